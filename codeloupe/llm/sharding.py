"""Sharding by minimax contiguous partition.

Documents with equal texts are an atomic group; groups are ordered by their texts' hash. The
smallest shard capacity for which a greedy pass over the ordered group sizes needs no more shards
than there are is found by binary search, and the greedy cuts of that capacity are the shards' ends.

The sizes of all groups never reach the driver. It knows the totals of hash ranges: at first 65,536
ranges, and a range that a greedy pass ends in, if it holds several groups, is split into 65,536
smaller ones by a further aggregation. A capacity is feasible if the greedy pass over known ends
succeeds, infeasible if even one that may cut anywhere inside unsplit ranges fails; only in between
are ranges split. So a group with a third of all bytes costs one row, and the memory of the driver
depends on the number of shards alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloupe.llm.common import checkpointed, columns, packed

SHARDS = 8
#: Bits of the hash that one level of ranges splits by.
BITS = 16
#: Pieces of a shard whose rows are numbered apart from each other.
PIECES = 1024


def described(row: Column, doc_id: Column, text: Column) -> list[Column]:
    """``row`` and what its place follows from. Two texts of one hash (``key``) would only share a shard."""
    known = F.coalesce(text, F.lit(""))
    return [row.alias("row"), doc_id.alias("id"), (F.octet_length(known).cast("long") + 1).alias("size"), F.crc32(known.cast("binary")).alias("text_crc32"), F.xxhash64(known).alias("key")]


class Ranges:
    """Consecutive hash ranges with their total sizes, as far as the groups have been split."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        rows = self._split(F.lit(True), 64 - BITS)
        self.high, self.total, self.count, self.shift = rows

    def _split(self, where: Column, shift: int) -> tuple[np.ndarray, ...]:
        prefix = F.shiftright("key", shift)
        rows = self.groups.where(where).groupBy(prefix.alias("prefix")).agg(F.sum("size"), F.count("*")).orderBy("prefix").collect()
        prefixes = np.array([r[0] for r in rows], np.int64)
        high = (prefixes << shift) | np.int64((1 << shift) - 1) if shift else prefixes
        return high, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.full(len(rows), shift)

    def refine(self, nodes: set[int]) -> None:
        """Splits the named ranges."""
        for shift in sorted({int(self.shift[i]) for i in nodes}):
            own = [i for i in nodes if self.shift[i] == shift]
            where = F.shiftright("key", shift).isin([int(self.high[i]) >> shift for i in own])
            parts = self._split(where, shift - BITS)
            stay = np.ones(len(self.high), bool)
            stay[own] = False
            mixed = [np.concatenate([a[stay], b]) for a, b in zip((self.high, self.total, self.count, self.shift), parts)]
            order = np.argsort(mixed[0], kind="stable")
            # Ranges move, so those of other levels are named by their ends.
            ends = {int(self.high[i]) for i in nodes}
            self.high, self.total, self.count, self.shift = (x[order] for x in mixed)
            nodes = {i for i in np.flatnonzero(self.count > 1) if int(self.high[i]) in ends and self.shift[i] > shift}

    def greedy(self, capacity: int, shards: int, hopeful: bool) -> tuple[bool, list[int], set[int]]:
        """Whether a pass reaches the end; its cuts, as numbers of ranges; unsplit ranges it met.

        A hopeful pass takes every point inside an unsplit range for a group's end.
        """
        ends = np.concatenate([[0], np.cumsum(self.total)])
        at, cuts, met = 0, [], set()
        for _ in range(shards):
            to = at + capacity
            k = int(np.searchsorted(ends, to, side="right")) - 1
            if k >= len(self.total):
                return True, cuts, met
            inside = self.count[k] > 1
            if inside:
                met.add(k)
            at = to if hopeful and inside else max(at, int(ends[k]))
            cuts.append(k)
        return False, cuts, met


def cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The smallest capacity, and the last hash of every shard but the last; ``groups`` has unique ``key`` and ``size``."""
    ranges = Ranges(groups)
    if not len(ranges.total):
        return 0, []
    largest = groups.agg(F.max("size")).collect()[0][0]
    low, high = max(largest, -(-int(ranges.total.sum()) // shards)), int(ranges.total.sum())
    while low < high:
        middle = (low + high) // 2
        surely, _, met = ranges.greedy(middle, shards, hopeful=False)
        if surely:
            high = middle
            continue
        maybe, _, further = ranges.greedy(middle, shards, hopeful=True)
        if not maybe:
            low = middle + 1
        else:
            ranges.refine(met | further)
    while True:
        fits, found, met = ranges.greedy(low, shards, hopeful=False)
        if fits:
            return low, [int(ranges.high[k - 1]) for k in found]
        ranges.refine(met)


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """``described`` rows with ``shard`` and ``slot``."""
    groups = checkpointed(rows.groupBy("key").agg(F.sum("size").alias("size")))
    _, ends = cuts(groups, shards)
    place = sum((F.when(F.col("key") > end, 1).otherwise(0) for end in ends), F.lit(0)) if ends else F.lit(0)
    placed = rows.withColumn("shard", place.cast("int")).withColumn("piece", F.pmod(F.xxhash64("id", "key"), F.lit(PIECES)).cast("int"))
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x PIECES rows, whatever the input.
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "piece").orderBy("id", "key")
    return placed.withColumn("nth", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "piece"]).withColumn("slot", (F.col("start") + F.col("nth") - 1).cast("long"))


RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def results() -> list[Column]:
    return [F.col("size"), F.col("text_crc32"), F.lit("bytes").alias("law"), F.col("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard")]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``; columns of these names are replaced.

    The law is ``bytes``: the largest shard is as small as cuts between groups in hash order allow.
    Equal texts, null and empty ones among them, share a shard; repeated rows get a slot each. A
    shard's slots run from 0 without a gap: first by pieces of a hash of the row's doc_id and text,
    then by doc_id. Fewer groups than shards leave shards empty, an empty table gives no row.
    Other columns pass through, whatever their names. ``grown_shard`` is null under this law.
    """
    own = [c for c in docs.columns if c not in RESULT]
    row = F.col("row")
    rows = packed(docs).select(*described(row, row["doc_id"], row["text"].cast("string")))
    return numbered(rows, shards).select(*(row.getField(c).alias(c) for c in own), *results())


def assignments(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``; texts are not shuffled."""
    own = columns(docs, doc_id="long", text="string")
    return numbered(own.select(*described(F.col("doc_id"), F.col("doc_id"), F.col("text"))), shards).select(F.col("row").alias("doc_id"), *results())
