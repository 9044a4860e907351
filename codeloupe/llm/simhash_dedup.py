"""SimHash near-duplicate detection by multi-index hashing.

A document's 64-bit SimHash is the bitwise majority over the XXH64 hashes of its word shingles.
Two fingerprints link when they differ in at most two bits. With two 32-bit segments one segment of
a linked pair differs in at most one bit, so it is enough to look up the radius-one Hamming ball of
each segment (33 keys) in a table of the same segment, and to verify the whole distance there.
Everything after the fingerprints works on distinct fingerprints: documents with equal ones are one
row with a count, so a group of thousands of copies costs one probe and is never expanded.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloupe.llm.common import checkpointed, columns, map_texts, packed, unpacked

SEED = 42
MAX_DISTANCE = 2
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 17


def simhash(text: bytes, width: int = 3) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes; 0 without a word.

    A-Z are lower-cased, words are runs of anything but ASCII white space. A text of fewer than
    ``width`` words has its whole word sequence as its only shingle.
    """
    words = text.lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else [tuple(words)]
    count = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for i in range(0, count, BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def place_of(doc_id: Column) -> Column:
    """``struct<none, id>`` that orders documents by doc_id, null ones behind all others; no id is taken for null."""
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row of ``docs``."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        found = np.fromiter(map(simhash, texts), np.uint64, len(texts))
        return {"doc_id": part.column(0), "fp": pa.array(found.view(np.int64))}

    return map_texts(columns(docs, doc_id="long", text="string"), "text", "doc_id long, fp long", work)


def links(classes: DataFrame) -> DataFrame:
    """Every ordered pair of distinct fingerprints within ``MAX_DISTANCE``: ``fp, fp2, n2, first2``.

    ``classes`` has one row per fingerprint: ``fp, n, first``. A pair that both segments find is
    kept from the first one only, so no pair comes twice and none needs a distinct.
    """
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    # The key is the segment's value with the segment's number above its 32 bits.
    ball = f"""concat(array({low}), transform(sequence(0, 31), i -> ({low}) ^ shiftleft(1L, i)),
                      array(4294967296L | ({high})), transform(sequence(0, 31), i -> 4294967296L | (({high}) ^ shiftleft(1L, i))))"""
    probes = classes.select("fp", F.explode(F.expr(ball)).alias("key"))
    slots = classes.select(F.col("fp").alias("fp2"), F.col("n").alias("n2"), F.col("first").alias("first2"), F.explode(F.expr(f"array({low}, 4294967296L | ({high}))")).alias("slot"))
    verified = (
        (F.col("key") == F.col("slot"))
        & (F.col("fp") != F.col("fp2"))
        & F.expr(f"bit_count(fp ^ fp2) <= {MAX_DISTANCE}")
        & F.expr("key < 4294967296L or bit_count((fp ^ fp2) & 4294967295L) > 1")
    )
    return probes.join(slots, verified).select("fp", "fp2", "n2", "first2")


def components(edges: DataFrame) -> DataFrame:
    """``fp, component`` of every linked fingerprint, where ``component`` is the smallest reachable
    ``struct<first, fp>``: the smallest doc_id, with its fingerprint to tell repeated doc_ids apart.

    ``edges`` are the rows of ``links``, which hold each pair both ways. Labels spread to
    neighbours and then jump to their label's label, so a chain of n takes about log n rounds. Each
    round is aggregated by fingerprint before it is joined, and cut off by a checkpoint.
    """
    own = F.struct(F.col("first2").alias("first"), F.col("fp2").alias("fp"))
    labels = edges.groupBy(F.col("fp2").alias("fp")).agg(F.min(own).alias("component"))
    labels = checkpointed(labels.withColumn("own", F.col("component")))
    pairs = edges.select("fp", "fp2")
    while True:
        near = pairs.join(labels.select(F.col("fp").alias("fp2"), "component"), "fp2").groupBy("fp").agg(F.min("component").alias("near"))
        spread = labels.join(near, "fp").select("fp", "own", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        spread = checkpointed(spread)
        if not spread.where("moved").take(1):
            return spread.select("fp", "component")
        owners = spread.select(F.col("own").alias("component"), F.col("component").alias("further"))
        labels = checkpointed(spread.join(owners, "component").select("fp", "own", F.least("component", "further").alias("component")))


def assigned(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, n_near, component`` (``struct<first: struct<none, id>, fp>``) of every row of ``docs``."""
    rows = checkpointed(fingerprints(docs))
    classes = checkpointed(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(place_of(F.col("doc_id"))).alias("first")))
    edges = checkpointed(links(classes))
    counted = edges.groupBy("fp").agg(F.sum("n2").alias("beside"))
    per_class = (
        classes.join(counted, "fp", "left")
        .join(components(edges), "fp", "left")
        .select("fp", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_near"), F.coalesce("component", F.struct("first", "fp")).alias("component"))
    )
    return rows.join(per_class, "fp").select("doc_id", "fp", "n_near", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fingerprint, n_near, component_id``.

    ``n_near`` counts the other rows whose fingerprint differs in ``MAX_DISTANCE`` bits at most;
    ``component_id`` is the smallest doc_id reachable over such links. Null, empty and white-space
    texts have fingerprint zero and link like any other. A repeated row counts as one more
    document. A null doc_id names a component only if all of its component's are null.
    """
    return assigned(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "n_near",
        F.when(~F.col("component.first.none"), F.col("component.first.id")).alias("component_id"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per component: the one with the smallest doc_id.

    Among rows that share that doc_id, one with the component's own fingerprint stays. A component
    whose doc_ids are all null keeps one row. Null and empty texts are one component. An empty table
    stays empty. Extra columns pass through, whatever their names.
    """
    heads = checkpointed(assigned(docs).select("component.first", F.col("component.fp").alias("fp")).distinct())
    rows = packed(docs).withColumn("first", place_of(F.col("row")["doc_id"].cast("long")))
    times = rows.groupBy("first").agg(F.count("*").alias("times"))
    known = checkpointed(heads.join(times, "first"))
    # A doc_id that stands once needs no look at its text.
    once = rows.join(known.where("times = 1").select("first"), "first", "left_semi")
    if not known.where("times > 1").take(1):
        return unpacked(once, docs.columns)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash((x or "").encode()) for x in texts), np.uint64, len(texts)).view(np.int64))

    several = known.where("times > 1")
    repeated = rows.join(several.select("first").distinct(), "first", "left_semi").withColumn("fp", fingerprint(F.col("row")["text"].cast("string")))
    chosen = repeated.join(several.select("first", "fp"), ["first", "fp"], "left_semi").groupBy("first", "fp").agg(F.first("row").alias("row"))
    return unpacked(once.select("row").unionByName(chosen.select("row")), docs.columns)
