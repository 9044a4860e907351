"""Document fingerprints of closed syncmers.

A k-mer of a text's UTF-8 bytes is a closed syncmer if the smallest of its s-mers, by hash, is its
first or its last one. That depends on the k-mer alone, so the same passage gives the same anchors
wherever it stands. A text is read behind a margin of ``K - 1`` zero bytes, so that texts of any
length, also shorter than ``K``, have anchors by one rule. A fingerprint holds all anchors in the
order of their places, nothing is left out: about ``2 / (K - S + 2)`` anchors a byte, and every byte
of the text is in one at least. Two fingerprints are compared by their longest common run of anchors
in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloupe.llm.common import columns, partitions, slices

K, S = 16, 6
#: Hexadecimal digits of an anchor in a fingerprint. Two different anchors are taken for one by chance of 1 in 16^6,
#: which adds some 0.05 % to a likeness at most: the longest rising run of that many chance matches.
DIGITS = 6
MASK = np.uint64((1 << 4 * DIGITS) - 1)
#: Bytes that are hashed at once.
BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash: each bit of the input changes about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def syncmers(text: bytes) -> np.ndarray:
    """The hashes, of ``DIGITS`` hexadecimal digits, of a text's closed syncmers in order; '' has none."""
    if not text:
        return np.zeros(0, np.uint32)
    whole = bytes(K - 1) + text
    found = []
    places = K - S + 1
    for at in range(0, len(whole) - K + 1, BLOCK):
        data = np.frombuffer(whole[at : at + BLOCK + K - 1] + bytes(8), np.uint8)
        n = len(data) - 8 - K + 1
        eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
        small = mixed((eights[: n + places - 1] & np.uint64((1 << 8 * S) - 1)) + np.uint64(0x9E3779B97F4A7C15))  # zero bytes are nothing special
        least, width = small, 1
        while width * 2 <= places:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[places - width : places - width + n])
        chosen = np.flatnonzero((small[:n] == least) | (small[places - 1 : places - 1 + n] == least))
        found.append((mixed(mixed(eights[chosen]) + eights[chosen + 8]) & MASK).astype(np.uint32))
    return np.concatenate(found)


def shown(anchors: np.ndarray) -> str:
    """The fingerprint as text: ``DIGITS`` digits an anchor."""
    return anchors.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - DIGITS // 2 :].tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    """The anchors of a fingerprint that ``shown`` has made."""
    made = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, DIGITS // 2)
    return np.pad(made, ((0, 0), (4 - DIGITS // 2, 0))).copy().view(">u4").ravel().astype(np.uint32)


def numbered(anchors: np.ndarray) -> np.ndarray:
    """Anchors that differ throughout: the first of a kind, the second of that kind and so on."""
    order = np.argsort(anchors, kind="stable")
    own = anchors[order]
    new = np.append(True, own[1:] != own[:-1])
    at = np.arange(len(own))
    out = np.empty(len(own), np.uint64)
    out[order] = own.astype(np.uint64) << np.uint64(32) | (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: anchors in the longest common run of the same order, over all anchors of both.

    An anchor that stands n times in both counts n times, the i-th matched with the i-th. Two empty
    fingerprints are alike.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    total, least = len(a) + len(b), min(len(a), len(b))
    # What both begin and end with is common without a search.
    differ = np.flatnonzero(a[:least] != b[:least])
    front = int(differ[0]) if len(differ) else least
    a, b = a[front:], b[front:]
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:least] != b[::-1][:least])
    back = int(differ[0]) if len(differ) else least
    a, b = a[: len(a) - back], b[: len(b) - back]
    ends: list[int] = []
    if len(a) and len(b):
        _, at, places = np.intersect1d(numbered(a), numbered(b), assume_unique=True, return_indices=True)
        for i in places[np.argsort(at)].tolist():  # the longest rising run of places
            j = bisect_left(ends, i)
            ends[j : j + 1] = [i]
    common = front + back + len(ends)
    return common / (total - common)


def edited(text: str, following: str) -> str:
    """The text with its last quarter (in code points, rounded down) replaced by the start of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut] if cut else text


def successive(docs: DataFrame) -> DataFrame:
    """``bucket, doc_id, text, tail``: rows dealt by ranges of doc_id to their partitions, in order.

    Rows of a partition are one bucket or several whole ones. Each bucket ends with a copy of the
    row that follows it (``tail``), the first of the next bucket; the last one's is the first row of
    all. The bounds and the first rows' doc_ids come from passes over that column alone, the first
    rows' texts from a scan with these doc_ids pushed down; the texts are shuffled once.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = columns(docs, doc_id="long", text="string").withColumn("__place", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    n = partitions(spark)
    inner = sorted({float(x) for x in rows.where("doc_id is not null").approxQuantile("__place", [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    splits = [float("-inf"), *(inner or [0.0]), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="__place", outputCol="__bucket").transform(rows).withColumn("bucket", F.col("__bucket").cast("int")).drop("__bucket", "__place")
    # The first doc_id of each bucket, as many rows as buckets: null comes before all others.
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    firsts = [(r["bucket"], r["first"]["doc_id"]) for r in rows.groupBy("bucket").agg(F.min(first).alias("first")).orderBy("bucket").collect()]
    if not firsts:
        return rows.select("bucket", "doc_id", "text", F.lit(False).alias("tail"))
    before = {bucket: firsts[i - 1][0] for i, (bucket, _) in enumerate(firsts)}
    wanted = F.col("doc_id").isin([i for _, i in firsts if i is not None])
    if any(i is None for _, i in firsts):
        wanted = wanted | F.col("doc_id").isNull()
    # Of repeated doc_ids the text of the smallest hash is first.
    heads = rows.where(wanted).groupBy("bucket", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    ends = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("bucket"))
    tails = heads.select(ends.alias("bucket"), "doc_id", "text", F.lit(True).alias("tail"))
    both = rows.select("bucket", "doc_id", "text", F.lit(False).alias("tail")).unionByName(tails)
    return both.repartitionById(len(splits) - 1, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its fingerprint, its edited text's, and how near that and the next row's are.

    Null texts count as empty, which have the fingerprint ''. Rows follow each other by doc_id, null
    ones first, repeated ones by a hash of their texts; an only row is followed by itself. An empty
    table gives no row, other columns are not read. Texts of any length are fingerprinted whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, until the next one is known
        for batch in batches:
            for part, texts in slices(batch, "text"):
                made: list[tuple] = []
                for doc_id, tail, raw in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), texts):
                    now = (doc_id, raw.decode("utf-8", "replace"), syncmers(raw))
                    if held is not None:
                        id_, text, own = held
                        other = edited(text, now[1]).encode()
                        new = syncmers(other)
                        made.append((id_, len(text), hashlib.sha256(other).hexdigest(), shown(own), shown(new), likeness(own, new), likeness(own, now[2])))
                    held = None if tail else now
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    return successive(docs).mapInArrow(run, SCHEMA)
