"""Labelled samples for the classifiers: who is held out, and which rows a model may learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloupe.llm.common import columns

#: Labels are learned from rows of remainders 1 to 4; remainder 0 is held out.
FOLDS = 5
#: Bytes of text that a model learns from at most.
MOST_BYTES = 64 << 20


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo ``FOLDS``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = MOST_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and 0/1 labels of ``most`` labelled rows at most, none of them held out.

    The rows with the smallest hashes of their doc_ids are taken, so that the sample depends on
    neither the order nor the layout of the tables; one whose text doesn't fit into what is left of
    ``most_bytes`` is passed over. Rows with null labels or doc_ids are left out; of repeated doc_ids
    the smallest label and the largest text count, chosen before anything is sent. So the driver gets
    ``most`` rows and ``most_bytes`` bytes of text at most, whatever the tables' sizes, and ``most``
    rows are broadcast.
    """
    chosen = (
        columns(labels, doc_id="long", **{label: "int"})
        .where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder() != 0))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = columns(docs, doc_id="long", text="string")
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("size"), F.xxhash64("doc_id").alias("place"))
    kept, left = [], most_bytes
    for _, doc_id, y, size in sorted((r.place, r.doc_id, r.label, r.size) for r in sizes.collect()):
        if size <= left:
            kept.append((doc_id, y))
            left -= size
    if not kept:
        return [], np.zeros(0, np.int64)
    wanted = F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long, label int"))
    found = texts.join(wanted, "doc_id").groupBy("doc_id", "label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).collect()
    found.sort(key=lambda r: r.doc_id)
    return [r.text.encode() for r in found], np.array([r.label for r in found], np.int64)
