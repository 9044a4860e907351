import zlib

import numpy as np
import pytest

from codeloupe.llm import sharding as m
from tests.llm.conftest import prose


def smallest_capacity(sizes, shards):
    def fits(c):
        n, load = 1, 0
        for s in sizes:
            if load + s > c:
                n, load = n + 1, 0
            load += s
        return n <= shards

    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def groups(spark, sizes, keys=None):
    return spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys if keys is not None else range(len(sizes)), sizes)], "key long, size long")


@pytest.mark.parametrize("seed", range(6))
def test_capacity_like_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 60))
    sizes = r.integers(1, 1000, n)
    if seed % 2:
        sizes[n // 2] = sizes.sum() // 2  # a third of all
    # Close keys need all levels of ranges.
    keys = np.sort(r.choice(10_000, n, replace=False)) if seed % 3 else np.sort(r.integers(-(1 << 62), 1 << 62, n))
    capacity, ends = m.cuts(groups(spark, sizes, keys), 8)
    assert capacity == smallest_capacity(sizes.tolist(), 8)
    place = (keys[:, None] > np.array(ends)[None, :]).sum(1) if ends else np.zeros(n, int)
    loads = np.bincount(place, sizes, 8)
    assert loads.max() <= capacity and len(loads) <= 8


def test_rows(docs, odd):
    rows = odd + [(k, prose(k, 20)) for k in range(100, 200)] + [(k, prose(3, 9)) for k in range(300, 330)]
    found = m.assignments(docs(rows).selectExpr("*", "'x' AS slot", "1 AS __n")).toPandas()
    assert len(found) == len(rows) and found.columns.tolist() == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    texts = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted(zip(found["size"], found.text_crc32)) == texts
    assert found.groupby("text_crc32").shard.nunique().max() == 1
    for _, g in found.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert found.shard.between(0, 7).all() and found.grown_shard.isna().all() and set(found.law) == {"bytes"}


def test_columns_pass(docs):
    found = m.shard(docs([(1, "a"), (2, None)]))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert found.count() == 2 and m.shard(docs([])).count() == 0


def test_clashing_and_dotted_columns(docs):
    df = docs([(1, "a"), (2, None), (2, "b")]).selectExpr("*", "1 AS __key", "2 AS key", "3 AS row", "4 AS id", "5 AS `a.b`", "6 AS size", "7 AS piece", "8 AS nth")
    found = m.shard(df, 2)
    assert found.columns == [*(c for c in df.columns if c != "size"), "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted((r.doc_id, r["__key"], r.key, r.row, r.id, r["a.b"], r.piece, r["size"]) for r in found.collect()) == [(1, 1, 2, 3, 4, 5, 7, 2), (2, 1, 2, 3, 4, 5, 7, 1), (2, 1, 2, 3, 4, 5, 7, 2)]


def plain_cuts(sizes, shards):
    """Capacity and cuts of the groups in order, by trying every capacity upwards."""
    capacity = max(sizes)
    while True:
        found, inside = [0], 0
        for size in sizes:
            if inside + size > capacity:
                found.append(0)
                inside = 0
            inside += size
            found[-1] += 1
        if len(found) <= shards:
            return capacity, found
        capacity += 1


def test_cuts_like_brute_force(docs):
    rows = [(k, prose(k % 37, 1 + k * k % 90)) for k in range(150)] + [(200 + k, prose(7, 50)) for k in range(60)]
    df = docs(rows)
    groups = {}
    for r in df.selectExpr("xxhash64(text) AS key", "octet_length(text) + 1 AS size").collect():
        groups[r.key] = groups.get(r.key, 0) + r["size"]
    capacity, counts = plain_cuts([groups[k] for k in sorted(groups)], 8)
    shard_of = dict(zip(sorted(groups), [s for s, n in enumerate(counts) for _ in range(n)]))
    found = m.assignments(df).join(df.selectExpr("doc_id", "xxhash64(text) AS key"), "doc_id").collect()
    assert all(r.shard == shard_of[r.key] for r in found)
    totals = {}
    for r in found:
        totals[r.shard] = totals.get(r.shard, 0) + r["size"]
    assert max(totals.values()) == capacity
