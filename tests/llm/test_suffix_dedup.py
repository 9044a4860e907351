import hashlib

import numpy as np
import pytest

from codeloupe.llm import suffix_dedup as m
from tests.llm.conftest import prose


def brute(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] is not None, (rows[k][1] or "").encode()))
    seen, found = set(), []
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        found.append((str(rows[k][0]), len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(found)


def ours(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.summary(df).collect())


def passages():
    p, q = prose(60, 40), prose(61, 25)
    rows = [(k, f"{prose(70 + k, 5 + k)} {p} {prose(90 + k, 8)} {q[: 90 + k]}") for k in range(40)]
    rows += [(100, "ab" * 300), (101, "x" + "ab" * 120), (102, p + p), (103, p[:100]), (104, p[1:100]), (105, p[:99]), (106, "z" * 99), (107, "z" * 101), (108, "é" * 80 + p), (109, "é" * 80)]
    return rows


def test_like_brute_force(docs):
    rows = passages()
    assert ours(docs(rows)) == brute(rows)


@pytest.mark.parametrize("crowd, bucket", [(2, 100), (256, 3), (1, 1)])
def test_crowded_anchors(docs, monkeypatch, crowd, bucket):
    monkeypatch.setattr(m, "CROWD", crowd)
    monkeypatch.setattr(m, "BUCKET_CROWD", bucket)
    rows = passages()
    assert ours(docs(rows).repartition(3)) == brute(rows)


def test_small_slices(docs, monkeypatch):
    monkeypatch.setattr(m, "TEXT_BYTES", 500)
    monkeypatch.setattr(m, "RUNS", 5)
    monkeypatch.setattr(m, "WINDOW_BYTES", 3000)
    monkeypatch.setattr(m, "CROWD", 1)
    rows = passages()
    assert ours(docs(rows)) == brute(rows)


def test_odd_rows(docs, odd):
    assert ours(docs(odd)) == brute(odd)


def test_nothing(docs):
    assert ours(docs([])) == []


def test_suffix_order():
    r = np.random.default_rng(3)
    words = r.integers(0, 3, (500, 4)).astype(np.uint64)
    order, new = m.suffix_order(words)
    got = [tuple(x) for x in words[order].tolist()]
    assert got == sorted(map(tuple, words.tolist()))
    assert new.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]


def test_merged():
    doc, a, e = m.merged(np.array([2, 1, 1, 1, 2]), np.array([5, 0, 10, 3, 1]), np.array([9, 4, 12, 10, 6]))
    assert list(zip(doc.tolist(), a.tolist(), e.tolist())) == [(1, 0, 12), (2, 1, 9)]


def test_long_texts_in_blocks(docs, monkeypatch):
    """Blocks of one text, and slices of any size, choose the same anchors."""
    long = prose(200, 900)
    rows = [(1, long), (2, prose(201, 37) + long[:3000] + prose(202, 11) + long[1000:]), (3, prose(203, 60)), (4, long[777:2777]), (5, "ab" * 3000)]
    whole = ours(docs(rows))
    assert whole == brute(rows)
    for size in (100, 333, 1000):
        monkeypatch.setattr(m, "TEXT_BYTES", size)
        assert ours(docs(rows)) == whole


def test_memory_of_a_long_text():
    import tracemalloc

    text = np.random.default_rng(0).integers(97, 123, 8 << 20).astype(np.uint8).tobytes()
    m.Powers.of(1)
    tracemalloc.start()
    n = sum(len(m.runs(*block)[0]) for block in m.blocks([text], np.array([1])))
    assert n > len(text) // 80 and tracemalloc.get_traced_memory()[1] < 256 << 20
    tracemalloc.stop()


def test_buckets_grow_with_the_bytes(docs, monkeypatch):
    assert m.bucket_number(1, 8) == 8 and m.bucket_number(100 * m.BUCKET_BYTES + 1, 8) == 101
    monkeypatch.setattr(m, "BUCKET_BYTES", 500)
    rows = passages()
    assert ours(docs(rows)) == brute(rows)
