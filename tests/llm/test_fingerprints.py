import hashlib

import numpy as np
import pandas as pd
import pytest

from codeloupe.llm import fingerprints as m
from tests.llm.conftest import prose


def number(data):
    return np.array([int.from_bytes(data, "little")], np.uint64)


def plain_syncmers(text):
    """The anchors by their definition, one k-mer after the other."""
    whole, found = bytes(m.K - 1) + text, []
    if not text:
        return found
    hashes = [int(m.mixed(number(whole[i : i + m.S]) + np.uint64(0x9E3779B97F4A7C15))[0]) for i in range(len(whole) - m.S + 1)]
    for i in range(len(whole) - m.K + 1):
        own = hashes[i : i + m.K - m.S + 1]
        if min(own) in (own[0], own[-1]):
            found.append(int((m.mixed(m.mixed(number(whole[i : i + 8])) + number(whole[i + 8 : i + 16])) & m.MASK)[0]))
    return found


@pytest.mark.parametrize("text", [prose(1, 60).encode(), b"ab" * 60, "zwölf Boxkämpfer".encode(), b"", b"a", bytes(40), *(prose(5, 40).encode()[:n] for n in (2, 7, 15, 16, 17, 31, 63, 64, 65))])
def test_syncmers_like_brute_force(text):
    found = m.syncmers(text)
    assert found.tolist() == plain_syncmers(text)
    assert bool(len(found)) == bool(text)
    assert m.read(m.shown(found)).tolist() == found.tolist()


def plain_likeness(a, b):
    """The longest common subsequence by dynamic programming, for anchors that stand once in each."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1] / (len(a) + len(b) - row[-1]) if a or b else 1.0


@pytest.mark.parametrize("seed", range(20))
def test_likeness_like_brute_force(seed):
    r = np.random.default_rng(seed)
    a = r.permutation(60)[: r.integers(0, 60)].astype(np.uint32)
    b = r.permutation(60)[: r.integers(0, 60)].astype(np.uint32) if seed % 2 else np.concatenate([a[:20], a[30:], a[20:25]]).astype(np.uint32)
    assert m.likeness(a, b) == pytest.approx(plain_likeness(a.tolist(), b.tolist())) == m.likeness(b, a)


def test_repeats_count():
    line = prose(3, 12).encode() + b"\n"
    assert m.likeness(m.syncmers(line), m.syncmers(line * 50)) < 0.1 and m.likeness(m.syncmers(line * 49), m.syncmers(line * 50)) > 0.9


@pytest.mark.parametrize("n", [4, 8, 14, 15, 16, 17, 18, 24, 31, 32, 33, 63, 64, 65, 127, 128, 511, 4095])
def test_no_length_is_a_border(n):
    """One byte more at the end adds one anchor at most, at every length; one at the front changes those of the margin."""
    text = prose(8, 2000).encode()
    short, long = m.syncmers(text[:n]), m.syncmers(text[: n + 1])
    assert m.likeness(short, long) >= len(short) / (len(short) + 1)
    assert n < 63 or m.likeness(m.syncmers(text[1 : n + 1]), long) > 0.3


def test_passages_of_long_texts_are_matched():
    passage, long = prose(1, 60).encode(), prose(2, 20_000).encode()
    inside = set(m.syncmers(passage).tolist())
    kept = inside & set(m.syncmers(long[:50_000] + passage + long[50_000:]).tolist())
    assert len(kept) > 0.9 * len(inside)  # all but those of the margin


def test_every_byte_is_in_an_anchor():
    text = prose(9, 400).encode()
    whole = m.shown(m.syncmers(text))
    assert all(m.shown(m.syncmers(text[:i] + b"~" + text[i + 1 :])) != whole for i in range(0, len(text), 7))


def test_syncmers_in_blocks(monkeypatch):
    text = prose(4, 500).encode()
    whole = m.syncmers(text)
    monkeypatch.setattr(m, "BLOCK", 100)
    assert (m.syncmers(text) == whole).all()


def test_anchors_do_not_depend_on_context():
    passage = prose(1, 100).encode()
    inside = m.syncmers(passage).tolist()
    around = m.syncmers(prose(2, 50).encode() + b" " + passage + b" " + prose(3, 50).encode()).tolist()
    own = [x for x in inside if x in set(around)]
    assert len(own) >= len(inside) - m.K + 1 and m.likeness(np.array(own), np.array(around)) == len(own) / len(around)


def test_likeness():
    a, b = m.syncmers(prose(1, 300).encode()), m.syncmers(prose(2, 300).encode())
    assert m.likeness(a, a) == 1 and m.likeness(a, b) < 0.05
    none = m.syncmers(b"")
    assert m.likeness(none, none) == 1 and m.likeness(none, a) == 0
    assert m.likeness(a, a[::-1]) < 0.1  # the same anchors in another order


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    found = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = m.edited(t, nxt)
        x, y, z = (m.syncmers(s.encode()) for s in (t, e, nxt))
        found.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), m.shown(x), m.shown(y), m.likeness(x, y), m.likeness(x, z)))
    return found


def ours(df):
    return [(None if pd.isna(r.doc_id) else int(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in m.compare(df).toPandas().sort_values("doc_id", na_position="first").itertuples()]


def test_like_brute_force(docs):
    rows = [(k * 7 % 101, prose(k, 3 + k * 5)) for k in range(101)] + [(200, None), (201, ""), (202, "ab"), (203, "é" * 50), (None, "first of all")]
    assert ours(docs(rows).repartition(5)) == brute(rows)


def test_edges(docs, odd):
    assert m.edited("abcdefgh", "x") == "abcdefx" and m.edited("abc", "xyz") == "abc" and m.edited("abcd", "") == "abc"
    assert ours(docs([])) == [] and ours(docs([(3, "only")])) == brute([(3, "only")])
    found = m.compare(docs(odd).selectExpr("*", "1 AS bucket", "2 AS tail")).toPandas()
    assert len(found) == len(odd) and found.near_edited.between(0, 1).all()
    same = found[found.doc_id == 5].fingerprint
    assert same.nunique() == 1
