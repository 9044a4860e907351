import numpy as np
import pandas as pd
import xxhash

from codeloupe.llm import simhash_dedup as m
from tests.llm.conftest import prose


def plain_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def brute(rows):
    """doc_id, fingerprint, n_near and component_id by comparing all pairs."""
    fps = np.array([plain_simhash(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.array([2**64 if i is None else i for i, _ in rows], object)
    while True:
        new = np.array([label[near[k]].min() for k in range(len(rows))], object)
        if (new == label).all():
            break
        label = new
    return sorted((str(i), f"{int(f):016x}", int(n) - 1, None if c == 2**64 else int(c)) for (i, _), f, n, c in zip(rows, fps, near.sum(1), label))


def ours(df):
    found = m.near_duplicates(df).toPandas()
    return sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.fingerprint, int(r.n_near), None if pd.isna(r.component_id) else int(r.component_id)) for r in found.itertuples())


def test_odd_rows(docs, odd):
    assert ours(docs(odd)) == brute(odd)


def test_chains_and_copies(docs):
    base = prose(5, 400).split()
    rows = []
    for k in range(24):
        words = list(base)
        for j in range(k):
            words[j * 15] = f"changed{j}"
        rows += [(100 - k, " ".join(words)), (200 + k, " ".join(words))]
    rows += [(300 + k, prose(50 + k, 30)) for k in range(20)]
    assert ours(docs(rows)) == brute(rows)


def test_no_link_of_chosen_fingerprints_is_lost(spark):
    r = np.random.default_rng(1)
    fps = [int(x) for x in r.integers(0, 1 << 63, 40, dtype=np.uint64)]
    for f in fps[:30]:
        for _ in range(3):
            a, b = r.integers(0, 64, 2)
            fps.append(f ^ (1 << int(a)) ^ (1 << int(b)))
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f, 1, (False, k)) for k, f in enumerate(signed)], "fp long, n long, first struct<none: boolean, id: long>")
    found = sorted((r.fp, r.fp2) for r in m.links(classes).collect())
    assert found == sorted((a, b) for i, a in enumerate(signed) for j, b in enumerate(signed) if i != j and (fps[i] ^ fps[j]).bit_count() <= 2)


def test_ends_of_the_type(docs):
    rows = [(2**63 - 1, "a b c d"), (2**63 - 1, "e f g h"), (-(2**63), "i j k l"), (None, "m n o p"), (None, "m n o p"), (None, "a b c d"), (0, "q r s t")]
    found = sorted((str(r.doc_id), r.fingerprint, r.n_near, r.component_id) for r in m.near_duplicates(docs(rows)).collect())
    assert found == brute(rows)
    kept = sorted((str(r.doc_id), r.text) for r in m.deduplicate(docs(rows)).collect())
    assert kept == [("-9223372036854775808", "i j k l"), ("0", "q r s t"), ("9223372036854775807", "a b c d"), ("9223372036854775807", "e f g h"), ("None", "m n o p")]


def test_clashing_and_dotted_columns(docs):
    df = docs([(1, "a b c d"), (2, "a b c d"), (2, "w x y z"), (3, None)]).selectExpr("*", "2 AS __id", "3 AS row", "4 AS first", "5 AS fp", "6 AS `a.b`")
    kept = m.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.drop("lang", "source", "n_chars").collect()), key=str) == [(1, "a b c d", 2, 3, 4, 5, 6), (2, "w x y z", 2, 3, 4, 5, 6), (3, None, 2, 3, 4, 5, 6)]


def test_nothing(docs):
    assert ours(docs([])) == [] and m.deduplicate(docs([])).count() == 0


def test_one_of_each_component_stays(docs, odd):
    kept = m.deduplicate(docs(odd))
    assert kept.columns == docs([]).columns
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect())
    components = {c for *_, c in brute(odd)}
    assert len(found) == len(components) + sum(1 for i, _, _, c in brute(odd) if i == "4" and c == 4) - 1
    assert (1, None) in found and (2, "") not in found and (5, prose(1, 40)) not in found


def test_extra_columns_pass(docs):
    df = docs([(1, "a b c d"), (2, "a b c d")]).selectExpr("*", "1 AS fp", "2 AS component", "3 AS n")
    assert m.deduplicate(df).select("doc_id", "fp", "component", "n").collect() == [(1, 1, 2, 3)]
    assert m.near_duplicates(df).count() == 2
