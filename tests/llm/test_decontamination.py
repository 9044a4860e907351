import hashlib
import re

import pytest

from codeloupe.llm import decontamination as m
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(m.UPPER, m.LOWER)))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    found = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for size in {len(g) for g in windows}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    ids |= windows[g]
        found.append((str(doc_id), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(found)


@pytest.fixture(scope="module")
def items():
    return [(1, prose(100, 30)), (2, prose(101, 9)), (3, ""), (4, None), (10, prose(100, 14)), (11, "Solo"), (12, prose(102, 60)), (12, prose(102, 60))]


@pytest.fixture(scope="module")
def rows(odd):
    a, b, c = prose(100, 30), prose(101, 9), prose(102, 60)
    more = [
        (20, f"{prose(8, 20)} {a.upper()}; {prose(9, 10)}"), (21, f"{prose(8, 7)}, {b}!"), (22, " ".join(a.split()[3:13])), (23, " ".join(a.split()[3:12])), (24, "a Solo b"), (25, f"{c} {c} {a}"),
        (26, " ".join(b.split()[1:])), (27, "ſolo solos"), (28, "\n".join(c.split()[20:45])), (29, f"solo {prose(8, 9)} {a} it's solo"),
    ]
    return odd + more


def ours(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


@pytest.mark.parametrize("most, keys", [(m.MAX_WINDOWS, m.MAX_KEYS), (0, m.MAX_KEYS), (m.MAX_WINDOWS, 0), (0, 0)])
def test_like_brute_force_with_the_filter_and_with_joins(spark, docs, rows, items, most, keys):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert ours(m.contamination(docs(rows), benchmark, max_windows=most, max_keys=keys)) == brute(rows, items)
    gone = {b[0] for b in brute(rows, items) if b[-1]}
    kept = m.decontaminate(docs(rows), benchmark, max_windows=most, max_keys=keys).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in rows if str(r[0]) not in gone)


def test_a_full_filter_gives_the_same_rows(spark, docs, rows, items, monkeypatch):
    """The filter only saves work: one that lets nearly everything pass changes nothing."""
    monkeypatch.setattr(m, "KEY_BITS", 0)
    assert ours(m.contamination(docs(rows), spark.createDataFrame(items, "item_id long, text string"))) == brute(rows, items)


def test_many_windows(spark, docs):
    """200,000 windows: the filter and the join of the windows it leaves."""
    benchmark = spark.sql("SELECT id AS item_id, array_join(transform(sequence(0, 99), i -> concat('w', abs(hash(id, i)) % 5000)), ' ') AS text FROM range(2200)")
    own = [r.text for r in benchmark.limit(3).collect()]
    rows = [(1, prose(1, 3000)), (2, f"{prose(2, 20)} {' '.join(own[0].split()[5:15])}"), (3, own[1]), (4, " ".join(own[2].split()[:9]))]
    assert m.Windows(benchmark, 10, m.MAX_WINDOWS, m.MAX_KEYS).distinct.count() > 200_000 - 2000
    found = {r.doc_id: r.n_hit for r in m.contamination(docs(rows), benchmark).collect()}
    assert found == {1: 0, 2: 10, 3: 100, 4: 0}


def test_clashing_and_dotted_columns(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = docs([(1, "Solo"), (2, "x"), (3, None)]).selectExpr("*", "1 AS __w", "2 AS __rid", "3 AS row", "4 AS `a.b`", "5 AS __c", "6 AS runs", "7 AS gram")
    assert sorted(r.doc_id for r in m.decontaminate(df, benchmark).select(df.columns[:6] + ["`a.b`"]).collect()) == [2, 3]
    assert [r[0] for r in m.decontaminate(df, benchmark, remove="spans").where("doc_id = 1").select("text").collect()] == [""]
    assert m.decontaminate(df, benchmark).columns == df.columns and m.contamination(df, benchmark).count() == 3


def test_without_short_items(spark, docs, rows, items):
    long_ = [x for x in items if len(words(x[1])) >= 10]
    assert ours(m.contamination(docs(rows), spark.createDataFrame(long_, "item_id long, text string"))) == brute(rows, long_)


def test_empty_tables(spark, docs, rows, items):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert ours(m.contamination(docs(rows), nothing)) == brute(rows, [])
    assert m.contamination(docs([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_documents_go_whole(spark, docs, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = m.decontaminate(docs(rows).selectExpr("*", "1 AS w", "2 AS hits", "3 AS rid", "4 AS n_hit"), benchmark)
    assert kept.columns[-4:] == ["w", "hits", "rid", "n_hit"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(b[0] for b in brute(rows, items) if not b[-1])


def test_spans_go_and_the_rest_stays(spark, docs, rows, items):
    benchmark = spark.createDataFrame([x for x in items if x[0] != 11], "item_id long, text string")
    cut = {r.doc_id: r.text for r in m.decontaminate(docs(rows), benchmark, remove="spans").collect()}
    assert cut[20] == f"{prose(8, 20)} ; {prose(9, 10)}"
    assert cut[21] == f"{prose(8, 7)}, !"
    assert cut[22] == "" and cut[23] == rows[-7][1] and cut[1] is None
    assert not m.contamination(docs([(k, v) for k, v in cut.items() if k is not None]), benchmark).filter("contaminated").count()


def test_no_python_on_the_main_path(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    plan = m.contamination(docs([(1, "a")]), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
