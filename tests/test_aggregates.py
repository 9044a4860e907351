import pytest

from codeloupe.operators import aggregates
from tests.helpers import refs, symbols, tuples
from tests.test_search import CALLER_CALLS, CALLER_ROWS


def files(spark, rows):
    return spark.createDataFrame([("r", p, language) for p, language in rows], "repo_id string, path string, language string").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS indexed_at")


@pytest.fixture(scope="module")
def report(spark):
    syms = symbols(spark, [("a.go", "main", "function", 1, 2), ("a.go", "serve", "method", 3, 4, "Server"), ("a.go", "Server", "class", 5, 6), ("b.go", "helper", "function", 1, 2), ("c.ts", "run", "function", 1, 2), ("c.ts", "Runner", "interface", 3, 4)])
    return files(spark, [("a.go", "go"), ("b.go", "go"), ("c.ts", "typescript"), ("d.py", "python")]), syms


def test_report(report):
    assert tuples(aggregates.report_totals(*report), "total_files", "total_symbols") == [(4, 6)]
    assert tuples(aggregates.report_languages(*report)) == [("go", 2, 4), ("typescript", 1, 2), ("python", 1, 0)]
    assert tuples(aggregates.report_types(report[1])) == [("function", 3), ("class", 1), ("interface", 1), ("method", 1)]


def test_report_of_nothing(spark):
    assert tuples(aggregates.report_totals(files(spark, []), symbols(spark, []))) == [(0, None, 0)]


def test_hotspots(spark):
    syms = symbols(spark, CALLER_ROWS)
    assert tuples(aggregates.hotspots(refs(spark, syms, CALLER_CALLS), syms)) == [("baz", "", 3), ("bar", "a.go", 2), ("foo", "a.go", 1)]


def test_hotspots_multiply_by_definitions(spark):
    syms = symbols(spark, [("b", "f", "function", 1, 2), ("a", "f", "method", 3, 4)])
    r = refs(spark, syms, [("x", "f", 1), ("x", "f", 2)])
    assert tuples(aggregates.hotspots(r, syms)) == [("f", "a", 4)]
    assert tuples(aggregates.hotspots(r, syms, distinct_calls=True)) == [("f", "a", 2)]


def test_tree(spark):
    syms = symbols(spark, [("a/b/c/deep.go", n, "function", 1, 2) for n in "xyz"] + [("a/top.go", "t", "function", 1, 2)])
    tree = aggregates.directory_tree(files(spark, [("a/b/c/deep.go", "go"), ("a/top.go", "go")]), syms)
    assert tuples(tree, "dir", "depth", "files", "symbols") == [(".", 0, 2, 4), ("a", 1, 2, 4), ("a/b", 2, 1, 3), ("a/b/c", 3, 1, 3)]
    assert aggregates.nested(tree)["children"][0]["children"][0]["path"] == "a/b"


def test_tree_languages(spark):
    tree = aggregates.directory_tree(files(spark, [("src/a.go", "go"), ("src/b.go", "go"), ("src/c.ts", "typescript")]), symbols(spark, []), depth=1)
    assert tuples(tree, "dir", "languages") == [(".", {"go": 2, "typescript": 1}), ("src", {"go": 2, "typescript": 1})]


@pytest.fixture(scope="module")
def dead(spark):
    syms = symbols(spark, [
        ("a.go", "usedFunc", "function", 1, 5), ("a.go", "deadFunc", "function", 7, 10), ("a.go", "DeadMethod", "method", 12, 15, "T"), ("a.go", "UsedMethod", "method", 17, 20, "T"),
        ("b.go", "ExportedDead", "function", 1, 5), ("b.go", "caller", "function", 7, 15), ("b.go", "testHelper", "function", 20, 21), ("b.go", "main", "function", 22, 23), ("c.rs", "hidden", "function", 1, 2),
    ])
    return syms, refs(spark, syms, [("b.go", "usedFunc", 9), ("b.go", "UsedMethod", 11)])


def test_dead(dead):
    find = lambda **q: [r[0] for r in tuples(aggregates.dead_symbols(*dead, **q), "name")]
    assert find() == ["deadFunc", "DeadMethod", "ExportedDead", "caller", "hidden"]
    assert find(unexported_only=True) == ["deadFunc", "caller"]
    assert find(type="method") == ["DeadMethod"]
    assert find(file="B.G_") == ["ExportedDead", "caller"]
    assert aggregates.dead_candidates(dead[0]).count() == 7


def test_dead_is_an_anti_join(dead):
    assert "LeftAnti" in aggregates.dead_symbols(*dead)._jdf.queryExecution().optimizedPlan().toString()
