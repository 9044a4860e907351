import pytest

from codeloupe.operators import search
from codeloupe.operators.search import SearchQuery
from tests.helpers import refs, symbols, tuples

ROWS = [
    ("file.go", "main", "function", 1, 5), ("file.go", "serve", "method", 7, 12, "Server"), ("file.go", "Server", "class", 14, 30),
    ("util.go", "helper", "function", 1, 4), ("util.go", "parse", "function", 6, 10), ("main.py", "run", "function", 1, 8),
]


@pytest.fixture(scope="module")
def syms(spark):
    return symbols(spark, ROWS)


def names(syms, **q):
    return [r[0] for r in tuples(search.search_symbols(syms, SearchQuery(**q)), "name")]


def test_filters(syms):
    assert names(syms) == ["main", "serve", "Server", "run", "helper", "parse"]
    assert names(syms, name="serve") == ["serve"]
    assert names(syms, like="SER") == ["serve", "Server"]
    assert names(syms, type="class") == ["Server"]
    assert names(syms, path="util") == ["helper", "parse"]
    assert names(syms, path="UTIL") == []
    assert names(syms, parent="*") == ["serve"]
    assert names(syms, limit=2) == ["main", "serve"]
    assert names(syms, name="Server.serve") == ["serve"]
    assert names(syms, name="Server.*") == ["serve"]
    assert names(syms, name="*.serve") == ["serve"]
    assert names(syms, name="serve", like="main") == ["serve"]


def test_a_negative_limit_is_an_error():
    with pytest.raises(ValueError):
        SearchQuery(limit=-1)


def test_first_of_each_keeps_document_order(spark):
    df = symbols(spark, [("a.go", "f", "function", 1, 2), ("a.go", "f", "function", 1, 9), ("a.go", "f", "method", 1, 2)])
    assert sorted(tuples(search.first_of_each(df), "type", "end_line")) == [("function", 2), ("method", 2)]


CALLER_ROWS = [("a.go", "foo", "function", 1, 6), ("a.go", "bar", "function", 7, 10), ("b.go", "run", "function", 1, 5), ("c.go", "init", "function", 1, 4)]
CALLER_CALLS = [("a.go", "bar", 3), ("a.go", "baz", 4), ("a.go", "baz", 8), ("b.go", "bar", 2), ("b.go", "foo", 3), ("c.go", "baz", 2)]


def test_references_and_callers(spark):
    r = refs(spark, symbols(spark, CALLER_ROWS), CALLER_CALLS)
    assert tuples(search.search_refs(r)) == [("a.go", "foo", "bar", 3), ("a.go", "foo", "baz", 4), ("a.go", "bar", "baz", 8), ("b.go", "run", "bar", 2), ("b.go", "run", "foo", 3), ("c.go", "init", "baz", 2)]
    assert tuples(search.find_callers(r, "baz")) == [("a.go", "foo", 4), ("a.go", "bar", 8), ("c.go", "init", 2)]
    with pytest.raises(ValueError):
        search.find_callers(r, "")


def test_imports(spark):
    df = spark.createDataFrame([("r", "main.go", "fmt", "", 3), ("r", "main.go", "fmt", "myfmt", 4), ("r", "other.go", "os", "", 3)], "repo_id string, file_path string, import_path string, alias string, line int")
    assert tuples(search.search_imports(df, module="fmt"), "alias") == [("",), ("myfmt",)]
    assert tuples(search.search_imports(df, path="other.go"), "import_path") == [("os",)]


def test_limits_are_per_repository(spark):
    both = symbols(spark, ROWS, "r1").unionByName(symbols(spark, ROWS, "r2"))
    assert tuples(search.search_workspace(both, SearchQuery(like="s", limit=1)), "repo_id", "name") == [("r1", "serve"), ("r2", "serve")]
    assert {r[0] for r in tuples(search.search_workspace(both, SearchQuery(fuzzy="serv", limit=1)), "repo_id")} == {"r1", "r2"}
