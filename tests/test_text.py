import pytest
from pyspark.sql import functions as F

from codeloupe.functions import text

SPLITS = [
    ("parseHTTPRequest", ["parse", "http", "request"]), ("_private_field_", ["private", "field"]), ("base64Encode", ["base64", "encode"]), ("getUserID", ["get", "user", "id"]),
    ("HTTPServer", ["http", "server"]), ("MAX_RETRY_COUNT", ["max", "retry", "count"]), ("simple", ["simple"]), ("", []), ("A", ["a"]), ("__init__", ["init"]), ("dot.name", ["dot.name"]),
]


@pytest.mark.parametrize("name, words", SPLITS)
def test_split_name(name, words):
    assert text.split_name(name) == words


def test_split_identifier_in_spark(spark):
    df = spark.createDataFrame([(n, w) for n, w in SPLITS], "n string, w array<string>")
    assert df.filter(text.split_identifier(F.col("n")) != F.col("w")).count() == 0


def test_query_words():
    assert text.query_words("getUser user_name  GET") == ["get", "user", "name"]
    assert text.query_words("  ") == []


def test_split_literal(spark):
    df = spark.createDataFrame([('"cannot open %s: %w"',), ("a b cd",)], "x string")
    assert [r[0] for r in df.select(text.split_literal(F.col("x"))).collect()] == [["cannot", "open"], ["cd"]]
    assert text.literal_words('"cannot open %s: %w"') == ["cannot", "open"]


def test_like_ignores_ascii_case_and_keeps_wildcards(spark):
    df = spark.createDataFrame([("Foobar",), ("f_o",), ("É",), ("a\\b",)], "x string")

    def found(pattern):
        return {r[0] for r in df.filter(text.like(F.col("x"), pattern)).collect()}

    assert found("fOO%") == {"Foobar"}
    assert found("F_O") == {"f_o"}
    assert found("é") == set()
    assert found("A\\B") == {"a\\b"}


def test_unexported(spark):
    rows = [("foo", "a.go", True), ("Foo", "a.go", False), ("_x", "a.go", False), ("foo", "a.rs", False), ("名前", "a.py", True), ("", "a.go", False)]
    df = spark.createDataFrame(rows, "n string, p string, w boolean")
    assert df.filter(text.unexported(F.col("n"), F.col("p")) != F.col("w")).count() == 0


def test_line_slice(spark):
    df = spark.createDataFrame([("a\r\nb\nc\n", 1, 2), ("a\nb", 2, 9), ("a", 3, 4), ("", 1, 1)], "t string, s int, e int")
    assert [r[0] for r in df.select(text.line_slice(F.col("t"), F.col("s"), F.col("e"))).collect()] == ["a\nb\n", "b\n", "", "\n"]
