import sqlite3

import pytest

from codeloupe.operators import fulltext, search
from codeloupe.operators.search import SearchQuery
from tests.helpers import tuples

ROWS = [
    ("a.go", "getUserPrimaryAddress", "function", 1, "", "load row"), ("a.go", "setContentType", "method", 9, "Header", "application json charset"),
    ("b.go", "processOrder", "function", 1, "", "cart total"), ("b.go", "handleRequest", "function", 20, "", "process order now"), ("c.py", "order_items", "function", 3, "Cart", "items"),
    ("c.py", "caféName", "function", 30, "", "process the order of processing"),
]


@pytest.fixture(scope="module")
def syms(spark):
    return spark.createDataFrame([(*r[:4], r[3] + 2, *r[4:], k) for k, r in enumerate(ROWS)], "file_path string, name string, type string, start_line int, end_line int, parent string, body_tokens string, symbol_id int")


@pytest.fixture(scope="module")
def sqlite(syms):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(name, type, parent, file_path, name_tokens, body_snippet)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    from codeloupe.functions.text import split_name

    db.executemany("INSERT INTO t(rowid, name, type, parent, file_path, name_tokens, body_snippet) VALUES (?, ?, ?, ?, ?, ?, ?)", [(k, r[1], r[2], r[4], r[0], " ".join(split_name(r[1])), r[5]) for k, r in enumerate(ROWS)])
    return db


def ranks(syms, query):
    return {r[0]: round(r[1], 6) for r in tuples(fulltext.ranked(syms, query), "symbol_id", "rank")}


PLAIN = ["getUserPrimaryAddress", "get_user_primary_address", "get user primary address", "application json", "json", "process order", "ord", "zzz", "proc"]


@pytest.mark.parametrize("query", PLAIN)
def test_plain_queries_rank_like_fts5(syms, sqlite, query):
    from codeloupe.functions.text import query_words

    match = " AND ".join(f"(name_tokens : {w}* OR body_snippet : {w}*)" for w in query_words(query))
    assert ranks(syms, query) == {k: round(r, 6) for k, r in sqlite.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (match,))}


POWER = [
    "proc*", '"process order"', "name_tokens : order", "name : ^get*", "{name_tokens body_snippet} : order", "go*", "ord* NOT cart", "ord* AND (cart OR items)", "process* OR json", "- name_tokens : order*",
    '"process order" OR items:x*', "NEAR(process order, 1) OR x*", 'body_snippet : "process" + "order"',
]


@pytest.mark.parametrize("query", [q for q in POWER if "items:" not in q])
def test_power_queries_match_like_fts5(syms, sqlite, query):
    assert set(ranks(syms, query)) == {k for (k,) in sqlite.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,))}


def test_grammar_errors():
    for bad in ('"process order" OR items:x*', "(a* OR b", "a* OR", "{name : x*"):
        with pytest.raises(ValueError):
            fulltext.parse_query(bad)


def test_names_rank_before_bodies(syms):
    assert [r[0] for r in tuples(search.search_symbols(syms, SearchQuery(fuzzy="process order")), "name")][0] == "processOrder"


def test_filters_come_after_ranking(syms):
    every, some = ranks(syms, "order"), search.search_symbols(syms, SearchQuery(fuzzy="order", type="function", path="b.go"))
    assert {round(r[0], 6) for r in tuples(some, "rank")} <= set(every.values())
    assert search.search_symbols(syms, SearchQuery(fuzzy="order", name="Cart.x")).select("name").collect()[0][0] == "order_items"
    assert search.search_symbols(syms, SearchQuery(fuzzy="  ")).count() == 0


def test_postings(syms):
    assert fulltext.postings(syms).filter("token = 'order'").count() == 5
