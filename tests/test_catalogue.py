"""Every registered query against its DuckDB oracle, over the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return round(float(v), 8) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.sql(contract.oracle_sql()[name])
    assert sorted(found.columns) == names
    theirs = sorted((tuple(plain(r[found.columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_nothing_else_imports_the_pipeline_operators():
    from pathlib import Path

    root = Path(contract.__file__).parent
    for p in (root / "codeloupe").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "codeloupe.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
