"""Filtered lookups of symbols, references, imports and callers."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloupe.functions.text import like

SYMBOL_COLUMNS = ("name", "type", "file_path", "start_line", "end_line", "parent")


@dataclass(frozen=True)
class SearchQuery:
    """Which symbols to find; empty fields don't filter.

    ``parent`` may be ``*`` (any). ``name`` and ``like`` may be dotted (``Parent.name``, either side
    ``*``). ``fuzzy`` takes precedence over both, but a dotted name still filters by parent.
    """

    name: str = ""
    like: str = ""
    fuzzy: str = ""
    type: str = ""
    parent: str = ""
    path: str = ""
    limit: int = 0

    def __post_init__(self) -> None:
        if self.limit < 0:
            raise ValueError("limit must not be negative")


def undotted(q: SearchQuery) -> SearchQuery:
    """``q`` with a dotted name or prefix taken apart at its last dot."""
    field = "name" if q.name else "like"
    text = getattr(q, field)
    if "." not in text:
        return q
    parent, _, name = text.rpartition(".")
    return replace(q, **{field: "" if name == "*" else name}, parent=parent or q.parent)


def every(conditions: list[Column], df: DataFrame) -> DataFrame:
    return df.filter(reduce(and_, conditions)) if conditions else df


def narrowing(q: SearchQuery) -> list[Column]:
    """The filters that both name and full-text search apply."""
    found = []
    if q.parent == "*":
        found.append(F.col("parent") != "")
    elif q.parent:
        found.append(F.col("parent") == q.parent)
    if q.type:
        found.append(F.col("type") == q.type)
    if q.path:
        found.append(F.instr("file_path", q.path) > 0)
    return found


def search_symbols(symbols: DataFrame, q: SearchQuery, index: DataFrame | None = None) -> DataFrame:
    """Symbols by exact or prefix name and the other filters, in the order of files and lines; full-text search uses the stored ``index``."""
    q = undotted(q)
    if q.fuzzy:
        from codeloupe.operators.fulltext import search_text

        return search_text(symbols, q, index=index)
    conditions = narrowing(q)
    if q.name:
        conditions.append(F.col("name") == q.name)
    elif q.like:
        conditions.append(like(F.col("name"), q.like + "%"))
    found = every(conditions, symbols).orderBy("file_path", "start_line", "name", "type")
    return (found.limit(q.limit) if q.limit else found).select(*SYMBOL_COLUMNS)


def first_of_each(symbols: DataFrame) -> DataFrame:
    """One symbol for each file, name, type and start line: the first in document order (``ord``)."""
    key = [c for c in ("repo_id", "file_path", "name", "type", "start_line") if c in symbols.columns]
    ranked = symbols.withColumn("__first", F.row_number().over(Window.partitionBy(*key).orderBy("ord")))
    return ranked.filter("__first = 1").drop("__first")


def search_refs(refs: DataFrame, caller_file: str = "", caller: str = "", callee: str = "") -> DataFrame:
    wanted = {"caller_file": caller_file, "caller_name": caller, "callee_name": callee}
    return every([F.col(k) == v for k, v in wanted.items() if v], refs).select(*wanted, "line").orderBy("caller_file", "line", "callee_name", "caller_name")


def search_imports(imports: DataFrame, path: str = "", module: str = "") -> DataFrame:
    wanted = {"file_path": path, "import_path": module}
    return every([F.col(k) == v for k, v in wanted.items() if v], imports).select(*wanted, "alias", "line").orderBy("file_path", "line", "import_path")


def find_callers(refs: DataFrame, callee: str) -> DataFrame:
    if not callee:
        raise ValueError("a callee name is needed")
    return refs.filter(F.col("callee_name") == callee).select("caller_file", "caller_name", "line").orderBy("caller_file", "line", "caller_name")


def limit_per_repo(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows of each repository; a limit of 0 takes all."""
    if not limit:
        return rows.orderBy("repo_id", *order)
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order)))
    return ranked.filter(F.col("__n") <= limit).drop("__n").orderBy("repo_id", *order)


def search_workspace(symbols: DataFrame, q: SearchQuery, index: DataFrame | None = None) -> DataFrame:
    """``search_symbols`` over all repositories of one table, with ``repo_id``; the limit is per repository."""
    q = undotted(q)
    if q.fuzzy:
        from codeloupe.operators.fulltext import search_text

        return search_text(symbols, q, by=("repo_id",), index=index)
    conditions = narrowing(q)
    if q.name:
        conditions.append(F.col("name") == q.name)
    elif q.like:
        conditions.append(like(F.col("name"), q.like + "%"))
    found = every(conditions, symbols).select("repo_id", *SYMBOL_COLUMNS)
    return limit_per_repo(found, q.limit, "file_path", "start_line", "name", "type")
