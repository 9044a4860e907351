"""Interval operators over line ranges: who calls, and who contains whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloupe.parsing.registry import CHILDREN, CONTAINERS


#: Lines of a file that meet each other in a join, so that a file of any length is many keys.
LINES = 128


def band(line: str) -> Column:
    return F.expr(f"cast({line} div {LINES} AS int)")


def bands(start: str, end: str) -> Column:
    """The bands that a range of lines reaches into; an empty range has none."""
    return F.expr(f"explode(CASE WHEN {end} >= {start} THEN sequence(cast({start} div {LINES} AS int), cast({end} div {LINES} AS int)) ELSE cast(array() AS array<int>) END)")


def resolve_callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with ``caller_name``: the innermost symbol around the call's line, '' at file scope.

    ``calls`` has ``file_path, callee_name, line``; repeated calls stay. Of symbols with the same
    span the first in document order wins. File and band of lines are equi-join keys, the range only
    a residual: a line meets the symbols that reach into its band, so work grows with a file's
    length, not with its square. Calls on a line are joined once.
    """
    keys = [c for c in ("repo_id",) if c in calls.columns and c in symbols.columns] + ["file_path"]
    # All that follows is of one file and band: symbols are shuffled once, calls for their lines and for themselves.
    near = [*keys, "__band"]
    lines = calls.select(*keys, "line", "callee_name", band("line").alias("__band")).repartition(*near).groupBy(*near, "line", "callee_name").agg(F.count("*").alias("__n"))
    spans = symbols.select(*keys, F.col("name").alias("__name"), F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("ord").alias("ord")).alias("__key"), "start_line", "end_line", bands("start_line", "end_line").alias("__band"))
    at = lines.select(*near, "line").distinct().alias("c")
    s = spans.alias("s")
    same = [F.col(f"c.{k}") == F.col(f"s.{k}") for k in near]
    inside = at.join(s, [*same, F.col("line").between(F.col("start_line"), F.col("end_line"))])
    around = inside.groupBy(*(F.col(f"c.{k}").alias(k) for k in near), F.col("c.line").alias("line")).agg(F.min_by("__name", "__key").alias("caller_name")).alias("a")
    # As a difference the line is no key of the join: a call meets the lines of its band, 128 at most.
    met = [*(F.col(f"l.{k}") == F.col(f"a.{k}") for k in near), F.col("l.line") - F.col("a.line") == 0]
    found = lines.alias("l").join(around, met, "left").select(*(F.col(f"l.{k}").alias(k) for k in keys), F.coalesce("a.caller_name", F.lit("")).alias("caller_name"), "callee_name", F.col("l.line").alias("line"), "__n")
    again = found.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return again.select(*keys[:-1], F.col("file_path").alias("caller_file"), "caller_name", "callee_name", "line")


def assign_parents(symbols: DataFrame, containers: tuple[str, ...] = CONTAINERS, children: tuple[str, ...] = CHILDREN) -> DataFrame:
    """Symbols with ``parent``: the name of the last container before it, in document order, that reaches its line.

    Only types of ``children`` get one. Holds for well-nested ranges, as parsers give them. '' without
    a container. Bands of lines bound the join as in ``resolve_callers``.
    """
    keys = [c for c in ("repo_id",) if c in symbols.columns] + ["file_path"]
    near = [*keys, "__band"]
    rest = [c for c in symbols.columns if c not in (*keys, "ord", "parent")]
    own = symbols.select(*keys, "ord", band("start_line").alias("__band"), F.struct(*rest).alias("__row"), F.col("type").isin(*children).alias("__child"), F.col("start_line").alias("__start")).alias("s")
    outer = symbols.filter(F.col("type").isin(*containers)).select(*keys, F.col("ord").alias("c_ord"), F.col("name").alias("c_name"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), bands("start_line", "end_line").alias("__band")).alias("c")
    same = [F.col(f"c.{k}") == F.col(f"s.{k}") for k in near]
    nested = own.join(outer, [*same, F.col("s.__child"), F.col("c_ord") < F.col("s.ord"), F.col("c_start") <= F.col("s.__start"), F.col("c_end") >= F.col("s.__start")], "left")
    # A symbol is one row of its file and band, so its containers are already where it is.
    parents = nested.groupBy(*(F.col(f"s.{k}").alias(k) for k in near), F.col("s.ord").alias("ord"), F.col("s.__row").alias("__row")).agg(F.max_by("c_name", "c_ord").alias("parent"))
    found = parents.select(*keys, "ord", *(F.col(f"__row.{c}").alias(c) for c in rest), F.coalesce("parent", F.lit("")).alias("parent"))
    return found.select(*(c for c in symbols.columns if c != "parent"), "parent")
