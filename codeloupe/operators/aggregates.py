"""Reports over a whole index: totals, hotspots, directory rollups and dead symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloupe.functions.text import like, unexported
from codeloupe.operators.search import every


def report_totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: ``total_files, total_symbols, last_indexed`` (null without files)."""
    a = files.agg(F.count("*").alias("total_files"), F.max("indexed_at").alias("last_indexed"))
    return a.crossJoin(symbols.agg(F.count("*").alias("total_symbols")))  # one row each


def report_languages(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``language, files, symbols`` by most symbols; languages without symbols stay."""
    counted = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))
    joined = files.join(counted, "path", "left")
    return joined.groupBy("language").agg(F.countDistinct("path").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols")).orderBy(F.desc("symbols"), "language")


def report_types(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def hotspots(refs: DataFrame, symbols: DataFrame, limit: int = 20, distinct_calls: bool = False) -> DataFrame:
    """The most referenced names: ``callee_name, file_path, call_count``.

    A count is multiplied by the number of symbols of that name, as a join of both would; with
    ``distinct_calls`` it is the number of references. ``file_path`` is the first file that defines
    the name, '' if none does. Both sides are aggregated before they meet.
    """
    called = refs.groupBy("callee_name").agg(F.count("*").alias("calls"))
    defined = symbols.groupBy(F.col("name").alias("callee_name")).agg(F.count("*").alias("definitions"), F.min("file_path").alias("file_path"))
    factor = F.lit(1) if distinct_calls else F.coalesce("definitions", F.lit(1))
    found = called.join(defined, "callee_name", "left").select("callee_name", F.coalesce("file_path", F.lit("")).alias("file_path"), (F.col("calls") * factor).alias("call_count"))
    found = found.orderBy(F.desc("call_count"), "callee_name")
    return found.limit(limit) if limit else found


def file_counts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``path, language, symbols`` of every file."""
    counted = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbols"))
    return files.select("path", "language").join(counted, "path", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0))).orderBy("path")


def ancestors(path: Column) -> Column:
    """The directories above a file: ``.`` for the root, then each prefix of its path."""
    parts = F.split(path, "/")
    below = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts))
    return F.concat(F.array(F.lit(".")), F.transform(below, lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def directory_languages(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``dir, language, files, symbols`` of every directory, everything below it included."""
    rows = file_counts(files, symbols).select(F.explode(ancestors(F.col("path"))).alias("dir"), "language", "symbols")
    return rows.groupBy("dir", "language").agg(F.count("*").alias("files"), F.sum("symbols").alias("symbols"))


def directory_tree(files: DataFrame, symbols: DataFrame, depth: int = 0) -> DataFrame:
    """``dir, depth, files, symbols, languages`` (a map to file counts) in path order; depth 0 is unlimited."""
    rows = directory_languages(files, symbols).groupBy("dir").agg(
        F.sum("files").alias("files"), F.sum("symbols").alias("symbols"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("languages")
    )
    level = F.when(F.col("dir") == ".", 0).otherwise(F.size(F.split("dir", "/")))
    rows = rows.withColumn("depth", level)
    if depth:
        rows = rows.filter(F.col("depth") <= depth)
    return rows.select("dir", "depth", "files", "symbols", "languages").orderBy("dir")


def nested(tree: DataFrame) -> dict:
    """The rows of ``directory_tree`` nested into one another, for display; collects one row a directory."""
    nodes: dict[str, dict] = {}
    root: dict = {"name": ".", "path": ".", "files": 0, "symbols": 0, "languages": {}, "children": []}
    for r in tree.collect():
        node = root if r["dir"] == "." else {"name": r["dir"].rpartition("/")[2], "path": r["dir"], "children": []}
        node |= {"files": r["files"], "symbols": r["symbols"], "languages": dict(r["languages"])}
        nodes[r["dir"]] = node
        if r["dir"] != ".":
            nodes.get(r["dir"].rpartition("/")[0] or ".", root)["children"].append(node)
    return root


def dead_candidates(symbols: DataFrame, type: str = "", file: str = "") -> DataFrame:
    """Symbols that could be dead: of a type (else functions and methods), of files like ``%file%``, not called by a runtime or test framework."""
    name = F.col("name")
    conditions = [F.col("type") == type if type else F.col("type").isin("function", "method"), ~name.isin("main", "init")]
    conditions += [~like(name, prefix + "%") for prefix in ("Test", "Benchmark", "Example", "Fuzz")]
    if file:
        conditions.append(like(F.col("file_path"), f"%{file}%"))
    return every(conditions, symbols)


def dead_symbols(symbols: DataFrame, refs: DataFrame, type: str = "", file: str = "", unexported_only: bool = False) -> DataFrame:
    """Candidates whose name nobody references: ``name, type, file_path, start_line``."""
    found = dead_candidates(symbols, type, file)
    if unexported_only:
        found = found.filter(unexported(F.col("name"), F.col("file_path")))
    called = refs.select(F.col("callee_name").alias("name")).distinct()
    return found.join(called, "name", "left_anti").select("name", "type", "file_path", "start_line").orderBy("file_path", "start_line", "name")
