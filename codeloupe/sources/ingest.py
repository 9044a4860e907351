"""Incremental ingestion as relational steps: list, compare, parse, replace.

Every step is a DataFrame operator, so that thousands of repositories are one job partitioned by
``repo_id``, and contents are read for files only whose time or size changed.
"""

from __future__ import annotations

import os
import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloupe.functions.text import split_identifier
from codeloupe.operators.fulltext import with_words
from codeloupe.operators.resolve import resolve_callers
from codeloupe.operators.search import first_of_each
from codeloupe.parsing.registry import EXTENSIONS, SKIPPED, parser_udf

STATUSES = ("added", "updated", "unchanged", "removed", "error")


def language_of(path):
    """The language of a path's extension, null if it has none that is known."""
    lookup = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return lookup[F.regexp_extract(path, r"\.[^./]+$", 0)]


def listing(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """``repo_id, path, language, mtime, size, content`` of the source files below ``root``.

    Skips dependency folders and dot-folders below the root (the root's own name doesn't matter):
    where the driver can walk the tree it doesn't enter them, else Spark lists all and drops theirs.
    ``content`` is a lazy column: a plan that doesn't use it doesn't read it.
    """
    root = root.rstrip("/")
    if os.path.isdir(root):
        stats = {name: os.stat(name) for name in source_files(root)}
        # Spark's scans pass over files without a byte.
        found = spark.createDataFrame([(name, datetime.fromtimestamp(s.st_mtime, UTC), 0, b"") for name, s in stats.items() if not s.st_size], "path string, modificationTime timestamp, length long, content binary")
        if walked := [re.sub(r"([\\{}\[\]*?])", r"\\\1", name) for name, s in stats.items() if s.st_size]:
            found = found.unionByName(spark.read.format("binaryFile").load(walked))
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^.*?{_quoted(root)}/", "")
    rows = found.select(F.lit(repo).alias("repo_id"), path.alias("path"), F.date_trunc("second", "modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    folders = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    rows = rows.filter(~F.concat(F.lit("/"), folders).rlike(r"/(" + "|".join(SKIPPED) + r"|\.[^/]+)/"))
    return rows.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull())


def source_files(root: str) -> list[str]:
    """The files of known extensions below a folder; skipped folders are not entered."""
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in SKIPPED and not d.startswith("."))
        found += [os.path.join(folder, n) for n in sorted(names) if "." in n and "." + n.rpartition(".")[2] in EXTENSIONS]
    return found


def _quoted(text: str) -> str:
    return re.escape(text.split("://", 1)[-1])


def compare(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """``repo_id, path, status`` by stat alone: ``added, removed, unchanged`` or ``candidate``.

    A file is unchanged if its time (to the second) and size are those of the stored row, which has
    a hash. ``listed`` needs no content.
    """
    s = stored.select("repo_id", "path", F.date_trunc("second", "mtime").alias("s_mtime"), F.col("size").alias("s_size"), F.col("sha256").alias("s_sha"), F.lit(True).alias("s_here"))
    d = listed.select("repo_id", "path", F.date_trunc("second", "mtime").alias("mtime"), "size", F.lit(True).alias("d_here"))
    both = d.join(s, ["repo_id", "path"], "full_outer")
    same = (F.col("mtime") == F.col("s_mtime")) & (F.col("size") == F.col("s_size")) & (F.coalesce("s_sha", F.lit("")) != "")
    status = F.when(F.col("d_here").isNull(), "removed").when(F.col("s_here").isNull(), "added").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("candidate")
    return both.select("repo_id", "path", status.alias("status"), F.coalesce("s_sha", F.lit("")).alias("s_sha"))


def hashed(compared: DataFrame, listed: DataFrame) -> DataFrame:
    """Added and candidate files with their content: ``status`` is ``added``, ``updated``, or ``unchanged`` where the hash is."""
    open_files = compared.filter(F.col("status").isin("added", "candidate"))
    rows = listed.join(open_files, ["repo_id", "path"]).withColumn("sha256", F.sha2("content", 256))
    status = F.when(F.col("status") == "added", "added").when(F.col("sha256") == F.col("s_sha"), "unchanged").otherwise("updated")
    return rows.withColumn("status", status).drop("s_sha")


def parsed(changed: DataFrame) -> DataFrame:
    """Changed files with ``parsed``: their symbols, calls and imports, or an error; the one Python step."""
    return changed.withColumn("parsed", parser_udf()("path", "language", "content"))


def relations(files: DataFrame) -> dict[str, DataFrame]:
    """The relations of parsed files without an error."""
    good = files.filter(F.col("parsed.error").isNull())
    symbols = good.select("repo_id", F.col("path").alias("file_path"), F.inline("parsed.symbols"))
    symbols = first_of_each(symbols).withColumn("name_tokens", split_identifier(F.col("name")))
    symbols = with_words(symbols)
    calls = good.select("repo_id", F.col("path").alias("file_path"), F.inline("parsed.calls")).drop("ord")
    imports = good.select("repo_id", F.col("path").alias("file_path"), F.inline("parsed.imports"))
    return {
        "files": good.select("repo_id", "path", "language", "sha256", "mtime", "size", F.date_trunc("second", F.current_timestamp()).alias("indexed_at")),
        "symbols": symbols.select("repo_id", "file_path", "ord", "name", "type", "start_line", "end_line", "parent", "name_tokens", "body_tokens", "symbol_id", "words", "n_words"),
        "postings": symbols.select("repo_id", F.explode(F.array_distinct(F.flatten("words"))).alias("token"), "file_path", "symbol_id"),
        "refs": resolve_callers(calls, symbols).select("repo_id", "caller_file", "caller_name", "callee_name", "line"),
        "imports": imports.select("repo_id", "file_path", "import_path", "alias", "line"),
    }


def staleness(indexed: DataFrame, now: datetime, threshold: timedelta = timedelta(seconds=10)) -> DataFrame:
    """Repositories' ``last_indexed`` with ``stale``: whether that is missing or longer ago than the threshold; a negative one is zero."""
    age = F.lit(now) - F.col("last_indexed")
    return indexed.withColumn("stale", F.coalesce(age > F.lit(max(threshold, timedelta(0))), F.lit(True)))


FILE_KEY = {"files": "path", "symbols": "file_path", "postings": "file_path", "refs": "caller_file", "imports": "file_path"}


def upsert(table: str, stored: DataFrame, fresh: DataFrame, replaced: DataFrame) -> DataFrame:
    """``stored`` without the rows of ``replaced`` files (``repo_id, path``: changed and removed ones), with the ``fresh`` rows."""
    key = FILE_KEY[table]
    gone = replaced.select("repo_id", F.col("path").alias(key)).distinct()
    return stored.join(gone, ["repo_id", key], "left_anti").unionByName(fresh)


def prune(table: str, stored: DataFrame, removed: DataFrame) -> DataFrame:
    key = FILE_KEY[table]
    return stored.join(removed.select("repo_id", F.col("path").alias(key)).distinct(), ["repo_id", key], "left_anti")
