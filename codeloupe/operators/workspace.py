"""Links between repositories: filters, creation, validation, and fan-out over all repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloupe.operators.search import every, limit_per_repo


def list_links(links: DataFrame, src_repo: str = "", dst_repo: str = "", repo: str = "", src_symbol: str = "", dst_symbol: str = "") -> DataFrame:
    """Links by repository of either end, of both (``repo``: any end), and symbols, oldest first."""
    wanted = {"src_repo_id": src_repo, "dst_repo_id": dst_repo, "src_symbol": src_symbol, "dst_symbol": dst_symbol}
    conditions = [F.col(k) == v for k, v in wanted.items() if v]
    if repo:
        conditions.append((F.col("src_repo_id") == repo) | (F.col("dst_repo_id") == repo))
    return every(conditions, links).orderBy("created_at", "id")


def with_meta(links: DataFrame, meta: DataFrame) -> DataFrame:
    """``links`` with a ``meta`` map from rows of ``link_id, key, value``; an empty map without any."""
    maps = meta.groupBy(F.col("link_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))
    return links.drop("meta").join(maps, "id", "left").withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))


def parse_meta(pairs: list[str]) -> dict[str, str]:
    found = {}
    for pair in pairs:
        key, sign, value = pair.partition("=")
        if not sign or not key:
            raise ValueError(f"{pair!r} is no key=value")
        found[key] = value
    return found


def located(ends: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per different row of ``ends``, ``repo_id, name, recorded`` of links' ends: where the symbol is now.

    ``actual_file`` is the recorded file if the symbol is there, else the only file that ends like
    the recorded one, else the symbol's first file; ``error`` is set if there is no such symbol, or
    several files end like the recorded one.

    Symbols never meet links one by one: what ends like a recorded file is found by equality, of the
    end of each file that is as long. So a symbol is held once for each length of its name's recorded files.
    """
    at = ends.distinct()
    lengths = at.groupBy("repo_id", "name").agg(F.collect_set(F.length("recorded")).alias("lengths"))
    s = symbols.select("repo_id", "name", "file_path").join(lengths, ["repo_id", "name"])
    # The whole file stands under null, for names whose files count whatever they end like.
    within = F.filter("lengths", lambda k: k <= F.length("file_path"))
    tails = s.select("repo_id", "name", "file_path", F.explode(F.concat(F.array(F.lit(None).cast("int")), within)).alias("k")).withColumn("tail", F.expr("right(file_path, k)"))
    tails = tails.groupBy("repo_id", "name", "tail").agg(F.count("file_path").alias("n"), F.count_if(F.col("file_path") == F.col("tail")).alias("same"), F.min("file_path").alias("first"))
    whole = tails.filter(F.col("tail").isNull()).select("repo_id", "name", "n", "first")
    alike = tails.filter(F.col("tail").isNotNull()).select("repo_id", "name", F.col("tail").alias("recorded"), "same", F.col("n").alias("alike"), F.col("first").alias("one"))
    seen = at.join(whole, ["repo_id", "name"], "left").join(alike, ["repo_id", "name", "recorded"], "left").fillna(0, ["n", "same", "alike"])
    file = F.when(F.col("same") > 0, F.col("recorded")).when(F.col("alike") == 1, F.col("one")).when(F.col("alike") == 0, F.col("first"))
    error = F.when(F.col("n") == 0, F.concat(F.lit("symbol '"), "name", F.lit("' not found in repo"))).when(
        (F.col("same") == 0) & (F.col("alike") > 1), F.concat(F.lit("symbol '"), "name", F.lit("' is ambiguous: "), F.col("alike").cast("string"), F.lit(" matches"))
    )
    return seen.select("repo_id", "name", "recorded", F.when(F.col("n") > 0, file).alias("actual_file"), error.alias("error"))


def validate_links(links: DataFrame, symbols: DataFrame, repositories: DataFrame) -> DataFrame:
    """Links with, for both ends, ``*_valid`` (null if its repository is unknown), ``*_actual_file`` and ``*_error``.

    An end is valid if its symbol is in its recorded file.
    """
    found = links
    known = repositories.select(F.col("id").alias("__repo")).distinct()
    # Both ends of all links look for few different symbols and files; of these there is one relation.
    src, dst = (links.select(F.col(f"{side}_repo_id").alias("repo_id"), F.col(f"{side}_symbol").alias("name"), F.col(f"{side}_file").alias("recorded")) for side in ("src", "dst"))
    places = located(src.unionByName(dst), symbols)
    for side in ("src", "dst"):
        l = places.select(F.col("repo_id").alias("__r"), F.col("name").alias("__name"), F.col("recorded").alias("__recorded"), F.col("actual_file").alias(f"{side}_actual_file"), F.col("error").alias(f"{side}_error"))
        same = [F.col(f"{side}_{a}").eqNullSafe(F.col(b)) for a, b in (("repo_id", "__r"), ("symbol", "__name"), ("file", "__recorded"))]
        found = found.join(l, same, "left").join(known, F.col(f"{side}_repo_id") == F.col("__repo"), "left")
        lost = F.col("__repo").isNull()
        valid = F.col(f"{side}_error").isNull() & (F.col(f"{side}_actual_file") == F.col("__recorded"))
        found = found.withColumns({
            f"{side}_valid": F.when(~lost, F.coalesce(valid, F.lit(False))),
            f"{side}_actual_file": F.when(~lost, F.col(f"{side}_actual_file")),
            f"{side}_error": F.when(lost, F.concat(F.lit("repo '"), f"{side}_repo_id", F.lit("' not found in workspace"))).otherwise(F.col(f"{side}_error")),
        }).drop("__repo", "__r", "__name", "__recorded")
    return found.orderBy("created_at", "id")


def resolve_symbol(symbols: DataFrame, repo: str, name: str, hint: str = "") -> str:
    """The file of a repository's symbol for a new link; LookupError if there is none, or several."""
    rows = symbols.filter((F.col("repo_id") == repo) & (F.col("name") == name))
    if hint:
        rows = rows.filter(F.col("file_path").endswith(hint))
    found = rows.orderBy("file_path", "start_line").select("file_path", "start_line", "type").take(21)
    if not found:
        raise LookupError(f"symbol {name!r} not found in repository {repo!r}" + f" with a file like {hint!r}" * bool(hint))
    if len(found) > 1:
        places = "; ".join(f"{r['file_path']}:{r['start_line']} ({r['type']})" for r in found[:20])
        raise LookupError(f"symbol {name!r} is ambiguous in repository {repo!r}: {places}")
    return found[0]["file_path"]


def refs_workspace(refs: DataFrame, limit: int = 0, **wanted: str) -> DataFrame:
    """References of all repositories; ``caller_file, caller_name, callee_name`` filter."""
    found = every([F.col(k) == v for k, v in wanted.items() if v], refs).select("repo_id", "caller_file", "caller_name", "callee_name", "line")
    return limit_per_repo(found, limit, "caller_file", "line", "callee_name", "caller_name")


def imports_workspace(imports: DataFrame, limit: int = 0, **wanted: str) -> DataFrame:
    found = every([F.col(k) == v for k, v in wanted.items() if v], imports).select("repo_id", "file_path", "import_path", "alias", "line")
    return limit_per_repo(found, limit, "file_path", "line", "import_path")
