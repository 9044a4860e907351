"""Many links of a name with many symbols."""

import random

from pyspark.sql import functions as F

from codeloupe.operators import workspace

LINKS = "id long, src_repo_id string, src_symbol string, src_file string, dst_repo_id string, dst_symbol string, dst_file string, created_at long"


def test_like_brute_force(spark):
    at = random.Random(5)
    files = ["a.go", "x/a.go", "y/x/a.go", "b.go", "", "xa.go"]
    symbols = [(at.choice(("r1", "r2", "r3")), at.choice("fgh"), at.choice(files), at.randrange(1, 3)) for _ in range(9)]
    ends = lambda: (at.choice(("r1", "r2", "r3")), at.choice("fghi"), at.choice([*files, "go", None]))
    links = [(k, *ends(), *ends(), 0) for k in range(80)]
    found = workspace.validate_links(spark.createDataFrame(links, LINKS), spark.createDataFrame(symbols, "repo_id string, name string, file_path string, start_line int"), spark.createDataFrame([("r1",), ("r2",)], "id string")).collect()
    assert [r.id for r in found] == list(range(80))
    for r, link in zip(found, links):
        for side, (repo, name, recorded) in (("src", link[1:4]), ("dst", link[4:7])):
            at_name = sorted(f for s, n, f, _ in symbols if (s, n) == (repo, name))
            alike = [f for f in at_name if recorded is not None and f.endswith(recorded)]
            same = recorded in alike
            file = recorded if same else alike[0] if len(alike) == 1 else None if alike else (at_name or [None])[0]
            error = f"symbol '{name}' not found in repo" if not at_name else f"symbol '{name}' is ambiguous: {len(alike)} matches" if len(alike) > 1 and not same else None
            want = (None, None, f"repo '{repo}' not found in workspace") if repo == "r3" else (bool(not error and file == recorded is not None), file, error)
            assert (r[f"{side}_valid"], r[f"{side}_actual_file"], r[f"{side}_error"]) == want, (side, link)


def test_links_times_symbols_are_not_joined(spark):
    """No join of the plan gives more rows than links and symbols have ends."""
    n = 1000
    symbols = spark.range(n).select(F.lit("r").alias("repo_id"), F.lit("f").alias("name"), F.concat(F.lit("m"), "id", F.lit(".go")).alias("file_path"), F.lit(1).alias("start_line"))
    links = spark.range(n).select("id", *(F.lit(v).alias(f"{side}_{c}") for side in ("src", "dst") for c, v in (("repo_id", "r"), ("symbol", "f"), ("file", ".go"))), F.lit(0).alias("created_at"))
    ends = links.select(F.col("src_repo_id").alias("repo_id"), F.col("src_symbol").alias("name"), F.col("src_file").alias("recorded"))
    found = workspace.located(ends, symbols)
    assert [tuple(r) for r in found.collect()] == [("r", "f", ".go", None, f"symbol 'f' is ambiguous: {n} matches")]
    assert workspace.validate_links(links, symbols, spark.createDataFrame([("r",)], "id string")).filter("src_error = dst_error").count() == n
