"""Seeded relations, and rows as plain tuples."""

from codeloupe.operators.resolve import resolve_callers


def symbols(spark, rows, repo="r"):
    """Rows of file, name, type, start, end and, where there is one, parent."""
    full = [(repo, k, *r, *[""] * (6 - len(r))) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "repo_id string, ord int, file_path string, name string, type string, start_line int, end_line int, parent string")


def refs(spark, syms, calls, repo="r"):
    """Resolved references of calls given as file, callee and line."""
    return resolve_callers(spark.createDataFrame([(repo, *c) for c in calls], "repo_id string, file_path string, callee_name string, line int"), syms)


def tuples(df, *names):
    return [tuple(r) for r in (df.select(*names) if names else df).collect()]
