from codeloupe.operators import resolve
from tests.helpers import refs, symbols, tuples


def test_innermost_caller_wins(spark):
    syms = symbols(spark, [("a", "outer", "class", 1, 20), ("a", "inner", "method", 5, 8), ("a", "same", "method", 5, 8), ("b", "other", "function", 1, 9)])
    found = refs(spark, syms, [("a", "x", 6), ("a", "x", 6), ("a", "y", 12), ("a", "z", 30), ("c", "w", 1)])
    assert sorted(tuples(found, "caller_file", "caller_name", "callee_name", "line")) == [("a", "", "z", 30), ("a", "inner", "x", 6), ("a", "inner", "x", 6), ("a", "outer", "y", 12), ("c", "", "w", 1)]


def test_the_file_is_a_join_key(spark):
    syms = symbols(spark, [("a", "f", "function", 1, 2)])
    plan = refs(spark, syms, [("a", "x", 1)])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parents(spark):
    syms = symbols(spark, [("a", "N", "namespace", 1, 30), ("a", "C", "class", 2, 10), ("a", "m", "method", 3, 4), ("a", "f", "function", 12, 14), ("a", "g", "function", 40, 41)])
    assert sorted(tuples(resolve.assign_parents(syms), "name", "parent")) == [("C", "N"), ("N", ""), ("f", ""), ("g", ""), ("m", "C")]


def test_long_files_like_brute_force(spark):
    """Spans that reach over many bands of lines."""
    rows = [("a", f"c{k}", "class", 1 + k, 4000 - k) for k in range(5)] + [("a", f"m{k}", "method", 10 + 7 * k, 14 + 7 * k) for k in range(500)] + [("a", "all", "variable", 127, 128), ("a", "none", "method", 4100, 4099)]
    syms = symbols(spark, rows)
    calls = [("a", "x", line) for line in range(1, 4200, 3)]
    found = {r.line: r.caller_name for r in refs(spark, syms, calls).collect()}
    order = {r.name: r.ord for r in syms.collect()}
    for _, _, line in calls:
        around = [(e - s, order[n], n) for _, n, _, s, e in rows if s <= line <= e]
        assert found[line] == (min(around)[2] if around else "")
    parents = dict(tuples(resolve.assign_parents(syms), "name", "parent"))
    for _, n, _, s, _ in rows:
        outer = [(order[c], c) for _, c, t, a, b in rows if t == "class" and order[c] < order[n] and a <= s <= b]
        assert parents[n] == (max(outer)[1] if outer else "")
