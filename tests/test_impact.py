import pytest

from codeloupe.model import CROSS, DIRECT, INDIRECT
from codeloupe.operators import graph, scoring
from codeloupe.plans import planning
from tests.helpers import refs, symbols, tuples
from tests.test_search import CALLER_CALLS, CALLER_ROWS

MAIN = [("main.go", "runImpact", "function", 1, 5), ("main.go", "service", "function", 6, 12), ("main.go", "controller", "function", 13, 20)]


@pytest.fixture(scope="module")
def code(spark):
    one = symbols(spark, MAIN, "r1")
    two = symbols(spark, [("remote.go", "remoteHandler", "function", 3, 9)], "r2")
    return one.unionByName(two), refs(spark, one, [("main.go", "runImpact", 8), ("main.go", "service", 15)], "r1")


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([(1, "r1", "runImpact", "main.go", "r2", "remoteHandler", "remote.go", "n")], "id long, src_repo_id string, src_symbol string, src_file string, dst_repo_id string, dst_symbol string, dst_file string, note string")


def simulate(code, depth, links=None):
    start = graph.start_symbol(code[0], "r1", "runImpact")
    steps = graph.propagate(*code, start, depth, links)
    scored = scoring.score(graph.impacts(steps))
    items = [r.asDict() for r in scored.collect()]
    scope, scores = graph.scope(steps).collect()[0].asDict(), scoring.aggregate(scored).collect()[0].asDict()
    return {x["symbol"]: x for x in items}, scope, scores, planning.plan(start, scope, items, scores)


def test_depth_4(code):
    items, scope, scores, plan = simulate(code, 4)
    brief = lambda x: (x["distance"], x["line"], x["reasons"], x["risk_score"], x["risk_tier"], round(x["confidence"], 6))
    assert brief(items["service"]) == (1, 8, [DIRECT, INDIRECT], 99, "critical", 0.98)
    assert brief(items["controller"]) == (2, 15, [INDIRECT], 36, "medium", 0.98)
    assert brief(items["runImpact"]) == (2, 1, [INDIRECT], 28, "low", 0.98)
    assert items["runImpact"]["breaks"] == ["behavioral_regression"] and len(items["controller"]["evidence"]) == 2
    assert scope == {"direct_callers": 1, "indirect_callers": 1, "affected_symbols": 3, "affected_files": 1, "affected_repos": 1, "cross_boundary_edges": 0}
    assert (scores["risk_score"], scores["risk_tier"], round(scores["confidence"], 6)) == (85, "critical", 0.98)
    signals = plan["planning_signals"]
    assert (signals["recommended_strategy"], signals["suggested_batch_count"]) == ("deprecate_then_remove", 3)
    assert [len(plan[k]) for k in ("required_checks", "recommended_order", "notify_owners")] == [4, 4, 0]
    assert [a["expected_risk_score_delta"] for a in plan["alternatives"]] == [-20, -18]


def test_depth_1(code):
    items, _, scores, _ = simulate(code, 1)
    assert list(items) == ["service"] and items["service"]["reasons"] == [DIRECT]
    assert (items["service"]["risk_score"], scores["risk_score"]) == (67, 67)


def test_links(code, links):
    items, scope, scores, plan = simulate(code, 4, links)
    x = items["remoteHandler"]
    assert (x["distance"], x["line"], x["reasons"], x["breaks"], x["risk_score"]) == (1, 3, [CROSS], ["contract_break"], 67)
    assert scope == {"direct_callers": 1, "indirect_callers": 1, "affected_symbols": 4, "affected_files": 2, "affected_repos": 2, "cross_boundary_edges": 1}
    assert scores["risk_score"] == 85
    assert (plan["planning_signals"]["recommended_strategy"], plan["planning_signals"]["suggested_batch_count"]) == ("adapter_bridge_then_migrate", 4)
    assert [len(plan[k]) for k in ("required_checks", "recommended_order", "notify_owners", "alternatives")] == [5, 5, 1, 1]


def test_unlimited_depth_ends(code):
    assert set(simulate(code, 0)[0]) == {"service", "controller", "runImpact"}


def test_file_scope_is_a_leaf(spark):
    syms = symbols(spark, [("a", "f", "function", 5, 6)])
    r = refs(spark, syms, [("a", "f", 1)])
    assert tuples(graph.impacts(graph.propagate(syms, r, graph.start_symbol(syms, "r", "f"), 6)), "symbol", "line") == [("<file scope>", 1)]
    with pytest.raises(LookupError):
        graph.start_symbol(syms, "r", "nothing")


def test_callers_recursive(spark):
    r = refs(spark, symbols(spark, CALLER_ROWS), CALLER_CALLS)
    rows = graph.callers_recursive(r, "baz", 2)
    assert sorted(tuples(rows, "depth", "caller_name", "caller_file", "line")) == [(1, "bar", "a.go", 8), (1, "foo", "a.go", 4), (1, "init", "c.go", 2), (2, "foo", "a.go", 3), (2, "run", "b.go", 2), (2, "run", "b.go", 3)]
    tree = graph.caller_tree(rows, "baz")
    assert [n["name"] for n in tree] == ["foo", "bar", "init"] and [n["name"] for n in tree[1]["callers"]] == ["foo", "run"]


def test_cycles_end(spark):
    syms = symbols(spark, [("a", "f", "function", 1, 2), ("a", "g", "function", 3, 4)])
    r = refs(spark, syms, [("a", "f", 3), ("a", "g", 1), ("a", "f", 2)])
    assert sorted(tuples(graph.callers_recursive(r, "f", 0), "depth", "caller_name", "cycle")) == [(1, "f", True), (1, "g", False), (2, "f", True)]


@pytest.mark.parametrize("score, tier", [(0, "low"), (34, "low"), (35, "medium"), (64, "medium"), (65, "high"), (84, "high"), (85, "critical"), (100, "critical")])
def test_tiers(spark, score, tier):
    from pyspark.sql import functions as F

    assert spark.range(1).select(scoring.tier(F.lit(score))).collect()[0][0] == tier


def test_nothing_scores_low(spark):
    empty = spark.createDataFrame([], "id string, repo string, file string, symbol string, line int, distance int, reasons array<string>, breaks array<string>, evidence array<string>")
    assert scoring.aggregate(scoring.score(empty)).collect()[0].asDict() == {"risk_score": 0, "confidence": 0.0, "risk_tier": "low"}


def test_weights_merge():
    w = scoring.Weights().merged(reasons={DIRECT: 1}, penalty_cap=0, cross_bonus=5)
    assert w.reasons[DIRECT] == 1 and w.reasons[CROSS] == 35 and w.penalty_cap == 24 and w.cross_bonus == 5


def test_changes():
    assert planning.parse_change("rename_symbol:from=a: to = b") == {"kind": "rename_symbol", "from": "a", "to": "b"}
    assert planning.parse_change("param_type_change:param=x:param_type=int")["param_type_to"] == "int"
    for bad in ("", "nothing", "rename_symbol", "rename_symbol:to", "rename_symbol:to=", "rename_symbol:who=x", "visibility_change", "param_type_change:param=x"):
        with pytest.raises(ValueError):
            planning.parse_change(bad)


SCOPE = {"direct_callers": 0, "indirect_callers": 0, "affected_repos": 1}


@pytest.mark.parametrize(
    "scope, risk, confidence, reasons, warnings, strategy, batches",
    [
        ({}, 10, 0.9, [], [], "single_pr_direct_change", 1),
        ({"direct_callers": 3}, 10, 0.9, [], [], "adapter_bridge_then_migrate", 2),
        ({}, 70, 0.9, [], [], "adapter_bridge_then_migrate", 2),
        ({}, 90, 0.9, [], [], "deprecate_then_remove", 3),
        ({"affected_repos": 2}, 90, 0.9, [], [], "adapter_bridge_then_migrate", 4),
        ({"affected_repos": 2}, 90, 0.5, [], [], "manual_investigation_first", 5),
        ({}, 10, 0.9, ["POSSIBLE_DYNAMIC_DISPATCH"], [], "manual_investigation_first", 2),
        ({}, 10, 0.9, [], ["w"], "manual_investigation_first", 2),
    ],
)
def test_strategies(scope, risk, confidence, reasons, warnings, strategy, batches):
    items = [{"id": "a", "repo": "r", "file": "f", "symbol": "s", "reasons": reasons, "risk_score": risk, "confidence": confidence, "distance": 1}]
    signals = planning.plan({"repo": "r", "symbol": "s"}, SCOPE | scope, items, {"risk_score": risk, "confidence": confidence}, warnings)["planning_signals"]
    assert (signals["recommended_strategy"], signals["suggested_batch_count"]) == (strategy, batches)
    assert signals["safe_to_do_in_single_pr"] == (strategy == "single_pr_direct_change")
