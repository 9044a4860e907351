"""Walks over names with many symbols and calls: few rows written, and the same places as a queue finds."""

import random

import pytest

from codeloupe.model import BEHAVIOR, COMPILE, CONTRACT, CROSS, DIRECT, INDIRECT
from codeloupe.operators import graph, scoring
from codeloupe.plans import planning

SYMBOLS = "repo_id string, file_path string, name string, start_line int"
REFS = "repo_id string, caller_file string, caller_name string, callee_name string, line int"
LINKS = "id long, src_repo_id string, src_symbol string, dst_repo_id string, dst_symbol string, dst_file string, note string"


def test_calls_times_symbols_are_not_expanded(spark):
    n = 200
    symbols = spark.createDataFrame([("r", f"{k}.go", name, 1) for k in range(n) for name in "fg"], SYMBOLS)
    refs = spark.createDataFrame([("r", f"{k}.go", "f", "g", 2) for k in range(n)], REFS)
    walk = graph.propagate(symbols, refs, graph.start_symbol(symbols, "r", "f"), 1)
    assert walk.expansions.count() == graph.impacts(walk).count() == n


def queue_walk(symbols, refs, links, start, depth):
    """All expansions of a queue: target, distance, reason, break, steps, source of a link."""
    seed = (start["repo"], start["file"], start["symbol"], start["line"], "", "", -1, -1, "")
    frontier, seen, every, d = {(start["repo"], start["symbol"]): (seed,)}, {(start["repo"], start["symbol"])}, [], 0
    while frontier and (not depth or d < depth):
        rows = []
        for (repo, symbol), pos in frontier.items():
            for r, file, caller, callee, line in refs:
                if r == repo and callee == symbol:
                    rows.append((repo, file, caller or graph.FILE_SCOPE, line, INDIRECT if d else DIRECT, COMPILE, "upstream_caller", line, -1, "", pos, caller != ""))
                if r == repo and caller == symbol:
                    for f, l in [(f, l) for sr, f, name, l in symbols if (sr, name) == (repo, callee)] or [(file, line)]:
                        rows.append((repo, f, callee, l, INDIRECT, BEHAVIOR, "downstream_callee", line, -1, "", pos, callee != ""))
            for i, sr, s, dr, name, file, note in links:
                if (sr, s) == (repo, symbol):
                    for f, l in [(f, l) for r, f, x, l in symbols if (r, x) == (dr, name)] or [(file, 0)]:
                        rows.append((dr, f, name, l, CROSS, CONTRACT, "workspace_link", -1, i, note, pos, True))
        d += 1
        step = [(r, f, s, l, d, reason, brk, (*pos, (r, f, s, l, reason, rel, call, i, note)), is_open) for r, f, s, l, reason, brk, rel, call, i, note, pos, is_open in rows]
        every += step
        first = {}
        for r, f, s, l, _, _, _, pos, is_open in step:
            if is_open:
                first[r, s] = min(first.get((r, s), pos), pos)
        frontier = {k: v for k, v in first.items() if k not in seen}
        seen |= first.keys()
    return every


@pytest.mark.parametrize("seed, depth", [(1, 3), (2, 3), (3, 0)])
def test_like_a_queue(spark, seed, depth):
    at = random.Random(seed)
    names = [f"n{k}" for k in range(9)]
    symbols = sorted({(at.choice(("r1", "r2")), f"{at.randrange(4)}.go", at.choice(names[:7]), at.randrange(1, 4)) for _ in range(30)} | {("r1", "0.go", "n0", 1)})
    refs = [(at.choice(("r1", "r2")), f"{at.randrange(4)}.go", at.choice(["", *names]), at.choice(names), at.randrange(1, 6)) for _ in range(25)] + [("r1", "1.go", "n0", "n1", 3), ("r1", "1.go", "n0", "n8", 3)]
    links = [(k, "r1", at.choice(["n0", *names]), "r2", at.choice(names), f"x{k % 2}.go", f"note {k}") for k in range(6)]
    tables = spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(refs, REFS), spark.createDataFrame(links, LINKS)
    start = graph.start_symbol(tables[0], "r1", "n0")
    walk = graph.propagate(tables[0], tables[1], start, depth, tables[2])
    every = queue_walk(symbols, refs, links, start, depth)
    want = {}
    for r, f, s, l, d, reason, brk, pos, _ in every:
        x = want.setdefault((r, f, s), [(d, pos, l), set(), set()])
        x[0] = min(x[0], (d, pos, l))
        x[1].add(reason)
        x[2].add(brk)
    found = graph.impacts(walk).collect()
    assert {(r.repo, r.file, r.symbol) for r in found} == want.keys() and len(found) == len(want)
    for r in found:
        (d, pos, l), reasons, breaks = want[r.repo, r.file, r.symbol]
        assert (r.distance, r.line, r.reasons, r.breaks) == (d, l, sorted(reasons), sorted(breaks))
        proofs = [(a[0], a[1], a[2], b[0], b[1], b[2], b[3], b[5], b[6], b[7], b[8]) for a, b in zip(pos, pos[1:])]
        none = lambda v, other: other if v is None else v
        assert [(e.from_repo, e.from_file, e.from_symbol, e.to_repo, e.to_file, e.to_symbol, e.to_line, e.relation, none(e.call_line, -1), none(e.link_id, -1), none(e.note, "")) for e in r.evidence] == proofs
    places = lambda keep: len({x[:3] for x in every if keep(x)})
    caller = lambda x: x[7][-1][5] == "upstream_caller"
    assert graph.scope(walk).collect()[0].asDict() == {
        "direct_callers": places(lambda x: caller(x) and x[4] == 1), "indirect_callers": places(lambda x: caller(x) and x[4] > 1), "affected_symbols": places(lambda x: True), "affected_files": len({x[1] for x in every}),
        "affected_repos": len({x[0] for x in every}), "cross_boundary_edges": len({(x[7][-2][:3], x[:3]) for x in every if x[5] == CROSS}),
    }
    scored = scoring.score(graph.impacts(walk, proofs=False))
    items, few = [r.asDict() for r in scored.collect()], planning.deciding(scored)
    scope, risk = graph.scope(walk).collect()[0].asDict(), scoring.aggregate(scored).collect()[0].asDict()
    assert len(few) < len(items) and planning.plan(start, scope, items, risk) == planning.plan(start, scope, few, risk)
