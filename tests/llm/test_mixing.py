import math
from collections import Counter

import numpy as np
import pytest

from codeloupe.llm import mixing as m
from tests.llm.conftest import prose


def temper(totals, **options):
    """The mix of totals by source; its weights and budgets."""
    full = [t for t in totals.values() if t]
    mix = m.temper(len(full), min(full, default=0), max(full, default=0), m.sums_of(np.array(full, float), np.ones(len(full))), **options)
    weights = {s: mix.weight_of(t) for s, t in totals.items()}
    return mix, weights, {s: w * mix.budget for s, w in weights.items()}


def entropy(weights):
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def plain_temper(totals, target_entropy=m.TARGET_ENTROPY, max_repetition=m.MAX_REPETITION, budget=None):
    """The largest exponent that is enough, by stepping down in small steps; weights by the formula."""
    full = {s: t for s, t in totals.items() if t}

    def weights(a):
        raised = {s: (t / max(full.values())) ** a for s, t in full.items()}
        return {s: r / sum(raised.values()) for s, r in raised.items()}

    a = 1.0
    while a > 0:
        w = weights(a)
        passes = [w[s] / t for s, t in full.items()]
        if entropy(w) + 1e-12 >= target_entropy * math.log(len(full)) or (max(passes) / min(passes) if budget is None else max(passes) * budget) >= max_repetition:
            break
        a -= 1e-4
    return a, weights(a)


@pytest.mark.parametrize("options", [{}, {"target_entropy": 0.9, "max_repetition": 1e9}, {"target_entropy": 1.0, "max_repetition": 3.0}, {"budget": 500, "max_repetition": 1.2}])
def test_temper_like_brute_force(options):
    for totals in ({"a": 1000, "b": 100, "c": 10}, {"a": 7, "b": 5}, {"a": 10, "b": 10, "c": 10}, {k: (k * k) % 97 + 1 for k in range(50)}):
        mix, weights, _ = temper(totals, **options)
        a, plain = plain_temper(totals, **options)
        assert mix.exponent == pytest.approx(a, abs=3e-4) and all(weights[s] == pytest.approx(plain[s], abs=1e-3) for s in totals)


def test_repetition_binds():
    mix, weights, budgets = temper({"a": 1000, "b": 100, "c": 10}, target_entropy=1.0, max_repetition=3.0)
    passes = {s: budgets[s] / t for s, t in (("a", 1000), ("b", 100), ("c", 10))}
    assert passes["a"] == pytest.approx(1.0) and max(passes.values()) == pytest.approx(3.0, rel=1e-6)
    assert sum(weights.values()) == pytest.approx(1.0)


def test_entropy_binds():
    totals = {"a": 1000, "b": 300, "c": 200}
    mix, weights, _ = temper(totals, target_entropy=0.9, max_repetition=1e9)
    assert entropy(weights) == pytest.approx(0.9 * math.log(3), rel=1e-6)


def test_budget():
    mix, _, budgets = temper({"a": 900, "b": 100}, budget=500)
    assert sum(budgets.values()) == pytest.approx(500) and max(budgets["a"] / 900, budgets["b"] / 100) <= m.MAX_REPETITION + 1e-9


@pytest.mark.parametrize("totals", [{}, {"a": 0}, {"a": 5}, {"a": 0, None: 7}, {"a": 4, "b": 4}])
def test_edges(totals):
    mix, weights, _ = temper(totals)
    assert mix.exponent == 1.0 and sum(weights.values()) == pytest.approx(1.0 if any(totals.values()) else 0.0)


@pytest.fixture(scope="module")
def rows(odd):
    return odd + [(k, prose(k, 20 + k % 9), "big") for k in range(100, 180)] + [(k, prose(k, 15), "small") for k in range(200, 212)] + [(500, prose(9, 5), None), (501, None, "silent"), (502, "", "silent")]


def test_draws(docs, rows):
    df = docs(rows)
    options = {"target_entropy": 1.0, "max_repetition": 2.5}
    found = m.draws(df, block_tokens=300, **options).toPandas()
    have = Counter((i, s) for i, _, s in [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows])
    totals = {s: sum(len((r[1] or "").split()) for r in rows if (r[2] if len(r) > 2 else "s") == s) for s in {s for _, s in have}}
    mix, _, budgets = temper(totals, **options)
    key = lambda v: None if v is None or v != v else v
    got = Counter((key(r.doc_id), key(r.source)) for r in found.itertuples())
    for (i, s), n in got.items():
        passes = budgets[s] / totals[s] if totals[s] else 1
        assert math.floor(passes + 1e-9) * have[i, s] <= n <= math.ceil(passes - 1e-9) * have[i, s]
    assert set(got) == set(have)  # nothing is lost
    for s, g in found.groupby("source"):
        longest = max(len((r[1] or "").split()) for r in rows if (r[2] if len(r) > 2 else "s") == s)
        if totals[s]:
            assert budgets[s] - 1e-6 <= g.n_tokens.sum() < budgets[s] + longest
        # Running totals: in the order of epochs and draws, each begins where the last one ended.
        g = g.sort_values(["epoch", "at", "n_tokens"])
        assert g["at"].tolist() == (g.n_tokens.cumsum() - g.n_tokens).tolist()
    blocks = found.groupby(["block"]).n_tokens.sum()
    assert found.block.min() == 0 and len(blocks) == math.ceil(mix.budget / 300)


def test_mixed_rows_are_the_draws(docs, rows):
    df = docs(rows).selectExpr("*", "1 AS draw", "2 AS epoch")
    options = {"target_entropy": 1.0, "max_repetition": 2.5}
    got = Counter((r.doc_id, r.text) for r in m.mixed(df, **options).collect())
    drawn = m.mixture(docs(rows), **options).groupBy("doc_id").count().collect()
    by_id = Counter()
    for (i, _), n in got.items():
        by_id[i] += n
    assert by_id == Counter({r.doc_id: r["count"] for r in drawn})
    assert m.mixed(df).columns == df.columns


def test_draws_do_not_depend_on_the_layout(docs, rows):
    a, b = (sorted(map(str, m.mixture(df).collect())) for df in (docs(rows), docs(rows[::-1]).repartition(7)))
    assert a == b


def test_nothing(docs):
    assert m.mixture(docs([])).count() == 0 and m.mixed(docs([])).count() == 0


def plain_draws(rows, seed, options):
    """Every copy of every row, one after the other, by the rule."""
    own = [(i, r[2] if len(r) > 2 else "s", len((r[1] or "").split()), r[1]) for r in rows for i in [r[0]]]
    totals = Counter()
    for _, s, n, _ in own:
        totals[s] += n
    _, _, budgets = temper(dict(totals), **options)
    found = Counter()
    for s, total in totals.items():
        passes = budgets[s] / total if total else 1.0
        at = 0
        for epoch in range(math.ceil(passes - 1e-9)):
            for i, n, text in sorted(((i, n, t) for i, x, n, t in own if x == s), key=lambda r: ORDER[seed, epoch, r[0], r[2]]):
                if epoch < math.floor(passes + 1e-9) or at < budgets[s]:
                    found[i, s, n, epoch, at] += 1
                at += n
    return found


ORDER = {}


def test_draws_like_brute_force(spark, docs, rows):
    options = {"target_entropy": 1.0, "max_repetition": 2.5}
    for epoch in range(4):
        for r in docs(rows).selectExpr("doc_id", "text", f"xxhash64({m.SEED}, {epoch}, doc_id, xxhash64(text)) AS draw").collect():
            ORDER[m.SEED, epoch, r.doc_id, r.text] = (r.draw, r.doc_id is not None, r.doc_id or 0)
    found = Counter((r.doc_id, r.source, r.n_tokens, r.epoch, r["at"]) for r in m.draws(docs(rows), **options).collect())
    assert found == plain_draws(rows, m.SEED, options)


def test_any_number_of_sources(docs, rows, monkeypatch):
    few = sorted(map(str, m.mixture(docs(rows)).collect()))
    kept = Counter((r.doc_id, r.text) for r in m.mixed(docs(rows)).collect())
    monkeypatch.setattr(m, "MAX_SOURCES", 1)
    monkeypatch.setattr(m, "MAX_TOTALS", 1)
    assert sorted(map(str, m.mixture(docs(rows)).collect())) == few
    assert Counter((r.doc_id, r.text) for r in m.mixed(docs(rows)).collect()) == kept


def test_a_row_repeated_many_times(docs, monkeypatch):
    monkeypatch.setattr(m, "COPIES", 7)
    rows = [(1, "a b c", "hot")] * 50 + [(2, "d", "hot"), (3, "e f", "cold")]
    found = m.draws(docs(rows), target_entropy=1.0, max_repetition=1.5).toPandas()
    hot = found[(found.source == "hot") & (found.epoch == 0)].sort_values("at")
    assert len(hot) == 51 and hot["at"].tolist() == (hot.n_tokens.cumsum() - hot.n_tokens).tolist()


def test_clashing_and_dotted_columns(docs):
    df = docs([(1, "a b", "x"), (2, None, None)]).selectExpr("*", "1 AS __source", "2 AS row", "3 AS `a.b`", "4 AS last", "5 AS of", "6 AS pass", "7 AS at")
    found = m.mixed(df)
    assert found.columns == df.columns and found.count() == 2 and m.draws(df).count() == 2
