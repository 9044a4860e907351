"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few surface features. Boosting cycles over the features and fits a shallow
tree of the current gradient to one feature at a time; what the trees of a feature add up to is a
lookup table over its bins. Then the most useful pairs get tables the same way. A score is the sum
of table entries: bin each feature by ``searchsorted`` and add.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloupe.llm.common import columns, map_texts
from codeloupe.llm.labelled import remainder, sample

#: Labelled rows that are learned from at most; memory and time of the fit are bounded by it.
TRAIN_ROWS = 6_000
#: A document is good from this score on.
THRESHOLD = 0.3
NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "stops", "commas", "symbols", "bars", "exclaims",
    "other_bytes", "distinct_words", "top_word", "same_next", "distinct_pairs", "log_lines", "line_bytes", "distinct_lines", "stopped_lines",
)


def features(text: bytes) -> list[float]:
    """The features of a whole text's UTF-8 bytes, in the order of ``NAMES``; all finite, also for ''."""
    size = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, high = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum()), int(count[128:].sum())
    spaces = int(count[9:14].sum() + count[32])
    symbols = int(count[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 123, 125, 126]].sum())
    words = text.split()
    n = len(words) or 1
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x]
    m = len(lines) or 1
    solid = (size - spaces) or 1
    return [
        np.log1p(size), np.log1p(len(words)), solid / n, upper / ((upper + lower + high) or 1), digits / solid,
        (solid - upper - lower - digits - high) / solid, count[46] / n, count[44] / n, symbols / n, int(count[124]) / n, int(count[33]) / n,
        high / solid, len(seen) / n, max(seen.values(), default=0) / n, sum(map(operator.eq, words, words[1:])) / n, pairs / n,
        np.log1p(len(lines)), size / m, len(set(lines)) / m, sum(x.endswith((b".", b"!", b"?")) for x in lines) / m,
    ]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, ridge: float) -> tuple[float, int]:
    """Gain and position (first bin on the right) of the best split of per-bin sums; position 0: none."""
    a, b, c = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a**2 / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(c < least) | (n.sum() - c < least)] = -1
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, ridge: float) -> np.ndarray:
    """The step of a tree of four leaves at most, as one value for each bin."""
    step = np.zeros(len(g))
    _, k = best_split(g, h, n, least, ridge)
    for lo, hi in ((0, k), (k, len(g))) if k else ((0, len(g)),):
        _, j = best_split(g[lo:hi], h[lo:hi], n[lo:hi], least, ridge)
        for a, b in ((lo, lo + j), (lo + j, hi)) if j else ((lo, hi),):
            step[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


@dataclass
class Gam:
    """Bin edges and lookup tables; picklable, a few kilobytes."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 12, rounds: int = 150, rate: float = 0.08, n_pairs: int = 8, least: int = 8, ridge: float = 1.0) -> Gam:
    """A model of the rows ``x`` with labels ``y``; of one class only, a constant near that class.

    A seventh of the rows decides how many rounds are kept, first of the single features, then of
    the pairs.
    """
    y = y.astype(float)
    cut = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    if not len(y):
        return Gam([], [])
    model = Gam([cut(v, bins) for v in x.T], [cut(v, coarse_bins) for v in x.T])
    rate_of_one = np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1))
    model.base = float(np.log(rate_of_one / (1 - rate_of_one)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if y.min() == y.max():
        return model
    held = np.arange(len(y)) % 7 == 3
    fine = np.stack([np.searchsorted(e, v, side="right") for e, v in zip(model.edges, x.T)])
    raw = np.full(len(y), model.base)
    loss = lambda r: float(np.mean(np.logaddexp(0, np.where(y[held] > 0, -r[held], r[held]))))

    def boost(cells: list[np.ndarray], shapes: list[tuple], grow) -> list[np.ndarray]:
        nonlocal raw
        tables = [np.zeros(s) for s in shapes]
        best, kept, kept_raw, stale = loss(raw), [t.copy() for t in tables], raw.copy(), 0
        for _ in range(rounds):
            for k, at in enumerate(cells):
                p = sigmoid(raw)
                size = int(np.prod(shapes[k]))
                sums = [np.bincount(at[~held], w[~held], size).reshape(shapes[k]) for w in (y - p, p * (1 - p), np.ones(len(y)))]
                step = rate * grow(*sums)
                tables[k] += step
                raw = raw + step.ravel()[at]
            if (now := loss(raw)) < best - 1e-5:
                best, kept, kept_raw, stale = now, [t.copy() for t in tables], raw.copy(), 0
            elif (stale := stale + 1) > 12:
                break
        raw = kept_raw
        return kept

    model.tables = boost(list(fine), [(len(t),) for t in model.tables], lambda g, h, n: tree(g, h, n, least, ridge))

    # The pairs whose cells would gain most from what the single features leave.
    wide = np.stack([np.searchsorted(e, v, side="right") for e, v in zip(model.coarse, x.T)])
    sizes = [len(e) + 1 for e in model.coarse]
    p = sigmoid(raw)
    gains = []
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes)):
            at = wide[i] * sizes[j] + wide[j]
            g, h = (np.bincount(at[~held], w[~held], sizes[i] * sizes[j]) for w in (y - p, p * (1 - p)))
            gains.append((float(np.sum(g**2 / (h + 4 * ridge))), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]

    def grow_pair(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        step = np.zeros(g.shape)
        _, k = best_split(g.sum(1), h.sum(1), n.sum(1), least, ridge)
        for rows in (slice(0, k), slice(k, None)) if k else (slice(None),):
            _, j = best_split(g[rows].sum(0), h[rows].sum(0), n[rows].sum(0), least, ridge)
            for cols in (slice(0, j), slice(j, None)) if j else (slice(None),):
                step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
        return step

    found = boost([wide[i] * sizes[j] + wide[j] for i, j in chosen], [(sizes[i], sizes[j]) for i, j in chosen], grow_pair)
    model.pairs = [(i, j, t) for (i, j), t in zip(chosen, found)]
    return model


def feature_rows(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Gam:
    texts, y = sample(docs, labels, "quality", most)
    return fit(feature_rows(texts), y)


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Null texts score as empty ones. Repeated rows score alike. With nothing to learn from, the
    score is 0.5.
    """

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        return {"doc_id": part.column(0), "held_out": part.column(2), "score": model.score(feature_rows(texts))}

    rows = columns(docs, doc_id="long", text="string").withColumn("held_out", remainder() == 0)
    scored = map_texts(rows, "text", "doc_id long, held_out boolean, score double", work)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, most))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model takes for good, with all their columns; no shuffle.

    A row's own text decides, so repeated rows and ties of doc_id stay or go together. Null and empty
    texts are judged as empty ones. An empty table stays empty. Other columns pass through, whatever
    their names; without labels to learn from every row scores 0.5 and stays.
    """
    model = train(docs, labels, most)

    def run(batches):
        from codeloupe.llm.common import slices

        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield part.filter(pa.array(model.score(feature_rows(texts)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
