"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of rows of hashed tables: one for the word, two for its first bytes,
so that inflected forms share what they have in common. Filters of several widths slide over a
text's words, each is max-pooled over the whole text, and a linear layer gives the logit. Gradients
reach only the windows that won the pooling, so a step touches few table rows.

Scores are calibrated by language: on labelled rows kept from the fit, each language gets the
threshold that separates best, and its logits are shifted so that the threshold is 0.5. A text's
language is guessed from its own function words.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloupe.llm.common import columns, map_texts
from codeloupe.llm.labelled import remainder, sample

#: Labelled rows that are learned from at most.
TRAIN_ROWS = 12_000
THRESHOLD = 0.5
WIDTHS = (1, 2, 3)
#: Bytes of a word that a table hashes (0: all), and the bits of its row numbers.
TABLES = ((0, 15), (5, 13), (7, 14))
DIMENSION, FILTERS = 12, 8
LANGUAGES = {
    b"en": b"the of and to in is that it for with was are this be on as at by from have not or",
    b"de": b"der die das und ist nicht ein von den mit des dem zu im auf sich auch eine",
    b"fr": b"le la les des et est une dans que qui pour du sur pas au avec elle un",
    b"es": b"el los las del y en que por con una para es su al se lo como",
}
LANGUAGE_OF = {w: k for k, ws in enumerate(LANGUAGES.values(), 1) for w in ws.split()}
#: Bytes of text that are split, and words that are convolved, at once.
PIECE, BLOCK = 1 << 18, 1 << 15
#: ASCII that is no letter or digit separates words; A-Z are lower-cased.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Memo(dict):
    """Packed row numbers and language mark of a word; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        packed, shift = 0, 0
        for size, bits in TABLES:
            packed |= (crc32(word[:size] if size else word) & ((1 << bits) - 1)) << shift
            shift += bits
        packed |= LANGUAGE_OF.get(word, 0) << shift
        if len(self) > 300_000:
            self.clear()
        self[word] = packed
        return packed


MEMO = Memo()
PAD = np.full(max(WIDTHS), -1, np.int64)


def packed_words(text: bytes) -> np.ndarray:
    """A whole text's words as numbers; split piece by piece, each ending behind a separator."""
    plain, parts, at = text.translate(PLAIN), [], 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= PIECE else plain.find(b" ", at + PIECE)
        words = plain[at : end if end >= 0 else len(plain)].split()
        parts.append(np.fromiter(map(MEMO.__getitem__, words), np.int64, len(words)))
        at = end if end >= 0 else len(plain)
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int64)


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words after each other, padding behind each; where each begins."""
    parts = [p for t in texts for p in (t, PAD)]
    sizes = np.fromiter((len(t) + len(PAD) for t in texts), np.int64, len(texts))
    return np.concatenate(parts), np.cumsum(sizes) - sizes


def language(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text the number of the language with most function words, 0 with none."""
    mark = np.where(words >= 0, words >> sum(bits for _, bits in TABLES), 0)
    votes = np.stack([np.add.reduceat((mark == k).astype(np.int32), starts) for k in range(1, len(LANGUAGES) + 1)])
    return np.where(votes.max(0) > 0, votes.argmax(0) + 1, 0)


@dataclass
class Cnn:
    tables: list[np.ndarray]
    kernels: list[np.ndarray]  # per width: width, dimension, filters
    biases: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: np.ndarray  # logits, by language number
    known: bool = True  # whether there was anything to learn

    def rows(self, words: np.ndarray) -> list[np.ndarray]:
        found, shift = [], 0
        for _, bits in TABLES:
            found.append((words >> shift) & ((1 << bits) - 1))
            shift += bits
        return found

    def embed(self, words: np.ndarray) -> np.ndarray:
        e = sum(t[r] for t, r in zip(self.tables, self.rows(words)))
        e[words < 0] = 0
        return e

    def pool(self, words: np.ndarray, starts: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Per text and filter (of all widths): its greatest value and, if asked, the first word of the window that has it.

        Words are embedded and convolved a block after the other, so memory doesn't depend on a
        text's length. A window that reaches into the next text never wins.
        """
        best = np.full((len(starts), len(self.out)), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64)
        for a in range(0, len(words), BLOCK):
            e = self.embed(words[a : a + BLOCK + max(WIDTHS) - 1])
            first = int(np.searchsorted(starts, a, side="right")) - 1
            cuts = np.append(a, starts[first + 1 : np.searchsorted(starts, a + BLOCK)]) - a
            for k, (kernel, bias) in enumerate(zip(self.kernels, self.biases)):
                n = min(BLOCK, len(e) - len(kernel) + 1)
                if n <= 0:
                    continue
                made = sum(e[o : o + n] @ kernel[o] for o in range(len(kernel))) + bias
                for o in range(1, len(kernel)):
                    beyond = starts[1:] - o - a
                    made[beyond[(beyond >= 0) & (beyond < n)]] = -np.inf
                columns_ = slice(k * FILTERS, (k + 1) * FILTERS)
                if not places:
                    most = np.maximum.reduceat(made, cuts[cuts < n])
                    own = best[first : first + len(most), columns_]
                    np.maximum(own, most, out=own)
                    continue
                for row, (lo, hi) in enumerate(zip(cuts, np.append(cuts[1:], n)), first):
                    if lo >= hi:
                        continue
                    win = made[lo:hi].argmax(0)
                    value = made[lo:hi][win, np.arange(FILTERS)]
                    better = value > best[row, columns_]
                    best[row, columns_][better] = value[better]
                    where[row, columns_][better] = (win + lo + a)[better]
        return best, where

    def logits(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.maximum(self.pool(words, starts)[0], 0) @ self.out + self.shift

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.known:
            return np.zeros(len(texts))
        words, starts = joined(texts)
        x = self.logits(words, starts) - self.thresholds[language(words, starts)]
        return 1 / (1 + np.exp(-np.clip(x.astype(float), -40, 40)))


def blank(seed: int = 11) -> Cnn:
    r = np.random.default_rng(seed)
    normal = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
    return Cnn(
        [normal(0.1, 1 << bits, DIMENSION) for _, bits in TABLES],
        [normal(0.3, w, DIMENSION, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        normal(0.3, len(WIDTHS) * FILTERS),
        0.0,
        np.zeros(len(LANGUAGES) + 1, np.float32),
    )


class Adagrad:
    def __init__(self, model: Cnn, rate: float):
        self.rate = rate
        self.sums: dict[int, np.ndarray] = {}

    def step(self, key: int, value: np.ndarray, gradient: np.ndarray, at: np.ndarray | None = None) -> None:
        seen = self.sums.setdefault(key, np.full(value.shape[:1] if at is not None else value.shape, 1e-2, np.float32))
        if at is None:
            seen += gradient**2
            value -= self.rate * gradient / np.sqrt(seen)
        else:
            seen[at] += (gradient**2).mean(1)
            value[at] -= self.rate * gradient / np.sqrt(seen[at])[:, None]


def train_step(model: Cnn, grow: Adagrad, words: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    n = len(y)
    best, where = model.pool(words, starts, places=True)
    filters = [slice(k * FILTERS, (k + 1) * FILTERS) for k in range(len(WIDTHS))]
    wins, pooled = [where[:, c] for c in filters], [np.maximum(best[:, c], 0) for c in filters]
    flat = np.concatenate(pooled, axis=1)
    logit = flat @ model.out + model.shift
    d = ((1 / (1 + np.exp(-logit)) - y) * weight / n).astype(np.float32)
    d_flat = np.outer(d, model.out)
    touched, spread = [], []
    for k, (kernel, win, pool) in enumerate(zip(model.kernels, wins, pooled)):
        g = d_flat[:, k * FILTERS : (k + 1) * FILTERS] * (pool > 0)
        d_kernel = np.empty_like(kernel)
        for o in range(len(kernel)):
            at = win + o
            d_kernel[o] = np.einsum("nf,nfd->df", g, model.embed(words[at].ravel()).reshape(*at.shape, DIMENSION))
            touched.append(at.ravel())
            spread.append((g[:, :, None] * kernel[o].T[None]).reshape(-1, DIMENSION))
        grow.step(100 + k, model.kernels[k], d_kernel)
        grow.step(200 + k, model.biases[k], g.sum(0))
    grow.step(300, model.out, flat.T @ d)
    model.shift -= 0.05 * float(d.sum())
    at, gradient = np.concatenate(touched), np.concatenate(spread)
    real = (words[at] >= 0) & (np.abs(gradient).max(1) > 0)
    at, gradient = at[real], gradient[real]
    for k, rows in enumerate(model.rows(words[at])):
        own, back = np.unique(rows, return_inverse=True)
        total = np.zeros((len(own), DIMENSION), np.float32)
        np.add.at(total, back, gradient)
        grow.step(k, model.tables[k], total, own)


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates the labels with the best F1, in the middle of its gap."""
    order = np.argsort(logits)
    x, hit = logits[order], y[order]
    above = hit[::-1].cumsum()[::-1]
    f1 = 2 * above / (np.arange(len(x), 0, -1) + y.sum())
    k = int(f1.argmax())
    return float(x[k] + x[k - 1]) / 2 if k else float(x[0]) - 1.0


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.08, seed: int = 11, least: int = 20) -> Cnn:
    """A model of texts (as packed words) with 0/1 labels.

    Every fifth row is kept for the thresholds. A language with fewer than ``least`` positive rows
    there uses the threshold of all. With no row, or rows of one class, the model knows nothing and
    scores 0.
    """
    model = blank(seed)
    if not len(y) or y.min() == y.max():
        model.known = False
        return model
    r = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 2
    if y[held].max() == 0 or y[~held].max() == 0:
        held[:] = False
    own = np.flatnonzero(~held)
    rare = max(1.0, min(4.0, (1 - y.mean()) / y.mean() / 2))
    model.shift = float(np.log(y.mean() * rare / (1 - y.mean())))
    grow = Adagrad(model, rate)
    for epoch in range(epochs):
        grow.rate = rate * (1 - epoch / epochs) + 0.01
        order = r.permutation(own)
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            words, starts = joined([texts[i] for i in part])
            train_step(model, grow, words, starts, y[part], np.where(y[part] > 0, rare, 1.0))
    kept = np.flatnonzero(held) if held.any() else np.arange(len(y))
    logits, languages = np.zeros(len(kept)), np.zeros(len(kept), int)
    for a in range(0, len(kept), 256):
        words, starts = joined([texts[i] for i in kept[a : a + 256]])
        logits[a : a + 256], languages[a : a + 256] = model.logits(words, starts), language(words, starts)
    model.thresholds[:] = best_threshold(logits, y[kept])
    for k in range(len(model.thresholds)):
        if y[kept][languages == k].sum() >= least:
            model.thresholds[k] = best_threshold(logits[languages == k], y[kept][languages == k])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Cnn:
    texts, y = sample(docs, labels, "toxic", most)
    return fit([packed_words(t) for t in texts], y)


def score(docs: DataFrame, model: Cnn) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Null texts score as empty ones, which have no words and the score of the bias alone. Repeated
    rows and ties of doc_id score alike, a null doc_id counts as the empty text for ``held_out``, an
    empty table gives no row, other columns aren't read. Texts of any length are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 3 MB, whatever the input

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        return {"doc_id": part.column(0), "held_out": part.column(2), "score": sent.value.score([packed_words(t) for t in texts])}

    rows = columns(docs, doc_id="long", text="string").withColumn("held_out", remainder() == 0)
    scored = map_texts(rows, "text", "doc_id long, held_out boolean, score double", work, most_bytes=1 << 20)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, most))
