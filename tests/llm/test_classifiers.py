import zlib

import numpy as np
import pytest

from codeloupe.llm import quality_gam, toxicity_cnn
from codeloupe.llm.labelled import sample
from tests.llm.conftest import prose


def rows(n=600):
    found = []
    for k in range(n):
        text = prose(k, 30 + k % 50)
        good, toxic = k % 3 > 0, k % 7 == 0
        if not good:
            text = " ".join(w + "$$$" for w in text.split()) if k % 2 else " ".join([text.split()[0]] * 60)
        if toxic:
            words = text.split()
            words.insert(len(words) // 2, "wretched")
            text = " ".join(words)
        found.append((k, text, int(good), int(toxic)))
    return found


@pytest.fixture(scope="module")
def tables(spark, docs):
    found = rows()
    return docs([r[:2] for r in found]), spark.createDataFrame([(r[0], r[2], r[3]) for r in found], "doc_id long, quality int, toxic int")


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


@pytest.mark.parametrize("operator, at", [(quality_gam, 2), (toxicity_cnn, 3)])
def test_held_out_rows(tables, operator, at):
    found = operator.classify(*tables).toPandas().set_index("doc_id")
    truth = {r[0]: r[at] for r in rows()}
    assert len(found) == len(truth) and found.score.between(0, 1).all()
    assert all(found.held_out[k] == held(k) for k in truth)
    own = [k for k in truth if held(k)]
    assert np.mean([found.predicted[k] == truth[k] for k in own]) > 0.97


def test_held_out_labels_are_never_read(spark, tables):
    texts, y = sample(*tables, "quality", 10_000)
    assert len(texts) == sum(not held(r[0]) for r in rows())
    assert len(sample(*tables, "quality", 25)[0]) == 25


@pytest.mark.parametrize("operator", [quality_gam, toxicity_cnn])
def test_odd_rows_and_labels(spark, docs, odd, operator):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (4, None, None), (5, 1, 0), (7, 1, 0), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    found = operator.classify(docs(odd).selectExpr("*", "9.0 AS score", "1 AS held_out"), labels).toPandas()
    assert len(found) == len(odd) and found.score.between(0, 1).all() and found.predicted.isin([0, 1]).all()
    assert found[found.doc_id == 5].score.nunique() == 1
    assert operator.classify(docs([]), labels).count() == 0
    assert operator.classify(docs(odd), labels.limit(0)).count() == len(odd)


def test_keep_good(spark, tables):
    model = quality_gam.train(*tables)
    kept = {r.doc_id for r in quality_gam.keep_good(*tables).collect()}
    scored = quality_gam.score(tables[0], model).toPandas()
    assert kept == set(scored[scored.predicted == 1].doc_id)


def test_gam_is_a_sum_of_tables():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)  # an interaction, no single feature helps
    model = quality_gam.fit(x, y, n_pairs=2)
    assert np.mean((model.score(x) > 0.5) == y) > 0.85
    assert any((i, j) == (0, 1) for i, j, _ in model.pairs)
    raw = model.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, x.T))
    for i, j, t in model.pairs:
        raw = raw + t[np.searchsorted(model.coarse[i], x[:, i], side="right"), np.searchsorted(model.coarse[j], x[:, j], side="right")]
    assert np.allclose(raw, model.raw(x))


def test_cnn_gradient():
    """A step lowers the loss of its batch."""
    texts = [toxicity_cnn.packed_words(r[1].encode()) for r in rows(60)]
    y = np.array([r[3] for r in rows(60)])
    model = toxicity_cnn.blank()
    words, starts = toxicity_cnn.joined(texts)
    loss = lambda: float(np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * model.logits(words, starts))))
    before, grow = loss(), toxicity_cnn.Adagrad(model, 0.05)
    for _ in range(30):
        toxicity_cnn.train_step(model, grow, words, starts, y, np.ones(len(y)))
    assert loss() < before * 0.7


def test_scores_do_not_depend_on_the_batch():
    texts = [toxicity_cnn.packed_words(r[1].encode()) for r in rows(50)] + [toxicity_cnn.packed_words(b"")]
    model = toxicity_cnn.fit(texts[:-1], np.array([r[3] for r in rows(50)]), epochs=2)
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts], atol=1e-5)


def test_languages():
    words, starts = toxicity_cnn.joined([toxicity_cnn.packed_words(t.encode()) for t in ("the house of this and that", "der Hund und die Katze", "le chat est dans la maison", "el perro y los gatos", "xyz", "")])
    assert toxicity_cnn.language(words, starts).tolist() == [1, 2, 3, 4, 0, 0]


def test_the_sample_is_bounded_in_rows_and_bytes(spark, docs):
    ids = [k for k in range(400) if not held(k)]
    repeated = docs([(k, prose(k, 20) + str(n)) for k in ids for n in range(4)])
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int")
    texts, y = sample(repeated, labels, "toxic", 50)
    assert len(texts) == len(y) == 50 and all(t.endswith(b"3") for t in texts)  # one text, the largest, of each
    texts, _ = sample(repeated, labels, "toxic", 400, most_bytes=2000)
    assert 0 < len(texts) < 50 and sum(map(len, texts)) <= 2000
    huge = docs([(ids[0], "x" * 5000), (ids[1], "y")])
    assert sample(huge, labels, "toxic", 400, most_bytes=100)[0] == [b"y"]
    assert sample(huge, labels, "toxic", 400, most_bytes=0)[0] == []


def plain_pool(model, words, starts):
    """Every window of every text by itself."""
    ends, found = [*starts[1:], len(words)], []
    for a, b in zip(starts, ends):
        row = []
        for kernel, bias in zip(model.kernels, model.biases):
            e = model.embed(words[a:b])
            row.append(np.max([sum(e[i + o] @ kernel[o] for o in range(len(kernel))) + bias for i in range(b - a - len(kernel) + 1)], axis=0))
        found.append(np.concatenate(row))
    return np.array(found)


@pytest.mark.parametrize("block, piece", [(1, 1), (3, 10), (7, 64), (1 << 15, 1 << 18)])
def test_pooling_in_blocks_like_brute_force(monkeypatch, block, piece):
    monkeypatch.setattr(toxicity_cnn, "BLOCK", block)
    monkeypatch.setattr(toxicity_cnn, "PIECE", piece)
    own = [prose(1, 40), "", "one", prose(2, 3), "two words", prose(3, 90), "x" * 300, " . "]
    texts = [toxicity_cnn.packed_words(t.encode()) for t in own]
    assert [len(t) for t in texts] == [40, 0, 1, 3, 2, 90, 1, 0]
    model = toxicity_cnn.blank(5)
    words, starts = toxicity_cnn.joined(texts)
    values, where = model.pool(words, starts, places=True)
    assert np.allclose(values, plain_pool(model, words, starts), atol=1e-5) and np.allclose(values, model.pool(words, starts)[0])
    for k, kernel in enumerate(model.kernels):
        for f in range(toxicity_cnn.FILTERS):
            for row in range(len(texts)):
                e = model.embed(words[where[row, k * toxicity_cnn.FILTERS + f] :][: len(kernel)])
                assert np.isclose(sum(e[o] @ kernel[o] for o in range(len(kernel)))[f] + model.biases[k][f], values[row, k * toxicity_cnn.FILTERS + f], atol=1e-5)
