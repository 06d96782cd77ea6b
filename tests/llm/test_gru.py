"""The recurrent model of op4 against a plain recurrence, and that its training does its whole job in full windows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinespark.llm import gru, gru_lm

COUNTS, OTHER = np.array([30.0, 50, 40, 20, *range(1, 90)][::-1]), 25.0


def some_docs(n, longest, seed=0):
    rng = np.random.default_rng(seed)
    return [np.append(rng.integers(1, len(COUNTS) + 1, k), 0) for k in [longest, 0, *rng.integers(0, 40, n - 2)]]


def plain(p, doc):
    """Log-likelihood of one document, a step at a time in 64 bits."""
    q = {k: v.astype(np.float64) for k, v in p.items()}
    words, span, last = len(p["gates"]) - 1, p["to_word"].shape[2], len(p["to_word"])
    h, total = np.zeros(p["back"].shape[1]), 0.0
    share = lambda a: a - a.max() - np.log(np.exp(a - a.max()).sum())
    for x, y in zip([0, *doc[:-1]], doc):
        g, b = q["gates"][x] + q["bias"], h @ q["back"]
        r, z = (1 / (1 + np.exp(-(g[k] + b[k]))) for k in range(2))
        c = np.tanh(g[2] + r * b[2])
        h = c + z * (h - c)
        h1 = np.append(h, 1)
        total += share(h1 @ q["to_class"])[last if y == words else y // span]
        if y != words:
            total += share(h1 @ q["to_word"][y // span])[y % span]
    return total


def test_scores_are_those_of_a_plain_recurrence():
    docs, model = some_docs(300, 700), gru.init(COUNTS, OTHER)
    trainer = gru.Trainer(model)
    for _ in range(3):
        gru.train(trainer, docs)
    assert np.allclose(gru.score(model, docs), [plain(model, d) for d in docs], rtol=1e-4, atol=1e-3)
    assert len(gru.score(model, [])) == 0
    # a class whose words lie far apart is still a distribution
    model["to_word"][:, -1, 0] += 200
    assert np.allclose(gru.score(model, docs[:3]), [plain(model, d) for d in docs[:3]], rtol=1e-4)


def test_gradients_agree_with_differences():
    rng, model = np.random.default_rng(2), gru.init(COUNTS, OTHER)
    model = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in model.items()}
    y = rng.integers(0, len(COUNTS) + 1, (6, 40))
    x, h = np.vstack([rng.integers(0, 4, (1, 40)), y[:-1]]), rng.standard_normal((40, gru.HIDDEN)).astype(np.float32) * 0.3
    grads, used, _ = gru.Trainer(model).gradients(x, y, h)

    def loss(p):
        states, _ = gru._steps(gru._tables(p), x, h, False)
        return -gru._log_probs(p, states.reshape(-1, gru.HIDDEN), y.ravel(), None)[0].sum()

    for k in model:
        way = rng.standard_normal(model[k].shape).astype(np.float32)
        step = lambda e: loss({**model, k: model[k] + np.float32(e) * way})
        got = (grads[k] * (way[used] if k == "gates" else way)).sum()
        assert np.isclose(got, (step(0.003) - step(-0.003)) / 0.006, rtol=0.02, atol=0.3), k


@pytest.mark.parametrize("longest", [20_000, 5])
def test_training_steps_in_full_windows(monkeypatch, longest):
    docs, sizes, step = some_docs(3000, longest), [], gru.Trainer.window
    monkeypatch.setattr(gru.Trainer, "window", lambda self, x, y, *rest: sizes.append(y.size) or step(self, x, y, *rest))
    trainer = gru.Trainer(gru.init(COUNTS, OTHER))
    gru.train(trainer, docs)
    words = sum(map(len, docs))
    assert trainer.tokens == sum(sizes) == words  # every word of every document, once
    assert len(sizes) <= 1.5 * words / (gru.WINDOW * max(gru.LEAST, min(gru.LANES, words // (gru.WINDOW * gru.STEPS))))


def test_words_and_slices():
    texts = ["", " ", "\t A b\x0b\nC\x0c ", "Ünï ÇÖDÉ x y", "\x1c\x00 q", "one"] * 7
    words, n = gru_lm._words(pa.array(texts))
    want = [t.encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]
    ids = gru_lm._own_ids(gru_lm._ranks(words, pa.array([b"one", b"b", b"q"], pa.binary())), n, 2, 9)
    assert [x.tolist() for x in ids] == [[{b"one": 1, b"b": 2}.get(x, 9) for x in w] + [0] for w in want]


@pytest.mark.parametrize("size", [1, 20, 10_000])
def test_slices_hold_all_rows(monkeypatch, size):
    monkeypatch.setattr(gru_lm, "SLICE", size)
    texts = ["x" * k for k in (0, 3, 50, 0, 0, 7, 19, 1, 0)]
    batches = [pa.RecordBatch.from_pydict({"text": texts}), pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})]
    assert [t for b in gru_lm._slices(iter(batches)) for t in b["text"].to_pylist()] == texts


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_training_helps_held_out_texts(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions, "doc_id")
    model, base, n = gru_lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert n > 100 and model > 0.98 * base
