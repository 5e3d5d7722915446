import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import lm_scoring as lm
from skerry.llm import recurrent as r
from skerry.llm.labelled import remainder

SCHEMA = "doc_id long, text string, held_out string, row int, word binary"


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()


def base(docs):
    train = [t for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in [*words(t), b" "])
    total, size = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    for i, t in docs:
        tokens = [*words(t), b" "]
        score = sum(math.log10((counts[w] + 1) / size) for w in tokens)
        yield i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), total, score


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1, b"y") for i, t in docs], SCHEMA).repartition(3)
    return lm.scored(df, remainder(F.col("doc_id"), 7) == 2).collect()


def corpus():
    rng = np.random.default_rng(0)
    kinds = [[f"{a}{b}" for b in "abcdefghij"] for a in ("ka", "Lo", "ñu")]
    docs = [(i, " ".join(rng.choice(kinds[i % 3], int(rng.integers(3, 60))))) for i in range(400)]
    docs += [(i, f"ka{'b' * 40} rare{i}   lo\ta {i}") for i in range(400, 430)] + [(430, None), (431, ""), (432, " \n"), (None, "kaa kab"), (None, None), (5, docs[5][1]), (5, docs[5][1])]
    return docs + [(433, " ".join(["kaa", "kab"] * 3000))]


@pytest.mark.parametrize("listed", [8, 1 << 17])
def test_counts_and_base_scores(spark, monkeypatch, listed):
    monkeypatch.setattr(lm, "HELD", 10)
    monkeypatch.setattr(lm, "LISTED", listed)
    docs = corpus()
    counts = lm.word_counts(spark.createDataFrame([(t,) for _, t in docs], "text string").select(F.col("text").cast("binary").alias("text")))
    found = lm.vocabulary(lm.durable(counts))
    assert len(found.words) <= listed + 1 and found.symbol_counts.sum() == found.total
    got = sorted((tuple(x)[:6] for x in run(spark, docs)), key=str)
    for g, w in zip(got, sorted(base(docs), key=str), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * abs(w[5])


def test_model_learns_and_texts_are_read_whole(spark):
    rows = {x.doc_id: x for x in run(spark, corpus()) if x.doc_id is not None}
    held = [x for i, x in rows.items() if x.held_out and i < 400]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert rows[433].score < 20 * max(rows[i].score for i in range(10))
    assert all(x.score < 0 for x in rows.values())


def test_empty_tables(spark):
    assert run(spark, []) == []
    (row,) = run(spark, [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b")])
    assert tuple(row)[1:6] == (True, 3, 0, 0, 0.0) and row.score <= 0


def test_every_word_has_a_share_and_they_sum_to_one():
    v = lm.Vocabulary([(f"w{k}".encode(), 5000 - k) for k in range(3000)], 7, 5000 * 3000, 4000)
    m = r.Model.initial(v.symbol_counts, 1)
    logp = [r.log_probabilities(m, [np.array([s])])[0] / math.log(10) + v.within[k] for k, s in enumerate(v.symbols)]
    rare = r.log_probabilities(m, [np.array([v.rare])])[0]
    assert abs(np.sum(10 ** np.array(logp)) + math.exp(rare) - 1) < 1e-4


def test_scores_do_not_depend_on_lanes_or_windows():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, r.SYMBOLS, int(n)) for n in rng.integers(1, 90, 60)]
    m = r.Model.initial(np.ones(r.SYMBOLS, np.int64), 3)
    one = np.array([r.log_probabilities(m, [d], 1, 7)[0] for d in docs])
    for lanes, window in ((1, 1000), (7, 5), (512, 64)):
        assert np.allclose(r.log_probabilities(m, docs, lanes, window), one, rtol=1e-4)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, r.SYMBOLS, n) for n in (5, 3, 4)]
    m = r.Model.initial(np.ones(r.SYMBOLS, np.int64), 5)
    m.values = {k: v.astype(np.float64) for k, v in m.values.items()}
    streams = r.Streams(docs, 2)
    (at, real), = streams.windows(50)
    x, keep, zero = streams.before[at], streams.keep[at].astype(np.float64), np.zeros((2, r.HIDDEN))

    def loss():
        return -r.output(m, r.forward(m, x, keep, zero)[real].astype(np.float64), streams.symbols[at[real]])[0].sum()

    saved = r.Saved(*x.shape)
    states = r.forward(m, x, keep, zero, saved)
    _, grads, dh = r.output(m, states[real].astype(np.float64), streams.symbols[at[real]], learn=True)
    dout = np.zeros(states.shape)
    dout[real] = dh
    recurrent, rows = r.backward(m, x, keep, saved, dout)
    full = np.zeros(r.SHAPES["x"])
    full[rows] = recurrent["x"]
    for k, g in {**grads, "u": recurrent["u"], "x": full}.items():
        for at_ in zip(*(a[:3] for a in np.unravel_index(np.argsort(-abs(g), axis=None)[:3], g.shape))):
            old, eps = m.values[k][at_], 1e-2
            m.values[k][at_] = old + eps
            up = loss()
            m.values[k][at_] = old - eps
            down = loss()
            m.values[k][at_] = old
            assert abs((up - down) / (2 * eps) - g[at_]) < 2e-2 * max(1, abs(g[at_])), k


def test_means_by_weight(spark):
    rows = [(b, s, float(w), [float(b + s)] * 3) for b in range(3) for s, w in enumerate((1, 3, 4))]
    got = lm.averaged(spark.createDataFrame(rows, "block int, salt int, weight double, values array<float>"))
    assert np.allclose(got, np.repeat([11 / 8, 19 / 8, 27 / 8], 3))


def far_words(n=700):
    """A model whose words beyond the head stand in trees of two or three levels."""
    v = lm.Vocabulary([(f"w{k}".encode(), 5000 - k) for k in range(r.HEAD + n)], 7, 5000 * 3000, 4000)
    m = r.Model.initial(v.symbol_counts, 1, v.tree)
    m.values = {k: x.astype(np.float64) for k, x in m.values.items()}
    return v, m


def test_state_decides_about_words_beyond_the_head():
    """They sum to one for any weights, start from their counts, and differ from them after another word."""
    v, m = far_words()
    numbers = v.symbols_of(np.arange(len(v.words)))
    alone = np.array([r.log_probabilities(m, [np.array([s])])[0] for s in numbers])
    classes = np.array([r.log_probabilities(m, [np.array([s])])[0] for s in v.symbols])
    assert np.allclose(alone, classes + v.within * math.log(10), atol=1e-5)
    m.values["t"] = np.random.default_rng(3).standard_normal(m.values["t"].shape)
    rare = r.log_probabilities(m, [np.array([v.rare])])[0]
    after = np.array([r.log_probabilities(m, [np.array([numbers[-1], s])])[0] - r.log_probabilities(m, [numbers[-1:]])[0] for s in numbers])
    alone = np.array([r.log_probabilities(m, [np.array([s])])[0] for s in numbers])
    assert abs(np.exp(alone).sum() + math.exp(rare) - 1) < 1e-4 and abs(alone - after)[r.HEAD :].max() > 0.1
    assert len(set(r.input_rows(numbers))) == len(numbers)


def test_trees_learn():
    v, m = far_words()
    a, b = v.symbols_of(np.array([400, 900]))
    docs = [np.array([a, b] * 40 + [0])] * 40
    before = r.log_probabilities(m, docs[:1])[0]
    m.values = {k: x.astype(np.float32) for k, x in m.values.items()}
    for _ in range(5):
        r.train(m, docs)
    assert r.log_probabilities(m, docs[:1])[0] > before / 2


def test_gradients_of_trees_agree_with_differences():
    v, m = far_words()
    rng = np.random.default_rng(6)
    m.values["t"] = rng.standard_normal(m.values["t"].shape) / 4
    h, words = rng.standard_normal((50, r.HIDDEN)), v.symbols_of(rng.integers(0, len(v.words), 50))
    _, grads, dh = r.output(m, h.copy(), words, learn=True)
    full = np.zeros(r.SHAPES["t"])
    full[grads.pop("slots")] = grads.pop("t")
    for table, g in ((m.values["t"], full), (h, dh)):
        for at in zip(*(x[:4] for x in np.unravel_index(np.argsort(-abs(g), axis=None)[:4], g.shape))):
            old, loss = table[at], []
            for step in (1e-4, -1e-4):
                table[at] = old + step
                loss.append(-r.output(m, h.copy(), words)[0].sum())
            table[at] = old
            assert (loss[0] - loss[1]) / 2e-4 == pytest.approx(g[at], rel=1e-3, abs=1e-3)
