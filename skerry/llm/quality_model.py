"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

The tokens of a text are its runs of letters, digits and punctuation. Features are hashed into 2^18 places: each
token, each pair of neighbours, the token's shape (all upper case, capital first, neither), pairs of shapes with
punctuation, and a mark where a word repeats the one before. A feature's value is its share of the text's features,
so that the score of a text is the mean weight of its features on a fixed scale: a sparse dot product.

FTRL-proximal (McMahan et al. 2013) visits a bounded seeded sample of labelled rows in seeded order a few times; its
L1 term leaves most weights at zero. A rarer label counts by the root of its rarity.

Defined results: a null text counts as empty; a text without tokens scores by the bias alone; repeated rows score
alike; null ids are allowed and never learned from; a repeated label row counts once, by its smallest label; without
any label every score is 0.5. Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.arrow_text import sliced
from skerry.llm.labelled import labelled_sample
from skerry.llm.word_hashes import Words, mixed

SAMPLE, EPOCHS = 8_000, 3
BITS = 18
SCALE = 30.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
_SHIFT = np.uint64(64 - BITS)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of all texts, text by text, and the n + 1 offsets of the texts in them."""
    words = Words(texts)
    h = words.hashes()
    n = np.diff(words.offsets)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    first = np.zeros(len(h), bool)
    first[words.offsets[:-1][n > 0]] = True
    last = np.roll(h, 1)
    echo = (h == last) & ~first & (words.kinds == 1)
    # Punctuation keeps its hash, so that its pairs with shapes are features; other tokens give their shape.
    shape = np.where(words.kinds == 3, h, mixed(words.kinds.astype(np.uint64) * np.uint64(4) + words.upper(), 9))
    shape[echo] = mixed(np.full(1, 77, np.uint64))[0]
    pair = mixed(last * np.uint64(3) + h, 1)
    shapes = mixed(np.roll(shape, 1) * np.uint64(5) + shape, 2)
    pair[first], shapes[first] = h[first], shape[first]
    places = (np.stack([h, pair, mixed(shape, 3), shapes], 1) >> _SHIFT).astype(np.int64)
    return places.reshape(-1), words.offsets * 4


@dataclass
class Model:
    """Weights of the hashed features, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        places, offsets = features(texts)
        sums = np.append(0.0, np.cumsum(self.weights[places], dtype=np.float64))
        n = np.maximum(np.diff(offsets), 1)
        margin = SCALE * (sums[offsets[1:]] - sums[offsets[:-1]]) / n + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def train(texts: pa.Array, labels: np.ndarray, seed: int = 5) -> Model:
    """FTRL-proximal over the texts and 0/1 labels."""
    rows = []
    for k in range(0, len(texts), 256):
        places, offsets = features(texts.slice(k, 256))
        for a, b in zip(offsets, offsets[1:]):
            at, count = np.unique(places[a:b], return_counts=True)
            rows.append((at.astype(np.int32), (SCALE * count / max(b - a, 1)).astype(np.float32)))
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last place is the bias
    rate = float(np.mean(labels)) if len(labels) else 0.5
    cost = np.array([(0.5 / max(1 - rate, 1e-3)) ** 0.5, (0.5 / max(rate, 1e-3)) ** 0.5])

    def weights_at(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zz) <= L1] = 0.0
        return w

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            w = weights_at(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -50, 50)))
            g = (p - labels[i]) * cost[int(labels[i])] * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights_at(np.arange(size + 1))
    return Model(w[:size].astype(np.float32), float(w[size]))


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Trains in one task on at most `sample` labelled rows for which `learn` holds."""
    chosen = labelled_sample(docs, labels, learn, id_col, text_col, label_col, sample)

    def once(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("text", "ascending")])  # the same order however rows arrive
        m = train(table.column("text").combine_chunks(), table.column("label").to_numpy())
        return pa.table({"weights": pa.array([m.weights.tobytes()], pa.binary()), "bias": pa.array([m.bias])})

    found = chosen.groupBy(F.lit(0).alias("all")).applyInArrow(once, "weights binary, bias double").collect()
    if not found:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(bytes(found[0]["weights"]), np.float32), found[0]["bias"])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            p = sent.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(id_col, text_col).mapInArrow(score, schema)
