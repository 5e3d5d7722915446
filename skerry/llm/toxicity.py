"""Toxicity by maximum-scoring segments of token log-odds.

Training, on a bounded seeded sample of labelled rows: for each form of a word (the word, and its first 3 to 6 bytes)
the documents of either label that hold it are counted, near copies once. The log-odds of a form between the labels
get a Dirichlet prior in proportion to its count in both, and are reduced by a multiple of their standard deviation.
A word scores the best of its forms less a drift, so that ordinary text falls. Scoring is one linear scan for all
maximal scoring segments (Ruzzo and Tompa). The best one's significance follows the extreme-value law of such maxima,
E = K n exp(-lambda S) for n words; the number of those as good as the r-th best is a Poisson count, so that r of them
come by chance with E^r / r! at most (Karlin and Altschul), where K bounds the counts seen in background texts. A text
takes its most significant r, at a factor of 2 for each further one; a logistic curve, fitted out of fold, turns the
negative logarithm into a probability.

Every significant passage is returned too: all maximal scoring segments whose own E is small enough.

Defined results: a null text counts as empty; a text without words scores as the least toxic text does; repeated
rows score alike; null ids are allowed and never learned from; a repeated label row counts once, by its smallest
label; without labels of both kinds every score is 0. Only the text enters a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.arrow_text import sliced
from skerry.llm.labelled import labelled_sample
from skerry.llm.word_hashes import Words, mixed

SAMPLE, CHUNK = 8_000, 256
PREFIXES = (3, 4, 5, 6)
PRIOR, SHRINK, DRIFT = 0.02, 1.5, 0.5
MOST_E = 0.01
_TOP = np.uint64(64 - 20)


@dataclass
class Model:
    """Scores of the forms worth more than the drift, by hash, and the calibration."""

    keys: np.ndarray
    values: np.ndarray
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -50.0
    crowd: float = 1.0  # K of the number of segments

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys, self.values = self.keys[order], self.values[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> _TOP] = True

    def token_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the letter tokens and their offsets by text."""
        letters = words.kinds == 1
        best = np.zeros(int(letters.sum()))
        if len(self.keys):
            for h in (words.hashes(), *(words.prefix_hashes(k) for k in PREFIXES)):
                h = h[letters]
                at = np.flatnonzero(self.maybe[h >> _TOP])
                place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
                hit = self.keys[place] == h[at]
                best[at[hit]] = np.maximum(best[at[hit]], self.values[place[hit]])
        return best - DRIFT, np.append(0, np.cumsum(letters))[words.offsets]

    def probability(self, sums: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """Of texts with these segment sums, largest first, and sizes in words."""
        x = evidence(sums, n, self.lam, self.k, self.crowd)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -50, 50)))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), in linear time."""
    steps, total = [], 0.0
    for i, s in enumerate(scores):
        if s > 0:
            steps.append((i, total, total + s))
        total += s
    return _maximal(steps)


def _maximal(steps: Iterable[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """The maximal segments, from (place, sum before, sum after) of the positive scores."""
    found: list[tuple] = []  # start, end, sum before, sum after, last place with a smaller sum before
    for i, before, after in steps:
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((start, i + 1, before, after, j))
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
    return [(a, b, after - before) for a, b, before, after, _ in found]


def segments(scores: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """All maximal segments (start, end, sum) of each text."""
    out = []
    for a, b in zip(offsets, offsets[1:]):
        part = scores[a:b]
        at = np.flatnonzero(part > 0)
        if len(at):
            sums = np.append(0.0, np.cumsum(part))
            out.append(_maximal(zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist())))
        else:
            out.append([])
    return out


def segment_sums(found: list[list[tuple[int, int, float]]]) -> list[np.ndarray]:
    """Sums of the segments of each text, largest first."""
    return [np.sort(np.array([v for *_, v in x]))[::-1] if x else np.zeros(0) for x in found]


def evidence(sums: list[np.ndarray], n: np.ndarray, lam: float, k: float, crowd: float) -> np.ndarray:
    """-log of the chance of each text's segments: of the best one, or of the r best, whichever is less."""
    out = -np.log(k * np.maximum(n, 1))
    for i, s in enumerate(sums):
        if len(s):
            out[i] += lam * s[0]
        if len(s) > 1:
            r = np.arange(2, len(s) + 1)
            x = lam * s[1:] - math.log(max(k, crowd) * max(n[i], 1))
            out[i] = max(out[i], (r * x + np.cumsum(np.log(r)) - (r - 1) * math.log(2)).max())
    return out


def _crowd(sums: list[np.ndarray], n: np.ndarray, lam: float) -> float:
    """The least K for which K n exp(-lambda s) bounds the number of segments above s in all these texts together."""
    s = np.sort(np.concatenate([*sums, np.zeros(0)]))[::-1]
    if not len(s):
        return 0.0
    count = np.arange(1, len(s) + 1)
    rare = count >= min(len(s), max(10, len(s) // 100))  # the few largest say little about their number
    return float(np.exp((np.log(count) + np.minimum(lam * s, 700))[rare].max()) / max(n.sum(), 1))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """The texts a few at a time, so that memory follows what is kept of them."""
    for k in range(0, len(texts), CHUNK):
        yield k, Words(texts.slice(k, CHUNK))


def _forms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct forms of each text."""
    found = []
    for k, words in _chunks(texts):
        letters = words.kinds == 1
        text = np.repeat(np.arange(len(words.offsets) - 1, dtype=np.int32), np.diff(words.offsets))[letters]
        hashes = [words.hashes()[letters]] + [words.prefix_hashes(n)[letters] for n in PREFIXES]
        h, t = np.concatenate(hashes), np.tile(text, len(hashes))
        t, h = t[h != 0], h[h != 0]
        order = np.lexsort((h, t))
        t, h = t[order], h[order]
        new = np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])) if len(t) else np.zeros(0, bool)
        found.append((t[new] + np.int32(k), h[new]))
    return np.concatenate([t for t, _ in found]), np.concatenate([h for _, h in found])


def first_copies(texts: pa.Array) -> np.ndarray:
    """False for texts that share two of four minima of hashed word triples with an earlier text."""
    seen: list[set] = [set() for _ in range(4)]
    out = np.ones(len(texts), bool)
    for k, words in _chunks(texts):
        h = words.hashes()
        triple = mixed(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:]) if len(h) > 2 else h[:0]
        salted = [mixed(triple, n + 1) for n in range(4)]
        for i, (a, b) in enumerate(zip(words.offsets, words.offsets[1:])):
            if b - a > 2:
                least = [int(s[a : b - 2].min()) for s in salted]
                out[k + i] = sum(m in s for m, s in zip(least, seen)) < 2
                for m, s in zip(least, seen):
                    s.add(m)
    return out


def log_odds(text: np.ndarray, forms: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forms and their shrunken log-odds, where these exceed the drift."""
    keys, which = np.unique(forms, return_inverse=True)
    a = np.bincount(which, toxic[text], len(keys))
    b = np.bincount(which, ~toxic[text], len(keys))
    n1, n0 = a.sum(), b.sum()
    prior = PRIOR * (a + b)
    total = PRIOR * (n1 + n0)
    odds = np.log((a + prior) / (n1 + total - a - prior)) - np.log((b + prior) / (n0 + total - b - prior))
    lower = odds - SHRINK * np.sqrt(1 / (a + prior) + 1 / (b + prior))
    return keys[lower > DRIFT], lower[lower > DRIFT]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift by damped Newton steps, slightly penalised."""
    mean, spread = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - 1e-2 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad)
        w += np.clip(step, -2, 2)
    slope = max(w[0], 0.0) / spread
    return float(slope), float(w[1] - slope * mean)


def _background(scores: np.ndarray) -> float:
    """The positive root of mean(exp(lambda * score)) = 1."""
    if not (scores > 0).any():
        return 1.0
    low, high = 1e-6, 50.0
    value, count = np.unique(np.round(scores, 3), return_counts=True)
    share = count / count.sum()
    for _ in range(60):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            low, high = (low, mid) if (share * np.exp(mid * value)).sum() > 1 else (mid, high)
    return low


def train(texts: pa.Array, labels: np.ndarray) -> Model:
    """The model of a sample of texts and 0/1 labels."""
    toxic = labels.astype(bool)
    none = Model(np.zeros(0, np.uint64), np.zeros(0))
    keep = first_copies(texts)
    texts, toxic = texts.filter(pa.array(keep)), toxic[keep]
    if toxic.all() or not toxic.any():
        return none
    text, forms = _forms(texts)
    fold = np.zeros(len(toxic), np.int64)
    for label in (False, True):
        at = np.flatnonzero(toxic == label)
        fold[at] = np.arange(len(at)) % 2
    sums, n, background = [np.zeros(0)] * len(toxic), np.zeros(len(toxic)), []
    for k in (0, 1):  # scores out of fold
        there = fold[text] != k
        part = Model(*log_odds(text[there], forms[there], toxic))
        for start, words in _chunks(texts):
            scores, offsets = part.token_scores(words)
            held = slice(start, start + len(offsets) - 1)
            own = fold[held] == k
            n[held][own] = np.diff(offsets)[own]
            for i, found in enumerate(segment_sums(segments(scores, offsets))):
                if own[i]:
                    sums[start + i] = found
            background.append(scores[np.repeat(own & ~toxic[held], np.diff(offsets))])
    lam = _background(np.concatenate(background))
    # Under the law the mean of n exp(-lambda S) over background texts is 1/K.
    clean = ~toxic
    best = np.array([s[0] if len(s) else 0.0 for s in sums])
    crowd = _crowd([s for s, c in zip(sums, clean) if c], n[clean], lam)
    k_hat = 1 / max(np.mean(np.maximum(n[clean], 1) * np.exp(-np.minimum(lam * best[clean], 700))), 1e-300)
    slope, shift = _logistic(evidence(sums, n, lam, k_hat, crowd), toxic.astype(float))
    final = Model(*log_odds(text, forms, toxic))
    return Model(final.keys, final.values, lam, float(k_hat), slope, shift, crowd)


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Trains in one task on at most `sample` labelled rows for which `learn` holds."""
    chosen = labelled_sample(docs, labels, learn, id_col, text_col, label_col, sample)

    def once(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("text", "ascending")])  # the same order however rows arrive
        m = train(table.column("text").combine_chunks(), table.column("label").to_numpy())
        head = [m.lam, m.k, m.slope, m.shift, m.crowd]
        return pa.table({"keys": pa.array([m.keys.tobytes()], pa.binary()), "numbers": pa.array([[*head, *m.values.tolist()]], pa.list_(pa.float64()))})

    found = chosen.groupBy(F.lit(0).alias("all")).applyInArrow(once, "keys binary, numbers array<double>").collect()
    if not found:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    return Model(np.frombuffer(bytes(found[0]["keys"]), np.uint64), np.array(found[0]["numbers"][5:]), *found[0]["numbers"][:5])


def scored(docs: DataFrame, model: Model, most_e: float = MOST_E, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted and passages (first word, last word, sum, e) of each row.

    Passages are all maximal segments with E of at most `most_e`, in order; words are runs of letters, counted from 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most the forms of the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in sliced(batches, 1):
            scores, offsets = m.token_scores(Words(batch.column(1)))
            found, n = segments(scores, offsets), np.diff(offsets)
            p = m.probability(segment_sums(found), n)
            e = lambda i, value: float(max(m.k, m.crowd) * n[i] * math.exp(-m.lam * value))
            passages = [[{"first": a, "last": b - 1, "score": v, "e": e(i, v)} for a, b, v in x if e(i, v) <= most_e] for i, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(passages, kind)], names=[id_col, "score", "predicted", "passages"])

    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("e", pa.float64())]))
    passage = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e", T.DoubleType())])
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.ArrayType(passage))])
    return docs.select(id_col, text_col).mapInArrow(score, schema)
