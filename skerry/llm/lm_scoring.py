"""Document log-likelihood by a recurrent language model whose words are counted over the whole corpus.

Counts of all words of the training rows are summed by shuffle. The most frequent words, at most LISTED by a threshold
on the count, go to the tasks and are words of the recurrent model (see `recurrent`), which reads each of them and
predicts each from its state: the first by a softmax over their class, the others by softmaxes down the tree of theirs.
All words that are not listed make up the last class, which the model reads and predicts; of the class their counts
decide, which are joined by shuffle, so that nothing is cut from the vocabulary.

The model learns from every training row once, in ROUNDS of growing shares of the rows. In a round each task goes on
from the same model over its own rows, and the models are averaged by their numbers of tokens (local stochastic
gradient descent), block by block and in two levels. Texts are read twice: for the counts, and to write their symbols
into the shared folder, where training and scoring find them; that folder goes when the scores are kept.

Defined results: tokens are the runs of other than ASCII blanks, A-Z in lower case, then one end; a null text is
empty. Null ids and ids that are not held out are learned from. Without training rows all counts are zero. Repeated
rows each get a row. A text is one sequence, read by one task from start to end. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm import recurrent
from skerry.llm.arrow_text import sliced
from skerry.session import durable, remove_folder, shared_folder

END = b" "
LISTED, LONGEST = 1 << 18, 32
HELD, TEXT_BYTES, TRAIN_BYTES, SCORE_BYTES = 300_000, 1 << 20, 12 << 20, 12 << 20
ROUNDS = (1, 5, 30)
PART, SALTS = 16_384, 64


def key_of(word: bytes) -> bytes:
    """The word, or its digest where it is long; 0xFF begins no word."""
    return word if len(word) <= LONGEST else b"\xff" + hashlib.md5(word).digest()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over all texts of (text as bytes), the end included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def table() -> pa.RecordBatch:
            keys = pa.array([key_of(w) for w in held], pa.binary())
            return pa.RecordBatch.from_arrays([keys, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in sliced(batches, 0, 1 << 20):
            for text in batch.column(0):
                held.update((text.as_py() or b"").lower().split())
            held[END] += len(batch)
            if len(held) > HELD:
                yield table()
                held.clear()
        if held:
            yield table()

    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Listed words by falling count, the end first; their symbols, and what their counts say of base and class."""

    def __init__(self, listed: list[tuple[bytes, int]], end: int, total: int, distinct: int):
        listed = sorted(listed, key=lambda w: (-w[1], w[0]))
        self.words = [END] + [w for w, _ in listed]
        self.counts = np.array([end] + [c for _, c in listed], np.int64)
        self.total, self.distinct = total, distinct
        ranks, head, last = np.arange(len(self.words)), recurrent.HEAD, recurrent.FURTHER - 1
        ratio = np.log(np.maximum(ranks / head, 1)) / math.log(max(LISTED / head, 2))
        self.symbols = np.where(ranks < head, ranks, head + np.minimum((ratio * last).astype(np.int64), last - 1))
        self.rare = head + last
        self.rare_tokens, self.rare_words = total - int(self.counts.sum()), distinct - len(listed) - (end > 0)
        self.rare_size = math.log10(self.rare_tokens + self.rare_words + 1)
        self.symbol_counts = np.bincount(self.symbols, self.counts, recurrent.SYMBOLS)
        self.symbol_counts[self.rare] = self.rare_tokens
        # Of a further class the model starts from the counts.
        within = np.log10(np.maximum(self.counts, 1) / np.maximum(self.symbol_counts[self.symbols], 1))
        self.within = np.where(ranks < head, 0.0, within)
        self.base = np.log10(self.counts + 1)
        self.tree = recurrent.Tree(self.symbols[head:], np.maximum(self.counts[head:], 1))
        self._place: dict[bytes, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None}

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place in the list of each word and of the end after them; -1 where a word is not listed."""
        if self._place is None:
            self._place = {w: k for k, w in enumerate(self.words)}
        out = np.zeros(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(self._place.get, words, repeat(-1)), np.int64, len(words))
        return out

    def symbols_of(self, places: np.ndarray) -> np.ndarray:
        """Numbers of words in the model."""
        return np.where(places < 0, self.rare, np.where(places < recurrent.HEAD, places, places + recurrent.FURTHER))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Words down to the count at which at most LISTED would be listed; counts are held in eighths of an octave."""
    step = F.floor(F.log2("c") * 8)
    usable = (F.octet_length("word") <= LONGEST) & (F.col("word") != F.lit(END))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    steps = sorted(((r["s"], r["n"]) for r in counts.where(usable).groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)  # some hundreds
    held, least = 0, None
    for s, n in steps:
        held += n
        if held > LISTED:
            break
        least = s
    listed = [] if least is None else counts.where(usable & (step >= least)).collect()
    return Vocabulary([(bytes(r["word"]), r["c"]) for r in listed], sums[2], sums[0], sums[1])


def averaged(parts: DataFrame) -> np.ndarray | None:
    """Mean by weight of (block, salt, weight, values), end to end in the order of blocks; the result has a fixed size."""

    def mean(table: pa.Table) -> pa.Table:
        weights = table.column("weight").to_numpy()
        total = np.zeros(len(table.column("values")[0]))
        for w, v in zip(weights, table.column("values")):
            total += w * v.values.to_numpy(zero_copy_only=False)
        out = {"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "weight": pa.array([weights.sum()]), "values": pa.array([(total / weights.sum()).astype(np.float32)], pa.list_(pa.float32()))}
        return pa.table(out)

    kind = "block int, weight double, values array<float>"
    some = parts.groupBy("block", "salt").applyInArrow(mean, kind).groupBy("block").applyInArrow(mean, kind)
    rows = sorted(some.select("block", "values").toArrow().to_pylist(), key=lambda r: r["block"])
    return np.concatenate([np.array(r["values"], np.float32) for r in rows]) if rows else None


def trained(rows: DataFrame, words: Vocabulary, seed: int) -> recurrent.Model:
    """The model after one pass over all of (symbols, place), place a number from 0 to 1 that deals rows to rounds."""
    tree = words.tree
    model = recurrent.Model.initial(words.symbol_counts, seed, tree)

    def learn(start: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, tokens = recurrent.Model.of(start, tree), 0
            for batch in sliced(batches, 0, TRAIN_BYTES):
                docs = [np.frombuffer(s.as_buffer(), np.int32) for s in batch.column(0)]
                recurrent.train(own, docs)
                tokens += sum(map(len, docs))
            if tokens:
                flat = own.flat()
                blocks = [flat[a : a + PART] for a in range(0, len(flat), PART)]
                n, salt = len(blocks), TaskContext.get().partitionId() % SALTS
                columns = [pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([float(tokens)] * n), pa.array(blocks, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "salt", "weight", "values"])

        return run

    edges = np.cumsum((0, *ROUNDS)) / sum(ROUNDS)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = rows.where((F.col("place") >= low) & (F.col("place") < high)).select("symbols")
        flat = averaged(own.mapInArrow(learn(model.flat()), "block int, salt int, weight double, values array<float>"))
        model = model if flat is None else recurrent.Model.of(flat, tree)
    return model


def encoded(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """(row, own, n_tokens, listed, base, n_rare, rare, times, symbols): tokens, listed ones of a known count, their base, the words that are not listed, and the numbers of all; from (row, own, text)."""
    names = ["row", "own", "n_tokens", "listed", "base", "n_rare", "rare", "times", "symbols"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, TEXT_BYTES):
            columns: list[list] = [[] for _ in kinds]
            for text in batch.column(2):
                tokens = (text.as_py() or b"").lower().split()
                places = words.places(tokens)
                rare = Counter(tokens[i] for i in np.flatnonzero(places < 0).tolist())
                found = places[places >= 0]
                row = (len(places), int((words.counts[found] > 0).sum()), float(words.base[found].sum()), len(places) - len(found), [key_of(w) for w in rare], list(rare.values()), words.symbols_of(places).astype(np.int32).tobytes())
                for c, v in zip(columns, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    long, double = T.LongType(), T.DoubleType()
    types = [long, rows.schema["own"].dataType, long, long, double, long, T.ArrayType(T.BinaryType()), T.ArrayType(long), T.BinaryType()]
    return rows.mapInArrow(encode, T.StructType([T.StructField(n, t) for n, t in zip(names, types)]))


def model_scores(rows: DataFrame, model: recurrent.Model) -> DataFrame:
    """rows with log10, the model's own part of a score, in place of symbols."""
    flat, tree, others = model.flat(), model.tree, [c for c in rows.columns if c not in ("symbols", "rare", "times")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = recurrent.Model.of(flat, tree)
        for batch in sliced(batches, len(others), SCORE_BYTES):
            found = recurrent.log_probabilities(own, [np.frombuffer(s.as_buffer(), np.int32) for s in batch.column(len(others))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found / math.log(10))], names=[*others, "log10"])

    fields = [rows.schema[c] for c in others]
    return rows.select(*others, "symbols").mapInArrow(score, T.StructType([*fields, T.StructField("log10", T.DoubleType())]))


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row; rows that are not held out are learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    counts = durable(word_counts(rows.where(~F.col("held_out")).select("text")))
    words = vocabulary(counts)
    place = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 20)) / F.lit(float(1 << 20))
    own = F.struct(F.col(id_col).alias("id"), "held_out", place.alias("place"))
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), own.alias("own"), "text")
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    encoded(numbered, words).write.parquet(folder)
    parts = spark.read.parquet(folder)
    model = trained(parts.where(~F.col("own.held_out")).select("symbols", "own.place"), words, seed)
    kept = durable(model_scores(parts, model))
    rare = parts.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))))
    # A word that isn't listed is rare in training; one that is hot among held-out rows is left to the runtime's skew join.
    met = rare.join(counts, "word")  # a word without a count adds nothing
    sums = durable(met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_sum"), F.sum("times").alias("rare_known")))
    remove_folder(spark, folder)
    out = kept.join(sums, "row", "left")
    extra = F.coalesce("rare_sum", F.lit(0.0))
    size = F.lit(math.log10(words.total + words.distinct + 1))
    return out.select(
        F.col("own.id").alias(id_col), "own.held_out", "n_tokens", (F.col("listed") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * size).alias("base_score"), (F.col("log10") + extra - F.col("n_rare") * F.lit(words.rare_size)).alias("score"),
    )
