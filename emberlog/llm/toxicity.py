"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence is toxic with probability ``p = sigmoid(b + sum of its words' weights)``; a
document is toxic unless none of its sentences is: ``1 - prod(1 - p)`` (noisy-or).  The
weights are fitted to document labels only, and then point to the sentences that made a
document toxic.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, slices

#: Bounds of the labelled sample: rows of each label, and characters of a row.
SAMPLE_ROWS, ROW_CHARS = 2_500, 20_000
#: A word has a weight if so many sampled documents have it; at most so many words have one.
WORD_DOCUMENTS, VOCABULARY = 8, 50_000
#: Standard errors by which its share of toxic documents must exceed that of others.
LIFT = 5.0
#: Lengths of the beginnings of words that have weights too.
BEGINNINGS = (4, 5, 6)
EPOCHS, RATE, DECAY = 200, 0.1, 1e-5
CACHE_WORDS, CACHE_CHARS = 300_000, 64

_ends = re.compile(r"(?<=[.!?。！？])\s+|\n+").split
letters = re.compile(r"[^\W_]+").findall


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sentences(text: str | None) -> list[str]:
    return [s for s in _ends(text or "") if s and not s.isspace()]


def parts(word: str) -> list[str]:
    """What of a word has weights: the word and its beginnings, marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> tuple[float, dict[str, float]]:
    """Bias and word weights that make the weighted noisy-or likelihood large (Adam, all rows a step)."""
    bags = [[set(letters(s.lower())) for s in sentences(t)] for t in texts]
    counts: dict[str, list[int]] = {}
    for bag, y in zip(bags, toxic.tolist(), strict=True):
        for f in {f for w in set().union(*bag) for f in parts(w)} if bag else ():
            counts.setdefault(f, [0, 0])[y] += 1
    # only what toxic documents have clearly more often can mark a sentence
    many = {1: max(1, int(toxic.sum())), 0: max(1, int((1 - toxic).sum()))}

    def lift(c: list[int]) -> float:
        both = (c[0] + c[1]) / (many[0] + many[1])
        return (c[1] / many[1] - c[0] / many[0]) / math.sqrt(max(both * (1 - both), 1e-12) * (1 / many[1] + 1 / many[0]))

    lifts = {f: lift(c) for f, c in counts.items() if sum(c) >= WORD_DOCUMENTS}
    ranked = sorted((f for f, z in lifts.items() if z >= LIFT), key=lambda f: (-lifts[f], f))[:VOCABULARY]
    index = {w: i for i, w in enumerate(ranked)}
    owner, item, row = [], [], []
    for d, bag in enumerate(bags):
        for words in bag:
            found = [index[f] for w in words for f in parts(w) if f in index]
            item += found
            owner += [len(row)] * len(found)
            row.append(d)
    owner, item, row = np.array(owner, np.int64), np.array(item, np.int64), np.array(row, np.int64)
    n, d = len(row), len(texts)
    has = np.bincount(row, minlength=d) > 0
    weight = np.where(has, weight, 0.0) / max(weight[has].sum(), 1e-9) if has.any() else weight
    w, b = np.zeros(len(index)), -5.0
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(owner, w[item], n) + b
        soft = np.logaddexp(0, z)
        total = np.bincount(row, soft, d)
        none = np.exp(-total)
        pull = np.where(toxic == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * weight
        g = np.exp(z - soft) * pull[row]
        grad = np.append(np.bincount(item, g[owner], len(index)) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return float(b), {x: float(w[i]) for x, i in index.items() if abs(w[i]) > 1e-3}


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[float, dict[str, float]]:
    """Fit on a bounded sample of labelled rows that are not held out; only the sample moves to one task.

    Of each label about SAMPLE_ROWS rows with the smallest hashes of the key are taken and
    weighed back to their number.  Null keys, labels other than 0 and 1 and labelled rows
    without a document are left out; a row that is labelled twice alike counts once, one
    with both labels as a row of each; of documents that repeat a key one counts.  Without rows of both labels nothing is toxic.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).filter(F.col("key").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("key"))).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return -20.0, {}
    rates = {k: min(1.0, SAMPLE_ROWS / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.lit(4), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.withColumn("rate", F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])).filter(draw < F.col("rate"))
    # the sample's size is bounded, so it can be sent to the documents
    texts = docs.select(F.col(key).alias("key"), F.substring(text, 1, ROW_CHARS).alias("text"))
    # rows that repeat a key have one draw, so one text of a key is taken
    sample = texts.join(F.broadcast(chosen), "key").groupBy("key", "toxic", "rate").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        t = pa.Table.from_batches(batches, schema=None) if (batches := list(batches)) else None
        if t is None:
            return
        t = t.sort_by([("key", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
        b, words = train([x or "" for x in t["text"].to_pylist()], t["toxic"].to_numpy(), 1 / t["rate"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([list(words)], pa.list_(pa.string())), pa.array([list(words.values())], pa.list_(pa.float64()))], names=["b", "words", "weights"])

    got = sample.repartition(1).mapInArrow(run, "b double, words array<string>, weights array<double>").collect()
    if not got:
        return -20.0, {}
    return got[0]["b"], dict(zip(got[0]["words"], got[0]["weights"], strict=True))


class Scorer:
    """Sentence scores, with the weights of recent words at hand."""

    def __init__(self, model: tuple[float, dict[str, float]]):
        self.bias, self.weights = model
        self.known: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        get = self.weights.get
        w = sum(get(p, 0.0) for p in parts(word))
        if len(word) <= CACHE_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = w
        return w

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """Document score and (sentence, probability) of those more likely toxic than not."""
        get, total, worst = self.known.get, 0.0, []
        for i, s in enumerate(sentences(text)):
            z = self.bias
            for word in sorted(set(letters(s.lower()))):  # in order: sums of doubles depend on it
                w = get(word)
                z += self._weight(word) if w is None else w
            soft = z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
            total += soft
            if z >= 0:
                worst.append((i, 1 - math.exp(-soft)))
        return 1 - math.exp(-total), worst


def score(spark: SparkSession, docs: DataFrame, model: tuple[float, dict[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text: key, score (0 to 1), predicted (score >= 0.5) and offending.

    ``offending`` lists the sentences (index, probability) of probability 0.5 or more.  A
    null or empty text has no sentence and scores 0.  Rows stay where they are; repeated
    rows each give a row; other columns are not read.
    """
    shared = spark.sparkContext.broadcast(model)  # at most VOCABULARY weights
    ident = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") else id(shared)
    kind = pa.list_(pa.struct([("sentence", pa.int32()), ("probability", pa.float64())]))

    def run(batches):
        scorer = held(("toxicity", ident), lambda: Scorer(shared.value))
        for batch in slices(batches, text, tables=True):
            found = [scorer.score(t) for t in batch.column(1).to_pylist()]
            worst = [[{"sentence": i, "probability": p} for i, p in w] for _, w in found]
            points = np.array([s for s, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points), pa.array((points >= 0.5).astype(np.int32)), pa.array(worst, kind)], names=[key, "score", "predicted", "offending"])

    offending = T.ArrayType(T.StructType([T.StructField("sentence", T.IntegerType()), T.StructField("probability", T.DoubleType())]))
    fields = [docs.schema[key], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", offending)]
    return docs.select(key, text).mapInArrow(run, T.StructType(fields))
