"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A document is toxic unless all of its sentences are harmless: P = 1 - (1 - leak) * prod(1 - p_s), p_s = sigmoid(BIAS + sum
of the weights of the sentence's features). Features are words and their beginnings of 3 to 8 letters, hashed; only those that
LEAST_DOCS documents or more hold, toxic ones more often, by a likelihood ratio whose signed root is at least LEAST_Z, get a weight, and
holding any of them has a weight of its own, so that a sentence without them is all but certain to be harmless. Training
maximises the likelihood of document labels with an elastic net, on at most PER_CLASS labelled documents of each class
(an expected bound, drawn by a hash of the row and weighed by the inverse rate, so that priors stay those of all rows).
Every text is scored whole. ``locate`` names the offending sentences.

Defined results: null and empty texts have no sentence and score the leak; unlabelled rows and labels other than 0 and
1 teach nothing; several labels of a document all count; repeated rows are scored each. Without labelled rows of both
classes every score is the share of toxic ones (0.0 if there are none). An empty table gives an empty result. Only doc_id, text and
the labels are read, so other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, join_small, keep, memory

HELD_OUT = (5, 0)
PER_CLASS = 4_000
SPACE_BITS, STARTS, LEAST_DOCS, LEAST_Z, MOST_Z = 24, range(3, 9), 3, 3.5, 16.0
ANY = -1  #: the feature of every sentence that holds one with a weight
#: A sentence without features has log odds BIAS, so that length alone makes no text toxic; LEAK stands for labels without cause.
L1, L2, STEPS, BIAS, LEAK = 0.02, 1e-4, 300, -13.0, 0.01
REMEMBERED = 400_000
_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]+")


def sentences(text: str | None) -> list[str]:
    """Parts between sentence ends and line ends that hold a letter."""
    return [s for s in _SENTENCE.split(text or "") if _WORD.search(s)]


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and its beginnings."""
    mask = (1 << SPACE_BITS) - 1
    return [zlib.crc32(word.encode()) & mask, *(zlib.crc32(f"{word[:n]}*".encode()) & mask for n in STARTS if n <= len(word))]


class Model(NamedTuple):
    weights: dict[int, float]
    bias: float
    leak: float


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.memory: dict[str, tuple[int, ...]] = {}
        self.silent = float(np.logaddexp(0, model.bias))  # -log(1 - p) of a sentence without features

    def _hits(self, word: str) -> tuple[int, ...]:
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            found = self.memory[word] = tuple(f for f in word_features(word) if f in self.model.weights)
        return found

    def sentence(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self._log_odds({f for w in _WORD.findall(text.lower()) for f in self._hits(w)}), -700, 700))))

    def _log_odds(self, found: set[int]) -> float:
        return self.model.bias + (sum(self.model.weights[f] for f in sorted(found)) + self.model.weights.get(ANY, 0.0) if found else 0.0)

    def document(self, text: str | None) -> float:
        low = (text or "").lower()
        known, hits = self.memory.get, self._hits
        risky = {w for w in set(_WORD.findall(low)) if (known(w) or hits(w))}
        parts = sentences(low)
        harmless = -np.log1p(-self.model.leak)
        if not risky:
            return float(-np.expm1(-(harmless + len(parts) * self.silent)))
        for s in parts:
            found = {f for w in _WORD.findall(s) if w in risky for f in known(w) or hits(w)}
            harmless += np.logaddexp(0, self._log_odds(found)) if found else self.silent
        return float(-np.expm1(-harmless))


def _sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """The training sample (label, kinds: distinct features, features and sizes: those of each sentence), and each class's sampling rate.

    First ids are drawn, then, where ids repeat so much that the documents are more than twice as many as expected, documents.
    """
    wanted = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", HELD_OUT[0]) != HELD_OUT[1])).select("doc_id", F.col("toxic").cast("int").alias("label"))
    wanted = keep(wanted.where("doc_id is not null").groupBy("doc_id", "label").agg(F.count("*").alias("times")), "toxic-labels")
    n = {r["label"]: r["n"] for r in wanted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = {c: min(1.0, PER_CLASS / k) for c, k in n.items()}
    cut = F.when(F.col("label") == 1, int(rate.get(1, 1) * 2**31)).otherwise(int(rate.get(0, 1) * 2**31))
    drawn = keep(wanted.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(2**31)) < cut), "toxic-drawn")  # 2 * PER_CLASS expected rows
    rows = join_small(docs.select("doc_id"), drawn, ["doc_id"], "inner").agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    share = min(1.0, 4 * PER_CLASS / max(rows, 1))
    rate = {c: r * share for c, r in rate.items()}

    def read(batches):
        for b in batches:
            for label, text in zip(b.column(0), b.column(1)):
                own = [sorted({f for w in set(_WORD.findall(s)) for f in word_features(w)}) for s in sentences((text.as_py() or "").lower())]
                flat = np.array([f for s in own for f in s], "<i4")
                yield pa.RecordBatch.from_arrays([pa.array([label.as_py()], pa.int32()), pa.array([np.unique(flat)], pa.list_(pa.int32())), pa.array([flat.tobytes()], pa.binary()), pa.array([np.array([len(s) for s in own], "<i4").tobytes()], pa.binary())], names=["label", "kinds", "features", "sizes"])

    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("number"))
    copies = F.sequence(F.lit(1), F.col("times").cast("int"))  # labels that a document repeats
    if share < 1:
        copies = F.filter(copies, lambda c: F.pmod(F.xxhash64("number", c), F.lit(2**31)) < int(share * 2**31))
    texts = join_small(numbered, drawn, ["doc_id"], "inner").withColumn("copy", F.explode(copies))
    texts = texts.select("label", "text")
    return keep(texts.mapInArrow(read, "label int, kinds array<int>, features binary, sizes binary"), "toxic-sample"), rate


def _telling(sample: DataFrame) -> dict[int, float]:
    """Feature to signed root of its likelihood ratio by document counts, where at least LEAST_Z in at least LEAST_DOCS documents."""
    total = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("a"), F.count("*").alias("n")).first()
    a, b = float(total["a"]), float(total["n"] - total["a"])
    counted = sample.select("label", F.explode("kinds").alias("f")).groupBy("f").agg(F.sum("label").cast("double").alias("t"), (F.count("*") - F.sum("label")).cast("double").alias("c"))
    t, c, n = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = part(t, n * (a / (a + b))) + part(c, n * (b / (a + b))) + part(a - t, (a + b - n) * (a / (a + b))) + part(b - c, (a + b - n) * (b / (a + b))) if a and b else F.lit(0.0)
    chosen = counted.where((n >= LEAST_DOCS) & (t * b > c * a)).select("f", F.sqrt(F.greatest(2 * ratio, F.lit(0.0))).alias("z")).where(F.col("z") >= LEAST_Z)
    return {r["f"]: min(r["z"], MOST_Z) for r in chosen.collect()}  # some thousand of the sample's features


def _compact(sample: DataFrame, chosen: np.ndarray) -> pa.Table:
    """label, n: number of sentences, features and sizes of the sentences that hold a chosen one, others left out."""

    def select(batches):
        for b in batches:
            rows = []
            for x, z in zip(b.column(2), b.column(3)):
                f, sizes = np.frombuffer(x.as_py(), "<i4"), np.frombuffer(z.as_py(), "<i4")
                told = np.isin(f, chosen)
                per = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[told], minlength=len(sizes))
                rows.append((len(sizes), f[told].tobytes(), per[per > 0].astype("<i4").tobytes()))
            n, f, sizes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f, pa.binary()), pa.array(sizes, pa.binary())], names=["label", "n", "features", "sizes"])

    return sample.mapInArrow(select, "label int, n long, features binary, sizes binary").toArrow()


def fit(table: pa.Table, rate: dict[int, float], telling: dict[int, float]) -> Model:
    y = table.column("label").to_numpy().astype(float)
    each = np.array([1 / rate[int(c)] for c in y])
    if len(set(y)) < 2:
        return Model({}, float("-inf"), float(min(y.mean() if len(y) else 0.0, 1 - 1e-9)))
    each /= each.sum()
    chosen = np.array(sorted(telling), np.int64)
    none = np.array([], "<i4")
    sizes = [np.frombuffer(x, "<i4") for x in table.column("sizes").to_pylist()]
    spoken = np.array([len(x) for x in sizes])  # sentences that hold a chosen feature
    d = np.repeat(np.arange(len(y)), spoken)
    s = np.repeat(np.arange(len(d)), np.concatenate([*sizes, none]).astype(int))
    f = np.searchsorted(chosen, np.concatenate([*(np.frombuffer(x, "<i4") for x in table.column("features").to_pylist()), none]))
    rest = table.column("n").to_numpy() - spoken
    w = np.append([telling[int(c)] / 2 for c in chosen], -BIAS / 2)  # the last is that of ANY
    squares = np.full(len(w), 1e-8)
    for _ in range(STEPS):
        _, grad = likelihood(w, y, each, d, s, f, rest)
        grad[:-1] -= L2 * w[:-1] / 100
        squares += grad**2
        step = 0.5 / np.sqrt(squares)
        w = w + step * grad
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step[:-1] * L1 / len(y), 0)
    return Model({int(c): float(x) for c, x in zip([*chosen, ANY], w)}, BIAS, LEAK)


def likelihood(w: np.ndarray, y: np.ndarray, each: np.ndarray, d: np.ndarray, s: np.ndarray, f: np.ndarray, rest: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of labels y, of rows that count ``each``, under noisy-or, and its gradient. d: documents of the sentences that hold features; s, f:
    sentences and features of all occurrences; rest: other sentences of each document; the last weight is that of holding any."""
    z = BIAS + w[-1] + np.bincount(s, weights=w[f], minlength=len(d))
    harmless = np.bincount(d, weights=np.logaddexp(0, z), minlength=len(y)) + rest * np.logaddexp(0, BIAS) - np.log1p(-LEAK)
    value = float((each * np.where(y == 1, np.log(-np.expm1(-np.clip(harmless, 1e-9, 700))), -harmless)).sum())
    # d log P(y) / d harmless: 1 / (e^h - 1) for toxic documents, -1 for the others
    slope = each * np.where(y == 1, 1 / np.expm1(np.clip(harmless, 1e-9, 700)), -1.0)
    of_sentence = slope[d] / (1 + np.exp(-z))
    return value, np.append(np.bincount(f, weights=of_sentence[s], minlength=len(w) - 1), of_sentence.sum())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample, rate = _sampled(docs, labels)
    telling = _telling(sample)
    return fit(_compact(sample, np.array(sorted(telling), np.int32)), rate, telling)


def _scorer(key: str, shared) -> Scorer:
    scorers = memory("toxicity")
    if key not in scorers:
        scorers.clear()
        scorers[key] = Scorer(shared.value)
    return scorers[key]


def classify(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents (doc_id, text); labels (doc_id, toxic) teach."""
    model = train(docs, labels)
    key, shared = f"{hash(tuple(sorted(model.weights.items())))}{model.bias}", docs.sparkSession.sparkContext.broadcast(model)  # some thousand weights

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        scorer = _scorer(key, shared)
        return pa.array([scorer.document(x.as_py()) for x in texts], pa.float64())

    held = (fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out")
    return docs.select("doc_id", held, score("text").alias("score")).withColumn("predicted", (F.col("score") >= at).cast("int"))


def locate(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """doc_id, position, sentence, score of each sentence whose own score is at least ``at``; positions count from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())]))

    @F.arrow_udf(kind)
    def offending(texts: pa.Array) -> pa.Array:
        scorer = Scorer(shared.value)
        rows = [[{"position": i, "sentence": s, "score": p} for i, s in enumerate(sentences(x.as_py())) if (p := scorer.sentence(s)) >= at] for x in texts]
        return pa.array(rows, pa.list_(pa.struct([("position", pa.int32()), ("sentence", pa.string()), ("score", pa.float64())])))

    return docs.select("doc_id", F.explode(offending("text")).alias("x")).select("doc_id", "x.*")
