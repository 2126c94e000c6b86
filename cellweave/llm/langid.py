"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-case letters with a space for any run of other characters; n-grams of 1 to 3 letters are hashed to 2**BITS
features. Document frequencies are counted over all labelled texts outside the held-out fold (each task sends one vector of fixed size). The
regression is trained by follow-the-regularised-leader with an elastic net, which leaves most weights at zero, on at
most PER_LANGUAGE labelled texts of each language and MOST_ROWS in all (an expected bound, drawn by a hash of the id, and where ids repeat so much that it
is passed twice over, by row). A fifth of these is kept back to find the temperature that calibrates probabilities. The
MOST_LANGUAGES labels with most texts are classes, so that a model has a bounded size; texts of others teach document frequencies only.
Every text is judged whole.

Defined results: null texts and texts without a letter are 'und' with score 0.0, as is everything if nothing can be
learned; labels are learned as they stand, one class for each; ties go to the first language by code point; repeated
rows are judged each; an empty table gives an empty result. Other columns do not matter, and ``keep_languages`` carries
them along.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, memory, packed, prepare

HELD_OUT = (4, 2)
BITS, ORDERS = 15, (1, 2, 3)
PER_LANGUAGE, MOST_ROWS, MOST_LANGUAGES, PASSES = 1_000, 16_000, 128, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 0.1
UNKNOWN = "und"
_DIM = 1 << BITS
_CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to lower-case letter, or to 32."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def counts(text: str | None) -> np.ndarray | None:
    """Occurrences of each feature; None without a letter. Long texts are taken in chunks that overlap by two letters."""
    if not text:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    total, tail, any_letter = np.zeros(_DIM, np.int64), np.array([32], np.uint32), False
    longest = max(ORDERS)
    for at in range(0, len(points), _CHUNK):
        chunk = _letters()[points[at : at + _CHUNK]]
        any_letter |= bool((chunk != 32).any())
        last = at + _CHUNK >= len(points)
        chars = np.concatenate([tail, chunk, np.array([32], np.uint32)] if last else [tail, chunk])
        gap = chars == 32
        solid = np.concatenate([[True], ~(gap[1:] & gap[:-1])])  # one space for a run
        solid[: len(tail)] = True
        chars = chars[solid].astype(np.uint64)
        fresh = len(tail) - (at == 0)  # letters seen in the chunk before
        for n in ORDERS:
            if len(chars) < n:
                continue
            h = np.full(len(chars) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ chars[k : len(chars) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            h = h[max(0, fresh - n + 1) :]
            total += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=_DIM)
        tail = chars[-(longest - 1) :].astype(np.uint32)
    return total if any_letter else None


class Model(NamedTuple):
    """Languages, inverse document frequencies, weights (features x languages), intercepts, temperature: 2**BITS rows, so of bounded size."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text) if self.languages else None
        if n is None:
            return UNKNOWN, 0.0
        at, x = _tf_idf(n, self.idf)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return self.languages[int(z.argmax())], float(p.max() / p.sum())


def _tf_idf(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = n.nonzero()[0]
    x = np.log1p(n[at]) * idf[at]
    return at, x / np.sqrt((x * x).sum())


def _document_frequencies(texts: DataFrame) -> np.ndarray:
    """Texts holding each feature, and last the number of texts."""

    def partial(batches):
        memory("language")
        total = np.zeros(_DIM + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                n = counts(t.as_py())
                if n is not None:
                    total[:-1] += n > 0
                    total[-1] += 1
        if total[-1]:
            at = total.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(_DIM + 1)
    for r in texts.mapInArrow(partial, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 2**BITS + 1 rows at most
        out[r["at"]] = r["n"]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts from rows (features, values, class), by FTRL-proximal with elastic net; intercepts are not penalised."""
    z, n = np.zeros((_DIM + 1, classes)), np.zeros((_DIM + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0.0
        w[at == _DIM] = -z[_DIM] / ((BETA + np.sqrt(n[_DIM])) / ALPHA)
        return w

    for k in range(PASSES):
        for i in np.random.default_rng(k).permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, _DIM), np.append(x, 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[y] -= 1
            g = np.outer(x, error)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(_DIM + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame) -> Model:
    """From documents (doc_id, text, lang) whose lang is not null, outside the held-out fold."""
    prepare(docs.sparkSession)
    taught = docs.where(F.col("lang").isNotNull() & (fold("doc_id", HELD_OUT[0]) != HELD_OUT[1])).select("doc_id", "lang", "text")
    spoken = taught.where("text is not null").groupBy("lang").count()
    n = {r["lang"]: r["count"] for r in spoken.orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(n)
    found = _document_frequencies(taught.select("text"))
    idf = np.log((1 + found[-1]) / (1 + found[:-1])) + 1
    if not languages:
        return Model([], idf, np.zeros((_DIM, 0)), np.zeros(0), 1.0)
    each = min(PER_LANGUAGE, MOST_ROWS // len(languages))
    rate = F.create_map(*[F.lit(x) for c in languages for x in (c, int(min(1.0, each / n[c]) * 2**31))])[F.col("lang")]  # MOST_LANGUAGES entries
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(2**31))
    drawn = taught.withColumn("draw", draw).where(F.col("lang").isin(languages) & (F.col("draw") < rate) & F.col("text").isNotNull())
    share = min(1.0, 2 * each * len(languages) / max(drawn.count(), 1))
    if share < 1:
        drawn = drawn.withColumn("draw", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**31))).where(F.col("draw") < int(share * 2**31))

    def read(batches):
        for b in batches:
            found = []
            for y, d, t in zip(*b.columns):
                if (c := counts(t.as_py())) is not None:
                    at = c.nonzero()[0]
                    found.append((y.as_py(), d.as_py(), at.astype("<u2" if BITS <= 16 else "<u4").tobytes(), c[at].astype("<i4").tobytes()))
            columns = list(zip(*found)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "draw", "at", "n"])

    sample = drawn.select("lang", "draw", "text").mapInArrow(read, "lang string, draw long, at binary, n binary")
    rows = []
    for r in sample.orderBy("draw", "lang", F.sha2("n", 256)).toArrow().to_pylist():  # PER_LANGUAGE expected rows a language, of 2**BITS features at most
        full = np.zeros(_DIM, np.int64)
        full[np.frombuffer(r["at"], "<u2" if BITS <= 16 else "<u4")] = np.frombuffer(r["n"], "<i4")
        rows.append((*_tf_idf(full, idf), languages.index(r["lang"])))
    learn, calibrate = [x for i, x in enumerate(rows) if i % 5], rows[::5]
    if not learn:
        learn = rows
    weights, bias = ftrl(learn, len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in calibrate]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias, _temperature(logits, np.array([y for _, _, y in calibrate])) if len(calibrate) else 1.0)


def _predictor(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of some languages: a few MB

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predicted(texts: pa.Array) -> pa.Array:
        memory("language")
        rows = [shared.value.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["lang", "score"])

    return predicted


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents (doc_id, text, lang)."""
    predicted = _predictor(docs, train(docs))
    held = (fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out")
    return docs.select("doc_id", held, predicted("text").alias("x")).select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


def keep_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is recognised with a probability of at least ``least``; columns as they are."""
    predicted = _predictor(docs, train(docs))
    judged = packed(docs).select("packed", predicted("packed.text").alias("x"))
    return judged.where((F.col("x.lang") != UNKNOWN) & (F.col("x.score") >= least)).select("packed.*")
