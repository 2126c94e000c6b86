"""Quality classifier: regularised quadratic discriminant over transformed statistics of each document.

One pass over the texts gives FEATURES (counts and rates, logarithms or logits of them, so that classes are closer to
normal). Class moments are summed over all labelled rows outside the held-out fold: counts, sums and products add up, so
each task sends some hundred numbers. A class covariance is shrunk towards the pooled one and that towards its
diagonal; its Cholesky factor is computed once and cached with the model. A score is the posterior from the difference
of Mahalanobis log densities and log priors; log densities are tempered by TEMPER, as the features depend on each other.

Defined results: null and empty texts have all counts zero and are scored like any other; documents without a label,
or whose label is null, teach nothing; several labels of a document all count; repeated rows are scored each. With no
labelled row every score is 0.5; with one class only, its prior decides. An empty table gives an empty result. Only
doc_id, text and the labels are read, so other columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, keep, memory

HELD_OUT = (4, 2)
CLASS_SHRINK, DIAGONAL_SHRINK, TEMPER = 0.1, 0.1, 0.5
SPACE, SYMBOLS, STOPS = b" \t\n\v\f\r", b"#*$%&|<>{}[]=_^~@/\\", b"!?.,;:\"'()-"
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
FEATURES = ("words", "word_length", "symbols", "stops", "upper", "digits", "distinct", "top_word", "repeated_pairs", "dup_lines", "line_words", "long_words")


def _logit(hits: int, total: int) -> float:
    return float(np.log((hits + 0.5) / (total - hits + 0.5))) if total >= hits else float(np.log(hits + 0.5) - np.log(0.5))


def features(data: bytes | None) -> tuple[float, ...]:
    """FEATURES of one text in UTF-8. Rates are logits over the whole text."""
    data = data or b""
    words = data.split()
    n, solid = len(words), data.translate(None, SPACE)
    size = len(solid)
    without = lambda chars: size - len(solid.translate(None, chars))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    top = counts.most_common(1)[0][1] if n else 0
    repeated = max(n - 1, 0) - len(pairs)
    long = sum([1 for w in words if len(w) > 24])
    return (
        float(np.log1p(n)),
        float(np.log1p(size / n)) if n else 0.0,
        _logit(without(SYMBOLS), size),
        _logit(without(STOPS), size),
        _logit(without(UPPER), size),
        _logit(without(DIGITS), size),
        _logit(len(counts), n),
        _logit(top, n),
        _logit(repeated, max(n - 1, 0)),
        _logit(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / len(lines))) if lines else 0.0,
        _logit(long, n),
    )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_features(texts: pa.Array) -> pa.Array:
    memory("quality classifier")
    return pa.array([features(t.as_py()) for t in texts.cast(pa.large_binary())], pa.list_(pa.float64()))


class Model(NamedTuple):
    """Per class: log prior, mean, lower Cholesky factor of the covariance, its log determinant."""

    log_prior: list[float]
    mean: np.ndarray
    factor: np.ndarray
    log_det: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        side = []
        for c in (0, 1):
            z = np.linalg.solve(self.factor[c], (x - self.mean[c]).T)
            side.append(self.log_prior[c] - TEMPER * 0.5 * (self.log_det[c] + (z * z).sum(axis=0)))
        return side[1] - side[0]


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Class to (rows, sum, sum of products), of rows (label, x); each task sends one row for each class."""
    d = len(FEATURES)

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            y, x = np.array(b.column(0)), np.array(b.column(1).flatten()).reshape(-1, d)
            for c in (0, 1):
                mine = np.column_stack([np.ones((y == c).sum()), x[y == c]])
                total[c] = total.get(c, 0) + mine.T @ mine
        for c, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["label", "m"])

    parts = labelled.mapInArrow(partial, "label int, m array<double>")
    summed = parts.select("label", F.posexplode("m").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()  # 2 * (d + 1)^2 rows
    out: dict[int, np.ndarray] = {}
    for r in summed:
        out.setdefault(r["label"], np.zeros((d + 1) ** 2))[r["at"]] = r["v"]
    full = {c: m.reshape(d + 1, d + 1) for c, m in out.items()}
    return {c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in full.items() if m[0, 0] > 0}


def fit(found: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model | None:
    """None without labelled rows."""
    if not found:
        return None
    d, n = len(FEATURES), sum(m[0] for m in found.values())
    mean = {c: s / k for c, (k, s, _) in found.items()}
    scatter = {c: p - k * np.outer(mean[c], mean[c]) for c, (k, _, p) in found.items()}
    pooled = sum(scatter.values()) / n
    pooled = (1 - DIAGONAL_SHRINK) * pooled + DIAGONAL_SHRINK * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
    whole = sum(s for _, s, _ in found.values()) / n
    means, factors, dets = [], [], []
    for c in (0, 1):
        k = found[c][0] if c in found else 0.0
        share = CLASS_SHRINK + (1 - CLASS_SHRINK) * d / (d + k)  # small classes lean on the pooled covariance
        cov = (1 - share) * (scatter[c] / k if k else 0.0) + share * pooled
        cov = (1 - DIAGONAL_SHRINK) * cov + DIAGONAL_SHRINK * np.diag(np.diag(cov)) + 1e-3 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean.get(c, whole))
        factors.append(factor)
        dets.append(float(2 * np.log(np.diag(factor)).sum()))
    prior = [float(np.log(((found[c][0] if c in found else 0.0) + 0.5) / (n + 1))) for c in (0, 1)]
    return Model(prior, np.array(means), np.array(factors), dets)


def classify(docs: DataFrame, labels: DataFrame, at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents (doc_id, text); labels (doc_id, quality) teach."""
    held = (fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out")
    read = keep(docs.select("doc_id", held, text_features("text").alias("x")), "quality-features")
    wanted = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(moments(read.where(~F.col("held_out")).join(wanted, "doc_id").select("label", "x")))
    score = F.lit(0.5) if model is None else _scorer(model)("x")
    return read.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= at).cast("int"))


def _scorer(model: Model):
    @F.arrow_udf(T.DoubleType())
    def posterior(xs: pa.Array) -> pa.Array:
        x = np.array(xs.flatten()).reshape(-1, len(FEATURES))
        return pa.array(1 / (1 + np.exp(-np.clip(model.log_odds(x), -700, 700))))

    return posterior
