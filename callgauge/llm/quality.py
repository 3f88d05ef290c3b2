"""Quality by a regularised quadratic discriminant over transformed statistics of a text.

The statistics of every document are a table; sums over its labelled rows give each class's mean and covariance (all
labelled rows of the learning folds, no sample), which are shrunk towards the pooled covariance and its
diagonal. A score is the posterior probability of label 1, from the difference of the Mahalanobis log densities by
the factors cached once a fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.common import small, text_of, written

SHRINK = 0.2  #: weight of the pooled covariance in a class's
RIDGE = 0.05  #: weight of the diagonal in both, after scaling to unit variances
MARKS = b"#$%&*@^~<>{}\\="


def statistics(text: str) -> list[float]:
    """Logarithms of lengths and rates, so that classes are nearer to normal. All are finite for any text."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    n, size = len(words), len(data)
    solid = size - int(counts[9:14].sum() + counts[32])
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    rate = lambda k, of: math.log((k + 0.5) / (of + 10.0))
    kept = [x for x in lines if x.strip()]
    return [
        math.log1p(n),
        math.log((solid + 1) / (n + 1)),
        rate(upper, upper + lower),
        rate(digits, solid),
        rate(sum(int(counts[b]) for b in MARKS), solid),
        rate(int(counts[33]), solid),
        rate(int(counts[124]), solid),
        rate(int(counts[44] + counts[46]), n),
        rate(len(set(words)), n),
        rate(len(kept) - len(set(kept)), len(kept)),
        rate(int(counts[10]), n),
        rate(int(counts[128:].sum()), solid),
    ]


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, x: the statistics of each row's whole text."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["_id", "x"])

    return written(rows.mapInArrow(run, T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])), "quality-statistics")


@dataclass(frozen=True)
class Discriminant:
    """``white``: of each class the inverse of its covariance's Cholesky factor; ``level``: the rest of its log density and the prior's."""

    mean: np.ndarray
    white: np.ndarray
    level: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [self.level[c] - 0.5 * (((x - self.mean[c]) @ self.white[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """``labelled``: x and y (0 or 1). If a class has no more rows than dimensions, the score is the smoothed share of 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.array(batch.column("y").to_pylist())
            x = np.array(batch.column("x").to_pylist(), np.float64)
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            for c in np.unique(y):
                held[int(c)] = held.get(int(c), 0) + x[y == c].T @ x[y == c]
        for c, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], ["y", "k", "v"])

    sums = labelled.select("x", "y").mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()  # two classes by a square matrix
    width = math.isqrt(max([len(sums) // max(1, len({r["y"] for r in sums})), 1]))
    moments = np.zeros((2, width * width))
    for r in sums:
        moments[r["y"], r["k"]] = r["v"]
    moments = moments.reshape(2, width, width)
    n = moments[:, 0, 0]
    if min(n) < width + 1:
        none = np.zeros(0)
        return Discriminant(none, none, none, float((n[1] + 1) / (n.sum() + 2)))
    mean = moments[:, 0, 1:] / n[:, None]
    own = moments[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (own * n[:, None, None]).sum(0) / n.sum()
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    white, level = [], []
    for c in (0, 1):
        cov = ((1 - shrink) * own[c] + shrink * pooled) / unit[:, None] / unit[None, :]
        cov = (1 - ridge) * cov + ridge * np.eye(len(unit))
        factor = np.linalg.cholesky(cov)
        white.append(np.linalg.inv(factor) / unit[None, :])
        level.append(math.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(mean, np.array(white), np.array(level))


def held_out(id_col: str):
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row a row of ``docs``: id, held_out, score (0 to 1), predicted (1 from ``least`` on).

    Learns from labels of 0 or 1 (others and nulls are passed over) of ids whose crc32 modulo 5 is not 0; a label row
    counts once for each row of its id. Null text: empty, scored like any. A null id has no label and is
    held out. Without enough labels the score is constant. Empty table: no rows. Other columns are no input.
    """
    told = statistics_table(docs, id_col, text_col)
    marks = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_l"), F.col(label_col).cast("int").alias("y")).filter(~held_out("_l") & F.col("_l").isNotNull())
    model = fit(told.join(marks, F.col("_id") == F.col("_l")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["_id", "score"])

    kind = T.StructType([T.StructField("_id", told.schema["_id"].dataType), T.StructField("score", T.DoubleType())])
    scored = told.mapInArrow(run, kind)
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns. An id that repeats stays if one of its texts does."""
    told = score_quality(docs, labels, least, id_col, text_col)
    bad = told.groupBy(F.col(id_col).alias("_cg_bad")).agg(F.max("predicted").alias("_cg_best")).filter("_cg_best = 0").select("_cg_bad")
    return docs.join(small(written(bad, "quality-bad"), 64), F.col(id_col).eqNullSafe(F.col("_cg_bad")), "left_anti")
