"""Quality by regularised quadratic discriminant analysis.

Every whole text becomes a vector of transformed statistics.  Each class has a mean
and a covariance shrunk towards its diagonal (by the Ledoit-Wolf style ratio of the
noise to the size of its off-diagonal part) and towards the pooled covariance.  A
score comes from the difference of the two log densities, each a Mahalanobis distance
through a Cholesky factor that is worked out once and kept in the model, passed
through a logistic curve fitted on the training rows.

The moments are sums over all labelled training rows, pre-added in each task; no row
is sampled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from .shared import LOWER, free_name, materialise, run_hashes, text_slices, word_bounds

NAMES = (
    "log_words", "word_length", "upper", "digits", "marks", "symbols", "pipes", "bangs", "lines", "stops",
    "distinct", "next_same", "pair_distinct", "line_distinct", "packed", "high",
)
D = len(NAMES)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


COUNTED = np.stack(
    [
        _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(",;:'\"()-"), _class("#$%&*@^~<>{}[]\\/_=+`"),
        _class("|"), _class("!?"), _class("\n"), _class("."),
    ]
)
LETTERS = np.zeros(256)
LETTERS[[*range(65, 91), *range(97, 123), *range(192, 256)]] = 1


def _sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Number of unlike keys in each row."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    first = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])] if len(r) else np.zeros(0, bool)
    return np.bincount(r[first], minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The vector of each text: counts as logarithms, shares as square roots or logits."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, rows = word_bounds(data, offsets)
    low = LOWER[data]
    words = np.bincount(rows, minlength=n).astype(float)
    hashes = run_hashes(low, starts, ends)
    some_size, some_words = np.maximum(size, 1), np.maximum(words, 1)
    share = [np.sqrt(_sum(c[data], offsets) / some_size) for c in COUNTED]
    letters = np.maximum(_sum(LETTERS[data], offsets), 1)
    upper = np.sqrt(_sum(COUNTED[0][data], offsets) / letters)
    high = np.sqrt(_sum((data >= 128).astype(float), offsets) / some_size)
    same = np.zeros(n)
    pair_share = np.ones(n)
    if len(hashes) > 1:
        together = rows[1:] == rows[:-1]
        same = np.bincount(rows[1:][together & (hashes[1:] == hashes[:-1])], minlength=n) / some_words
        with np.errstate(over="ignore"):
            pairs = hashes[1:] * np.uint64(3) + hashes[:-1]
        pair_share = _distinct(rows[1:][together], pairs[together], n) / np.maximum(words - 1, 1)
    # Distinct words fall off with length, so compare with a power of the number of words.
    distinct = np.log(np.maximum(_distinct(rows, hashes, n), 1)) - 0.9 * np.log(some_words)
    at = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets[:-1], at + 1])).astype(np.int64)
    cuts = cuts[cuts < len(data)]
    stops = np.r_[cuts[1:], len(data)] if len(cuts) else cuts
    line_rows = np.searchsorted(offsets, cuts, "right") - 1
    lines = np.bincount(line_rows, minlength=n).astype(float)
    line_share = _distinct(line_rows, run_hashes(data, cuts, stops), n) / np.maximum(lines, 1)
    view = memoryview(np.ascontiguousarray(data))
    packed = np.array([len(zlib.compress(view[a:b], 1)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], float)
    return np.stack(
        [
            np.log1p(words), np.log((size + 1) / (words + 1)), upper, share[1], share[2], share[3], share[4], share[5], share[6], share[7],
            distinct, np.sqrt(same), pair_share, line_share, np.log((packed + 8) / (size + 64)), high,
        ],
        axis=1,
    )


def with_features(docs: DataFrame, column: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics of every whole text in ``column``; a null text is empty."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(place)):
                flat = pa.FixedSizeListArray.from_arrays(pa.array(statistics(data, offsets).ravel()), D).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, flat], [*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, ArrayType(DoubleType()))]))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(1)):
                x = statistics(data, offsets)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), D).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), flat], ["doc_id", "x"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class QualityModel:
    """Means, Cholesky factors of the precisions, log determinants, and the logistic curve over the log ratio."""

    mean: list[np.ndarray]
    factor: list[np.ndarray]
    log_det: list[float]
    slope: float = 1.0
    shift: float = 0.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, tamed: a text far from both says little."""
        out = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            out.append(0.5 * ((z * z).sum(axis=1) + self.log_det[c]))
        return np.arcsinh((out[0] - out[1]) / 4)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_ratio(x) + self.shift, -40, 40)))


def shrunk(n: list[float], total: list[np.ndarray], outer: list[np.ndarray], pool: float = 0.1) -> QualityModel:
    """Class densities from the number, sum and sum of outer products of each class."""
    mean = [t / max(k, 1) for k, t in zip(n, total, strict=True)]
    cov = [o / max(k, 1) - np.outer(m, m) for k, o, m in zip(n, outer, mean, strict=True)]
    pooled = sum(k * c for k, c in zip(n, cov, strict=True)) / max(1, sum(n))
    factor, log_det = [], []
    for k, c in zip(n, cov, strict=True):
        off = c - np.diag(np.diag(c))
        noise = (np.outer(np.diag(c), np.diag(c)) + c * c).sum() / max(k, 1)
        towards = min(1.0, noise / max((off * off).sum(), 1e-12))
        weight = max(pool, D / (k + D))
        c = (1 - weight) * ((1 - towards) * c + towards * np.diag(np.diag(c))) + weight * pooled
        c += np.diag(np.full(D, 1e-4) + 0.01 * np.diag(pooled))
        low = np.linalg.cholesky(c)
        factor.append(np.linalg.inv(low))
        log_det.append(2 * float(np.log(np.diag(low)).sum()))
    return QualityModel(mean, factor, log_det)


def fit(rows: DataFrame, labels: DataFrame, where: Column, label_col: str = "quality") -> QualityModel:
    """Model from the feature rows (doc_id, x) whose label (0 or 1) passes ``where``; all of them, by sums.

    With a class missing from the labels the model scores every text alike, with the
    share of class 1 (0.5 without any label).
    """
    spark = rows.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(where & F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    labelled = materialise(rows.join(known, "doc_id").select("y", "x"), "quality-rows")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + D + D * D))
        for batch in batches:
            y, x = batch.column(0).to_numpy(), np.asarray(batch.column(1).flatten()).reshape(-1, D)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["y", "s"])

    parts = labelled.mapInArrow(moments, "y int, s array<double>").select("y", F.posexplode("s").alias("i", "v"))
    found = np.zeros((2, 1 + D + D * D))
    for r in parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + D + D * D) rows
        found[r["y"], r["i"]] = r["v"]
    n = [float(k) for k in found[:, 0]]
    if not min(n):
        share = n[1] / sum(n) if sum(n) else 0.5
        flat = QualityModel([np.zeros(D)] * 2, [np.zeros((D, D))] * 2, [0.0, 0.0], 0.0)
        flat.shift = math.log((share + 1e-3) / (1 - share + 1e-3))
        return flat
    model = shrunk(n, list(found[:, 1 : 1 + D]), [s.reshape(D, D) for s in found[:, 1 + D :]])
    shared = spark.sparkContext.broadcast(model)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = shared.value.log_ratio(np.asarray(batch.column(1).flatten()).reshape(-1, D))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(np.rint(r * 20), -400, 400).astype(np.int32))], ["y", "b"])

    # The curve is fitted on a histogram of the ratio, of 801 bins at most.
    bins = labelled.mapInArrow(ratios, "y int, b int").groupBy("b").agg(F.count_if(F.col("y") == 1).alias("good"), F.count(F.lit(1)).alias("n"))
    hist = np.array([(r["b"] / 20, r["good"], r["n"]) for r in bins.collect()], float)
    model.slope, model.shift = _curve(hist)
    return model


def _curve(hist: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (ratio, good, all), by damped Newton steps."""
    r, good, n = hist.T
    w = np.array([1.0, 0.0])
    x = np.c_[r, np.ones(len(r))]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * p - good) + np.array([1e-3 * n.sum() * (w[0] - 1), 0])
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1e-3 * n.sum(), 1e-6])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(1e-3, float(w[0])), float(w[1])


def score(rows: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1; higher: class 1 likelier) and predicted for each feature row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(np.asarray(batch.column(1).flatten()).reshape(-1, D))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double").withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def classify(docs: DataFrame, labels: DataFrame, where: Column, threshold: float = 0.3) -> DataFrame:
    """Score of every document by a model of the labelled rows that pass ``where``.

    Defined cases: a null text is the empty text, which has a score like any other; null
    and repeated ids give a row each (a labelled id that repeats trains with each of its
    rows; of unlike labels of an id the larger counts); other columns are ignored;
    labels other than 0 and 1 are not used; empty tables give an empty result.
    """
    rows = materialise(features(docs), "quality-features")
    return score(rows, fit(rows, labels, where), threshold)


def accepted(docs: DataFrame, labels: DataFrame, where: Column, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose score by ``classify`` reaches the threshold.

    The statistics are written beside the rows, which are then judged where they lie: no
    row is looked up by its id, so null and repeated ids do not matter.  Other cases as
    in ``classify``.
    """
    x, ok = free_name(docs, "quality_x"), free_name(docs, "quality_ok")
    rows = materialise(with_features(docs, x, text_col), "quality-rows")
    model = fit(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(x).alias("x")), labels, where)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = rows.columns.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(np.asarray(batch.column(place).flatten()).reshape(-1, D))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s >= threshold)], [*batch.schema.names, ok])

    judged = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(ok, BooleanType())]))
    return judged.filter(F.col(ok)).select(*docs.columns)
