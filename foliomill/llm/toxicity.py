"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text and one on toxic text.  Of the
toxic one only those bytes stay that lie in substrings (``GRAM`` bytes) which more
training texts of the toxic class hold than chance allows, so that it does not save
bytes on what all texts share.  The whole text is cut into windows of ``WINDOW`` bytes,
each overlapping the next by half, and every window is compressed with the ordinary
dictionary, and with the ordinary and the toxic one together.  (It is written down
twice for that, or zstandard would store it as it is where it saves few bytes.)  The
bytes that the second saves are the window's contrast.  The shares of windows above several
contrasts, the largest contrasts and their mean go through a logistic curve, whose
weights and threshold come from labelled texts that no dictionary has seen.

Nothing is cut into words, so scripts without spaces are read like all others.

Training takes a bounded sample of labelled rows (``TRAIN_DOCS`` of each class, those
with the smallest hash of their id, and of their texts at most ``TRAIN_PIECES`` pieces
of ``PIECE`` bytes for a dictionary); scoring reads every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import fold, materialise

#: Labelled rows of each class that training takes at most.
TRAIN_DOCS = 8_000
#: Pieces of text, and bytes of a piece, that a dictionary is trained on at most.
TRAIN_PIECES, PIECE = 8_000, 4_096
ORDINARY_BYTES, TOXIC_BYTES = 24_000, 64_000
#: Segment and substring length of zstandard's training.
SEGMENT, SUBSTRING = 64, 8
#: zstandard picks few segments if a dictionary is larger than this part of its text.
TEXT_PER_BYTE = 16
LEVEL, SHORTEST_MATCH = 3, 6
WINDOW = 32
#: Bytes of a substring that is tested for its class.
GRAM = 6
#: What a substring must pass to stay: standard errors above chance, times as frequent.
#: Calibration takes the pair that tells its texts apart best.
TESTS = ((4.0, 3.0), (6.0, 30.0))
CONTRASTS = (2, 3, 4, 5, 7)
N_FEATURES = 3 + len(CONTRASTS) + 3
#: A clean text taken for toxic counts as much as this many toxic texts missed.
COST = 4.0


def normalised(text: str | None) -> bytes:
    """Lower case, one space for each run of white space and at both ends; '' without any other character."""
    words = (text or "").lower().split()
    return f" {' '.join(words)} ".encode("utf-8", "replace") if words else b""


def windows(text: bytes) -> list[bytes]:
    """Windows that overlap by half and together cover every byte."""
    step = WINDOW // 2
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - step), step)] if text else []


@dataclass
class ToxicityModel:
    """Both dictionaries, and a logistic score over scaled features whose 0.5 is the calibrated threshold."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        """With the ordinary dictionary, and with both; filled to one length, so that zstandard lays out both alike.

        The last bytes of a dictionary are not indexed, hence the filling after them.
        """
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=SHORTEST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        out = []
        for content in (self.ordinary + b" " * len(self.toxic), self.ordinary + self.toxic):
            data = zstandard.ZstdCompressionDict(content + b" " * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))
        return out[0], out[1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


def untrained(ordinary: bytes, toxic: bytes) -> ToxicityModel:
    return ToxicityModel(ordinary, toxic, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1))


class Contrast:
    """Bytes that the toxic dictionary saves on each window of a text."""

    AT_ONCE = 1 << 14

    def __init__(self, model: ToxicityModel):
        self.plain, self.both = model.compressors()

    def of(self, text: str | None) -> np.ndarray:
        cut, out = windows(normalised(text)), []
        for at in range(0, len(cut), self.AT_ONCE):
            some = [w + w for w in cut[at : at + self.AT_ONCE]]
            sizes = [self._sizes(c, some) for c in (self.plain, self.both)]
            out.append(sizes[0] - sizes[1])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    @staticmethod
    def _sizes(compressor: zstandard.ZstdCompressor, cut: list[bytes]) -> np.ndarray:
        packed = compressor.multi_compress_to_buffer(cut, threads=1)
        return np.fromiter((len(x) for x in packed), np.int64, len(cut))

    def features(self, text: str | None) -> np.ndarray:
        """Largest and third largest contrast, their mean, shares and numbers of windows by contrast, length."""
        c = self.of(text)
        if not len(c):
            return np.zeros(N_FEATURES)
        top = np.sort(c)[::-1]
        shares = [10 * math.sqrt((c >= t).mean()) for t in CONTRASTS]
        hits = [math.log1p((c >= t).sum()) for t in (3, 5)]
        return np.array([top[0], top[min(2, len(c) - 1)], 10 * c.mean(), *shares, *hits, math.log(len(c))], float)


def train_dictionary(pieces: list[bytes], size: int) -> bytes:
    """Dictionary content from samples of text; of fewer samples than zstandard trains on, their own text."""
    total = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // TEXT_PER_BYTE)), pieces, k=SEGMENT, d=SUBSTRING).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def gram_hashes(text: bytes) -> np.ndarray:
    """A number for each substring of ``GRAM`` bytes, by its first byte."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(a) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        out = out * np.uint64(256) + a[i : len(a) - GRAM + 1 + i] if len(out) else out
    return out


def typical_parts(content: bytes, grams: np.ndarray, toxic: np.ndarray, plain: np.ndarray, n_toxic: int, n_plain: int, test: tuple[float, float]) -> bytes:
    """The runs of ``content`` that lie in substrings typical of toxic texts, once each.

    ``grams``: sorted substring numbers, ``toxic`` and ``plain``: texts of each class that hold them.
    """
    n_t, n_p = max(1, n_toxic), max(1, n_plain)
    rate_t, rate_p = toxic / n_t, plain / n_p
    spread = np.sqrt((toxic + plain) / (n_t + n_p) * (1 / n_t + 1 / n_p)) + 1e-12
    good = ((rate_t - rate_p) / spread > test[0]) & (rate_t > test[1] * rate_p) & (toxic >= 3)
    own = gram_hashes(content)
    if not len(own) or not len(grams):
        return b""
    at = np.flatnonzero(good[np.searchsorted(grams, own)])
    keep = np.zeros(len(content) + 2, bool)
    for i in range(GRAM):
        keep[at + i + 1] = True
    edges = np.flatnonzero(keep[1:] != keep[:-1])
    # A byte that no text of UTF-8 holds keeps the runs apart.
    return b"\xff".join(dict.fromkeys(content[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) by damped Newton steps; the ridge is on all but the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w[-1] = math.log(y.mean() / (1 - y.mean()))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        step = np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, grad), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrate(model: ToxicityModel, x: np.ndarray, y: np.ndarray) -> float:
    """Sets the score of ``model`` from features and labels; returns how well it tells them apart (1 at best).

    The threshold is the one with the largest share of toxic texts found less ``COST``
    times that of clean texts taken for toxic, midway to the next score below.
    """
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = fit_logistic((x - model.mean) / model.scale, y)
    z = model.logit(x)
    order = np.argsort(-z)
    found, wrong = np.cumsum(y[order]) / y.sum(), np.cumsum(1 - y[order]) / (1 - y).sum()
    gain = found - COST * wrong
    gain[:-1][z[order][1:] == z[order][:-1]] = -np.inf  # equal scores fall on one side
    best = int(gain.argmax())
    below = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    model.weights[-1] -= (z[order][best] + below) / 2
    return float(gain[best])


def sample_ids(labels: DataFrame, label: Column, per_class: int, where: Column) -> DataFrame:
    """(doc_id, y) of at most ``per_class`` rows of each class, those with the smallest hash of their id."""
    rows = labels.select("doc_id", label.cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & where)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].union(parts[1])


def _pieces(texts: DataFrame) -> list[bytes]:
    """At most ``TRAIN_PIECES`` pieces of the texts, those with the smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                whole = normalised(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([whole[i : i + PIECE] for i in range(0, len(whole), PIECE)], pa.binary())], ["piece"])

    cut = texts.select("text").mapInArrow(run, "piece binary")
    return [bytes(r[0]) for r in cut.orderBy(F.xxhash64("piece"), "piece").limit(TRAIN_PIECES).collect()]


def _holders(texts: DataFrame, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many toxic and how many ordinary texts (text, y) hold each of the sorted ``grams``."""
    shared = texts.sparkSession.sparkContext.broadcast(grams)  # TOXIC_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros((2, len(known)), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = np.unique(gram_hashes(normalised(text.as_py())))
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                counts[y, at[known[at] == own]] += 1
        some = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])], ["i", "t", "p"])

    found = np.zeros((2, len(grams)))
    if len(grams):
        rows = texts.select("text", "y").mapInArrow(run, "i long, t long, p long").groupBy("i").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
        for r in rows.collect():
            found[:, r["i"]] = r["t"], r["p"]
    return found[0], found[1]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Dictionaries from folds 1 to 3 of the labelled rows, weights and threshold from fold 4 (crc32 of the id mod 5).

    Defined cases: rows without an id, a 0/1 label or a text teach nothing; of unlike
    labels of an id the larger counts; copies and near copies of a text (op8's
    components of the sample) within a class count as one; with a class missing from
    fold 4 every text scores the share of toxic texts in the sample (none: under 0.5).
    """
    spark = docs.sparkSession
    ids = materialise(sample_ids(labels, F.col(label_col), train_docs, fold(F.col("doc_id"), 5) != 0), "toxic-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    sample = materialise(rows.join(F.broadcast(ids), "doc_id"), "toxic-sample")
    # Or the chance words of a text that many copy would look typical of its class.
    found = simhash.near_duplicates(sample).groupBy("doc_id").agg(F.min("component_id").alias("k"))
    sample = sample.select("doc_id", "text", "y").join(found, "doc_id")
    sample = materialise(sample.groupBy("y", "k").agg(F.min_by("doc_id", "doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text")), "toxic-sample")
    learn = fold(F.col("doc_id"), 5) != 4

    of_class = {y: sample.filter(learn & (F.col("y") == y)) for y in (0, 1)}
    ordinary = train_dictionary(_pieces(of_class[0]), ORDINARY_BYTES)
    whole = train_dictionary(_pieces(of_class[1]), TOXIC_BYTES)
    sizes = {r["y"]: r["n"] for r in sample.filter(learn).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    grams = np.unique(gram_hashes(whole))
    toxic, plain = _holders(sample.filter(learn), grams)

    best, gain, ys = None, -math.inf, np.zeros(0)
    for test in TESTS:
        model = untrained(ordinary, typical_parts(whole, grams, toxic, plain, sizes.get(1, 0), sizes.get(0, 0), test))
        kept = _features(sample.filter(~learn), model, "y").toArrow()  # TRAIN_DOCS of each class at most
        ys = kept.column("y").to_numpy().astype(float)
        if not 0 < ys.sum() < len(ys):
            break
        told = calibrate(model, np.array(kept.column("f").to_pylist(), float), ys)
        if told > gain:
            best, gain = model, told
    if best is None:
        n = sum(sizes.values()) + len(ys)
        share = (sizes.get(1, 0) + ys.sum() + 0.1) / (n + 1)
        best = untrained(ordinary, b"")
        best.weights[-1] = math.log(share / (1 - share))
    return best


def _features(docs: DataFrame, model: ToxicityModel, carry: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contrast = Contrast(shared.value)
        for batch in batches:
            found = [contrast.features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], [carry, "f"])

    kind = docs.schema[carry].dataType.simpleString()
    return docs.select(carry, "text").mapInArrow(run, f"{carry} {kind}, f array<double>")


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Toxicity of every whole text: doc_id, score (0 to 1), predicted (score >= threshold), top_contrast.

    Defined cases: a null or blank text has no windows and gets the score of a text
    without contrast; null and repeated ids give a row each; other columns are ignored;
    an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contrast = Contrast(shared.value)
        for batch in batches:
            x = np.array([contrast.features(t.as_py()) for t in batch.column(1)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-shared.value.logit(x)))), pa.array(x[:, 0])], ["doc_id", "score", "top_contrast"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, top_contrast double")
    return rows.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "top_contrast")
