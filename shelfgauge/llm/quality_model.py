"""Quality classifier (5): kernel ridge on document statistics, calibrated.

A text becomes a dozen statistics (length, word shapes, repetition, character classes),
scaled by the training rows. Random Fourier features, drawn once from a fixed seed,
approximate a Gaussian kernel over them. Each partition of the training rows adds up its
part of the normal equations, whose size depends on the number of features alone; Spark
sums the parts, and the driver solves for the ridge weights. Isotonic regression, on
training rows that the ridge fit did not see, turns ridge scores into probabilities; it
works on counts in ``BINS`` bins of the score.

Labels are used only for rows whose crc32 of the id as text, modulo 5, is not 0: 1 to 3
fit the ridge weights, 4 calibrates. Neither ids nor other columns are inputs of a score.

Null texts count as empty and are scored like others. Null ids are scored and not held
out. Several labels of an id count as their mean; null labels do not count; rows that
repeat an id are rows like others. Without labels to fit or calibrate, all scores are
0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfgauge.llm.common import map_rows, pieces, store, whole

FEATURES = 256
#: Width of the kernel, in standard deviations of a statistic.
WIDTH = 3.0
RIDGE = 1e-3
SEED = 20240501
BINS = 1000
THRESHOLD = 0.3
#: Folds by crc32 modulo ``FOLDS``: held out, and used for calibration; the rest fit.
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4

NAMES = (
    "log_words", "word_length", "distinct", "stutter", "upper", "digits", "ends", "symbols",
    "bars", "shouts", "wide", "log_line",
)


def _of(characters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(characters))


_UPPER, _LOWER, _DIGIT = _of(bytes(range(65, 91))), _of(bytes(range(97, 123))), _of(b"0123456789")
_ENDS, _SYMBOLS = _of(b".,;:?"), _of(b"#*$%&<>@^~_=+\\{}[]")
_WIDE = np.arange(256) >= 128


def statistics(text: str) -> list[float]:
    """The statistics of a text, in the order of ``NAMES``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda which: float(counts[which].sum())
    solid = max(1, sum(map(len, words)))
    letters = max(1.0, of(_UPPER) + of(_LOWER))
    return [
        np.log1p(len(words)),
        min(30.0, solid / n),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        of(_UPPER) / letters,
        of(_DIGIT) / solid,
        of(_ENDS) / n,
        of(_SYMBOLS) / n,
        counts[ord("|")] / n,
        counts[ord("!")] / n,
        of(_WIDE) / solid,
        np.log1p(len(raw) / (counts[10] + 1)),
    ]


def projection(n_statistics: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return (
        draw.normal(0.0, 1.0 / WIDTH, (n_statistics, FEATURES)),
        draw.uniform(0.0, 2 * np.pi, FEATURES),
    )


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of statistics, and a constant."""
    directions, phases = projection(x.shape[1])
    scaled = np.clip((x - mean) / scale, -10, 10)
    waves = np.sqrt(2.0 / FEATURES) * np.cos(scaled @ directions + phases)
    return np.hstack([waves, np.ones((len(x), 1))])


def rising(rows: list[tuple[int, float, float]]) -> list[tuple[int, float]]:
    """Isotonic regression by pooling: (bin, count, sum of labels) to (bin, mean)."""
    pools: list[list[float]] = []  # count, sum, number of bins
    for _, count, total in rows:
        pools.append([count, total, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    means = [total / count for count, total, n in pools for _ in range(int(n))]
    return [(row[0], mean) for row, mean in zip(rows, means)]


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def document_statistics(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), fold(doc_id).cast("int").alias("fold"), whole(text).alias("text")
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in pieces(batches, "doc_id", "fold", "text"):
            for key, own, text in zip(*part):
                yield key, own, statistics(text)

    return store(map_rows(narrow, f"doc_id {kind}, fold int, x array<double>", run), "statistics")


def _matrix(values: list) -> np.ndarray:
    return np.array(values, np.float64).reshape(len(values), -1)


def _bins(scores: np.ndarray) -> np.ndarray:
    """Ridge scores from -0.5 to 1.5 in equal bins, the rest in the outer ones."""
    return np.clip((scores + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)


class Model:
    """Ridge weights and the calibration of their scores."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        self.mean, self.scale = mean, scale
        self.weights: np.ndarray | None = None
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: list) -> np.ndarray:
        return fourier(_matrix(x), self.mean, self.scale)

    def bins(self, x: list) -> np.ndarray:
        return _bins(self.features(x) @ self.weights)

    def score(self, x: list) -> np.ndarray:
        if self.steps is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.bins(x), *self.steps), 0.0, 1.0)


def _fit_ridge(model: Model, rows: DataFrame) -> None:
    """Sum the partitions' normal equations and solve them."""
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        square, right = np.zeros((size, size)), np.zeros(size)
        for x, y in pieces(batches, "x", "y", rows=2000):
            z = model.features(x)
            square += z.T @ z
            right += z.T @ np.array(y, np.float64)
        if square[-1, -1]:
            yield from ((int(at), float(v)) for at, v in enumerate(square[upper]))
            yield from ((-1 - at, float(v)) for at, v in enumerate(right))

    sums = map_rows(rows, "at int, v double", equations).groupBy("at").agg(F.sum("v").alias("v"))
    found = {row.at: row.v for row in sums.collect()}  # as many as the features need, whatever the rows
    if not found:
        return
    square = np.zeros((size, size))
    square[upper] = [found[at] for at in range(len(upper[0]))]
    square += np.triu(square, 1).T
    right = np.array([found[-1 - at] for at in range(size)])
    ridge = RIDGE * square[-1, -1] * np.eye(size) / FEATURES
    ridge[-1, -1] = 0.0
    model.weights = np.linalg.solve(square + ridge, right)


def _calibrate(model: Model, rows: DataFrame) -> None:
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for x, y in pieces(batches, "x", "y", rows=2000):
            yield from zip(model.bins(x).tolist(), y)

    counts = (
        map_rows(rows, "bin int, y double", binned)
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.sum("y").alias("total"))
        .orderBy("bin")
        .collect()  # at most BINS rows
    )
    if counts:
        steps = rising([(row.bin, row.n, row.total) for row in counts])
        model.steps = tuple(np.array(column, np.float64) for column in zip(*steps))


def train(rows: DataFrame) -> Model:
    """Fit on rows ``fold, x, y`` of labelled documents."""
    fit = rows.where(~F.col("fold").isin(HELD_OUT, CALIBRATE))
    sums = [f(F.get("x", F.lit(i))) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]
    shape = [value or 0.0 for value in fit.agg(*sums).first()]
    scale = np.array(shape[1::2])
    model = Model(np.array(shape[::2]), np.where(scale > 1e-9, scale, 1.0))
    _fit_ridge(model, fit)
    if model.weights is not None:
        _calibrate(model, rows.where(F.col("fold") == CALIBRATE))
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    stats = document_statistics(docs, text, doc_id)
    marks = (
        labels.where("quality is not null")
        .groupBy("doc_id")
        .agg(F.avg("quality").cast("double").alias("y"))
    )
    model = train(store(stats.where(F.col("fold") != HELD_OUT).join(marks, "doc_id").select("fold", "x", "y"), "labelled"))
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ids, folds, x in pieces(batches, "doc_id", "fold", "x", rows=2000):
            for key, own, score in zip(ids, folds, model.score(x).tolist()):
                yield key, own == HELD_OUT, score, int(score >= THRESHOLD)

    return map_rows(stats, f"doc_id {kind}, held_out boolean, score double, predicted int", run)
