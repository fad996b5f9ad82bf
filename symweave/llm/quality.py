"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Each whole text is read once into a short vector of document statistics.
Random Fourier features of the standardised vector approximate a Gaussian
kernel. Every partition sums its share of the normal equations; the sums of all
partitions give the ridge weights. A part of the labelled rows that the ridge
does not see calibrates its output: counts in fixed bins, also summed over
partitions, and pool-adjacent-violators over the bins.

Edge cases: null text counts as empty and is scored; labels other than 0 and 1
and null labels are not learnt from; with no label every score is 0.5; where no
label falls into the part that calibrates, those that the ridge saw calibrate
it, and where all do, they are learnt from too; equal outputs share a bin, so
ties get equal scores, as repeated rows do; texts are read whole; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import id_bucket, materialise, small_batches, table, tree_sum

FEATURES = 256
RIDGE = 1e-3
BINS = 2048
THRESHOLD = 0.3
SEED = 11

#: Byte classes whose share of a text is a statistic (fixed values).
BYTE_CLASSES: tuple[bytes, ...] = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" ",
    b"\n",
    b"\t\r\x0b\x0c",
    b".",
    b",",
    b"!?",
    b"#$%&*",
    b"|",
    b"\"'()-/:;",
    b"<>=@[]\\^_`{}~+",
    bytes(range(128, 256)),
    bytes(range(9)) + bytes(range(14, 32)) + b"\x7f",
)
_CLASS_OF = np.zeros(256, np.int64)
for _n, _members in enumerate(BYTE_CLASSES):
    _CLASS_OF[list(_members)] = _n
_LETTERS = np.zeros(256, bool)
_LETTERS[list(BYTE_CLASSES[0] + BYTE_CLASSES[1] + BYTE_CLASSES[13])] = True
WIDTH = len(BYTE_CLASSES) + 17


def statistics_of(raw: bytes) -> np.ndarray:
    """The statistics of one whole text."""
    out = np.zeros(WIDTH)
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    k = len(BYTE_CLASSES)
    out[:k] = np.bincount(_CLASS_OF[data], minlength=k) / len(data)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    out[k] = np.log1p(len(data))
    out[k + 1] = np.log1p(n)
    out[k + 2] = np.log(len(zlib.compress(raw, 1)) / len(data))
    if n:
        sizes = np.fromiter(map(len, words), np.int64, n)
        tally = Counter(words)
        folded = np.fromiter(map(hash, words), np.int64, n)
        pairs = len(np.unique(folded[:-1] * 31 + folded[1:])) if n > 1 else 1
        tails = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
        heads = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
        out[k + 3] = sizes.mean()
        out[k + 4] = sizes.std()
        out[k + 5] = np.log1p(sizes.max())
        out[k + 6] = len(tally) / n
        out[k + 7] = np.log(len(tally)) / np.log(n + 1)
        out[k + 8] = max(tally.values()) / n
        out[k + 9] = (folded[:-1] == folded[1:]).mean() if n > 1 else 0
        out[k + 10] = pairs / max(1, n - 1)
        out[k + 11] = 1 - _LETTERS[tails].mean()
        out[k + 12] = 1 - _LETTERS[heads].mean()
        out[k + 13] = ((heads >= 65) & (heads <= 90)).mean()
        out[k + 14] = (sizes <= 3).mean()
    if lines:
        out[k + 15] = np.log1p(len(data) / len(lines))
        out[k + 16] = 1 - len(set(lines)) / len(lines)
    return out


def statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats array<float>) of every text: the only pass over the texts."""
    small_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(b or b"") for b in batch.column(1).cast(pa.binary()).to_pylist()]
            flat = pa.array(np.asarray(rows, np.float32).ravel())
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=[key, "stats"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, stats array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``part`` over all batches: one array a partition, added up in two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return tree_sum(rows.mapInArrow(run, "total binary"), shape)


class FourierRidge:
    """Standardisation, random features, ridge weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.frequencies = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, features))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.curve: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(x @ self.frequencies + self.phase), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        return np.full(len(raw), 0.5) if self.curve is None else np.interp(raw, *self.curve)


def isotonic(positions: np.ndarray, ones: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: positions and non-decreasing shares of ones."""
    pooled: list[list[float]] = []  # ones, total, first, last
    for x, a, n in zip(positions, ones, totals, strict=True):
        pooled.append([a, n, x, x])
        while len(pooled) > 1 and pooled[-2][0] * pooled[-1][1] >= pooled[-1][0] * pooled[-2][1]:
            a2, n2, _, last = pooled.pop()
            pooled[-1] = [pooled[-1][0] + a2, pooled[-1][1] + n2, pooled[-1][2], last]
    xs, ys = [], []
    for a, n, first, last in pooled:
        share = (a + 0.5) / (n + 1)  # never quite sure
        for x in {first, last}:
            xs.append(x)
            ys.append(share)
    order = np.argsort(xs, kind="stable")
    return np.asarray(xs)[order], np.maximum.accumulate(np.asarray(ys)[order])


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, label: str = "label") -> FourierRidge | None:
    """Fit on (stats, label, calibrate) rows; rows with ``calibrate`` only shape the calibration curve."""
    learn = labelled.where(~F.col("calibrate"))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0))
        return np.vstack([np.full(WIDTH, len(x)), x.sum(0), (x * x).sum(0)])

    n, first, second = summed(learn.select("stats"), moments, (3, WIDTH))
    if not n[0]:
        learn = labelled
        n, first, second = summed(learn.select("stats"), moments, (3, WIDTH))
    if not n[0]:
        return None
    mean = first / n
    model = FourierRidge(mean, np.sqrt(np.maximum(second / n - mean * mean, 1e-12)) + 1e-6, features)

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(matrix(batch.column(0)))
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        return np.vstack([z.T @ z, z.T @ y])

    sums = summed(learn.select("stats", label), equations, (features + 2, features + 1))
    model.weights = np.linalg.solve(sums[:-1] + ridge * n[0] / features * np.eye(features + 1), sums[-1])

    low, high = -0.5, 1.5

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip((model.raw(matrix(batch.column(0))) - low) / (high - low) * BINS, 0, BINS - 1).astype(int)
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        return np.vstack([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    ones, totals = summed(labelled.where("calibrate").select("stats", label), bins, (2, BINS))
    if not totals.any():  # too few labels for a fold of their own: those that the ridge saw calibrate it too
        ones, totals = summed(learn.select("stats", label), bins, (2, BINS))
    full = totals > 0
    if full.any():
        middle = low + (np.arange(BINS) + 0.5) * (high - low) / BINS
        model.curve = isotonic(middle[full], ones[full], totals[full])
    return model


def score(stats: DataFrame, model: FourierRidge | None, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of every row of ``statistics``."""
    kind = stats.schema[key].dataType.simpleString()
    sent = stats.sparkSession.sparkContext.broadcast(model)  # a few hundred KB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            x = matrix(batch.column(1))
            s = np.clip(model.score(x), 0, 1) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    return stats.select(key, "stats").mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def op10_rff_quality(spark, sf_dir: str) -> DataFrame:
    stats = materialise(statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(F.col("label").isin(0, 1) & (id_bucket("doc_id", 5) != 0))
    # the fold that calibrates is told by another hash of the id
    labelled = materialise(stats.join(marks, "doc_id").select("stats", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrate")), "labelled")
    found = score(stats, fit(labelled))
    return found.select("doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
