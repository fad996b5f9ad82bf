"""Masked pseudo-likelihood of documents under a bidirectional window network.

The tokens are the bytes of a text. A network with one hidden layer predicts a
byte from the two bytes on either side of it; the logarithms of those
conditional probabilities, summed over a document, are its score.

A byte and its window are one number, so the corpus is its table of window
counts: every text is read whole into counts that are summed over the corpus,
and the network is trained in numpy on that table, each task passing over its
share and all tasks averaging their weights after each round. Scoring needs the
network once for each distinct window; a worker remembers those it has met.

Edge cases: null and empty texts have no token and score 0; the edges of a text
are padded with the zero byte; repeated rows score alike; an empty table trains
nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import materialise, small_batches, table, tree_sum

SIDE = 2
HIDDEN = 32
ROUNDS, BATCH, RATE, SEED = 4, 2048, 0.02, 3
#: Distinct windows that one training task passes over.
ROWS_A_TASK = 100_000
#: Bytes whose windows are made together.
GROUP = 2_000_000
#: Slots of a worker's memory of scored windows (12 bytes each).
SLOTS = 1 << 23

_PLACES = (32, 24, 8, 0)  # of the two bytes before and the two after; the byte itself is at 16


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The window number of every byte, and where each text's windows end."""
    pad = b"\0" * SIDE
    data = np.frombuffer(pad + b"".join([t + pad for t in texts]), np.uint8).astype(np.uint64)
    n = len(data) - 2 * SIDE
    keys = (data[:n] << np.uint64(32)) | (data[1 : n + 1] << np.uint64(24)) | (data[2 : n + 2] << np.uint64(16)) | (data[3 : n + 3] << np.uint64(8)) | data[4:]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    keep = np.ones(n, bool)
    gaps = np.cumsum(sizes + SIDE)[:-1] - SIDE
    for k in range(SIDE):
        keep[gaps + k] = False
    return keys[keep], np.cumsum(sizes)


def grouped(texts: list[bytes | None]) -> Iterator[list[int]]:
    """Numbers of texts, in groups of about ``GROUP`` bytes."""
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t or b"")
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def tallied(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and their counts."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.diff(np.concatenate((first, [len(keys)])))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def window_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(window, n) over all texts; each task sums what it reads before the shuffle."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for group in grouped(texts):
                keys, _ = windows([texts[i] for i in group])
                if len(keys):
                    held.append(tallied(keys))
                if len(held) >= 8:
                    held = [tallied(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
        if held:
            keys, counts = tallied(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            for a in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 50_000].view(np.int64)), pa.array(counts[a : a + 50_000].astype(np.int64))], names=["window", "n"])

    return documents.select(text).mapInArrow(run, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))


class WindowNet:
    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.3, (len(_PLACES), 256, hidden)).astype(np.float32)
        self.inner = np.zeros(hidden, np.float32)
        self.out = rng.normal(0, 0.1, (hidden, 256)).astype(np.float32)
        self.bias = np.zeros(256, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.tables, self.inner, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def load(self, flat: np.ndarray) -> WindowNet:
        at = 0
        for w in self.weights():
            w[...] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        return self

    @staticmethod
    def split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        around = np.stack([(keys >> np.uint64(p)) & np.uint64(255) for p in _PLACES]).astype(np.int64)
        return around, ((keys >> np.uint64(16)) & np.uint64(255)).astype(np.int64)

    def _forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(sum(self.tables[k][around[k]] for k in range(len(_PLACES))) + self.inner)
        logits = h @ self.out + self.bias
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return h, logits

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), np.float32)
        for a in range(0, len(keys), 4096):
            around, byte = self.split(keys[a : a + 4096])
            _, logp = self._forward(around)
            out[a : a + len(byte)] = logp[np.arange(len(byte)), byte]
        return out

    def train_pass(self, keys: np.ndarray, counts: np.ndarray, rate: float, seed: int) -> None:
        """One pass of Adam over windows weighted by their counts."""
        rng = np.random.default_rng(seed)
        params = self.weights()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        # every window comes up at least once and frequent ones more often, weighing less for it: the expected loss is that of the corpus
        share = np.sqrt(counts.astype(np.float64))
        times = np.maximum(1, np.rint(len(keys) * share / share.sum())).astype(np.int64)
        picks = rng.permutation(np.repeat(np.arange(len(keys)), times))
        scale = counts / times
        for step, a in enumerate(range(0, len(picks), BATCH), 1):
            rows = picks[a : a + BATCH]
            around, byte = self.split(keys[rows])
            h, logp = self._forward(around)
            d = np.exp(logp)
            d[np.arange(len(rows)), byte] -= 1
            d *= (scale[rows] / scale[rows].sum())[:, None].astype(np.float32)
            dh = (d @ self.out.T) * (1 - h * h)
            hidden = self.inner.size
            g = np.zeros_like(self.tables)
            cell = np.arange(hidden)
            for k in range(len(_PLACES)):
                g[k] = np.bincount((around[k][:, None] * hidden + cell).ravel(), dh.ravel(), 256 * hidden).reshape(256, hidden)
            for p, grad, m, s in zip(params, (g, dh.sum(0), h.T @ d, d.sum(0)), first, second, strict=True):
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)


def train(counts: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> WindowNet | None:
    """Train on all window counts: in each round every task passes over its share, then the weights are averaged."""
    spark = counts.sparkSession
    n = counts.count()
    if not n:
        return None
    small_batches(spark)
    shares = counts.repartition(max(1, n // ROWS_A_TASK), "window")
    net = WindowNet(seed)
    sums = np.zeros(256)
    for r in counts.groupBy(F.expr("shiftright(window, 16) & 255").cast("int").alias("b")).agg(F.sum("n")).collect():  # at most 256 rows
        sums[r[0]] = r[1]
    net.bias[:] = np.log((sums + 0.5) / (sums.sum() + 128))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(net.flat())
        rate = RATE * (1 - k / rounds)

        def share(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate, k=k) -> Iterator[pa.RecordBatch]:
            parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if parts:
                keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(keys)
                own = WindowNet(seed).load(sent.value)
                own.train_pass(keys[order], n[order], rate, seed * 1000 + k)
                weighed = np.concatenate(([1.0], own.flat())) * float(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([weighed.tobytes()], pa.binary())], names=["total"])

        flat = tree_sum(shares.mapInArrow(share, "total binary"), (net.flat().size + 1,))
        net.load((flat[1:] / flat[0]).astype(np.float32))
    return net


class Scored:
    """A worker's open-addressing table from windows to log-probabilities."""

    def __init__(self, net: WindowNet, slots: int = SLOTS):
        self.net, self.slots = net, slots
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(self.slots, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros(self.slots, np.float32)
        self.used = 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of every window."""
        place = self._home(keys)
        wrong = np.flatnonzero(self.keys[place] != keys)
        missing = []
        free = np.iinfo(np.uint64).max
        while len(wrong):
            empty = self.keys[place[wrong]] == free
            missing.append(wrong[empty])
            wrong = wrong[~empty]
            place[wrong] = (place[wrong] + 1) & (self.slots - 1)
            wrong = wrong[self.keys[place[wrong]] != keys[wrong]]
        lost = np.concatenate(missing) if missing else np.zeros(0, np.int64)
        if not len(lost):
            return self.values[place]
        new = np.unique(keys[lost])
        scores = self.net.log_probabilities(new)
        out = self.values[place]
        out[lost] = scores[np.searchsorted(new, keys[lost])]
        if self.used + len(new) > self.slots // 2:
            self.clear()
        if len(new) <= self.slots // 4:
            self._insert(new, scores)
        return out

    def _insert(self, keys: np.ndarray, scores: np.ndarray) -> None:
        free = np.iinfo(np.uint64).max
        place, left = self._home(keys), np.arange(len(keys))
        while len(left):
            open_ = self.keys[place[left]] == free
            self.keys[place[left[open_]]] = keys[left[open_]]
            settled = self.keys[place[left]] == keys[left]
            done = left[settled]
            self.values[place[done]] = scores[done]
            left = left[~settled]
            place[left] = (place[left] + 1) & (self.slots - 1)
        self.used += len(keys)


def score(documents: DataFrame, net: WindowNet | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, log_likelihood, per_token) of every whole text, in one pass without a shuffle."""
    small_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(net)  # 40 thousand weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scored(sent.value) if sent.value is not None else None
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            total, sizes = np.zeros(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
            for group in grouped(texts) if scored else ():
                keys, ends = windows([texts[i] for i in group])
                sums = np.concatenate(([0.0], np.cumsum(scored.of(keys), dtype=np.float64)))
                total[group] = np.diff(sums[np.concatenate(([0], ends))])
            mean = total / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(total), pa.array(mean)], names=[key, "n_tokens", "log_likelihood", "per_token"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, log_likelihood double, per_token double")


def op2_masked_lm_score(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(documents, train(materialise(window_counts(documents), "windows")))
