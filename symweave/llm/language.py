"""Language identification with a byte convolutional network.

Filters of several widths run over the bytes of fixed windows, the largest
response of each filter in a window is kept, and a softmax layer names the
language. Training is numpy on a bounded, documented sample of labelled rows
(``DOCS_PER_LANGUAGE`` expected documents of each language, taken by a hash of
the id); prediction reads every window of every text.

A filter over bytes is a sum of table look-ups, one table for each tap; taps are
merged into pair tables for prediction, so no one-hot matrix is ever built.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
rows without a label are predicted but never learnt from; with no labelled row
at all every text is ``und`` (and ``keep_identified`` keeps all documents, as
there is nothing to reject them by); languages that tie go by the order of their
names; repeated rows get equal answers; texts of any length are read whole;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import id_bucket, small_batches, table, unit_hash

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Documents of each language that the network is fitted on, as expected under the hash sample.
DOCS_PER_LANGUAGE = 500
#: Bytes of one document that the network learns from: a stretch whose place a hash of the id tells.
LEARNT_BYTES = 1 << 16
STEPS, BATCH, RATE, SEED = 700, 128, 0.01, 7
UNKNOWN = "und"
#: Windows whose responses are held at once (1 MB for each table).
BLOCK = 64

_LETTER = regex.compile(r"\p{L}")


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts as zero-padded windows [n, WINDOW], with their owner and their bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.zeros((int(counts.sum()), WINDOW), np.uint8)
    flat, at = out.reshape(-1), 0
    for t, c in zip(texts, counts.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += c * WINDOW
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return out, owner, np.minimum(WINDOW, sizes[owner] - place * WINDOW)


class ByteConvNet:
    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.taps = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.taps:
            t[:, 0] = 0  # padding answers nothing
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)
        self.pairs: list[tuple[np.ndarray, np.ndarray | None, bool]] | None = None

    def fit(self, windows: np.ndarray, truth: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """Adam on cross-entropy; the pooled maximum passes its gradient to the bytes under it."""
        rng = np.random.default_rng(seed)
        params = [*self.taps, self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(windows), BATCH)
            x = np.ascontiguousarray(windows[rows].T)
            pooled, places = [], []
            for taps, w in zip(self.taps, WIDTHS, strict=True):
                span = WINDOW - w + 1
                h = taps[0][x[:span]]
                for k in range(1, w):
                    h += taps[k][x[k : k + span]]
                at = h.argmax(0)
                pooled.append(np.take_along_axis(h, at[None], 0)[0])
                places.append(at)
            z = np.maximum(np.concatenate(pooled, 1), 0)
            logits = z @ self.dense + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(BATCH), truth[rows]] -= 1
            p /= BATCH
            dz = (p @ self.dense.T) * (z > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                part, g = dz[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(self.taps[i])
                for k in range(w):
                    byte = x[places[i] + k, np.arange(BATCH)[:, None]].astype(np.int64)
                    g[k] = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), part.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                g[:, 0] = 0
                grads.append(g)
            grads += [z.T @ p, p.sum(0)]
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for v, g, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.pairs = None

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray | None, bool]]:
        if self.pairs is None:
            both = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
            two, three, four = self.taps
            self.pairs = [(both(two[0], two[1]), None, False), (both(three[0], three[1]), three[2], False), (both(four[0], four[1]), both(four[2], four[3]), True)]
        return self.pairs

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float32)
        tables = self._tables()
        for a in range(0, len(windows), BLOCK):
            x = np.ascontiguousarray(windows[a : a + BLOCK].T)
            pair = x[:-1].astype(np.int32) * 256 + x[1:]
            pooled = []
            for w, (head, tail, paired) in zip(WIDTHS, tables, strict=True):
                span = WINDOW - w + 1
                h = head.take(pair[:span], axis=0)
                if tail is not None:
                    h += tail.take(pair[2 : 2 + span] if paired else x[2 : 2 + span], axis=0)
                pooled.append(h.max(0))
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.dense + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            out[a : a + BLOCK] = p / p.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Label number and mean probability over the bytes of each (non-empty) text."""
        windows, owner, sizes = windows_of(texts)
        p = self.probabilities(windows) * sizes[:, None]
        total = np.stack([np.bincount(owner, p[:, c], len(texts)) for c in range(len(self.labels))], 1)
        total /= np.maximum(np.bincount(owner, sizes, len(texts)), 1)[:, None]
        best = total.argmax(1)
        return best, np.clip(total[np.arange(len(texts)), best], 0, 1)


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, key: str = "doc_id", text: str = "text", label: str = "lang") -> ByteConvNet | None:
    """Fit on about ``docs_per_language`` documents of each label; None where nothing is labelled."""
    usable = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col(label) == v, F.lit(min(1.0, docs_per_language / n))) for v, n in sorted(counts.items())])
    data = F.col(text).cast("binary")
    spare = F.greatest(F.octet_length(data) - LEARNT_BYTES, F.lit(0))
    start = F.pmod(F.xxhash64(key), spare + 1).cast("int") + 1
    rows = usable.where(unit_hash(key) < share).select(label, F.substring(data, start, F.lit(LEARNT_BYTES))).collect()
    labels = sorted(counts)
    rows = sorted(((r[0], bytes(r[1])) for r in rows if r[1]), key=lambda r: (r[0], r[1]))
    if not rows:
        return None
    windows, owner, sizes = windows_of([t for _, t in rows])
    truth = np.asarray([labels.index(v) for v, _ in rows])[owner]
    net = ByteConvNet(labels)
    keep = sizes >= 16
    if not keep.any():
        keep[:] = True
    # each language has the same weight: windows are drawn until all have as many as the largest
    windows, truth = windows[keep], truth[keep]
    groups = [np.flatnonzero(truth == c) for c in range(len(labels))]
    most = max(map(len, groups))
    even = np.concatenate([np.resize(g, most) for g in groups if len(g)])
    net.fit(windows[even], truth[even])
    return net


def identify(documents: DataFrame, net: ByteConvNet | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text, in one pass without a shuffle."""
    small_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    if net is not None:
        net.pairs = None
    sent = documents.sparkSession.sparkContext.broadcast(net)  # 40 thousand weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            names, scores = predictions(net, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def predictions(net: ByteConvNet | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    rows = [i for i, t in enumerate(texts) if net is not None and t and _LETTER.search(t)]
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if rows and net is not None:
        best, p = net.predict([texts[i].encode() for i in rows])
        for i, b in zip(rows, best.tolist(), strict=True):
            names[i] = net.labels[b]
        scores[rows] = p
    return names, scores


def keep_identified(documents: DataFrame, net: ByteConvNet | None, least_score: float = 0.3, text: str = "text") -> DataFrame:
    """Documents with a language: those that are ``und`` or below ``least_score`` go, the rest keep all their columns; without a network all stay."""
    if net is None:
        return documents
    small_batches(documents.sparkSession)
    at = documents.columns.index(text)
    sent = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predictions(sent.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, scores.tolist(), strict=True)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op3_byte_cnn_language(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(documents.where(id_bucket("doc_id", 4) != 2))
    found = identify(documents, net)
    return found.select("doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
