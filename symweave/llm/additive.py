"""Nearest neighbours with additive quantisation.

A vector is written as the sum of one entry from each of several codebooks, all
of full dimension: the codebooks are fitted one after another to what the ones
before leave, and a beam search picks the entries of a vector together. The norm
of the sum is stored. A query's products with all entries form a table, so an
approximate cosine is a few look-ups and one division; the best candidates are
scored again exactly: at least ``CANDIDATES`` in every task, and all that the
quantisation error may have kept from the best (``SURE`` standard deviations of
an error in any direction).

The codebooks are fitted on at most about ``TRAINING_ROWS`` rows, taken by a hash
of the id; every row is encoded and indexed. Queries are sent to the code
partitions in blocks of ``QUERY_BLOCK``, which bounds what is broadcast, and each
partition, which holds the vectors beside the codes, answers with its exact best
for a query, so nothing is shuffled but those.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do those of another length than most rows have; rows with the
query's own id are not its candidates; rows that repeat an id are candidates
each, and a repeated query is asked once; ties go to the smaller id; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.llm.common import materialise, regrouped, small_batches, table, unit_hash

CODEBOOKS, ENTRIES, BEAM = 16, 256, 4
TRAINING_ROWS = 8192
ROUNDS = 6
CANDIDATES = 300
#: Standard deviations of the quantisation error within which rows are scored exactly.
SURE = 4.0
#: Rows that one task scans for a block of queries.
SCAN_ROWS = 8192
QUERY_BLOCK = 32_768
SEED = 5


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of rows that take part; all have the same length."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False)))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (sizes["d"] if sizes else 0))


def stacked(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top  # so that neither large nor tiny components overflow a square
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class AdditiveQuantiser:
    def __init__(self, sample: np.ndarray, codebooks: int = CODEBOOKS, entries: int = ENTRIES, seed: int = SEED):
        """Fit residual codebooks by k-means on unit vectors."""
        rng = np.random.default_rng(seed)
        left, books = sample.astype(np.float32).copy(), []
        for _ in range(codebooks):
            k = min(entries, len(left))
            centres = left[rng.choice(len(left), k, replace=False)].copy()
            for _ in range(ROUNDS):
                near = self._nearest(left, centres)
                sums = np.zeros_like(centres)
                np.add.at(sums, near, left)
                count = np.bincount(near, minlength=k)
                centres[count > 0] = sums[count > 0] / count[count > 0, None]
            centres[0] = 0  # nothing to add stays possible, so more codebooks never hurt
            books.append(centres)
            left -= centres[self._nearest(left, centres)]
        self.books = np.stack(books)  # [codebook, entry, dimension]
        self.products: np.ndarray | None = None  # of all pairs of entries; made where vectors are encoded

    @property
    def flat(self) -> np.ndarray:
        return self.books.reshape(-1, self.books.shape[2])

    def __getstate__(self) -> dict:
        return {"books": self.books, "products": None}

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes [n, codebooks] and the norm of their sums, by beam search over all codebooks."""
        m, k, _ = self.books.shape
        if self.products is None:
            self.products = self.flat @ self.flat.T
        codes, norms = np.zeros((len(x), m), np.uint8), np.zeros(len(x), np.float32)
        own = np.diag(self.products)
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024].astype(np.float32)
            n = len(part)
            dots = part @ self.flat.T
            # error of a partial sum s: |s|^2 - 2 x.s ; only that differs between candidates
            error = np.zeros((n, 1), np.float32)
            chosen = np.zeros((n, 1, 0), np.int64)
            for b in range(m):
                cost = own[b * k : (b + 1) * k] - 2 * dots[:, b * k : (b + 1) * k]
                step = error[:, :, None] + cost[:, None, :]
                for j in range(b):
                    step += 2 * self.products[chosen[:, :, j], b * k : (b + 1) * k]
                flat = step.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                error = np.take_along_axis(flat, best, 1)
                came = np.take_along_axis(chosen, (best // k)[:, :, None], 1) if b else np.zeros((n, keep, 0), np.int64)
                chosen = np.concatenate([came, (best % k + b * k)[:, :, None]], 2)
            first = chosen[np.arange(n), error.argmin(1)]
            codes[a : a + n] = first - np.arange(m) * k
            norms[a : a + n] = np.sqrt((self.flat[first].sum(1) ** 2).sum(1))
        return codes, norms

    def miss(self, x: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Distance of each unit vector from its sum of entries, scaled to length one."""
        sums = np.zeros(x.shape, np.float32)
        for b in range(codes.shape[1]):
            sums += self.books[b][codes[:, b]]
        return np.sqrt(((x - sums / np.maximum(norms, 1e-12)[:, None]) ** 2).sum(1)).astype(np.float32)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query with all entries: [query, codebook * entry]."""
        return queries.astype(np.float32) @ self.flat.T

    def approximate(self, tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        k = self.books.shape[1]
        total = np.zeros((len(tables), len(codes)), np.float32)
        for b in range(codes.shape[1]):
            total += tables[:, b * k : (b + 1) * k].take(codes[:, b], axis=1)
        return total / np.maximum(norms, 1e-12)


def train(rows: DataFrame, training_rows: int = TRAINING_ROWS) -> AdditiveQuantiser | None:
    n = rows.count()
    if not n:
        return None
    sample = sorted((r[0], r[1]) for r in rows.where(unit_hash("vec_id") < training_rows / n).select("vec_id", "vector").collect())
    if not sample:
        sample = [(r[0], r[1]) for r in rows.orderBy("vec_id").limit(training_rows).collect()]
    return AdditiveQuantiser(unit(np.asarray([v for _, v in sample])))


def encoded(rows: DataFrame, quantiser: AdditiveQuantiser) -> DataFrame:
    """(vec_id, codes, norm, miss, vector): the index; miss is the distance of the vector from the direction of its codes."""
    sent = rows.sparkSession.sparkContext.broadcast(quantiser)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches, 1024):
            if batch.num_rows:
                x = unit(stacked(batch.column(1)))
                codes, norms = sent.value.encode(x)
                miss = sent.value.miss(x, codes, norms)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(miss), batch.column(1)], names=["vec_id", "codes", "norm", "miss", "vector"])

    return rows.select("vec_id", "vector").mapInArrow(run, f"vec_id {kind}, codes binary, norm float, miss float, vector array<double>")


def best_places(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` best scores; ties go to smaller ids. ids ascend."""
    if len(scores) <= count:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - count)[len(scores) - count]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: count - len(above)]])


def search(vectors: DataFrame, is_query: Column, neighbours: int = 5, candidates: int = CANDIDATES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of each query row by cosine."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = materialise(usable(vectors, key, vector), "vectors")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    quantiser = train(rows)
    if quantiser is None:
        return spark.createDataFrame([], schema)
    index = materialise(encoded(rows, quantiser), "codes")
    tasks = max(1, -(-index.count() // SCAN_ROWS))
    index = index.coalesce(tasks)
    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        held: dict = {}
        for r in part.collect():  # about QUERY_BLOCK rows
            held[r[0]] = min(held.get(r[0], r[1]), r[1])
        if not held:
            continue
        names = sorted(held)
        sent = spark.sparkContext.broadcast((quantiser, np.asarray(names), unit(np.asarray([held[q] for q in names]))))
        parts.append(_search_block(index, sent, kind, neighbours, candidates))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_best(query: np.ndarray, scores: np.ndarray, margin: np.ndarray, ids: np.ndarray, vectors: np.ndarray, neighbours: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the best rows of one query; ids ascend."""
    chosen = best_places(scores, ids, candidates)
    if len(scores) > candidates:
        low = scores - margin
        sure = np.partition(low, len(low) - neighbours)[len(low) - neighbours]
        chosen = np.union1d(chosen, np.flatnonzero(scores + margin >= sure))
    chosen = chosen[scores[chosen] > -np.inf]
    exact = (query * vectors[chosen]).sum(1)
    order = np.lexsort((ids[chosen], -exact))[:neighbours]
    return chosen[order], exact[order]


def _search_block(index: DataFrame, sent, kind: str, neighbours: int, candidates: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, names, queries = sent.value
        found: list[tuple[np.ndarray, np.ndarray]] | None = None
        for batch in regrouped(batches, SCAN_ROWS):
            order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
            ids = batch.column(0).to_numpy(zero_copy_only=False)[order]
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            norms = batch.column(2).to_numpy(zero_copy_only=False)[order]
            vectors = unit(stacked(batch.column(4)))[order]
            miss = batch.column(3).to_numpy(zero_copy_only=False)[order]
            margin = miss * min(1.0, SURE / np.sqrt(vectors.shape[1])) + np.float32(1e-5)
            tops = []
            for a in range(0, len(names), 128):
                scores = quantiser.approximate(quantiser.tables(queries[a : a + 128]), codes, norms)
                for q, s in enumerate(scores, a):
                    at = np.searchsorted(ids, names[q])
                    while at < len(ids) and ids[at] == names[q]:
                        s[at] = -np.inf
                        at += 1
                    best, exact = exact_best(queries[q], s, margin, ids, vectors, neighbours, candidates)
                    tops.append((ids[best], exact))
            if found is None:
                found = tops
            else:
                for q, ((i, s), (j, t)) in enumerate(zip(found, tops, strict=True)):
                    i, s = np.concatenate([i, j]), np.concatenate([s, t])
                    o = np.lexsort((i, -s))[:neighbours]
                    found[q] = (i[o], s[o])
        for a in range(0, len(found or ()), 256):
            part = found[a : a + 256]
            q = np.repeat(names[a : a + 256], [len(i) for i, _ in part])
            i, s = np.concatenate([i for i, _ in part]), np.concatenate([s for _, s in part])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    near = index.mapInArrow(scan, f"query_id {kind}, vec_id {kind}, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_additive_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
