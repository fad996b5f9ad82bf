"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r
bits of both. Every fingerprint therefore emits all its variants within r bits,
variants are shuffled, and fingerprints that meet in a variant are linked.

The variants are not shipped one by one. A variant goes to the bucket that its
top bits name; all variants of a fingerprint reach only 1 + k + C(k, 2) of the
2^k buckets, so a fingerprint is shipped once to each of those, and the bucket
makes the variants that belong to it. Equal fingerprints are shipped once. The
depth k grows with the number of fingerprints, and a bucket that a dense cluster
crowds is split by further bits until its parts have the usual size.

A bucket returns at most one link a fingerprint (its local components), however
many fingerprints meet, so a group of copies of any size yields no pair list.

The filtering stage (``keep_one``) asks for a similarity of four fifths of the
five-word shingles, where fingerprints differ in about ten bits: a ball that holds
half of such pairs takes eight million variants a fingerprint, one that holds
nearly all of them five billion. So ball hashing finds what lies within its
radius, bands of least shingle hashes find the rest, and every link is checked on
the shingle sets themselves.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; fewer words than a shingle hash as one sequence; repeated rows share
their component; a null key names no group, and a group whose keys are all null
has a null component (``keep_one`` keeps rows without a key); ties go to the
smallest key; keys may be of any type that has an order; rows that repeat a key
with other words are documents of their own; further columns, maps too, are
ignored or carried; texts are read whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import dealt_join, materialise, small_batches, table
from symweave.llm.components import components
from symweave.llm.decontaminate import words_of

SHINGLE = 4
RADIUS = 4
HASH_SEED = 42
#: Words of a shingle of near copies, and the similarity (Jaccard, of sets of shingles) from which texts are near copies.
COPY_SHINGLE = 5
NEAR = (4, 5)
#: Bands of least shingle hashes: texts of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Fingerprints whose own top bits name one bucket, as expected.
BUCKET = 1024
#: Least depth: small inputs have as many buckets as a cluster has cores, not fewer and larger ones.
LEAST_DEPTH = 8
#: Fingerprints of its own from which a bucket is split by further bits, and the bits of one split.
HEAVY, STEP = 8 * BUCKET, 4
#: Keys of dropped documents that are broadcast (16 bytes each); beyond that they are joined by a shuffle.
BROADCAST_KEYS = 4_000_000
#: Variants held at once; a larger bucket is walked in slices by further bits.
HELD = 1_500_000
#: Nodes of a band that one task compares with as many others, and the share of equal least hashes from which it takes a pair to be worth a check:
#: a pair of similarity 0.8 lies below it with probability 0.0001. Blocks are smaller where their sets would take more bytes.
BLOCK, BLOCK_BYTES, PLAUSIBLE = 2048, 32 << 20, 0.64
#: Rows of a narrow table in one file.
FILE_ROWS = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def files_for(rows: int) -> int:
    """Files of a narrow table: no more than its rows ask for."""
    return max(2, -(-rows // FILE_ROWS))


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    words = raw.translate(_LOWER).split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, HASH_SEED)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-shingle]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], HASH_SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    return majority(hashes)


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long): the fingerprint of each whole text, as a signed 64-bit number."""
    small_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray([fingerprint(b, shingle) for b in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def masks(low: int, high: int, weight: int) -> np.ndarray:
    """All masks of at most ``weight`` bits among the bits low..high-1."""
    bits = range(low, high)
    return np.asarray([sum(1 << b for b in chosen) for w in range(weight + 1) for chosen in itertools.combinations(bits, w)], np.uint64)


def depth_for(count: int, bucket: int = BUCKET) -> int:
    return max(LEAST_DEPTH, min(40, math.ceil(math.log2(max(1, count) / bucket))))


def heavy_buckets(nodes: DataFrame, depth: int, radius: int = RADIUS) -> list[tuple[int, np.ndarray]]:
    """(depth, buckets) to be split: buckets whose own fingerprints are many (a dense cluster) and those that their variants fall into; then of their parts, and so on."""
    found: list[tuple[int, np.ndarray]] = []
    left = nodes.select("fp")
    while depth <= 64 - STEP:
        own = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
        crowded = left.groupBy(own.alias("b")).count().where(F.col("count") > HEAVY).select("b")
        rows = np.asarray([r[0] for r in crowded.collect()], np.int64)  # one row for each HEAVY fingerprints at most
        if not len(rows):
            break
        found.append((depth, np.unique(rows[:, None] ^ masks(0, depth, radius // 2).view(np.int64))))
        left = left.withColumn("b", own).join(F.broadcast(crowded), "b", "left_semi").select("fp")
        depth += STEP
    return found


def routed(nodes: DataFrame, depth: int, radius: int, heavy: list[tuple[int, np.ndarray]] | None = None) -> DataFrame:
    """(bucket, depth, fp, ...): each row once for every bucket that one of its fingerprint's variants falls into; crowded buckets are split by further bits."""
    flips = masks(0, depth, radius // 2)
    names = nodes.columns

    def split(fps: np.ndarray, owner: np.ndarray, bucket: np.ndarray, away: np.ndarray, at: int, among: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Those in usual buckets, and the rest taken on to the parts of their crowded buckets."""
        place = np.minimum(np.searchsorted(among, bucket.view(np.int64)), len(among) - 1)
        crowded = among[place] == bucket.view(np.int64)
        done = [(owner[~crowded], bucket[~crowded])]
        owner, bucket, away = owner[crowded], bucket[crowded], away[crowded]
        parts = []
        for spare in range(radius // 2 + 1):  # bits that may still be turned
            rows = np.flatnonzero(radius // 2 - away == spare)
            more = masks(0, STEP, spare)
            own = (fps[owner[rows]] >> np.uint64(64 - at - STEP)) & np.uint64((1 << STEP) - 1)
            deeper = (bucket[rows, None] << np.uint64(STEP)) | (own[:, None] ^ more)
            parts.append((np.repeat(owner[rows], len(more)), deeper.ravel(), (away[rows, None] + np.bitwise_count(more)).ravel()))
        return done, *(np.concatenate(x) for x in zip(*parts, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(every), 1024):
                fps = every[a : a + 1024]
                top = fps >> np.uint64(64 - depth) if depth else np.zeros(len(fps), np.uint64)
                owner, bucket, away = np.repeat(np.arange(len(fps)), len(flips)), (top[:, None] ^ flips).ravel(), np.tile(np.bitwise_count(flips), len(fps))
                at = depth
                for level, among in heavy or ():
                    done, owner, bucket, away = split(fps, owner, bucket, away, level, among)
                    for o, b in done:
                        yield batch_of(batch, a + o, b, level)
                    at = level + STEP
                yield batch_of(batch, a + owner, bucket, at)

    def batch_of(batch: pa.RecordBatch, owner: np.ndarray, bucket: np.ndarray, at: int) -> pa.RecordBatch:
        columns = [pa.array(bucket.view(np.int64)), pa.array(np.full(len(bucket), at, np.int32)), *[c.take(pa.array(owner)) for c in batch.columns]]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "depth", *names])

    return nodes.mapInArrow(run, "bucket long, depth int, " + ", ".join(f"{n} long" for n in names))


def slices(fps: np.ndarray, bucket: int, depth: int, reach: int) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The variants of a bucket as (fingerprint numbers, bases, masks), in slices that fit in memory."""
    top = fps >> np.uint64(64 - depth) if depth else np.zeros(len(fps), np.uint64)
    away = np.bitwise_count(top ^ np.uint64(bucket))
    size = sum(int((away == d).sum()) * math.comb(64 - depth, w) for d in range(reach + 1) for w in range(reach - d + 1))
    if size > HELD and depth < 60:
        for bit in (0, 1):
            yield from slices(fps, bucket * 2 + bit, depth + 1, reach)
        return
    rest = np.uint64((1 << (64 - depth)) - 1)
    head = np.uint64(bucket << (64 - depth)) if depth else np.uint64(0)
    found = []
    for d in range(reach + 1):
        rows = np.flatnonzero(away == d)
        if len(rows):
            found.append((rows, (fps[rows] & rest) | head, masks(0, 64 - depth, reach - d)))
    yield found


def meetings(fps: np.ndarray, bucket: int, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (numbers of fingerprints) between owners of one variant: to its first owner, or to the first that is near enough."""
    left, right = [], []
    for groups in slices(fps, bucket, depth, radius // 2):
        if sum(len(rows) for rows, _, _ in groups) < 2:
            continue
        mix = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        variants = np.concatenate([(base[:, None] ^ m).ravel() for _, base, m in groups])
        variants.sort()
        shared = np.unique(variants[1:][variants[1:] == variants[:-1]])
        del variants
        if not len(shared):
            continue
        # a second walk over the variants tells the owners of the shared ones; a bit table spares most searches
        seen = np.zeros(1 << 20, bool)
        seen[mix(shared)] = True
        at, who = [], []
        for rows, base, m in groups:
            for a in range(0, len(rows), 512):
                block = (base[a : a + 512, None] ^ m).ravel()
                near = np.flatnonzero(seen[mix(block)])
                place = np.searchsorted(shared, block[near])
                hit = (place < len(shared)) & (shared[np.minimum(place, len(shared) - 1)] == block[near])
                at.append(place[hit])
                who.append(rows[a + near[hit] // len(m)])
        at, who = np.concatenate(at), np.concatenate(who)
        order = np.lexsort((who, at))
        at, who = at[order], who[order]
        while len(at):
            first = who[np.searchsorted(at, at, side="left")]
            near = np.bitwise_count(fps[first] ^ fps[who]) <= radius
            linked = near & (first != who)
            pair = np.unique(first[linked] * len(fps) + who[linked])
            left.append(pair // len(fps))
            right.append(pair % len(fps))
            at, who = at[~near], who[~near]  # owners of a variant that are not near its first may be near each other
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number that each of n nodes reaches over the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v) between fingerprints of one component; at most one a fingerprint and bucket."""
    depth = depth_for(nodes.count(), bucket)
    heavy = heavy_buckets(nodes, depth, radius)

    def collide(group: pa.Table) -> pa.Table:
        fps, at, of = group.column("fp").to_numpy().view(np.uint64), group.column("bucket")[0].as_py(), group.column("depth")[0].as_py()
        fps = np.unique(fps)
        names = fps.view(np.int64)
        u, v = meetings(fps, at % (1 << 64), of, radius)
        label = local_components(len(fps), u, v)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table({"u": names[moved], "v": names[label[moved]]})

    return routed(nodes.select("fp"), depth, radius, heavy).groupBy("bucket", "depth").applyInArrow(collide, "u long, v long")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): component is the smallest key reachable over links of at most ``radius`` bits."""
    rows = materialise(fingerprints(documents, shingle, key, text), "fingerprints")
    files = files_for(rows.count())
    nodes = materialise(rows.groupBy("fp").agg(F.min(key).alias("first")), "nodes", files=files)
    roots = components(links(nodes, radius))
    joined = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("m", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    of_fp = materialise(joined.join(least, "root").select("fp", "component"), "components", files=files)
    return dealt_join(rows, of_fp, ["fp"], [key]).select(key, "fp", "component")


def majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(hashes)
    rows = np.asarray(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 8192):
        ones += np.unpackbits(rows[a : a + 8192], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The set of hashed shingles of a text, ascending."""
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= COPY_SHINGLE:
        return np.asarray([digest(joined, 0)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    return np.unique(np.asarray([digest(joined[a : b - 1], 0) for a, b in zip([0, *ends[:-COPY_SHINGLE]], ends[COPY_SHINGLE - 1 :], strict=True)], np.uint64))


def text_number(words: list[bytes]) -> int:
    """64 bits that name a sequence of words; zero names that of no words."""
    return xxhash.xxh64_intdigest(b" ".join(words), 1) if words else 0


_TURNS = np.random.default_rng(HASH_SEED).integers(1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of a set of hashes under each of BANDS * ROWS orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[a : a + 2048, None] * _TURNS[0] + _TURNS[1]).min(0), out=least)
    return least


def band_hashes(least: np.ndarray) -> np.ndarray:
    """One number for each band of each row of least hashes: [row, band]."""
    rows = (least ^ (least >> np.uint64(29))) * _TURNS[1]
    mixed = rows.reshape(-1, BANDS, ROWS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(32))


def texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, node, fp, bands): a hash of the text as it is, the number of its words, and, of texts with words, their shingle fingerprint and band hashes."""
    small_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, least = [], [], []
            for raw in batch.column(2).cast(pa.binary()).to_pylist():
                words = words_of(raw)
                nodes.append(text_number(words))
                hashes = shingle_hashes(words) if words else None
                fps.append(0 if hashes is None else majority(hashes))
                if hashes is not None:
                    least.append(least_hashes(hashes))
            bands = band_hashes(np.stack(least)).view(np.int64) if least else np.zeros((0, BANDS), np.int64)
            ends = np.cumsum([0, *[BANDS if n else 0 for n in nodes]], dtype=np.int32)
            longs = [pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))], names=[key, "h", "node", "fp", "bands"])

    return documents.select(key, F.xxhash64(text).alias("h"), text).where(F.col(key).isNotNull()).mapInArrow(run, f"`{key}` {kind}, h long, node long, fp long, bands array<long>")


def ball_candidates(nodes: DataFrame) -> DataFrame:
    """(u, v): nodes whose fingerprints meet in a ball: each with the least node of its fingerprint, and those of linked fingerprints."""
    least = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")), "least", files=files_for(nodes.count()))
    same = dealt_join(nodes.select("fp", "node"), least, ["fp"], ["node"]).select(F.col("node").alias("u"), F.col("least").alias("v"))
    met = links(least).join(least.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    return same.unionByName(met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).where("u <> v").distinct()


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(band, node, n): the bands that several nodes share, with their number of nodes."""
    bands = nodes.select("node", F.explode("bands").alias("band"))
    return dealt_join(bands, bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), ["band"], ["node"])


def band_candidates(shared: DataFrame) -> DataFrame:
    """(u, v): every node with the most central node of each band it shares: that which shares most bands with most others,
    as the text that a group was copied from does. Ties go to the least node."""
    weight = shared.groupBy("node").agg(F.sum("n").alias("w"))
    pivots = shared.join(weight, "node").groupBy("band").agg(F.max(F.struct("w", -F.col("node"))).alias("p")).select("band", (-F.col("p.col2")).alias("v"))
    return dealt_join(shared.select("band", "node"), pivots, ["band"], ["node"]).where("node <> v").select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()


def shingle_sets(documents: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(node, shingles): the set of hashed shingles of each wanted (node, first<key, h>), eight bytes each."""
    small_batches(documents.sparkSession)
    wanted = wanted.select("node", F.col(f"first.{key}").alias(key), F.col("first.h").alias("__h"))
    if wanted.count() <= BROADCAST_KEYS:  # texts then stay where they are
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(words_of(raw)).tobytes() for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    found = documents.select(key, F.xxhash64(text).alias("__h"), text).join(wanted, [key, "__h"]).select("node", text).mapInArrow(run, "node long, shingles binary")
    return materialise(found.dropDuplicates(["node"]), "shingles")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes, ascending, have the similarity of near copies."""
    if min(len(a), len(b)) * NEAR[1] < max(len(a), len(b)) * NEAR[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * NEAR[1] >= (len(a) + len(b) - both) * NEAR[0]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) whose sets of shingles are similar; a node of many pairs is dealt over tasks."""
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            keep = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    left = materialise(dealt_join(pairs, sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), ["u"], ["v"]), "pairs")
    both = dealt_join(left, sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), ["v"], ["u"])
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def sketches(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, sketch, size, bands): 16 bits of each least hash of the wanted (node, bands), and the bytes of the set."""
    small_batches(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(1).to_pylist()
            found = [(least_hashes(np.frombuffer(x, np.uint64)) >> np.uint64(20)).astype(np.uint16).tobytes() for x in every]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array([len(x) for x in every], pa.int64()), batch.column(2)], names=["node", "sketch", "size", "bands"])

    return sets.join(wanted, "node").select("node", "shingles", "bands").mapInArrow(run, "node long, sketch binary, size long, bands array<long>")


def worth_a_check(roots: np.ndarray, marks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rows of ``left`` and ``right`` that are plausibly similar to a row of the other side in another component."""
    found = np.zeros(len(roots), bool)
    for a in range(0, len(left), 32):
        rows = left[a : a + 32]
        near = ((marks[rows, None, :] == marks[None, right, :]).mean(2) >= PLAUSIBLE) & (roots[rows, None] != roots[None, right])
        found[rows[near.any(1)]] = True
        found[right[near.any(0)]] = True
    return np.flatnonzero(found)


def joining(band: int, nodes: np.ndarray, roots: np.ndarray, bands: list[set[int]], marks: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between rows of ``left`` and ``right`` whose sets are similar, as many as join the components of ``label``, which is changed.

    Every plausible pair of two components is checked, but in the least band that it shares only; pairs that others have joined need no check.
    """
    for i in left:
        share = (marks[i] == marks[right]).mean(1)
        near = np.flatnonzero((share >= PLAUSIBLE) & (label[right] != label[i]))
        for j in right[near[np.argsort(-share[near], kind="stable")]]:
            if label[i] != label[j] and min(bands[i] & bands[j]) == band and similar(sets[i], sets[j]):
                label[label == label[j]] = label[i]
                yield nodes[i], nodes[j]


def untried(shared: DataFrame, tried: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): similar nodes of different components that share a band, as many as join what is similar there.

    A node that is not similar to the central node of a band may be similar to another one there. Members of a band that are
    outside its largest component are compared with all its members by sketches, in blocks and in place; those with a plausible
    partner, a row each, meet again with their sets, and all their plausible pairs are checked in place. No list of pairs comes out.
    """
    crowd = dealt_join(shared.where("n > 2"), roots, ["node"], ["band"], "left").select("band", "node", F.coalesce("m", "node").alias("root"))
    crowd = materialise(crowd, "crowd", files=files_for(shared.count()))
    mains = crowd.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("k")).where("k > 1").select("band", F.col("most.root").alias("main"))
    mixed = materialise(dealt_join(crowd, mains, ["band"], ["node"]), "mixed", files=files_for(shared.count()))
    held = materialise(sketches(sets, mixed.groupBy("node").agg(F.collect_set("band").alias("bands"))), "sketches")
    rows = dealt_join(mixed, held, ["node"], ["band"])
    sizes = rows.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = dealt_join(rows.drop("size"), sizes, ["band"], ["node"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other", "blocks")

    def sides(group: pa.Table) -> tuple:
        nodes, roots, block = (group.column(n).to_numpy() for n in ("node", "root", "block"))
        a, b, main = (group.column(n)[0].as_py() for n in ("a", "b", "main"))
        marks = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(len(nodes), -1)
        minor, one, two = roots != main, block == a, block == b
        pairs = [(np.flatnonzero(minor & one), np.flatnonzero(two))]
        if a != b:
            pairs.append((np.flatnonzero(minor & two), np.flatnonzero(one)))
        return nodes, roots, marks, pairs

    def sift(group: pa.Table) -> pa.Table:
        _, roots, marks, pairs = sides(group)
        return group.take(np.unique(np.concatenate([worth_a_check(roots, marks, *p) for p in pairs])))

    def check(group: pa.Table) -> pa.Table:
        nodes, roots, marks, pairs = sides(group)
        bands = [set(x) for x in group.column("bands").to_pylist()]
        hashes = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        label = roots.copy()
        found = [x for p in pairs for x in joining(group.column("band")[0].as_py(), nodes, roots, bands, marks, hashes, *p, label)]
        u, v = np.asarray(found, np.int64).reshape(-1, 2).T
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    schema = "band long, node long, root long, main long, sketch binary, bands array<long>, block int, a int, b int"
    few = materialise(rows.select("band", "node", "root", "main", "sketch", "bands", "block", "a", "b").groupBy("band", "a", "b").applyInArrow(sift, schema), "sifted")
    met = dealt_join(few, sets, ["node"], ["band", "a", "b"]).groupBy("band", "a", "b").applyInArrow(check, "u long, v long").distinct()
    return met.join(tried, ["u", "v"], "left_anti")


def grouped(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, first<key, h>): each document by its key and the hash of its text, and the first document of its group of copies and near copies.

    Texts of equal words are one node. Nodes meet where their shingle fingerprints lie in a ball, and where a band of least hashes
    of their shingles agrees, which depends on the similarity only and not on the kind of edit; a link counts if the sets
    themselves have the similarity ``NEAR``.
    """
    rows = materialise(texts(documents, key, text), "texts")
    nodes = rows.groupBy("node").agg(F.min(F.struct(key, "h")).alias("first"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    nodes = materialise(nodes, "nodes", files=files_for(10 * rows.count()))
    files = files_for(nodes.count())
    shared = materialise(shared_bands(nodes), "shared", files=files)
    tried = materialise(ball_candidates(nodes).unionByName(band_candidates(shared)).distinct(), "candidates", files=files)
    met = shared.select("node").union(tried.select("u")).union(tried.select("v")).distinct()
    sets = shingle_sets(documents, materialise(nodes.select("node", "first").join(met, "node"), "met", files=files), key, text)
    # steps that hold sets or sketches run in all tasks; only their few rows are brought together
    found = materialise(verified(tried, sets).repartition(files), "links")
    roots = components(found).withColumnRenamed("u", "node")
    more = materialise(untried(shared, tried, roots, sets).repartition(files), "links")
    if not more.isEmpty():
        roots = components(found.unionByName(more)).withColumnRenamed("u", "node")
    joined = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("m", "node"))
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    of_node = materialise(joined.join(least, "root").select("node", F.col("least").alias("first")), "components", files=files)
    return materialise(dealt_join(rows.select(key, "h", "node"), of_node, ["node"], [key]).select(key, "h", "first"), "copies", files=files_for(rows.count()))


def copies(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component): groups of copies and near copies, for filtering; the component is the smallest key of the group."""
    return grouped(documents, key, text).select(key, F.col(f"first.{key}").alias("component"))


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of copies, that with the smallest key, with all its columns.

    Rows that repeat a key with other words are documents of their own; of rows that repeat key and text one stays.
    """
    groups = grouped(documents, key, text)
    gone = groups.where((F.col(key) != F.col(f"first.{key}")) | (F.col("h") != F.col("first.h"))).select(key, F.col("h").alias("__h")).distinct()
    if gone.count() <= BROADCAST_KEYS:  # texts then stay where they are
        gone = F.broadcast(gone)
    named = documents.withColumn("__h", F.xxhash64(text))
    kept = named.join(gone, [key, "__h"], "left_anti")
    # rows without a key belong to no group and stay
    again = materialise(groups.groupBy(key, F.col("h").alias("__h")).agg(F.count("*").alias("n")).where("n > 1").select(key, "__h"), "again", files=2)
    if again.isEmpty():
        return kept.select(*documents.columns)
    if again.count() <= BROADCAST_KEYS:
        again = F.broadcast(again)
    once = kept.join(again, [key, "__h"], "left_semi").dropDuplicates([key, "__h"])
    return kept.join(again, [key, "__h"], "left_anti").select(*documents.columns).unionByName(once.select(*documents.columns))


def op4_simhash_ball(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
