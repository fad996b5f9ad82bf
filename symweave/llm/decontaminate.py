"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items are compiled into one automaton. A document's
words stream through it; the automaton keeps the length of the longest item
substring that ends at each word. Where that length reaches the window (or the
whole of an item shorter than a window), the words inside are hit.

Edge cases: null and empty texts have no words; items without words match
nothing; repeated rows are scored each on its own; an empty benchmark hits
nothing; other columns are ignored. Texts are always read whole.

The automaton is shipped to the executors, so its size is checked: items are
dealt into blocks of at most ``max_block_words`` words; with more than one
block each is scanned on its own and hit positions are merged per document. A
worker holds all blocks, so a benchmark of a million words takes it 830 MB.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import small_batches, table

WINDOW = 10
#: Words of benchmark text compiled into one automaton; a word takes about 830 bytes of memory on each worker.
MAX_BLOCK_WORDS = 200_000

#: ASCII letters fold to lower case; digits and bytes from 0x80 stay; the rest separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items that contain each window."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.nxt: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: list[str] = []
        ends: list[tuple[int, int]] = []  # (state, item) of each prefix
        short: dict[int, list[tuple[int, int]]] = {}  # state -> (length, item) of items below a window
        for key, words in items:
            if not words:
                continue
            item = len(self.ids)
            self.ids.append(str(key))
            last = 0
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                ends.append((last, item))
            if len(words) < window:
                short.setdefault(-1, []).append((len(words), item))
                short.setdefault(-2, []).append(tuple(self.vocab[w] for w in words))  # type: ignore[arg-type]
        self._finish(ends, list(zip(short.get(-1, []), short.get(-2, []), strict=True)))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.nxt, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.nxt, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _finish(self, ends: list[tuple[int, int]], short) -> None:
        n, window, link, length = len(self.nxt), self.window, self.link, self.length
        order = sorted(range(1, n), key=length.__getitem__)
        #: the ancestor that holds this state's suffix of one window
        at = [-1] * n
        for v in order:
            at[v] = v if length[v] >= window > length[link[v]] else at[link[v]] if length[v] >= window else -1
        holds: dict[int, set[int]] = {}
        for v, item in ends:
            if at[v] >= 0:
                holds.setdefault(at[v], set()).add(item)
        whole: dict[int, list[tuple[int, int]]] = {}
        for (size, item), ids in short:
            v = 0
            for c in ids:
                v = self.nxt[v][c]
            whole.setdefault(v, []).append((size, item))
        self.window_state = at
        self.window_items = {v: tuple(sorted(s)) for v, s in holds.items()}
        #: short items that are a suffix of the state, longest states inherit from their links
        tails: list[tuple[tuple[int, int], ...]] = [()] * n
        for v in order:
            tails[v] = (*whole.get(v, ()), *tails[link[v]])
        self.tails = tails
        self.shortest = min([window if self.window_items else 1 << 30, *(s for (s, _), _ in short)])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint ascending [start, end) runs of hit words, and the items whose windows occur."""
        if len(words) < self.shortest:
            return [], set()
        get = self.vocab.get
        ids = np.fromiter([get(w, -1) for w in words], np.int32, len(words))
        # only runs of words known to the items can hold a window
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        begins, ends = known[::2], known[1::2]
        keep = ends - begins >= self.shortest
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for b, e in zip(begins[keep].tolist(), ends[keep].tolist(), strict=True):
            self._run(ids[b:e].tolist(), b, spans, items)
        return spans, items

    def _run(self, ids: list[int], base: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        nxt, link, length, window, at, tails = self.nxt, self.link, self.length, self.window, self.window_state, self.tails
        v = size = 0
        for i, c in enumerate(ids):
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
            hit = 0
            if size >= window:
                hit = window
                items.update(self.window_items[at[v]])
            for need, item in tails[v]:
                if need <= size:
                    items.add(item)
                    hit = max(hit, need)
            if hit:
                start, end = base + i + 1 - hit, base + i + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))


def compile_benchmark(items: list[tuple[object, bytes | None]], window: int, max_block_words: int) -> list[SuffixAutomaton]:
    blocks: list[list[tuple[object, list[bytes]]]] = [[]]
    held = 0
    for key, text in items:
        words = words_of(text)
        if held and held + len(words) > max_block_words:
            blocks.append([])
            held = 0
        blocks[-1].append((key, words))
        held += len(words)
    return [SuffixAutomaton(b, window) for b in blocks]


def benchmark_items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> list[tuple[object, bytes | None]]:
    """Test items on the driver: a benchmark is a fixed published set, a few MB, not a corpus."""
    return [(r[0], bytes(r[1]) if r[1] is not None else None) for r in benchmark.select(key, F.col(text).cast("binary")).toLocalIterator()]


def scan_documents(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_words, n_hit, items, spans): spans are [start, end) character ranges of hit runs in the text.

    One pass over the documents, without a shuffle: every block of the benchmark goes over a text in turn.
    """
    spark = documents.sparkSession
    small_batches(spark)
    automata = compile_benchmark(benchmark_items(benchmark), window, max_block_words)
    sent = [spark.sparkContext.broadcast(pickle.dumps(a, pickle.HIGHEST_PROTOCOL)) for a in automata]
    kind = documents.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [pickle.loads(b.value) for b in sent]
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(raw)
                runs: list[tuple[int, int]] = []
                found: set[str] = set()
                for a in ready:
                    more, ids = a.scan(words)
                    runs += more
                    found.update(a.ids[i] for i in ids)
                runs = merge_runs(runs) if len(ready) > 1 else runs
                n_words.append(len(words))
                n_hit.append(sum(e - b for b, e in runs))
                items.append(sorted(found))
                spans.append(char_spans(raw, runs) if runs else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array([[{"start": b, "end": e} for b, e in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=[key, "n_words", "n_hit", "items", "spans"],
            )

    schema = f"`{key}` {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
    return documents.select(key, text).mapInArrow(scan, schema)


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(runs):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def char_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as character ranges of the text."""
    ends = [m.span() for m in _WORD.finditer(raw)]
    marks = sorted({p for b, e in runs for p in (ends[b][0], ends[e - 1][1])})
    chars, at, seen = {}, 0, 0
    for p in marks:
        seen += len(raw[at:p].decode())
        chars[p] = seen
        at = p
    return [(chars[ends[b][0]], chars[ends[e - 1][1]]) for b, e in runs]


def remove_spans(documents: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut every hit span out of its text, and drop documents of which more than ``max_coverage`` of the words is hit.

    All columns stay; clean documents are returned untouched. ``n_chars``, where there is one, follows the new text.
    """
    spark = documents.sparkSession
    small_batches(spark)
    automata = compile_benchmark(benchmark_items(benchmark), window, MAX_BLOCK_WORDS)
    sent = [spark.sparkContext.broadcast(pickle.dumps(a, pickle.HIGHEST_PROTOCOL)) for a in automata]
    at = documents.columns.index(text)
    chars = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [pickle.loads(b.value) for b in sent]
        for batch in batches:
            texts, keep, changed = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool), False
            for i, t in enumerate(texts):
                raw = t.encode() if t else b""
                words = words_of(raw)
                runs = merge_runs([r for a in ready for r in a.scan(words)[0]])
                if not runs:
                    continue
                if sum(e - b for b, e in runs) > max_coverage * len(words):
                    keep[i] = False
                    continue
                changed, last, parts = True, 0, []
                for b, e in char_spans(raw, runs):
                    parts.append(t[last:b])
                    last = e
                texts[i] = "".join([*parts, t[last:]])
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, pa.string())
                if chars is not None:
                    lengths = [None if t is None else len(t) for t in texts]
                    columns[chars] = pa.array(lengths, batch.column(chars).type)
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return documents.mapInArrow(cut, documents.schema)


def op8_suffix_decontam(spark, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM words, sizes WHERE len(w) >= k)),
found AS (SELECT d.r, d.k, d.p, i.item_id FROM doc_windows d JOIN item_windows i ON d.k = i.k AND d.gram = i.gram),
hits AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS pos FROM (SELECT DISTINCT r, k, p FROM found)) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits ON words.r = hits.r LEFT JOIN named ON words.r = named.r
"""


def items_digest(ids: Iterable[object]) -> str:
    """The digest of a set of item ids as the query gives it."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
