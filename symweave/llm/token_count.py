"""Token counts from a tokenizer compiled to finite-state transducers.

Two deterministic transducers count what the tokenizer's library would emit,
without making the tokens:

* the pre-token transducer reads character classes (with their look-ahead
  folded in) and marks where a pre-token begins. It has eight states, so each
  fixed chunk of the text stream has a small state map; the maps compose
  through a parallel prefix scan, which gives the state at the start of every
  chunk, however long the text or word.
* the merge transducer reads the bytes of one pre-token. A state holds, for
  every start that a vocabulary entry can still grow from, the entry before it
  and its count relative to now; the transition on a byte is annotated with the
  change in the number of tokens. It is compiled on demand and kept.

Character classes and valid neighbours come from the library itself.

Edge cases: null text counts as empty (0 bytes, 0 tokens); strings of special
tokens inside a text are one token each, as the library's default has it; ties,
repeated rows and further columns do not matter; texts are read whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from symweave.llm.common import small_batches, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512

END, LETTER, NUMBER, OTHER, JOIN, LONE, RUN, QUOTE1, QUOTE2 = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINED, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
STATES, CLASSES = 8, 16
CHUNK = 64
#: Merge states kept before the compiled part is dropped and rebuilt (1 KB each).
MAX_STATES = 100_000
#: Steps that all words of a batch take together; the rest of longer words is walked alone.
LOCKSTEP = 96


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pre_token_table() -> tuple[np.ndarray, np.ndarray]:
    """nxt[state, class] and begins[state, class] (a pre-token begins here), both flat."""
    nxt = np.zeros((STATES, CLASSES), np.uint8)
    begins = np.zeros((STATES, CLASSES), np.uint8)
    run_of = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}
    for s in range(STATES):
        for c, run in run_of.items():
            nxt[s, c], begins[s, c] = run, s not in (run, JOINED)
        for c, left in ((QUOTE1, ONE_LEFT), (QUOTE2, TWO_LEFT)):
            inside = s in (IN_OTHER, JOINED)
            nxt[s, c], begins[s, c] = (IN_OTHER, 0) if inside else (left, 1)
        nxt[s, JOIN], begins[s, JOIN] = JOINED, 1
        nxt[s, LONE], begins[s, LONE] = FRESH, 1
        nxt[s, RUN], begins[s, RUN] = IN_SPACE, s != IN_SPACE
    nxt[ONE_LEFT, LETTER], begins[ONE_LEFT, LETTER] = FRESH, 0
    nxt[TWO_LEFT, LETTER], begins[TWO_LEFT, LETTER] = ONE_LEFT, 0
    return nxt.ravel(), begins.ravel()


NEXT, BEGINS = _pre_token_table()


class Compiled:
    """Both transducers of one byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.kind = np.full(0x110000, 255, np.uint8)
        # the byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others follow from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.sign = [""] * 256
        for b in plain:
            self.sign[b] = chr(b)
        for n, b in enumerate(rest):
            self.sign[b] = chr(256 + n)
        of_sign = {s: b for b, s in enumerate(self.sign)}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.text: dict[int, str] = {}
        for word, i in self.vocab.items():
            if any(ch not in of_sign for ch in word):
                continue
            node = 0
            for ch in word:
                b = of_sign[ch]
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][b]
            self.token[node] = i
            self.text[i] = word
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.states: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.moves = np.full((1024, 256), -1, np.int32)

    def follows(self, a: int, b: int) -> bool:
        """Whether the library leaves the entries a and b as they are when they stand side by side."""
        if a < 0:
            return True
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = [t.id for t in self.library.model.tokenize(self.text[a] + self.text[b])] == [a, b]
        return found

    def compile(self, state: int, byte: int) -> int:
        """The packed transition (next state * 256 + change + 128) of a state on a byte."""
        grown, best = [], None
        for node, before, count in self.states[state]:
            child = self.children[node].get(byte)
            if child is not None:
                grown.append((child, before, count))
                t = self.token[child]
                if best is None and t >= 0 and self.follows(before, t):
                    best = (t, count + 1)
        assert best is not None, "every byte is an entry"
        t, change = best
        key = (*((c, b, n - change) for c, b, n in grown if self.children[c]), (0, t, 0))
        nxt = self.number.get(key)
        if nxt is None:
            nxt = self.number[key] = len(self.states)
            self.states.append(key)
            if nxt >= len(self.moves):
                self.moves = np.concatenate((self.moves, np.full_like(self.moves, -1)))
        packed = nxt * 256 + change + 128
        self.moves[state, byte] = packed
        return packed

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Letter, number, other or space (RUN) for each code point, asked of the library once per code point."""
        kind = self.kind
        out = kind[points]
        if (out == 255).any():
            pieces = self.library.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[out == 255]).tolist():
                c = chr(p)
                kind[p] = LETTER if len(pieces("a" + c)) == 1 else NUMBER if len(pieces("1" + c)) == 1 else OTHER if len(pieces("!" + c)) == 1 else RUN
            out = kind[points]
        return out

    def pre_tokens(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions at which a pre-token begins; ends marks the separators between texts."""
        n = len(points)
        cls = self.classes(points)
        cls[ends] = END
        after = np.concatenate((cls[1:], np.zeros(1, np.uint8)))
        space = cls == RUN
        last = space & (after != RUN) & (after != END)
        cls[last] = np.where(points[last] == 32, JOIN, LONE)
        quotes = np.flatnonzero(points == 39)
        if len(quotes):
            padded = np.concatenate((points, np.zeros(2, points.dtype)))
            padded[:n][ends] = 0
            a, b = padded[quotes + 1], padded[quotes + 2]
            cls[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = QUOTE1
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            cls[quotes[two]] = QUOTE2
        chunks = -(-n // CHUNK)
        grid = np.zeros(chunks * CHUNK, np.uint8)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        # state map of each chunk: where each of the states would be led
        maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1)).T.copy()
        for column in grid:
            maps = NEXT.take((maps << 4) | column)
        # inclusive parallel prefix scan of the maps under composition
        span = 1
        while span < chunks:
            maps[:, span:] = np.take_along_axis(maps[:, span:], maps[:, :-span], axis=0)
            span *= 2
        state = np.zeros(chunks, np.uint8)
        state[1:] = maps[FRESH, :-1]
        marks = np.empty((CHUNK, chunks), np.uint8)
        for j, column in enumerate(grid):
            at = (state << 4) | column
            marks[j] = BEGINS.take(at)
            state = NEXT.take(at)
        return np.flatnonzero(marks.T.ravel()[:n])

    def word_counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each word (bytes from starts, of sizes) through the merge transducer, all words in step."""
        if len(self.states) > MAX_STATES:
            self._reset()
        order = np.argsort(-np.minimum(sizes, 65535).astype(np.int32), kind="stable")
        first, left = starts[order], sizes[order]
        state = np.zeros(len(order), np.int64)
        count = np.zeros(len(order), np.int32)
        longest = int(left[0]) if len(left) else 0
        active = np.searchsorted(-left, -np.arange(min(longest, LOCKSTEP)), side="left")
        for j, n in enumerate(active.tolist()):
            byte = data[first[:n] + j]
            s = state[:n]
            at = s * 256 + byte
            packed = self.moves.ravel().take(at)
            if (missing := packed < 0).any():
                for k in np.unique(at[missing]).tolist():
                    self.compile(k >> 8, k & 255)
                packed = self.moves.ravel().take(at)
            state[:n] = packed >> 8
            count[:n] += (packed & 255) - 128
        for k in range(int((left > LOCKSTEP).sum())):
            s, total = int(state[k]), int(count[k])
            for byte in data[first[k] + LOCKSTEP : first[k] + left[k]].tolist():
                packed = int(self.moves[s, byte])
                if packed < 0:
                    packed = self.compile(s, byte)
                s, total = packed >> 8, total + (packed & 255) - 128
            count[k] = total
        out = np.empty(len(order), np.int32)
        out[order] = count
        return out

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        owners, parts, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if not t:
                continue
            pieces = [t]
            if self.special is not None and any(s in t for s in self.specials):
                pieces = self.special.split(t)
                extra[i] = len(pieces) - 1
            for p in pieces:
                if p:
                    owners.append(i)
                    parts.append(p)
        if not parts:
            return extra
        stream = "\0".join([*parts, ""])
        points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        begins = self.pre_tokens(points, ends)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate((np.zeros(1, np.int64), np.cumsum(width, dtype=np.int64)))
        data = np.frombuffer(stream.encode(), np.uint8)
        piece = np.searchsorted(ends, begins, side="right")
        stops = np.minimum(np.concatenate((begins[1:], [len(points)])), ends[piece])
        starts = offset[begins]
        words = self.word_counts(data, starts, offset[stops] - starts)
        totals = np.bincount(np.asarray(owners)[piece], weights=words, minlength=len(texts)).astype(np.int64)
        return totals + extra


_READY: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    """One compiled tokenizer for each worker process."""
    if path not in _READY:
        _READY[path] = Compiled(path)
    return _READY[path]


#: Characters counted together; a batch of longer texts is dealt into several groups.
GROUP_CHARS = 2_000_000


def counted(ready: Compiled, texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    at, size, begin = 0, 0, 0
    for at, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP_CHARS:
            out[begin : at + 1] = ready.counts(texts[begin : at + 1])
            begin, size = at + 1, 0
    out[begin:] = ready.counts(texts[begin:])
    return out


def count_tokens(documents: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every text, in one pass without a shuffle."""
    path = vocabulary or vocabulary_path()
    small_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = compiled(path)
        for batch in batches:
            column = batch.column(1)
            n = counted(ready, column.to_pylist())
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_fst_token_count(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
