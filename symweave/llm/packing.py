"""Concatenate-and-cut packing of tokenised documents into fixed windows.

Pass one tokenises every document, ends it with a separator and writes the ids
once, each row with its place inside its partition. The token totals of the
partitions, one number each, give every partition its global offset by a prefix
sum. Pass two cuts the stream at multiples of the window: a document that
crosses a boundary leaves a piece on either side. Nothing is shuffled, and only
the last sequence is padded.

Edge cases: a null or empty text is its separator alone; repeated rows are
packed each on its own; an empty table gives no piece; further columns are
ignored; a document of any length is cut into as many pieces as it needs; there
are no ties, as places follow the order of the rows.
"""

from __future__ import annotations

import itertools
import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import materialise, small_batches, table

WINDOW = 1024
SEPARATOR = 0
VOCABULARY = "byte_bpe_50k.json"
#: The pre-token pattern of byte-level vocabularies of this family (fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}


def merged(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of a word when pairs are joined by least rank, ranks from ``below`` on left out."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def proven(model: dict) -> bool:
    """Whether joining pairs by the rank of what they make gives the ids that the file's own merges give, for every text.

    Both ways join the pair of least rank, the leftmost first. They agree if the merges stand in the order of the ids they make, and
    if the word of every id falls, under lesser ranks alone, into just the two parts that its merge names: then a pair that makes
    the word can only be that pair, as no join crosses the ends of a word before they meet. The test of the pre-token pattern is
    over all code points, in the tests.
    """
    core, pre = model["model"], model["pre_tokenizer"] or {}
    plain = not model["normalizer"] and core["type"] == "BPE" and not any(core.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    signs = byte_signs()
    ranks = {bytes(signs[c] for c in word): i for word, i in core["vocab"].items()}
    if sum(len(w) == 1 for w in ranks) != 256:
        return False
    last = -1
    for pair in core["merges"]:
        left, right = (bytes(signs[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
        rank = ranks.get(left + right, -1)
        if rank <= last or merged(left + right, ranks, rank) != [left, right]:
            return False
        last = rank
    return len(core["merges"]) + 256 == len(ranks)


_PROVEN: dict[str, tuple[bool, int]] = {}


def profile(path: str) -> tuple[bool, int]:
    """Whether the faster encoder is proven equal for this file, and the bytes of an id; told once, on the driver."""
    if path not in _PROVEN:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        most = max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]) if isinstance(model["model"]["vocab"], dict) else 1 << 16
        _PROVEN[path] = (proven(model), 2 if most < 1 << 16 else 4)
    return _PROVEN[path]


class Encoder:
    """Ids as the tokenizers library gives them.

    Where the file is ``proven``, tiktoken's encoder over the same vocabulary makes them, about three times as fast; texts with
    special strings, and all texts of other files, are encoded by the library itself.
    """

    def __init__(self, path: str, fast: bool, width: int):
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), "H" if width == 2 else "I"
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = None
        if fast:
            import tiktoken

            signs = byte_signs()
            ranks = {bytes(signs[c] for c in word): i for word, i in self.library.get_vocab(with_added_tokens=False).items()}
            self.fast = tiktoken.Encoding("byte-level", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.specials):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text."""
        return [array(self.kind, self.ids(t)).tobytes() if t else b"" for t in texts]


_READY: dict[tuple, Encoder] = {}


def _encoder(*wanted) -> Encoder:
    if wanted not in _READY:
        _READY[wanted] = Encoder(*wanted)
    return _READY[wanted]


def tokenised(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, before, n, ids): the ids with their separator, and the tokens before them in their partition."""
    small_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    fast, width = profile(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(vocabulary, fast, width), TaskContext.get().partitionId(), 0
        end = np.asarray([SEPARATOR], f"<u{width}").tobytes()
        for batch in batches:
            ids = [b + end for b in encoder.encode(batch.column(1).to_pylist())]
            n = np.fromiter((len(b) // width for b in ids), np.int64, len(ids))
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=[key, "part", "before", "n", "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, part int, before long, n long, ids binary")


def partition_offsets(stream: DataFrame) -> dict[int, int]:
    """Global offset of each partition: a prefix sum over one total a partition, all that the driver gathers."""
    totals = sorted((r[0], r[1]) for r in stream.groupBy("part").agg(F.sum("n")).collect())
    return dict(zip((p for p, _ in totals), itertools.accumulate((n for _, n in totals), initial=0), strict=False))


def cut(stream: DataFrame, window: int = WINDOW, key: str = "doc_id", with_ids: bool = False, width: int = 2) -> DataFrame:
    """Pieces of each document: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]); ids of ``width`` bytes."""
    offsets = partition_offsets(stream)
    sent = stream.sparkSession.sparkContext.broadcast(offsets)  # one number a partition
    kind = stream.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = sent.value
        for batch in batches:
            n = batch.column("n").to_numpy()
            begin = batch.column("before").to_numpy() + np.fromiter((base[p] for p in batch.column("part").to_pylist()), np.int64, len(n))
            first, last = begin // window, (begin + n - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(sequence * window, begin[row])
            stop = np.minimum((sequence + 1) * window, (begin + n)[row])
            inside = start - begin[row]
            length = stop - start
            ids = [np.frombuffer(b, f"<u{width}") for b in batch.column("ids").to_pylist()]
            cuts = [ids[r][a : a + m] for r, a, m in zip(row.tolist(), inside.tolist(), length.tolist(), strict=True)]
            crc = np.fromiter((zlib.crc32(c.astype("<u4")) for c in cuts), np.int64, len(cuts))
            columns = [batch.column(key).take(pa.array(row)), pa.array(inside), pa.array(length), pa.array(crc), pa.array(n[row]), pa.array(sequence), pa.array(start - sequence * window)]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([c.astype("<i4") for c in cuts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return stream.mapInArrow(run, schema)


def pack(documents: DataFrame, vocabulary: str | None = None, window: int = WINDOW, key: str = "doc_id", text: str = "text", encode: Callable | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise, concatenate and cut ``documents``."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path(VOCABULARY)
    stream = materialise((encode or tokenised)(documents, path, key, text), "token-stream")
    return cut(stream, window, key, with_ids, profile(path)[1])


def op5_concat_cut_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
