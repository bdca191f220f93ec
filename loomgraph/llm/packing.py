"""Packing token sequences into bins of a fixed length by swap-based local search.

Documents become token ids and an end id; only documents longer than a bin are cut. The pieces are
dealt out by a hash into groups of bounded size, and each group is packed by itself: first plainly,
each piece in turn into the last bin or a new one, then by local search. The search takes the fullest
bin that has room and, as long as it finds one, makes the step that brings it the most length from
bins that are no fuller: a piece moves, or is exchanged one for one, or two for one. So every step
raises the sum of squared fills, and the emptiest bins lose piece after piece until they are empty.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, shards_for, written

BIN = 2048
#: Pieces that are packed together, in one task's memory.
GROUP_PIECES = 8192
#: Of so many of the emptiest bins, pairs of pieces are tried in an exchange of two for one.
PAIR_BINS = 32
#: Words whose ids a worker remembers; then it starts afresh.
REMEMBERED = 1_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Words(dict):
    """Ids of words, as bytes, found out when they are first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if word[-1:] in (".", ",") and word[:-1].lower().isalpha():  # letters and marks are never merged
            ids = self[word[:-1]] + self[word[-1]]
        elif word.isalpha() and word.isascii() and not word.islower():
            ids = self[word.lower()]
        else:
            ids = np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids


# How a tokenizer's file says that it lower-cases, drops white space and never joins words.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def word_by_word(path: str) -> bool:
    """Whether a text's ids are those of its words one after the other, by the tokenizer's own file."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    added = all(not any(c.isspace() for c in x["content"]) and not x["lstrip"] and not x["rstrip"] for x in parts["added_tokens"])
    return added and parts["normalizer"] == WORD_NORMALIZER and parts["pre_tokenizer"] == WORD_SPLIT and parts["post_processor"] is None


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    With a tokenizer that is told to go word by word, a text's ids are those of its words, and a word
    is encoded once; with any other, whole texts are encoded.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.words = word_by_word(path)
        self.tokenizer, self.remembered, self.known = tokenizer, remembered, _Words(tokenizer.encode)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        get = known.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


@lru_cache(maxsize=1)
def word_encoder(path: str, remembered: int) -> WordEncoder:
    """One for all tasks of a Python worker, which come one after the other."""
    return WordEncoder(path, remembered)


def document_pieces(docs: DataFrame, tokenizer: str, most: int = BIN, end_id: int = 0, remembered: int = REMEMBERED, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]) of documents(doc_id, text).

    Null and empty texts are the end id alone; repeated rows give their pieces each; other columns are
    ignored.
    """

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
    names_ = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, remembered)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for lo in range(0, len(texts), 256):
                for doc_id, ids in zip(names[lo : lo + 256], encoder.encode(texts[lo : lo + 256]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[at : at + 4 * most]
                        row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, part) if with_ids else row)
            columns = list(zip(*rows, strict=True)) or [()] * len(names_)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names_)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(plain, cut, PIECE + ", ids binary" * with_ids)


Piece = tuple[int, int]  # (length, number)


class Bins:
    """Pieces in bins, at first in turn. A bin at work is taken out of ``open``; ``loose`` has the pieces
    of the bins that are in it."""

    def __init__(self, lengths: list[int], size: int):
        self.size = size
        self.items: list[list[Piece]] = []
        self.fill: list[int] = []
        self.home = [0] * len(lengths)  # of each piece: its bin
        for i, n in enumerate(lengths):
            if not self.items or self.fill[-1] + n > size:
                self.items.append([])
                self.fill.append(0)
            self.items[-1].append((n, i))
            self.fill[-1] += n
            self.home[i] = len(self.items) - 1
        self.open = sorted((f, b) for b, f in enumerate(self.fill) if f < size)
        self.loose = sorted(x for _, b in self.open for x in self.items[b])
        self.steps = {"move": 0, "one for one": 0, "two for one": 0}

    def take_fullest(self) -> int:
        _, b = self.open.pop()
        for x in self.items[b]:
            del self.loose[bisect_left(self.loose, x)]
        return b

    def _longest(self, most: int) -> Piece | None:
        k = bisect_left(self.loose, (most + 1, -1)) - 1
        return self.loose[k] if k >= 0 else None

    def best_step(self, b: int) -> tuple[int, tuple[Piece, ...], tuple[Piece, ...]]:
        """(length gained, pieces out, pieces in) of the step that brings bin b the most."""
        room = self.size - self.fill[b]
        best: tuple[int, tuple[Piece, ...], tuple[Piece, ...]] = (0, (), ())
        if x := self._longest(room):
            best = (x[0], (), (x,))
        for y in self.items[b]:
            if best[0] < room and (x := self._longest(y[0] + room)) and x[0] - y[0] > best[0]:
                best = (x[0] - y[0], (y,), (x,))
        if best[0] < room:  # two pieces of one bin, one of the emptiest, for one of this
            for _, s in self.open[:PAIR_BINS]:
                for first, second in combinations(self.items[s], 2):
                    both = first[0] + second[0]
                    for y in self.items[b]:
                        if best[0] < both - y[0] <= room:
                            best = (both - y[0], (y,), (first, second))
        return best

    def exchange(self, b: int, out: tuple[Piece, ...], into: tuple[Piece, ...]) -> None:
        """``into``, of one open bin, goes to bin b, which is not open; ``out`` goes the other way."""
        s = self.home[into[0][1]]
        del self.open[bisect_left(self.open, (self.fill[s], s))]
        for x in into:
            self.items[s].remove(x)
            del self.loose[bisect_left(self.loose, x)]
            self.items[b].append(x)
            self.home[x[1]] = b
        for x in out:
            self.items[b].remove(x)
            self.items[s].append(x)
            insort(self.loose, x)
            self.home[x[1]] = s
        gain = sum(x[0] for x in into) - sum(x[0] for x in out)
        self.fill[b] += gain
        self.fill[s] -= gain
        if self.fill[s]:
            insort(self.open, (self.fill[s], s))
        self.steps["two for one" if len(into) == 2 else "one for one" if out else "move"] += 1

    def improve(self) -> None:
        """Each bin is at work once, the fullest first, until it is full or no step brings it more."""
        while self.open:
            b = self.take_fullest()
            while self.fill[b] < self.size:
                gain, out, into = self.best_step(b)
                if not gain:
                    break
                self.exchange(b, out, into)


def pack_lengths(lengths: list[int], size: int = BIN) -> list[int]:
    """The bin of each piece."""
    bins = Bins(lengths, size)
    bins.improve()
    return bins.home


def pack_pieces(pieces: DataFrame, seed: int = 0, size: int = BIN, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, start, length, ...), written to a table.

    Full pieces are bins by themselves. The others are dealt into groups by a hash of their arrival,
    so that repeated rows spread too. Sequence numbers are unique, not gapless; an empty table gives
    an empty result.
    """
    whole = pieces.filter(F.col("length") == size).withColumns({"sequence_id": F.lit(-1).cast("long"), "offset": F.lit(0).cast("long")})
    part = pieces.filter(F.col("length") != size)
    n = part.count()
    groups = shards_for(n, group_pieces)
    names = part.columns
    dealt = part.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)))
    schema = part.schema.add("sequence_id", "long").add("offset", "long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks().sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
            group = table.column("__group")[0].as_py()
            lengths = table.column("length").to_pylist()
            bins = pack_lengths(lengths, size)
            used: dict[int, int] = {}
            offsets = []
            for b, length in zip(bins, lengths, strict=True):
                offsets.append(used.get(b, 0))
                used[b] = offsets[-1] + length
            table = table.select(names)
            table = table.append_column("sequence_id", pa.array([(group << 24) + b for b in bins], pa.int64()))
            yield from table.append_column("offset", pa.array(offsets, pa.int64())).to_batches()
            held.clear()

        for batch in batches:  # sorted by group
            group = np.asarray(batch.column("__group"))
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if held and held[0].column("__group")[0].as_py() != group[lo]:
                    yield from flush()
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush()

    packed = in_arrow(dealt.repartition(groups, "__group").sortWithinPartitions("__group"), pack, schema)
    # full pieces get negative numbers of their own
    own = -1 - F.monotonically_increasing_id()
    return packed.unionByName(whole.withColumn("sequence_id", own))


def pack_documents(docs: DataFrame, tokenizer: str, seed: int = 0, size: int = BIN, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of documents(doc_id, text).

    Each row is a piece and its place in the packed sequences; see document_pieces and pack_pieces.
    Without ``with_ids`` only the pieces' lengths and checksums travel, not the ids.
    """
    pieces = written(document_pieces(docs, tokenizer, size, remembered=remembered, with_ids=with_ids), "pieces")
    return pack_pieces(pieces, seed, size)
