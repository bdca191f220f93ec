"""Token counts of whole texts, encoded in overlapping chunks that are resynchronised.

A text becomes chunks that overlap, each encoded once with offsets. Two neighbours are spliced at a
stable common boundary in their overlap: a single space within a line at which both have a token
begin, with the tokens on both sides of it alike in both. Such a place is proven to be a boundary of
the whole text's encoding for tokenizers that never have a token go on to a space: their pieces (words,
numbers or marks, with their leading space) are merged apart from each other, whatever precedes them.
``spaced`` tells these tokenizers by their files; with any other, whole texts are encoded. Where an overlap has
no such place, the later chunk begins earlier and earlier, at last where the text begins.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Characters of a chunk, and of the overlap with the one before it.
CHUNK_CHARS = 2048
OVERLAP_CHARS = 64
#: Tokens that must agree, one by one and in place, on both sides of a splice.
STABLE_TOKENS = 3
BATCH_CHARS = 1 << 20

#: A space after what is no white space and before a visible ASCII character: a piece ends before it.
_BOUNDARY = re.compile(r"(?<=\S) (?=[!-~])")


class Encoded:
    """A chunk's encoding: its length in tokens, and the tokens at and around a character."""

    def __init__(self, ids, starts=None, encoding=None):
        self.ids, self.starts, self.encoding = ids, starts, encoding
        self.n = len(encoding) if encoding is not None else len(ids)

    def token_at(self, char: int) -> int | None:
        """The token that begins at the character, or None."""
        if self.encoding is None:
            k = bisect_left(self.starts, char)
            return k if k < self.n and self.starts[k] == char else None
        k = self.encoding.char_to_token(char)
        return k if k is not None and self.encoding.token_to_chars(k)[0] == char else None

    def around(self, k: int) -> tuple[list[int], list[int]]:
        """Ids and starts of a few tokens before token k and from it on."""
        lo, hi = max(0, k - STABLE_TOKENS), min(self.n, k + STABLE_TOKENS)
        if self.ids is None:
            self.ids = self.encoding.ids
        if self.encoding is None:
            return self.ids[lo:hi], self.starts[lo:hi]
        return self.ids[lo:hi], [self.encoding.token_to_chars(i)[0] for i in range(lo, hi)]


def spaced(path: str) -> bool:
    """Whether no token of the tokenizer goes on past a space: byte-level pieces split by the usual
    pattern and no normaliser, or sentence pieces of which none has a space mark after another character."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return all("\u2581" not in processor.id_to_piece(i).lstrip("\u2581") for i in range(processor.vocab_size()))
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    split = parts.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and parts.get("normalizer") is None
    return plain and not any(" " in x["content"] for x in parts.get("added_tokens", ()))


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """(encode(texts) -> list of Encoded, count(texts) -> counts, are tokens proven to end at spaces)"""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)

        def one(text: str) -> Encoded:
            pieces = processor.encode(text, return_type="proto").pieces
            data = np.frombuffer(text.encode(), np.uint8)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
            return Encoded([p.id for p in pieces], chars[[p.begin for p in pieces]].tolist())

        return lambda texts: [one(t) for t in texts], lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)], spaced(path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(texts: list[str]) -> list[Encoded]:
        return [Encoded(None, encoding=e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return encode, lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], spaced(path)


def splice(text: str, left: Encoded, left_at: int, right: Encoded, right_at: int, end: int) -> tuple[int, int] | None:
    """Token counts (of ``left``, of ``right``) before the middlemost place of the overlap, from
    ``right_at`` to ``end``, at which both are the same; None if there is none. Chunks begin at
    ``left_at`` and ``right_at`` of the text."""
    middle = (right_at + end) // 2
    for place in sorted((m.start() for m in _BOUNDARY.finditer(text, right_at + 1, end)), key=lambda p: abs(p - middle)):
        k, j = left.token_at(place - left_at), right.token_at(place - right_at)
        if not k or not j:
            continue
        (ids, starts), (other, others) = left.around(k), right.around(j)
        before, after = min(k, j, STABLE_TOKENS), min(left.n - k, right.n - j, STABLE_TOKENS)
        at, to = min(k, STABLE_TOKENS), min(j, STABLE_TOKENS)
        same = ids[at - before : at + after] == other[to - before : to + after]
        if same and [s + left_at for s in starts[at - before : at + after]] == [s + right_at for s in others[to - before : to + after]]:
            return k, j
    return None


def chunk_places(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of each chunk of a text of n characters; the last one is not a mere overlap."""
    if n <= chunk + overlap:
        return [(0, n)]
    count = -(-(n - overlap) // chunk)
    return [(k * chunk, min(n, (k + 1) * chunk + overlap)) for k in range(count)]


def count_spliced(text: str, places: list[tuple[int, int]], parts: list[Encoded], encode, overlap: int) -> tuple[int, int]:
    """(tokens of the text, chunks that had to be widened) from its chunks' encodings."""
    total, skip, widened = 0, 0, 0  # `skip` tokens of the chunk at hand are counted already
    for k in range(len(places) - 1):
        (left_at, end), (right_at, right_end), wide = places[k], places[k + 1], overlap
        while (found := splice(text, parts[k], left_at, parts[k + 1], right_at, end)) is None or found[0] < skip:
            # the later chunk begins earlier; where it takes in the one before, that one's splice is its own
            wide, widened = 2 * wide, widened + 1
            right_at = max(left_at, end - wide)
            parts[k + 1], places[k + 1] = encode([text[right_at:right_end]])[0], (right_at, right_end)
            if right_at == left_at:
                found = (skip, skip)
                break
        total += found[0] - skip
        skip = found[1]
    return total + parts[-1].n - skip, widened


def count_resynchronised(text: str, encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of one text by overlapping chunks."""
    if not text:
        return 0
    places = chunk_places(len(text), chunk, overlap)
    return count_spliced(text, places, encode([text[a:b] for a, b in places]), encode, overlap)[0]


def count_huge(text: str, places: list[tuple[int, int]], encode, overlap: int, run: int = 256) -> int:
    """The tokens of a huge text, a run of chunks at a time: runs share a chunk, which the first counts
    up to its splice with the next and the second from there on."""
    total, lo = 0, 0
    carried: Encoded | None = None
    while True:
        hi = min(len(places), lo + run)
        own = places[lo:hi]
        parts = encode([text[a:b] for a, b in own[carried is not None :]])
        parts = parts if carried is None else [carried, *parts]
        counted = count_spliced(text, own, parts, encode, overlap)[0]
        if hi == len(places):
            return total + counted
        # the last chunk is counted whole here and again as the next run's first
        total += counted - parts[-1].n
        carried, places[hi - 1], lo = parts[-1], own[-1], hi - 1


def token_counts(docs: DataFrame, tokenizer: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_chunks) of documents(doc_id, text): tokens of the whole text.

    Null and empty texts have none; special strings inside texts count as the library has them by
    default; repeated rows are counted each; an empty table gives an empty result; other columns are
    ignored. Rows stream through in Arrow batches; texts are encoded about a million characters at a
    time.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, n_chunks long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, count_whole, proven = load_tokenizer(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_tokens, n_chunks = [0] * len(texts), [0] * len(texts)
            held: list[tuple[int, list[tuple[int, int]]]] = []

            def flush(held=held, texts=texts, n_tokens=n_tokens) -> None:
                parts = encode([texts[i][a:b] for i, places in held for a, b in places])
                at = 0
                for i, places in held:
                    n = len(places)
                    n_tokens[i] = parts[at].n if n == 1 else count_spliced(texts[i], places, parts[at : at + n], encode, overlap)[0]
                    at += n
                held.clear()

            chars = 0
            for i, text in enumerate(texts):
                if not text:
                    continue
                if not proven:
                    n_tokens[i], n_chunks[i] = count_whole([text])[0], 1
                    continue
                # a huge text goes by in runs of chunks, so that few encodings are held at once
                places = chunk_places(len(text), chunk, overlap)
                n_chunks[i] = len(places)
                if len(text) > BATCH_CHARS:
                    n_tokens[i] = count_huge(text, places, encode, overlap)
                    continue
                held.append((i, places))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    flush()
                    chars = 0
            if held:
                flush()
            columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in ([len(t.encode()) for t in texts], n_tokens, n_chunks))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(plain, count, schema)
