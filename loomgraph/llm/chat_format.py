"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered to one string, with the character span of every turn's text, and
encoded once with offsets. A token is trained on if its span meets an assistant turn's span; both
lists are sorted, so each turn's first and last token are found by binary search.

The template is ``<|turn|>role<|text|>text<|end|>`` for each turn. Markers are tokens of their own,
so no token spans a marker and a text. Inside roles and texts every control string - all of the
template and the common ones of other templates - gets a backslash after its first character, and
one that has backslashes there gets one more, so the escape can be undone whatever a text holds.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings as (first character, rest); no rest holds a first character.
CONTROL = (("<", "|"), ("<", "s>"), ("<", "/s>"), ("[", "INST]"), ("[", "/INST]"))
_REST = "|".join(re.escape(rest) for _, rest in CONTROL if rest != "INST]" and rest != "/INST]")
_INST = "|".join(re.escape(rest) for _, rest in CONTROL if rest in ("INST]", "/INST]"))
_PLAIN = re.compile(rf"(<)(\\*)({_REST})|(\[)(\\*)({_INST})")
_ESCAPED = re.compile(rf"(<)\\(\\*)({_REST})|(\[)\\(\\*)({_INST})")
_PARSE = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}" if m[1] else f"{m[4]}\\{m[5]}{m[6]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"{m[1]}{m[2]}{m[3]}" if m[1] else f"{m[4]}{m[5]}{m[6]}", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's (escaped) text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: what ``render`` was given."""
    return [(unescape(m[1]), unescape(m[2])) for m in _PARSE.finditer(formatted)]


@dataclass
class Encoded:
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    mask: np.ndarray  # of each token: is it trained on


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    """The tokenizer with the template's markers as tokens of their own, after its other ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return tokenizer


def encode(tokenizer, formatted: list[str], trained: list[list[tuple[int, int]]]) -> list[Encoded]:
    """Ids, offsets and mask of each string; ``trained`` has each one's sorted spans to train on."""
    out = []
    for e, spans in zip(tokenizer.encode_batch(formatted, add_special_tokens=False), trained, strict=True):
        ids = np.array(e.ids, np.int32)
        offsets = np.fromiter(chain.from_iterable(e.offsets), np.int32, 2 * len(ids))
        starts, ends = offsets[0::2], offsets[1::2]
        mask = np.zeros(len(ids), np.int8)
        lo, hi = np.array([s for s in spans if s[0] < s[1]], np.int32).reshape(-1, 2).T
        for first, last in zip(np.searchsorted(ends, lo, "right").tolist(), np.searchsorted(starts, hi, "left").tolist(), strict=True):
            mask[first:last] = 1
        out.append(Encoded(ids, starts, ends, mask))
    return out


def masked_spans(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """The character spans under the mask, in order; tokens of one character's bytes count it once."""
    on = mask.astype(bool)
    lo, hi = starts[on], np.maximum.accumulate(ends[on])
    if not len(lo):
        return []
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    last = np.concatenate([first[1:], [len(lo)]]) - 1
    return list(zip(lo[first].tolist(), hi[last].tolist(), strict=True))


FORMATTED = "conv_id long, formatted string, ids array<int>, offsets array<struct<start:int,end:int>>, loss_mask array<byte>"


def conversations_of(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) gathered by conversation and sorted in it: null turns first,
    ties by role, then text. Null roles and texts are empty; a null conv_id is one conversation."""
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    started, name, turns = False, None, []
    for batch in batches:
        for conv_id, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if started and conv_id != name:
                yield name, turns
                turns = []
            started, name = True, conv_id
            turns.append((role, text))
    if started:
        yield name, turns


BATCH_CHARS = 1 << 20


def format_conversations(rows: DataFrame, tokenizer: str, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(conv_id, formatted, ids, offsets, loss_mask) of rows(conv_id, turn, role, text); see
    conversations_of for nulls and ties. Repeated rows are repeated turns; an empty table gives an
    empty result; other columns are ignored. A conversation is held whole, and conversations are
    encoded about a million characters at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chat_tokenizer(tokenizer)
        types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int8())]

        def flush(held: list) -> pa.RecordBatch:
            encoded = encode(encoder, [x[1] for x in held], [x[2] for x in held])
            counts = pa.array(list(accumulate((len(e.ids) for e in encoded), initial=0)), pa.int32())
            flat = lambda parts: pa.array(np.concatenate(list(parts)))
            places = pa.StructArray.from_arrays([flat(e.starts for e in encoded), flat(e.ends for e in encoded)], fields=list(types[3].value_type))
            columns = [
                pa.array([x[0] for x in held], types[0]),
                pa.array([x[1] for x in held], types[1]),
                pa.ListArray.from_arrays(counts, flat(e.ids for e in encoded)),
                pa.ListArray.from_arrays(counts, places),
                pa.ListArray.from_arrays(counts, flat(e.mask for e in encoded)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "ids", "offsets", "loss_mask"])

        held, chars = [], 0
        for conv_id, turns in _conversations(batches):
            formatted, spans = render(turns)
            held.append((conv_id, formatted, [s for s, (role, _) in zip(spans, turns, strict=True) if role == trained_role]))
            chars += len(formatted)
            if chars >= BATCH_CHARS:
                yield flush(held)
                held, chars = [], 0
        if held:
            yield flush(held)

    return in_arrow(conversations_of(rows), run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars), taken from the string and the mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            offsets, masks = batch.column("offsets"), batch.column("loss_mask")
            bounds, mask_bounds = np.asarray(offsets.offsets), np.asarray(masks.offsets)
            starts, ends = (np.asarray(offsets.values.field(x)) for x in ("start", "end"))
            mask = np.asarray(masks.values)
            for k, (conv_id, text) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True)):
                turns = parse(text)
                at = slice(bounds[k], bounds[k + 1])
                spans = masked_spans(starts[at], ends[at], mask[mask_bounds[k] : mask_bounds[k + 1]])
                loss = "".join(unescape(text[lo:hi]) for lo, hi in spans)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_arrow(formatted, run, schema)
