"""Quality of documents by a linear-chain conditional random field over their lines.

Every line gets features of its own and of its neighbours. The field labels each line good or bad;
forward-backward gives each line's marginal probability, and a document's quality is the mean of its
lines' marginals, weighted by length, brought to the scale of the documents' labels.

Only documents are labelled, so lines are latent: those of good documents are good, and a classifier
of single lines, trained on their documents' labels and then on its own findings, says which lines of
bad documents are. Bad documents thus teach the field how good and bad lines follow one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow
from .text_arrays import span_hashes, text_slices, words_of

#: Documents that the field is trained on at most, and lines of them all together: documents are taken
#: whole, with all their lines, as long as these suffice (31 numbers of 4 bytes each a line).
TRAINING_DOCUMENTS = 4000
TRAINING_LINES = 500_000
THRESHOLD = 0.7

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#*$%&<>=+^~@_\\/{}[]"]] = True
_PIPE = np.zeros(256, bool)
_PIPE[ord("|")] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord("!"), ord("?")]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\"')"]] = True
_STOP[128:] = True

OWN = ("bias", "length", "capitals", "marks", "pipes", "shouts", "digits", "no_letters", "repeated_word", "long_words", "no_stop", "seen_line", "few_distinct")
#: Of these, a line also has those of the line before and of the line after.
SHARED = ("capitals", "marks", "pipes", "shouts", "digits", "repeated_word", "seen_line", "few_distinct")
FEATURES = (*OWN, *(f"{x}_before" for x in SHARED), *(f"{x}_after" for x in SHARED), "first", "last")


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, row, bytes) of every line with a word, over texts joined in ``data``."""
    starts, ends = words_of(data, bounds)
    if not len(starts):
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, bounds]))
    line_of = np.searchsorted(breaks, starts, "right")
    first_word = np.flatnonzero(np.concatenate([[True], np.diff(line_of) > 0]))
    last_word = np.concatenate([first_word[1:], [len(starts)]]) - 1
    lo, hi = starts[first_word], ends[last_word]
    n = (hi - lo).astype(np.float64)
    n_words = (last_word - first_word + 1).astype(np.float64)
    row = np.searchsorted(bounds, lo, "right") - 1

    def share(table: np.ndarray) -> np.ndarray:  # white space between lines is in no table
        return np.add.reduceat(table[data], lo, dtype=np.int64) / n

    hashes = span_hashes(data, starts, ends)
    same = np.zeros(len(starts))
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    repeated = np.maximum(np.add.reduceat(same, first_word) - 1, 0) / n_words  # one may be chance
    line_no = np.repeat(np.arange(len(lo)), (last_word - first_word + 1))
    order = np.lexsort((hashes, line_no))
    fresh = np.ones(len(starts))
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_no[order][1:] != line_no[order][:-1])
    distinct = np.add.reduceat(fresh, first_word) / n_words
    expected = np.minimum(1.0, 2.2 / np.log1p(n_words))  # long lines of prose repeat their short words
    with np.errstate(over="ignore"):
        line_hash = np.add.reduceat(hashes * (2 * (np.arange(len(starts)) - np.repeat(first_word, last_word - first_word + 1)) + 1).astype(np.uint64), first_word)
    order = np.lexsort((lo, line_hash, row))
    seen = np.zeros(len(lo))
    seen[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (row[order][1:] == row[order][:-1])
    letters = share(_LETTER)
    step = lambda x, least, full: np.clip((x - least) / (full - least), 0, 1)
    own = {
        "bias": np.ones(len(lo)),
        "length": np.minimum(np.log1p(n), 8) / 8,
        "capitals": step(share(_UPPER) / np.maximum(letters, 1e-9), 0.1, 0.4) * (n > 20),
        "marks": step(share(_MARKS), 0.01, 0.08),
        "pipes": step(share(_PIPE), 0.004, 0.04),
        "shouts": step(share(_SHOUT), 0.01, 0.06),
        "digits": step(share(_DIGIT), 0.1, 0.4),
        "no_letters": step(1 - letters, 0.35, 0.7),
        "repeated_word": step(repeated, 0.04, 0.3),
        "long_words": step(n / n_words, 12, 30),
        "no_stop": (~_STOP[data[hi - 1]]).astype(float),
        "seen_line": seen,
        "few_distinct": step(expected - distinct, 0.0, 0.3),
    }
    before = np.concatenate([[False], row[1:] == row[:-1]])
    after = np.concatenate([row[1:] == row[:-1], [False]])
    columns = [own[x] for x in OWN]
    columns += [np.where(before, np.roll(own[x], 1), 0.0) for x in SHARED]
    columns += [np.where(after, np.roll(own[x], -1), 0.0) for x in SHARED]
    columns += [(~before).astype(float), (~after).astype(float)]
    return np.stack(columns, 1).astype(np.float32), row, n.astype(np.int64)


class Chains:
    """Lines of many documents, laid out so that step t is one array over the documents that have it."""

    def __init__(self, row: np.ndarray):
        self.rows, start, count = np.unique(row, return_index=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        self.rows, self.start, self.count = self.rows[order], start[order], count[order]
        longest = int(self.count[0]) if len(self.count) else 0
        self.active = np.searchsorted(-self.count, -np.arange(longest), "left") if longest else np.zeros(0, int)
        self.active = np.array([int(np.sum(self.count > t)) for t in range(longest)]) if longest < 64 else len(self.count) - np.searchsorted(self.count[::-1], np.arange(longest), "right")


def _log_ratio(x: np.ndarray, low0: float, low1: float, high0: float, high1: float) -> np.ndarray:
    """log((e^high0 + e^(x + high1)) / (e^low0 + e^(x + low1)))"""
    return np.logaddexp(high0, x + high1) - np.logaddexp(low0, x + low1)


def forward_backward(emission: np.ndarray, chains: Chains, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good over bad from the lines up to each, and from those after it."""
    ahead, behind = emission.astype(np.float64).copy(), np.zeros(len(emission))
    for k in range(1, len(chains.active)):
        at = chains.start[: chains.active[k]] + k
        ahead[at] += _log_ratio(ahead[at - 1], t[0, 0], t[1, 0], t[0, 1], t[1, 1])
    for k in range(len(chains.active) - 2, -1, -1):
        at = chains.start[: chains.active[k + 1]] + k
        behind[at] = _log_ratio(emission[at + 1] + behind[at + 1], t[0, 0], t[0, 1], t[1, 0], t[1, 1])
    return ahead, behind


def train(x: np.ndarray, row: np.ndarray, good: np.ndarray, steps: int = 400, rate: float = 0.1, penalty: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the penalised likelihood of the lines' labels; ``row``
    is in order, ``good`` has a label for each line."""
    chains = Chains(row)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    pairs = np.flatnonzero(row[1:] == row[:-1])
    counted = np.zeros((2, 2))
    np.add.at(counted, (good[pairs], good[pairs + 1]), 1)
    params, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    scale = max(1, len(chains.rows))
    for step in range(1, steps + 1):
        w, t = params[:-4], params[-4:].reshape(2, 2)
        emission = x @ w
        ahead, behind = forward_backward(emission, chains, t)
        p = 1 / (1 + np.exp(-np.clip(ahead + behind, -500, 500)))
        grad_w = x.T @ (good - p)
        right = (emission + behind)[pairs + 1]
        left = ahead[pairs]
        scores = np.stack([np.full(len(pairs), t[0, 0]), right + t[0, 1], left + t[1, 0], left + right + t[1, 1]], 1)
        scores -= scores.max(1, keepdims=True)
        both = np.exp(scores)
        both /= both.sum(1, keepdims=True)
        grad = np.concatenate([grad_w, counted.ravel() - both.sum(0)]) / scale - penalty * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.1, penalty: float = 1e-4) -> np.ndarray:
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, steps + 1):
        grad = x.T @ (y - _probability(x @ w)) / max(1, len(x)) - penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -500, 500)))


def line_labels(x: np.ndarray, row: np.ndarray, good: np.ndarray, rounds: int = 2) -> np.ndarray:
    """A label for each line from its document's (``good``, by row): lines of good documents are good;
    of a bad one those are bad that look so by their own features, all of them if none does."""
    own = x[:, : len(OWN)]
    labels = good[row]
    for _ in range(rounds):
        likely = _probability(own @ logistic(own, labels)) >= 0.5
        labels = np.where((good[row] == 0) & ~likely, 0, 1)
        without = (np.bincount(row, labels == 0, len(good)) == 0) & (good == 0)
        labels[without[row]] = 0
    return labels


@dataclass
class Field:
    """Weights of features and transitions (bad or good, then bad or good); scale and shift take the
    log odds of a document's mean marginal to those of its label."""

    weights: np.ndarray
    transitions: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        ahead, behind = forward_backward(x @ self.weights, Chains(row), self.transitions)
        return _probability(ahead + behind)


NEUTRAL = Field(np.zeros(len(FEATURES)), np.zeros((2, 2)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def mean_marginals(field: Field, x: np.ndarray, row: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """Of each document: its lines' marginals of good, weighted by their lengths ``n``; 0 without lines."""
    return np.bincount(row, field.marginals(x, row) * n, rows) / np.maximum(np.bincount(row, n, rows), 1) if len(row) else np.zeros(rows)


def calibrated(field: Field, means: np.ndarray, good: np.ndarray, steps: int = 50) -> Field:
    """The field with the scale and shift that explain the labels best, held near 1 and 0 by a prior."""
    at = np.stack([_log_odds(means), np.ones(len(means))], 1)
    w, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(steps):  # Newton's method, damped
        p = _probability(at @ w)
        grad = at.T @ (good - p) - (w - prior)
        hessian = (at * (p * (1 - p))[:, None]).T @ at + np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, grad), -0.5, 0.5)
    return replace(field, scale=max(float(w[0]), 1e-3), shift=float(w[1]))


def document_scores(data: np.ndarray, bounds: np.ndarray, field: Field) -> np.ndarray:
    """A score for each text; 0 without a word."""
    x, row, n = line_features(data, bounds)
    rows = len(bounds) - 1
    means = mean_marginals(field, x, row, n, rows)
    scores = _probability(field.scale * _log_odds(means) + field.shift)
    return np.where(np.bincount(row, minlength=rows) > 0, scores, 0.0)


def fit(labelled: DataFrame, lines: int = TRAINING_LINES) -> Field:
    """Trains on (text, label 0 or 1), as training_rows gives them: whole texts, in the order of their
    lines' hash, as long as ``lines`` suffice. The lines' features come to the driver (62 MB at most),
    not the texts. Without rows the field is neutral (every line 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for lo, _, data, bounds in text_slices(batch.column("text")):
                x, row, n = line_features(data, bounds)
                found, start = np.unique(row, return_index=True)
                cut = lambda a: [p.tobytes() for p in np.split(a, start[1:])] if len(found) else []
                columns = [pa.array([int(labels[lo + r]) for r in found], pa.int32()), pa.array(np.diff([*start, len(row)]), pa.int64()), pa.array(cut(x.astype("<f4")), pa.binary()), pa.array(cut(n.astype("<i8")), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "lines", "features", "lengths"])

    found = in_arrow(labelled, run, "label int, lines long, features binary, lengths binary")
    so_far = Window.orderBy(F.xxhash64("features", "lengths"), "label").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("so_far", F.sum("lines").over(so_far)).filter(F.col("so_far") <= lines).drop("so_far").collect()
    if not rows:
        return NEUTRAL
    rows.sort(key=lambda r: (bytes(r["features"]), r["label"]))
    parts = [np.frombuffer(r["features"], "<f4").reshape(-1, len(FEATURES)) for r in rows]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    x, n = np.concatenate(parts).astype(np.float64), np.concatenate([np.frombuffer(r["lengths"], "<i8") for r in rows])
    good = np.array([r["label"] for r in rows])
    field = Field(*train(x, row, line_labels(x, row, good)))
    return calibrated(field, mean_marginals(field, x, row, n, len(good)), good)


def training_rows(docs: DataFrame, labels: DataFrame, documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """(text, label) of the labelled rows that are not held out, a bounded sample by hash."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.select("doc_id", F.col("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(documents)
    # `documents` rows of two numbers at most: safe to broadcast
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) of documents(doc_id, text): a number from 0 to 1 for every row, the likelihood
    of quality label 1. Null texts and texts without a word score 0; repeated rows score alike; an
    empty table gives an empty result; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [document_scores(data, bounds, field) for _, _, data, bounds in text_slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names=["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(plain, run, "doc_id long, score double")


def rows_of_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents(doc_id, text, ...) that score ``threshold`` or more, with all their columns,
    whatever their names. Nulls, empty texts, repeated rows and empty tables go as in score_documents."""
    field = fit(training_rows(docs, labels))

    # by their places, as some names can't be asked for
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [document_scores(data, bounds, field) for _, _, data, bounds in text_slices(batch.column(text))]
            good = np.concatenate([np.zeros(0), *scores]) >= threshold
            yield batch.filter(pa.array(good))

    return in_arrow(plain, run, plain.schema).toDF(*docs.columns)


def classify_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) with a field trained on ``labels`` that are not held out."""
    scored = score_documents(docs, fit(training_rows(docs, labels)))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
