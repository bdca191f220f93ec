"""N-gram Jaccard self-join of documents by a token-group matrix.

A document's tokens are the hashes of its word shingles. Documents with the same set are one class.
Similar classes are partitioned into groups: classes that share a min-hash are queries against the
one of them with the fewest tokens of its own, and verified links make the groups. The matrix has a
row for every token, with the classes (and their groups) that hold it among their *prefix* tokens:
two sets that overlap enough share a token among the first of each in any common order (frequent
tokens come last in ours), so a class asks a group only if

* it shares a prefix token with a member, and places and sizes leave room for enough overlap; and
* the bits of the group's token union, stored with the group, bound its overlap with the class from
  above, and the bound reaches the threshold.

Groups that qualify are opened: in parts of bounded size, the exact union of a part's tokens bounds
the overlap once more, and then the class is held against the members. Of two groups the members of
the smaller ask the larger; a group is never asked by its own members. No link between groups is
lost: every filter is a bound, and only the order of tokens and the grouping depend on estimates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names, in_arrow, named, small, written
from .components import components
from .text_arrays import mix, span_hashes, text_slices, words_of

WORDS = 5
PERCENT = 80
MIN_HASHES = 4
#: A token in so many documents of one slice of a task's input is counted towards the frequent ones.
SLICE_TOKENS = 3_000_000
LEAST_IN_SLICE = 4
FREQUENT = 64
#: Frequent tokens that are put last, at most: 8 bytes each travel to every worker. The rest is
#: treated like any other token.
MOST_FREQUENT = 1 << 20
BROADCAST_ROWS = 500_000
#: Rows of the matrix with more entries than this are dealt over cells.
LONG_ROW = 1024
#: Members of a group that a cell holds, and classes that ask it there, about.
PART = 256
ASKING = 128
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``words`` words; fewer words make
    one shingle of all of them, none an empty set. A-Z are lower-cased, nothing else."""
    starts, ends = words_of(data, bounds)
    hashes = span_hashes(data, starts, ends, lower=True)
    count = np.bincount(np.searchsorted(bounds, starts, "right") - 1, minlength=len(bounds) - 1)
    first = np.cumsum(count) - count
    n = max(0, len(hashes) - words + 1)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled = mix(rolled + hashes[k : k + n] * _ODD[0] + _ODD[1])
        out = []
        for c, at in zip(count.tolist(), first.tolist(), strict=True):
            if c >= words:
                out.append(np.unique(rolled[at : at + c - words + 1]))
            elif c:
                h = np.full(1, c, np.uint64)
                for x in hashes[at : at + c]:
                    h = mix(h * _ODD[2] + x)
                out.append(h)
            else:
                out.append(rolled[:0])
    return out


def least_overlap(n: int, percent: int) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def token_bits(tokens: np.ndarray) -> np.ndarray:
    """The set as bits: each token sets one of 2^k places, two or more for each token and 64 at least.
    A token whose place is not set in another set's bits is not in that set."""
    places = max(64, 2 << max(0, int(len(tokens) - 1).bit_length()))
    bits = np.zeros(places, np.uint8)
    bits[(mix(tokens) & np.uint64(places - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_number(tokens: np.ndarray) -> bytes:
    """128 bits that stand for the set: the same for equal sets, and for others with a chance of 2^-128."""
    with np.errstate(over="ignore"):
        sums = [np.sum(mix(tokens * k), dtype=np.uint64) + np.uint64(len(tokens)) for k in _ODD[3:5]]
        return mix(np.array(sums, np.uint64)).tobytes()


def frequent_tokens(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and in how many documents each was seen: every task counts its documents' tokens slice by slice, and
    counts over a small limit are summed over all slices. It only orders tokens; results don't
    depend on it."""

    def frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(sets), return_counts=True)
        keep = n >= LEAST_IN_SLICE
        return pa.RecordBatch.from_arrays([pa.array(_signed(token[keep])), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column("text")):
                held.append(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(data, bounds, words)]))
                if sum(map(len, held)) >= SLICE_TOKENS:
                    yield frequent(held)
                    held = []
        if held:
            yield frequent(held)

    counts = in_arrow(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    tokens, n = top.column("token").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


SETS = "doc_id long, cls binary, n int, rare int, prefix array<long>, minima array<long>, bits array<long>"


def document_sets(docs: DataFrame, words: int, percent: int, last: np.ndarray) -> DataFrame:
    """(doc_id, cls, n, rare, prefix, minima, bits) of documents(doc_id, text): the set's number, size,
    infrequent tokens, prefix tokens, min-hashes and bits; cls is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch.column("text")):
                cls, sizes, rare, prefixes, minima, bits = [], [], [], [], [], []
                for tokens in shingle_hashes(data, bounds, words):
                    n = len(tokens)
                    sizes.append(n)
                    if not n:
                        cls.append(None)
                        rare.append(0)
                        prefixes.append(None)
                        minima.append(None)
                        bits.append(None)
                        continue
                    with np.errstate(over="ignore"):
                        minima.append(np.sort(_signed(np.array([np.min(mix(tokens ^ _ODD[k])) + _ODD[k] for k in range(MIN_HASHES)], np.uint64))))
                    cls.append(set_number(tokens))
                    k = n - least_overlap(n, percent) + 1
                    ordered, infrequent = tokens, n
                    if len(last):
                        at = np.searchsorted(last, tokens)
                        frequent = last[np.minimum(at, len(last) - 1)] == tokens
                        infrequent = n - int(frequent.sum())
                        if infrequent < n:
                            ordered = np.concatenate([tokens[~frequent], tokens[frequent]])
                    rare.append(infrequent)
                    prefixes.append(_signed(ordered[:k].copy()))
                    bits.append(token_bits(tokens))
                longs = pa.list_(pa.int64())
                arrays = [pa.array(cls, pa.binary()), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), pa.array(prefixes, longs), pa.array(minima, longs), pa.array(bits, longs)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *arrays], names=["doc_id", "cls", "n", "rare", "prefix", "minima", "bits"])

    return in_arrow(docs, run, SETS)


def _folded(bits: Column, places: Column) -> Column:
    """Bits brought down to a smaller power of two of longs: a place is set if one that it stands for is."""
    times = F.size(bits) / places
    fold = F.transform(F.sequence(F.lit(0), places - 1), lambda i: F.aggregate(F.sequence(F.lit(0), (times - 1).cast("int")), F.lit(0).cast("long"), lambda s, j: s.bitwiseOR(F.get(bits, i + j * places))))
    return F.when(F.size(bits) == places, bits).otherwise(fold)


def missing_at_least(own: Column, union: Column) -> Column:
    """How many tokens of a set are surely not in another one, from the bits of both."""
    places = F.least(F.size(own), F.size(union))
    gaps = F.zip_with(_folded(own, places), _folded(union, places), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def group_unions(members: DataFrame, light: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, members, n_min, n_max, bits) of members(grp, row): the bits of each group's token union, and
    its sizes. Words of bits are combined before they are shuffled, however large a group is."""
    own = members.join(light, "row")
    shape = own.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min(F.size("bits")).alias("places"))
    shape = scratch.written(shape, "group-shapes")
    words = own.select("grp", F.posexplode("bits").alias("at", "word")).join(small(shape.select("grp", "places"), BROADCAST_ROWS), "grp")
    words = words.groupBy("grp", F.pmod("at", "places").alias("at")).agg(F.bit_or("word").alias("word"))
    bits = words.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("bits"))
    return shape.drop("places").join(bits, "grp")


def qualifying(asks: DataFrame, light: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Of asks(row, grp) those where sizes and the bound on the overlap with the group's union allow a link."""
    n, n_min, n_max = F.col("n"), F.col("n_min"), F.col("n_max")
    sizes = (n_max * 100 >= n * percent) & (n * 100 >= n_min * percent)
    least = F.greatest(n_min, n * percent / 100)  # the smallest partner
    enough = (n - missing_at_least(F.col("own"), F.col("bits"))) * (100 + percent) >= (n + least) * percent - 1e-6
    both = asks.join(light.select("row", "n", F.col("bits").alias("own")), "row").join(groups.select("grp", "n_min", "n_max", "bits"), "grp")
    return both.filter(sizes).filter(enough).select("row", "grp")


def _class_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column("text")):
                cls, sets = [], []
                for tokens in shingle_hashes(data, bounds, words):
                    if len(tokens):
                        cls.append(set_number(tokens))
                        sets.append(_signed(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "tokens"])

    return in_arrow(docs.select("text"), run, "cls binary, tokens array<long>")


def _sets_of(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(cls, tokens) of the documents that wanted(cls, doc_id, ...), a written table, names. Where
    doc_id is null, as in a class of which no row has one, they are found by their sets' numbers."""
    named = wanted.filter("doc_id is not null").select("doc_id").distinct()
    sets = _class_sets(docs.join(small(named, BROADCAST_ROWS), "doc_id", "left_semi"), words)
    nameless = wanted.filter("doc_id is null").select("cls").distinct()
    if nameless.limit(1).count():
        sets = sets.unionByName(_class_sets(docs.filter("doc_id is null"), words).join(small(nameless, BROADCAST_ROWS), "cls", "left_semi"))
    return sets


def _row_pairs(n: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j below n, about ``most`` at a time."""
    if n * n <= 2 * most:
        yield np.triu_indices(n, 1)
        return
    step = max(1, most // n)
    for lo in range(0, n, step):
        i, j = np.meshgrid(np.arange(lo, min(n, lo + step)), np.arange(n), indexing="ij")
        keep = i < j
        yield i[keep], j[keep]


def _fits(own: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of entries may link. Each is (n_min, n_max, place). A pair that links is formed at its
    first common token at least; all tokens before the two places differ there, so the places together
    are no more than the sets may differ in."""
    sizes = (100 * own[1] >= percent * other[0]) & (100 * other[1] >= percent * own[0])
    return sizes & ((own[2] + other[2]) * (100 + percent) <= (own[1] + other[1]) * (100 - percent))


def matrix_rows(entries: DataFrame, percent: int) -> DataFrame:
    """asks(row, grp) from the rows of the matrix, entries(token, row, n, place, grp, members).

    Of two classes of different groups that may link, that of the smaller group asks the other group.
    Rows arrive sorted by token and are held one at a time, as a few numbers for each entry.
    """
    names = ("token", "row", "n", "place", "grp", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None  # the row that may go on in the next batch
        for batch in batches:
            part = np.stack([np.asarray(batch.column(x).cast(pa.int64())) for x in names])
            part = part if rest is None else np.concatenate([rest, part], 1)
            if not part.shape[1]:
                continue
            cut = int(np.flatnonzero(part[0] == part[0][-1])[0])
            if cut:
                yield from rows(part[:, :cut])
            rest = part[:, cut:]
        if rest is not None:
            yield from rows(rest)

    def rows(part: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, row, n, place, grp, members = part
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.concatenate([start, [len(token)]]))
        entry = np.stack([n, n, place])
        for size in np.unique(length[length > 1]).tolist():
            at = start[length == size]
            for i, j in _row_pairs(size):
                step = max(1, (1 << 20) // max(1, len(i)))
                for lo in range(0, len(at), step):
                    x, y = (at[lo : lo + step, None] + i).ravel(), (at[lo : lo + step, None] + j).ravel()
                    fit = (grp[x] != grp[y]) & _fits(entry[:, x], entry[:, y], percent)
                    x, y = x[fit], y[fit]
                    first = (members[x] < members[y]) | ((members[x] == members[y]) & (grp[x] < grp[y]))
                    yield _asks(row[np.where(first, x, y)], grp[np.where(first, y, x)])

    dealt = entries.select(*names).repartition("token").sortWithinPartitions("token")
    return in_arrow(dealt, run, "row long, grp long")


def _asks(rows: np.ndarray, grps: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([rows, grps]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["row", "grp"])


def matrix_cells(entries: DataFrame, long_rows: DataFrame, percent: int) -> DataFrame:
    """asks(row, grp) from long rows of the matrix. Entries are first combined by group; classes that
    ask and groups that are asked are each dealt into blocks, and a cell has one block of both."""
    at = entries.join(F.broadcast(long_rows), "token")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    both = ["token", "asking", "asked", "role", "row", "grp", "members", "n_min", "n_max", "place"]
    asking = at.select("token", F.col("n").alias("n_min"), F.col("n").alias("n_max"), "place", "grp", "members", "row", block("row").alias("asking"), F.explode(every).alias("asked"), F.lit(1).alias("role"))
    groups = at.groupBy("token", "blocks", "grp", "members").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("place").alias("place"))
    asked = groups.select("token", "n_min", "n_max", "place", "grp", "members", F.lit(0).cast("long").alias("row"), block("grp").alias("asked"), F.explode(every).alias("asking"), F.lit(0).alias("role"))
    dealt = asking.select(*both).unionByName(asked.select(*both))
    cells = ["token", "asking", "asked"]
    dealt = dealt.repartition(*cells).sortWithinPartitions(*cells, "role").select(*both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            part = np.stack([np.asarray(batch.column(x).cast(pa.int64())) for x in both])
            change = np.flatnonzero(np.any(part[:4, 1:] != part[:4, :-1], axis=0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), part.shape[1]], strict=True):
                if hi == lo:
                    continue
                piece = part[:, lo:hi]
                key = tuple(piece[:3, 0].tolist())
                if key != cell:
                    cell, held = key, []
                if piece[3, 0] == 0:
                    held.append(piece)
                elif held:
                    held = [np.concatenate(held, 1)]
                    yield from against(piece, held[0])

    def against(own: np.ndarray, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // groups.shape[1])
        for lo in range(0, own.shape[1], step):
            some = own[:, lo : lo + step]
            smaller = (some[6, :, None] < groups[6]) | ((some[6, :, None] == groups[6]) & (some[5, :, None] < groups[5]))
            fit = smaller & _fits(some[7:, :, None], groups[7:, None, :], percent)
            x, y = np.nonzero(fit)
            if len(x):
                yield _asks(some[4, x], groups[5, y])

    return in_arrow(dealt, run, "row long, grp long")


def opened(asks: DataFrame, members: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch, label: str) -> DataFrame:
    """edges(u, v): for each class of asks(row, grp) and each part of the group, of members(grp, row),
    the first member that it links with, if any.

    A cell holds a part's sets and their union while classes that ask stream past it: one whose overlap
    with the union can't reach the threshold is done with. Parts and classes that ask are both split,
    so neither a large group nor one that many ask is a task's burden.
    """
    asked = members.join(asks.select("grp").distinct(), "grp", "left_semi")
    involved = asked.select("row").unionByName(asks.select("row")).distinct().join(reps.select("row", "cls", "doc_id"), "row")
    involved = scratch.written(involved, f"{label}-asked")
    # a repeated doc_id may bring other texts along: the numbers of their sets tell
    sets = _sets_of(involved, docs, words).join(involved.select("row", "cls"), "cls").dropDuplicates(["row"]).select("row", "tokens")
    sets = scratch.written(sets, f"{label}-sets")
    shape = asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).join(asks.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("askings")), "grp")
    shape = scratch.written(shape, f"{label}-shape")
    deal = lambda parts: F.pmod(F.xxhash64("row"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    inside = asked.join(shape, "grp").select("grp", deal("parts").alias("part"), every("askings").alias("asking"), F.lit(0).alias("role"), "row")
    queries = asks.join(shape, "grp").select("grp", every("parts").alias("part"), deal("askings").alias("asking"), F.lit(1).alias("role"), "row")
    cells = ["grp", "part", "asking"]
    dealt = inside.unionByName(queries).join(sets, "row").repartition(*cells).sortWithinPartitions(*cells, "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sets_, flat = None, [], [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = [batch.column(x).to_pylist() for x in (*cells, "role", "row")]
            tokens = batch.column("tokens")
            values, bounds = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
            for k, (grp, part, asking, role, row) in enumerate(zip(*columns, strict=True)):
                own = values[bounds[k] : bounds[k + 1]]
                if (grp, part, asking) != key:
                    key, names, sets_, flat = (grp, part, asking), [], [], None
                if role == 0:
                    names.append(row)
                    sets_.append(own.copy())
                    continue
                if not names:
                    continue
                if flat is None:
                    sizes = np.array([len(x) for x in sets_])
                    flat, starts, smallest = np.concatenate(sets_), np.cumsum(sizes) - sizes, int(sizes.min())
                    union = np.unique(flat)
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                most = int((union[at] == own).sum())
                if most * (100 + percent) < percent * max(len(own) + smallest, len(own) * (100 + percent) // 100):
                    continue  # not even with all members together
                if len(names) == 1:
                    shared = np.array([most])
                else:
                    own = np.sort(own)
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    shared = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
                hit = np.flatnonzero(100 * shared >= percent * (len(own) + sizes - shared))
                if len(hit):
                    found.append((row, min(names[h] for h in hit)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])

    return scratch.written(in_arrow(dealt, run, "u long, v long"), f"{label}-links")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents(doc_id, text).

    Two documents link if the Jaccard similarity of their shingle sets is ``percent`` or more;
    component_id is the smallest doc_id reachable over links. Links inside a group are looked for only
    until the group hangs together, so they are not counted. Null and empty texts, and those without a
    word, have no shingles and link with nothing; repeated rows and equal sets are one class; a null
    doc_id is never a component's smallest one unless alone; an empty table gives an empty result;
    other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    scratch = Scratch(spark)
    last, seen = frequent_tokens(docs, words)
    sets = scratch.written(document_sets(docs, words, percent, last).withColumn("row", F.monotonically_increasing_id()), "sets")
    # one row stands for a class, one with a doc_id if there is any
    rep = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.col("row"))), F.min("row"))
    classes = scratch.written(sets.filter("n > 0").groupBy("cls").agg(rep.alias("rep"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("rows")), "classes")
    doubles = sets.filter("n > 0").join(classes.filter("rows > 1").select("cls", "rep"), "cls").filter("row != rep").select("row")
    reps = sets.filter("n > 0").join(small(scratch.written(doubles, "doubles"), BROADCAST_ROWS), "row", "left_anti")
    light = reps.select("row", "n", "bits")

    # groups: every class asks one of those with the same min-hash, that with the fewest tokens of its
    # own: what a set of near copies was copied from has hardly any, and links with all of them
    keys = reps.select("row", "rare", F.explode("minima").alias("key"))
    pivots = keys.groupBy("key").agg(F.min(F.struct("rare", "row")).alias("a"), F.count(F.lit(1)).alias("rows"))
    pivots = scratch.written(pivots.filter("rows > 1").select("key", F.col("a.row").alias("grp")), "pivots")
    star = keys.join(pivots, "key").filter("row != grp").select("row", "grp").distinct()
    alone = light.select(F.col("row").alias("grp"), F.col("n").alias("n_min"), F.col("n").alias("n_max"), "bits")
    star = scratch.written(qualifying(star, light, alone, percent), "star")
    first_links = opened(star, star.select("grp", F.col("grp").alias("row")).distinct(), reps, docs, words, percent, scratch, "star")
    members = scratch.written(components(first_links).select(F.col("label").alias("grp"), F.col("node").alias("row")), "members")
    unions = group_unions(members, light, scratch)
    single = light.join(members.select("row"), "row", "left_anti")
    single = single.select(F.col("row").alias("grp"), F.lit(1).cast("long").alias("members"), F.col("n").alias("n_min"), F.col("n").alias("n_max"), "bits")
    groups = scratch.written(unions.unionByName(single), "groups")

    # the matrix, asked by every class
    own = members.join(groups.select("grp", "members"), "grp")
    grouped = reps.select("row", "n", "prefix").join(own, "row", "left").withColumns({"grp": F.coalesce("grp", "row"), "members": F.coalesce("members", F.lit(1))})
    entries = grouped.select("row", "n", "grp", "members", F.posexplode("prefix").alias("place", "token"))
    is_long = seen > LONG_ROW
    if is_long.any():
        listed = spark.createDataFrame(list(zip(_signed(last[is_long]).tolist(), (-(-seen[is_long] // LONG_ROW)).tolist(), strict=True)), "token long, blocks int")
        asks = matrix_rows(entries.join(F.broadcast(listed), "token", "left_anti"), percent).unionByName(matrix_cells(entries, listed, percent))
    else:
        asks = matrix_rows(entries, percent)
    asks = scratch.written(qualifying(asks.distinct(), light, groups, percent), "asks")
    everyone = members.unionByName(single.select("grp", F.col("grp").alias("row")))
    links = first_links.unionByName(opened(asks, everyone, reps, docs, words, percent, scratch, "asks"))

    labels = components(links).withColumnRenamed("node", "rep")
    labelled = scratch.written(classes.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")).select("cls", "label", "first_doc"), "labelled")
    smallest = labelled.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named_ = scratch.written(labelled.join(smallest, "label").select("cls", "component_id"), "named")
    out = sets.select("doc_id", "cls", "n").join(named_, "cls", "left")
    out = written(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    scratch.drop()
    return out


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of documents(doc_id, text, ...) that stay, with all their columns: of each component
    the one with the smallest doc_id (null ones last). Rows count each, so that repeated doc_ids do no
    harm; edge cases as in jaccard_components, and columns may have any names."""
    key, = free_names(docs.columns, "__key")
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "near-input")
        found = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("row"), "component_id")
        found = found.join(keyed.select(F.col(key).alias("row"), F.col("doc_id").alias("id")), "row")
        stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).select(F.col("first.row").alias("row"))
        dropped = found.select("row").join(stays, "row", "left_anti").select(F.col("row").alias(key))
    else:
        keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
        dropped = jaccard_components(docs, words, percent).filter("doc_id != component_id").select(F.col("doc_id").alias(key))
    dropped = written(dropped, "near-dropped")
    return keyed.join(small(dropped, BROADCAST_ROWS), key, "left_anti").select(*named(docs.columns))
