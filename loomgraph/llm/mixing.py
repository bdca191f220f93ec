"""Mixing sources to target weights by hash-threshold histograms.

Every record has a 48-bit hash. Sizes are summed by source and by the top bits of the hash; the
running sum over a source's buckets shows in which bucket its budget ends. Only that bucket is
split further, by the next bits, until the threshold is one hash value. A record is then taken by
comparing its hash with its source's threshold: nothing is sorted, and budgets nest (a smaller
budget takes a subset of a larger one's records).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, named, small, text_of, word_count, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
HASH_DIGITS = 12
DIGITS_A_LEVEL = 3
#: A source's line in the threshold table has six numbers; so many of them are broadcast at most.
BROADCAST_SOURCES = 50_000


def record_hash(key, seed: int):
    """48 bits of the md5 of the record's key, as a long."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds ``target`` to (skey, size): all sizes shared by weight, none above ``most`` times its own.

    Weights repeat over the sources in order of code point, null last. Resharing the excess until no
    target is above its limit ends at ``least(limit, level * weight)`` with one level for all: sources
    are limited in order of limit / weight, and the level is what is left by the weight that is left.
    """
    rank = Window.orderBy("skey")
    by_ratio = Window.orderBy("ratio", "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    out = sizes.withColumn("rank", F.row_number().over(rank) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    out = out.withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    zero = F.lit(0).cast("long")
    out = out.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum(F.col("source_size") * most).over(before), zero).alias("held"),
        F.coalesce(F.sum("weight").over(before), zero).alias("gone"),
    )
    level = (F.col("all_size") - F.col("held")).cast("double") / (F.col("all_weight") - F.col("gone"))
    out = out.withColumn("own_level", F.when(level <= F.col("ratio"), level))
    out = out.withColumn("level", F.max("own_level").over(everything))
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.col("level") * F.col("weight"))
    return out.select("skey", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_limits(records: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The threshold table of records(skey string, h long, size long): one line for each source, with
    its size, its target, how often all its records are taken, and the hash below which they are
    taken once more."""
    sizes = records.groupBy("skey").agg(F.sum("size").cast("long").alias("source_size"))
    plan = source_targets(sizes, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(1)
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")

    levels = HASH_DIGITS // DIGITS_A_LEVEL
    edge = plan.filter("rest > 0").select("skey", F.lit(0).cast("long").alias("prefix"), "rest")
    inside = records.select("skey", "h", "size")
    for level in range(1, levels + 1):
        bits = 4 * DIGITS_A_LEVEL * (levels - level)
        joined = inside.join(small(edge, BROADCAST_SOURCES), ["skey"])
        if level > 1:
            joined = joined.filter(F.shiftright("h", bits + 4 * DIGITS_A_LEVEL) == F.col("prefix"))
        buckets = joined.groupBy("skey", "rest", F.shiftright("h", bits).alias("bucket")).agg(
            F.sum("size").alias("inside"), F.count(F.lit(1)).alias("rows")
        )
        so_far = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        buckets = buckets.withColumn("total", F.sum("inside").over(so_far)).filter(F.col("total") > F.col("rest"))
        first = F.min_by(F.struct("bucket", (F.col("rest") - (F.col("total") - F.col("inside"))).alias("rest"), "inside", "rows"), "bucket")
        edge = buckets.groupBy("skey").agg(first.alias("x"))
        edge = edge.select("skey", F.col("x.bucket").alias("prefix"), F.col("x.rest").alias("rest"), F.col("x.inside").alias("inside"), F.col("x.rows").alias("rows"))
        edge = written(edge, "mix-edge")
    edge = edge.select("skey", F.col("prefix").alias("threshold"), F.col("rest").alias("edge_rest"), F.col("inside").alias("edge_size"), F.col("rows").alias("edge_rows"))
    return written(plan.join(edge, "skey", "left"), "mix-limits")


def _mixed(limit, h: Column, size: Column, most: int) -> tuple[Column, Column]:
    """(taken, copies) of a record of hash ``h`` under its source's limits, ``limit(name)`` each."""
    full = limit("rest") > 0
    below = F.coalesce(h < limit("threshold"), full)
    at = F.coalesce(h == limit("threshold"), F.lit(False))
    alone = F.when(limit("edge_rest") * 2 >= limit("edge_size"), size).otherwise(0)
    shared = F.floor(size * limit("edge_rest") / limit("edge_size"))
    at_edge = F.when(limit("edge_rows") == 1, alone).otherwise(shared)
    extra = F.when(at, at_edge).when(below, size).otherwise(0).cast("long")
    more = F.when(at, at_edge * 2 >= size).otherwise(below) & (limit("whole") < most)
    return limit("whole") * size + extra, (limit("whole") + more.cast("long")).cast("int")


def take_records(records: DataFrame, limits: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Adds source_size, target, copies, taken to records(skey, h, size, ...).

    ``copies`` is how often a record is taken, ``taken`` its words in the mix. Records whose hashes
    tie at the threshold (repeated rows) share what is left of the budget in proportion to size; a
    single record there is taken if that brings the source nearer its target.
    """
    out = records.join(small(limits, BROADCAST_SOURCES), "skey")
    taken, copies = _mixed(F.col, F.col("h"), F.col("size"), most)
    return out.withColumns({"taken": taken, "copies": copies}).drop("rest", "whole", "threshold", "edge_rest", "edge_size", "edge_rows")


def source_key(source):
    """A never-null key whose order is that of code points with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def mix_documents(docs: DataFrame, seed: int = 0, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for documents(doc_id, text, source, ...).

    Null texts and texts without words have size 0 and give 0 words; a null source is a source of its
    own, the last; a null doc_id hashes as the empty string; repeated rows tie and share the
    threshold's rest; an empty table gives an empty result; other columns are ignored.
    """
    records = docs.select("doc_id", source_key(F.col("source")).alias("skey"), record_hash(F.col("doc_id"), seed).alias("h"), word_count(text_of()).alias("size"))
    records = written(records, "mix-records")
    out = take_records(records, mix_limits(records, weights, most), most)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_rows(docs: DataFrame, seed: int = 0, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: each row as often as it is taken.

    The rows themselves are neither shuffled nor copied into structs; only (source, hash, size) of
    each is written for the histograms. Edge cases as in mix_documents; any names of other columns do.
    """
    skey, h, size = source_key(F.col("source")), record_hash(F.col("doc_id"), seed), word_count(text_of())
    limits = mix_limits(written(docs.select(skey.alias("skey"), h.alias("h"), size.alias("size")), "mix-records"), weights, most)
    numbers = ["rest", "whole", "threshold", "edge_rest", "edge_size", "edge_rows"]
    own = free_names(docs.columns, "__skey", "__limits", "__copies")
    packed = limits.select(F.col("skey").alias(own[0]), F.struct(*numbers).alias(own[1]))
    # the rows pass by once: beside each stand its source's limits, and words are only counted at a threshold
    joined = docs.withColumn(own[0], skey).join(small(packed, BROADCAST_SOURCES), own[0])
    _, copies = _mixed(lambda n: F.col(own[1])[n], h, size, most)
    joined = joined.select(*named(docs.columns), copies.alias(own[2])).filter(F.col(own[2]) > 0)
    return joined.withColumn(own[2], F.explode(F.sequence(F.lit(1), F.col(own[2])))).select(*named(docs.columns))
