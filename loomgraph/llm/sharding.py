"""Two-pass external shuffle into shards.

Pass one scatters records uniformly over buckets that fit in memory, by a seeded hash. Pass two
gathers each bucket, puts it in a Fisher-Yates order and writes it. The buckets one after the other
are the shuffled corpus; record i of it goes to shard ``i mod shards``, slot ``i div shards``, so
that shards differ by one record at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import on_one_machine, shards_for, small, written

#: A bucket's records are held in memory at once: it is to take so small a share of a core's memory.
CORE_SHARE = 64
LEAST_BUCKET_BYTES = 2 << 20
BROADCAST_BUCKETS = 200_000
#: Buckets whose places are summed by one task.
BUCKETS_A_BLOCK = 4096


def bucket_size(spark: SparkSession) -> int:
    """Bytes of a bucket: a share of the memory that an executor's core has."""
    conf = spark.sparkContext.getConf()
    memory = conf.get("spark.driver.memory" if on_one_machine(spark) else "spark.executor.memory", "1g").lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    total = int(memory[:-1]) * scale[memory[-1]] if memory[-1] in scale else int(memory)
    cores = int(conf.get("spark.executor.cores", "4"))
    return max(LEAST_BUCKET_BYTES, total // cores // CORE_SHARE)


def external_shuffle(records: DataFrame, seed: int, size, bucket_bytes: int | None = None) -> DataFrame:
    """Adds ``__bucket`` (from 0) and ``__place`` (from 0 in its bucket) to every record.

    The scatter hashes the record's arrival number along with the seed, so that repeated rows spread
    over the buckets like any others; it also fixes the order in a bucket before it is shuffled, so
    that a task that runs again gives the same order.
    """
    names = records.columns
    # the number of buckets follows the bytes of all records
    total = records.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    buckets = shards_for(total, bucket_bytes or bucket_size(records.sparkSession))
    arrival = F.monotonically_increasing_id()
    scatter = F.xxhash64(F.lit(seed), arrival)
    held = records.select(F.pmod(scatter, F.lit(buckets)).alias("__bucket"), F.struct(scatter.alias("__order"), *names).alias("__record"))
    gathered = held.repartition(buckets, "__bucket").groupBy("__bucket").agg(F.sort_array(F.collect_list("__record")).alias("__all"))
    # shuffle() draws from a generator seeded once a partition: buckets come to it in a fixed order
    ordered = gathered.sortWithinPartitions("__bucket")
    mixed = ordered.select("__bucket", F.posexplode(F.shuffle("__all", seed)).alias("__place", "__record"))
    return mixed.select(*[F.col("__record")[n].alias(n) for n in names], F.col("__bucket").cast("long"), F.col("__place").cast("long"))


def shard_records(records: DataFrame, shards: int, seed: int, size, bucket_bytes: int | None = None) -> DataFrame:
    """Adds ``__shard`` and ``__slot`` to every record and keeps all its columns.

    Nulls in any column are carried along; an empty table gives an empty table; repeated rows each
    get a place of their own. Columns whose names begin with two underscores are reserved.
    """
    mixed = written(external_shuffle(records, seed, size, bucket_bytes), "shuffled-buckets")
    counts = mixed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = written(bucket_starts(counts), "bucket-starts")
    index = F.col("__start") + F.col("__place")
    placed = mixed.join(small(starts, BROADCAST_BUCKETS), "__bucket").withColumn("__index", index)
    placed = placed.withColumn("__shard", F.pmod("__index", F.lit(shards)).cast("int"))
    return placed.withColumn("__slot", F.floor(F.col("__index") / shards).cast("long")).drop("__bucket", "__place", "__start", "__index")


def bucket_starts(counts: DataFrame, each: int = BUCKETS_A_BLOCK) -> DataFrame:
    """(__bucket, __start) of (__bucket, n): how many records the buckets before hold. Blocks of buckets
    are summed first, so that no task sees all buckets; one sees all blocks."""
    counts = counts.withColumn("block", F.floor(F.col("__bucket") / each))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("all"))
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("ahead"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), zero)
    return counts.withColumn("inside", inside).join(blocks, "block").select("__bucket", (F.col("ahead") + F.col("inside")).cast("long").alias("__start"))


def write_shards(sharded: DataFrame, path: str, shards: int, files_a_shard: int = 1) -> None:
    """One folder a shard. Its files, about ``files_a_shard``, follow one another in the order of their
    slots, and so do the records in each. Nulls and repeated rows are written like any others; an
    empty table gives an empty folder."""
    parts = sharded.repartitionByRange(shards * files_a_shard, "__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    parts.write.partitionBy("__shard").parquet(path)


def document_size(text):
    """UTF-8 bytes of the text (null: none) and 16 for its frame."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
