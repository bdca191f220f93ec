"""Exact deduplication as a stateful stream.

Records arrive as a file stream. A keyed state on local disk (the RocksDB state store, backed up to
the checkpoint folder) keeps, for every digest ever seen and without expiry, the stable identifier
and the content locator (file and row) of the record that stays, and how many records share the
digest. Every micro-batch appends the state rows it changed to a log; the last of each digest is
the final state. A hit, a digest with more than one record, is believed only after the full bytes of
both records compare equal; texts that differ under one digest are regrouped by their bytes.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, free_names, named, shards_for, shared_folder, small, source_folder, text_of, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of input files that one micro-batch takes at least, and into how many batches a larger input
#: is cut: a batch costs every state partition a commit.
BATCH_BYTES = 256 << 20
BATCHES = 32
#: Bytes of input files for each state partition, and partitions at least.
PART_BYTES = 64 << 20
LEAST_PARTS = 8
#: Memory outside the heap that the state stores of one executor share, in MB.
STATE_MB = 192
#: Digest prefixes (8 bytes each) that are broadcast at most, to pick the hits out of the table.
BROADCAST_HITS = 500_000
#: Places of dropped rows (a path and a number) that are broadcast at most, to leave them out of the table.
BROADCAST_DROPPED = 200_000


@contextmanager
def session_settings(spark: SparkSession, **settings):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha(text):
    return F.unhex(F.sha2(text, 256))


def _located(df: DataFrame, digest) -> DataFrame:
    text = text_of()
    at = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(digest(text).alias("digest"), at.alias("at"), text.alias("text"))


def stream_state(spark: SparkSession, path: str, folder: str, digest=sha, batch_bytes: int | None = None) -> DataFrame:
    """(digest, keeper struct<doc_id, file, row>, n): the final state after the whole stream, whose
    checkpoint and log are in ``folder``."""
    schema = spark.read.parquet(path).schema
    total = input_bytes(spark, path)
    batch_bytes = batch_bytes or max(BATCH_BYTES, total // BATCHES)
    # a stream keeps its number of state partitions for life: it follows the input up to the session's own
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST_PARTS, shards_for(total, PART_BYTES)))
    settings = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        # the stores of an executor share one bounded memory, and back up what changed, not whole files
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    with session_settings(spark, **settings):
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(as_pattern(path))
        state = _located(stream, digest).groupBy("digest").agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("n"))

        def log(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{folder}/log/batch={batch}")

        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(log).start()
        query.awaitTermination()
    logged = "digest binary, keeper struct<doc_id:long,file:string,row:long>, n long"
    if query.lastProgress is None and not _exists(spark, f"{folder}/log"):
        return spark.createDataFrame([], logged)
    # keeper and count only ever grow, so the last state of a digest is the greatest
    return spark.read.schema(logged + ", batch long").parquet(f"{folder}/log").groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("n").alias("n"))


def as_pattern(path: str) -> str:
    """A pattern that matches the path alone: as a pattern, it may name one file as well as a folder. One
    that is a pattern already, as any reader would take it, stays as it is."""
    path = path.rstrip("/") or path
    if any(c in "{}[]*?\\" for c in path):
        return path
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else f"{path[:-1]}{{{path[-1]}}}"


def input_bytes(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def dedup_files(spark: SparkSession, path: str, digest=sha, batch_bytes: int | None = None, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """One row per record of the Parquet files at ``path`` (columns doc_id, text; others are ignored):
    doc_id, at (its locator), keep_id, group_size, kept, text_sha256.

    Texts are compared as they are; null counts as empty. Of equal texts the row with the largest
    doc_id stays; rows that also share that doc_id tie, and the one with the last locator stays. A
    null doc_id is the smallest. An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    state = written(stream_state(spark, path, scratch.folder("dedup-stream"), digest, batch_bytes), "dedup-state")
    rows = _located(spark.read.parquet(path), digest)
    prefix = F.xxhash64("digest")
    hits = scratch.written(state.filter("n > 1").select("digest", F.col("keeper").alias("stays")), "dedup-hits")
    chosen = rows.withColumn("prefix", prefix).join(small(hits.select(prefix.alias("prefix")).distinct(), broadcast_hits), "prefix", "left_semi").drop("prefix")
    chosen = scratch.written(chosen.join(hits, "digest"), "dedup-candidates")
    originals = chosen.filter(F.col("at") == F.col("stays")).select("digest", F.col("text").alias("stored"))
    compared = chosen.join(originals, "digest").select("digest", "at", F.col("text") == F.col("stored"), F.when(F.col("text") != F.col("stored"), F.col("text")))
    compared = written(compared.toDF("digest", "at", "same", "text"), "dedup-compared")

    differ = compared.filter("not same")
    regrouped = differ.groupBy("digest", "text").agg(F.max("at").alias("other"), F.count(F.lit(1)).alias("others"))
    fewer = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("fewer"))
    same = rows.select("digest", "at", F.sha2("text", 256).alias("text_sha256")) if digest is not sha else rows.select("digest", "at", F.lower(F.hex("digest")).alias("text_sha256"))
    differing = written(differ.join(regrouped, ["digest", "text"]).select("at", F.col("other"), F.col("others")), "dedup-differing")
    out = same.join(state, "digest")
    fewer = written(fewer, "dedup-fewer")
    scratch.drop()
    if differing.limit(1).count():
        out = out.join(fewer, "digest", "left").join(differing, "at", "left")
    else:
        none = F.lit(None)
        out = out.withColumns({"fewer": none.cast("long"), "other": none.cast("struct<doc_id:long,file:string,row:long>"), "others": none.cast("long")})
    keeper = F.coalesce("other", "keeper")
    size = F.coalesce("others", F.col("n") - F.coalesce("fewer", F.lit(0)))
    return out.select(F.col("at.doc_id").alias("doc_id"), "at", keeper["doc_id"].alias("keep_id"), size.cast("long").alias("group_size"), (F.col("at") == keeper).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of documents(doc_id, text, ...) that stay, with all their columns: one of each text,
    that of the largest doc_id. Rows that aren't a Parquet table are written to the shared folder, and
    streamed from there. Nulls and ties go as in dedup_files; columns may have any names."""
    spark = docs.sparkSession
    path = source_folder(docs)
    if path is None:
        path = shared_folder(spark, "dedup-input")
        docs.write.parquet(path)
    found = dedup_files(spark, path)
    file, row = free_names(docs.columns, "__file", "__row")
    dropped = written(found.filter("not kept").select(F.col("at.file").alias(file), F.col("at.row").alias(row)), "dedup-dropped")
    rows = spark.read.schema(docs.schema).parquet(path)
    placed = rows.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    return placed.join(small(dropped, BROADCAST_DROPPED), [file, row], "left_anti").select(*named(docs.columns))
