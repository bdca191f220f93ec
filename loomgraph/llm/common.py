"""Helpers that the operators share: shared storage, checked broadcasts, text columns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that travel to a Python worker at once; texts may be long.
BATCH_ROWS = 1000
WHITE = " \t\n\x0b\x0c\r"


#: Folders that were named in this process, the last one last.
_NAMED: list[str] = []


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors share their local folders: local mode, not local-cluster."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names, deleted when the session ends.

    Where the setting is absent a temporary folder takes its place, once a session; that is refused on
    a cluster, whose machines don't share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.loomgraph.local.dir", None)
    if not base:
        if not on_one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.loomgraph.local.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    _NAMED.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_folder`` named."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make, label: str) -> DataFrame:
    """``make()`` as a written table; all tables that were written on the way are deleted."""
    before = len(_NAMED)
    out = written(make(), label)
    for path in _NAMED[before:-1]:
        remove(spark, path)
    del _NAMED[before:]
    return out


class Scratch:
    """Tables that are needed until a result is written; ``drop`` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self, label: str) -> str:
        self.paths.append(shared_folder(self.spark, label))
        return self.paths[-1]

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = self.folder(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, unless they run on the driver's machine
    and find it by themselves: in the folder they run in or by PYTHONPATH."""
    package = Path(__file__).resolve().parent.parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    found = on_one_machine(spark) and str(package.parent) in (os.path.realpath(x) for x in known if x)
    if found or getattr(context, "_loomgraph_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="loomgraph-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._loomgraph_sent = True


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with small batches; a task gives the memory it has freed back at its end, as
    Python workers outlive tasks and stages. The batches' size is a setting of the session, which is
    made (and stays, as the DataFrame is lazy) only where the session has none of its own."""
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "-9") == "-9":  # what is asked for comes back if it is unset
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        try:
            yield from function(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return df.mapInArrow(run, schema)


def source_folder(df: DataFrame) -> str | None:
    """The one path that a DataFrame reads as Parquet and nothing else, or None."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    relation = plan.relation()
    roots = relation.location().rootPaths()
    plain = relation.partitionSchema().isEmpty() and relation.fileFormat().toString() == "Parquet"
    return roots.head().toString() if plain and roots.size() == 1 else None


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the (written) table has at most ``rows`` rows; else as it is, so that the
    join falls back to a shuffle. Callers pass tables of a few fixed-width columns."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body (or a lambda in it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: A word with the white space around it.
_WORD_AND_WHITE = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def word_count(text: Column) -> Column:
    """Words of a text: each is replaced by a letter, and the letters are counted. No word becomes a
    value of its own, so a long text costs one short string."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(F.regexp_replace(text, _WORD_AND_WHITE, "x"))).otherwise(0).cast("long")


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores put before those that clash with a column (case aside)."""
    used = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def named(columns: list[str]) -> list[Column]:
    """The columns by their names, whatever marks these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def shards_for(n_bytes: int, each: int) -> int:
    """How many parts of about ``each`` bytes ``n_bytes`` make, one at least."""
    return max(1, -(-int(n_bytes) // int(each)))
