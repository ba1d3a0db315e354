"""Sessions, table loading and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "strataline", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark's reader is the only thing that opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's `spark.checkpoint.dir`. Only a local master, whose executors are this machine, may leave it out."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strataline-checkpoint-"))
    return context.getCheckpointDir()


#: Folders of stored tables by application, each with a weak reference to what every plan that reads it holds.
_STORED: dict[str, list[tuple[str, object]]] = {}


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget its lineage; Spark's cleaner removes it where `cleanCheckpoints` is on."""
    shared_folder(df.sparkSession)
    swept(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `cut`, as compressed columns: for rows that carry texts and are read by a few columns at a time. The folder goes once no plan reads it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    swept(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    _STORED.setdefault(spark.sparkContext.applicationId, []).append((path, spark._jvm.java.lang.ref.WeakReference(files)))
    return out


def swept(spark: SparkSession) -> None:
    """Remove the stored tables that nothing refers to any more."""
    held = _STORED.get(spark.sparkContext.applicationId, [])
    for entry in [x for x in held if x[1].get() is None]:
        held.remove(entry)
        removed(spark, entry[0])


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A materialised side of a join, marked to be broadcast if it has at most so many rows, else to be hashed where the other side's rows arrive."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is materialised inside sends Python workers at most so many rows at once: large rows would make large batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimmed() -> None:
    """Give back what this Python process has freed: a worker that is used again holds on to the memory of its earlier tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's own
    if trim:
        trim(0)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a run's folder in the shared one, by Spark's own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
