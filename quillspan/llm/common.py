"""Reading the shared folder, cutting lineage and joining by checked size."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes is broadcast, whatever its number of rows.
BROADCAST_BYTES = 24 << 20
#: Rows of an Arrow batch of texts.
TEXTS_PER_BATCH = 2000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only in a local session without one (tests) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Hand texts, which may be long, to Python tasks in batches of fewer rows, unless the session already does."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > TEXTS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage."""
    small_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    released(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are over, now that their result is a table.

    Its cleaner follows the driver's garbage collection, which else may be half an hour away.
    """
    gc.collect()
    spark._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few bytes (it should be stored: this reads it), else df as it is."""
    sizes = [F.octet_length(f.name) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in df.schema.fields]
    size = df.select(reduce(add, (F.coalesce(c, F.lit(0)) for c in sizes), F.lit(16)).alias("size")).agg(F.sum("size")).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def without_gc() -> Iterator[None]:
    """No collection of cycles meanwhile: large caches of a task hold none, and walking them costs more than filling them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_held: dict = {}


def held(name: Hashable, make: Callable):
    """The one large object that this worker keeps from task to task; one of another name takes its place."""
    if name not in _held:
        forget()
        _held[name] = make()
    return _held[name]


def forget() -> None:
    _held.clear()


def trim() -> None:
    """Give memory that is free back to the system, which allocators of a worker else keep for its next task."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The work of a task that needs nothing which its worker holds of others, and leaves it no free memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from work(batches)
        trim()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def batches(rows: dict[str, pa.Array | list], limit: int = 20_000) -> Iterator[pa.RecordBatch]:
    """One Arrow batch, handed on in slices."""
    batch = pa.RecordBatch.from_pydict(rows)
    for at in range(0, batch.num_rows, limit):
        yield batch.slice(at, limit)
