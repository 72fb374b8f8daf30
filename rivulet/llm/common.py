"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a text are what lies between these characters.
BLANK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the cluster's shared folder (``spark.checkpoint.dir``), read again: computed once,
    independent of executors, and without its lineage. Only where the setting is unset on a single machine (in tests) a
    temporary folder takes its place; a cluster has to name its folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rivulet-"))
        folder = spark.sparkContext.getCheckpointDir()
    df.write.parquet(path := f"{folder}/rivulet-{uuid.uuid4().hex}")
    # Shuffle files of finished steps go once the driver has collected the plans that made them, which may be long after the disk is full.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name based on ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


#: Bytes of rows that go to Python at once: no more than ``bpe`` indexes together, so that a batch of texts is one group.
BATCH = "1900k"


def in_small_batches(spark: SparkSession) -> None:
    """Rows of this session go to Python in batches of ``BATCH`` bytes, unless it has a size of its own. Spark's 64 MB are held by the task, which
    builds them in memory that isn't given back, and once or twice by its worker; what a batch holds changes no result."""
    if spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set(key, BATCH)


def returned(run):
    """``run`` for ``mapInArrow``, after whose task the Python worker gives free memory back to the system: workers live on for
    the next stages, and all of an executor's share its memory."""

    def running(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return running


def split_of(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def smallest_by_class(df: DataFrame, by: str, rows: int) -> DataFrame:
    """Of each value of ``by`` the ``rows`` rows with the smallest hash of all their columns: a sample whose size depends on the number of classes alone."""
    # As an Arrow table, whose frame needs no Python on the executors: a frame of Python rows would start a second family of workers there.
    classes = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("class")).count().toArrow()
    counts = dict(zip(*(classes.column(c).to_pylist() for c in ("class", "count"))))
    if not counts:
        return df.limit(0)
    order, last, k = unused(df, "order"), unused(df, "last"), unused(df, "k")
    # Hashes are even, so four times the wanted share of them leaves enough rows and bounds what the window sorts.
    most = pa.array([-(2**63) + min(2**64 - 1, 4 * rows * 2**64 // n) for n in counts.values()], pa.int64())
    near = df.sparkSession.createDataFrame(pa.table([classes.column("class"), most], names=[by, last]), T.StructType([T.StructField(by, df.schema[by].dataType), T.StructField(last, T.LongType())]))
    hashed = df.withColumn(order, F.xxhash64(*df.columns))

    def smallest(some: DataFrame) -> DataFrame:
        first = Window.partitionBy(by).orderBy(order, *df.columns)
        return some.withColumn(k, F.row_number().over(first)).where(F.col(k) <= rows).select(*df.columns)

    found = smallest(hashed.join(F.broadcast(near), by).where(F.col(order) <= F.col(last)))
    # Repeated rows share a hash, so a class of few distinct rows can come back short: its rows are then all sorted.
    got = {r[by]: r["count"] for r in found.groupBy(by).count().collect()}
    short = [c for c, n in counts.items() if got.get(c, 0) < min(rows, n)]
    if not short:
        return found
    is_short = F.col(by).isin(short)
    return found.where(~is_short).unionByName(smallest(hashed.where(is_short)))
