"""What the training-data operators share: durable tables, Arrow batches and column lookups."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting of the folder that driver and executors share.
SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a folder of this machine if Spark runs on it alone, and an error on a cluster."""
    at = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED} must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set(SHARED, at)
    return at.rstrip("/")


_SCRATCH: list[list[DataFrame]] = []


def durable(df: DataFrame, tag: str, scratch: bool = True, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Lineage ends at files that outlive any executor, and values that Spark
    does not reproduce when it computes a plan again, such as row numbers
    given on the fly, are fixed from here on.  The files go when the
    application ends, or with the ``scratch`` block around the call.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    if scratch and _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


@contextmanager
def scratch():
    """Delete what ``durable`` writes inside the block when it ends, but for tables written with ``scratch=False``."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for df in _SCRATCH.pop():
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that ``durable`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "6m") -> None:
    """Bound Arrow batches by rows and bytes, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(texts: list, limit: int = 2 << 20):
    """Cut a list of byte strings into runs of about ``limit`` bytes; yields (first, end)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name
