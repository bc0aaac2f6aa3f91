"""Documents that keep arriving in a folder, brought into an index batch by batch.

The file source remembers what it has read in the checkpoint, and a batch that
is run again after a loss changes nothing: documents are told by address and
hash, so what is already stored is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..commands import Index
from ..functions import text as T

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (uri, text, content_hash, content_type, modified); binary files and skipped endings go."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = raw.withColumn("uri", F.regexp_replace("path", "^file:/*", "/")).where(~T.should_skip(F.col("uri"))).where(~T.is_binary(F.col("content")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("uri", text.alias("text"), F.col("modificationTime").alias("modified")).withColumn("content_hash", T.content_hash(F.col("text"))).withColumn("content_type", T.type_by_ending(F.col("uri")))


def newest(rows: DataFrame) -> DataFrame:
    """Of one batch's rows of an address, the last written."""
    w = Window.partitionBy("uri").orderBy(F.desc("modified"), "content_hash")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "modified")


def ingest_stream(index: Index, folder: str, checkpoint: str, files_per_batch: int = 1000, keep_running: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Start the stream; by default it ends once what is there has been read.  Files that vanish are left to ``Index.prune``."""

    def batch(rows: DataFrame, number: int) -> None:
        index.ingest("dir", folder.rstrip("/"), newest(rows), operation="ingest", whole=False)

    writer = arriving(index.spark, folder, files_per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if keep_running else writer.trigger(availableNow=True)).start()
