"""Counts and states of sources, in single joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_run(runs: DataFrame) -> DataFrame:
    """The run of each source that started last."""
    row = F.struct(*[c for c in runs.columns if c != "source_id"])
    return runs.groupBy("source_id").agg(F.max_by(row, F.struct("started_at", "id")).alias("r")).select("source_id", "r.*")


def state(status: Column, operation: Column) -> Column:
    return (
        F.when(status.isNull(), "ready")
        .when((status == "running") & (operation == "update"), "updating")
        .when(status == "running", "indexing")
        .when(status == "failed", "error")
        .otherwise("ready")
    )


def source_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.join(per_doc, documents.id == per_doc.doc_id, "left").groupBy("source_id").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def list_sources(sources: DataFrame, documents: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    stats, last = source_stats(documents, chunks), latest_run(runs)
    joined = sources.join(stats.withColumnRenamed("source_id", "id"), "id", "left").join(last.select(F.col("source_id").alias("id"), "operation", "status", "started_at", "completed_at", "errors"), "id", "left")
    return joined.select(
        "id", "source_type", "uri", "name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"),
        state(F.col("status"), F.col("operation")).alias("state"), F.coalesce("completed_at", "started_at").alias("last_updated"),
        F.when(F.col("errors").isNull(), 0).otherwise(F.size("errors")).alias("error_count"), "created_at",
    ).orderBy(F.desc("created_at"))


def global_stats(sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(sources, "sources").crossJoin(one(documents, "documents")).crossJoin(one(chunks, "chunks"))  # one row each


def documents_of(documents: DataFrame, source_id: str) -> DataFrame:
    return documents.where(F.col("source_id") == source_id).orderBy("uri")


def chunks_of(chunks: DataFrame, doc_id: str, modality: str | None = None) -> DataFrame:
    """A document's chunks in order; chunks without a modality are text."""
    mine = chunks.where(F.col("doc_id") == doc_id)
    if modality is not None:
        mine = mine.where(F.coalesce("modality", F.lit("text")) == modality)
    return mine.orderBy("chunk_index")


def completions(sources: DataFrame, shell: str) -> DataFrame:
    label = F.coalesce("name", "uri")
    line = {"zsh": F.concat("id", F.lit(":"), F.replace(label, F.lit(":"), F.lit("\\:"))), "fish": F.concat("id", F.lit("\t"), label)}.get(shell, F.col("id"))
    return sources.select(line.alias("line"))
