"""Keyed writes on immutable snapshots: upsert, delete, change detection, and what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ("id", "created_at"), version: str = "updated_at") -> DataFrame:
    """The newest row of each key; columns in ``keep`` stay what they were when the key was first seen.

    One shuffle on the keys: both window functions share it.  Of new rows with
    one key the latest version counts.
    """
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    group = Window.partitionBy(*keys)
    rows = both.withColumn("__last", F.row_number().over(group.orderBy(F.desc("__age"), F.desc(version))))
    first = group.orderBy("__age", version).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in keep:
        rows = rows.withColumn(c, F.first(c).over(first))
    return rows.where("__last = 1").select(*old.columns)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def changed(seen: DataFrame, stored: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """Rows that are new, or whose digest differs from what is stored."""
    return seen.join(stored.select(*keys, digest), [*keys, digest], "left_anti")


def stale(stored: DataFrame, current: DataFrame, key: str = "uri") -> DataFrame:
    """Stored rows of a source that the current listing does not have; an empty listing makes all of them stale."""
    return stored.join(current.select(key).distinct(), key, "left_anti")


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    return chunks.join(stored.select("doc_id", "chunk_hash").distinct(), ["doc_id", "chunk_hash"], "left_anti")


def chunks_from(chunks: DataFrame, doc_id: str, index: int) -> DataFrame:
    return chunks.where((F.col("doc_id") == doc_id) & (F.coalesce("modality", F.lit("text")) == "text") & (F.col("chunk_index") >= index))


def split_modality(chunks: DataFrame, doc_id: str, modality: str) -> tuple[DataFrame, DataFrame]:
    """(a document's chunks of a modality, all other chunks); chunks without a modality are text."""
    mine = F.coalesce((F.col("doc_id") == doc_id) & (F.coalesce("modality", F.lit("text")) == modality), F.lit(False))
    return chunks.where(mine), chunks.where(~mine)


def point_ids(chunks: DataFrame, documents: DataFrame | None = None, source_id: str | None = None) -> DataFrame:
    """The points that chunks name, of all sources or of one."""
    if documents is not None:
        chunks = chunks.join(documents.where(F.col("source_id") == source_id).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return chunks.select("point_id").distinct()


def orphans(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points that no chunk names, over all sources."""
    return points.select("id").join(chunks.select(F.col("point_id").alias("id")).distinct(), "id", "left_anti")


def cascade(tables: dict[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """All tables without a source; the points go first, as they are found through documents and chunks."""
    docs = tables["documents"].where(F.col("source_id") == source_id).select(F.col("id").alias("doc_id"))
    chunks = tables["chunks"].join(docs, "doc_id", "left_semi")
    out = dict(tables)
    out["points"] = tables["points"].join(chunks.select(F.col("point_id").alias("id")).distinct(), "id", "left_anti")
    out["chunks"] = tables["chunks"].join(docs, "doc_id", "left_anti")
    for name, column in (("documents", "source_id"), ("runs", "source_id"), ("sources", "id")):
        out[name] = tables[name].where(~F.col(column).eqNullSafe(source_id))
    return out
