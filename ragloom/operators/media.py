"""Images of indexed pages: chosen, fetched where the rows lie, gated, and made into chunks beside the texts.

A page's image chunks count down from -1, so they never meet the texts' chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import frontier
from ..sources.web import CrawlLimits
from . import images

#: Takes an address and gives (status, content type, bytes); it is sent to the tasks.
BytesFetcher = Callable[[str], tuple[int, str, bytes]]
#: Takes an image's bytes and gives its 64 grey values in 8 x 8, or None if it cannot be read.
Luma = Callable[[bytes], list[int] | None]


def wanted(docs: DataFrame, least: float, most: int, css: bool, prefixes: tuple[str, ...]) -> DataFrame:
    """docs: id, title, headings, media.  (page, url, alt, context, relevance) of the images worth fetching, at most ``most`` a page."""
    heads = F.transform("headings", lambda h: h["text"])
    rows = docs.select(F.col("id").alias("page"), "title", heads.alias("headings"), F.explode("media").alias("m"))
    rows = rows.select("page", "title", "headings", "m.url", "m.alt", "m.css_background")
    found = images.candidates(rows, least, most, css, prefixes)
    return found.select("page", "url", "alt", images.context(F.col("alt"), F.col("title"), F.col("headings")).alias("context"), "relevance")


def fetched(rows: DataFrame, fetch: BytesFetcher, limits: CrawlLimits, luma: Luma | None = None) -> DataFrame:
    """``rows`` with content_type, data, size, sha and hash; what cannot be fetched goes.

    Each address is asked once, by the task that has its host, under the
    host's robots rules and at the pace that it is owed.
    """
    targets = rows.select("url").distinct().withColumn("rank", F.xxhash64("url"))
    got = frontier.fetch_all(targets, fetch, limits, body="body binary").where("error is null").select("url", "content_type", F.col("body").alias("data"))
    return hashed(rows.join(got, "url"), luma).withColumn("size", F.length("data")).withColumn("sha", F.sha2("data", 256))


def hashed(rows: DataFrame, luma: Luma | None) -> DataFrame:
    """``rows`` (data, ...) with the perceptual hash, null where ``luma`` is none or cannot read the image."""
    if luma is None:
        return rows.withColumn("hash", F.lit(None).cast("long"))

    def run(batches):
        for b in batches:
            found = []
            for data in b.column("data").to_pylist():
                grey = luma(data)
                value = None if grey is None else images.average_hash(grey)
                found.append(None if value is None else value - (1 << 64) if value >> 63 else value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*b.schema.names, "hash"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, hash long")


def assets(docs: DataFrame, fetch: BytesFetcher, limits: CrawlLimits, luma: Luma | None = None, least_bytes: int = images.LEAST_BYTES, most_bytes: int = images.MOST_BYTES, **choice) -> DataFrame:
    """(doc_id, chunk_index, url, alt, context, content_type, sha, data) of the images to be indexed.

    No SVG, sizes in range, equal bytes and near images once a page.
    """
    rows = images.acceptable(fetched(wanted(docs, **choice), fetch, limits, luma), least_bytes, most_bytes)
    place = Window.partitionBy("page").orderBy(F.desc("relevance"), "url")  # at most ``most`` rows a page
    rows = rows.withColumn("place", F.row_number().over(place))
    if luma:
        kept = images.distinct(rows.select("page", F.col("place").alias("id"), "hash"))
        rows = rows.join(kept.withColumnRenamed("id", "place"), ["page", "place"], "left_semi")
    return rows.select(F.col("page").alias("doc_id"), (-F.col("place")).alias("chunk_index"), "url", "alt", "context", "content_type", "sha", "data")


def chunks(found: DataFrame) -> DataFrame:
    """Chunks of assets: the alternative text or the address stands for the image's text."""
    at = F.concat_ws(":", "doc_id", "chunk_index")
    return found.select(
        at.alias("id"), "doc_id", "chunk_index", F.col("sha").alias("chunk_hash"), F.coalesce(F.nullif(F.trim("alt"), F.lit("")), "url").alias("chunk_text"),
        T.point_id(F.concat(at, F.lit(":"), F.col("sha"))).alias("point_id"), F.lit("image").alias("modality"), F.col("url").alias("media_url"), F.col("sha").alias("media_hash"),
    )
