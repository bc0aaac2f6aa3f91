"""What a user asks of an index: ingest, update, prune, remove, rename, reindex, query, status.

Each command is a few lazy plans over the stored tables.  The next state of
every table is staged first and then becomes current at once, so a command
that fails leaves the index as it was, but for the record of its run.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config
from . import models
from .embedders import Embedder, HashEmbedder, http_rerank, post_json
from .errors import ConfigError, EngineError, FetchError, SourceNotFound
from .functions import html as H
from .functions import text as T
from .operators import chunk as C
from .operators import media, merge, parse, pixels, status
from .plans import search as S
from .plans import vectors as X
from .schemas import ASSETS, CHUNKS, DOCUMENTS, KEYS, POINTS, RUNS, SOURCES
from .sources import files, frontier, web
from .sources.fetch import bytes_fetcher
from .sources.store import MOST, WHOLE, Store, buckets_for

SEEN = "uri string, text string, content_hash string, content_type string, title string"


@dataclass
class Stats:
    source_id: str = ""
    docs_seen: int = 0
    docs_changed: int = 0
    docs_deleted: int = 0
    chunks_created: int = 0
    chunks_deleted: int = 0
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def _like(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a stored table, in order and type; what is missing is null."""
    empty = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty])


def _contains(kind: str, outer: str, inner: str) -> bool:
    """Folders by whole components; addresses by host and the text of the path."""
    if kind == "dir":
        return (inner.rstrip("/") + "/").startswith(outer.rstrip("/") + "/")
    return (urlsplit(inner).path or "/").startswith(urlsplit(outer).path or "/")


def overlaps(stored: list[tuple[str, str, str, str | None]], source_type: str, uri: str) -> list[str]:
    """Warnings for a new source about those of (id, type, uri, name) that are it, hold it, or are held by it.

    Folders are set against folders, sites and sitemaps of one host against both.
    """
    web_kinds, out = ("url", "sitemap"), []
    for at, kind, other, name in stored:
        if source_type == "dir" and kind != "dir" or source_type in web_kinds and (kind not in web_kinds or urlsplit(other).hostname != urlsplit(uri).hostname):
            continue
        held, holds = _contains(source_type, other, uri), _contains(source_type, uri, other)
        known = f"{name or other} ({at})"
        if held and holds:
            out.append(f"{uri} is indexed already as {known}")
        elif held:
            out.append(f"{uri} lies inside {known}: its documents may be indexed twice")
        elif holds:
            out.append(f"{uri} holds {known}: its documents may be indexed twice")
    return out


class Index:
    def __init__(self, store: Store, config: Config | None = None, embedder: Embedder | None = None, image_fetch: media.BytesFetcher | None = None, luma: media.Luma | None = pixels.luma, renderer: web.Renderer | None = None):
        """``luma`` reads images for perceptual hashes (by default PNG and GIF), ``renderer`` runs scripts; without one neither is done."""
        self.store, self.spark = store, store.spark
        self.config = (config or Config()).validate()
        self.embedder = embedder or HashEmbedder()
        self.image_fetch = image_fetch or bytes_fetcher(self.config.crawl.user_agent, self.config.crawl.timeout_secs, self.config.multimodal.max_asset_bytes)
        self.luma, self.renderer = luma, renderer
        store.dim = store.dim or self.embedder.dim

    # -- sources ---------------------------------------------------------------

    def find_source(self, name: str):
        """A source by id, address or name."""
        s = self.store.table("sources").where((F.col("id") == name) | (F.col("uri") == name) | (F.col("name") == name))
        row = s.orderBy(F.col("id") != name, F.col("uri") != name).first()
        if row is None:
            raise SourceNotFound(name)
        return row

    def _write(self, dropped: tuple[str, ...] = (), **tables: Callable[[], DataFrame]) -> None:
        """Whole tables that are not kept by source, and sources that go, become current at once."""

        def write():
            for name, made in tables.items():
                self.store.stage(name, made().coalesce(1))

        self.store.change(write, dropped)

    def rename(self, source: str, name: str | None) -> None:
        at, stored = self.find_source(source).id, lambda: self.store.table("sources")
        if name and stored().where((F.col("name") == name) & (F.col("id") != at)).count():
            raise ConfigError(f"another source is named {name}")
        self._write(sources=lambda: stored().withColumn("name", F.when(F.col("id") == at, F.lit(name)).otherwise(F.col("name"))))

    def remove(self, source: str) -> None:
        """A source's parts of all tables go with it; nothing of other sources is read or written."""
        at = self.find_source(source).id
        self._write((at,), sources=lambda: self.store.table("sources").where(F.col("id") != at))

    def sources(self) -> DataFrame:
        t = self.store.table
        return status.list_sources(t("sources"), t("documents"), t("chunks"), t("runs"))

    def status(self) -> DataFrame:
        """One row: the counts of the index, and whether the vectors' store can be read and has a collection."""
        try:
            m = self.store.manifest()
        except Exception:  # the store is not there or cannot be reached
            row = [(False, False, 0, 0, 0, 0)]
            return self.spark.createDataFrame(row, "connected boolean, collection boolean, points long, sources long, documents long, chunks long")
        t = self.store.table
        counts = status.global_stats(t("sources"), t("documents"), t("chunks"))
        points = t("points").agg(F.count("*").alias("points"))
        return counts.crossJoin(points).select(F.lit(True).alias("connected"), F.lit(bool(m["dim"])).alias("collection"), "points", "sources", "documents", "chunks")  # one row each

    # -- look-ups ----------------------------------------------------------------

    def documents(self, source: str) -> DataFrame:
        """A source's documents by address."""
        return status.documents_of(self.store.table("documents", at := self.find_source(source).id), at)

    def document(self, source: str, uri: str):
        """A source's document of an address, or None."""
        return self.store.table("documents", self.find_source(source).id).where(F.col("uri") == uri).first()

    def chunks(self, source: str, doc_id: str, modality: str | None = None) -> DataFrame:
        """A document's chunks in order, of one modality if asked."""
        return status.chunks_of(self.store.table("chunks", self.find_source(source).id), doc_id, modality)

    def chunk(self, point_id: str):
        return self.store.table("chunks").where(F.col("point_id") == point_id).first()

    def point_ids(self, source: str | None = None) -> DataFrame:
        """The points that chunks name, of all sources or of one."""
        return self.store.table("chunks", None if source is None else self.find_source(source).id).select("point_id").distinct()

    # -- ingest ------------------------------------------------------------------

    def ingest_dir(self, path: str, name: str | None = None, endings: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Stats:
        if not os.path.isdir(path):
            raise ConfigError(f"{path} is not a folder")
        root = os.path.realpath(path)
        with self._listed(root, endings, exclude) as listed:
            return self.ingest("dir", root, files.read_files(listed), name)

    @contextmanager
    def _listed(self, root: str | list[str], endings: tuple[str, ...] = (), exclude: tuple[str, ...] = ()):
        """The files of a folder, as long as the block lasts."""
        at = f"{self.store.root}/listing/{uuid.uuid4().hex}"
        try:
            yield files.list_files(self.spark, root, at, endings, exclude)
        finally:
            self.store.fs.delete(self.store.path(at), True)

    def ingest_url(self, url: str, fetch: web.Fetcher, name: str | None = None, operation: str = "ingest", **limits) -> Stats:
        settings = self.config.crawling(**limits)
        crawled = self._crawl(frontier.seeds_of(self.spark, [("", url)], settings), fetch, settings)
        try:
            pages, errors = crawled.pages(), self._failures(crawled, settings)
            if self.config.crawl.auto_js_rendering and self.renderer is not None and not pages.isEmpty():
                rows = [r.asDict() for r in pages.orderBy("rank").select("url", "html", "content_type", "depth", "links").collect()]  # at most max_pages, and rendering is not Spark's
                rendered, failed = web.render_pages(rows, self._scripted(rows), self.renderer, settings.max_pages)
                pages = self.spark.createDataFrame([(p["url"], p["html"], p["content_type"]) for p in rendered], "url string, html string, content_type string")
                errors += failed
            # a crawl that reached nothing tells nothing about what is gone
            return self.ingest("url", web.normalize_url(url), self._pages(pages), name, operation, whole=not pages.isEmpty(), errors=errors)
        finally:
            crawled.delete()

    def _crawl(self, seeds: DataFrame, fetch: web.Fetcher, limits: web.CrawlLimits) -> frontier.Crawl:
        crawl = frontier.Crawl(self.spark, f"{self.store.root}/crawl", limits, fetch)
        try:
            return crawl.run(seeds)
        except Exception:
            crawl.delete()
            raise

    def _failures(self, crawled: frontier.Crawl, limits: web.CrawlLimits) -> list[str]:
        """What could not be had, in order; a report, so no more than the attempts that a crawl has."""
        return [r.error for r in crawled.errors().orderBy("rank").limit(limits.attempts).collect()]

    def ingest_sitemap(self, url: str, fetch: web.Fetcher, name: str | None = None, operation: str = "ingest") -> Stats:
        """Up to ``crawl.max_pages`` pages that a sitemap names; one that names none makes no source."""
        entries, failed = web.read_sitemaps(url, fetch)
        if not entries:
            return Stats(errors=[f"{failed} sitemaps could not be read"] if failed else [])
        limits = self.config.crawling(max_depth=0)
        listed = [e["loc"] for e in entries][: limits.max_pages]
        seeds = self.spark.createDataFrame([("", u, 0, 0, n, [], "") for n, u in enumerate(dict.fromkeys(listed))], frontier.QUEUE)
        crawled = self._crawl(seeds, fetch, limits)
        try:
            return self.ingest("sitemap", url, self._pages(crawled.pages()), name, operation, errors=self._failures(crawled, limits), listed=listed)
        finally:
            crawled.delete()

    def _scripted(self, pages: list[dict]) -> dict[str, list[str] | None]:
        """The pages that need scripts, with their hash routes, or None for those without."""
        rows = self.spark.createDataFrame([(p["url"], p["html"]) for p in pages if "html" in p["content_type"]], "url string, html string")
        found = rows.select("url", H.analyze(F.col("html")).alias("a")).where("a.needs_js").select("url", F.when(F.col("a.uses_hash_routing"), F.col("a.hash_routes")).alias("routes"))
        return {r.url: r.routes for r in found.collect()}  # at most max_pages

    def _pages(self, pages: DataFrame) -> DataFrame:
        rows = pages.select(F.col("url").alias("uri"), F.col("html").alias("text"), F.col("content_type").alias("mime")).dropDuplicates(["uri"])
        return rows.select("uri", "text", T.content_hash(F.col("text")).alias("content_hash"), T.content_type(F.col("uri"), F.col("mime")).alias("content_type"))

    def ingest(self, source_type: str, uri: str, seen: DataFrame, name: str | None = None, operation: str = "ingest", whole: bool = True, errors: list[str] = (), listed: list[str] = ()) -> Stats:
        """Bring a source to the state of ``seen`` (``SEEN``; title optional), one row an address.

        Only documents whose hash changed are parsed, chunked and embedded.
        With ``whole``, stored documents that neither ``seen`` nor ``listed``
        (addresses that exist, but could not be read) has go.
        """
        store, now = self.store, datetime.now(timezone.utc)
        known = store.table("sources").select("source_type", "uri", "id", "name").collect()  # one row a source
        source_id = next((r.id for r in known if r.uri == uri), str(uuid.uuid5(uuid.NAMESPACE_URL, uri)))
        out = Stats(source_id, errors=list(errors), warnings=[] if any(r.uri == uri for r in known) else overlaps([(r.id, r.source_type, r.uri, r.name) for r in known], source_type, uri))
        run = {"id": str(uuid.uuid4()), "source_id": source_id, "operation": operation, "started_at": now, "status": "running"}
        if not any(r.id == source_id for r in known):
            if name and any(r.name == name for r in known):
                raise ConfigError(f"another source is named {name}")
            row = self.spark.createDataFrame([(source_id, source_type, uri, name, now, now, None)], SOURCES)
            store.upsert(sources=row)
        self._run(run)
        try:
            self._apply(out, source_type, uri, seen, now, whole, listed)
        except Exception as e:
            store.unstage()
            self._run(run | {"status": "failed", "completed_at": datetime.now(timezone.utc), "errors": [*out.errors, str(e)[:500]]})
            raise
        self._run(run | {"status": "completed", "completed_at": datetime.now(timezone.utc), "docs_processed": out.docs_changed, "chunks_created": out.chunks_created, "chunks_updated": 0, "chunks_deleted": out.chunks_deleted, "errors": out.errors})
        return out

    def _run(self, values: dict) -> None:
        empty = self.spark.createDataFrame([], RUNS)
        self.store.log(self.spark.createDataFrame([tuple(values.get(c) for c in empty.columns)], RUNS), values["source_id"])

    def _apply(self, out: Stats, source_type: str, uri: str, seen: DataFrame, now: datetime, whole: bool, listed: list[str]) -> None:
        store, at, sid = self.store, out.source_id, F.lit(out.source_id)
        old = {n: store.table(n, at) for n in ("documents", "chunks", "points")}
        seen = seen.withColumn("source_id", sid)
        changed = merge.changed(seen, old["documents"], ["source_id", "uri"]).withColumn("id", F.expr("sha2(concat(source_id, '\n', uri), 256)"))
        parsed = parse.parse_documents(changed, base="uri")
        title = F.coalesce(*(["title"] if "title" in seen.columns else []), F.col("parsed.title"))
        # the changed documents are parsed once, into a folder that is not published
        fresh = store.stage("parsed", parsed.select("id", "source_id", "uri", "content_hash", "content_type", title.alias("title"), F.col("parsed.text").alias("text"), F.col("parsed.headings").alias("headings"), F.col("parsed.media").alias("media")))
        parsed_at = store.staged.pop()
        try:
            exists = seen.select("uri").unionByName(self.spark.createDataFrame([(u,) for u in listed], "uri string"))
            gone = merge.stale(old["documents"], exists).select("id") if whole else old["documents"].where("false").select("id")
            out.docs_seen, out.docs_changed, out.docs_deleted = seen.count(), fresh.count(), gone.count()
            if out.docs_changed or out.docs_deleted:
                self._write_changes(out, old, fresh, gone, now, source_type, uri)
        finally:
            store.fs.delete(store.path(f"{store.root}/{parsed_at[3]['at'][0]}"), True)

    def _write_changes(self, out: Stats, old: dict[str, DataFrame], fresh: DataFrame, gone: DataFrame, now: datetime, source_type: str, uri: str) -> None:
        """New documents alone are appended to the source's parts; where stored ones change or go, its parts are written anew."""
        store, at = self.store, out.source_id
        new_docs = _like(fresh.drop("headings", "text", "media").withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now)), DOCUMENTS)
        found = C.chunk_documents(fresh, "id", "text", "headings", self.config.chunking())
        found = found.withColumn("id", F.concat_ws(":", "doc_id", "chunk_index")).withColumn("point_id", T.point_id(F.concat_ws(":", "id", "chunk_hash")))
        found = found.withColumn("modality", F.lit("text"))
        new_source = not store.parts("documents").get(at)
        deal = buckets_for(out.docs_changed) if new_source else None
        append = not out.docs_deleted and store.appendable(at) and not old["documents"].join(fresh.select("id"), "id", "left_semi").count()
        touched, lost = fresh.select(F.col("id").alias("doc_id")), gone.select(F.col("id").alias("doc_id"))
        # a change writes the buckets of its documents anew; a part of too many folders is written as a whole, and dealt anew
        hit = None
        if not append and not new_source and store.appendable(at):
            hit = sorted(r.b for r in touched.unionByName(lost).select(store.bucket("doc_id", at).alias("b")).distinct().collect())  # at most ``MOST``
            old = {n: store.table(n, at, hit) for n in old}
        elif not append and not new_source:
            deal = buckets_for(old["documents"].count() + out.docs_changed)
        pictures = self._pictures(fresh, source_type)
        if pictures is not None:
            if not append:
                pictures = merge.delete(store.table("assets", at), touched.unionByName(lost), ["doc_id"]).unionByName(pictures)
            pictures = store.stage("assets", pictures, at, append)  # each is fetched once
            found = found.unionByName(media.chunks(pictures.join(touched, "doc_id", "left_semi")), allowMissingColumns=True)
        new_chunks = _like(found.withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now)), CHUNKS)
        if append:
            docs = store.stage("documents", new_docs, at, append=True, deal=deal)
            chunks = store.stage("chunks", new_chunks, at, append=True, deal=deal)
            points = store.stage("points", self._embedded(chunks, docs, F.lit(source_type), F.lit(uri), pictures), at, append=True, deal=deal)
            out.chunks_created = points.count()
        else:
            documents = merge.delete(merge.upsert(old["documents"], new_docs, KEYS["documents"]), gone, ["id"])
            # of a changed document, chunks that it no longer has go
            left = merge.delete(old["chunks"], lost, ["doc_id"])
            again = left.join(touched, "doc_id", "left_semi").join(new_chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_semi")
            chunks = store.stage("chunks", left.join(touched, "doc_id", "left_anti").select(*left.columns).unionByName(merge.upsert(again.select(*left.columns), new_chunks, KEYS["chunks"])), at, buckets=hit, deal=deal)
            docs = store.stage("documents", documents, at, buckets=hit, deal=deal)
            kept = old["points"].join(chunks.select(F.col("point_id").alias("id")), "id", "left_semi")
            # only chunks without a stored point are embedded
            lacking = chunks.join(touched, "doc_id", "left_semi").join(old["points"].select(F.col("id").alias("point_id")), "point_id", "left_anti")
            points = store.stage("points", kept.unionByName(self._embedded(lacking, docs, F.lit(source_type), F.lit(uri), pictures)), at, buckets=hit, deal=deal)
            before = old["points"].select("id")
            out.chunks_created = points.select("id").join(before, "id", "left_anti").count()
            out.chunks_deleted = before.join(points.select("id"), "id", "left_anti").count()
        store.publish()

    def _pictures(self, fresh: DataFrame, source_type: str) -> DataFrame | None:
        """The images of changed pages that are to be indexed, as ``ASSETS``; None where settings ask for none."""
        m = self.config.multimodal
        if not (m.enabled and m.include_images) or source_type == "dir":
            return None
        found = media.assets(fresh, self.image_fetch, self.config.crawling(), self.luma, m.min_asset_bytes, m.max_asset_bytes, least=m.min_relevance_score, most=m.max_assets_per_page, css=m.include_css_backgrounds, prefixes=tuple(m.allowed_mime_prefixes))
        return _like(found, ASSETS)

    def _embedded(self, chunks: DataFrame, docs: DataFrame, source_type, source_uri, pictures: DataFrame | None = None) -> DataFrame:
        """Points of chunks; those of images need their assets."""
        d = docs.select(F.col("id").alias("doc_id"), "source_id", F.col("uri").alias("doc_uri"), "title")
        rows = chunks.where("modality = 'text'").withColumn("vector", self.embedder.column(F.col("chunk_text")).cast("array<float>"))
        if pictures is not None:
            seen = chunks.where("modality = 'image'").join(pictures.select("doc_id", "chunk_index", "data", "context"), ["doc_id", "chunk_index"])
            rows = rows.unionByName(seen.withColumn("vector", self.embedder.images(F.col("data"), F.col("context")).cast("array<float>")).select(*rows.columns))
        rows = rows.join(d, "doc_id").drop("id").withColumnRenamed("point_id", "id").withColumn("source_type", source_type).withColumn("source_uri", source_uri)
        return _like(self.store.with_norm(rows), POINTS)

    # -- maintenance -------------------------------------------------------------

    def update(self, fetch: web.Fetcher | None = None, prune: bool = True) -> tuple[list[Stats], list[str]]:
        """Ingest every source again; the errors of one source do not stop the others."""
        done, errors = [], []
        for s in self.store.table("sources").orderBy("created_at").collect():  # one row a source
            try:
                if s.source_type == "dir":
                    if not os.path.isdir(s.uri):
                        raise ConfigError(f"{s.uri} is not a folder")
                    with self._listed(s.uri) as listed:
                        done.append(self.ingest("dir", s.uri, files.read_files(listed), operation="update"))
                elif fetch is None:
                    raise FetchError("no fetcher was given")
                else:
                    done.append((self.ingest_url if s.source_type == "url" else self.ingest_sitemap)(s.uri, fetch, operation="update"))
            except EngineError as e:
                errors.append(f"{s.uri}: {e}")
        if prune:
            self.prune(orphans=True)
        return done, errors

    def prune(self, source: str | None = None, dry_run: bool = False, orphans: bool = False) -> dict[str, int]:
        """Drop documents of folder sources whose file is gone and, if asked, points that no chunk names.

        A source whose folder is not there is left alone: it may not be mounted.
        All sources are looked through together; only those that lose something
        are written, and of these only the buckets that do.
        """
        store, one = self.store, self.find_source(source).id if source else None
        mounted = [s for s in store.table("sources").collect() if s.source_type == "dir" and (one in (None, s.id)) and os.path.isdir(s.uri)]  # one row a source
        docs, chunks, points = (store.table(n, one) for n in ("documents", "chunks", "points"))
        with self._listed([s.uri for s in mounted]) as listed, self._kept() as keep:
            gone = keep("gone", merge.stale(docs.where(F.col("source_id").isin([s.id for s in mounted])), listed).select("source_id", "id"))
            lost_docs = gone.select(F.col("id").alias("doc_id"))
            lost = merge.orphans(points, merge.delete(chunks, lost_docs, ["doc_id"]))
            if not orphans:  # only the points of the documents that go
                lost = lost.join(chunks.join(lost_docs, "doc_id", "left_semi").select(F.col("point_id").alias("id")), "id", "left_semi")
            lost = keep("lost", points.join(lost.select("id").distinct(), "id", "left_semi").select("source_id", "id", "doc_id"))
            counts = {"documents": gone.count(), "points": lost.count()}
            if dry_run or not any(counts.values()):
                return counts
            hit: dict[str, set[int] | None] = {}
            where = gone.select("source_id", F.col("id").alias("d")).unionByName(lost.select("source_id", F.col("doc_id").alias("d")))
            for r in where.select("source_id", F.pmod(F.xxhash64("d"), F.lit(MOST)).alias("h"), F.col("d").isNull().alias("none")).distinct().collect():  # ``MOST`` rows a source that loses something
                if r.none:
                    hit[r.source_id] = None  # of a document that is not known
                elif hit.setdefault(r.source_id, set()) is not None:
                    hit[r.source_id].add(r.h % store.buckets(r.source_id))
            try:
                for at, found in hit.items():
                    some = None if found is None else sorted(found)
                    keys = {"documents": (gone, ["id"]), "chunks": (lost_docs, ["doc_id"]), "points": (lost, ["id"])}
                    for name, (gone_keys, on) in keys.items():
                        store.stage(name, merge.delete(store.table(name, at, some), gone_keys, on), at, buckets=some)
                store.publish()
            finally:
                store.unstage()
            return counts

    @contextmanager
    def _kept(self):
        """Tables that are written for the length of a block, as they are read more than once."""
        at = f"{self.store.root}/kept/{uuid.uuid4().hex}"

        def keep(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{at}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{at}/{name}")

        try:
            yield keep
        finally:
            self.store.fs.delete(self.store.path(at), True)

    def reindex(self, source: str | None = None) -> int:
        """Embed the stored chunks again, images too if they are asked for; nothing is read, fetched or cut anew."""
        store, total, one = self.store, 0, None if source is None else self.find_source(source).id
        try:
            for s in store.table("sources").collect():  # one row a source
                if one and s.id != one:
                    continue
                docs, points = store.table("documents", s.id), store.table("points", s.id)
                chunks, images = store.table("chunks", s.id), self.config.multimodal.enabled
                if not images:
                    chunks = chunks.where("modality = 'text'")
                new = self._embedded(chunks, docs, F.lit(s.source_type), F.lit(s.uri), store.table("assets", s.id) if images else None)
                rest = points.join(chunks.select(F.col("point_id").alias("id")), "id", "left_anti")
                store.stage("points", rest.unionByName(new), s.id)
                total += chunks.count()
            store.publish()
        finally:
            store.unstage()
        return total

    def optimize(self, parts: int | None = None) -> int:
        """Index the vectors of all folders of points that are current; later ones are scanned beside it until the next call."""
        store, at = self.store, f"vectors/{uuid.uuid4().hex}"
        covers = sorted(a for p in store.parts("points").values() for a in p["at"])
        points = store.table("points")
        rows = points.select("*", F.regexp_extract(F.col("_metadata.file_path"), "(points/[0-9a-f]+(?:/bucket=[0-9]+)?)/[^/]*$", 1).alias("folder")) if covers else points.withColumn("folder", F.lit(""))
        index = X.VectorIndex.build(rows, f"{store.root}/{at}", parts, (*S.FILTERS, "folder"))
        store.staged.append(("vectors", WHOLE, False, {"at": [at], "covers": covers}))
        try:
            store.publish()
        finally:
            store.unstage()
        return sum(p.n for p in index.parts)

    def nearest(self, query: list[float], k: int, where) -> DataFrame:
        """The k nearest points with ``score``: by the index what it covers, by a scan what is newer."""
        store = self.store
        current = {a for p in store.parts("points").values() for a in p["at"]}
        held = store.parts("vectors").get(WHOLE)
        covered = set(held["covers"]) if held else set()
        scanned = S.top_k(store.read_folders("points", sorted(current - covered)).where(where), query, k)
        if not held or not covered & current:
            return scanned
        gone = sorted(covered - current)
        found = X.VectorIndex(self.spark, f"{store.root}/{held['at'][0]}").top_k(query, k, where & ~F.col("folder").isin(gone) if gone else where).drop("folder")
        return found.unionByName(scanned, allowMissingColumns=True).orderBy(F.desc("score"), "id").limit(k) if current - covered else found

    # -- query -------------------------------------------------------------------

    def query(self, text: str, **options) -> DataFrame:
        """Hits for a text; with a model server behind the embedder, its reranker scores them, else BM25."""
        o = self.config.querying(**options)
        t, e, model = self.store.table, self.config.embedding, self.config.reranker.model
        chunks = t("chunks").select(F.col("point_id").alias("id"), "chunk_text")
        score = None
        if o.rerank and e.backend == "http":
            score = lambda query, texts: http_rerank(e.url, model, query, texts, getattr(self.embedder, "post", post_json))
        media = bool(models.reranker(model)) and models.reranker(model).multimodal
        return S.search(t("points"), chunks, text, self.embedder.one(self.spark, text), o, self.store.mean_length(), score, media, self.nearest)
