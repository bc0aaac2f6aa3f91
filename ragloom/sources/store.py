"""The index's tables as Parquet folders behind numbered manifests.

A table is kept in parts, one for each source, and a part is a list of folders.
A write makes new folders and then a manifest of the next number that names
them; the highest manifest that is whole is the state of the index.  A crash
between the steps leaves the state before, and readers see all tables of one
state or of the next.  What a source writes touches its own parts only: new
rows are appended as more folders.  The parts of a large source are dealt into
buckets by a hash of the document, a folder each, and a change writes only the
buckets of the documents that it touches anew.  Paths
go through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, DimensionMismatch, StoreError
from ..functions import vec as V
from ..operators import merge
from ..schemas import KEYS, TABLES

#: The part of tables that are not kept by source.
WHOLE = ""
#: Folders of a part beyond which an append rewrites it as one.
FOLDERS = 16
#: Tables that are dealt into buckets, with the document's column; documents that a bucket should hold, and most buckets of a part.
BUCKETED, BUCKET, MOST = {"documents": "id", "chunks": "doc_id", "points": "doc_id"}, 500, 256
_IN_BUCKET = re.compile(r"/bucket=(\d+)$")
#: Columns that look-ups name: files are sorted by the first and have a Bloom filter for each, so a look-up skips files and row groups without its key.
LOOKED_UP = {"documents": ("uri", "id"), "chunks": ("doc_id", "point_id", "id"), "points": ("id",)}
#: Writers that may come first before one gives up.
RETRIES = 50
_MANIFEST = re.compile(r"manifest-(\d+)\.json")


def _within(folder: str, buckets: list[int] | None) -> bool:
    """Whether a folder may hold rows of these buckets."""
    m = _IN_BUCKET.search(folder)
    return buckets is None or m is None or int(m[1]) in buckets


def buckets_for(documents: int) -> int:
    """A power of two, so that buckets hold about ``BUCKET`` documents."""
    return min(MOST, 1 << max(0, math.ceil(math.log2(max(1, documents / BUCKET)))))


class Store:
    def __init__(self, spark: SparkSession, root: str, dim: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.staged: list[tuple[str, str, bool, dict]] = []
        #: The folders of each part when it was last read: what is staged in its place was made from these.
        self.seen: dict[tuple[str, str], list[str]] = {}
        jvm = spark._jvm
        self.path, self.io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self.exists():
            if any(self.fs.exists(self.path(f"{self.root}/{name}")) for name in TABLES):
                raise StoreError(f"{self.root} holds tables but no manifest that can be read")
            self._write_manifest({"dim": dim, "tables": {}}, self._next())  # or another writer's
        stored = self.manifest()["dim"]
        if dim and stored and dim != stored:
            raise DimensionMismatch(stored, dim)
        self.dim = stored or dim

    # -- manifests ---------------------------------------------------------------

    def _numbers(self) -> list[int]:
        """Numbers of the manifests, the highest first."""
        at = self.path(self.root)
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted((int(m[1]) for n in names if (m := _MANIFEST.fullmatch(n))), reverse=True)

    def _next(self) -> int:
        return max(self._numbers(), default=-1) + 1

    def _current(self) -> tuple[int, dict] | None:
        for n in self._numbers():
            stream = self.fs.open(self.path(f"{self.root}/manifest-{n:012d}.json"))
            try:
                return n, json.loads(self.io.toString(stream, "UTF-8"))
            except ValueError:  # cut short by a crash: the one before holds
                continue
            finally:
                stream.close()
        return None

    def exists(self) -> bool:
        return self._current() is not None

    def manifest(self) -> dict:
        found = self._current()
        if found is None:
            raise StoreError(f"{self.root} holds no manifest that can be read")
        return found[1]

    def _write_manifest(self, m: dict, number: int) -> bool:
        """Make ``m`` the manifest of a number; false if there is one already.

        It is written aside and renamed, which fails where the name is taken:
        a manifest is whole once it is seen, and of two writers one comes first.
        """
        aside, at = self.path(f"{self.root}/.manifest-{uuid.uuid4().hex}"), self.path(f"{self.root}/manifest-{number:012d}.json")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(aside, at, self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            if self.fs.exists(aside):
                self.fs.delete(aside, False)

    # -- reading -----------------------------------------------------------------

    def parts(self, name: str) -> dict[str, dict]:
        return self.manifest()["tables"].get(name, {})

    def buckets(self, source: str) -> int:
        """Into how many buckets a source's parts are dealt."""
        return self.parts("documents").get(source, {}).get("buckets", 1)

    def bucket(self, document: str, source: str) -> Column:
        return F.pmod(F.xxhash64(document), F.lit(self.buckets(source))).cast("int")

    def table(self, name: str, source: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table, or one source's part of it, or some buckets of that; of each run its last state."""
        parts = self.parts(name)
        if source is not None:
            parts = {k: v for k, v in parts.items() if k == source}
        for part in {*parts, WHOLE if source is None else source}:
            self.seen[name, part] = parts.get(part, {"at": []})["at"]
        return self.read_folders(name, [at for p in parts.values() for at in p["at"] if _within(at, buckets)])

    def read_folders(self, name: str, folders: list[str]) -> DataFrame:
        """A table as these folders of it have it."""
        empty = self.spark.createDataFrame([], TABLES[name])
        if not folders:
            return empty
        read = self.spark.read.schema(empty.schema).parquet(*(f"{self.root}/{at}" for at in folders))  # columns that older folders lack are null
        if name == "runs":
            done = F.struct(F.col("completed_at").isNotNull(), F.col("completed_at"))
            return read.groupBy("id").agg(F.max_by(F.struct(*[c for c in read.columns if c != "id"]), done).alias("r")).select("id", "r.*")
        return read.withColumn("modality", F.coalesce("modality", F.lit("text"))) if "modality" in read.columns else read

    def mean_length(self) -> float:
        """Mean bytes of a chunk's text, from the manifest."""
        found = [n for p in self.parts("chunks").values() for n in p.get("stats", {}).values()]
        rows = sum(n for n, _ in found)
        return sum(b for _, b in found) / rows if rows else 1.0

    # -- writing -----------------------------------------------------------------

    def stage(self, name: str, df: DataFrame, source: str = WHOLE, append: bool = False, buckets: list[int] | None = None, deal: int | None = None) -> DataFrame:
        """Write the next state of a part, of some ``buckets`` of it, or rows to be added to it; readers see them once ``publish`` is called.

        ``deal`` is the number of buckets of a part that is written as a whole, if it is not to stay.
        """
        at, held = f"{name}/{uuid.uuid4().hex}", self.parts(name).get(source, {"at": []})
        n = (deal or self.buckets(source)) if name in BUCKETED else 1
        entry: dict = {"at": [at]}
        self.staged.append((name, source, append, entry))
        keys = LOOKED_UP.get(name, ())
        rows = df.withColumn("bucket", F.pmod(F.xxhash64(BUCKETED[name]), F.lit(n)).cast("int")).hint("rebalance", "bucket") if n > 1 else df
        writer = (rows.sortWithinPartitions(*keys[:1]) if keys else rows).write.option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        (writer.partitionBy("bucket") if n > 1 else writer).parquet(f"{self.root}/{at}")
        if n > 1:
            entry |= {"at": sorted(f"{at}/{f.getPath().getName()}" for f in self.fs.listStatus(self.path(f"{self.root}/{at}")) if f.isDirectory()), "buckets": n}
        out = self.spark.read.schema(df.schema).parquet(*(f"{self.root}/{x}" for x in entry["at"])) if entry["at"] else self.spark.createDataFrame([], df.schema)
        if name == "chunks":
            folder = F.regexp_extract("_metadata.file_path", "(chunks/[0-9a-f]+(?:/bucket=[0-9]+)?)/[^/]*$", 1) if entry["at"] else F.lit("")
            sizes = out.select(folder.alias("at"), F.octet_length("chunk_text").alias("b")).groupBy("at").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
            entry["stats"] = {r["at"]: [r.n, int(r.b or 0)] for r in sizes.collect()}  # a row a bucket
        if name == "points":
            self._check(out)
        if buckets is not None and not append:
            kept = [x for x in held["at"] if not _within(x, buckets)]
            entry["at"] = kept + entry["at"]
            if "stats" in entry:
                entry["stats"] |= {x: held["stats"][x] for x in kept if x in held.get("stats", {})}
        return out

    def _check(self, points: DataFrame) -> None:
        """Vectors that were written have the collection's length."""
        sizes = [r.n for r in points.select(F.size("vector").alias("n")).distinct().limit(2).collect()]
        self.dim = self.dim or (sizes[0] if sizes else None)
        if bad := [n for n in sizes if n != self.dim]:
            raise DimensionMismatch(self.dim, bad[0])

    def publish(self, dropped: tuple[str, ...] = ()) -> None:
        """Make what was staged current, without the sources ``dropped``.

        If another writer made the next manifest meanwhile, that is read and
        changed in turn, so neither is lost.  Where what is staged replaces a
        part that is no longer as it was read, this is a ``ConflictError``.
        """
        for _ in range(RETRIES):
            number = self._next()
            m = self.manifest()
            for name, source, append, entry in self.staged:
                parts = m["tables"].setdefault(name, {})
                old, base = parts.get(source), self.seen.get((name, source))
                if not append and base is not None and (old or {"at": []})["at"] != base:
                    raise ConflictError(f"another writer changed {name} of {source or 'the index'}")
                parts[source] = entry | {"at": old["at"] + entry["at"]} | ({"stats": old.get("stats", {}) | entry["stats"]} if "stats" in entry else {}) if append and old else entry
            for parts in m["tables"].values():
                for source in dropped:
                    parts.pop(source, None)
            if self._write_manifest(m | {"dim": self.dim}, number):
                self.seen |= {(name, source): m["tables"][name][source]["at"] for name, source, _, _ in self.staged if source not in dropped}
                self.staged = []
                return
        raise ConflictError(f"{RETRIES} other writers came first")

    def change(self, write: Callable[[], None], dropped: tuple[str, ...] = ()) -> None:
        """Let ``write`` stage a change and publish it; if another writer came between, it stages it again from what there is now."""
        for n in range(RETRIES):
            try:
                write()
                self.publish(dropped)
                return
            except ConflictError:
                if n + 1 == RETRIES:
                    raise
            finally:
                self.unstage()

    def unstage(self) -> None:
        """Delete what was staged and is not to be current; buckets that stay as they are belong to the state there is."""
        for name, source, _, entry in self.staged:
            current = set(self.parts(name).get(source, {"at": []})["at"])
            for at in {*entry["at"]} - current:
                self.fs.delete(self.path(f"{self.root}/{_IN_BUCKET.sub('', at)}"), True)
        self.staged = []

    def appendable(self, source: str) -> bool:
        """Whether the source's parts are few folders; beyond that they are written as one."""
        return all(len((p := self.parts(n).get(source, {"at": []}))["at"]) < FOLDERS * p.get("buckets", 1) for n in BUCKETED)

    def log(self, row: DataFrame, source: str) -> None:
        """Add a state of a run; one folder of a source's runs in ``FOLDERS`` is a rewrite of them all."""

        def write():
            full = len(self.parts("runs").get(source, {"at": []})["at"]) >= FOLDERS
            rows = self.table("runs", source).unionByName(row) if full else row
            self.stage("runs", rows.coalesce(1), source, append=not full)

        self.change(write)

    def upsert(self, **rows: DataFrame) -> None:
        """Merge rows into their tables by key, source by source, and make all of it current together."""

        def write():
            for name, new in rows.items():
                by_source = "source_id" in new.columns
                for source in [r.source_id for r in new.select("source_id").distinct().collect()] if by_source else [WHOLE]:
                    mine = new.where(F.col("source_id") == source) if by_source else new
                    keep = tuple(c for c in ("id", "created_at") if c in new.columns and c not in KEYS[name])
                    version = {"runs": "started_at"}.get(name, "updated_at")
                    self.stage(name, merge.upsert(self.table(name, source), self.with_norm(mine) if name == "points" else mine, KEYS[name], keep if name not in ("runs", "points") else (), version), source)

        self.change(write)

    def with_norm(self, points: DataFrame) -> DataFrame:
        return points.withColumn("norm", V.norm(F.col("vector")))

    # -- upkeep ------------------------------------------------------------------

    def vacuum(self) -> int:
        """Delete folders and manifests that are not current; only while nobody reads or writes older states."""
        current, m = self._current()
        live = {at for parts in m["tables"].values() for p in parts.values() for at in p["at"]}
        gone = 0
        for folder in self.fs.listStatus(self.path(self.root)):
            if folder.isDirectory():
                for old in self.fs.listStatus(folder.getPath()):
                    name = f"{folder.getPath().getName()}/{old.getPath().getName()}"
                    inner = [f for f in self.fs.listStatus(old.getPath()) if f.getPath().getName().startswith("bucket=")] if old.isDirectory() else []
                    stay = {f.getPath().getName() for f in inner if f"{name}/{f.getPath().getName()}" in live}
                    if name not in live and not stay:
                        gone += bool(self.fs.delete(old.getPath(), True))
                    elif stay:
                        gone += sum(bool(self.fs.delete(f.getPath(), True)) for f in inner if f.getPath().getName() not in stay)
        for n in self._numbers():
            if n != current:
                self.fs.delete(self.path(f"{self.root}/manifest-{n:012d}.json"), False)
        return gone

    def reset(self) -> None:
        while not self._write_manifest({"dim": self.dim, "tables": {}}, self._next()):
            pass
