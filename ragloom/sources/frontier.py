"""Crawling over the cluster: a frontier in rounds, dealt by host.

A round takes from each source's queue as many addresses as its budget still
allows, in the order in which they were found, and deals them by host.  A task
keeps its hosts' robots rules and due times and always calls the host that is
due first, several at once; what it found goes to a folder before the next round
reads it, so a lost task asks its own hosts again and no others.  New addresses are
those of a round's links that were never queued before, an anti-join.  Pages,
tries and depths are those of ``web.crawl``, which does the same one by one.

Addresses of sitemaps and of images go the same way without following links.
"""

from __future__ import annotations

import heapq
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .web import CrawlLimits, Fetcher, Robots, links_of, normalize_url, should_crawl

#: Hosts that a task calls at once.
LANES = 8
RULED_OUT = "ruled out by robots.txt"
_ANSWER = "status int, content_type string, {body}, final_url string, error string, tried boolean, at double, robots string"
QUEUE = "source_id string, url string, depth int, parent long, place int, hosts array<string>, prefix string"
#: What is known of hosts: when each may be called again (seconds since 1970), and its robots rules, null if never read.
HOSTS = "host string, due double, robots string"


def host_of(url: str) -> Column:
    """The host of an address with its port, empty where there is none."""
    return F.regexp_extract(url, "(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


class Courtesy:
    """Robots rules and due times of the hosts of one task."""

    def __init__(self, fetch: Callable, rate: float, agent: str, robots: bool, known: dict[str, tuple[float, str | None]]):
        self.fetch, self.gap, self.agent, self.robots = fetch, 1.0 / rate, agent, robots
        self.due = {h: due for h, (due, _) in known.items()}
        self.rules = {h: Robots(r) for h, (_, r) in known.items() if r is not None}

    def call(self, host: str, url: str) -> dict:
        """One answer; the robots rules come with the first of a host that has none yet."""
        out = dict.fromkeys(("status", "content_type", "body", "final_url", "error", "robots")) | {"tried": False, "at": time.time()}
        if self.robots and host not in self.rules:
            out["robots"] = self._read_rules(url)
            self.rules[host] = Robots(out["robots"])
        if self.robots and not self.rules[host].is_allowed(urlsplit(url).path, self.agent):
            return out | {"error": RULED_OUT}
        out |= {"tried": True, "at": time.time()}
        self.due[host] = out["at"] + self.gap
        try:
            status, kind, body, *rest = self.fetch(url)
        except Exception as e:  # noqa: BLE001 - one address never stops a crawl
            return out | {"error": str(e)}
        final = rest[0] if rest else url
        return out | {"status": status, "content_type": kind, "final_url": final} | ({"body": body} if 200 <= status < 300 else {"error": f"status {status}"})

    def _read_rules(self, url: str) -> str:
        p = urlsplit(url)
        try:
            status, _, body, *_ = self.fetch(f"{p.scheme}://{p.netloc}/robots.txt")
        except Exception:  # noqa: BLE001 - a host without rules allows all
            return ""
        body = body.decode("utf-8", "replace") if isinstance(body, bytes) else body
        return body if 200 <= status < 300 else ""


def _answers(targets: dict[str, list[tuple[int, str]]], courtesy: Courtesy, lanes: int):
    """(place, answer) of the targets (host -> places and addresses in order), each host's one after the other."""
    ready = [(courtesy.due.get(h, 0.0), h) for h in targets]
    heapq.heapify(ready)
    left = {h: iter(t) for h, t in targets.items()}
    with ThreadPoolExecutor(lanes) as pool:
        running: dict = {}
        while ready or running:
            while ready and len(running) < lanes and ready[0][0] <= time.time():
                _, host = heapq.heappop(ready)
                if (target := next(left[host], None)) is not None:
                    running[pool.submit(courtesy.call, host, target[1])] = (host, target[0])
            pause = max(0.0, ready[0][0] - time.time()) if ready and len(running) < lanes else None
            if not running:
                time.sleep(pause or 0.0)
                continue
            done, _ = wait(running, timeout=pause, return_when=FIRST_COMPLETED)
            for d in done:
                host, place = running.pop(d)
                yield place, d.result()
                heapq.heappush(ready, (courtesy.due.get(host, 0.0), host))


def fetch_all(targets: DataFrame, fetch: Callable, limits: CrawlLimits, hosts: DataFrame | None = None, body: str = "body string", lanes: int = LANES) -> DataFrame:
    """``targets`` (url, rank, ...) with answers: status, content_type, body, final_url, error, tried, at, robots.

    A host's addresses are asked in one task by ``rank``, at least 1 / rate
    seconds apart and not before its due time in ``hosts``.  Rows of other
    statuses than 2xx have an error and no body.
    """
    spark = targets.sparkSession
    names = targets.columns
    answer = _ANSWER.format(body=body)
    kept = spark.createDataFrame([], answer).schema
    rows = targets.withColumn("_host", host_of("url")).select("_host", F.lit(True).alias("_target"), F.lit(None).cast("double").alias("_due"), F.lit(None).cast("string").alias("_robots"), *names)
    if hosts is not None:
        known = hosts.join(rows.select(F.col("_host").alias("host")).distinct(), "host", "left_semi")
        rows = rows.unionByName(known.select(F.col("host").alias("_host"), F.lit(False).alias("_target"), F.col("due").alias("_due"), F.col("robots").alias("_robots")), allowMissingColumns=True)
    rate, agent, robots = limits.rate, limits.agent, limits.respect_robots

    def run(batches):
        held, known, todo, place = [], {}, {}, 0
        for b in batches:  # addresses only
            for i, (host, target, due, rules, url) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_host", "_target", "_due", "_robots", "url")), strict=True)):
                if target:
                    todo.setdefault(host, []).append((place + i, url))
                else:
                    known[host] = (due or 0.0, rules)
            held.append(b)
            place += b.num_rows
        table = pa.Table.from_batches(held).select(names) if held else None
        for at, found in _answers(todo, Courtesy(fetch, rate, agent, robots, known), lanes):
            row = table.slice(at, 1).to_batches()[0]  # one answer a batch, as bodies may be large
            yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([found[f.name]], pa.binary() if f.name == "body" and body.endswith("binary") else _arrow(f)) for f in kept)], [*names, *(f.name for f in kept)])

    schema = ", ".join(f"`{c}` {t}" for c, t in targets.dtypes)
    # a number, as adaptive execution would join tasks of few addresses, which wait for hosts, not for data
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(tasks, "_host").sortWithinPartitions("_host", "_target", "rank")
    return dealt.mapInArrow(run, f"{schema}, {answer}")


def _arrow(f):
    return {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}[f.dataType.simpleString()]


def in_scope(url: str, hosts: list[str], prefix: str) -> bool:
    p = urlsplit(url)
    return p.scheme in ("http", "https") and p.hostname in hosts and p.path.startswith(prefix) and should_crawl(url)


def with_links(rows: DataFrame) -> DataFrame:
    """Answers with ``links``, all of a page in order, and ``next``, those a crawl of the source may follow."""

    def run(batches):
        for b in batches:
            links, further = [], []
            for kind, body, final, hosts, prefix in zip(*(b.column(c).to_pylist() for c in ("content_type", "body", "final_url", "hosts", "prefix")), strict=True):
                found = [urljoin(final, h) for h in links_of(body)] if body and "html" in (kind or "") else []
                links.append(found)
                further.append([u for u in map(lambda h: normalize_url(h, True), found) if in_scope(u, hosts, prefix)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(links, pa.list_(pa.string())), pa.array(further, pa.list_(pa.string()))], [*b.schema.names, "links", "next"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, links array<string>, next array<string>")


def from_table(pages: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A visit that answers from stored pages (url, content_type, body) instead of the web; absent ones are 404."""

    def visit(targets: DataFrame, hosts: DataFrame) -> DataFrame:
        found = targets.join(pages.select("url", "content_type", "body", F.lit(True).alias("held")), "url", "left")
        status = F.when(F.col("held"), 200).otherwise(404)
        return found.select(*targets.columns, status.alias("status"), "content_type", "body", F.col("url").alias("final_url"), F.when(F.col("held").isNull(), F.lit("status 404")).alias("error"), F.lit(True).alias("tried"), F.lit(0.0).alias("at"), F.lit(None).cast("string").alias("robots"))

    return visit


def seeds_of(spark: SparkSession, sources: list[tuple[str, str]], limits: CrawlLimits) -> DataFrame:
    """Queue rows of (source_id, address): a source's scope is its own host and folder, if limits name no other."""
    rows = []
    for source_id, url in sources:
        url = normalize_url(url, True)
        hosts = sorted({h.lower() for h in limits.allowed_hosts}) or [urlsplit(url).hostname or ""]
        prefix = limits.path_prefix if limits.path_prefix is not None else urlsplit(url).path.rpartition("/")[0] + "/"
        rows.append((source_id, url, 0, 0, 0, hosts, prefix))
    return spark.createDataFrame(rows, QUEUE)


class Crawl:
    """A crawl of many sources; its rounds are folders under ``folder``, which its owner deletes."""

    def __init__(self, spark: SparkSession, folder: str, limits: CrawlLimits, fetch: Fetcher | None = None, visit: Callable | None = None, lanes: int = LANES):
        self.spark, self.folder, self.limits = spark, f"{folder.rstrip('/')}/{uuid.uuid4().hex}", limits
        self.visit = visit or (lambda targets, hosts: fetch_all(targets, fetch, limits, hosts, lanes=lanes))
        self.rounds: list[str] = []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def run(self, seeds: DataFrame) -> Crawl:
        """``seeds``: (source_id, url, depth, parent, place, hosts, prefix), one row or more a source."""
        limits, key, began = self.limits, ["source_id", "url"], time.monotonic()
        queue = self._keep(seeds.dropDuplicates(key), "queue-0")
        seen = [queue.select(*key)]
        spent = queue.select("source_id").distinct().select("source_id", *(F.lit(0).cast("long").alias(c) for c in ("pages", "tries", "ranked")))
        hosts = self.spark.createDataFrame([], HOSTS)
        n = 0
        while limits.seconds is None or time.monotonic() - began <= limits.seconds:
            left = F.least(limits.max_pages - F.col("pages"), limits.attempts - F.col("tries"))
            place = F.row_number().over(Window.partitionBy("source_id").orderBy("parent", "place"))
            ready = queue.join(spent, "source_id").withColumn("n", place).where(F.col("n") <= left)
            ready = ready.select(*queue.columns, (F.col("ranked") + F.col("n")).alias("rank"))
            found = self._keep(with_links(self.visit(ready, hosts)), f"round-{n}")
            if found.isEmpty():
                break
            self.rounds.append(f"{self.folder}/round-{n}")
            ok = F.col("error").isNull()
            used = found.groupBy("source_id").agg(F.count(F.when(ok, 1)).alias("pages"), F.count(F.when(F.col("tried"), 1)).alias("tries"), F.count("*").alias("ranked"))
            spent = self._keep(spent.unionByName(used).groupBy("source_id").agg(*(F.sum(c).alias(c) for c in ("pages", "tries", "ranked"))), f"spent-{n}")
            called = found.groupBy(host_of("url").alias("host")).agg((F.max(F.when(F.col("tried"), F.col("at"))) + 1.0 / limits.rate).alias("due"), F.max("robots").alias("robots"))
            hosts = self._keep(hosts.unionByName(called).groupBy("host").agg(F.max("due").alias("due"), F.max("robots").alias("robots")), f"hosts-{n}")
            more = found.where(ok & (F.col("depth") < limits.max_depth)).select("source_id", "depth", "rank", "hosts", "prefix", F.posexplode("next").alias("place", "url"))
            first = F.min(F.struct(F.col("rank").alias("parent"), "place", "depth", "hosts", "prefix")).alias("f")
            new = more.groupBy(*key).agg(first)
            for old in seen:
                new = new.join(old, key, "left_anti")
            new = self._keep(new.select("source_id", "url", (F.col("f.depth") + 1).alias("depth"), "f.parent", "f.place", "f.hosts", "f.prefix"), f"new-{n}")
            queue = self._keep(queue.join(found.select(*key), key, "left_anti").unionByName(new), f"queue-{n + 1}")
            seen.append(new.select(*key))
            if len(seen) > 8:  # few joins a round, however many rounds
                whole = seen[0]
                for s in seen[1:]:
                    whole = whole.unionByName(s)
                seen = [self._keep(whole, f"seen-{n}")]
            n += 1
        return self

    def _read(self) -> DataFrame | None:
        return self.spark.read.parquet(*self.rounds) if self.rounds else None

    def visited(self) -> DataFrame:
        """source_id, url (as it was asked for), depth, rank, error: every address that was asked for or ruled out."""
        rows = self._read()
        names = ("source_id", "url", "depth", "rank", "error")
        return rows.select(*names) if rows is not None else self.spark.createDataFrame([], "source_id string, url string, depth int, rank long, error string")

    def pages(self) -> DataFrame:
        """source_id, url (where it led), html, content_type, depth, links, rank."""
        rows = self._read()
        if rows is None:
            return self.spark.createDataFrame([], "source_id string, url string, html string, content_type string, depth int, links array<string>, rank long")
        return rows.where("error is null").select("source_id", F.col("final_url").alias("url"), F.coalesce("body", F.lit("")).alias("html"), "content_type", "depth", "links", "rank")

    def errors(self) -> DataFrame:
        """source_id, rank, error: what could not be had, and why."""
        rows = self._read()
        if rows is None:
            return self.spark.createDataFrame([], "source_id string, rank long, error string")
        return rows.where("error is not null").select("source_id", "rank", F.concat("url", F.lit(": "), "error").alias("error"))

    def delete(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
