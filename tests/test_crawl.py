"""The crawl over the cluster against the crawl one by one, and its manners."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ragloom.sources import frontier, web


def site_of(seed, hosts=("a.org", "b.org"), pages=40):
    """A web of links in and out of scope, broken ones, loops, repeats and redirects."""
    rng = random.Random(seed)
    every = [f"http://{h}/d/{i}" for h in hosts for i in range(pages)]
    links = every + [f"{u}/" for u in every[:5]] + [f"{u}#top" for u in every[:5]] + ["/d/3", "4", "http://other.org/x", "http://a.org/up", "mailto:x@y", "http://a.org/d/broken", "http://a.org/d/2024/01/02/", "http://a.org/d/file.pdf"]
    return {u: "".join(f"<a href='{rng.choice(links)}'>x</a>" for _ in range(rng.randint(0, 7))) for u in every}


def fetcher(site, rules=""):
    def fetch(u):
        if u.endswith("/robots.txt"):
            return (200 if rules else 404), "text/plain", rules, u
        if zlib.crc32(u.encode()) % 7 == 0:
            raise web.FetchError("no answer")
        return (200, "text/html; charset=utf-8", site[u], u) if u in site else (404, "", "", u)

    return fetch


@pytest.mark.parametrize("limits", [{}, {"max_pages": 7}, {"max_depth": 1}, {"max_pages": 3, "max_depth": 9}, {"max_pages": 25, "path_prefix": "/", "allowed_hosts": ("a.org", "b.org")}, {"respect_robots": False}])
def test_pages_equal_those_of_the_crawl_one_by_one(spark, tmp_path, limits):
    settings = web.CrawlLimits(rate=10_000.0, **limits)
    fetch = fetcher(site_of(3), "User-agent: *\nDisallow: /d/1")
    sources = [("s1", "http://a.org/d/0"), ("s2", "http://b.org/d/2"), ("s3", "http://a.org/d/5")]
    got = frontier.Crawl(spark, f"file://{tmp_path}", settings, fetch).run(frontier.seeds_of(spark, sources, settings))
    pages, errors = defaultdict(list), defaultdict(list)
    for r in got.pages().orderBy("rank").collect():
        pages[r.source_id].append({"url": r.url, "html": r.html, "content_type": r.content_type, "depth": r.depth, "links": r.links})
    for r in got.errors().orderBy("rank").collect():
        errors[r.source_id].append(r.error)
    for source, url in sources:
        want, failed = web.crawl(url, fetch, settings, web.HostPace(1e9))
        assert pages[source] == want and sorted(errors[source]) == sorted(failed)
    got.delete()
    assert not list(tmp_path.iterdir())


def test_hosts_are_asked_at_their_pace_and_side_by_side(spark, tmp_path):
    hosts = [f"h{i}.org" for i in range(6)]
    site = {f"http://{h}/{i}": "".join(f"<a href='/{j}'>x</a>" for j in range(5)) for h in hosts for i in range(5)}
    limits = web.CrawlLimits(rate=20.0, max_depth=3, respect_robots=False)

    def fetch(u):
        return 200, "text/html", site[u], u

    crawl = frontier.Crawl(spark, f"file://{tmp_path}", limits, fetch)
    crawl.run(frontier.seeds_of(spark, [(h, f"http://{h}/0") for h in hosts], limits))
    rows = spark.read.parquet(*crawl.rounds).collect()
    assert len(rows) == 30 and len(crawl.rounds) == 2
    times = defaultdict(list)
    for r in rows:
        times[r.url.split("/")[2]].append(r.at)
    for t in times.values():
        t.sort()
        assert all(b - a >= 0.05 for a, b in zip(t, t[1:], strict=False))  # 1 / rate, across rounds too
    # within a task hosts take turns: those of one task overlap
    alone = frontier.fetch_all(spark.createDataFrame([(u, i) for i, u in enumerate(sorted(site))], "url string, rank int").coalesce(1), fetch, limits)
    spans = alone.groupBy(F.expr("parse_url(url, 'HOST')").alias("h")).agg(F.min("at").alias("a"), F.max("at").alias("b")).collect()
    assert max(s.a for s in spans) < min(s.b for s in spans)


def test_a_host_waits_for_its_due_time_and_keeps_its_rules(spark):
    import time

    due = time.time() + 0.4
    hosts = spark.createDataFrame([("x.org", due, "User-agent: *\nDisallow: /no"), ("y.org", 0.0, "")], frontier.HOSTS)
    targets = spark.createDataFrame([("http://x.org/yes", 1), ("http://x.org/no", 2), ("http://y.org/", 3), ("not an address", 4)], "url string, rank int")

    def fetch(u):
        return (500 if u.endswith("robots.txt") else 200), "text/html", "body", u  # asked for the host without a name only

    got = {r.url: r for r in frontier.fetch_all(targets, fetch, web.CrawlLimits(rate=100.0), hosts).collect()}
    assert got["http://x.org/yes"].at >= due and got["http://x.org/yes"].body == "body"
    assert (got["http://x.org/no"].error, got["http://x.org/no"].tried) == (frontier.RULED_OUT, False)
    assert got["http://y.org/"].robots is None and len(got) == 4


def test_a_host_belongs_to_one_task(spark, tmp_path):
    """So a task that is lost and run again asks its own hosts only, and each address is asked once otherwise."""
    from pyspark import TaskContext

    asked = tmp_path / "asked"
    asked.mkdir()

    def fetch(u):
        (asked / f"{u.split('/')[2]} {TaskContext.get().partitionId()} {random.random()}").write_text("")
        return 200, "text/html", "", u

    targets = spark.createDataFrame([(f"http://h{i}.org/{j}", j) for i in range(8) for j in range(3)], "url string, rank int").repartition(4)
    rows = frontier.fetch_all(targets, fetch, web.CrawlLimits(rate=1000.0, respect_robots=False))
    rows.write.parquet(f"file://{tmp_path}/out")
    names = [f.name.split() for f in asked.iterdir()]
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 24 == len(names)
    assert len({(h, task) for h, task, _ in names}) == 8 and len({task for _, task, _ in names}) > 1
