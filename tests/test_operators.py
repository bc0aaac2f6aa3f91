import random

from pyspark.sql import functions as F

from ragloom.functions import html as H
from ragloom.functions import text as T
from ragloom.functions import url as U
from ragloom.operators import chunk as C
from ragloom.operators import images, merge, status
from ragloom.sources import files, web
from ragloom.sources.store import Store


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_white_space(spark):
    assert one(spark, T.normalize_whitespace(F.col("t")), t="Hello   world\n\n\n\ntest") == "Hello world\n\ntest"
    assert one(spark, T.flatten_whitespace(F.col("t")), t="Hello\n\n\nWorld\t\tTest") == "Hello World Test"
    assert one(spark, T.plain_title(F.col("t")), t="Title Line\n\nSome content here.") == "Title Line"
    assert one(spark, T.plain_title(F.col("t")), t="x" * 100) is None


def test_types_and_binary(spark):
    for name, kind in (("test.html", "html"), ("test.md", "markdown"), ("test.txt", "plaintext"), ("test.rs", "unknown")):
        assert one(spark, T.type_by_ending(F.col("t")), t=name) == kind
    for name, skip in (("image.png", True), ("archive.zip", True), ("readme.md", False), ("index.html", False)):
        assert one(spark, T.should_skip(F.col("t")), t=name) is skip
    assert one(spark, T.is_binary(F.col("t")), t=bytearray(b"\0\1\2")) is True
    assert one(spark, T.is_binary(F.col("t")), t=bytearray(b"Hello world \x10\x02")) is False


def test_chunks():
    assert [c[3] for c in C.chunk_text("This is a short document.", [], C.ChunkConfig(500, 50, 50))] == ["This is a short document."]
    many = C.chunk_text("Lorem ipsum dolor sit amet. " * 100, [], C.ChunkConfig(500, 50, 50))
    assert len(many) > 1 and all(len(c[3]) <= 600 for c in many)
    assert C.breadcrumb([(1, "A", 0), (2, "B", 5), (3, "C", 9), (2, "D", 20)], 25) == ["A", "D"]
    assert all("�" not in c[3] for c in C.chunk_text("é" * 3000))


def test_urls(spark):
    n = lambda u, keep=False: one(spark, U.normalize(F.col("t"), keep), t=u)
    assert n("https://x.org/path/") == "https://x.org/path"
    assert n("https://x.org/path#fragment") == "https://x.org/path"
    assert n("https://x.org/") == "https://x.org/"
    assert n("https://x.org/p#/api", True) == "https://x.org/p#/api"
    for u, ok in (("/docs/intro", True), ("/login", False), ("/api/users", False), ("javascript:void(0)", False), ("x#/api", True), ("page#section", False)):
        assert one(spark, U.crawlable(F.col("t")), t=u) is ok and web.should_crawl(u) is ok


def test_pages(spark):
    shell = "<html><body><app-root></app-root>" + "<script src='a.js'></script>" * 3 + "<i ng-version='1'></i></body></html>"
    assert one(spark, H.analyze(F.col("t")), t=shell).needs_js is True
    assert one(spark, H.analyze(F.col("t")), t="<html><body><p>" + "Plain words. " * 40 + "</p></body></html>").technology == "static"


def test_robots_and_pace():
    r = web.Robots("User-agent: *\nDisallow: /admin/\nDisallow: /private/\nCrawl-delay: 2.5\n\nUser-agent: BadBot\nDisallow: /\n\nUser-agent: SpecialBot\nCrawl-delay: 1.0")
    assert r.is_allowed("/public/page", "GoodBot") and not r.is_allowed("/admin/secret", "GoodBot") and not r.is_allowed("/", "BadBot")
    assert r.crawl_delay("SpecialBot") == 1.0 and r.crawl_delay("RandomBot") == 2.5
    slept = []
    pace = web.HostPace(10, clock=lambda: 0.0, sleep=slept.append)
    for _ in range(3):
        pace.wait("h")
    assert sum(slept) >= 0.18


def test_crawl_stops_after_attempts():
    tried = []

    def fetch(u):
        tried.append(u)
        if u.endswith("/docs/"):
            return 200, "text/html", "".join(f"<a href='p{i}'>x</a>" for i in range(20)), u
        return 404, "", "", u

    limits = web.CrawlLimits(max_depth=2, max_pages=2, respect_robots=False)
    pages, errors = web.crawl("https://x.org/docs/", lambda u: fetch(u if u.count("/") > 3 and "p" in u[-4:] else "https://x.org/docs/"), limits, web.HostPace(1e9))
    assert len(pages) == 1 and len(errors) == 9


def test_sitemap():
    entries, more = web.parse_sitemap("<urlset><url><loc>https://x.org/a</loc><lastmod>2024</lastmod><priority>0.8</priority></url><url><loc>https://x.org/b</loc></url></urlset>")
    assert [e["loc"] for e in entries] == ["https://x.org/a", "https://x.org/b"] and entries[0]["priority"] == 0.8 and more == []


def test_images(spark):
    assert images.drop_alike([0b10101010, 0b10101010 ^ 0b11, 0b10101010 ^ 0xFF]) == [0, 2]
    assert one(spark, U.is_svg(F.col("t")), t="https://x/icon.svgz?x=1") is True


def test_distinct_images_equal_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for page in range(6):
        base = [rng.getrandbits(64) for _ in range(3)]
        for i in range(rng.randint(0, 9)):
            h = rng.choice(base)
            for _ in range(rng.randint(0, 7)):
                h ^= 1 << rng.randrange(64)
            rows.append((page, page * 100 + i, h - (1 << 64) if h >> 63 else h))
    rows += [(7, 701, None), (7, 702, None)]
    frame = spark.createDataFrame(rows, "page long, id long, hash long")
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want, pairs = [], set()
    for page in range(6):
        kept, mine = [], [(i, h) for p, i, h in rows if p == page]
        for i, h in mine:
            if all(far(h, k) > 5 for _, k in kept):
                kept.append((i, h))
        want += [i for i, _ in kept]
        pairs |= {(i, j, far(h, g)) for i, h in mine for j, g in mine if i < j and far(h, g) <= 5}
    assert sorted(r.id for r in images.distinct(frame).collect()) == sorted([*want, 701, 702])
    got = [(r.one, r.other, r.distance) for r in images.near_pairs(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 5


def test_distinct_images_of_long_pages_and_null_hashes(spark):
    """Pages over several batches, next to short ones; a null hash beside others leaves these in every bit."""
    rng = random.Random(5)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows, want = [], []
    for page, n in ((1, 700), (2, 3), (3, 40), (4, 1), (None, 90), (5, 8)):
        base, kept = [rng.getrandbits(64) for _ in range(1 + n // 3)], []
        for i in range(n):
            h = rng.choice(base)
            for _ in range(rng.randint(0, 7)):
                h ^= 1 << rng.randrange(64)
            if all((h ^ k).bit_count() > 5 for k in kept):
                kept.append(h)
                want.append((page, i))
            rows.append((page, i, signed(h)))
        if n > 1:
            rows.append((page, n, None))
            want.append((page, n))
    # hashes that differ in eight low bits only, which a double does not hold
    rows += [(9, 0, 1 << 62), (9, 1, (1 << 62) + 255), (9, 2, None)]
    want += [(9, 0), (9, 1), (9, 2)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "page long, id long, hash long").repartition(3)
    plain = lambda pairs: sorted(pairs, key=lambda p: (p[0] or 0, p[1]))
    assert plain((r.page, r.id) for r in images.distinct(frame).collect()) == plain(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert plain((r.page, r.id) for r in images.distinct(frame).collect()) == plain(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_chunks(text, most, least, overlap):
    """The chunker as a plain loop over bytes, written from its description."""
    data, begin, out = text.encode(), 0, []
    ends = sorted({i + 2: (3 if data[i : i + 2] == b"\n\n" else 2) for i in range(len(data)) if data[i : i + 2] in (b"\n\n", b". ", b".\n", b"? ", b"! ")}.items())
    floor = lambda i: i if i >= len(data) or i <= 0 or data[i] >> 6 != 2 else floor(i - 1)
    while begin < len(data):
        target, low, high = begin + most, begin + most * 4 // 5, min(begin + most * 6 // 5, len(data))
        end = len(data)
        if target < len(data):
            near = [(rank, at) for at, rank in ends if low <= at <= high]
            spaces = [i + 1 for i in range(max(0, target - 50), min(len(data), target + 50)) if data[i : i + 1] == b" "]
            end = max(near)[1] if near else spaces[-1] if spaces and low <= spaces[-1] <= high else floor(target)
        piece = data[begin:end].decode(errors="replace").strip()
        if len(piece.encode()) < least and end < len(data):
            begin = end
            continue
        out.append((begin, end, piece))
        if end == len(data):
            break
        back = floor(end - overlap) if end > overlap else end
        begin = back if back > begin else end
    return out


def test_chunks_equal_a_plain_loop(spark):
    """Over every document of a table, against a loop of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = sorted((r.doc_id, i, *c) for r in docs.collect() for i, c in enumerate(plain_chunks(r.text or "", 1500, 100, 200)))
    got = sorted((r.doc_id, r.chunk_index, r.char_start, r.char_end, r.chunk_text) for r in C.chunk_documents(docs).collect())
    assert got == want
    for n, most in ((1, 40), (2, 77)):
        for r in docs.limit(60).collect():
            assert [c[1:4] for c in C.chunk_text(r.text or "", [], C.ChunkConfig(most, 10 * n, 9 * n))] == plain_chunks(r.text or "", most, 10 * n, 9 * n)
    blocks = C.find_code_blocks("a\n```py\nb\n```\nc\n~~~\nd")
    assert blocks == [(2, 14)] and C.in_code_block(9, blocks) and not C.in_code_block(14, blocks)


def test_states_and_merge(spark):
    assert one(spark, status.state(F.col("s"), F.col("o")), s="running", o="update") == "updating"
    points = spark.createDataFrame([(1,), (2,)], "id long")
    assert merge.orphans(points, spark.createDataFrame([(1,)], "point_id long")).collect()[0].id == 2


def test_store_keeps_first_id(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    row = "'{i}' AS id, 's' AS source_id, 'u' AS uri, 't' AS title, '{h}' AS content_hash, 'html' AS content_type, timestamp'{d}' AS created_at, timestamp'{d}' AS updated_at"
    store.upsert(documents=spark.sql("SELECT " + row.format(i="a", h="h1", d="2024-01-01")))
    store.upsert(documents=spark.sql("SELECT " + row.format(i="b", h="h2", d="2024-02-01")))
    (got,) = store.table("documents").collect()
    assert (got.id, got.content_hash, got.created_at.month, got.updated_at.month) == ("a", "h2", 1, 2)
