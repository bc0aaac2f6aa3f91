import pytest

from pyspark.sql import functions as F

from ragloom import config, embedders, model_server, models
from ragloom.commands import Index, _like, overlaps
from ragloom.errors import ConfigError, DimensionMismatch, EmbeddingError, SourceNotFound, StoreError
from ragloom.plans import search as S
from ragloom.schemas import POINTS
from ragloom.sources import web
from ragloom.sources.store import Store
from ragloom.streaming.ingest import ingest_stream


def make(spark, tmp_path, **more):
    return Index(Store(spark, f"file://{tmp_path}/index"), **more)


def state(index):
    t = index.store.table
    return t("documents").count(), t("chunks").count(), t("points").count()


def test_directory_life(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("# Alpha\n\n" + "Alpha words are here. " * 150)
    (root / "b.txt").write_text("Beta file of a few words that is long enough to be a chunk of its own, so it is kept.")
    (root / "c.bin").write_bytes(b"\0\1")
    index = make(spark, tmp_path)
    first = index.ingest_dir(str(root), "docs")
    assert (first.docs_seen, first.docs_changed, first.docs_deleted) == (2, 2, 0) and first.chunks_created > 2
    before = state(index)
    assert before[1] == before[2] == first.chunks_created
    again = index.ingest_dir(str(root))
    assert (again.docs_changed, again.chunks_created, again.chunks_deleted) == (0, 0, 0) and state(index) == before
    created = {r.id: r.created_at for r in index.store.table("documents").collect()}
    (root / "a.md").write_text("# Alpha\n\nNow short, and yet over the hundred bytes that a chunk is asked to have, if only just so by a few words.")
    third = index.ingest_dir(str(root))
    assert (third.docs_changed, state(index)[:2]) == (1, (2, 2)) and third.chunks_deleted == before[1] - 1
    assert {r.id: r.created_at for r in index.store.table("documents").collect()} == created
    assert index.store.table("documents").where("title = 'Alpha'").count() == 1
    text = index.store.table("chunks").where("chunk_text like 'Beta%'").first().chunk_text
    hit = index.query(text, k=1).first()
    assert hit.doc_uri.endswith("b.txt") and hit.score == pytest.approx(1.0)
    index.rename("docs", "other")
    assert index.find_source("other").uri == str(root)
    assert index.reindex("other") == 2 and state(index) == (2, 2, 2)
    (root / "b.txt").unlink()
    assert index.prune(dry_run=True) == {"documents": 1, "points": 1} and state(index) == (2, 2, 2)
    assert index.prune() == {"documents": 1, "points": 1} and state(index) == (1, 1, 1)
    assert index.update() [1] == [] and index.status().first().sources == 1
    assert index.sources().first().state == "ready"
    assert index.store.vacuum() > 5 and state(index) == (1, 1, 1)
    index.remove("other")
    assert state(index) == (0, 0, 0)
    with pytest.raises(SourceNotFound):
        index.find_source("other")


def test_web_sources(spark, tmp_path):
    page = "<html><head><title>P{0}</title></head><body><h1>Page {0}</h1><p>" + "Some words of page {0}. " * 12 + "<a href='/d/2'>two</a></p></body></html>"
    site = {"http://x.org/d/1": page.format(1), "http://x.org/d/2": page.format(2), "http://x.org/map.xml": "<urlset><url><loc>http://x.org/d/2</loc></url></urlset>"}
    fetch = lambda u: (200 if u in site else 404, "text/html", site.get(u, ""), u)
    index = make(spark, tmp_path)
    index.config.crawl.rate_limit_per_host = 1000.0
    got = index.ingest_url("http://x.org/d/1", fetch)
    assert got.docs_changed == 2 and sorted(r.title for r in index.store.table("documents").collect()) == ["P1", "P2"]
    assert index.ingest_sitemap("http://x.org/map.xml", fetch).docs_changed == 1
    assert index.ingest_sitemap("http://x.org/none.xml", fetch).source_id == ""
    assert index.update()[1] and index.update(fetch)[1] == []
    assert {r.operation for r in index.store.table("runs").collect()} == {"ingest", "update"}
    site["http://x.org/robots.txt"] = "User-agent: *\nDisallow: /d/2"
    closed = index.ingest_sitemap("http://x.org/map.xml", fetch)
    assert closed.docs_seen == 0 and closed.errors == ["http://x.org/d/2: ruled out by robots.txt"]
    assert closed.docs_deleted == 0  # listed, if not read
    site.clear()
    assert index.ingest_url("http://x.org/d/1", fetch).docs_deleted == 0 and index.store.table("documents").count() == 3


def test_failed_run_leaves_the_index(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.txt").write_text("word " * 60)
    index = make(spark, tmp_path, embedder=embedders.HttpEmbedder("http://h", "BAAI/bge-small-en-v1.5", 3, post=lambda *a: {"vectors": []}))
    with pytest.raises(Exception, match="vectors came back"):
        index.ingest_dir(str(root))
    assert state(index) == (0, 0, 0)
    assert [r.status for r in index.store.table("runs").collect()] == ["failed"]


def test_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("First file of the stream. " * 8)
    index = make(spark, tmp_path)
    for n, name in ((1, None), (2, "b.txt"), (2, None)):
        if name:
            (root / name).write_text("Another file of the stream. " * 8)
        ingest_stream(index, str(root), f"file://{tmp_path}/mark").awaitTermination()
        assert state(index)[0] == n


def test_config(tmp_path):
    c = config.Config()
    assert "# k" not in config.render(c) and "# default_k = 10" in config.render(c)
    c.query.default_k, c.warehouse = 7, 'a"b'
    config.save(c, str(tmp_path / "c.toml"))
    assert config.load(str(tmp_path / "c.toml"), {}) == c
    assert config.load(str(tmp_path / "c.toml"), {"RAGLOOM_WAREHOUSE": "w"}).warehouse == "w"
    for part, key, bad in (("query", "min_score", 2.0), ("chunk", "min_chars", 9999), ("embedding", "model", "own/model"), ("embedding", "model", "vidore/colpali"), ("multimodal", "enabled", True), ("crawl", "rate_limit_per_host", 0.0)):
        with pytest.raises(ConfigError):
            config.from_dict({part: {key: bad}}).validate()
    with pytest.raises(ConfigError):
        config.from_dict({"query": {"nothing": 1}})
    assert config.Config().dim() == 384 and config.Config().dim(512) == 512
    with pytest.raises(ConfigError):
        config.from_dict({"embedding": {"dimension": 3}}).dim(4)


def test_models_and_http():
    assert models.batch_size(0, "Qwen/Qwen3-VL-Embedding-8B") == 4 and models.batch_size(8, "BAAI/bge-small-en-v1.5") == 8
    assert len(models.names(models.EMBEDDERS, True)) == 5
    sent, fails = [], [1]

    def post(address, body, seconds):
        if fails:
            fails.pop()
            raise EmbeddingError("once")
        sent.append(len(body["inputs"]))
        return {"data": [{"embedding": [1.0, 2.0]} for _ in body["inputs"]]}

    e = embedders.HttpEmbedder("http://h/", "jinaai/jina-clip-v2", 2, 3, post)
    assert len(e.embed(["a"] * 7)) == 7 and sent == [3, 3, 1]
    with pytest.raises(EmbeddingError):
        embedders.vectors_of({})
    assert embedders.http_rerank("http://h", "BAAI/bge-reranker-base", "q", ["a", "b"], lambda *a: {"results": [{"index": 1, "score": 0.5}, {"index": 9, "score": 1}]}) == {1: 0.5}


def test_overlaps():
    stored = [("i1", "dir", "/a", None), ("i2", "url", "https://x.org/docs", "docs"), ("i3", "sitemap", "https://x.org/docs/map.xml", None), ("i4", "url", "https://y.org/docs", None)]
    assert overlaps(stored, "dir", "/a/b") == ["/a/b lies inside /a (i1): its documents may be indexed twice"]
    assert overlaps(stored, "dir", "/ab") == [] and overlaps(stored, "dir", "/a/") == ["/a/ is indexed already as /a (i1)"]
    got = overlaps(stored, "sitemap", "https://x.org/docs/")
    assert got == ["https://x.org/docs/ lies inside docs (i2): its documents may be indexed twice", "https://x.org/docs/ holds https://x.org/docs/map.xml (i3): its documents may be indexed twice"]
    assert len(overlaps(stored, "url", "https://x.org/docs")) == 2


def counting(dim=3):
    posts = []

    def post(address, body, seconds):
        if "documents" in body:
            return {"results": [{"index": i, "score": float(len(d))} for i, d in enumerate(body["documents"])]}
        open(posts[0], "a").write("".join(f"{len(x)}\n" for x in body["inputs"]))
        return {"vectors": [[float(len(x)), 1.0, 2.0][:dim] for x in body["inputs"]]}

    return posts, post


def test_each_chunk_is_embedded_once_and_other_sources_stay(spark, tmp_path):
    posts, post = counting()
    posts.append(str(tmp_path / "posts"))
    index = make(spark, tmp_path, embedder=embedders.HttpEmbedder("http://h", "BAAI/bge-small-en-v1.5", 3, post=post))
    for d in ("one", "two"):
        (tmp_path / d).mkdir()
        for n in range(3):
            (tmp_path / d / f"{n}.txt").write_text(f"File {n} of {d}. " * (10 + n))
    got = [index.ingest_dir(str(tmp_path / d), d) for d in ("one", "two")]
    assert sum(s.chunks_created for s in got) == 6 == len(open(posts[0]).readlines())
    parts = index.store.manifest()["tables"]
    (tmp_path / "one" / "new.txt").write_text("A new file alone. " * 12)
    assert index.ingest_dir(str(tmp_path / "one")).docs_changed == 1 and len(open(posts[0]).readlines()) == 7
    now = index.store.manifest()["tables"]
    for name in ("documents", "chunks", "points"):
        assert now[name][got[1].source_id] == parts[name][got[1].source_id]  # untouched
        assert now[name][got[0].source_id]["at"][:1] == parts[name][got[0].source_id]["at"] and len(now[name][got[0].source_id]["at"]) == 2  # appended to
    (tmp_path / "one" / "0.txt").write_text("Changed. " * 20)
    assert index.ingest_dir(str(tmp_path / "one")).chunks_deleted == 1 and len(open(posts[0]).readlines()) == 8
    assert state(index) == (7, 7, 7) and len(index.store.manifest()["tables"]["points"][got[0].source_id]["at"]) == 1
    # look-ups
    docs = index.documents("one").collect()
    assert [d.uri.rsplit("/", 1)[1] for d in docs] == ["0.txt", "1.txt", "2.txt", "new.txt"]
    assert index.document("one", docs[0].uri).id == docs[0].id and index.document("two", docs[0].uri) is None
    chunk = index.chunks("one", docs[0].id).first()
    assert chunk.chunk_text.startswith("Changed") and index.chunk(chunk.point_id).doc_id == docs[0].id
    assert index.chunks("one", docs[0].id, "image").count() == 0 and index.chunks("one", docs[0].id, "text").count() == 1
    assert (index.point_ids().count(), index.point_ids("two").count()) == (7, 3)
    # the model server reranks: the longest text first, with the server's score
    index.config.embedding.backend = "http"
    best = index.query("file", k=4, rerank=True).collect()
    assert best[0].score == max(len(r.chunk_text) for r in index.store.table("chunks").collect())
    (tmp_path / "two").rename(tmp_path / "away")
    assert len(index.update()[1]) == 1 and state(index) == (7, 7, 7)  # a folder that is not there loses nothing


def test_a_crash_between_the_steps_keeps_the_state(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("word " * 60)
    index = make(spark, tmp_path)
    index.ingest_dir(str(tmp_path / "docs"))
    before, (number, _) = state(index), index.store._current()
    with open(f"{tmp_path}/index/manifest-{number + 1:012d}.json", "w") as f:
        f.write('{"dim": 64, "tables": {"docu')  # a writer that died
    assert state(make(spark, tmp_path)) == before
    (tmp_path / "docs" / "b.txt").write_text("other " * 60)
    index.store._write_manifest = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        index.ingest_dir(str(tmp_path / "docs"))
    again = make(spark, tmp_path)
    assert state(again) == before
    assert again.ingest_dir(str(tmp_path / "docs")).docs_changed == 1 and state(again) == (2, 2, 2)
    (tmp_path / "index/documents/of-a-writer-that-died").mkdir()
    assert again.store.vacuum() > 0 and state(again) == (2, 2, 2)
    for f in (tmp_path / "index").glob("*manifest-*"):
        f.unlink()
    with pytest.raises(StoreError):  # tables without a manifest are not an empty index
        make(spark, tmp_path)


def test_store_refuses_vectors_of_another_length(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    row = "SELECT '{i}' AS id, {v} AS vector, 's' AS source_id"
    rows = lambda sql: _like(store.with_norm(spark.sql(sql)), POINTS)
    store.upsert(points=rows(row.format(i="a", v="array(1f, 2f)")))
    with pytest.raises(DimensionMismatch):
        store.upsert(points=rows(row.format(i="b", v="array(1f, 2f, 3f)")))
    assert [r.id for r in store.table("points").collect()] == ["a"] and store.staged == []


def test_rerank_leaves_other_modalities_behind_the_texts(spark):
    points = spark.createDataFrame([("t1", [1.0, 0.0], "text", "aaa"), ("t2", [0.9, 0.1], None, "bbbb"), ("i1", [1.0, 0.01], "image", "alt")], "id string, vector array<float>, modality string, chunk_text string").withColumn("doc_uri", F.col("id"))
    scorer = lambda query, texts: {i: float(len(t)) for i, t in enumerate(texts)} | {99: 1.0}
    o = S.QueryOptions(k=5, rerank=True)
    assert [(r.id, r.score) for r in S.search(points, None, "q", [1.0, 0.0], o, None, scorer).collect()][:2] == [("t2", 4.0), ("t1", 3.0)]
    assert [r.id for r in S.search(points, None, "q", [1.0, 0.0], o, None, scorer, True).collect()] == ["t2", "i1", "t1"]
    assert [r.id for r in S.search(points, None, "q", [1.0, 0.0], o, None, lambda q, t: {}).collect()] == ["t1", "t2", "i1"]


def test_images_are_indexed(spark, tmp_path):
    figure = "<img src='/img/flow-diagram.png' alt='The flow of it'><img src='/img/again-diagram.png' alt='The flow again'><img src='/logo.png' alt='logo'><img src='/img/chart.svg' alt='A chart'><img src='/img/tiny-chart.png' alt='A flow chart'><img src='/img/lost-chart.png' alt='The flow lost'>"
    page = "<html><head><title>Flow</title></head><body><h1>Flow</h1><p>" + "Words of a page about it. " * 12 + "{0}</p></body></html>"
    site = {"http://x.org/d/1": page.format(figure)}
    fetch = lambda u: (200 if u in site else 404, "text/html", site.get(u, ""), u)

    def image(u):
        big = b"picture" * 1000
        return (404, "", b"") if "lost" in u else (200, "image/png", b"small" if "tiny" in u else big)

    settings = config.from_dict({"embedding": {"model": "jinaai/jina-clip-v2"}, "multimodal": {"enabled": True}, "crawl": {"rate_limit_per_host": 1000.0}})
    index = make(spark, tmp_path, config=settings, image_fetch=image)
    got = index.ingest_url("http://x.org/d/1", fetch)
    chunks = {r.chunk_index: r for r in index.store.table("chunks").collect()}
    assert sorted(chunks) == [-1, 0] and got.chunks_created == 2 and state(index) == (1, 2, 2)  # equal bytes once, small, SVG and lost ones not at all
    assert chunks[-1].modality == "image" and chunks[-1].chunk_text.startswith("The flow") and chunks[-1].media_url.startswith("http://x.org/img/") and chunks[-1].media_hash == chunks[-1].chunk_hash
    point = index.store.table("points").where("modality = 'image'").first()
    assert point.id == chunks[-1].point_id and point.norm == pytest.approx(1.0, abs=1e-6) and index.store.table("assets").first().context == f"{chunks[-1].chunk_text} | Flow | Flow"
    assert index.reindex() == 2 and state(index) == (1, 2, 2)
    source = index.sources().first().id
    doc = index.documents(source).first().id
    assert [r.chunk_index for r in index.chunks(source, doc).collect()] == [-1, 0] and index.chunks(source, doc, "image").count() == 1
    site["http://x.org/d/1"] = page.format("<p>No images any more.</p>")
    assert index.ingest_url("http://x.org/d/1", fetch).chunks_deleted >= 1 and state(index)[1:] == (1, 1) and index.store.table("assets").count() == 0


def test_http_images():
    sent = []

    def post(address, body, seconds):
        sent.append((address.rsplit("/", 1)[1], body["inputs"]))
        return {"embeddings": [[1.0, 0.0] if "image" in address else [0.0, 1.0] for _ in body["inputs"]]}

    dual = embedders.HttpEmbedder("http://h", "jinaai/jina-clip-v2", 2, post=post)
    got = dual.embed_images([b"a", b"b"], ["text", None])
    assert got[0] == pytest.approx([0.5**0.5, 0.5**0.5]) and got[1] == [1.0, 0.0] and [k for k, _ in sent] == ["image_text", "text"]
    sent.clear()
    joint = embedders.HttpEmbedder("http://h", "Qwen/Qwen3-VL-Embedding-2B", 2, post=post)
    assert joint.embed_images([b"a"], ["text"]) == [[1.0, 0.0]] and sent == [("image_text", [{"image_base64": "YQ==", "text": "text"}])]
    with pytest.raises(EmbeddingError):
        embedders.HttpEmbedder("http://h", "vidore/colpali", 2, post=post).embed_images([b"a"], [None])


def test_pages_that_need_scripts_are_rendered(spark, tmp_path):
    shell = "<html><body><app-root></app-root><i ng-version='1'></i><a href='#/intro'>x</a></body></html>"
    body = "<html><body><p>" + "Rendered words. " * 20 + "</p><a href='#/more'>m</a></body></html>"
    fetch = lambda u: (200 if u == "http://x.org/app" else 404, "text/html", shell, u)

    class Renders:
        def render(self, url):
            return url, body.replace("words", "words of " + url.rpartition("#")[2] if "#" in url else "words")

    index = make(spark, tmp_path, renderer=Renders())
    index.config.crawl.rate_limit_per_host = 1000.0
    assert index.ingest_url("http://x.org/app/", fetch).docs_changed == 3
    assert sorted(r.uri for r in index.store.table("documents").collect()) == ["http://x.org/app", "http://x.org/app#/intro", "http://x.org/app#/more"]
    with pytest.raises(web.FetchError):
        web.fetch_hash_route("http://x.org/", "/a", web.NoRenderer())


def test_model_server(spark, tmp_path):
    with model_server.running() as url:
        settings = lambda model, **more: config.from_dict({"embedding": {"backend": "http", "url": url, "model": model, **more}, "reranker": {"enabled": True}})
        e = embedders.make(settings("BAAI/bge-small-en-v1.5"))
        assert e.dim == 384 and embedders.make(settings("jinaai/jina-clip-v2")).dim == 64 and embedders.make(settings("Qwen/Qwen3-VL-Embedding-2B")).dim == 64
        assert e.embed(["a"] * 70) == [model_server.vector(b"a", 384)] * 70  # batches stay under the server's limit
        with pytest.raises(EmbeddingError):
            embedders.post_json(f"{url}/v1/embed/text", {"model": e.model, "inputs": ["a"] * 70}, 5)
        for wrong in (settings("vidore/colpali"), settings("own/model", allow_custom=True)):
            with pytest.raises(EmbeddingError):
                embedders.make(wrong)
        with pytest.raises(ConfigError):
            embedders.make(settings("BAAI/bge-small-en-v1.5", dimension=3))
        offered = lambda at: {"models": [{"id": "own/model", "modalities": ["text"]}]}
        own = embedders.resolve(settings("own/model", allow_custom=True), lambda *a: {"embedding_dim": 7}, offered)
        assert own == 7
        clip = embedders.make(settings("jinaai/jina-clip-v2"))
        assert clip.embed_images([b"x"], [None]) == [model_server.vector(b"x", 64)]
        joint = embedders.make(settings("Qwen/Qwen3-VL-Embedding-2B"))
        assert joint.embed_images([b"x"], ["t"]) == [model_server.vector(b"tx", 64)]
        assert [m["id"] for m in embedders.get_json(f"{url}/capabilities")["models"]] == models.names(models.EMBEDDERS)
        (tmp_path / "docs").mkdir()
        for name, text in (("a", "apples and pears " * 12), ("b", "stars and planets " * 12)):
            (tmp_path / "docs" / f"{name}.txt").write_text(text)
        index = make(spark, tmp_path, config=settings(e.model), embedder=e)
        assert index.ingest_dir(str(tmp_path / "docs")).chunks_created == 2
        best = index.query("stars planets", min_score=-1.0).first()
        assert best.doc_uri.endswith("b.txt") and best.score == 1.0
        assert index.status().first().asDict() == {"connected": True, "collection": True, "points": 2, "sources": 1, "documents": 2, "chunks": 2}
