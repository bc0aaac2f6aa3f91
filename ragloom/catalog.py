"""Named queries over the shared tables, and the SQL that checks them.

``documents`` stand for indexed files, ``pages`` for crawled pages,
``embeddings`` for a vector collection (label: source), ``events`` for the run
log (user: source).  Scores are rounded to six places on both sides.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import html as H
from .functions import text as T
from .functions import url as U
from .functions import vec as V
from .operators import chunk as C
from .operators import images, merge, parse, status
from .plans import search as S
from .plans import vectors as X
from .sources import frontier
from .sources.web import CrawlLimits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a scan has fewer splits, as for a file of one row group; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _points(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("label-"), "label").alias("source_id"), F.col("label").alias("doc_uri"))


def _first_vector(spark, sf_dir) -> list[float]:
    return _table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1))"


# -- vectors ---------------------------------------------------------------


@query(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return S.top_k(_points(spark, sf_dir), _first_vector(spark, sf_dir), 20).select("id", V.rounded(F.col("score")).alias("score"))


@query(f"SELECT vec_id AS id, label AS doc_uri, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 3) ORDER BY {_COS} DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark, sf_dir):
    points = S.filtered(_points(spark, sf_dir), S.QueryOptions(source_ids=("label-1", "label-3")))
    return S.top_k(points, _first_vector(spark, sf_dir), 20).select("id", "doc_uri", V.rounded(F.col("score")).alias("score"))


@query(f"SELECT * FROM (SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20) WHERE score >= 0.2")
def vector_topk_min_score(spark, sf_dir):
    return S.min_score(S.top_k(_points(spark, sf_dir), _first_vector(spark, sf_dir), 20).withColumn("score", V.rounded(F.col("score"))), 0.2).select("id", "score")


@query(f"SELECT id, doc_uri, score FROM (SELECT vec_id AS id, label AS doc_uri, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY {_COS} DESC, vec_id) AS n FROM embeddings) WHERE n = 1")
def vector_dedupe_by_group(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _first_vector(spark, sf_dir)])
    scored = _points(spark, sf_dir).withColumn("score", V.cosine(F.col("vector"), q))
    return S.best_per_document(scored).select("id", "doc_uri", V.rounded(F.col("score")).alias("score"))


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the application ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


_LAST = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id DESC LIMIT 1))"


@query(f"SELECT id, label, score FROM (SELECT vec_id AS id, label, round({_LAST}, 6) AS score FROM embeddings ORDER BY {_LAST} DESC, vec_id LIMIT 25)")
def vector_topk_indexed(spark, sf_dir):
    """Top-k over a written index: folders by pivot, codes first, vectors of the candidates only; equal to a scan."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    asked = e.orderBy(F.desc("id")).select("vector").first()[0]
    found = X.VectorIndex.build(e, _shared(spark), parts=16).top_k(asked, 25)
    return found.select("id", "label", V.rounded(F.col("score")).alias("score"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE label = 3),
    s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q)
    SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s) WHERE n <= 10""")
def vector_batch_topk(spark, sf_dir):
    """Every vector of a label as a query against all vectors, in blocks of matrix products."""
    e = _table(spark, sf_dir, "embeddings")
    asked = e.where("label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return X.batch_top_k(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10).select("query_id", "id", V.rounded(F.col("cosine")).alias("score"))


@query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings")
def normalize_vectors(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(V.normalize(F.col("embedding")), lambda x: V.rounded(x)).alias("unit"))


@query("""
    WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
    f AS (SELECT a.vec_id, list_transform(list_zip(a.v, b.v), lambda p: (p[1] + p[2]) / 2.0::DOUBLE) AS v FROM u a JOIN u b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS fused FROM f""")
def fuse_vectors(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.transform(V.fuse(F.col("embedding"), F.col("other")), lambda x: V.rounded(x)).alias("fused"))


_HEX_WORD = "('0x' || d[i * 8 + 7:i * 8 + 8] || d[i * 8 + 5:i * 8 + 6] || d[i * 8 + 3:i * 8 + 4] || d[i * 8 + 1:i * 8 + 2])::BIGINT"


@query(f"""
    WITH h AS (SELECT item_id, string_agg(sha256(encode(text) || unhex(printf('%02x000000', c))), '' ORDER BY c) AS d FROM benchmark, range(8) r(c) GROUP BY item_id)
    SELECT item_id, list_transform(range(64), lambda i: round({_HEX_WORD} / 4294967296.0::DOUBLE * 2 - 1, 6)) AS vector FROM h""")
def hash_embedder(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.transform(V.hash_embed(F.col("text")), lambda x: V.rounded(x)).alias("vector"))


# -- ranking ---------------------------------------------------------------

TERMS = ["the", "tion", "license"]
_BM25 = " + ".join(
    f"(CASE WHEN contains(lower(text), '{t}') THEN ((length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}.0::DOUBLE) * 2.2::DOUBLE"
    f" / ((length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}.0::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * strlen(text) / (SELECT avg(strlen(text)) FROM documents))) ELSE 0 END)"
    for t in TERMS
)


def _bm25(docs: DataFrame):
    mean = docs.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    return T.bm25(TERMS, F.col("text"), F.lit(mean))


@query(f"SELECT doc_id, round({_BM25}, 6) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 200")
def bm25_rank(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    score = _bm25(d)  # the mean length comes from the scan
    return _spread(d).select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(200)


@query(f"SELECT doc_id, round(0.7::DOUBLE * (n_chars % 100) / 100.0::DOUBLE + 0.3::DOUBLE * ({_BM25}), 6) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 100")
def hybrid_rank(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    mean = d.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    hits = d.select("doc_id", F.col("text").alias("chunk_text"), ((F.col("n_chars") % 100) / 100.0).alias("vector_score"))
    return S.hybrid(hits, TERMS, mean, 0.3).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(100)


@query(f"""
    WITH hits AS (SELECT doc_id, text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)
    SELECT doc_id AS id, round({_BM25}, 6) AS score FROM hits ORDER BY score DESC, id LIMIT 10""")
def rerank_bm25(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    mean = d.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    hits = d.orderBy(F.desc("n_chars"), "doc_id").limit(50).select(F.col("doc_id").alias("id"), "text", F.col("n_chars").cast("double").alias("score"))
    scores = hits.select("id", F.round(T.bm25(TERMS, F.col("text"), F.lit(mean)), 6).alias("rerank_score"))
    return S.rerank(hits, scores, 10).select("id", "score")


@query()
def rag_search(spark, sf_dir):
    """The flagship: documents are normalised, chunked and embedded, and the best chunk of each document answers a query text."""
    d = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    chunks = C.chunk_documents(d.withColumn("text", T.normalize_whitespace(F.col("text"))))
    query_text = _table(spark, sf_dir, "benchmark").orderBy("item_id").select(V.hash_embed(F.col("text")).alias("v"), "text").first()
    points = chunks.select(F.concat_ws(":", "doc_id", "chunk_index").alias("id"), F.concat(F.lit("doc://"), "doc_id").alias("doc_uri"), "chunk_text", V.hash_embed(F.col("chunk_text")).alias("vector"))
    hits = S.search(points, None, query_text.text, query_text.v, S.QueryOptions(dedupe=True))
    return hits.select("id", "doc_uri", F.round("score", 6).alias("score"), F.left("chunk_text", F.lit(200)).alias("preview"))


def _hits(spark, sf_dir) -> DataFrame:
    """Vectors with the text of the document of the same number, its source for its document, and a modality."""
    e, d = _table(spark, sf_dir, "embeddings"), _table(spark, sf_dir, "documents")
    rows = e.join(d, e.vec_id == d.doc_id, "left")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.coalesce("source", F.lit("none")).alias("doc_uri"), F.col("text").alias("chunk_text"), F.when(F.col("lang") == "en", "text").when(F.col("lang") == "de", "image").alias("modality"))


_HITS = f"""
    p AS (SELECT vec_id AS id, {_COS} AS cos, coalesce(source, 'none') AS doc_uri, text, CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'image' END AS modality FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
    m AS (SELECT avg(strlen(text)) AS mean FROM p), top AS (SELECT *, coalesce({_BM25.replace('(SELECT avg(strlen(text)) FROM documents)', '(SELECT mean FROM m)')}, 0) AS bm25 FROM p ORDER BY cos DESC, id LIMIT 60)"""
_ASKED = " ".join(TERMS)


@query(f"""WITH {_HITS}, r AS (SELECT id, doc_uri, bm25 AS score FROM top WHERE cos >= 0.1 ORDER BY score DESC, id LIMIT 25)
    SELECT id, doc_uri, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_uri ORDER BY score DESC, id) AS n FROM r) WHERE n = 1 ORDER BY score DESC, id LIMIT 30""")
def search_rerank_dedupe(spark, sf_dir):
    """The whole query path: top 2k by cosine, score floor, rerank, best hit of each document, top k."""
    o = S.QueryOptions(k=30, min_score=0.1, rerank=True, rerank_top_k=25, dedupe=True)
    return S.search(_hits(spark, sf_dir), None, _ASKED, _first_vector(spark, sf_dir), o, reranks_media=True).select("id", "doc_uri", V.rounded(F.col("score")).alias("score"))


@query(f"""WITH {_HITS}, r AS (SELECT id, bm25 AS score, 0 AS behind FROM top WHERE coalesce(modality, 'text') = 'text' ORDER BY score DESC, id LIMIT 15), o AS (SELECT id, cos AS score, 1 AS behind FROM top WHERE coalesce(modality, 'text') <> 'text')
    SELECT id, round(score, 6) AS score, (row_number() OVER (ORDER BY behind, score DESC, id))::INTEGER AS place FROM (FROM r UNION ALL FROM o) ORDER BY place LIMIT 30""")
def search_modalities(spark, sf_dir):
    """A reranker of texts leaves hits of other modalities behind them, in their own order."""
    hits = S.search(_hits(spark, sf_dir), None, _ASKED, _first_vector(spark, sf_dir), S.QueryOptions(k=30, rerank=True, rerank_top_k=15))
    place = F.row_number().over(Window.orderBy(F.coalesce("modality", F.lit("text")) != "text", F.desc("score"), "id"))  # k rows
    return hits.select("id", V.rounded(F.col("score")).alias("score"), place.alias("place"))


@query(f"""WITH {_HITS} SELECT id, doc_uri, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_uri ORDER BY score DESC, id) AS n FROM (SELECT id, doc_uri, 0.7::DOUBLE * cos + 0.3::DOUBLE * bm25 AS score FROM top)) WHERE n = 1 AND score >= 0.2 ORDER BY score DESC, id LIMIT 30""")
def search_hybrid(spark, sf_dir):
    o = S.QueryOptions(k=30, min_score=0.2, hybrid=True, dedupe=True)
    return S.search(_hits(spark, sf_dir), None, _ASKED, _first_vector(spark, sf_dir), o).select("id", "doc_uri", V.rounded(F.col("score")).alias("score"))


# -- text ------------------------------------------------------------------

_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\s*\n\s*\n\s*', E'\n\n', 'g'), '[^\S\n]*\n[^\S\n]*', E'\n', 'g'), '[^\S\n]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(r"SELECT item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda t: strlen(t) >= 3) AS terms FROM benchmark")
def query_tokenize(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", T.query_terms(F.col("text")).alias("terms"))


@query(f"SELECT doc_id, sha256({_NORM}) AS h, strlen({_NORM})::INTEGER AS n_bytes FROM documents")
def normalize_whitespace(spark, sf_dir):
    t = T.normalize_whitespace(F.coalesce("text", F.lit("")))
    return _spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.sha2(t, 256).alias("h"), F.octet_length(t).alias("n_bytes"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS h FROM documents")
def clean_for_embedding(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.flatten_whitespace(F.coalesce("text", F.lit(""))), 256).alias("h"))


@query(rf"SELECT doc_id, CASE WHEN l <> '' AND strlen(l) < 100 THEN l END AS title FROM (SELECT doc_id, trim(string_split({_NORM}, E'\n')[1]) AS l FROM documents)")
def plain_text_title(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.plain_title(F.coalesce("text", F.lit(""))).alias("title"))


@query()
def chunk_documents(spark, sf_dir):
    return C.chunk_documents(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "chunk_index", "char_start", "char_end", "chunk_hash", "point_id")


@query()
def chunk_stats_by_source(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    n = C.chunk_documents(d).groupBy("doc_id").agg(F.count("*").alias("n"))
    return d.join(n, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


CHUNK_SMALL = C.ChunkConfig(max_chars=120, min_chars=30, overlap_chars=40)
_PLAIN_TEXT = "regexp_replace(text, '[^ -~\\n]', '?', 'g')"


@query(f"""
    WITH RECURSIVE t AS (
        SELECT item_id, x, strlen(x) AS size, list_filter(range(2, strlen(x) + 1), lambda p: substr(x, p - 1, 2) IN (E'\\n\\n', '. ', E'.\\n', '? ', '! ')) AS cuts FROM (SELECT item_id, {_PLAIN_TEXT} AS x FROM benchmark)),
    w AS (
        SELECT item_id, 0::BIGINT AS begins, 0::BIGINT AS ends, -1::BIGINT AS idx, false AS kept, true AS more FROM t
        UNION ALL
        SELECT item_id, begins, ends, idx + kept::INTEGER AS idx, kept, ends < size AND (ends > begins) AS more
        FROM (SELECT *, strlen(trim(substr(x, begins + 1, ends - begins), E' \\n')) >= 30 OR ends = size AS kept
              FROM (SELECT item_id, x, size, begins, idx, CASE WHEN begins + 120 >= size THEN size WHEN best IS NOT NULL THEN best
                           WHEN space IS NOT NULL AND space BETWEEN begins + 96 AND least(begins + 144, size) THEN space ELSE begins + 120 END AS ends
                    FROM (SELECT *, list_max(list_filter(range(greatest(0, begins + 70), least(size, begins + 170)), lambda p: substr(x, p + 1, 1) = ' ')) + 1 AS space,
                                 list_last(list_sort(list_transform(list_filter(cuts, lambda p: p BETWEEN begins + 96 AND least(begins + 144, size)), lambda p: {{'k': (substr(x, p - 1, 2) = E'\\n\\n')::INTEGER, 'p': p}}))).p AS best
                          FROM (SELECT t.item_id, x, size, cuts, idx, CASE WHEN w.idx < 0 AND NOT w.kept AND w.ends = 0 THEN 0 WHEN NOT w.kept THEN w.ends WHEN w.ends > 40 AND w.ends - 40 > w.begins THEN w.ends - 40 ELSE w.ends END AS begins
                                FROM w JOIN t USING (item_id) WHERE w.more))))
        WHERE begins < size)
    SELECT item_id, idx::INTEGER AS chunk_index, begins::INTEGER AS char_start, ends::INTEGER AS char_end, sha256(sha256(x) || trim(substr(x, begins + 1, ends - begins), E' \\n')) AS chunk_hash FROM w JOIN t USING (item_id) WHERE kept""")
def chunk_benchmark(spark, sf_dir):
    """The chunker over a whole table of short texts, with small chunks, so that recursive SQL can follow it."""
    b = _table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^ -~\n]", "?").alias("text"))
    return C.chunk_documents(b, "item_id", config=CHUNK_SMALL).select(F.col("doc_id").alias("item_id"), "chunk_index", "char_start", "char_end", "chunk_hash")


_UUID = "substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(s, 17, 1))::INTEGER % 4), 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12)"


@query(f"SELECT doc_id, h AS content_hash, {_UUID} AS point_id FROM (SELECT doc_id, sha256(text) AS h, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || sha256(text)::BLOB) AS s FROM documents)")
def content_hash_ids(spark, sf_dir):
    h = T.content_hash(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", h.alias("content_hash"), T.point_id(h).alias("point_id"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").groupBy(T.content_hash(F.col("text")).alias("content_hash"))
    return d.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# -- pages -----------------------------------------------------------------

_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace({h}, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')"
_BODY = "(CASE WHEN regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) = '' THEN html ELSE regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) END)"
_BODY_TEXT = _VISIBLE.replace("{h}", _BODY)
for _n, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _BODY_TEXT = f"replace({_BODY_TEXT}, '{_n}', '{_c}')"
_BODY_NORM = _NORM.replace("coalesce(text, '')", _BODY_TEXT)
_RATIO = r"(strlen(trim(regexp_replace(" + _VISIBLE.replace("{h}", "html") + r", '\s+', ' ', 'g'))) / strlen(html))"


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def html_title(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


_LEVELS = " UNION ALL ".join(f"SELECT page_id, {n} AS level, unnest(regexp_extract_all(html, '(?is)<h{n}(?:\\s[^>]*)?>(.*?)</h{n}>', 1)) AS raw FROM pages" for n in range(1, 7))


@query(f"""
    WITH t AS (SELECT page_id, {_BODY_NORM} AS body FROM pages), h AS (SELECT page_id, level, trim(regexp_replace(raw, '<[^>]+>', '', 'g')) AS text FROM ({_LEVELS}))
    SELECT page_id, level, text, greatest(0, strpos(body, text) - 1)::INTEGER AS position FROM h JOIN t USING (page_id) WHERE text <> ''""")
def html_headings(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(H.headings(F.col("html"))).alias("h")).select("page_id", "h.level", "h.text", "h.position")


_TAGS = r"""regexp_extract_all(html, '(?is)(<a\s[^>]*href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>)', 1)"""
_PAGE_HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_SCHEME_HOST = "regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_PATH = "regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_LINKS = rf"""
    WITH a AS (SELECT page_id, url AS base, unnest({_TAGS}) AS tag FROM pages),
    b AS (SELECT page_id, base, regexp_extract(tag, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href, nullif(trim(regexp_replace(tag, '<[^>]+>', '', 'g')), '') AS text FROM a),
    l AS (SELECT page_id, base, text, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
        WHEN starts_with(href, '//') THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href
        WHEN starts_with(href, '/') THEN {_SCHEME_HOST} || href WHEN starts_with(href, '#') THEN string_split(base, '#')[1] || href
        ELSE {_SCHEME_HOST} || regexp_replace(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END, '[^/]*$', '') || href END AS link FROM b)"""


def _links(spark, sf_dir) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("url").alias("base"), F.explode(H.links(F.col("html"), F.col("url"))).alias("l")).select("page_id", "base", F.col("l.url").alias("link"), "l.text", "l.internal")


@query(f"{_LINKS} SELECT page_id, link, text, {_PAGE_HOST.format(u='link')} = {_PAGE_HOST.format(u='base')} AS internal FROM l")
def html_links(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "link", "text", "internal")


@query(f"""
    WITH n AS (SELECT page_id, count(*) AS n FROM ({_LEVELS}) WHERE trim(regexp_replace(raw, '<[^>]+>', '', 'g')) <> '' GROUP BY 1)
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS title, coalesce(n, 0)::INTEGER AS n_headings,
           len({_TAGS})::INTEGER AS n_links, len(regexp_extract_all(html, '(?i)<img\\s'))::INTEGER AS n_images
    FROM pages LEFT JOIN n USING (page_id)""")
def parse_pages(spark, sf_dir):
    """The tree parser over whole pages, held against counts of the tags."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html", F.lit("html").alias("kind"))
    p = parse.parse_documents(pages, "html", "kind", "url")
    count = lambda c: F.size(f"parsed.{c}").alias({"media": "n_images"}.get(c, f"n_{c}"))
    return p.select("page_id", "parsed.title", count("headings"), count("links"), count("media"))


@query(f"SELECT page_id, sha256({_BODY_NORM}) AS h FROM pages")
def html_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(H.body_text(F.col("html")), 256).alias("h"))


_ENDING = r"regexp_extract(string_split(url, '/')[-1], '[^.].*\.([^.]*)$', 1)"


@query(f"SELECT page_id, CASE WHEN {_ENDING} IN ('html', 'htm') THEN 'html' WHEN {_ENDING} IN ('md', 'markdown', 'mdx') THEN 'markdown' WHEN {_ENDING} IN ('txt', 'text', 'rst') THEN 'plaintext' ELSE 'unknown' END AS by_ending, 'html' AS detected, lower({_ENDING}) IN ({', '.join(repr(x) for x in T.SKIPPED)}) AS skipped FROM pages")
def content_type_detect(spark, sf_dir):
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", T.type_by_ending(u).alias("by_ending"), T.content_type(u, F.lit("text/html; charset=utf-8")).alias("detected"), T.should_skip(u).alias("skipped"))


_NORM_URL = f"CASE WHEN {_SCHEME_HOST} = '' THEN base ELSE {_SCHEME_HOST} || coalesce(nullif(regexp_replace({_PATH}, '/+$', ''), ''), '/') || regexp_extract(base, '^[^?#]*(\\?[^#]*)', 1) END"


@query(f"{_LINKS}, u AS (SELECT DISTINCT link AS base FROM l) SELECT base AS link, {_NORM_URL} AS normal FROM u")
def url_normalize(spark, sf_dir):
    return _links(spark, sf_dir).select("link").distinct().select("link", U.normalize(F.col("link")).alias("normal"))


_DENY = " OR ".join(f"contains(lower(link), '{d}')" for d in U.DENIED)


@query(rf"{_LINKS}, u AS (SELECT DISTINCT link FROM l) SELECT link, NOT ({_DENY} OR regexp_matches(lower(link), '^[^#]*#[^/]') OR regexp_matches(lower(link), '/\d{{4}}/\d{{2}}/\d{{2}}/')) AS crawlable FROM u")
def url_crawlable(spark, sf_dir):
    return _links(spark, sf_dir).select("link").distinct().select("link", U.crawlable(F.col("link")).alias("crawlable"))


@query(f"SELECT page_id, round({_RATIO}, 6) AS ratio FROM pages")
def page_content_ratio(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.round(H.content_ratio(F.col("html")), 6).alias("ratio"))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_has = lambda parts, c="lower(html)": "(" + " OR ".join(f"contains({c}, {_lit(p)})" for p in parts) + ")" if parts else "false"
_FRAME = "CASE " + " ".join(f"WHEN {_has(low)} OR {_has(raw, 'html')} THEN '{n}'" for n, low, raw in H.FRAMEWORKS) + " END"
_ROUTE_SQL = "list_sort(list_distinct(list_filter(" + " || ".join(f"regexp_extract_all(html, {_lit(r)}, 1)" for r in H.ROUTES) + ", lambda r: r <> '/' AND r <> '')))"
_count = lambda parts: " + ".join(f"({p})::INTEGER" for p in parts)
_AUTH = _count([f"regexp_matches(lower(html), {_lit('(?i)' + p)})" for p in H.AUTH_PATTERNS] + [f"contains(lower(html), {_lit(t)})" for t in H.AUTH_TEXTS])
_BOT = _count([f"contains(lower(html), {_lit(b)})" for b in H.BOTS])
_SHELL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, {_lit('(?i)' + p)}) THEN {_lit(n)} END" for n, p in H.SHELLS) + "], lambda x: x IS NOT NULL)"
_SCRIPTS = r"""len(regexp_extract_all(html, '<script[^>]*(?:src\s*=\s*["''][^"'']+["''])?[^>]*>')) > 5 OR list_sum(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.+?)</script>', 1), lambda x: strlen(x))) / 1024.0 > 50"""


@query(f"""
    WITH f AS (SELECT page_id, {_RATIO} AS ratio, {_SHELL} AS shells, {_FRAME} AS framework, coalesce(({_SCRIPTS}), false) AS heavy, {_has(H.HYDRATION)} AS hydrated,
        {_ROUTE_SQL} AS routes, ({_AUTH}) >= 2 AS auth, ({_BOT}) >= 2 AS bot FROM pages),
    s AS (SELECT *, (CASE WHEN ratio < 0.05 THEN 40 WHEN ratio < 0.15 THEN 20 ELSE 0 END) + 30 * (len(shells) > 0)::INTEGER + 20 * (framework IS NOT NULL)::INTEGER + 15 * heavy::INTEGER + 10 * hydrated::INTEGER + 30 * (len(routes) > 0)::INTEGER AS points FROM f)
    SELECT page_id, CASE WHEN auth THEN 'auth_wall' WHEN bot THEN 'bot_protection' WHEN points >= 50 THEN 'spa' ELSE 'static' END AS technology,
        CASE WHEN NOT auth AND NOT bot AND points >= 50 THEN coalesce(framework, 'unknown') END AS framework,
        (CASE WHEN auth THEN 0.8 WHEN bot THEN 0.9 WHEN points >= 50 THEN least(points / 100.0, 1.0) ELSE 1.0 END)::DOUBLE AS confidence,
        CASE WHEN auth THEN false WHEN bot THEN true ELSE points >= 50 END AS needs_js, round(ratio, 6) AS content_ratio,
        array_to_string(CASE WHEN auth THEN ['login form'] WHEN bot THEN ['bot check'] WHEN points >= 50 THEN list_filter([CASE WHEN ratio < 0.05 THEN 'hardly any text' WHEN ratio < 0.15 THEN 'little text' END] || list_transform(shells, lambda x: 'shell: ' || x)
            || ['framework ' || framework, CASE WHEN heavy THEN 'heavy scripts' END, CASE WHEN hydrated THEN 'hydration' END, CASE WHEN len(routes) > 0 THEN len(routes) || ' hash routes' END], lambda x: x IS NOT NULL) ELSE [] END, ', ') AS indicators FROM s""")
def page_technology(spark, sf_dir):
    a = _spread(_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", H.analyze(F.col("html")).alias("a"))
    return a.select("page_id", "a.technology", "a.framework", "a.confidence", "a.needs_js", F.round("a.content_ratio", 6).alias("content_ratio"), F.array_join("a.indicators", ", ").alias("indicators"))


@query(f"""
    WITH RECURSIVE e AS ({_LINKS} SELECT DISTINCT base AS src, link AS dst FROM l WHERE {_PAGE_HOST.format(u='link')} = {_PAGE_HOST.format(u='base')}),
    w(url, depth) AS (SELECT min(url), 0 FROM pages UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.url WHERE w.depth < 3)
    SELECT url, min(depth)::INTEGER AS depth FROM w GROUP BY url""")
def crawl_bfs_static(spark, sf_dir):
    """Breadth-first over the stored link graph, three levels from the first page; one join a level."""
    pages = _table(spark, sf_dir, "pages").select("url")
    parsed = _links(spark, sf_dir).where("internal").select("base", "link").distinct()
    parsed.write.parquet(at := _shared(spark))  # once for all levels
    edges = spark.read.schema(parsed.schema).parquet(at)
    front = pages.agg(F.min("url").alias("url")).withColumn("depth", F.lit(0))
    seen = front
    for depth in range(1, 4):
        front = front.join(edges, front.url == edges.base).select(F.col("link").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen


@query(f"""
    WITH RECURSIVE e AS ({_LINKS} SELECT DISTINCT base AS src, {_NORM_URL.replace('base', 'link')} AS dst FROM l
                         WHERE {_PAGE_HOST.format(u='link')} = {_PAGE_HOST.format(u='base')} AND NOT ({_DENY} OR regexp_matches(lower(link), '^[^#]*#[^/]') OR regexp_matches(lower(link), '/\\d{{4}}/\\d{{2}}/\\d{{2}}/'))),
    w(source_id, url, depth) AS (SELECT {_PAGE_HOST.format(u='url')}, min(url), 0 FROM pages GROUP BY 1 UNION SELECT source_id, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.url WHERE w.depth < 3)
    SELECT source_id, w.url, min(depth)::INTEGER AS depth, max((p.url IS NOT NULL)::INT) = 1 AS found FROM w LEFT JOIN pages p ON p.url = w.url GROUP BY ALL""")
def crawl_sites(spark, sf_dir):
    """A crawl of every host at once from its first page, three levels deep, answered from the stored pages instead of the web."""
    pages = _table(spark, sf_dir, "pages").select("url", F.col("html").alias("body"), F.lit("text/html").alias("content_type"))
    host = U.host(F.col("url"))
    seeds = pages.groupBy(host.alias("source_id")).agg(F.min("url").alias("url"))
    seeds = seeds.select("source_id", "url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("parent"), F.lit(0).alias("place"), F.array("source_id").alias("hosts"), F.lit("/").alias("prefix"))
    limits = CrawlLimits(max_depth=3, max_pages=1 << 40)
    crawl = frontier.Crawl(spark, _shared(spark), limits, visit=frontier.from_table(pages)).run(seeds)
    return crawl.visited().select("source_id", "url", "depth", F.col("error").isNull().alias("found"))


# -- maintenance -----------------------------------------------------------

_V1 = "SELECT doc_id, source, doc_id::VARCHAR AS uri, sha256(text) AS h FROM documents"
_MOVED = "source = 'src3'"
_NEW_TEXT = "CASE WHEN lang = 'de' THEN text || '!' ELSE text END"
_V2 = f"SELECT doc_id, source, CASE WHEN {_MOVED} THEN doc_id || '-moved' ELSE doc_id::VARCHAR END AS uri, sha256({_NEW_TEXT}) AS h FROM documents"


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two states of the index over whole tables: in the second, German texts have changed and one source's documents have moved."""
    d = _table(spark, sf_dir, "documents")
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    moved = F.when(F.expr(_MOVED), F.concat(F.col("doc_id").cast("string"), F.lit("-moved"))).otherwise(F.col("doc_id").cast("string"))
    state = lambda uri, t: d.select("doc_id", F.col("source").alias("source_id"), uri.alias("uri"), T.content_hash(t).alias("content_hash"))
    return state(F.col("doc_id").cast("string"), F.col("text")), state(moved, text)


@query(f"""
    WITH a AS ({_V1}), b AS ({_V2})
    SELECT coalesce(b.source, a.source) AS source_id, uri, CASE WHEN a.doc_id IS NULL THEN 'new-' ELSE 'old-' END || coalesce(a.doc_id, b.doc_id) AS id, coalesce(b.h, a.h) AS content_hash
    FROM a FULL JOIN b USING (uri)""")
def upsert_documents(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    at = lambda df, name, day: df.select("source_id", "uri", F.concat(F.lit(name), "doc_id").alias("id"), "content_hash", F.lit(day).cast("timestamp").alias("created_at"), F.lit(day).cast("timestamp").alias("updated_at"))
    return merge.upsert(at(old, "old-", "2024-01-01"), at(new, "new-", "2024-02-01"), ["source_id", "uri"]).select("source_id", "uri", "id", "content_hash")


@query(f"SELECT doc_id, source AS source_id FROM documents WHERE {_MOVED}")
def stale_documents(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return merge.stale(old, new).select("doc_id", "source_id")


@query(f"WITH a AS ({_V1}), b AS ({_V2}) SELECT b.doc_id, b.h AS content_hash FROM b LEFT JOIN a ON a.uri = b.uri AND a.h = b.h WHERE a.doc_id IS NULL")
def changed_documents(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return merge.changed(new, old, ["source_id", "uri"]).select("doc_id", "content_hash")


_LINES = "SELECT doc_id, unnest(string_split({t}, E'\\n')) AS line FROM documents"


@query(f"""
    WITH a AS (SELECT DISTINCT doc_id, sha256(line) AS chunk_hash FROM ({_LINES.format(t='text')})),
    b AS (SELECT doc_id, sha256(line) AS chunk_hash FROM ({_LINES.format(t=_NEW_TEXT)}))
    SELECT b.doc_id, b.chunk_hash FROM b ANTI JOIN a ON a.doc_id = b.doc_id AND a.chunk_hash = b.chunk_hash""")
def new_chunks(spark, sf_dir):
    """Lines stand for chunks here, so that SQL can follow."""
    d = _table(spark, sf_dir, "documents")
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    lines = lambda t: d.select("doc_id", F.explode(F.split(t, "\n")).alias("line")).select("doc_id", F.sha2("line", 256).alias("chunk_hash"))
    return merge.new_chunks(lines(text), lines(F.col("text"))).select("doc_id", "chunk_hash")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_points(spark, sf_dir):
    """Labels stand for the chunks that name points."""
    return merge.orphans(_points(spark, sf_dir), _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("point_id")))


@query("SELECT 'documents' AS part, count(*) AS n FROM documents WHERE source <> 'src1' UNION ALL SELECT 'chunks', sum(len(string_split(text, E'\\n')))::BIGINT FROM documents WHERE source <> 'src1' UNION ALL SELECT 'sources', count(DISTINCT source) - 1 FROM documents")
def remove_source(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    docs = d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"))
    chunks = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.split("text", "\n")).alias("line")).withColumn("point_id", F.col("doc_id"))
    tables = {"documents": docs, "chunks": chunks, "points": docs.select("id"), "runs": docs.select("source_id"), "sources": d.select(F.col("source").alias("id")).distinct()}
    out = merge.cascade(tables, "src1")
    parts = [out[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n in ("documents", "chunks", "sources")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT doc_id FROM documents WHERE {_MOVED}")
def prune_missing(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return old.join(new.select("uri"), "uri", "left_anti").select("doc_id")


@query("SELECT count(DISTINCT source) AS sources, count(*) AS documents, sum(len(string_split(text, E'\\n')))::BIGINT AS chunks FROM documents")
def global_stats(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return status.global_stats(d.select("source").distinct(), d, d.select(F.explode(F.split("text", "\n"))))


@query("SELECT source AS source_id, count(*) AS documents, sum(len(string_split(text, E'\\n')))::BIGINT AS chunks FROM documents GROUP BY 1")
def source_stats(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    chunks = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return status.source_stats(d.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id")), chunks)


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'completed' END"
_OPERATION = "CASE WHEN event_id % 2 = 0 THEN 'update' ELSE 'ingest' END"


def _runs(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("ts").alias("started_at"), F.expr(_STATUS).alias("status"), F.expr(_OPERATION).alias("operation"))


@query(f"SELECT user_id AS source_id, event_id AS id, {_STATUS} AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_run(spark, sf_dir):
    return status.latest_run(_runs(spark, sf_dir)).select("source_id", "id", "status")


@query(f"""
    WITH r AS (SELECT user_id AS source_id, {_STATUS} AS status, {_OPERATION} AS operation, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT source_id, CASE WHEN status = 'running' AND operation = 'update' THEN 'updating' WHEN status = 'running' THEN 'indexing' WHEN status = 'failed' THEN 'error' ELSE 'ready' END AS state FROM r WHERE n = 1""")
def source_state(spark, sf_dir):
    return status.latest_run(_runs(spark, sf_dir)).select("source_id", status.state(F.col("status"), F.col("operation")).alias("state"))


@query(f"WITH s AS (SELECT DISTINCT regexp_replace(url, '[^/]*$', '') AS url FROM pages) SELECT a.url AS one, b.url AS other FROM s a JOIN s b ON {_PAGE_HOST.format(u='a.url')} = {_PAGE_HOST.format(u='b.url')} AND a.url <> b.url AND starts_with(b.url, a.url)")
def source_overlap(spark, sf_dir):
    """Folders whose address another's begins with: each folder's own prefixes meet the folders in an equi-join."""
    p = _table(spark, sf_dir, "pages").select(F.regexp_replace("url", "[^/]*$", "").alias("url")).distinct().where("url <> ''")
    steps = F.split(F.col("url"), "/")
    shorter = F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.size(steps) - 2)), lambda n: F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/")))
    own = p.select(F.col("url").alias("other"), F.explode(shorter).alias("url")).where("url <> other")
    return own.join(p, "url").select(F.col("url").alias("one"), "other")


@query("SELECT d.doc_id, d.source, len(string_split(d.text, E'\\n'))::INTEGER AS lines FROM documents d JOIN labels l USING (doc_id)")
def chunk_point_join(spark, sf_dir):
    d, points = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id")
    return points.join(d, "doc_id").select("doc_id", "source", F.size(F.split("text", "\n")).alias("lines"))


@query(r"SELECT conv_id, turn, CASE WHEN l <> '' AND strlen(l) < 100 THEN l END AS title FROM (SELECT conv_id, turn, trim(string_split(%s, E'\n')[1]) AS l FROM conversations)" % _NORM)
def conversation_titles(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.plain_title(F.coalesce("text", F.lit(""))).alias("title"))


_BASE_HEADS = f"SELECT page_id, list(text ORDER BY level, text) AS headings FROM (SELECT page_id, level, trim(regexp_replace(raw, '<[^>]+>', '', 'g')) AS text FROM ({_LEVELS})) WHERE text <> '' GROUP BY 1"


@query(rf"""
    {_LINKS}, h AS ({_BASE_HEADS}),
    m AS (SELECT page_id AS page, {_NORM_URL.replace('base', 'link')} || '/flow-diagram.png' AS url, coalesce(text, '') || coalesce(' ' || headings[1], '') AS alt, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, headings
          FROM l LEFT JOIN h USING (page_id) JOIN (SELECT page_id, html FROM pages) USING (page_id)
          UNION ALL SELECT page_id, url || '/logo.png', 'logo', NULL, NULL FROM pages UNION ALL SELECT page_id, url || '/plot.svg', 'plot', NULL, NULL FROM pages),
    s AS (SELECT *, least(0.35 * (trim(alt) <> '')::INTEGER + 0.2 * coalesce(len(list_filter(headings, lambda h: contains(lower(trim(alt)), lower(h)))) > 0, false)::INTEGER + 0.1 * coalesce(contains(lower(trim(alt)), lower(title)), false)::INTEGER
        + 0.2 * regexp_matches(lower(url), '{"|".join(images.GOOD)}')::INTEGER - 0.3 * regexp_matches(lower(url), '{"|".join(images.BAD)}')::INTEGER, 1.0)::DOUBLE AS r FROM m
        WHERE NOT regexp_matches(lower(url), '\.svgz?($|[?#])') AND regexp_matches(lower(url), '^https?://.*\.(png|jpg|jpeg|gif|webp|bmp|tiff)$')),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, url ORDER BY r DESC, alt) AS n FROM s WHERE round(r, 6) >= 0.6) WHERE n = 1)
    SELECT page, url, alt, round(r, 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY r DESC, url) AS m FROM u) WHERE m <= 10""")
def image_candidates(spark, sf_dir):
    """The pages hold no images, so each link stands for one beside it; alt texts, titles and headings are the pages' own."""
    p = _table(spark, sf_dir, "pages")
    heads = F.array_sort(F.transform(H.headings(F.col("html")), lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"))))
    facts = p.select("page_id", H.title(F.col("html")).alias("title"), F.transform(heads, lambda h: h["text"]).alias("headings"))
    linked = _links(spark, sf_dir).select("page_id", "link", "text").join(facts, "page_id")
    alt = F.concat(F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit(" "), F.get("headings", F.lit(0))), F.lit("")))
    media = linked.select(F.col("page_id").alias("page"), F.concat(U.normalize(F.col("link")), F.lit("/flow-diagram.png")).alias("url"), alt.alias("alt"), "title", "headings")
    other = lambda name, alt: p.select(F.col("page_id").alias("page"), F.concat("url", F.lit(name)).alias("url"), F.lit(alt).alias("alt"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("array<string>").alias("headings"))
    media = media.unionByName(other("/logo.png", "logo")).unionByName(other("/plot.svg", "plot")).withColumn("css_background", F.lit(False))
    return images.candidates(media).select("page", "url", "alt", F.round("relevance", 6).alias("relevance"))


_PHASH = "xor(('0x' || substr(md5((event_id // 8) || event_type), 1, 15))::BIGINT, 1::BIGINT << (event_id % 60)::INTEGER)"


def _hashes(spark, sf_dir) -> DataFrame:
    """Events stand for images, eight to a page; images of one kind on a page differ in two bits at the most."""
    base = F.conv(F.substring(F.md5(F.concat(F.floor(F.col("event_id") / 8).cast("string"), "event_type")), 1, 15), 16, 10).cast("long")
    bit = F.expr("shiftleft(1L, cast(event_id % 60 as int))")
    return _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 8).alias("page"), F.col("event_id").alias("id"), base.bitwiseXOR(bit).alias("hash"))


@query(f"""
    WITH h AS (SELECT event_id // 8 AS page, event_id AS id, {_PHASH} AS hash FROM events)
    SELECT a.page, a.id AS one, b.id AS other, bit_count(xor(a.hash, b.hash))::INTEGER AS distance FROM h a JOIN h b ON a.page = b.page AND a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 5""")
def phash_near_dup(spark, sf_dir):
    """All pairs of near images of a page."""
    return images.near_pairs(_hashes(spark, sf_dir)).select("page", "one", "other", "distance")


@query()
def distinct_images(spark, sf_dir):
    """The images of each page that are kept, in order; a greedy choice that SQL does not express."""
    return images.distinct(_hashes(spark, sf_dir)).select("page", "id")


@query("""
    WITH a AS (SELECT source AS page, CASE WHEN lang = 'de' THEN 'image/svg+xml' ELSE 'image/png' END AS content_type, n_chars AS size, sha256(text) AS sha FROM documents)
    SELECT DISTINCT page, sha, size FROM a WHERE content_type NOT LIKE '%svg%' AND size BETWEEN 4096 AND 5000000""")
def image_assets(spark, sf_dir):
    """Documents stand for fetched files, their sources for pages."""
    d = _table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "de", "image/svg+xml").otherwise("image/png")
    return images.acceptable(d.select(F.col("source").alias("page"), kind.alias("content_type"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha"))).select("page", "sha", "size")


@query("SELECT conv_id, turn, concat_ws(' | ', nullif(trim(text), ''), nullif(trim(role), ''), CASE WHEN turn > 0 THEN 'Part > ' || turn END) AS context FROM conversations")
def image_context(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    heads = F.when(F.col("turn") > 0, F.array(F.lit("Part"), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", images.context(F.col("text"), F.col("role"), heads).alias("context"))


@query("SELECT page_id, [url || '/a.png', url || '/b.png?x=1'] AS urls FROM pages")
def srcset_urls(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", U.srcset(F.concat("url", F.lit("/a.png 1x, "), "url", F.lit("/b.png?x=1  2x,"))).alias("urls"))


@query("""
    SELECT vec_id AS id, '{"source_id":"label-' || label || '","doc_uri":' || label || CASE WHEN lang IS NOT NULL THEN ',"title":"' || lang || '"' ELSE '' END || ',"headings":["' || label || '"]'
        || ',"chunk_index":' || vec_id || CASE WHEN lang = 'de' THEN ',"modality":"image"' ELSE '' END || '}' AS payload FROM embeddings LEFT JOIN documents ON vec_id = doc_id""")
def point_payloads(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    rows = _points(spark, sf_dir).join(d, "id", "left").withColumn("title", F.col("lang")).withColumn("headings", F.array(F.col("doc_uri").cast("string")))
    return S.payload(rows.withColumn("chunk_index", F.col("id")).withColumn("modality", F.when(F.col("lang") == "de", "image")).withColumn("media_url", F.lit(None).cast("string")))


# -- look-ups --------------------------------------------------------------


@query("SELECT doc_id, source AS source_id, lang AS uri FROM documents WHERE source = 'src5'")
def documents_of_source(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), F.col("lang").alias("uri"))
    return status.documents_of(d, "src5")


def _turns(spark, sf_dir) -> DataFrame:
    """Conversations stand for documents, their turns for chunks, roles for modalities."""
    c = _table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), F.nullif("role", F.lit("user")).alias("modality"), F.concat_ws(":", "conv_id", "turn").alias("point_id"), F.sha2("text", 256).alias("chunk_hash"))


@query("SELECT conv_id::VARCHAR AS doc_id, turn::INTEGER AS chunk_index, conv_id || ':' || turn AS point_id FROM conversations WHERE conv_id = 3")
def chunks_of_document(spark, sf_dir):
    return status.chunks_of(_turns(spark, sf_dir), "3").select("doc_id", "chunk_index", "point_id")


@query("SELECT turn::INTEGER AS chunk_index FROM conversations WHERE conv_id = 3 AND role = 'assistant'")
def chunks_by_modality(spark, sf_dir):
    return status.chunks_of(_turns(spark, sf_dir), "3", "assistant").select("chunk_index")


@query("SELECT conv_id || ':' || turn AS point_id FROM conversations WHERE conv_id = 3 AND role = 'user' AND turn >= 1")
def chunks_from_index(spark, sf_dir):
    """The text chunks (users' turns here) of a document from a place on."""
    t = _turns(spark, sf_dir).withColumn("modality", F.coalesce("modality", F.lit("text")))
    return merge.chunks_from(t, "3", 1).select("point_id")


@query("SELECT conv_id || ':' || turn AS point_id FROM conversations WHERE conv_id = 3 AND role = 'assistant'")
def chunks_removed_by_modality(spark, sf_dir):
    gone, _ = merge.split_modality(_turns(spark, sf_dir), "3", "assistant")
    return gone.select("point_id")


@query("SELECT DISTINCT conv_id || ':' || turn AS point_id FROM conversations JOIN documents ON conv_id = doc_id WHERE source = 'src2'")
def point_ids_of_source(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"))
    return merge.point_ids(_turns(spark, sf_dir), d, "src2")


@query("SELECT DISTINCT conv_id || ':' || turn AS point_id FROM conversations")
def all_point_ids(spark, sf_dir):
    return merge.point_ids(_turns(spark, sf_dir))


@query("""
    WITH a AS (SELECT conv_id, turn, 'old' AS id, sha256(text) AS h FROM conversations), b AS (SELECT conv_id, turn + 1 AS turn, 'new' AS id, sha256(text || role) AS h FROM conversations)
    SELECT coalesce(a.conv_id, b.conv_id)::VARCHAR AS doc_id, coalesce(a.turn, b.turn)::INTEGER AS chunk_index, coalesce(a.id, b.id) AS id, coalesce(b.h, a.h) AS chunk_hash FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def upsert_chunks(spark, sf_dir):
    """A chunk that comes again keeps its id and takes the new hash."""
    c = _table(spark, sf_dir, "conversations")
    rows = lambda shift, text, name, day: c.select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + shift).cast("int").alias("chunk_index"), F.lit(name).alias("id"), F.sha2(text, 256).alias("chunk_hash"), F.lit(day).cast("timestamp").alias("created_at"), F.lit(day).cast("timestamp").alias("updated_at"))
    return merge.upsert(rows(0, F.col("text"), "old", "2024-01-01"), rows(1, F.concat("text", "role"), "new", "2024-02-01"), ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", "id", "chunk_hash")


@query("""
    WITH r AS (SELECT 'src' || (user_id % 20) AS source_id, *, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS n FROM events),
    d AS (SELECT source, count(*) AS documents, sum(len(string_split(text, E'\\n')))::BIGINT AS chunks FROM documents GROUP BY 1)
    SELECT source AS id, documents, chunks, CASE WHEN event_type = 'click' THEN 'indexing' WHEN event_type = 'error' THEN 'error' ELSE 'ready' END AS state, CASE WHEN event_type = 'error' THEN 2 ELSE 0 END::INTEGER AS error_count
    FROM d LEFT JOIN r ON r.source_id = source AND n = 1""")
def list_sources(spark, sf_dir):
    """Sources with their counts, the state and the errors of their latest run."""
    d, e = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "events")
    sources = d.select(F.col("source").alias("id")).distinct().select("id", F.lit("dir").alias("source_type"), F.col("id").alias("uri"), F.lit(None).cast("string").alias("name"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    runs = e.select(F.col("event_id").alias("id"), F.concat(F.lit("src"), F.col("user_id") % 20).alias("source_id"), F.lit("ingest").alias("operation"), F.expr(_STATUS).alias("status"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.when(F.col("event_type") == "error", F.array("event_type", "props")).alias("errors"))
    docs, chunks = d.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id")), d.select("doc_id", F.explode(F.split("text", "\n")))
    return status.list_sources(sources, docs, chunks, runs).select("id", "documents", "chunks", "state", "error_count")


@query("SELECT source || ':' || source AS line FROM (SELECT DISTINCT source FROM documents)")
def source_completions(spark, sf_dir):
    return status.completions(_table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct().select("id", F.lit(None).cast("string").alias("name"), F.col("id").alias("uri")), "zsh")


@query("SELECT page_id, string_split(url, '#')[1] || '#/page/' || page_id AS link FROM pages")
def hash_route_urls(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", U.hash_route(F.col("url"), F.concat(F.lit("/page/"), "page_id")).alias("link"))


@query(f"""
    WITH f AS (SELECT min(url) AS base FROM pages), s AS (SELECT {_PAGE_HOST.format(u='base')} AS host, regexp_replace({_PATH}, '[^/]*$', '') AS folder FROM f),
    {_LINKS.replace('WITH a AS', 'a AS')}
    SELECT DISTINCT link, {_PAGE_HOST.format(u='link')} = s.host AND starts_with({_PATH.replace('base', 'link')}, s.folder) AS inside FROM l, s""")
def crawl_scope(spark, sf_dir):
    """Whether links lie on the first page's host and under its folder."""
    first = _table(spark, sf_dir, "pages").agg(F.min("url").alias("u")).select(U.host(F.col("u")).alias("host"), F.regexp_replace(U.path(F.col("u")), "[^/]*$", "").alias("folder")).first()
    return _links(spark, sf_dir).select("link").distinct().select("link", U.in_scope(F.col("link"), [first.host], first.folder).alias("inside"))
