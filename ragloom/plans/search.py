"""Search as one lazy plan: filters, exact cosine top-k, texts, score floor, rerank, one hit per document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec as V


#: Scores of texts for a query, by place; places left out are dropped, none at all leaves the hits as they are.
Reranker = Callable[[str, list[str]], dict[int, float]]


@dataclass(frozen=True)
class QueryOptions:
    k: int = 10
    min_score: float = 0.0
    source_ids: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    path_prefix: str | None = None
    dedupe: bool = False
    hybrid: bool = False
    bm25_weight: float = 0.3
    rerank: bool = False
    rerank_top_k: int = 10
    max_results: int = 100


#: What a point tells beside its vector, in the order of its JSON form.
PAYLOAD = ("source_id", "source_type", "source_uri", "doc_id", "doc_uri", "title", "headings", "chunk_index", "chunk_hash", "updated_at", "modality", "media_url", "media_hash")


def payload(points: DataFrame) -> DataFrame:
    """(id, payload): a point's columns as JSON; what is null or not there is left out."""
    held = [c for c in PAYLOAD if c in points.columns]
    return points.select("id", F.to_json(F.struct(*held), {"ignoreNullFields": "true"}).alias("payload"))


#: Columns of points that filters read.
FILTERS = ("source_id", "source_type", "doc_uri")


def condition(o: QueryOptions) -> Column:
    """Which points may be found."""
    out = F.lit(True)
    if o.source_ids:
        out &= F.col("source_id").isin(list(o.source_ids))
    if o.source_types:
        out &= F.col("source_type").isin(list(o.source_types))
    if o.path_prefix:
        out &= F.col("doc_uri").startswith(o.path_prefix)
    return out


def filtered(points: DataFrame, o: QueryOptions) -> DataFrame:
    return points.where(condition(o))


def top_k(points: DataFrame, query: list[float], k: int, vector: str = "vector", tie: str = "id") -> DataFrame:
    """The k nearest by cosine; the query is a literal, so scoring and the heap run where the vectors lie."""
    stored = F.col("norm") if "norm" in points.columns else F.lit(None).cast("double")
    return points.withColumn("score", V.cosine_known(F.col(vector), stored, query)).orderBy(F.desc("score"), tie).limit(k)


def min_score(hits: DataFrame, floor: float) -> DataFrame:
    return hits.where(F.col("score") >= floor)


def best_per_document(hits: DataFrame, document: str = "doc_uri", tie: str = "id") -> DataFrame:
    """The hit of each document with the highest score, ties by ``tie``.

    Spark takes the first row of a window's groups before the shuffle too, so
    each task sends one row a document; rows should be narrow, as tasks sort them.
    """
    place = F.row_number().over(Window.partitionBy(document).orderBy(F.desc_nulls_last("score"), tie))
    return hits.withColumn("_place", place).where("_place = 1").drop("_place")


def hybrid(hits: DataFrame, terms: list[str], mean_length: float, weight: float) -> DataFrame:
    """(1 - w) * cosine + w * raw BM25."""
    scored = hits.withColumn("bm25_score", T.bm25(terms, F.col("chunk_text"), F.lit(mean_length)))
    return scored.withColumn("score", (1 - weight) * F.col("vector_score") + weight * F.coalesce("bm25_score", F.lit(0.0)))


def rerank(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """``scores`` (id, rerank_score) replace the scores; hits without one go; no scores at all: the order stays."""
    if scores.isEmpty():
        return hits.orderBy(F.desc("score"), "id").limit(k)
    return hits.join(scores, "id").withColumn("score", F.col("rerank_score")).drop("rerank_score").orderBy(F.desc("score"), "id").limit(k)


def rerank_by(hits: DataFrame, query: str, scorer: Reranker, k: int) -> DataFrame:
    """``rerank`` with scores from outside; at most twice ``k`` hits reach the driver."""
    rows = hits.orderBy(F.desc("score"), "id").select("id", "chunk_text").collect()
    found = scorer(query, [r.chunk_text or "" for r in rows]) if rows else {}
    scores = hits.sparkSession.createDataFrame([(rows[i].id, float(s)) for i, s in found.items() if 0 <= i < len(rows)], "id string, rerank_score double")
    return rerank(hits, scores, k)


def search(points: DataFrame, chunks: DataFrame | None, query_text: str, query: list[float], o: QueryOptions = QueryOptions(), mean_length: float | None = None, reranker: Reranker | None = None, reranks_media: bool = False, near: Callable[[list[float], int, Column], DataFrame] | None = None) -> DataFrame:
    """points: id, vector, source_id, source_type, doc_uri ...; chunks: id, chunk_text, joined to the hits only.

    Without ``chunks``, points carry ``chunk_text`` themselves.  Without a
    ``reranker`` BM25 scores the hits; ``mean_length`` saves a scan for it.  A
    reranker of texts only leaves hits of other modalities behind the texts.
    ``near`` finds the nearest points by an index instead of a scan.
    """
    k = min(o.k, o.max_results)
    hits = near(query, 2 * k, condition(o)) if near else top_k(filtered(points, o), query, 2 * k)
    hits = hits.withColumnRenamed("score", "vector_score").withColumn("score", F.col("vector_score"))
    hits = hits.drop("vector") if chunks is None else hits.drop("vector").join(chunks.select("id", "chunk_text"), "id", "left")
    hits = hits.withColumn("bm25_score", F.lit(None).cast("double"))
    terms = [t for t in query_text.lower().split() if len(t.encode()) >= 3]
    if mean_length is None and (o.hybrid or (o.rerank and reranker is None)):
        mean_length = (points if chunks is None else chunks).agg(F.avg(F.octet_length("chunk_text"))).first()[0] or 1.0
    if o.hybrid:
        hits = hybrid(hits, terms, mean_length, o.bm25_weight)
    hits = min_score(hits, o.min_score)
    order = [F.desc("score"), F.col("id")]
    if o.rerank:
        is_text = F.coalesce("modality", F.lit("text")) == "text" if "modality" in hits.columns and not reranks_media else F.lit(True)
        texts = hits.where(is_text)
        if reranker is None:
            ranked = rerank(texts, texts.select("id", T.bm25(terms, F.col("chunk_text"), F.lit(mean_length)).alias("rerank_score")), o.rerank_top_k)
        else:
            ranked = rerank_by(texts, query_text, reranker, o.rerank_top_k)
        hits = ranked.withColumn("behind", F.lit(0)).unionByName(hits.where(~is_text).withColumn("behind", F.lit(1)))
        order = [F.col("behind"), *order]
    if o.dedupe:
        hits, order = best_per_document(hits), order[-2:]
    return hits.orderBy(*order).limit(k).drop("behind")
