"""What turns texts into vectors and reranks hits: hash vectors in plain expressions, or an HTTP backend in Arrow batches."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import models
from .errors import EmbeddingError
from .functions import vec as V

#: (address, JSON body, seconds) -> JSON answer
Post = Callable[[str, dict, float], object]


def post_json(address: str, body: dict, seconds: float) -> object:
    request = urllib.request.Request(address, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.loads(answer.read())
    except (urllib.error.URLError, TimeoutError, ValueError) as e:
        raise EmbeddingError(f"{address}: {e}") from e


def get_json(address: str, seconds: float = 30.0) -> object:
    try:
        with urllib.request.urlopen(address, timeout=seconds) as answer:
            return json.loads(answer.read())
    except (urllib.error.URLError, TimeoutError, ValueError) as e:
        raise EmbeddingError(f"{address}: {e}") from e


def with_retries(post: Post, address: str, body: dict, seconds: float = 30.0, retries: int = 2, sleep=time.sleep) -> object:
    for n in range(retries + 1):
        try:
            return post(address, body, seconds)
        except EmbeddingError:
            if n == retries:
                raise
            sleep(0.2 * (n + 1))
    raise AssertionError("not reached")


def vectors_of(answer: object) -> list[list[float]]:
    """The vectors of an answer in any of three shapes: ``embeddings``, ``vectors`` or ``data[].embedding``."""
    if isinstance(answer, dict):
        for name in ("embeddings", "vectors"):
            if isinstance(answer.get(name), list):
                return answer[name]
        if isinstance(answer.get("data"), list):
            return [d["embedding"] for d in answer["data"]]
    raise EmbeddingError("the answer holds no vectors")


class Embedder(Protocol):
    dim: int

    def column(self, text: Column) -> Column: ...

    def images(self, data: Column, context: Column) -> Column: ...

    def one(self, spark, text: str) -> list[float]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic vectors without a model; the expression stays in the JVM."""

    dim: int = 64

    def column(self, text: Column) -> Column:
        return V.hash_embed(text, self.dim)

    def images(self, data: Column, context: Column) -> Column:
        """The image's vector, between it and its context's where it has one."""
        image = V.hash_embed(F.sha2(data, 256), self.dim)
        return F.when(F.coalesce(F.trim(context), F.lit("")) == "", image).otherwise(V.fuse(image, V.hash_embed(F.coalesce(context, F.lit("")), self.dim)))

    def one(self, spark, text: str) -> list[float]:
        return spark.range(1).select(V.hash_embed(F.lit(text), self.dim).alias("v")).first().v


@dataclass(frozen=True)
class HttpEmbedder:
    url: str
    model: str
    dim: int
    batch_size: int = 32
    post: Post = post_json

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors in the order of the texts, batch by batch; a wrong count or length is an error."""
        return self._asked("text", texts)

    def _asked(self, kind: str, inputs: list) -> list[list[float]]:
        out: list[list[float]] = []
        size = models.batch_size(self.batch_size, self.model)
        for first in range(0, len(inputs), size):
            batch = inputs[first : first + size]
            got = vectors_of(with_retries(self.post, f"{self.url.rstrip('/')}/v1/embed/{kind}", {"model": self.model, "inputs": batch}))
            if len(got) != len(batch):
                raise EmbeddingError(f"{len(batch)} inputs sent, {len(got)} vectors came back")
            if bad := next((v for v in got if len(v) != self.dim), None):
                raise EmbeddingError(f"a vector of length {len(bad)} came back, not {self.dim}")
            out += got
        return out

    def column(self, text: Column) -> Column:
        embed = self.embed

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(embed(texts.fillna("").tolist()), index=texts.index)

        return run(text)

    def embed_images(self, data: list[bytes], contexts: list[str | None]) -> list[list[float]]:
        """Joint models take the image with its context; dual encoders take both apart, and the vectors are fused."""
        known = models.embedder(self.model)
        if known is not None and (not known.multimodal or known.strategy == models.LATE):
            raise EmbeddingError(f"{self.model} makes no single vector of an image")
        joint = known is None or known.strategy == models.JOINT
        coded = [{"image_base64": base64.b64encode(d).decode(), **({"text": c} if joint and c else {})} for d, c in zip(data, contexts, strict=True)]
        out = self._asked("image_text", coded)
        if not joint:
            named = [i for i, c in enumerate(contexts) if c and c.strip()]
            for i, v in zip(named, self.embed([contexts[i] for i in named]), strict=True):
                pair = np.array([out[i], v], float)
                pair /= np.maximum(np.linalg.norm(pair, axis=1), 1e-300)[:, None]
                middle = pair.mean(axis=0)
                out[i] = (middle / (np.linalg.norm(middle) or 1.0)).tolist()
        return out

    def images(self, data: Column, context: Column) -> Column:
        embed = self.embed_images

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for d, c in batches:
                yield pd.Series(embed(d.tolist(), [None if x is None or x != x else x for x in c]), index=d.index)

        return run(data, context)

    def one(self, spark, text: str) -> list[float]:
        return self.embed([text])[0]


def http_rerank(url: str, model: str, query: str, texts: list[str], post: Post = post_json) -> dict[int, float]:
    """Score by place in ``texts`` (a query's few hits); places that do not exist are dropped."""
    if models.reranker(model) is None:
        raise EmbeddingError(f"unknown reranker {model}")
    answer = with_retries(post, f"{url.rstrip('/')}/v1/rerank", {"model": model, "query": query, "documents": texts})
    results = answer.get("results", []) if isinstance(answer, dict) else answer
    return {int(r["index"]): float(r["score"]) for r in results if 0 <= int(r["index"]) < len(texts)}


#: A picture of one grey point, for models that are probed with an image.
_POINT = base64.b64encode(b"P5 1 1 255 \x80").decode()


def resolve(config, post: Post = post_json, get: Callable[[str], object] = get_json) -> int:
    """The vector length of the configured model, once its server has been asked what it can do.

    A model that is not registered must be among the server's; models of late
    interaction, and without text, are refused.  What the settings say must
    agree with the probe.
    """
    e, url = config.embedding, config.embedding.url.rstrip("/")
    known = models.embedder(e.model)
    if known is None:
        offered = get(f"{url}/capabilities")
        found = next((m for m in offered.get("models", []) if m.get("id") == e.model), None)
        if found is None:
            raise EmbeddingError(f"the server at {url} has no model {e.model}")
        if "text" not in found.get("modalities", ["text"]):
            raise EmbeddingError(f"{e.model} takes no text")
    body = {"model": e.model, "text": "probe"} | ({"image_base64": _POINT} if known is not None and known.strategy == models.JOINT else {})
    said = with_retries(post, f"{url}/probe", body)
    if (known is not None and known.strategy == models.LATE) or said.get("multivector"):
        raise EmbeddingError(f"{e.model} gives several vectors for an input")
    dim = config.dim(said.get("embedding_dim"))
    if not dim:
        raise EmbeddingError(f"the vector length of {e.model} is not known")
    return dim


def make(config, post: Post = post_json, get: Callable[[str], object] = get_json) -> Embedder:
    e = config.embedding
    if e.backend == "hash":
        return HashEmbedder(e.dimension or 64)
    return HttpEmbedder(e.url, e.model, resolve(config, post, get), e.batch_size, post)
