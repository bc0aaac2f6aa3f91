"""Settings: dataclasses with defaults, read from TOML and the environment, checked across fields, written back as TOML."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field

from . import models
from .errors import ConfigError
from .operators.chunk import ChunkConfig
from .plans.search import QueryOptions
from .sources.web import CrawlLimits


@dataclass
class Embedding:
    model: str = "BAAI/bge-small-en-v1.5"
    allow_custom: bool = False
    backend: str = "hash"
    url: str = "http://127.0.0.1:7997"
    batch_size: int = 32
    dimension: int | None = None


@dataclass
class Chunk:
    max_chars: int = 1500
    min_chars: int = 100
    overlap_chars: int = 200
    prefer_heading_boundaries: bool = True


@dataclass
class Crawl:
    max_depth: int = 3
    max_pages: int = 1000
    rate_limit_per_host: float = 2.0
    user_agent: str = "ragloom/0.1 (Documentation Indexer)"
    timeout_secs: int = 30
    respect_robots_txt: bool = True
    auto_js_rendering: bool = True
    js_page_load_timeout_ms: int = 30_000
    js_render_wait_ms: int = 2_000


@dataclass
class Query:
    default_k: int = 10
    max_results: int = 100
    min_score: float = 0.0
    hybrid_search: bool = False
    bm25_weight: float = 0.3


@dataclass
class Reranker:
    enabled: bool = False
    model: str = "BAAI/bge-reranker-base"
    top_k: int = 10


@dataclass
class Multimodal:
    enabled: bool = False
    include_images: bool = True
    include_audio: bool = False
    include_video: bool = False
    min_asset_bytes: int = 4_096
    max_asset_bytes: int = 5_000_000
    max_assets_per_page: int = 10
    allowed_mime_prefixes: list[str] = field(default_factory=lambda: ["image/"])
    min_relevance_score: float = 0.6
    include_css_backgrounds: bool = False


BACKENDS = ("hash", "http")


@dataclass
class Config:
    warehouse: str = "index"
    embedding: Embedding = field(default_factory=Embedding)
    chunk: Chunk = field(default_factory=Chunk)
    crawl: Crawl = field(default_factory=Crawl)
    query: Query = field(default_factory=Query)
    reranker: Reranker = field(default_factory=Reranker)
    multimodal: Multimodal = field(default_factory=Multimodal)

    def validate(self) -> Config:
        e, c, q, m = self.embedding, self.chunk, self.query, self.multimodal
        known = models.embedder(e.model)
        rules = (
            (c.max_chars >= c.min_chars, "chunk.max_chars must not be under chunk.min_chars"),
            (c.overlap_chars * 5 < c.max_chars * 4, "chunk.overlap_chars must stay under 0.8 of chunk.max_chars"),
            (0 <= q.min_score <= 1, "query.min_score must lie in 0 .. 1"),
            (0 <= q.bm25_weight <= 1, "query.bm25_weight must lie in 0 .. 1"),
            (self.crawl.rate_limit_per_host > 0, "crawl.rate_limit_per_host must be positive"),
            (e.batch_size > 0, "embedding.batch_size must be positive"),
            (e.backend in BACKENDS, f"embedding.backend must be one of {', '.join(BACKENDS)}"),
            (e.backend != "http" or bool(e.url.strip()), "embedding.url must not be empty"),
            (bool(e.model.strip()), "embedding.model must not be empty"),
            (known or e.allow_custom, f"unknown embedding.model {e.model}; known: {', '.join(models.names(models.EMBEDDERS))}"),
            (known is None or known.strategy != models.LATE, f"embedding.model {e.model} gives many vectors a text and cannot be indexed"),
            (not m.enabled or known is None or known.multimodal, f"multimodal needs a model that takes images, not {e.model}"),
            (not self.reranker.enabled or models.reranker(self.reranker.model), f"unknown reranker.model {self.reranker.model}"),
            (not (m.include_audio or m.include_video), "audio and video are not supported"),
            (0 <= m.min_relevance_score <= 1, "multimodal.min_relevance_score must lie in 0 .. 1"),
            (m.min_asset_bytes <= m.max_asset_bytes, "multimodal.min_asset_bytes must not exceed max_asset_bytes"),
        )
        for ok, text in rules:
            if not ok:
                raise ConfigError(text)
        return self

    def dim(self, probed: int | None = None) -> int | None:
        """The vector length: what is set here, what the backend says, what the registry knows; the first two must agree."""
        own = self.embedding.dimension
        if own and probed and own != probed:
            raise ConfigError(f"embedding.dimension is {own}, the backend gives {probed}")
        known = models.embedder(self.embedding.model)
        return own or probed or (known.dim if known else None)

    def chunking(self) -> ChunkConfig:
        c = self.chunk
        return ChunkConfig(c.max_chars, c.min_chars, c.overlap_chars, c.prefer_heading_boundaries)

    def crawling(self, **more) -> CrawlLimits:
        c = self.crawl
        wait = max(c.timeout_secs, c.js_page_load_timeout_ms / 1000, 1)
        return CrawlLimits(**{"max_depth": c.max_depth, "max_pages": c.max_pages, "rate": c.rate_limit_per_host, "agent": c.user_agent, "respect_robots": c.respect_robots_txt, "seconds": wait * c.max_pages} | more)

    def querying(self, **more) -> QueryOptions:
        q = self.query
        base = {"k": q.default_k, "min_score": q.min_score, "hybrid": q.hybrid_search, "bm25_weight": q.bm25_weight, "max_results": q.max_results, "rerank": self.reranker.enabled, "rerank_top_k": self.reranker.top_k}
        return QueryOptions(**base | more)


#: Environment variables that set fields, over what the file says.
ENVIRONMENT = {"RAGLOOM_WAREHOUSE": ("", "warehouse"), "RAGLOOM_EMBEDDING_URL": ("embedding", "url"), "RAGLOOM_EMBEDDING_MODEL": ("embedding", "model")}


def from_dict(values: dict) -> Config:
    out = Config()
    for name, value in values.items():
        if not hasattr(out, name):
            raise ConfigError(f"unknown setting {name}")
        part = getattr(out, name)
        if not dataclasses.is_dataclass(part):
            setattr(out, name, value)
            continue
        if not isinstance(value, dict):
            raise ConfigError(f"{name} must be a table")
        for k, v in value.items():
            if not hasattr(part, k):
                raise ConfigError(f"unknown setting {name}.{k}")
            setattr(part, k, v)
    return out


def load(path: str, environment: dict | None = None) -> Config:
    try:
        with open(path, "rb") as f:
            out = from_dict(tomllib.load(f))
    except FileNotFoundError as e:
        raise ConfigError(f"no configuration at {path}") from e
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    for name, (part, key) in ENVIRONMENT.items():
        if value := (os.environ if environment is None else environment).get(name):
            setattr(getattr(out, part) if part else out, key, value)
    return out.validate()


def _toml(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
        return f'"{escaped}"'
    if isinstance(value, list):
        return f"[{', '.join(map(_toml, value))}]"
    return repr(value)


def irrelevant(c: Config) -> set[str]:
    """Settings that nothing reads as the others stand."""
    out = set()
    if not c.multimodal.enabled:
        out |= {f"multimodal.{f.name}" for f in dataclasses.fields(Multimodal) if f.name != "enabled"}
    if not c.reranker.enabled:
        out |= {"reranker.model", "reranker.top_k"}
    if not c.query.hybrid_search:
        out.add("query.bm25_weight")
    if c.embedding.backend == "hash":
        out.add("embedding.url")
    return out


def render(c: Config) -> str:
    """All settings as TOML; those that stand at their default or that nothing reads are comments."""
    blank, skip, lines = Config(), irrelevant(c), []

    def put(name: str, key: str, value, default) -> None:
        if value is not None:
            lines.append(f"{'# ' if value == default or name in skip else ''}{key} = {_toml(value)}")

    put("warehouse", "warehouse", c.warehouse, blank.warehouse)
    for f in dataclasses.fields(c):
        part = getattr(c, f.name)
        if dataclasses.is_dataclass(part):
            lines += ["", f"[{f.name}]"]
            for g in dataclasses.fields(part):
                put(f"{f.name}.{g.name}", g.name, getattr(part, g.name), getattr(getattr(blank, f.name), g.name))
    return "\n".join(lines) + "\n"


def save(c: Config, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(c))
