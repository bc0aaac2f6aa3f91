"""The registered embedding and reranking models, and look-ups by id and ability."""

from __future__ import annotations

from dataclasses import dataclass

TEXT, IMAGE, IMAGE_TEXT = "text", "image", "image_text"
DUAL, JOINT, LATE = "dual_encoder", "joint", "late_interaction"


@dataclass(frozen=True)
class Model:
    id: str
    dim: int | None
    takes: tuple[str, ...]
    strategy: str | None
    max_batch: int

    @property
    def multimodal(self) -> bool:
        return self.takes != (TEXT,)


# Public model names, vector lengths and batch limits; no length: the backend is asked.
EMBEDDERS = (
    Model("BAAI/bge-small-en-v1.5", 384, (TEXT,), DUAL, 32),
    Model("BAAI/bge-base-en-v1.5", 768, (TEXT,), DUAL, 32),
    Model("BAAI/bge-large-en-v1.5", 1024, (TEXT,), DUAL, 16),
    Model("sentence-transformers/all-MiniLM-L6-v2", 384, (TEXT,), DUAL, 32),
    Model("Qwen/Qwen3-VL-Embedding-2B", None, (TEXT, IMAGE_TEXT), JOINT, 8),
    Model("Qwen/Qwen3-VL-Embedding-8B", None, (TEXT, IMAGE_TEXT), JOINT, 4),
    Model("jinaai/jina-clip-v2", None, (TEXT, IMAGE), DUAL, 16),
    Model("google/siglip2-base-patch16-224", None, (TEXT, IMAGE), DUAL, 16),
    Model("vidore/colpali", None, (TEXT, IMAGE), LATE, 8),
)
RERANKERS = (
    Model("BAAI/bge-reranker-base", None, (TEXT,), None, 32),
    Model("Qwen/Qwen3-VL-Reranker-2B", None, (TEXT, IMAGE_TEXT), None, 8),
    Model("Qwen/Qwen3-VL-Reranker-8B", None, (TEXT, IMAGE_TEXT), None, 4),
    Model("jinaai/jina-reranker-m0", None, (TEXT, IMAGE_TEXT), None, 16),
    Model("lightonai/MonoQwen2-VL-v0.1", None, (TEXT, IMAGE_TEXT), None, 8),
)


def embedder(name: str) -> Model | None:
    return next((m for m in EMBEDDERS if m.id == name), None)


def reranker(name: str) -> Model | None:
    return next((m for m in RERANKERS if m.id == name), None)


def names(models: tuple[Model, ...], multimodal: bool | None = None) -> list[str]:
    return [m.id for m in models if multimodal is None or m.multimodal == multimodal]


def batch_size(asked: int, name: str) -> int:
    """What is asked for, up to the model's limit; 0 asks for the limit."""
    known = embedder(name)
    most = known.max_batch if known else asked or 32
    return max(1, most) if asked == 0 else min(asked, most)
