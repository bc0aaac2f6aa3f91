"""A stand-in for a model server: the routes that embedders ask, answered with vectors from digests.

GET /capabilities, POST /probe, /v1/embed/text, /v1/embed/image_text and
/v1/rerank, with the batch limits of the registry.  Vectors depend on the input
alone, so whatever speaks the protocol can be tried without a model.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from . import models

#: The length of vectors of models whose own the registry does not know.
DIM = 64


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def vector(seed: bytes, dim: int) -> list[float]:
    """Little-endian 32-bit words of SHA-256(seed | counter), scaled to -1 .. 1."""
    blocks = b"".join(hashlib.sha256(seed + n.to_bytes(4, "little")).digest() for n in range(-(-dim // 8)))
    return [int.from_bytes(blocks[4 * i : 4 * i + 4], "little") / 2**32 * 2 - 1 for i in range(dim)]


def _model(body: dict) -> models.Model:
    found = models.embedder(body.get("model", ""))
    if found is None:
        raise Refused(404, f"no model {body.get('model')}")
    return found


def _image(value: str) -> bytes:
    try:
        return base64.b64decode(value, validate=True)
    except (binascii.Error, ValueError, TypeError) as e:
        raise Refused(400, "image_base64 cannot be decoded") from e


def _inputs(body: dict, model: models.Model) -> list:
    inputs = body.get("inputs", [])
    if len(inputs) > model.max_batch:
        raise Refused(400, f"{len(inputs)} inputs, at most {model.max_batch} are taken at once")
    return inputs


def _described(m: models.Model) -> dict:
    return {"id": m.id, "modalities": list(m.takes), "embedding_dim": m.dim or DIM, "multivector": m.strategy == models.LATE, "max_batch": m.max_batch}


def capabilities() -> dict:
    return {"models": [_described(m) for m in models.EMBEDDERS]}


def probe(body: dict) -> dict:
    m, image = _model(body), body.get("image_base64")
    text, out = body.get("text", "").encode(), _described(m)
    dim = out["embedding_dim"]
    out["text_embeddings"] = [vector(text, dim)]
    if m.strategy == models.JOINT and image is None:
        raise Refused(400, "a joint model needs image_base64")
    if image is not None and m.multimodal:
        joint = m.strategy == models.JOINT
        out["joint_embeddings" if joint else "image_embeddings"] = [vector((text if joint else b"") + _image(image), dim)]
    return out


def embed_text(body: dict) -> dict:
    m = _model(body)
    return {"embeddings": [vector(t.encode(), m.dim or DIM) for t in _inputs(body, m)]}


def embed_image_text(body: dict) -> dict:
    m = _model(body)
    if not m.multimodal:
        raise Refused(400, f"{m.id} takes no images")
    text = lambda i: (i.get("text") or "").encode() if m.strategy == models.JOINT else b""
    return {"embeddings": [vector(text(i) + _image(i.get("image_base64")), m.dim or DIM) for i in _inputs(body, m)]}


def rerank(body: dict) -> dict:
    """The share of the query's words that a document holds."""
    if models.reranker(body.get("model", "")) is None:
        raise Refused(404, f"no model {body.get('model')}")
    asked = set(body.get("query", "").lower().split())
    score = lambda d: len(asked & set(d.lower().split())) / max(1, len(asked))
    return {"results": [{"index": i, "score": score(d)} for i, d in enumerate(body.get("documents", []))]}


GET = {"/capabilities": lambda body: capabilities()}
POST = {"/probe": probe, "/v1/embed/text": embed_text, "/v1/embed/image_text": embed_image_text, "/v1/rerank": rerank}


class _Handler(BaseHTTPRequestHandler):
    def _answer(self, routes: dict, body: dict) -> None:
        try:
            if self.path not in routes:
                raise Refused(404, f"no route {self.path}")
            status, said = 200, routes[self.path](body)
        except Refused as e:
            status, said = e.status, {"detail": str(e)}
        data = json.dumps(said).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):  # noqa: N802 - the name is the library's
        self._answer(GET, {})

    def do_POST(self):  # noqa: N802
        try:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
        except ValueError:
            body = {}
        self._answer(POST, body if isinstance(body, dict) else {})

    def log_message(self, *args):
        pass


@contextmanager
def running(port: int = 0):
    """The address of a server that runs while the block does; port 0 takes a free one."""
    server = ThreadingHTTPServer(("127.0.0.1", port), _Handler)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        yield f"http://127.0.0.1:{server.server_address[1]}"
    finally:
        server.shutdown()
        server.server_close()
