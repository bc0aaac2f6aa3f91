"""A tool server over standard input and output: one JSON-RPC message a line.

Long jobs (ingest, update, reindex) start in a thread and answer at once; they
run one after the other, as each makes a new state of the index.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable
from typing import IO

from . import __version__
from .commands import Index
from .errors import EngineError
from .sources.web import Fetcher

PROTOCOL = "2024-11-05"
PARSE, NO_METHOD, BAD_PARAMS = -32700, -32601, -32602
LIMIT, MOST, FLOOR = 5, 20, 0.5


def _schema(required: tuple[str, ...] = (), **fields) -> dict:
    return {"type": "object", "properties": fields, "required": list(required)}


_TEXT, _TEXTS, _COUNT = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "integer", "minimum": 1}
TOOLS = {
    "rag_search": (
        "Find the passages of the index that answer a question best, one for each document.",
        _schema(("query",), query=_TEXT, limit=_COUNT | {"maximum": MOST, "default": LIMIT}, source_ids=_TEXTS, min_score={"type": "number", "minimum": 0, "maximum": 1, "default": FLOOR}),
    ),
    "rag_sources": ("List the sources of the index with counts and states.", _schema()),
    "rag_status": ("Count what the index holds.", _schema()),
    "rag_ingest_source": (
        "Start reading a folder, a site or a sitemap into the index.",
        _schema(("source_type", "uri"), source_type=_TEXT | {"enum": ["dir", "url", "sitemap"]}, uri=_TEXT, name=_TEXT, max_pages=_COUNT, max_depth=_COUNT),
    ),
    "rag_update": ("Start reading every source again.", _schema(prune={"type": "boolean", "default": True})),
    "rag_reindex": ("Start embedding the stored passages again.", _schema(source_id=_TEXT, batch_size=_COUNT | {"default": 32})),
}


class ToolError(EngineError):
    """What a tool was asked makes no sense."""


def _strings(value) -> tuple[str, ...]:
    return tuple(v for v in value if isinstance(v, str)) if isinstance(value, list) else ()


class Server:
    def __init__(self, index: Index, fetch: Fetcher | None = None, start: Callable[[Callable], None] | None = None):
        self.index, self.fetch = index, fetch
        self.lock, self.failures = threading.Lock(), []
        self.start = start or (lambda job: threading.Thread(target=job, daemon=True).start())

    # -- tools ---------------------------------------------------------------------

    def call(self, name: str, args: dict) -> dict:
        tool = getattr(self, name, None) if name in TOOLS else None
        try:
            if tool is None:
                raise ToolError(f"Unknown tool: {name}")
            return {"content": [{"type": "text", "text": tool(args)}]}
        except EngineError as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}

    def rag_search(self, a: dict) -> str:
        if not isinstance(a.get("query"), str):
            raise ToolError("query is missing")
        hits = self.index.query(a["query"], k=max(0, min(int(a.get("limit", LIMIT)), MOST)), min_score=float(a.get("min_score", FLOOR)), source_ids=_strings(a.get("source_ids")), dedupe=True).collect()  # at most MOST
        if not hits:
            return "No results found matching your query."
        parts = [f"Found {len(hits)} results:\n"]
        for n, h in enumerate(hits, 1):
            about = [f"## Result {n} (score: {h.score:.2f})", f"**Source:** {h.doc_uri}"]
            if h.title:
                about.append(f"**Title:** {h.title}")
            if h.headings:
                about.append(f"**Section:** {' > '.join(h.headings)}")
            parts.append("\n".join([*about, "", "```", h.chunk_text or "", "```", ""]))
        return "\n".join(parts)

    def rag_sources(self, a: dict) -> str:
        rows = self.index.sources().collect()  # one row a source
        lines = [f"- **{r.name or r.uri}** ({r.source_type}, {r.state})\n  - id: {r.id}\n  - uri: {r.uri}\n  - {r.documents} documents, {r.chunks} chunks, {r.error_count} errors" for r in rows]
        return "\n".join(["# Sources", "", *(lines or ["No sources."])])

    def rag_status(self, a: dict) -> str:
        s = self.index.status().first()
        failed = "".join(f"\nFailed: {f}" for f in self.failures)
        if not s.connected:
            return f"# Index\n\nThe store cannot be reached.{failed}"
        points = f"{s.points}" if s.collection else "no collection yet"
        return f"# Index\n\n- sources: {s.sources}\n- documents: {s.documents}\n- chunks: {s.chunks}\n- points: {points}{failed}"

    def _later(self, what: str, job: Callable[[], object]) -> str:
        def run():
            with self.lock:
                try:
                    job()
                except Exception as e:  # noqa: BLE001 - the thread's only way to tell
                    self.failures.append(f"{what}: {e}")

        self.start(run)
        return f"Started {what}."

    def rag_ingest_source(self, a: dict) -> str:
        kind, uri, name = a.get("source_type"), a.get("uri"), a.get("name")
        if kind not in ("dir", "url", "sitemap") or not isinstance(uri, str) or not uri:
            raise ToolError("source_type (dir, url or sitemap) and uri are needed")
        if kind != "dir" and self.fetch is None:
            raise ToolError("this server has no fetcher")
        limits = {k: int(a[k]) for k in ("max_pages", "max_depth") if k in a}
        jobs = {"dir": lambda: self.index.ingest_dir(uri, name), "url": lambda: self.index.ingest_url(uri, self.fetch, name, **limits), "sitemap": lambda: self.index.ingest_sitemap(uri, self.fetch, name)}
        return self._later(f"ingest of {uri}", jobs[kind])

    def rag_update(self, a: dict) -> str:
        return self._later("update", lambda: self.index.update(self.fetch, a.get("prune", True) is not False))

    def rag_reindex(self, a: dict) -> str:
        one = a.get("source_id")
        if one is not None:
            self.index.find_source(one)
        return self._later("reindex", lambda: self.index.reindex(one))

    # -- messages ------------------------------------------------------------------

    def answer(self, line: str) -> dict | None:
        try:
            m = json.loads(line)
        except ValueError as e:
            return _error(None, PARSE, f"Parse error: {e}")
        if not isinstance(m, dict):
            return _error(None, PARSE, "Parse error: not an object")
        if "id" not in m or "method" not in m:
            return None  # notifications and answers get none
        params = m.get("params") or {}
        simple = {
            "initialize": lambda: {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "ragloom", "version": __version__}},
            "tools/list": lambda: {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]},
            "resources/list": lambda: {"resources": []},
            "prompts/list": lambda: {"prompts": []},
        }
        if m["method"] in simple:
            return {"jsonrpc": "2.0", "id": m["id"], "result": simple[m["method"]]()}
        if m["method"] != "tools/call":
            return _error(m["id"], NO_METHOD, f"Method not found: {m['method']}")
        if not isinstance(params, dict) or not isinstance(params.get("name"), str) or not isinstance(params.get("arguments", {}), dict):
            return _error(m["id"], BAD_PARAMS, "Invalid params")
        try:
            return {"jsonrpc": "2.0", "id": m["id"], "result": self.call(params["name"], params.get("arguments", {}))}
        except (TypeError, ValueError) as e:
            return _error(m["id"], BAD_PARAMS, f"Invalid params: {e}")

    def serve(self, lines: Iterable[str], out: IO[str]) -> None:
        for line in lines:
            if line.strip() and (reply := self.answer(line)) is not None:
                out.write(json.dumps(reply, ensure_ascii=False) + "\n")
                out.flush()


def _error(at, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": at, "error": {"code": code, "message": text}}
