"""Command line: python -m ragloom <command>."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys

from pyspark.sql import SparkSession

from . import config, embedders, server
from .commands import Index
from .errors import ConfigError, EngineError
from .operators.status import completions
from .sources.fetch import http_fetcher
from .sources.store import Store

DEFAULT = os.path.join("~", ".config", "ragloom", "config.toml")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ragloom", description="A retrieval and indexing engine on Spark.")
    p.add_argument("--config", default=DEFAULT, help="TOML settings")
    p.add_argument("--json", action="store_true", help="print JSON")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("init", help="write the settings file").add_argument("--force", action="store_true")
    ingest = c.add_parser("ingest", help="read a source into the index")
    ingest.add_argument("kind", choices=("dir", "url", "sitemap"))
    ingest.add_argument("uri")
    ingest.add_argument("--name")
    ingest.add_argument("--max-pages", type=int)
    ingest.add_argument("--max-depth", type=int)
    ingest.add_argument("--extensions", default="", help="of files, with commas between")
    ingest.add_argument("--exclude", action="append", default=[], help="a pattern of paths under the folder")
    query = c.add_parser("query", help="search")
    query.add_argument("text")
    query.add_argument("-k", type=int)
    query.add_argument("--min-score", type=float)
    query.add_argument("--source", action="append", default=[])
    query.add_argument("--path-prefix")
    query.add_argument("--dedupe", action="store_true")
    c.add_parser("status")
    c.add_parser("sources")
    prune = c.add_parser("prune", help="drop what is gone")
    prune.add_argument("--source")
    prune.add_argument("--dry-run", action="store_true")
    prune.add_argument("--orphans", action="store_true")
    c.add_parser("reindex").add_argument("--source")
    c.add_parser("update").add_argument("--no-prune", action="store_true")
    c.add_parser("remove").add_argument("source")
    rename = c.add_parser("rename")
    rename.add_argument("source")
    rename.add_argument("name", nargs="?", help="none: the name is cleared")
    c.add_parser("serve", help="tool server on standard input and output")
    c.add_parser("completions").add_argument("shell", choices=("bash", "zsh", "fish"))
    db = c.add_parser("db")
    db.add_argument("action", choices=("init", "status", "reset", "vacuum", "optimize"))
    db.add_argument("--yes", action="store_true")
    return p


def _rows(df) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def run(a: argparse.Namespace, index: Index, fetch) -> object:
    """What a command found or did, as plain values."""
    if a.command == "ingest":
        if a.kind == "dir":
            endings = tuple(e.strip().lstrip(".") for e in a.extensions.split(",") if e.strip())
            return dataclasses.asdict(index.ingest_dir(a.uri, a.name, endings, tuple(a.exclude)))
        if a.kind == "sitemap":
            return dataclasses.asdict(index.ingest_sitemap(a.uri, fetch, a.name))
        limits = {k: v for k, v in (("max_pages", a.max_pages), ("max_depth", a.max_depth)) if v is not None}
        return dataclasses.asdict(index.ingest_url(a.uri, fetch, a.name, **limits))
    if a.command == "query":
        asked = {"k": a.k, "min_score": a.min_score, "path_prefix": a.path_prefix}
        return _rows(index.query(a.text, dedupe=a.dedupe, source_ids=tuple(index.find_source(s).id for s in a.source), **{k: v for k, v in asked.items() if v is not None}))
    if a.command == "status" or (a.command == "db" and a.action == "status"):
        return _rows(index.status())
    if a.command == "sources":
        return _rows(index.sources())
    if a.command == "prune":
        return index.prune(a.source, a.dry_run, a.orphans)
    if a.command == "reindex":
        return {"chunks": index.reindex(a.source)}
    if a.command == "update":
        done, errors = index.update(fetch, not a.no_prune)
        return {"sources": [dataclasses.asdict(s) for s in done], "errors": errors}
    if a.command == "remove":
        return index.remove(a.source)
    if a.command == "rename":
        return index.rename(a.source, a.name)
    if a.command == "completions":
        return [r["line"] for r in _rows(completions(index.store.table("sources"), a.shell))]
    if a.command == "db" and a.action == "reset":
        if not a.yes:
            raise ConfigError("reset deletes the whole index; repeat with --yes")
        return index.store.reset()
    if a.command == "db" and a.action == "vacuum":
        return {"deleted": index.store.vacuum()}
    if a.command == "db" and a.action == "optimize":
        return {"indexed": index.optimize()}
    return None  # db init: opening the store made it


def show(value: object, as_json: bool) -> str:
    if as_json or not isinstance(value, (list, dict)):
        return json.dumps(value, default=str, ensure_ascii=False)
    rows = value if isinstance(value, list) else [value]
    return "\n".join(r if isinstance(r, str) else "\n".join(f"{k}: {v}" for k, v in r.items() if v is not None) + "\n" for r in rows)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    path = os.path.expanduser(a.config)
    try:
        if a.command == "init":
            if os.path.exists(path) and not a.force:
                raise ConfigError(f"{path} exists; repeat with --force")
            config.save(config.Config(warehouse=os.path.join(os.path.dirname(os.path.abspath(path)), "index")), path)
            print(path)
            return 0
        settings = config.load(path)
        spark = spark or SparkSession.builder.appName("ragloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        where = settings.warehouse if "://" in settings.warehouse else "file://" + os.path.abspath(settings.warehouse)
        embedder = embedders.make(settings)
        index = Index(Store(spark, where, embedder.dim), settings, embedder)
        fetch = http_fetcher(settings.crawl.user_agent, settings.crawl.timeout_secs)
        if a.command == "serve":
            server.Server(index, fetch).serve(sys.stdin, sys.stdout)
            return 0
        print(show(run(a, index, fetch), a.json))
        return 0
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
