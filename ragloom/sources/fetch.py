"""A fetcher over the standard library: up to five redirects, gzip and deflate, a byte limit."""

from __future__ import annotations

import gzip
import urllib.error
import urllib.request
import zlib
from functools import partial

from ..errors import FetchError
from .web import Fetcher


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = 5


def http_fetcher(agent: str, seconds: float = 30.0, most_bytes: int = 64 << 20) -> Fetcher:
    """(status, content type, text, final address) of an address; it can be sent to tasks."""
    return partial(_fetch_text, agent=agent, seconds=seconds, most_bytes=most_bytes)


def _fetch_text(address: str, agent: str, seconds: float, most_bytes: int) -> tuple[int, str, str, str]:
    request = urllib.request.Request(address, headers={"User-Agent": agent, "Accept-Encoding": "gzip, deflate"})
    try:
        with urllib.request.build_opener(_Redirects).open(request, timeout=seconds) as answer:
            data = answer.read(most_bytes + 1)
            if len(data) > most_bytes:
                raise FetchError(f"{address}: more than {most_bytes} bytes")
            packing = answer.headers.get("Content-Encoding", "")
            data = gzip.decompress(data) if packing == "gzip" else zlib.decompress(data) if packing == "deflate" else data
            charset = answer.headers.get_content_charset() or "utf-8"
            try:
                text = data.decode(charset, "replace")
            except LookupError:
                text = data.decode("utf-8", "replace")
            return answer.status, answer.headers.get("Content-Type", ""), text, answer.url
    except urllib.error.HTTPError as e:
        return e.code, "", "", address
    except (urllib.error.URLError, TimeoutError, OSError, ValueError, EOFError, zlib.error) as e:
        raise FetchError(f"{address}: {e}") from e


def bytes_fetcher(agent: str, seconds: float = 30.0, most_bytes: int = 8 << 20):
    """(status, content type, bytes) of an address, for images; it can be sent to tasks."""
    return partial(_fetch_bytes, agent=agent, seconds=seconds, most_bytes=most_bytes)


def _fetch_bytes(address: str, agent: str, seconds: float, most_bytes: int) -> tuple[int, str, bytes]:
    request = urllib.request.Request(address, headers={"User-Agent": agent})
    try:
        with urllib.request.build_opener(_Redirects).open(request, timeout=seconds) as answer:
            data = answer.read(most_bytes + 1)
            return (answer.status if len(data) <= most_bytes else 413), answer.headers.get("Content-Type", ""), data
    except urllib.error.HTTPError as e:
        return e.code, "", b""
    except (urllib.error.URLError, TimeoutError, OSError, ValueError) as e:
        raise FetchError(f"{address}: {e}") from e
