"""Web sources with a pluggable fetcher: robots rules, pace, breadth-first crawl, sitemaps."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import Protocol
from urllib.parse import urljoin, urlsplit, urlunsplit

from ..errors import FetchError
from ..functions.url import DENIED

#: Takes an address and gives (status, content type, body, final address).
Fetcher = Callable[[str], tuple[int, str, str, str]]
SITEMAPS = 50


class Renderer(Protocol):
    """Runs a page's scripts and gives (final address, HTML)."""

    def render(self, url: str) -> tuple[str, str]: ...


class NoRenderer:
    """What stands for a renderer where none is installed."""

    def render(self, url: str) -> tuple[str, str]:
        raise FetchError(f"{url}: no renderer of JavaScript is installed")


def fetch_hash_route(base: str, route: str, renderer: Renderer) -> tuple[str, str]:
    """A route behind ``#`` exists only once scripts have run."""
    return renderer.render(base.partition("#")[0] + "#" + route)


def rendered_routes(html: str, url: str) -> list[str]:
    """Routes of a rendered page: fragments that begin with / of links to its own host, but for the root."""
    found = (urlsplit(urljoin(url, h)) for h in links_of(html))
    return sorted({p.fragment for p in found if p.hostname == urlsplit(url).hostname and p.fragment.startswith("/") and p.fragment != "/"})


def render_pages(pages: list[dict], needs: dict[str, list[str] | None], renderer: Renderer, most: int) -> tuple[list[dict], list[str]]:
    """(pages, errors) with those that need scripts rendered, and their hash routes behind them, up to ``most`` pages.

    ``needs``: address -> known routes (None: the page does not route by hash).
    """
    out, errors = [], []
    for page in pages:
        if page["url"] not in needs:
            out.append(page)
            continue
        try:
            final, html = renderer.render(page["url"])
            out.append(page | {"url": final, "html": html, "content_type": "text/html"})
        except FetchError as e:
            errors.append(str(e))
            out.append(page)
            continue
        if needs[page["url"]] is not None:
            for route in sorted({*needs[page["url"]], *rendered_routes(html, final)}):
                if len(out) >= most:
                    break
                try:
                    _, inner = fetch_hash_route(final, route, renderer)
                    out.append(page | {"url": final.partition("#")[0] + "#" + route, "html": inner, "content_type": "text/html"})
                except FetchError as e:
                    errors.append(str(e))
    return out[:most], errors


def normalize_url(u: str, keep_routes: bool = False) -> str:
    p = urlsplit(u)
    if not p.scheme or not p.netloc:
        return u
    keep = p.fragment if keep_routes and p.fragment.startswith("/") else ""
    return urlunsplit((p.scheme, p.netloc, p.path.rstrip("/") or "/", p.query, keep))


def should_crawl(u: str) -> bool:
    low = u.lower()
    fragment = low.partition("#")[2]
    return not (any(d in low for d in DENIED) or (fragment and not fragment.startswith("/")) or re.search(r"/\d{4}/\d{2}/\d{2}/", low))


@dataclass
class Robots:
    """Groups of rules by agent; the longest matching rule decides, and a tie allows."""

    content: str = ""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = field(default_factory=list)
    delays: list[tuple[str, float]] = field(default_factory=list)

    def __post_init__(self):
        agents, rules = [], None
        for line in self.content.splitlines():
            key, _, value = (x.strip() for x in line.partition("#")[0].partition(":"))
            key = key.lower()
            if key == "user-agent":
                if rules is not None:
                    agents, rules = [], None
                agents.append(value.lower())
            elif key in ("allow", "disallow"):
                if rules is None:
                    rules = []
                    self.groups.append((agents, rules))
                if value:
                    rules.append((key == "allow", value))
            elif key == "crawl-delay" and agents:
                try:
                    self.delays.append((agents[-1], float(value)))
                except ValueError:
                    continue

    def is_allowed(self, path: str, agent: str) -> bool:
        agent = agent.lower()
        own = [r for names, rules in self.groups if any(n != "*" and n and n in agent for n in names) for r in rules]
        named = any(n != "*" and n and n in agent for names, _ in self.groups for n in names)
        rules = own if named else [r for names, rs in self.groups if "*" in names for r in rs]
        best = (-1, True)
        for allow, pattern in rules:
            expression = "".join(".*" if c == "*" else re.escape(c) for c in pattern.removesuffix("$")) + ("$" if pattern.endswith("$") else "")
            if re.match(expression, path):
                best = max(best, (len(pattern), allow))
        return best[1]

    def crawl_delay(self, agent: str) -> float | None:
        """The last delay of a group that the agent's name holds, else the last for all."""
        own = [d for n, d in self.delays if n != "*" and n in agent.lower()]
        return (own or [d for n, d in self.delays if n == "*"] or [None])[-1]


class HostPace:
    """At most ``rate`` calls a second for each host."""

    def __init__(self, rate: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1.0 / rate, clock, sleep, {}

    def wait(self, host: str) -> None:
        now = self.clock()
        due = max(now, self.next.get(host, now))
        if due > now:
            self.sleep(due - now)
        self.next[host] = due + self.gap


class HostRules:
    """The robots rules of each host, fetched when first asked for; a host without any allows all."""

    def __init__(self, fetch: Fetcher, agent: str):
        self.fetch, self.agent, self.known = fetch, agent, {}

    def allows(self, address: str) -> bool:
        p = urlsplit(address)
        if p.netloc not in self.known:
            try:
                status, _, body, _ = self.fetch(f"{p.scheme}://{p.netloc}/robots.txt")
            except FetchError:
                status, body = 0, ""
            self.known[p.netloc] = Robots(body if 200 <= status < 300 else "")
        return self.known[p.netloc].is_allowed(p.path, self.agent)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href") if tag == "a" else None
        if href:
            self.found.append(href)


def links_of(html: str) -> list[str]:
    """The addresses of a page's links as they are written, in order."""
    finder = _Links()
    finder.feed(html)
    return finder.found


@dataclass
class CrawlLimits:
    max_depth: int = 3
    max_pages: int = 1000
    rate: float = 2.0
    agent: str = "ragloom"
    respect_robots: bool = True
    allowed_hosts: tuple[str, ...] = ()
    path_prefix: str | None = None
    seconds: float | None = None

    @property
    def attempts(self) -> int:
        return 5 * self.max_pages


def crawl(seed: str, fetch: Fetcher, limits: CrawlLimits = CrawlLimits(), pace: HostPace | None = None) -> tuple[list[dict], list[str]]:
    """(pages, errors), breadth first.  A page: url, html, content_type, depth, links."""
    seed = normalize_url(seed, True)
    hosts = {h.lower() for h in limits.allowed_hosts} or {urlsplit(seed).hostname}
    prefix = limits.path_prefix if limits.path_prefix is not None else urlsplit(seed).path.rpartition("/")[0] + "/"
    pace = pace or HostPace(limits.rate)
    rules = HostRules(fetch, limits.agent)
    todo, seen, pages, errors, tries, began = deque([(seed, 0)]), {seed}, [], [], 0, time.monotonic()
    while todo and len(pages) < limits.max_pages and tries < limits.attempts:
        if limits.seconds and time.monotonic() - began > limits.seconds:
            break
        at, depth = todo.popleft()
        parts = urlsplit(at)
        if limits.respect_robots and not rules.allows(at):
            errors.append(f"{at}: ruled out by robots.txt")
            continue
        tries += 1
        pace.wait(parts.netloc)
        try:
            status, kind, body, final = fetch(at)
            if not 200 <= status < 300:
                raise FetchError(f"status {status}")
        except FetchError as e:
            errors.append(f"{at}: {e}")
            continue
        links = [urljoin(final, h) for h in links_of(body)] if "html" in kind else []
        pages.append({"url": final, "html": body, "content_type": kind, "depth": depth, "links": links})
        if depth >= limits.max_depth:
            continue
        for link in links:
            to = normalize_url(link, True)
            p = urlsplit(to)
            if to not in seen and p.scheme in ("http", "https") and p.hostname in hosts and p.path.startswith(prefix) and should_crawl(to):
                seen.add(to)
                todo.append((to, depth + 1))
    return pages, errors


def tag(xml: str, name: str) -> str | None:
    found = re.search(rf"<{name}>(.*?)</{name}>", xml, re.S)
    return found[1].strip() if found else None


def _is_url(u: str | None) -> bool:
    return bool(u and urlsplit(u).scheme and urlsplit(u).netloc)


def parse_sitemap(content: str) -> tuple[list[dict], list[str]]:
    """(entries, further sitemaps) of an index, a URL set or a plain list."""
    if "<sitemapindex" in content:
        blocks = [b.partition("</sitemap>")[0] for b in content.split("<sitemap>")[1:] if "</sitemap>" in b]
        return [], [u for b in blocks if _is_url(u := tag(b, "loc"))]
    if "<urlset" in content:
        out = []
        for b in content.split("<url>")[1:]:
            inner, closed, _ = b.partition("</url>")
            if closed and _is_url(loc := tag(inner, "loc")):
                priority = tag(inner, "priority")
                try:
                    priority = float(priority) if priority else None
                except ValueError:
                    priority = None
                out.append({"loc": loc, "lastmod": tag(inner, "lastmod"), "changefreq": tag(inner, "changefreq"), "priority": priority})
        return out, []
    lines = [x.strip() for x in content.splitlines()]
    return [{"loc": x, "lastmod": None, "changefreq": None, "priority": None} for x in lines if x.startswith(("http://", "https://")) and _is_url(x)], []


def read_sitemaps(start: str, fetch: Fetcher, most: int = SITEMAPS) -> tuple[list[dict], int]:
    """(entries, failures); the latest found sitemap is read first."""
    todo, entries, failed, read = [start], [], 0, 0
    while todo and read < most:
        read += 1
        try:
            status, _, body, _ = fetch(todo.pop())
            if not 200 <= status < 300:
                raise FetchError(f"status {status}")
        except FetchError:
            failed += 1
            continue
        found, more = parse_sitemap(body)
        entries += found
        todo += more
    return entries, failed
