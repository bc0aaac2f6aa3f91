"""Documents parsed by structure: Markdown and HTML into text, title, headings, code blocks, links and media.

Parsing walks a text's own structure, so it runs on Arrow batches; documents
are independent, and rows stay in the partition that read them.  Positions are
bytes of the parsed text.

Defined results: a null or empty text parses to an empty one without a title;
tags and fences that are never closed end with the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .markdown import Block, Blocks, Inline

PARSED = (
    "title string, text string, headings array<struct<level:int,text:string,position:int>>, "
    "code_blocks array<struct<language:string,content:string,position:int>>, links array<struct<url:string,text:string,is_internal:boolean>>, "
    "media array<struct<url:string,alt:string,tag:string,css_background:boolean>>"
)


@dataclass
class Parsed:
    title: str | None = None
    text: str = ""
    headings: list[dict] = field(default_factory=list)
    code_blocks: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    media: list[dict] = field(default_factory=list)


def normalize_whitespace(value: str) -> str:
    """As ``functions.text.normalize_whitespace``: a run with two line feeds is a paragraph break, with one a line break, else a space."""
    return re.sub(r"\s+", lambda m: ("\n\n" if m[0].count("\n") > 1 else "\n") if "\n" in m[0] else " ", value).strip()


def plain(value: str) -> Parsed:
    text = normalize_whitespace(value)
    first = text.partition("\n")[0].strip()
    return Parsed(first if first and len(first.encode("utf-8", "surrogatepass")) < 100 else None, text)


# -- Markdown ----------------------------------------------------------------

class _Markdown:
    def __init__(self, value: str):
        self.tree = Blocks(value)
        self.out, self.parts, self.size = Parsed(), [], 0

    def write(self, piece: str) -> None:
        self.parts.append(piece)
        self.size += len(piece.encode("utf-8", "surrogatepass"))

    def inline(self, block: Block, heading: bool = False) -> str:
        """The text without marks; links and images found on the way are kept."""

        def found(kind: str, url: str, label: str) -> None:
            if kind == "image":
                self.out.media.append({"url": url, "alt": label.strip() or None, "tag": "img", "css_background": False})
            else:
                self.out.links.append({"url": url, "text": label.strip() or None, "is_internal": url.startswith("#") or "://" not in url})

        code = (lambda c: c) if heading else (lambda c: f"`{c}`")
        return Inline("\n".join(block.lines).rstrip(), self.tree.references, found, code).text()

    def heading(self, block: Block) -> None:
        text = self.inline(block, True).strip()
        if not text:
            return
        if block.level == 1 and self.out.title is None:
            self.out.title = text
        self.write("\n")
        self.out.headings.append({"level": block.level, "text": text, "position": self.size})
        self.write(text + "\n")

    def blocks(self) -> None:
        """The tree in order, however deep it is: what is still to be written, blocks or pieces of text."""
        todo: list = [(self.tree.root, False)]
        while todo:
            block, tight = todo.pop()
            if isinstance(block, str):
                self.write(block)
            elif block.kind == "heading":
                self.heading(block)
            elif block.kind == "paragraph":
                self.write(self.inline(block) + ("" if tight else "\n\n"))
            elif block.kind == "code":
                content = "\n".join(block.lines)
                self.out.code_blocks.append({"language": block.language, "content": content, "position": self.size})
                self.write(f"\n```\n{content}\n```\n")
            elif block.kind in ("root", "quote", "list", "item"):
                item = block.kind == "item"
                self.write("• " if item else "")
                todo.append(("\n" if block.kind in ("list", "item") else "", False))
                todo += [(child, item and not block.list.loose) for child in reversed(block.children)]

    def parse(self) -> Parsed:
        self.blocks()
        whole = "".join(self.parts)
        cut = len(whole.encode("utf-8", "surrogatepass")) - len(whole.lstrip().encode("utf-8", "surrogatepass"))
        for found in (*self.out.headings, *self.out.code_blocks):
            found["position"] = max(0, found["position"] - cut)
        self.out.text = whole.strip()
        return self.out


def markdown(value: str) -> Parsed:
    return _Markdown(value).parse()


# -- HTML --------------------------------------------------------------------

_BLOCKS = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
_PARAGRAPHS = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre table ul ol dl".split())
_UNSEEN = frozenset("script style noscript template head title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BACKGROUND = re.compile(r"background-image\s*:\s*url\(([^)]+)\)", re.I)


def srcset(value: str) -> list[str]:
    return [p.split()[0] for p in value.split(",") if p.strip()]


def resolve(base: str | None, url: str) -> str:
    try:
        return urljoin(base, url) if base else url
    except ValueError:
        return url


def _internal(base: str | None, url: str) -> bool:
    if not base or "://" not in url:
        return "://" not in url
    try:
        return urlsplit(url).hostname == urlsplit(base).hostname
    except ValueError:
        return False


class _Html(HTMLParser):
    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.out = base, Parsed()
        self.whole: list[str] = []  # pieces of visible text
        self.body_from: int | None = None
        self.body_to: int | None = None
        self.hidden: list[str] = []
        self.title: list[str] | None = None
        self.open: list[tuple[str, int, dict]] = []  # headings, links and code: where their text begins
        self.found: list[tuple[int, str]] = []

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        self.media(tag, at)
        if tag == "body" and self.body_from is None:
            self.hidden.clear()
            self.body_from = len(self.whole)
        if tag == "title" and self.out.title is None and self.title is None:
            self.title = []
        if tag in _UNSEEN:
            self.hidden.append(tag)
        if tag == "br":
            self.whole.append("\n")
        elif tag in _BLOCKS:
            self.whole.append("\n\n" if tag in _PARAGRAPHS else "\n")
        if tag == "li":
            self.whole.append("* ")
        if re.fullmatch("h[1-6]", tag) or tag in ("pre", "code") or (tag == "a" and "href" in at):
            self.open.append((tag, len(self.whole), at))

    def handle_endtag(self, tag):
        if tag == "title" and self.title is not None and self.out.title is None:
            self.out.title = "".join(self.title).strip() or None
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close(*self.open.pop(i), inside_pre=any(o[0] == "pre" for o in self.open))
                break
        if tag == "body":
            self.body_to = len(self.whole)
        if tag in _BLOCKS:
            self.whole.append("\n\n" if tag in _PARAGRAPHS else "\n")

    def close(self, tag: str, first: int, at: dict, inside_pre: bool) -> None:
        inner = "".join(self.whole[first:])
        if tag == "a":
            url = resolve(self.base, at["href"])
            self.out.links.append({"url": url, "text": inner.strip() or None, "is_internal": _internal(self.base, url)})
        elif tag[0] == "h":
            if text := " ".join(inner.split()):
                self.found.append((int(tag[1]), text))
        elif (tag == "pre" or inside_pre) and inner.strip():
            language = next((c.partition("-")[2] for c in at.get("class", "").split() if c.startswith(("language-", "lang-"))), None)
            self.out.code_blocks.append({"language": language, "content": inner.strip("\n"), "position": 0})

    def handle_data(self, data):
        if self.title is not None and self.out.title is None and self.hidden and self.hidden[-1] == "title":
            self.title.append(data)
        if not self.hidden:
            self.whole.append(data)

    def media(self, tag: str, at: dict) -> None:
        urls, alt = [], None
        if tag == "img":
            urls, alt = [at.get("src", ""), *srcset(at.get("srcset", ""))], at.get("alt", "").strip() or None
        elif tag == "source":
            urls = srcset(at.get("srcset", ""))
        for u in dict.fromkeys(resolve(self.base, u) for u in urls if u.strip()):
            self.out.media.append({"url": u, "alt": alt, "tag": tag, "css_background": False})
        if css := _BACKGROUND.search(at.get("style", "")):
            url = css[1].strip()
            if len(url) > 1 and url[0] == url[-1] and url[0] in "\"'":
                url = url[1:-1]
            if url:
                self.out.media.append({"url": resolve(self.base, url), "alt": None, "tag": "style", "css_background": True})

    def parse(self, value: str) -> Parsed:
        self.feed(value)
        self.close_all()
        out = self.out
        body = self.whole if self.body_from is None else self.whole[self.body_from : self.body_to]
        out.text = normalize_whitespace("".join(body))
        if not out.text and self.body_from is None:
            out.text = normalize_whitespace("".join(self.whole))
        data = out.text.encode("utf-8", "surrogatepass")

        def place(text: str) -> int:
            return max(0, data.find(text.encode("utf-8", "surrogatepass")))

        by_level = sorted(self.found, key=lambda f: f[0])
        out.headings = sorted(({"level": n, "text": t, "position": place(t)} for n, t in by_level), key=lambda h: h["position"])
        for block in out.code_blocks:
            block["position"] = place(normalize_whitespace(block["content"]))
        return out

    def close_all(self) -> None:
        super().close()
        while self.open:
            self.close(*self.open.pop(), inside_pre=any(o[0] == "pre" for o in self.open))


def html(value: str, base: str | None = None) -> Parsed:
    return _Html(base).parse(value)


PARSERS = {"markdown": lambda t, b: markdown(t), "html": html}


def parse(value: str | None, content_type: str | None, base: str | None = None) -> Parsed:
    """Of an unknown type: plain text."""
    return PARSERS.get(content_type or "", lambda t, b: plain(t))(value or "", base)


def parse_documents(docs: DataFrame, text: str = "text", content_type: str = "content_type", base: str | None = None, name: str = "parsed") -> DataFrame:
    """``docs`` with the struct ``name`` of ``PARSED``; ``base`` is the column of the address that links are relative to."""
    docs = docs.drop(name)
    inner = StructType.fromDDL(PARSED)
    schema = StructType([*docs.schema.fields]).add(name, inner)
    extra = docs.select(*docs.columns, F.col(text).cast("string").alias("__text"), F.col(content_type).cast("string").alias("__type"), (F.col(base) if base else F.lit(None)).cast("string").alias("__base"))
    names = docs.columns

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(inner)
        for b in batches:
            rows = zip(b.column("__text").to_pylist(), b.column("__type").to_pylist(), b.column("__base").to_pylist(), strict=True)
            found = pa.array([vars(parse(*r)) for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], found], [*names, name])

    return extra.mapInArrow(run, schema)
