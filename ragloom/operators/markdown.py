"""Markdown by its block tree: containers line by line, then emphasis and links by stacks of what is still open.

Blocks are quotes, lists and items, headings, fenced and indented code, HTML
and paragraphs; a paragraph goes on where a line leaves its containers without
beginning a block.  Inline, a run of ``*`` or ``_`` is taken off as far as it
finds a partner, and brackets become links where an address or a reference
follows.  Raw HTML and rules leave nothing in the text.
"""

from __future__ import annotations

import html
import re

_QUOTE = re.compile(r" {0,3}> ?")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( +)(.*)|)$")
_HTML = re.compile(r" {0,3}<(?:(?:script|pre|style|textarea)\b|!--|\?|![A-Za-z]|/?(?:address|article|aside|base|blockquote|body|center|col|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$))", re.I)
_TAG_LINE = re.compile(r" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")
_HTML_ENDS = ((re.compile(r" {0,3}<(?:script|pre|style|textarea)\b", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile(r" {0,3}<!--"), re.compile("-->")), (re.compile(r" {0,3}<\?"), re.compile(r"\?>")))
_REFERENCE = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:\s*(?:<([^<>\n]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\))|\s*\n[ \t]*(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
_TARGET = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
_TOKEN = re.compile(
    r"\\(?P<escaped>[!-/:-@\[-`{-~])|(?P<hard>(?: {2,}|\\)?\n[ ]*)|(?P<ticks>`+)|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>"
    r"|(?P<tag></?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--.*?-->|<\?.*?\?>)|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)|(?P<run>\*+|_+)|(?P<open>!?\[)|(?P<close>\])",
    re.S,
)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def _name(label: str) -> str:
    return " ".join(label.split()).casefold()


def _plain(value: str) -> str:
    return html.unescape(_ESCAPE.sub(r"\1", value))


class Block:
    def __init__(self, kind: str, **more):
        self.kind, self.children, self.lines = kind, [], []
        self.__dict__ |= more


class Blocks:
    """The tree of a text's blocks; ``references`` are the addresses of its link labels."""

    def __init__(self, value: str):
        self.root, self.references, self.blank = Block("root"), {}, False
        self.stack, self.leaf = [self.root], None
        for line in value.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            head = len(line) - len(line.lstrip(" \t"))
            self._line(line[:head].expandtabs(4) + line[head:])
        self._end(0)

    # -- what is open ------------------------------------------------------------

    def _end_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf.kind == "paragraph":
            text = "\n".join(leaf.lines)
            while m := _REFERENCE.match(text):
                self.references.setdefault(_name(m[1]), _plain(m[2] if m[2] is not None else m[3]))
                text = text[m.end() :]
            leaf.lines = text.split("\n")
            if not text.strip():
                leaf.kind = "nothing"
        elif leaf.kind == "code" and leaf.fence is None:
            while leaf.lines and not leaf.lines[-1].strip():
                leaf.lines.pop()

    def _end(self, depth: int) -> None:
        """Close what is open below so many containers under the root."""
        if len(self.stack) > depth + 1:
            self._end_leaf()
            del self.stack[depth + 1 :]
        elif depth == 0 and self.leaf is not None:
            self._end_leaf()

    def _add(self, block: Block) -> Block:
        self._end_leaf()
        inside = self.stack[-1]
        if inside.kind == "item" and inside.children and self.blank:
            inside.list.loose = True
        inside.children.append(block)
        return block

    # -- one line ----------------------------------------------------------------

    def _line(self, rest: str) -> None:
        depth = 0
        for c in self.stack[1:]:
            if c.kind == "quote":
                if not (m := _QUOTE.match(rest)):
                    break
                rest = rest[m.end() :]
            elif not rest.strip():
                if not c.children and self.blank:
                    break
                rest = ""
            elif len(rest) - len(rest.lstrip(" ")) >= c.indent:
                rest = rest[c.indent :]
            else:
                break
            depth += 1
        whole, leaf = depth == len(self.stack) - 1, self.leaf
        if whole and leaf is not None and leaf.kind in ("code", "html") and self._goes_on(leaf, rest):
            self.blank = False
            return
        if not whole and leaf is not None and leaf.kind != "paragraph":
            self._end(depth)
            whole, leaf = True, None
        while self._begins(rest, depth, whole):
            rest, depth, whole, leaf = self._begin(rest, depth)
            if rest is None:
                self.blank = False
                return
        if not rest.strip():
            self._end(depth)
            if self.leaf is not None and self.leaf.kind == "paragraph":
                self._end_leaf()
            self.blank = True
            return
        if self.leaf is not None and self.leaf.kind == "paragraph":  # in its containers or not
            self.leaf.lines.append(rest.lstrip(" "))
        else:
            self._end(depth)
            self.leaf = self._add(Block("paragraph", lines=[rest.lstrip(" ")]))
        self.blank = False

    def _goes_on(self, leaf: Block, rest: str) -> bool:
        """Whether a line belongs to open code or HTML, which it may end."""
        if leaf.kind == "html":
            if leaf.end is None and not rest.strip():
                self._end_leaf()
                return False
            if leaf.end is not None and leaf.end.search(rest):
                self._end_leaf()
            return True
        if leaf.fence is not None:
            if re.fullmatch(rf" {{0,3}}{re.escape(leaf.fence[0])}{{{len(leaf.fence)},}}[ \t]*", rest):
                self._end_leaf()
            else:
                leaf.lines.append(rest[min(leaf.indent, len(rest) - len(rest.lstrip(" "))) :])
            return True
        if rest.startswith("    ") or not rest.strip():
            leaf.lines.append(rest[4:])
            return True
        self._end_leaf()
        return False

    def _begins(self, rest: str, depth: int, whole: bool) -> bool:
        if not rest.strip():
            return False
        paragraph = self.leaf is not None and self.leaf.kind == "paragraph"
        if rest.startswith("    "):
            return not paragraph
        if _QUOTE.match(rest) or (_ATX.match(rest)) or _FENCE.match(rest) or _RULE.match(rest) or _HTML.match(rest):
            return True
        if paragraph and whole and _SETEXT.match(rest):
            return True
        if m := _ITEM.match(rest):
            # a paragraph is not cut by an empty item, or by a number other than one, but in a list
            return not paragraph or self.stack[depth].kind == "item" or len(self.stack) > depth + 1 or bool((m[4] or "").strip()) and (m[2] in "-+*" or m[2][:-1] == "1")
        return not paragraph and bool(_TAG_LINE.match(rest))

    def _begin(self, rest: str, depth: int):
        """(what is left of the line or None, containers, whether all of them, the open leaf) after a block began."""
        leaf = self.leaf
        if leaf is not None and leaf.kind == "paragraph" and depth == len(self.stack) - 1 and (m := _SETEXT.match(rest)):
            self._end_leaf()
            if leaf.kind == "paragraph":
                leaf.kind, leaf.level = "heading", 1 if m[1][0] == "=" else 2
                return None, depth, True, None
        self._end(depth)
        if rest.startswith("    "):
            self.leaf = self._add(Block("code", fence=None, language=None, lines=[rest[4:]]))
        elif m := _QUOTE.match(rest):
            self.stack.append(self._add(Block("quote")))
            return rest[m.end() :], depth + 1, True, None
        elif m := _ATX.match(rest):
            self._add(Block("heading", level=len(m[1]), lines=[m[2] or ""]))
        elif m := _FENCE.match(rest):
            self.leaf = self._add(Block("code", fence=m[2], indent=len(m[1]), language=_plain(m[3]) or None))
        elif _RULE.match(rest):
            self._add(Block("rule"))
        elif _HTML.match(rest) or _TAG_LINE.match(rest):
            end = next((e for begin, e in _HTML_ENDS if begin.match(rest)), None)
            block = self._add(Block("html", end=end))
            self.leaf = None if end is not None and end.search(rest) else block
        else:
            return self._item(_ITEM.match(rest), depth)
        return None, depth, True, self.leaf

    def _item(self, m: re.Match, depth: int):
        self._end_leaf()
        inside, mark = self.stack[-1], m[2][-1]
        last = inside.children[-1] if inside.children else None
        if last is not None and last.kind == "list" and last.mark == mark:
            last.loose |= self.blank
        else:
            last = self._add(Block("list", mark=mark, loose=False))
        spaces, text = m[3] or "", m[4] or ""
        gap = len(spaces) if text and len(spaces) < 5 else 1
        item = Block("item", indent=len(m[1]) + len(m[2]) + gap, list=last)
        last.children.append(item)
        self.stack.append(item)
        self.blank = False
        return (spaces + text)[gap:], depth + 1, True, None


class Inline:
    """The text of one block; ``found(kind, address, label)`` is told of links and images."""

    def __init__(self, value: str, references: dict[str, str], found, code):
        self.value, self.references, self.found, self.code = value, references, found, code
        self.nodes: list = []  # texts, and lists [sign, length, opens, closes]
        self.brackets: list = []  # [node, image, active, place in the value]

    def text(self) -> str:
        at, value = 0, self.value
        while m := _TOKEN.search(value, at):
            self.nodes.append(value[at : m.start()])
            at = m.end()
            if m["ticks"]:
                end = re.compile(rf"(?<!`){m['ticks']}(?!`)").search(value, at)
                if end is None:
                    self.nodes.append(m["ticks"])
                    continue
                code = value[at : end.start()].replace("\n", " ")
                self.nodes.append(self.code(code[1:-1] if code.strip() and code[0] == code[-1] == " " else code))
                at = end.end()
            elif m["run"]:
                self._run(m)
            elif m["open"]:
                self.brackets.append([len(self.nodes), m["open"] != "[", True, at])
                self.nodes.append(m["open"])
            elif m["close"]:
                at = self._close(at)
            elif m["auto"]:
                self.found("link", m["auto"] if ":" in m["auto"] else f"mailto:{m['auto']}", m["auto"])
                self.nodes.append(m["auto"])
            else:
                self.nodes.append(m["escaped"] or (html.unescape(m["entity"]) if m["entity"] else " " if m["hard"] else ""))
        self.nodes.append(value[at:])
        self._emphasis(0)
        return self._joined(0)

    def _joined(self, first: int) -> str:
        return "".join(n if isinstance(n, str) else n[0] * n[1] for n in self.nodes[first:])

    def _run(self, m: re.Match) -> None:
        before, after = self.value[m.start() - 1 : m.start()] or " ", self.value[m.end() : m.end() + 1] or " "
        mark = lambda c: not c.isalnum() and not c.isspace()
        left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
        right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
        if m["run"][0] == "_":
            left, right = left and (not right or mark(before)), right and (not left or mark(after))
        self.nodes.append([m["run"][0], len(m["run"]), left, right, len(m["run"])])

    def _emphasis(self, first: int) -> None:
        """Pair the runs behind ``first``, each closing one with the nearest that opens."""
        opened: list = []
        for n in self.nodes[first:]:
            if isinstance(n, str):
                continue
            while n[3] and n[1]:
                at = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == n[0] and not ((n[2] or opened[i][3]) and (n[4] + opened[i][4]) % 3 == 0 and (n[4] % 3 or opened[i][4] % 3))), None)
                if at is None:
                    break
                taken = 2 if min(n[1], opened[at][1]) > 1 else 1
                n[1] -= taken
                opened[at][1] -= taken
                del opened[at + bool(opened[at][1]) :]
            if n[2] and n[1]:
                opened.append(n)

    def _close(self, at: int) -> int:
        """A closing bracket: where its opening one and what follows make a link, that; where the value goes on."""
        if not self.brackets:
            self.nodes.append("]")
            return at
        first, image, active, begin = self.brackets.pop()
        label, url, end = self.value[begin : at - 1], None, at
        if active and (m := _TARGET.match(self.value, at)):
            url, end = _plain(m[1] if m[1] is not None else m[2]), m.end()
        elif active:
            m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(self.value, at)
            url = self.references.get(_name(m[1] if m and m[1].strip() else label))
            end = m.end() if m and url is not None else at
            if m and url is None and m[1].strip():
                url = None
        if url is None:
            self.nodes.append("]")
            return at
        self._emphasis(first + 1)
        text = self._joined(first + 1)
        self.nodes[first:] = [text]
        self.found("image" if image else "link", url, text)
        if not image:
            for b in self.brackets:
                b[2] = b[2] and b[1]
        return end
