import random

from ragloom.functions import text as T
from ragloom.operators import parse as P
from pyspark.sql import functions as F

MD = """# Main *Title*

A paragraph with `code` and a [link](https://x.org/a) and ![pic](p.png)
over two lines.

## Section

```rust
fn main() {}
```

### Sub

- one
- two **bold**

```
bare
```
"""


def test_markdown():
    p = P.markdown(MD)
    assert p.title == "Main Title"
    assert [(h["level"], h["text"]) for h in p.headings] == [(1, "Main Title"), (2, "Section"), (3, "Sub")]
    assert all(p.text.encode()[h["position"] :].startswith(h["text"].encode()) for h in p.headings)
    assert [(c["language"], c["content"]) for c in p.code_blocks] == [("rust", "fn main() {}"), (None, "bare")]
    assert p.links == [{"url": "https://x.org/a", "text": "link", "is_internal": False}]
    assert p.media[0]["url"] == "p.png" and "• two bold\n" in p.text and "`code`" in p.text
    assert "link and pic over two lines." in p.text
    assert [h["level"] for h in P.markdown("# H1\n## H2\n### H3\n## Another H2").headings] == [1, 2, 3, 2]
    assert P.markdown("```python\nnever closed").code_blocks == [{"language": "python", "content": "never closed", "position": 0}]
    assert P.markdown("").text == "" and P.markdown("a_b_c * d").text == "a_b_c * d"


def test_html():
    page = """<html><head><title> T </title><style>p {color: red}</style></head><body><h2>Two</h2><h1>One</h1><p>See <a href="/b">this</a></p>
    <pre><code class="language-rust">let x = 1 &lt; 2;</code></pre><img src="d.png" alt=" D " srcset="d.png 1x, d-2x.png 2x">
    <picture><source srcset="s.png 1x"></picture><div style="background-image: url('bg.jpg')"></div><script>hidden()</script></body></html>"""
    p = P.html(page, "https://x.org/a/")
    assert p.title == "T" and "hidden" not in p.text and "color" not in p.text
    assert [(h["level"], h["text"]) for h in p.headings] == [(2, "Two"), (1, "One")]
    assert p.links == [{"url": "https://x.org/b", "text": "this", "is_internal": True}]
    assert [(c["language"], c["content"]) for c in p.code_blocks] == [("rust", "let x = 1 < 2;"), (None, "let x = 1 < 2;")]
    assert [(m["url"], m["alt"], m["tag"]) for m in p.media] == [
        ("https://x.org/a/d.png", "D", "img"), ("https://x.org/a/d-2x.png", "D", "img"), ("https://x.org/a/s.png", None, "source"), ("https://x.org/a/bg.jpg", None, "style"),
    ]
    assert P.html("no tags").text == "no tags" and P.html("").text == ""


def test_parse_documents(spark):
    rows = [(1, "# A\n\ntext", "markdown"), (2, None, "html"), (3, "<p>x  y</p>", "html"), (4, "Title\n\n\n\nb  c", "unknown"), (5, "q", None)]
    d = P.parse_documents(spark.createDataFrame(rows, "id int, text string, content_type string"))
    got = {r.id: (r.parsed.title, r.parsed.text) for r in d.collect()}
    assert got == {1: ("A", "A\ntext"), 2: (None, ""), 3: (None, "x y"), 4: ("Title", "Title\n\nb c"), 5: ("q", "q")}
    plain = spark.createDataFrame([(" a\t b \n c\n\n\nd\n",)], "t string").select(T.normalize_whitespace(F.col("t")).alias("n")).first().n
    assert plain == P.normalize_whitespace(" a\t b \n c\n\n\nd\n")


def test_white_space_against_a_plain_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\t\r\x0b\u00a0\u2003 ") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_whitespace(F.col("t")).alias("n"), T.flatten_whitespace(F.col("t")).alias("f"))
    for r in rows.collect():
        assert r.n == P.normalize_whitespace(r.t) and r.f == " ".join(r.t.split())


def test_markdown_quotes_references_and_tables():
    p = P.markdown('> outer\n>> inner *deep*\n> > - item one\n\nSee [the guide][g] and [short] and ![pic][p].\n\n[g]: https://x.org/g "T"\n[short]: <#part>\n[p]: /img/p.png\n\n| a | b |\n|---|---|\n| 1 | [c](d.md) |\n')
    assert p.text == "outer\n\ninner deep\n\n• item one\n\nSee the guide and short and pic.\n\n| a | b | |---|---| | 1 | c |"  # tables are text, as without the extension
    assert [(x["url"], x["text"], x["is_internal"]) for x in p.links] == [("https://x.org/g", "the guide", False), ("#part", "short", True), ("d.md", "c", True)]
    assert p.media == [{"url": "/img/p.png", "alt": "pic", "tag": "img", "css_background": False}]


#: Markdown, and its text by the events of a CommonMark parser without extensions.
CASES = [
    ("a\nb", "a b"), ("a  \nb\\\nc", "a b c"), ("a\n\nb", "a\n\nb"),
    ("> a\nlazy\n\nout", "a lazy\n\nout"), ("> a\n>\n> b", "a\n\nb"), ("> > a\n> b", "a b"), ("> - a\n> - b\n\nc", "• a\n• b\n\nc"),
    ("- a\n- b", "• a\n• b"), ("- a\n\n- b", "• a\n\n\n• b"), ("- a\n\n  more\n- b", "• a\n\nmore\n\n\n• b"), ("- a\n  - b\n  - c\n- d", "• a• b\n• c\n\n\n• d"),
    ("1. a\n2. b\n\ntext", "• a\n• b\n\ntext"), ("text\n2. b", "text 2. b"), ("text\n1. b", "text\n\n• b"), ("- a\n* b", "• a\n\n• b"), ("-\n  a", "• a"), ("-\n\n  a", "• \n\na"), ("10) x", "• x"),
    ("- a\n\n      code", "• a\n\n\n```\ncode\n```"), ("- > q\n- ```\n  f\n  ```", "• q\n\n\n• \n```\nf\n```"),
    ("    code\n\n      two\n\nt", "```\ncode\n\n  two\n```\nt"), ("a\n    b", "a b"), ("~~~ x y\n```\n~~~~\nz", "```\n```\n```\nz"), ("````\n```\n````", "```\n```\n```"), ("> ```\n> x\ny", "```\nx\n```\ny"),
    ("a\n---\nb\n===", "a\n\nb"), ("---\na", "a"), ("* * *\na", "a"), ("# a #\n####### b", "a\n####### b"), ("#no\n#", "#no"),
    ("*a* **b** ***c*** _d_ __e__", "a b c d e"), ("a*b*c a_b_c", "abc a_b_c"), ("* a", "• a"), ("2 * 3 * 4", "2 * 3 * 4"), ("**a*", "*a"), ("*a **b* c**", "a b c"), ("~~a~~", "~~a~~"), ("\\*a\\*", "*a*"), ("*a `*` b*", "a `*` b"), ("**a *b* c**", "a b c"), ("_a*b_c*", "_ab_c"),
    ("`a  b` ``c`d`` `e", "`a  b` `c`d` `e"), ("`` `x` ``", "``x``"), ("&amp; &lt;x&gt; &#65; &nope; &copy;", "& <x> A &nope; ©"),
    ("[a](b) [c] [d][e]", "a [c] [d][e]"), ("[a *b*](<c d> 'T')", "a b"), ("[a [b](c)](d)", "[a b](d)"), ("![a [b](c)](d)", "a b"), ("[x](a\\)b)", "x"), ("[x](a(b)c)", "x"), ("<http://x.org/a> <me@x.org> <b>bold</b>", "http://x.org/a me@x.org bold"),
    ("<div>\nhidden *x*\n</div>\n\nseen", "seen"), ("<!-- a\n\nb -->\nc", "c"), ("a <!-- x --> b", "a  b"), ("<i>\nx\n\ny", "y"),
    ("[r]\n\n[R]: /u\n'title'\nrest", "r\n\nrest"), ("[q]: /x y\n", "[q]: /x y"), ("", ""), ("\t\n \n", ""),
]


def test_markdown_block_tree():
    for value, text in CASES:
        assert P.markdown(value).text == text, value
    p = P.markdown("- [a](u1)\n  > # Deep [b](u2)\n\n[c][]\n\n[c]: <u3> (t)\n[c]: u4\n\n1. ```py title\n   x\n    y\n   ```\n")
    assert [(x["url"], x["text"]) for x in p.links] == [("u1", "a"), ("u2", "b"), ("u3", "c")] and p.title == "Deep b"
    assert p.code_blocks[0]["language"] == "py title" and p.code_blocks[0]["content"] == "x\n y"
    for found in (*p.headings, *({"text": "\n```", **c} for c in p.code_blocks)):
        assert p.text.encode()[found["position"] :].startswith(found["text"].encode())


def test_markdown_of_any_shape():
    """Marks in any order are parsed to an end, and text without marks comes back."""
    rng = random.Random(8)
    parts = ["a", "b ", "\n", "\n\n", "> ", "- ", "1. ", "    ", "*", "**", "_", "`", "```", "[", "](x)", "]", "![", "<b>", "<!--", "-->", "#", "# ", "---", "===", "\\", "&amp;", "[r]: u", "\t", "~~~"]
    for _ in range(3000):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        p = P.markdown(value)
        assert all(p.text.encode()[h["position"] :].startswith(h["text"].encode()) for h in p.headings)
    deep = P.markdown("> " * 3000 + "x" + "[" * 3000 + "*" * 3000 + "a" + "`" * 999)
    assert deep.text.startswith("x[")
