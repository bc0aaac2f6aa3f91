"""Text columns: white space, titles, content types, hashes and ids, query terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings that are never read as text.
SKIPPED = (
    "png jpg jpeg gif bmp ico svg webp mp3 mp4 wav ogg webm avi mov zip tar gz bz2 xz 7z rar exe dll so dylib bin "
    "woff woff2 ttf otf eot pyc pyo class o obj lock DS_Store pdf"
).split()


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind that Unicode knows."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normalize_whitespace(c: Column) -> Column:
    """Paragraph breaks become two line feeds, line breaks one, other runs one space; a single space is not written anew."""
    c = F.regexp_replace(c, r"(?U)\s*\n\s*\n\s*", "\n\n")
    c = F.regexp_replace(c, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return strip(F.regexp_replace(c, r"(?U)[^\S\n]{2,}|[^\S\n ]", " "))


def flatten_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s{2,}|[^\S ]", " "))


def plain_title(c: Column) -> Column:
    """The first line, if it has text and fewer than 100 bytes."""
    line = strip(F.substring_index(normalize_whitespace(c), "\n", 1))
    return F.when((line != "") & (F.octet_length(line) < 100), line)


def file_ending(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r"[^.].*\.([^.]*)$", 1)


def should_skip(path: Column) -> Column:
    """Endings are compared in lower case, as the list stands."""
    return F.lower(file_ending(path)).isin(SKIPPED)


def type_by_ending(path: Column) -> Column:
    e = file_ending(path)
    return F.when(e.isin("html", "htm"), "html").when(e.isin("md", "markdown", "mdx"), "markdown").when(e.isin("txt", "text", "rst"), "plaintext").otherwise("unknown")


def type_by_mime(mime: Column) -> Column:
    m = F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(m.contains("text/html") | m.contains("application/xhtml"), "html").when(m.contains("text/markdown"), "markdown").when(m.contains("text/plain"), "plaintext").otherwise("unknown")
    )


def content_type(path: Column, mime: Column) -> Column:
    """The MIME type decides unless it tells nothing; then the ending."""
    return F.coalesce(F.nullif(type_by_mime(mime), F.lit("unknown")), type_by_ending(path))


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8192."""
    return F.hex(F.substring(content, 1, 8192)).rlike("^(?:..)*?00")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_hash(doc_hash: Column, text: Column) -> Column:
    return F.sha2(F.concat(doc_hash, text), 256)


def point_id(h: Column) -> Column:
    """UUID version 5 of a hash's text in the OID namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8")), F.encode(h, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.expr("1").cast("int") + F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    fourth = F.element_at(F.split(variant, ""), nibble)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(fourth, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def query_terms(q: Column) -> Column:
    """Lower-cased words of three bytes or more; punctuation stays."""
    return F.filter(F.split(F.lower(q), r"(?U)\s+"), lambda t: F.octet_length(t) >= 3)


def bm25(terms: list[str], text: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Term counts are of substrings of the lower-cased text, lengths in bytes, and all terms weigh alike."""
    low, norm = F.lower(text), k1 * (1 - b + b * F.octet_length(text) / mean_length)
    score = F.lit(0.0)
    for t in terms:
        tf = (F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / float(len(t))
        score = score + F.when(tf > 0, tf * (k1 + 1) / (tf + norm)).otherwise(0.0)
    return score
