"""Images of a page: which are worth embedding, and which are alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U

# Words in addresses that speak for or against an image.
GOOD = "diagram architecture overview flow guide example schema chart figure graph plot screenshot".split()
BAD = "logo icon sprite avatar placeholder spinner favicon badge thumbnail thumb".split()
HAMMING, LEAST_BYTES, MOST_BYTES = 5, 4096, 5_000_000
#: Pages of up to so many images of a batch are worked on side by side.
SHORT = 32


def relevance(alt: Column, title: Column, headings: Column, address: Column, css: Column) -> Column:
    """What speaks for an image, at most 1; 0 if only what speaks against it is known."""
    trimmed, low = F.trim(alt), F.lower(address)
    text = F.lower(trimmed)
    has_alt = F.coalesce(trimmed != "", F.lit(False))
    in_heading = F.coalesce(F.exists(headings, lambda h: F.contains(text, F.lower(h))), F.lit(False)) & alt.isNotNull()
    in_title = F.coalesce(F.contains(text, F.lower(title)), F.lit(False)) & alt.isNotNull()
    good, bad = low.rlike("|".join(GOOD)), low.rlike("|".join(BAD))
    score = sum((F.when(c, v).otherwise(0.0) for c, v in ((has_alt, 0.35), (in_heading, 0.2), (in_title, 0.1), (good, 0.2), (bad, -0.3), (css, -0.1))), F.lit(0.0))
    return F.when(has_alt | in_heading | in_title | good, F.least(score, F.lit(1.0))).otherwise(0.0)


def context(alt: Column, title: Column, headings: Column) -> Column:
    return F.concat_ws(" | ", F.nullif(F.trim(alt), F.lit("")), F.nullif(F.trim(title), F.lit("")), F.nullif(F.array_join(headings, " > "), F.lit("")))


def candidates(media: DataFrame, least: float = 0.6, most: int = 10, css: bool = False, prefixes: tuple[str, ...] = ("image/",)) -> DataFrame:
    """media: page, url, alt, title, headings, css_background.  The best of each address, then the best ``most`` of each page."""
    rows = media.where(~F.col("css_background") | F.lit(css)).where(~U.is_svg(F.col("url"))).where(U.allowed_image(F.col("url"), list(prefixes)))
    rows = rows.withColumn("relevance", relevance(F.col("alt"), F.col("title"), F.col("headings"), F.col("url"), F.col("css_background"))).where(F.round("relevance", 6) >= least)
    rows = rows.withColumn("media_key", U.normalize(F.col("url")))
    per_url = Window.partitionBy("page", "media_key").orderBy(F.desc("relevance"), "url", "alt")
    per_page = Window.partitionBy("page").orderBy(F.desc("relevance"), "url")
    rows = rows.withColumn("__n", F.row_number().over(per_url)).where("__n = 1")
    return rows.withColumn("__n", F.row_number().over(per_page)).where(F.col("__n") <= most).drop("__n")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def average_hash(luma: list[int]) -> int:
    """64 bits of an 8 x 8 grey image: as bright as the mean at least."""
    mean = sum(luma) // 64
    return sum(1 << i for i, v in enumerate(luma) if v >= mean)


def drop_alike(hashes: list[int], radius: int = HAMMING) -> list[int]:
    """Places kept when images are taken in order and those near a kept one go."""
    kept: list[int] = []
    for i, h in enumerate(hashes):
        if all((h ^ hashes[k]).bit_count() > radius for k in kept):
            kept.append(i)
    return kept


def near_pairs(hashes: DataFrame, radius: int = HAMMING, bits: int = 64) -> DataFrame:
    """hashes: page, id, hash.  (page, one, other, distance) of the pairs of a page within ``radius``, each once.

    Two hashes that differ in ``radius`` bits agree in one of ``radius`` + 1
    blocks, so pairs meet in an equi-join on page, block and its bits, and are
    taken from the first block in which they agree.
    """
    n = radius + 1
    edges = [bits * k // n for k in range(n + 1)]
    block = lambda c, k: F.expr(f"shiftrightunsigned({c}, {edges[k]})").bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    parts = F.posexplode(F.array(*[block("hash", k) for k in range(n)])).alias("block", "bits")
    dealt = hashes.select("page", "id", "hash", parts)
    a = dealt.select("page", "block", "bits", F.col("id").alias("one"), F.col("hash").alias("h"))
    b = dealt.select("page", "block", "bits", F.col("id").alias("other"), F.col("hash").alias("g"))
    pairs = a.join(b, ["page", "block", "bits"]).where("one < other").withColumn("distance", hamming(F.col("h"), F.col("g"))).where(F.col("distance") <= radius)
    differ = F.col("h").bitwiseXOR(F.col("g"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] if edges[k + 1] < 64 else -(1 << edges[k]))) == 0, k) for k in range(n)])
    return pairs.where(F.col("block") == first).select("page", "one", "other", "distance")


def distinct(hashes: DataFrame, radius: int = HAMMING) -> DataFrame:
    """hashes: page, id, hash.  The images of each page kept when they are taken by id and those near a kept one go.

    Rows come to a task by page, sorted by id, and pass it in batches, all short
    pages of a batch at once; from batch to batch a task holds only the kept
    hashes of the page that goes on.  A null hash is near to nothing.
    """
    kinds = dict(hashes.dtypes)
    ordered = hashes.select("page", "id", F.col("hash").cast("long")).repartition("page").sortWithinPartitions("page", F.asc_nulls_last("id"), "hash")
    return ordered.mapInArrow(lambda batches: _distinct(batches, radius), f"page {kinds['page']}, id {kinds['id']}")


def _distinct(batches, radius: int):
    last, held = None, np.empty(0, np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        page, known = b.column("page"), np.asarray(b.column("hash").is_valid())
        h = np.asarray(b.column("hash").fill_null(0)).view(np.uint64)
        code = np.asarray(page.dictionary_encode("encode").indices)
        begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[begin, len(h)])
        if last is None or page[0].as_py() != last[0]:
            held = held[:0]
        last = (page[b.num_rows - 1].as_py(),)
        long = size > SHORT
        long[0] |= len(held) > 0
        keep = np.ones(len(h), bool)
        _drop_side_by_side(h, known, keep, begin[~long], size[~long], radius)
        for k in np.flatnonzero(long):
            rows = np.arange(begin[k], begin[k] + size[k])[known[begin[k] : begin[k] + size[k]]]
            keep[rows] = _drop_in_turn(h[rows], held if k == 0 else held[:0], radius)
        own = h[begin[-1] :][(keep & known)[begin[-1] :]]
        held = np.concatenate([held, own]) if len(begin) == 1 else own
        kept = b.take(pa.array(np.flatnonzero(keep)))
        yield pa.RecordBatch.from_arrays([kept.column("page"), kept.column("id")], ["page", "id"])


def _drop_side_by_side(h: np.ndarray, known: np.ndarray, keep: np.ndarray, begin: np.ndarray, size: np.ndarray, radius: int) -> None:
    """Takes the n-th images of all pages at once, and compares them with each place before."""
    for n in range(1, int(size.max(initial=0))):
        begin, size = begin[size > n], size[size > n]
        now = begin + n
        for before in range(n):
            then = begin + before
            keep[now] &= ~(known[now] & known[then] & keep[then] & (np.bitwise_count(h[now] ^ h[then]) <= radius))


def _drop_in_turn(h: np.ndarray, held: np.ndarray, radius: int) -> np.ndarray:
    """Which of a page's next images stay, when those ``held`` were kept before; a few at a time, against a stretch of the kept ones each."""
    stay = np.ones(len(h), bool)
    kept = np.concatenate([held, h])  # room for all
    n = len(held)
    for first in range(0, len(h), SHORT):
        some = h[first : first + SHORT]
        far = stay[first : first + SHORT]
        for k in range(0, n, 4096):
            far &= ~(np.bitwise_count(some[:, None] ^ kept[None, k : min(n, k + 4096)]) <= radius).any(1)
        near = np.bitwise_count(some[:, None] ^ some[None, :]) <= radius
        for i in range(1, len(some)):
            far[i] &= not (near[i, :i] & far[:i]).any()
        own = some[far]
        kept[n : n + len(own)] = own
        n += len(own)
    return stay


def acceptable(assets: DataFrame, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> DataFrame:
    """assets: page, content_type, size, sha.  No SVG, sizes in range, equal bytes once a page."""
    rows = assets.where(~F.lower(F.coalesce("content_type", F.lit(""))).contains("svg")).where(F.col("size").between(least, most))
    return rows.dropDuplicates(["page", "sha"])
