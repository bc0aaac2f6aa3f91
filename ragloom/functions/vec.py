"""Vector columns, in doubles: products, lengths, cosine, fusion, and a deterministic embedder."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_known(a: Column, a_norm: Column, b: list[float]) -> Column:
    """Cosine with a literal vector, where the column's norm is stored; a row without one has it computed."""
    length = math.sqrt(sum(float(x) * float(x) for x in b))
    return dot(a, F.array(*[F.lit(float(x)) for x in b])) / (F.coalesce(a_norm, norm(a)) * F.lit(length))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row; inside a lambda a captured expression would be computed for every element."""
    return F.transform(F.array(value), use)[0]


def rounded(x: Column, places: int = 6) -> Column:
    """``x`` to the nearest multiple of 10^-places, halves away from zero, as SQL engines round doubles: what becomes zero from below is -0.0, which ``F.round`` makes 0.0."""
    y = x * float(10**places)
    return F.when(F.abs(y - F.rint(y)) == 0.5, y + F.signum(y) * 0.5).otherwise(F.rint(y)) / float(10**places)


def normalize(a: Column) -> Column:
    """The direction of a vector; a zero vector stays."""
    held = F.struct(a.cast("array<double>").alias("v"), norm(a).alias("n"))
    return let(held, lambda h: F.when(h["n"] == 0, h["v"]).otherwise(F.transform(h["v"], lambda x: x / h["n"])))


def fuse(a: Column, b: Column) -> Column:
    """The direction between two vectors' directions."""
    return let(F.zip_with(normalize(a), normalize(b), lambda x, y: (x + y) / 2.0), normalize)


def hash_embed(seed: Column, dim: int = 64) -> Column:
    """Value k is the k-th little-endian 32-bit word of SHA-256(text | counter), scaled to -1 .. 1."""
    blocks = [F.sha2(F.concat(F.encode(seed, "UTF-8"), F.unhex(F.lit(f"{c:02x}000000"))), 256) for c in range((dim + 7) // 8)]

    def words(block: Column) -> Column:
        def word(i):
            swapped = F.concat(*[block.substr(i * 8 + F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)])
            return F.conv(swapped, 16, 10).cast("double") / 4294967296.0 * 2.0 - 1.0

        return F.transform(F.sequence(F.lit(0), F.lit(7)), word)

    return F.slice(F.flatten(F.transform(F.array(*blocks), words)), 1, dim)
