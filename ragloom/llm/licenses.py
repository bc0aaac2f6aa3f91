"""License scan, in DataFrame operations only.

Notices are looked for in every whole text: lower-cased words without
punctuation, in shingles of five.  Overlapping windows of six words (every
second word; two shingles each, so every shingle lies in one window) retrieve
templates by MinHash bands, and the exact share of a template's shingles that
the document holds decides.

A template under five words is one whole-sequence shingle: it is looked for as
that run of words, and its share is 1.  Its window is a single shingle, the
least of which is itself in every band, so one band is enough.

Band settings: ``BANDS`` bands of one row.  Templates are indexed by the bands
of each of their shingles; the least hash of any window of a template is one of
these.  A window that shares one of its two shingles with a template collides
with it in a band with probability 1/2, with both in every band; so a window is
missed with a chance of 2 ** -16 at the most.  A match holds ``SHARE`` of a
template's n shingles, two to a window at the most, so 0.4 n windows of the
document should collide; 0.36 n are asked for, one at the least, which leaves
room for windows that are missed.  Nothing is filtered before the bands.

Candidates are kept by the hash of a text and not by row, so copies of a text
are retrieved once and no row number is needed; the exact check reads each
row's own text.

Defined results: null and empty texts match nothing, texts under five words
only the templates under five words; repeated rows each give their rows; equal
shares are all returned; clashing input columns are not read; an empty table or
an empty set of templates gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, STEP, BANDS, SHARE, ASKED = 5, 2, 16, 0.8, 0.36

# The wording of public licence notices.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "lgpl-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
}
# Notices that do not name a licence.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "some-rights-reserved": "Some rights reserved.",
    "public-domain": "This work is in the public domain.",
    "public-domain-release": "This is free and unencumbered software released into the public domain.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """
#: Whole licences, from the line behind the copyright line on; longer ones lie in ``license_texts``.
TEXTS = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause-text": _BSD + _AS_IS,
    "bsd-3-clause-text": _BSD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. """ + _AS_IS,
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    **{f"{f.stem.lower()}-text": f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))},
}
ALL = {**TEMPLATES, **NOTICES, **TEXTS}


def words(text: Column) -> Column:
    """Lower-cased words; runs of characters that are no letters or digits are spaces."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def all_shingles(tokens: Column) -> Column:
    at = F.when(F.size(tokens) >= SHINGLE, F.sequence(F.lit(0), F.size(tokens) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i + 1, SHINGLE), " "))


def template_table(spark: SparkSession, templates: dict[str, str] = ALL) -> DataFrame:
    """(license, parts): a template and its distinct shingles, under five words its whole sequence; as many rows as there are templates."""
    tokens = spark.createDataFrame(sorted(templates.items()), "license string, notice string").select("license", words(F.col("notice")).alias("words"))
    # shingles are made here: Spark would split a whole licence anew for each of its words
    rows = [(r.license, list(dict.fromkeys(" ".join(r.words[i : i + SHINGLE]) for i in range(max(1, len(r.words) - SHINGLE + 1)) if r.words))) for r in tokens.collect()]
    return spark.createDataFrame(rows, "license string, parts array<string>")


def _bands(shingle_hashes: list[Column]) -> list[Column]:
    """Per band the least hash of the shingles, each mixed with the band."""
    return [reduce(F.least, (F.xxhash64(s, F.lit(band)) for s in shingle_hashes)) for band in range(BANDS)]


def _run(tokens: Column, at: Column, n: int) -> list[Column]:
    return [F.get(tokens, at + k) for k in range(n)]


def _short_key(run: list[Column]) -> Column:
    """The only band that a window of under five words needs."""
    return F.xxhash64(*run, F.lit(-len(run)))


def probes(docs: DataFrame, short: list[int]) -> DataFrame:
    """(text_hash, place, key): the bands of every window of every text; ``short``: word counts of templates under five words."""
    rows = docs.select(F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    placed = rows.select("text_hash", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(STEP))).alias("place"))
    one, two = _run(F.col("words"), F.col("place"), SHINGLE), _run(F.col("words"), F.col("place") + 1, SHINGLE)
    hashed = placed.select(
        "text_hash", "place", "words",
        F.when(one[-1].isNotNull(), F.xxhash64(*one)).otherwise(F.lit(0)).alias("one"),
        F.when(two[-1].isNotNull(), F.xxhash64(*two)).alias("two"),
    ).withColumn("two", F.coalesce("two", "one"))
    runs = [_run(F.col("words"), F.col("place") + k, n) for n in short for k in range(STEP)]
    keys = _bands([F.col("one"), F.col("two")]) + [F.when(r[-1].isNotNull(), _short_key(r)).otherwise(F.lit(0)) for r in runs]
    return hashed.select("text_hash", "place", F.explode(F.array(*keys)).alias("key"))


def find_licenses(docs: DataFrame, templates: dict[str, str] = ALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, share, first_word): one row per document and template that it holds; first_word counts from 0."""
    spark = docs.sparkSession
    known = [r for r in template_table(spark, templates).collect() if r.parts]  # as many rows as there are templates
    if not known:
        return docs.limit(0).select(F.col(key).cast("long").alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("share"), F.lit(0).alias("first_word"))
    sizes = {r.license: r.parts[0].count(" ") + 1 for r in known}
    short = sorted({n for n in sizes.values() if n < SHINGLE})
    cut = spark.createDataFrame([(r.license, p.split(" "), max(1, int(ASKED * len(r.parts)))) for r in known for p in r.parts], "license string, words array<string>, asked int")
    whole = cut.where(F.size("words") == SHINGLE).select("license", "asked", F.explode(F.array(*_bands([F.xxhash64(*_run(F.col("words"), F.lit(0), SHINGLE))]))).alias("key"))
    index = [whole] + [cut.where(F.size("words") == n).select("license", "asked", _short_key(_run(F.col("words"), F.lit(0), n)).alias("key")) for n in short]
    # the index has at most BANDS rows for each word of the templates, whatever the corpus
    index = F.broadcast(reduce(DataFrame.unionByName, index).distinct())
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hits = probes(rows, short).join(index, "key").select("text_hash", "place", "license", "asked").distinct()
    retrieved = hits.groupBy("text_hash", "license", "asked").count().where("count >= asked")
    # written, so that the size of the join's small side is known before it is broadcast or shuffled
    retrieved = common.durable(retrieved.groupBy("text_hash").agg(F.collect_list("license").alias("licenses")), "licenses")
    found = rows.withColumn("text_hash", F.xxhash64("text")).join(retrieved, "text_hash").select("doc_id", words(F.col("text")).alias("words"), "licenses")
    found = common.durable(found, "licenses")  # the retrieved documents only; their words are not split anew for each shingle
    held = F.broadcast(spark.createDataFrame([(r.license, r.parts) for r in known], "license string, parts array<string>"))
    out = _containing(found, held)
    return out.unionByName(_holding(found, [(r.license, r.parts[0]) for r in known if sizes[r.license] < SHINGLE])) if short else out


def _containing(found: DataFrame, held: DataFrame) -> DataFrame:
    """The exact share of the retrieved templates' shingles."""
    own = found.select("doc_id", all_shingles(F.col("words")).alias("own"), "licenses").select("doc_id", "own", F.explode("licenses").alias("license"))
    shared = own.join(held, "license").withColumn("both", F.array_intersect("own", "parts"))  # in the order of ``own``
    shared = shared.withColumn("share", F.size("both") / F.size("parts")).where(F.col("share") >= SHARE)
    return shared.select("doc_id", "license", F.round("share", 6).alias("share"), (F.array_position("own", F.get("both", F.lit(0))) - 1).cast("int").alias("first_word"))


def _holding(found: DataFrame, notices: list[tuple[str, str]]) -> DataFrame:
    """The rows that hold a notice of under five words, as a run of whole words."""
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    at = [F.struct(F.lit(name).alias("license"), F.instr(F.col("line"), F.lit(f" {notice} ")).alias("at")) for name, notice in notices]
    hit = found.where(F.arrays_overlap("licenses", F.array(*[F.lit(n) for n, _ in notices]))).select("doc_id", line.alias("line"))
    hit = hit.select("doc_id", "line", F.explode(F.filter(F.array(*at), lambda x: x["at"] > 0)).alias("hit"))
    before = F.expr("substring(line, 1, hit.at)")  # a space before each word and before the notice
    first = F.length(before) - F.length(F.replace(before, F.lit(" "))) - 1
    return hit.select("doc_id", "hit.license", F.lit(1.0).alias("share"), first.cast("int").alias("first_word"))
