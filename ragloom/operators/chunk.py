"""Structure-aware chunks: one row per document in, one per chunk out.

A greedy loop over byte offsets, so it runs on Arrow batches; documents are
independent, and rows stay in the partition that read them.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WORD, SENTENCE, PARAGRAPH, HEADING = 1, 2, 3, 4
SENTENCE_ENDS = (b". ", b".\n", b"? ", b"! ")


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int = 1500
    min_chars: int = 100
    overlap_chars: int = 200
    prefer_headings: bool = True

    def validate(self) -> ChunkConfig:
        if self.min_chars > self.max_chars:
            raise ValueError("min_chars must not exceed max_chars")
        if self.overlap_chars * 5 >= self.max_chars * 4:  # chunks would stop moving on
            raise ValueError("overlap_chars must stay under 0.8 of max_chars")
        return self


def breadcrumb(headings: list[tuple[int, str, int]], position: int) -> list[str]:
    """Texts of the headings that a position lies under; headings are (level, text, position) in order."""
    held: list[tuple[int, str]] = []
    for level, title, at in headings:
        if at <= position:
            held = [h for h in held if h[0] < level] + [(level, title)]
    return [t for _, t in held]


def break_points(data: bytes, headings: list[tuple[int, str, int]], prefer: bool = True) -> dict[int, int]:
    """Position -> priority; at equal places the stronger stays."""
    found: dict[int, int] = {}
    if prefer:
        for _, _, at in headings:
            found.setdefault(at, HEADING)
    for mark, priority in ((b"\n\n", PARAGRAPH), *((e, SENTENCE) for e in SENTENCE_ENDS)):
        at = data.find(mark)
        while at >= 0:
            found.setdefault(at + 2, priority)
            at = data.find(mark, at + 1)
    return found


def find_code_blocks(text: str) -> list[tuple[int, int]]:
    """(begin, end) in bytes of the fenced blocks, fences included; one that is not closed does not count."""
    found, begin, at = [], None, 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if line.strip().startswith((b"```", b"~~~")):
            if begin is None:
                begin = at
            else:
                found.append((begin, at + len(line) + 1))
                begin = None
        at += len(line) + 1
    return found


def in_code_block(position: int, blocks: list[tuple[int, int]]) -> bool:
    return any(begin <= position < end for begin, end in blocks)


def floor_boundary(data: bytes, at: int) -> int:
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunk_text(value: str, headings: list[tuple[int, str, int]] = (), config: ChunkConfig = ChunkConfig()) -> list[tuple[int, int, int, str, list[str]]]:
    """(index, start, end, text, heading texts); offsets are bytes."""
    data = value.encode("utf-8", "surrogatepass")
    points = sorted(break_points(data, list(headings), config.prefer_headings).items())
    size, out, start, first = len(data), [], 0, 0
    while start < size:
        target = start + config.max_chars
        if target >= size:
            end = size
        else:
            low, high = start + config.max_chars * 4 // 5, min(start + config.max_chars * 6 // 5, size)
            while first < len(points) and points[first][0] < low:
                first += 1
            best, i = (0, -1), first
            while i < len(points) and points[i][0] <= high:
                best = max(best, (points[i][1], points[i][0]))
                i += 1
            end = best[1]
            if end < 0:
                space = data.rfind(b" ", max(0, target - 50), min(size, target + 50))
                end = space + 1 if space >= 0 and low <= space + 1 <= high else floor_boundary(data, target)
        end = max(end, floor_boundary(data, start + 1), start + 1) if end <= start else end
        piece = data[start:end].decode("utf-8", "replace").strip()
        if len(piece.encode("utf-8", "surrogatepass")) < config.min_chars and end < size:
            start = end
            continue
        out.append((len(out), start, end, piece, breadcrumb(headings, start)))
        if end >= size:
            break
        back = floor_boundary(data, end - config.overlap_chars) if end > config.overlap_chars else end
        start = back if back > start else end
        first = 0 if not points else max(0, first - 64)
        while first and points[first - 1][0] >= start:
            first -= 1
    return out


CHUNKS = "chunk_index int, char_start int, char_end int, chunk_text string, headings array<string>"


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", headings: str | None = None, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """doc_id, doc_hash, chunk columns, chunk_hash and point_id.  ``headings``: array<struct<level,text,position>>.

    A null or empty text has no chunk.
    """
    config.validate()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(headings) if headings else F.lit(None).cast("array<struct<level:int,text:string,position:int>>")).alias("headings"))
    rows = rows.withColumn("doc_hash", T.content_hash(F.col("text")))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            out = []
            for i, (value, heads) in enumerate(zip(b.column("text").to_pylist(), b.column("headings").to_pylist(), strict=True)):
                known = [(h["level"], h["text"], h["position"]) for h in heads or []]
                out += [(i, *c) for c in chunk_text(value, known, config)]
            place, index, start, end, piece, crumbs = zip(*out, strict=True) if out else ([],) * 6
            at = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), b.column("doc_hash").take(at), pa.array(index, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(piece, pa.string()), pa.array(crumbs, pa.list_(pa.string()))],
                ["doc_id", "doc_hash", "chunk_index", "char_start", "char_end", "chunk_text", "headings"],
            )

    found = rows.mapInArrow(run, f"doc_id {kind}, doc_hash string, {CHUNKS}")
    return found.withColumn("chunk_hash", T.chunk_hash(F.col("doc_hash"), F.col("chunk_text"))).withColumn("point_id", T.point_id(F.col("chunk_hash")))
