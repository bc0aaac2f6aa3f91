"""Secret scan: all rules in one byte pass of one minimised automaton.

``find_secrets`` returns, for every row, the spans found in its text;
``redact_secrets`` replaces them.  The automaton is compiled once on the driver
(its size depends on the rules only) and sent to the executors; texts are
scanned where they are read, without a shuffle.  A private key is found by its
BEGIN line; its span then goes on to its END line, or over the body that
follows where no END line comes before the next key.

Defined results: a null or empty text has no span; a row with null in other
columns is scanned like any other; repeated rows give repeated results; an
empty table gives an empty result; columns of the input named like the added
ones are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .automaton import Automaton, Rule, compile_rules, scan

_VALUE = "[A-Za-z0-9+/_.=-]"
#: Base rules, in the order in which their names are listed, then the rules that the method adds.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?" + _VALUE + "(?C)" + _VALUE + "{5,}", ignore_case=True),
    Rule("access", "AKIA[A-Z0-9](?C)[A-Z0-9]{15,}"),
    Rule("hex", "[0-9a-f](?C)[0-9a-f]{23,}"),
)
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9](?C)[A-Za-z0-9]*", least=40),
    Rule("private_key", r"-----BEGIN\x20([A-Z0-9]+\x20)?PRIVATE\x20KEY-----(?C)"),
)
RULES = BASE + ADDED
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9]+ )?PRIVATE KEY-----")
_END = re.compile(r"-----END ([A-Z0-9]+ )?PRIVATE KEY-----")
#: A key's body without its END line: header fields, whole base64 lines and a last one that is padded; line feeds may be escaped.
_GAP = r"(?:\s|\\[nr])*+"
_BODY = re.compile(rf"(?:{_GAP}(?:(?:Proc-Type|DEK-Info):[^\n]*|[A-Za-z0-9+/]{{16,}}=*))*+(?:{_GAP}[A-Za-z0-9+/]+=+)?")
LANES, BUFFER = 2048, 4 << 20


def scan_texts(automaton: Automaton, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """Per text its spans (start, rule, end), in code points, by start and then rule."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in data]
    for first, last in common.slices(data, BUFFER):
        begins, at = [], 0
        for t in data[first:last]:
            begins.append(at)
            at += len(t) + 1
        i = 0
        for rule, s, e in sorted(scan(automaton, b"\n".join(data[first:last]), LANES), key=lambda x: x[1]):
            while i + 1 < len(begins) and begins[i + 1] <= s:
                i += 1
            text, s, e = data[first + i], s - begins[i], e - begins[i]
            before = len(text[:s].decode("utf-8", "surrogatepass"))
            out[first + i].append((before, rule, before + e - s))  # rules match ASCII only
    key = next((k for k, r in enumerate(automaton.rules) if r.name == "private_key"), None)
    return [sorted(_whole_keys(t, x, key) if any(k == key for _, k, _ in x) else x) for t, x in zip(texts, out, strict=True)]


def _whole_keys(text: str, spans: list[tuple[int, int, int]], key: int) -> list[tuple[int, int, int]]:
    """The spans, those of rule ``key`` drawn out from the BEGIN line over the whole key."""
    begins = [m.start() for m in _BEGIN.finditer(text)]
    ends = [(m.start(), m.end()) for m in _END.finditer(text)]

    def end(e: int) -> int:
        i, j = bisect.bisect_left(ends, (e, e)), bisect.bisect_left(begins, e)
        if i < len(ends) and (j == len(begins) or ends[i][0] < begins[j]):
            return ends[i][1]
        return _BODY.match(text, e).end()

    return [(s, k, end(e) if k == key else e) for s, k, e in spans]


def _joined(rules, spans) -> str:
    return ",".join(f"{rules[k].name}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``secret_spans``: array of (kind, start, end) in code points, end exclusive, by start, then rule."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(compile_rules(tuple(rules)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    docs = docs.drop("secret_spans")
    schema = StructType([*docs.schema.fields]).add("secret_spans", "array<struct<kind:string,start:bigint,end:bigint>>")

    def run(batches):
        names = [r.name for r in rules]
        for b in batches:
            spans = scan_texts(held.value, b.column(text).to_pylist())
            rows = [[{"kind": names[k], "start": s, "end": e} for s, k, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*b.schema.names, "secret_spans"])

    return docs.mapInArrow(run, schema)


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by base kind, the digest of its base spans, and all spans as text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(compile_rules(RULES))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            spans = scan_texts(held.value, b.column("text").to_pylist())
            base = [[x for x in row if x[1] < len(BASE)] for row in spans]
            count = [[sum(x[1] == k for x in row) for row in base] for k in range(len(BASE))]
            digest = [hashlib.sha256(_joined(RULES, row).encode()).hexdigest() for row in base]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in count), pa.array(digest), pa.array([_joined(RULES, row) for row in spans], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span by ``[kind]``, overlapping spans by one mark; a null text stays null, other columns stay."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(compile_rules(RULES))

    def cleaned(value, spans):
        parts, at = [], 0
        for s, k, e in spans:
            if s >= at:
                parts += [value[at:s], f"[{RULES[k].name}]"]
            at = max(at, e)
        return "".join(parts) + value[at:]

    def run(batches):
        for b in batches:
            values = b.column(text).to_pylist()
            new = [cleaned(v, s) if s else v for v, s in zip(values, scan_texts(held.value, values), strict=True)]
            yield b.set_column(b.schema.get_field_index(text), b.schema.field(text), pa.array(new, b.schema.field(text).type))

    return docs.mapInArrow(run, docs.schema)
