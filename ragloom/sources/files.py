"""Files of a folder tree as rows: ignored and unreadable ones left out, bytes decoded, content hashed.

A tree is listed level by level: the folders of a level are dealt over tasks,
each of which reads its folders' names and ignore rules, and their subfolders
are the next level.  Contents are opened by tasks as well.  So the driver meets
neither names nor contents; folders must be mounted where tasks run.
"""

from __future__ import annotations

import fnmatch
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: A folder's own ignore files, those named later decide over those before; the last only counts at the root.
RULES = (".git/info/exclude", ".gitignore")
_FOUND = "path string, is_dir boolean, rules array<struct<base:string,line:string>>"


def rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(expression over the path below the rule's folder, whether it brings back, whether it is for folders only), or None for no rule.

    As git has it: ``*`` and ``?`` stop at a slash, ``**`` does not where it is a
    whole part, a slash in front or within ties the rule to its folder, one at
    the end asks for a folder, and a backslash takes a sign as it is.
    """
    line = re.sub(r"(?<!\\)((?:\\\\)*) +$", r"\1", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    folders, line = line.endswith("/"), line.removesuffix("/")
    if not line:
        return None
    tied, line = "/" in line, line.removeprefix("/")
    out, i = "" if tied else "(?:.*/)?", 0
    while i < len(line):
        rest = line[i:]
        if (i == 0 or line[i - 1] == "/") and re.match(r"\*\*(?:/|$)", rest):
            out += "(?:.*/)?" if rest[2:] else ".+"
            i += 3
        elif m := re.match(r"\*+", rest):
            out += "[^/]*"
            i += m.end()
        elif rest[0] == "?":
            out += "[^/]"
            i += 1
        elif m := re.match(r"\[([!^]?)(\]?(?:\\.|\[:\w+:\]|[^\]\\])*)\]", rest):
            named = {"[:alpha:]": "a-zA-Z", "[:digit:]": "0-9", "[:alnum:]": "a-zA-Z0-9", "[:upper:]": "A-Z", "[:lower:]": "a-z", "[:space:]": r"\s", "[:punct:]": r"!-/:-@\[-`{-~"}
            inner = re.sub(r"\[:\w+:\]|\\.|[\[\]&~|]", lambda x: named.get(x[0]) or (x[0] if x[0][0] == "\\" else "\\" + x[0]), m[2])
            out += f"(?!/)[{'^' if m[1] else ''}{inner}]"
            i += m.end()
        elif rest[0] == "\\" and len(rest) > 1:
            out += re.escape(rest[1])
            i += 2
        else:
            out += re.escape(rest[0])
            i += 1
    try:
        return re.compile(out, re.S), back, folders
    except re.error:  # a range that runs backwards matches nothing
        return None


def ignored(path: str, is_dir: bool, rules: list[tuple[str, tuple[re.Pattern, bool, bool]]]) -> bool:
    """Whether compiled rules, (folder, rule) from the root down, leave a path out; the last that matches decides."""
    out = False
    for base, (expression, back, folders) in rules:
        base = base.rstrip("/") + "/"
        if path.startswith(base) and (is_dir or not folders) and expression.fullmatch(path[len(base) :]):
            out = not back
    return out


def _level(batches, roots: set[str]):
    """The entries of folders that no rule leaves out: files, and folders with the rules that hold in them."""
    for b in batches:
        for folder, held in zip(b.column("path").to_pylist(), b.column("rules").to_pylist(), strict=True):
            own = [(r["base"], r["line"]) for r in held]
            for name in RULES if folder in roots else RULES[1:]:
                try:
                    with open(os.path.join(folder, name), encoding="utf-8", errors="surrogateescape") as f:
                        own += [(folder, line.rstrip("\n")) for line in f if rule(line)]
                except OSError:
                    continue
            compiled = [(base, rule(line)) for base, line in own]
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:  # not to be read, or gone
                continue
            found = []
            for e in entries:
                try:
                    is_dir, is_file = e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)
                except OSError:
                    continue
                if (is_file or is_dir and e.name != ".git") and _is_text(e.path) and not ignored(e.path, is_dir, compiled):
                    found.append((e.path, is_dir))
            rules = [{"base": base, "line": line} for base, line in own]
            kind = pa.list_(pa.struct([("base", pa.string()), ("line", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([d for _, d in found], pa.bool_()), pa.array([rules if d else None for _, d in found], kind)], ["path", "is_dir", "rules"])


def _is_text(path: str) -> bool:
    """Whether a name can be kept as text; others cannot be an address."""
    try:
        path.encode()
        return True
    except UnicodeEncodeError:
        return False


def list_files(spark: SparkSession, root: str | list[str], at: str, endings: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(uri) of the regular files under a folder or several, dot files too, written below ``at``, which the caller deletes.

    ``exclude`` has patterns of paths below the folder, of which there is one then.
    """
    roots, levels = sorted({os.path.realpath(r) for r in ([root] if isinstance(root, str) else root)}), []
    tasks = _tasks(spark)
    front = spark.createDataFrame([(r, True, []) for r in roots], _FOUND)
    while True:
        levels.append(f"{at.rstrip('/')}/level-{len(levels)}")
        front.repartition(tasks).mapInArrow(lambda b: _level(b, set(roots)), _FOUND).write.parquet(levels[-1])
        front = spark.read.schema(front.schema).parquet(levels[-1]).where("is_dir")
        if front.isEmpty():
            break
    found = spark.read.schema(front.schema).parquet(*levels).where("not is_dir").select(F.col("path").alias("uri"))
    if endings:
        found = found.where(F.element_at(F.split("uri", r"\."), -1).isin(list(endings)))
    for pattern in exclude:
        found = found.where(~F.substring("uri", len(roots[0].rstrip("/")) + 2, 1 << 30).rlike(fnmatch.translate(pattern).replace(r"\z", r"\Z").replace("(?>", "(?:")))
    return found


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _opened(batches):
    """The bytes of files, one a batch; what cannot be read is left out."""
    for b in batches:
        for path in b.column("uri").to_pylist():
            try:
                with open(path, "rb") as f:
                    data = f.read()
            except OSError:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([data], pa.binary())], ["uri", "content"])


def read_files(listed: DataFrame) -> DataFrame:
    """uri, text, content_hash, content_type of ``listed`` (uri); binary files and skipped endings go.

    Paths are opened as they are: no sign in a name is a pattern.
    """
    rows = listed.where(~T.should_skip(F.col("uri"))).repartition(_tasks(listed.sparkSession)).mapInArrow(_opened, "uri string, content binary")
    rows = rows.where(~T.is_binary(F.col("content")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("uri", text.alias("text")).withColumn("content_hash", T.content_hash(F.col("text"))).withColumn("content_type", T.type_by_ending(F.col("uri")))
