"""The Merkle manifest against a plain tree in memory."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ragloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, total int, g string, rank int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes, fanout):
    """(root, siblings of each node level by level as (left, right))"""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, at in enumerate(where):
            run, place = runs[at // fanout], at % fanout
            paths[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
            where[k] = at // fanout
        nodes = [digest(*r) for r in runs]
    return nodes[0], paths


def brute(rows, fanout=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    solved = [tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in names]
    root, above = tree([s[0] for s in solved], fanout)
    out = []
    for s, (subroot, paths), up in zip(names, solved, above, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), paths, strict=True):
            low = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            fold = leaf_of(r, low) if hit else leaf
            for left, right in path + up:
                fold = digest(left, fold, right)
            out.append((r["doc_id"], leaf, subroot, root, digest(*(a + b for a, b in path + up)), fold, fold == root))
    return Counter(out)


def rows_of(n, seed, sources, ids=lambda rng, i: i):
    rng = random.Random(seed)
    return [{"doc_id": ids(rng, i), "text": rng.choice([None, "", "lower", "Upper é", "X" * rng.randint(1, 50)]), "lang": rng.choice([None, "en"]), "source": rng.choice(sources), "n_chars": rng.choice([None, i]), "h": "x", "total": 3, "g": "g", "rank": 1} for i in range(n)]


@pytest.mark.parametrize(("fanout", "bin_"), [(16, 1024), (16, 8), (3, 2)])
def test_manifest_equals_a_plain_tree(spark, fanout, bin_):
    rows = rows_of(700, 1, ["a"] * 5 + ["b", "ab", None, "", "é"], lambda rng, i: rng.choice([None, i * 7919 - 1_000_000, i, 5, 5]))
    rows += [rows[3]] * 40 + rows_of(1, 2, ["only one"])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(6), fanout, bin_, hit).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, fanout)
    assert {r.verified for r in got} == {True, False}


def test_audit_of_small_tables(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    for rows in (rows_of(1, 4, ["a"]), rows_of(1, 4, [None], lambda *_: None), rows_of(2, 5, ["a"]), rows_of(40, 6, [f"s{k}" for k in range(35)])):
        assert Counter(tuple(r) for r in merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_equal_rows_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 16)
    rows = rows_of(30, 7, ["a", "b"]) + [rows_of(1, 8, ["a"])[0]] * 100
    assert Counter(tuple(r) for r in merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_ranks_are_places_in_the_sorted_order(spark):
    rng = random.Random(9)
    keys = [("g%d" % (i % 3 if i % 2 else 0), "%x" % rng.getrandbits(rng.choice([8, 20, 64])), rng.randint(1, 3)) for i in range(500)]
    keys = list({(g, k): (g, "1" + k.rjust(len(k) + len(k) % 2, "0"), n) for g, k, n in keys}.values())
    keys = list({(g, k): (g, k, n) for g, k, n in keys}.values())
    for bin_ in (1, 10, 1000):
        got = {(r.g, r.key): (r["rank"], r.total) for r in merkle.radix_ranks(spark.createDataFrame(keys, "g string, key string, n long"), bin_).collect()}
        for g in ("g0", "g1", "g2"):
            before, own = 0, sorted(x for x in keys if x[0] == g)
            for _, k, n in own:
                assert got[g, k] == (before, sum(x[2] for x in own))
                before += n
