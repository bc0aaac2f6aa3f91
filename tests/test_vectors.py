"""Indexed, quantised and batched search against a scan."""

import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ragloom import catalog
from ragloom.functions import vec as V
from ragloom.plans import search as S
from ragloom.plans import vectors as X


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    out = [(f"p{i:04d}", (centres[i % 30] + 0.3 * rng.standard_normal(16)).tolist(), f"s{i % 3}") for i in range(1500)]
    out += [(f"copy{i:03d}", out[7][1], "s0") for i in range(40)]  # ties
    return out + [("zero", [0.0] * 16, "s0"), ("null", None, "s0"), ("nan", [float("nan")] * 16, "s0"), ("short", [1.0], "s0"), ("hole", [None] + [1.0] * 15, "s0")]


SCHEMA = "id string, vector array<double>, source_id string"


def scan(rows, query, k, source=None):
    q = np.array(query) / np.linalg.norm(query)
    fine = [r for r in rows if r[1] and len(r[1]) == 16 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) and source in (None, r[2])]
    score = [round(float(np.array(r[1]) @ q / np.linalg.norm(r[1])), 10) for r in fine]
    return sorted(((-s, r[0]) for s, r in zip(score, fine, strict=True)))[:k]


def test_index_equals_a_scan(spark, tmp_path, rows):
    points = spark.createDataFrame(rows, SCHEMA).repartition(5)
    index = X.VectorIndex.build(points, f"file://{tmp_path}/i", parts=25, filters=("source_id",))
    rng, shares = np.random.default_rng(5), []
    for n in range(12):
        q = rng.standard_normal(16).tolist() if n % 4 == 0 else rows[n * 31][1]
        k, source = (1, 10, 5000)[n // 4], "s1" if n % 5 == 4 else None
        got = index.top_k(q, k, None if source is None else F.col("source_id") == source).collect()
        want = scan(rows, q, k, source)
        assert [r.id for r in got] == [i for _, i in want] and [r.score for r in got] == pytest.approx([-s for s, _ in want], abs=1e-9)
        shares.append((k, index.read["codes"] / index.read["rows"], index.read["vectors"] / index.read["rows"]))
    print(shares)
    near = [s for k, *s in shares if k <= 10]
    assert np.mean([s[0] for s in near]) < 0.7 and np.mean([s[1] for s in near]) < 0.25
    assert X.VectorIndex(spark, f"file://{tmp_path}/i").top_k(rows[3][1], 3).columns == ["id", "vector", "source_id", "score"]
    assert index.top_k([0.0] * 16, 3).collect() == [] and index.top_k([1.0], 3).collect() == [] and index.top_k(rows[0][1], 3, F.col("source_id") == "none").collect() == []


def test_index_of_nothing(spark, tmp_path):
    index = X.VectorIndex.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/i")
    assert index.top_k([1.0], 3).collect() == []


def test_codes_bound_the_cosine():
    rng = np.random.default_rng(1)
    u, q = X.directions(rng.standard_normal((500, 48)) ** 3), X.directions(rng.standard_normal((20, 48)))
    codes, step, error = X.quantise(u)
    near, true = (codes * step[:, None]) @ q.T, u @ q.T
    assert (np.abs(near - true) <= error[:, None]).all() and error.max() < 0.05


def test_batch_equals_scans(spark, rows):
    points = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = spark.createDataFrame([(r[0], r[1]) for r in rows if r[2] == "s0"][:300] + [("short q", [2.0]), ("null", None)], "query_id string, vector array<double>")
    vectors = {r.query_id: r.vector for r in asked.collect()}
    for k, block in ((3, 1024), (50, 70)):
        got = {}
        for r in X.batch_top_k(asked, points, k, block).collect():
            got.setdefault(r.query_id, []).append((-r.score, r.id))
        assert "null" not in got and [i for _, i in got.pop("short q")] == ["short"]
        assert len(got) == len([v for v in vectors.values() if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)])
        for q, hits in got.items():
            want = scan(rows, vectors[q], k)
            assert [i for _, i in sorted(hits)] == [i for _, i in want] and [s for s, _ in sorted(hits)] == pytest.approx([s for s, _ in want], abs=1e-9)


def test_indexed_search_path_equals_top_k(spark, tmp_path, rows):
    points = spark.createDataFrame([r for r in rows if r[1] and len(r[1]) == 16 and None not in r[1]], SCHEMA)
    index = X.VectorIndex.build(points, f"file://{tmp_path}/i", parts=9)
    q = rows[11][1]
    assert [r.id for r in index.top_k(q, 20).collect()] == [r.id for r in S.top_k(points.where("id not in ('zero', 'nan')"), q, 20).collect()]


def test_rounding_keeps_the_sign_of_zero(spark):
    want = [(-1e-8, -0.0), (1e-8, 0.0), (-0.0, -0.0), (0.0, 0.0), (1.0000005, 1.000001), (-1.5e-6, -2e-6), (2.5e-6, 3e-6), (-0.1234564, -0.123456), (0.7, 0.7), (float("nan"), float("nan")), (None, None)]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, (x, _) in enumerate(want)], "i int, x double").select("i", V.rounded(F.col("x")).alias("y")).orderBy("i").collect()]
    assert list(map(repr, got)) == [repr(y) for _, y in want]


@pytest.mark.parametrize("name", ["normalize_vectors", "fuse_vectors"])
def test_units_equal_their_sql_in_every_bit(spark, tmp_path, name):
    """repr tells -0.0 from 0.0, which == does not."""
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((40, 16)).astype(np.float32)
    vectors[::2, 3], vectors[1::2, 3] = -1e-7, 1e-9
    table = pa.table({"vec_id": pa.array(range(40)), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())), "label": pa.array([1] * 40, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    plain = lambda rows: sorted(repr((r[0], list(r[1]))) for r in rows)
    want = plain(duck.sql(catalog.ORACLE_SQL[name]).fetchall())
    assert plain(catalog.QUERIES[name](spark, str(tmp_path)).collect()) == want and "-0.0," in "".join(want)


def test_a_block_takes_no_more_memory_than_its_tiles():
    """1,024 queries against full Arrow batches, one and three of them; rows come by rising cosine, the worst order."""
    rng = np.random.default_rng(6)
    q, vectors = X.directions(rng.standard_normal((1024, 64))), rng.standard_normal((30000, 64)).astype(np.float32)
    vectors = vectors[np.argsort(X.directions(vectors.astype(float)) @ q[0])]
    batches = [pa.record_batch({"id": pa.array(range(n, n + 10000)), "vector": pa.array(list(vectors[n : n + 10000]), pa.list_(pa.float32()))}) for n in range(0, 30000, 10000)]
    held = SimpleNamespace(value=(pa.array(range(1024)), q))
    peaks = []
    for some in (batches[:1], batches):
        tracemalloc.start()
        (found,) = X._block_best(iter(some), held, 10)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert max(peaks) < 48 and found.num_rows == 10240
    want = np.argsort(-(q[:20] @ X.directions(vectors.astype(float)).T), axis=1)[:, :10]
    assert [sorted(found["id"].to_numpy()[found["query_id"].to_numpy() == n]) for n in range(20)] == [sorted(w) for w in want]
    print(peaks)
