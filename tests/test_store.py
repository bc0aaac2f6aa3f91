"""Writers beside each other, and vectors indexed beside newer ones."""

import pytest
from pyspark.sql import functions as F

from ragloom.commands import Index
from ragloom.errors import ConflictError
from ragloom.sources import store as st
from ragloom.sources.store import Store


def sources_of(spark, *ids):
    return spark.createDataFrame([(i, "dir", f"/{i}", i, None, None, None) for i in ids], st.TABLES["sources"])


def names(store):
    return sorted(r.id for r in store.table("sources").collect())


def test_a_source_added_between_read_and_publish_stays(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    a, b = Store(spark, root), Store(spark, root)
    staged = a.stage

    def between(name, df, *more, **options):
        out = staged(name, df, *more, **options)
        a.stage = staged
        b.upsert(sources=sources_of(spark, "of-b"))  # after a has read and written, before it publishes
        return out

    a.stage = between
    a.upsert(sources=sources_of(spark, "of-a"))
    assert names(a) == names(b) == ["of-a", "of-b"]


def test_appends_and_other_parts_of_two_writers_both_stay(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    a, b = Store(spark, root), Store(spark, root)
    rows = lambda source, *ids: spark.createDataFrame([(i, source, f"/{i}", None, "h", "t", None, None) for i in ids], st.TABLES["documents"])
    for store, source, at in ((a, "s", "1"), (b, "s", "2"), (a, "t", "3"), (b, "u", "4")):
        store.stage("documents", rows(source, at), source, append=True)
    a.publish()
    b.publish()
    assert sorted(r.id for r in a.table("documents").collect()) == ["1", "2", "3", "4"]
    # both replace one part: the later one is told
    a.stage("documents", a.table("documents", "s").where("id = '1'"), "s")
    b.stage("documents", b.table("documents", "s").where("id = '2'"), "s")
    b.publish()
    with pytest.raises(ConflictError):
        a.publish()
    a.unstage()
    assert sorted(r.id for r in a.table("documents", "s").collect()) == ["2"]


def test_a_manifest_is_never_replaced(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/i")
    number = store._numbers()[0]
    assert store._write_manifest({"dim": 1, "tables": {}}, number) is False and store._write_manifest({"dim": 5, "tables": {}}, number + 1) is True
    assert store.manifest()["dim"] == 5 and not [f for f in (tmp_path / "i").iterdir() if f.name.startswith(".manifest") and "crc" not in f.name]


def test_search_over_indexed_and_newer_vectors_equals_a_scan(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    for i in range(12):
        (root / f"{i}.txt").write_text(f"Text number {i} about topic {i % 3}. " * 8)
    index = Index(Store(spark, f"file://{tmp_path}/i"))
    index.ingest_dir(str(root))
    ask = lambda: [(r.id, round(r.score, 9)) for r in index.query("topic", k=8, min_score=-1.0).collect()]
    before = ask()
    assert index.optimize(parts=3) == 12 and ask() == before
    (root / "new.txt").write_text("A new text about topic. " * 8)
    index.ingest_dir(str(root))  # appended: scanned beside the index
    mixed = ask()
    (root / "3.txt").write_text("Changed text. " * 12)
    index.ingest_dir(str(root))  # the part is written anew: nothing that is indexed is current
    changed = ask()
    index.optimize()
    assert ask() == changed and set(mixed) != set(before)
    assert len(changed) == 8 and index.query("topic", k=3, path_prefix=f"{root}/5").count() == 1
    index.store.vacuum()
    assert ask() == changed
    rows = index.store.table("points").select(F.max("norm")).first()
    assert rows is not None


def scanned(df):
    """Rows that the scan of a look-up gave to Spark."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.length()) if leaves.apply(i).metrics().contains("numOutputRows"))


def test_a_look_up_skips_what_lacks_its_key(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/i")
    empty = spark.createDataFrame([], st.TABLES["chunks"])
    for part in range(6):  # folders of one source, as appends make them
        rows = spark.range(part * 1000, part * 1000 + 1000).select(F.sha2(F.col("id").cast("string"), 256).alias("point_id"), F.concat(F.lit("d"), F.floor(F.col("id") / 10)).alias("doc_id"), (F.col("id") % 10).cast("int").alias("chunk_index"))
        filled = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])
        store.stage("chunks", filled.coalesce(1), "s", append=True)
    store.publish()
    key = store.table("chunks").orderBy("point_id").first().point_id
    hit = store.table("chunks").where(F.col("point_id") == key)
    assert hit.count() == 1 and scanned(hit) == 1000  # one folder of six
    assert scanned(store.table("chunks").where("point_id = 'none'")) == 0
    assert scanned(store.table("chunks").where("doc_id = 'd7'")) <= 1000


def test_a_change_writes_the_buckets_of_its_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "BUCKET", 10)
    index = Index(Store(spark, f"file://{tmp_path}/i"))
    seen = lambda changed, most=200: spark.range(most).select(F.concat(F.lit("/d/"), "id").alias("uri"), F.concat(F.lit("Text of document "), "id", F.when(F.col("id").isin(changed), " anew ").otherwise(" "), F.lit("word " * 30)).alias("text")).withColumn("content_hash", F.sha2("text", 256)).withColumn("content_type", F.lit("unknown"))
    folders = lambda: {n: set(index.store.parts(n)[source]["at"]) for n in st.BUCKETED}
    source = index.ingest("dir", "/d", seen([])).source_id
    assert index.store.buckets(source) == 32 and all(len(f) == 32 for f in folders().values())
    first, mean, ids = folders(), index.store.mean_length(), {r.uri: r.id for r in index.store.table("documents").collect()}
    got = index.ingest("dir", "/d", seen([7]))
    now = folders()
    assert (got.docs_changed, got.docs_deleted) == (1, 0) and all(len(now[n] - first[n]) == len(first[n] - now[n]) == 1 for n in now)
    index.ingest("dir", "/d", seen([7], 199))  # one goes
    assert all(len(folders()[n] - now[n]) <= 1 for n in now)
    assert {r.uri: r.id for r in index.store.table("documents").collect()} == {u: i for u, i in ids.items() if u != "/d/199"}
    chunks = index.store.table("chunks")
    assert chunks.count() == 199 == index.store.table("points").count() and chunks.where("chunk_text like '% anew %'").count() == 1
    assert index.store.mean_length() == pytest.approx(chunks.agg(F.avg(F.octet_length("chunk_text"))).first()[0]) and mean > 1
    index.ingest("dir", "/d", seen([7], 230))  # appended: more folders of the buckets
    assert index.store.table("documents").count() == 230 and index.store.buckets(source) == 32
    before = [(r.id, r.score) for r in index.query("document 7 anew", k=5, min_score=-1.0).collect()]
    index.optimize(parts=4)
    assert index.store.vacuum() > 0 and [(r.id, pytest.approx(r.score)) for r in index.query("document 7 anew", k=5, min_score=-1.0).collect()] == before
    assert index.reindex() == 230 and index.store.table("points").count() == 230


def test_prune_takes_as_many_jobs_for_many_sources(spark, tmp_path):
    def jobs(index, **how):
        spark.sparkContext.setJobGroup(group := f"prune-{len(taken)}", "")
        counts = index.prune(**how)
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), counts

    taken, index = [], Index(Store(spark, f"file://{tmp_path}/i"))
    for i in range(5):
        (tmp_path / f"s{i}").mkdir()
        for k in range(2):
            (tmp_path / f"s{i}/{k}.txt").write_text(f"Text {k} of source {i}. " * 10)
        index.ingest_dir(str(tmp_path / f"s{i}"))
        if i in (1, 4):
            taken.append(jobs(index, orphans=True))
    assert taken[0][0] == taken[1][0] and taken[0][1] == taken[1][1] == {"documents": 0, "points": 0}
    (tmp_path / "s2/0.txt").unlink()
    before = {s: p["at"] for s, p in index.store.parts("documents").items()}
    assert index.prune(dry_run=True) == index.prune() == {"documents": 1, "points": 1}
    assert sum(index.store.parts("documents")[s]["at"] != at for s, at in before.items()) == 1
    assert [index.store.table(n).count() for n in st.BUCKETED] == [9, 9, 9]
