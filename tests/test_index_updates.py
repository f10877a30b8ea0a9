"""Changes of a stored index that meet: re-inserts, deletes during a merge, writers at once, folds, batches of a stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakevec.operators import graph, layout, update
from lakevec.sources import index, log

P = graph.GraphParams(degree=12, candidates=40)


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(8).standard_normal((200, 8))


@pytest.fixture(scope="module")
def base(spark, points):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, vec array<double>").cache()


@pytest.fixture(scope="module")
def template(spark, base, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("template") / "index")
    index.build_index(base, path, chunks=4, codes=16, params=P, tags=base.select("id", (F.col("id") + 7000).alias("tag")))
    return index.open_index(spark, path)


@pytest.fixture()
def path(spark, template, tmp_path):
    x, at = template, str(tmp_path / "index")
    index.save(at, x.vectors, x.topology, x.entries, x.tags, None, x.codes, x.book, x.layout, x.metric, x.chunks, x.n_codes)
    return at


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def nearest(x, base, q, k=3):
    asked = base.where(F.col("id") == q).selectExpr("id AS qid", "vec AS qvec")
    return [r["id"] for r in x.search(asked, k, mode="beam", length=300, width=300).orderBy("rank").collect()]


def test_an_id_that_comes_again_is_found_and_stays(spark, base, points, path):
    index.delete(path, ids(spark, 5))
    assert 5 not in nearest(index.open_index(spark, path), base, 5)
    index.insert(path, base.where("id = 5"), params=P)
    x = index.open_index(spark, path)
    assert nearest(x, base, 5)[0] == 5 and x.tombstones.count() == 0
    index.repair(path, spark, P)
    index.merge(path, spark, P)
    x = index.open_index(spark, path)
    assert x.vectors.count() == 200 and x.by_tag(spark.createDataFrame([(5,)], "tag long")).count() == 0  # 5 kept its tag
    (row,) = x.by_tag(spark.createDataFrame([(7005,)], "tag long")).collect()
    assert np.allclose(row["vec"], points[5])


def test_an_id_gets_another_vector(spark, base, points, path):
    moved = spark.createDataFrame([(9, (points[20] + 1e-3).tolist())], "id long, vec array<double>")
    index.insert(path, moved, params=P)
    x = index.open_index(spark, path)
    assert nearest(x, base, 20, 2) == [20, 9] and 9 not in nearest(x, base, 9, 1)
    assert x.vectors.count() == x.codes.count() == x.topology.count() == x.layout.count() == 200


def meanwhile(monkeypatch, module, name, act):
    """act() runs once, before the first call of the function."""
    real, calls = getattr(module, name), []

    def slow(*a, **k):
        if not calls:
            calls.append(1)
            act()
        return real(*a, **k)

    monkeypatch.setattr(module, name, slow)
    return calls


def test_deletes_during_a_merge_stay(spark, base, path, monkeypatch):
    index.delete(path, ids(spark, 3, 4))
    before = index.open_epoch(spark, path)
    meanwhile(monkeypatch, update, "merged", lambda: index.delete(path, ids(spark, 17)))
    index.merge(path, spark, P)
    x = index.open_index(spark, path)
    (dead,) = x.tombstones.collect()
    assert dead["epoch"] == before + 1 and x.vectors.count() == 198
    assert x.tags.where(F.col("id") == dead["id"]).first()["tag"] == 7017


def test_inserts_during_a_merge_stay(spark, base, path, monkeypatch):
    index.delete(path, ids(spark, 3, 4))
    far = spark.createDataFrame([(900, [9.0] * 8)], "id long, vec array<double>")
    meanwhile(monkeypatch, update, "merged", lambda: index.insert(path, far, params=P))
    index.merge(path, spark, P)
    x = index.open_index(spark, path)
    assert x.vectors.count() == 199 and x.vectors.where("vec[0] = 9").count() == 1 and x.vectors.agg(F.max("id")).first()[0] == 198


def test_two_writers_lose_nothing(spark, base, path, monkeypatch):
    calls = meanwhile(monkeypatch, index, "_write_changes", lambda: index.delete(path, ids(spark, 31)))
    index.delete(path, ids(spark, 30))
    assert calls and {r["id"] for r in index.open_index(spark, path).tombstones.collect()} == {30, 31}
    assert index.versions(spark, path) == [1, 2, 3]


def test_writers_of_the_same_lists_go_one_after_the_other(spark, base, points, path, monkeypatch):
    one = spark.createDataFrame([(500, points[0].tolist())], "id long, vec array<double>")
    two = spark.createDataFrame([(501, points[0].tolist())], "id long, vec array<double>")
    meanwhile(monkeypatch, layout, "changed_by", lambda: index.insert(path, two, params=P))
    index.insert(path, one, params=P)
    x = index.open_index(spark, path)
    assert x.topology.count() == x.layout.count() == 202 and x.layout.groupBy("page", "slot").count().where("count > 1").count() == 0
    named = {r["n"] for r in x.topology.select(F.explode("nbrs").alias("n")).where("n >= 500").distinct().collect()}
    assert named == {500, 501} and set(nearest(x, base, 0)) == {0, 500, 501}


def test_an_insert_across_a_merge_is_refused(spark, base, points, path, monkeypatch):
    index.delete(path, ids(spark, 0))
    meanwhile(monkeypatch, layout, "changed_by", lambda: index.merge(path, spark, P))
    with pytest.raises(index.Conflict):
        index.insert(path, spark.createDataFrame([(500, points[0].tolist())], "id long, vec array<double>"), params=P)


def test_failed_deletes_are_told(spark, path):
    _, failed = index.delete(path, ids(spark, 1, 1, 2, 9999))
    assert [r["id"] for r in failed.collect()] == [9999]
    version, failed = index.delete(path, ids(spark, 1, 2))
    assert {r["id"] for r in failed.collect()} == {1, 2} and version == 2


def test_many_changes_are_folded_and_compacted(spark, path):
    for i in range(index.FOLD + 3):
        index.delete(path, ids(spark, i))
        if i % 3 == 2:
            index.append(path, spark, {"tags": spark.createDataFrame([(i, i * 10)], "id long, tag long")}, gone=ids(spark, i - 1))
    kinds = [log.read(spark, path, v).kind for v in index.versions(spark, path)]
    assert "fold" in kinds
    whole, changes = index._state(spark, path, index.versions(spark, path)[-1])
    assert len(changes) <= index.FOLD + 1
    x = index.open_index(spark, path)
    gone = {1, 4, 7}
    assert {r["id"] for r in x.tombstones.collect()} == set(range(11)) - gone and x.vectors.count() == 200 - len(gone)
    assert {r["tag"] for r in x.tags.where("id IN (2, 5, 8)").collect()} == {20, 50, 80}
    index.compact(path, spark)
    y = index.open_index(spark, path)
    for name in ("vectors", "topology", "tombstones", "tags", "layout", "codes", "entries"):
        assert sorted(map(str, getattr(x, name).select("id").collect())) == sorted(map(str, getattr(y, name).select("id").collect()))


def test_a_change_during_a_compaction_stays_on_top(spark, base, path, monkeypatch):
    index.delete(path, ids(spark, 1))
    meanwhile(monkeypatch, index, "_written", lambda: index.delete(path, ids(spark, 2)))
    index.compact(path, spark)
    assert {r["id"] for r in index.open_index(spark, path).tombstones.collect()} == {1, 2}


def test_a_batch_of_a_stream_is_taken_once(spark, base, path):
    new = spark.createDataFrame([(700, [3.0] * 8)], "id long, vec array<double>")
    one = index.insert(path, new, params=P, batch=("s/insert", 4))
    assert index.insert(path, new, params=P, batch=("s/insert", 4)) == one
    index.delete(path, ids(spark, 700), batch=("s/delete", 4))
    assert index.insert(path, new, params=P, batch=("s/insert", 3)) == one + 1
    assert [r["id"] for r in index.open_index(spark, path).tombstones.collect()] == [700]


def test_entries_are_created_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert log.create(spark, path, log.Entry("save", 0, version=1)) and not log.create(spark, path, log.Entry("merge", 0, version=1))
    assert log.versions(spark, path) == [1] and log.read(spark, path, 1).kind == "save"
    assert [p.name for p in (tmp_path / "log" / "log").iterdir() if p.suffix == ".json"] == ["000000000001.json"]
    assert json.loads((tmp_path / "log" / "log" / "000000000001.json").read_text())["version"] == 1


def test_entries_are_created_once_by_renaming(spark, tmp_path):
    """On file systems other than local disks, here one that is mounted by name."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./in", f"file://{tmp_path}")
    path = "viewfs://logs/in/index"
    assert log.create(spark, path, log.Entry("save", 0, version=1)) and not log.create(spark, path, log.Entry("merge", 0, version=1))
    assert log.versions(spark, path) == [1] and log.read(spark, path, 1).kind == "save"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_leave_the_tables_in_their_buckets(spark, path):
    x = index.open_index(spark, path)
    asked = spark.range(50).select("id", F.lit(1).alias("qid"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("topology", "codes", "vectors"):
            plan = plan_of(x.keyed(name).join(asked))
            scan = plan[plan.index("FileScan parquet") :]
            assert "Bucketed: true" in scan and plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange") < plan.index("FileScan")
            assert "Exchange hashpartitioning" not in plan_of(x.keyed(name).join(asked, few=True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pages_stay_near_after_many_batches(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 6))[rng.integers(30, size=600)] * 4 + rng.standard_normal((600, 6)) * 0.5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").cache()
    topology, _ = graph.build(rows, P)
    topology = topology.cache()
    where = layout.pages(topology.join(rows.where("id < 400").select("id"), "id", "left_semi"), rows.where("id < 400"), 8)
    for lo in range(400, 600, 50):
        new = rows.where((F.col("id") >= lo) & (F.col("id") < lo + 50)).select("id")
        where = spark.createDataFrame(layout.with_new_rows(where, topology, new, 8).collect(), "id long, page long, slot int")
    assert where.count() == 600 and where.groupBy("page", "slot").count().where("count > 1").count() == 0 and where.groupBy("page").count().where("count > 8").count() == 0
    fresh, grown = (layout.locality(topology, w).first() for w in (layout.pages(topology, rows, 8), where))
    assert grown["same_page"] > 0.8 * fresh["same_page"]
