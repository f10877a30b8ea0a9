"""Incremental build, work counts, page and adaptive searches, seeding, vector and trace sources, upkeep by a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakevec.functions.storage import work_folder
from lakevec.operators import cluster, exact, graph, layout, pq
from lakevec.sources import index, vectors
from lakevec.streaming import replay

P = graph.GraphParams(degree=12, candidates=60, part=150)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(12)
    return rng.standard_normal((20, 10))[rng.integers(20, size=900)] * 2 + rng.standard_normal((900, 10))


@pytest.fixture(scope="module")
def base(spark, points):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, vec array<double>").cache()


@pytest.fixture(scope="module")
def built(base):
    topology, entries = graph.build(base, P)
    return topology.cache(), entries.cache()


@pytest.fixture(scope="module")
def coder(spark, base):
    folder = work_folder(spark, "codes")
    book = pq.train(base, 10, 5, codes=32)
    book.write.parquet(f"{folder}/book")
    book = spark.read.parquet(f"{folder}/book")
    return graph.Coder(pq.packed(pq.encode(pq.split(base, 10, 5), book)).cache(), book, 10, 5)


def asked(base):
    return base.where("id % 60 = 0").selectExpr("id AS qid", "vec AS qvec")


def recall(base, found):
    return exact.recall(exact.knn(asked(base), base, 20), found, 10).first()["recall"]


def test_grown_graph_finds_as_much_as_one_of_parts(spark, base, built):
    topology, entries = graph.grow(base, P)
    sizes = topology.agg(F.countDistinct("id").alias("n"), F.max(F.size("nbrs")).alias("most")).first()
    assert tuple(sizes) == (900, 12)
    assert topology.select("id", F.explode("nbrs").alias("n")).where("id = n").count() == 0
    found = [graph.search(asked(base), base, t, e, 10, length=40, width=8) for t, e in ((topology, entries), built)]
    one, other = (recall(base, f) for f in found)
    assert one >= other - 2 and one > 90
    few = graph.grow(base.where("id < 50"), P)[0]
    assert few.count() == 50 and graph.grow(base.limit(0), P)[0].count() == 0


def test_counts_of_work(base, built, coder):
    """Along a ring of rows the counts are those of the walk itself."""
    ring = base.where("id < 100").select("id", F.array((F.col("id") + 1) % 100, (F.col("id") + 99) % 100).alias("nbrs"))
    own = asked(base).where("qid < 100").select("qid", F.col("qid").alias("id"))
    got = graph.search(asked(base).where("qid < 100"), base.where("id < 100"), ring, own, 5, length=100, width=100, max_hops=3, counts=True)
    assert {tuple(r) for r in got.select("hops", "expanded", "compared", "rescored", "complete").distinct().collect()} == {(3, 5, 7, 0, False)}
    topology, entries = built
    where = layout.pages(topology, base, 8)
    got = graph.search(asked(base), base, topology, entries, 10, length=30, width=8, mode="beam", coder=coder, layout=where, counts=True)
    work = got.select("qid", "hops", "expanded", "compared", "pages", "rescored").distinct().collect()
    assert len(work) == 15 and all(r["expanded"] == r["rescored"] >= 30 and r["pages"] <= r["expanded"] <= r["compared"] <= 900 and r["hops"] >= 4 for r in work)


def test_a_budget_of_comparisons_ends_a_search(base, built):
    topology, entries = built
    got = graph.search(asked(base), base, topology, entries, 10, length=200, width=4, max_compared=60, counts=True)
    assert got.where("complete").count() == 0 and got.agg(F.max("compared")).first()[0] < 60 + 4 * 12 + 8
    assert graph.search(asked(base), base, topology, entries, 10, length=20, width=8, max_compared=10**6).where("NOT complete").count() == 0


def test_whole_pages_take_fewer_rounds_and_adaptive_widths_fewer_comparisons(base, built, coder):
    topology, entries = built
    where = layout.pages(topology, base, 8)

    def run(mode, width):
        got = graph.search(asked(base), base, topology, entries, 10, length=40, width=width, mode=mode, coder=coder, layout=where, counts=True)
        work = got.select("qid", "hops", "compared").distinct().agg(F.avg("hops").alias("hops"), F.avg("compared").alias("compared")).first()
        return recall(base, got.select("qid", "rank", "id", "dist")), work["hops"], work["compared"]

    beam, page, pipe = run("beam", 16), run("page", 16), run("pipe", 16)
    assert page[0] >= beam[0] - 1 and page[1] < beam[1]
    assert pipe[0] >= beam[0] - 2 and pipe[2] != beam[2] and pipe[1] > beam[1]


def test_many_entries_are_found_by_a_graph(base, built, monkeypatch):
    topology, _ = built
    monkeypatch.setattr(graph, "GUIDED", 50)
    found = graph.search(asked(base), base, topology, base.where("id % 9 = 4").select("id"), 10, length=40, width=8)
    assert recall(base, found) > 90


def test_parallel_seeds_cost_less_than_random_rows(spark, base, points):
    seeds = cluster.parallel_seeds(base, 20)
    assert seeds.shape == (20, 10) and len(np.unique(seeds, axis=0)) == 20
    near = ((points[:, None] - seeds[None]) ** 2).sum(2).min(1).sum()
    assert abs(cluster.cost(base, seeds) - near) < 1e-6 * near
    random = [cluster.cost(base, cluster.kmeans(base, 20, rounds=0, seed=s, start="random")) for s in range(3)]
    assert near < np.mean(random)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "id long, vec array<double>")
    assert cluster.parallel_seeds(same, 4).tolist() == [[1.0, 2.0]]


def test_the_source_reads_only_ranges_that_are_asked_for(spark, tmp_path, monkeypatch):
    rows = [(i, [float(i), 2.0 * i]) for i in range(1000)]
    vectors.write_vectors(spark.createDataFrame(rows, "id long, vec array<float>"), str(tmp_path / "v"), files=4)
    vectors.register(spark)
    got = spark.read.format("lakevec_vectors").load(str(tmp_path / "v"))
    assert sorted((r["id"], list(r["vec"])) for r in got.collect()) == rows
    for cond, want in (("id >= 990", range(990, 1000)), ("id > 3 AND id < 7", range(4, 7)), ("id = 500", [500]), ("id IN (2, 998)", [2, 998]), ("id < 0", []), ("id <= 1", [0, 1]), ("id + 1 = 5", [4])):
        assert sorted(r["id"] for r in got.where(cond).collect()) == list(want)
    reader = vectors._Reader({"path": str(tmp_path / "v")})
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    assert not list(reader.pushFilters([GreaterThanOrEqual(("id",), 300), LessThan(("id",), 310)]))
    assert [(p.first, p.rows) for p in reader.partitions()] == [(300, 10)] and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10
    for kind in ("fvecs", "bvecs"):
        vectors.write_vectors(spark.createDataFrame([(i, [i % 200, 7]) for i in range(60)], "id long, vec array<int>"), str(tmp_path / kind), kind)
        back = spark.read.format("lakevec_vectors").option("format", kind).load(str(tmp_path / kind)).where("id >= 50")
        assert sorted((r["id"], [int(x) for x in r["vec"]]) for r in back.collect()) == [(i, [i % 200, 7]) for i in range(50, 60)]


def trace_file(path, dead, new):
    path.write_bytes(np.array([len(dead), *dead, *new], "<i4").tobytes())


def test_a_stream_keeps_an_index_up_exactly_once(spark, base, tmp_path, monkeypatch):
    path, traces = str(tmp_path / "index"), tmp_path / "traces"
    traces.mkdir()
    index.build_index(base.where("id < 200"), path, chunks=5, codes=16, params=P)
    trace_file(traces / "0", [0, 1], [200, 201])
    trace_file(traces / "1", [200, 3], [202, 0])
    real, calls = index.insert, []

    def dies(*a, **k):
        calls.append(k["batch"])
        out = real(*a, **k)
        if len(calls) == 2:
            raise RuntimeError("the job is killed after its second insert")
        return out

    monkeypatch.setattr(index, "insert", dies)
    where = str(tmp_path / "checkpoint")
    with pytest.raises(Exception, match="killed"):
        replay.keep_up(spark, path, replay.trace_stream(spark, str(traces)), base, where, params=P)
    before = index.versions(spark, path)
    assert before[-1] == 5  # the build, and two changes a step
    opened = index.open_index(spark, path)
    replay.keep_up(spark, path, replay.trace_stream(spark, str(traces)), base, where, params=P)
    assert index.versions(spark, path) == before  # nothing twice
    trace_file(traces / "2", [4, 0], [205, 206])
    replay.keep_up(spark, path, replay.trace_stream(spark, str(traces)), base, where, params=P, repair_every=3)
    x = index.open_index(spark, path)
    live = (set(range(200)) | {201, 202, 205, 206}) - {0, 1, 3, 4}
    assert {r["id"] for r in x.vectors.collect()} == live and x.tombstones.count() == 0
    assert {r["id"] for r in opened.tombstones.collect()} == {1, 200, 3}  # the version that was opened
