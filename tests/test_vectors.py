import numpy as np
import pytest
from pyspark.sql import functions as F

from lakevec.functions.storage import work_folder
from lakevec.operators import cluster, exact, graph, layout, metrics, pq, stats, update
from lakevec.sources import index
from lakevec.sources import vectors as files
from lakevec.streaming.replay import replay


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(3).standard_normal((300, 16)).astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def base(spark, points):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, vec array<double>").cache()


@pytest.fixture(scope="module")
def built(base):
    return graph.build(base, graph.GraphParams(degree=12, candidates=40))


def asked(base, n=8):
    return base.where(F.col("id") < n).selectExpr("id AS qid", "vec AS qvec")


def brute(points, q, k, skip=()):
    d = ((points - points[q]) ** 2).sum(1)
    return [i for i in np.lexsort((np.arange(len(d)), d)) if i not in skip][:k]


def answers(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


def test_knn_equals_brute_force(base, points):
    got = answers(exact.knn(asked(base), base, 7))
    assert got == {q: brute(points, q, 7) for q in range(8)}
    assert answers(exact.knn(asked(base), base, 5, exclude_self=True)) == {q: brute(points, q, 5, {q}) for q in range(8)}


def test_knn_of_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (2, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = exact.knn(df.selectExpr("id AS qid", "vec AS qvec").where("qid = 1"), df, 5).collect()
    assert [(r["rank"], r["id"], r["dist"]) for r in got] == [(1, 1, 0.0), (2, 2, 0.0)]
    assert exact.knn(df.selectExpr("id AS qid", "vec AS qvec").limit(0), df, 5).count() == 0
    assert exact.knn(df.selectExpr("id AS qid", "vec AS qvec").where("qid = 1"), df.limit(0), 5).count() == 0


def test_knn_in_parts(spark, base, points, monkeypatch):
    monkeypatch.setattr(exact, "BASE_BYTES", 2000)
    assert exact.blocks_of(base, "vec", exact.BASE_BYTES) > 3
    near = exact.knn(asked(base), base, 7)
    assert answers(near) == {q: brute(points, q, 7) for q in range(8)}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and plan.count("explode") <= 2  # only the queries are copied
    # a row that repeats more often than k hides no other row, as a query neither
    many = base.unionByName(base.where("id = 3").crossJoin(spark.range(300).select()))
    again = asked(base).unionByName(asked(base).where("qid = 3").crossJoin(spark.range(40).select()))
    assert answers(exact.knn(again, many, 7)) == {q: brute(points, q, 7) for q in range(8)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert answers(exact.knn(again, many, 7, exclude_self=True)) == {q: brute(points, q, 7, {q}) for q in range(8)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_metrics_names():
    assert metrics.metric("l2") is metrics.l2sq
    with pytest.raises(ValueError):
        metrics.metric("ip")


def test_recall_counts_ties(spark):
    truth = spark.createDataFrame([(0, 1, 5, 0.1), (0, 2, 6, 0.2), (0, 3, 7, 0.2)], "qid long, rank int, id long, dist double")
    found = spark.createDataFrame([(0, 1, 5, 0.1), (0, 2, 7, 0.2)], "qid long, rank int, id long, dist double")
    assert exact.recall(truth, found, 2).first()["recall"] == 100.0


def test_graph_is_sound(base, built):
    topology, entries = built
    d = stats.degrees(topology).first()
    assert d["n"] == 300 and d["most"] <= 12
    assert topology.where("array_contains(nbrs, id) OR size(array_distinct(nbrs)) < size(nbrs)").count() == 0
    assert entries.count() >= 1


def test_a_wide_pool_finds_all_neighbours(base, built, points):
    topology, entries = built
    got = answers(graph.search(asked(base, 4), base, topology, entries, 10, length=300, width=300))
    assert got == {q: brute(points, q, 10) for q in range(4)}


def test_rerank_with_deletes(base, built, points):
    topology, entries = built
    book = pq.train(base, 16, 4, codes=16).cache()
    codes = pq.encode(pq.split(base, 16, 4), book).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "code"))), lambda x: x["code"]).alias("codes"))
    dead = base.where("id % 3 = 1").select("id")
    got = answers(graph.search(asked(base, 2), base, topology, entries, 5, length=300, width=300, mode="rerank", coder=graph.Coder(codes, book, 16, 4), tombstones=dead))
    gone = set(range(1, 300, 3))
    assert got == {q: brute(points, q, 5, gone) for q in range(2)}


def test_consolidate_leaves_no_trace_of_deleted_rows(base, built):
    topology, entries = built
    dead = base.where("id % 4 = 0").select("id")
    new, live, starts = update.consolidate(topology, base, entries, dead, graph.GraphParams(degree=12, candidates=40))
    assert new.count() == live.count() == 225
    edges = new.select("id", F.explode("nbrs").alias("nbr"))
    assert edges.where("nbr % 4 = 0 OR id = nbr").count() == 0
    assert new.where("size(nbrs) > 12").count() == 0
    assert starts.where("id % 4 = 0").count() == 0


def test_insert_links_both_ways(base, built):
    topology, entries = graph.build(base.where("id < 290"), graph.GraphParams(degree=12, candidates=40))
    new, every = update.insert(base.where("id >= 290"), base.where("id < 290"), topology, entries, graph.GraphParams(degree=12, candidates=40), length=40)
    assert new.count() == every.count() == 300
    assert new.where("id >= 290 AND size(nbrs) > 0").count() == 10
    assert new.where("id < 290 AND exists(nbrs, x -> x >= 290)").count() > 0


def test_prune_kernels():
    vecs = np.array([[1.0, 0], [1.1, 0], [0, 2.0]])
    dist = (vecs**2).sum(1)
    assert graph.robust_prune(dist, vecs, 2, 1.2) == [0, 2]
    assert graph.robust_prune(np.array([1.0, 1.0]), np.array([[1.0, 0], [1.0, 0]]), 2, 1.2) == [0]
    assert graph.delta_prune(dist, vecs, 0, 1.2) == 1
    # Step two: the first later one that an earlier neighbour, other than the new one, occludes.
    line = np.array([[1.0, 0], [0, 2.0], [0, 2.2], [-9.0, 0]])
    assert graph.delta_prune((line**2).sum(1), line, 3, 1.2) == 2
    assert graph.robust_prune(dist, vecs, 3, 1.2, saturate=True) == [0, 1, 2]
    assert graph.robust_prune(dist, vecs, 2, 1.2, entry=2) == [0, 2] and graph.robust_prune(np.arange(1.0, 6), np.eye(5) * 9, 5, 1.2, entry=4) == [0, 1, 2, 3]
    assert graph.truncation(100, 20) == 34 and graph.truncation(5, 20) == 5


def test_codes_and_chunks():
    assert pq.chunk_bounds(10, 4) == [(0, 3), (3, 3), (6, 2), (8, 2)]
    assert pq.chunk_count(1000, 10, 64) == 64 and pq.chunk_count(1, 10, 64) == 1
    assert cluster.ram_estimate(1000, 10, 4, 32) == pytest.approx(1.1 * (1000 * 32 * 4 * 1.3 + 1000 * 16 * 4))


def test_second_codebook_lowers_the_error(base):
    parts = pq.split(base, 16, 4)
    first = pq.encode(parts, pq.train(base, 16, 4, codes=8)).cache()
    both = pq.dual(first, pq.encode(parts, pq.refine(parts, first, codes=8)))
    assert both.agg(F.avg("err")).first()[0] < first.agg(F.avg("err")).first()[0]


def test_pages_hold_every_row_once(base, built):
    where = layout.pages(built[0], base, 8, part=100)
    assert where.select("id").distinct().count() == 300 and where.select("page", "slot").distinct().count() == 300
    assert where.groupBy("page").count().where("count > 8").count() == 0


def clusters(spark, groups=60, size=16, dim=8):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((groups, dim)) * 10
    x = np.repeat(centres, size, 0) + rng.standard_normal((groups * size, dim)) * 0.01
    order = rng.permutation(len(x))
    return spark.createDataFrame([(i, x[j].tolist()) for i, j in enumerate(order)], "id long, vec array<double>")


def test_near_rows_share_pages_and_pages_are_full(spark):
    rows = clusters(spark)
    topology, _ = graph.build(rows, graph.GraphParams(degree=8, candidates=20, part=300))
    got = layout.locality(topology, layout.pages(topology, rows, 16, part=300)).first()
    assert got["same_page"] > 0.6 and got["fill"] > 0.7


def plainly_matched(size, edges, capacity, rounds):
    """layout.matched on dicts: {group: size} and {(x, y): (rank, n)}."""
    to = {g: g for g in size}
    for _ in range(rounds):
        edges = {e: v for e, v in edges.items() if size[e[0]] + size[e[1]] <= capacity}
        best = {}
        for (x, y), (rank, n) in edges.items():
            for g in (x, y):
                best[g] = min(best.get(g, (rank, -n, x, y)), (rank, -n, x, y))
        into = {y: x for rank, n, x, y in best.values() if best[x] == best[y]}
        for y, x in into.items():
            size[x] += size.pop(y)
        to = {g: into.get(t, t) for g, t in to.items()}
        merged = {}
        for (x, y), (rank, n) in edges.items():
            x, y = sorted((into.get(x, x), into.get(y, y)))
            if x != y:
                r, m = merged.get((x, y), (rank, 0))
                merged[x, y] = (min(r, rank), m + n)
        edges = merged
    return to


def test_groups_are_matched_as_by_the_plain_rule(spark):
    rng = np.random.default_rng(4)
    size = {g: int(rng.integers(1, 6)) for g in range(120)}
    edges = {(min(x, y), max(x, y)): (int(rng.integers(0, 4)), int(rng.integers(1, 5))) for x, y in rng.integers(0, 120, (400, 2)).tolist() if x != y}
    sizes = spark.createDataFrame(list(size.items()), "grp long, size long")
    got = layout.matched(sizes, spark.createDataFrame([(*e, *v) for e, v in edges.items()], "x long, y long, rank int, n long"), 16, 5)
    want = plainly_matched(dict(size), edges, 16, 5)
    assert {r["grp"]: r["to"] for r in got.collect()} == want and len(set(want.values())) < 70
    none = layout.matched(sizes, spark.createDataFrame([], "x long, y long, rank int, n long"))
    assert all(r["grp"] == r["to"] for r in none.collect())


def test_edges_across_parts_share_pages(spark):
    """Rows along a line, cut into parts: near rows of two parts come to one page, and pages stay full."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(int(i), [float(k), float(rng.random())]) for k, i in enumerate(rng.permutation(600))], "id long, vec array<double>")
    topology, _ = graph.build(rows, graph.GraphParams(degree=8, candidates=20))
    where = layout.pages(topology, rows, 8, part=40).cache()
    assert where.select("id").distinct().count() == where.select("page", "slot").distinct().count() == 600
    assert where.groupBy("page").count().where("count > 8").count() == 0
    got, whole = layout.locality(topology, where).first(), layout.locality(topology, layout.pages(topology, rows, 8, part=4096)).first()
    assert got["fill"] > 0.7 and got["same_page"] > 0.9 * whole["same_page"]


def test_full_pages_are_split_and_others_stay(spark):
    rows = clusters(spark, 20, 18)
    topology, _ = graph.build(rows, graph.GraphParams(degree=8, candidates=20))
    old = rows.where("id % 9 <> 0")
    before = layout.pages(topology, old, 16).join(old.select("id"), "id")
    after = layout.with_new_rows(before, topology, rows.where("id % 9 = 0"), 16).cache()
    assert after.count() == 360 and after.select("page", "slot").distinct().count() == 360
    assert after.groupBy("page").count().where("count > 16").count() == 0
    assert after.join(before, ["id", "page", "slot"]).count() > 0


@pytest.mark.parametrize("format", ["bin", "fvecs", "bvecs", "ivecs"])
def test_vector_files_round_trip(spark, tmp_path, format):
    rows = [(i, [float((i * 7 + j) % 200) for j in range(5)]) for i in range(11)]
    files.write_vectors(spark.createDataFrame(rows, "id long, vec array<float>"), str(tmp_path / "v"), format, files=3)
    got = files.read_vectors(spark, str(tmp_path / "v"), format).orderBy("id").collect()
    assert [(r["id"], [float(x) for x in r["vec"]]) for r in got] == rows


def test_bin_header_and_truth_set(spark, tmp_path):
    ids, dist = np.array([[3, 1], [2, 0]], "<u4"), np.array([[0.5, 1], [0, 2]], "<f4")
    (tmp_path / "t.bin").write_bytes(np.array([2, 2], "<i4").tobytes() + ids.tobytes() + dist.tobytes())
    assert [tuple(r)[1:] for r in files.bin_header(spark, str(tmp_path / "t.bin")).collect()] == [(2, 2)]
    got = files.read_truth(spark, str(tmp_path / "t.bin")).orderBy("qid", "rank").collect()
    assert [tuple(r)[:4] for r in got] == [(0, 1, 3, 0.5), (0, 2, 1, 1.0), (1, 1, 2, 0.0), (1, 2, 0, 2.0)]


def test_replay_sees_every_step_once(spark, base, tmp_path):
    trace = update.trace(base, 200, 20, 2)
    trace.repartition(1).write.parquet(str(tmp_path / "trace"))
    seen = []
    replay(spark, str(tmp_path / "trace"), lambda ins, dele, n: seen.append((ins.count(), dele.count())), str(tmp_path / "cp"))
    assert [sum(x) for x in zip(*seen, strict=True)] == [40, 40]


def test_index_versions(spark, base, built, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        index.open_index(spark, path)
    assert index.save(path, base, built[0], built[1]) == 1
    assert index.save(path, base.where("id < 10"), built[0], built[1]) == 2
    assert index.open_index(spark, path).vectors.count() == 10
    old = index.open_index(spark, path, 1)
    assert old.vectors.count() == 300 and old.coupled().count() == 300
    assert [tuple(r)[:2] for r in old.by_tag(spark.createDataFrame([(7,)], "tag long")).collect()] == [(7, 7)]


def test_shards_fit_the_memory(base):
    whole = cluster.ram_estimate(300, 16, 4, 32)
    centres = cluster.partition_for_memory(base, 16, whole * 0.6)
    assert len(centres) >= 3
    assert cluster.cluster_sizes(base, centres).agg(F.sum("n")).first()[0] == 600


def test_seeds_are_distinct_rows(points):
    got = cluster.seeds(points[:50], 10)
    assert len(np.unique(got, axis=0)) == 10
    assert len(cluster.seeds(np.ones((5, 2)), 3)) == 3


def test_two_books_of_one_training(base):
    a, b = pq.dual_from_scratch(base, 16, 4, codes=8)
    assert a.groupBy("chunk").count().agg(F.max("count")).first()[0] == 8 and b.count() == 32


def test_neighbourhood_of_entries(built):
    near = layout.neighbourhood(*built, hops=2)
    assert near.select("id").distinct().count() == near.count() and near.agg(F.max("hop")).first()[0] <= 2


def test_truth_sets_of_all_layouts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RANGE", 24)  # several ranges
    ids, dist, tags = np.arange(12, dtype="<u4"), np.arange(12, dtype="<f4") / 2, np.arange(12, dtype="<u4") + 100
    for layers in range(1, 4):
        path = tmp_path / f"t{layers}.bin"
        path.write_bytes(np.array([4, 3], "<i4").tobytes() + b"".join(x.tobytes() for x in (ids, dist, tags)[:layers]))
        got = files.read_truth(spark, str(path)).orderBy("qid", "rank").collect()
        want = [(q, r + 1, 3 * q + r, (3 * q + r) / 2 if layers > 1 else None, 3 * q + r + 100 if layers > 2 else None) for q in range(4) for r in range(3)]
        assert [tuple(r) for r in got] == want
    truth = files.read_truth(spark, str(tmp_path / "t3.bin"))
    files.write_truth(truth, str(tmp_path / "again"), 3)
    assert sorted(map(tuple, files.read_truth(spark, str(tmp_path / "again")).select("id", "dist", "tag").collect())) == [(i, i / 2, i + 100) for i in range(12)]
    (tmp_path / "bad.bin").write_bytes(np.array([4, 3, 1], "<i4").tobytes())
    with pytest.raises(Exception, match="no truth set"):
        files.read_truth(spark, str(tmp_path / "bad.bin")).collect()


def test_files_are_read_in_ranges_and_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RANGE", 100)
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(50)]
    files.write_vectors(spark.createDataFrame(rows, "id long, vec array<float>"), str(tmp_path / "v"))
    assert len(list((tmp_path / "v").glob("*.bin"))) > 1
    assert sorted((r["id"], list(r["vec"])) for r in files.read_vectors(spark, str(tmp_path / "v")).collect()) == rows


def test_trace_files(spark, tmp_path):
    (tmp_path / "trace.bin").write_bytes(np.array([3, 7, 8, 9, 17, 18, 19], "<i4").tobytes())
    got = sorted(tuple(r) for r in files.read_trace(spark, str(tmp_path / "trace.bin")).collect())
    assert got == [("delete", 7, 0), ("delete", 8, 1), ("delete", 9, 2), ("insert", 17, 0), ("insert", 18, 1), ("insert", 19, 2)]


def test_pools_count_live_rows(base, built, points):
    """Of 300 rows 285 are deleted: the ten nearest of the others are found all the same."""
    topology, entries = built
    dead = base.where("id % 20 <> 3").select("id")
    got = answers(graph.search(asked(base, 4), base, topology, entries, 10, length=15, width=64, tombstones=dead))
    gone = {i for i in range(300) if i % 20 != 3}
    assert got == {q: brute(points, q, 10, gone) for q in range(4)}


def test_hop_budget_says_which_answers_are_whole(base, built):
    topology, entries = built
    short = graph.search(asked(base, 3), base, topology, entries, 5, length=50, width=1, max_hops=1)
    assert not short.where("complete").count() and short.count() > 0
    assert graph.search(asked(base, 3), base, topology, entries, 5, length=20, width=64, max_hops=100).where("NOT complete").count() == 0


def test_own_entries_from_a_sample(base, built, points):
    topology, _ = built
    sample = graph.navigation(base, 0.2, graph.GraphParams(degree=8, candidates=20))
    starts = graph.entry_rows(asked(base, 3), sample, 4)
    assert starts.groupBy("qid").count().where("count <> 4").count() == 0
    got = answers(graph.search(asked(base, 3), base, topology, starts, 10, length=300, width=300))
    assert got == {q: brute(points, q, 10) for q in range(3)}
    assert graph.navigation(base, 0.0)[0].count() == 1


def test_strategies():
    assert graph.search_options(7) == {"mode": "rerank"} and graph.search_options(65) == {"mode": "rerank", "keep": 40}
    assert graph.search_options(256)["mode"] == "page" and graph.search_options(0) == {"mode": "beam"}
    for bits in (128, 512, -1):
        with pytest.raises(ValueError):
            graph.search_options(bits)


def test_parts_are_small_and_lose_no_row(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((900, 6)), np.ones((600, 6))])  # many equal rows
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    folder = work_folder(spark, "parts")
    got = cluster.parts(rows, folder, rows=100, fan=4).cache()
    assert got.groupBy("part").count().where("count > 100").count() == 0 and got.count() == 1500 and got.select("id").distinct().count() == 1500
    twice = cluster.parts(rows, work_folder(spark, "parts"), rows=100, overlap=2)
    assert twice.select("id").distinct().count() == 1500 and twice.count() > 1500


@pytest.mark.parametrize("n", [500, 1500, 3000])
def test_recall_with_many_parts(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((40, 12))[rng.integers(40, size=n)] * 2 + rng.standard_normal((n, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    topology, entries = graph.build(rows, graph.GraphParams(part=200))
    asking = rows.where("id % 50 = 0").selectExpr("id AS qid", "vec AS qvec")
    found = graph.search(asking, rows, topology, entries, 10, length=60, width=16)
    assert exact.recall(exact.knn(asking, rows, 20), found, 10).first()["recall"] >= 90


def test_rows_of_a_batch_link_to_one_another_and_little_is_written(spark, base):
    p = graph.GraphParams(degree=12, candidates=40)
    far = spark.createDataFrame([(1000 + i, [50.0 + i / 10] * 16) for i in range(4)], "id long, vec array<double>")
    topology, entries = graph.build(base, p)
    delta = update.insertion(far, base, topology, entries, p, length=30)
    near = {r["id"]: set(r["nbrs"]) for r in delta.topology.where("id >= 1000").collect()}
    assert set(near) == {1000, 1001, 1002, 1003} and all(near[i] & {1000, 1001, 1002, 1003} for i in near)
    assert delta.topology.count() < 100 and delta.vectors.count() == 4
    assert delta.topology.where("size(nbrs) > 12").count() == 0
    nothing = update.insertion(far.where("id = 1000"), base.limit(0), topology.limit(0), entries.limit(0), p)
    assert [(r["id"], r["nbrs"]) for r in nothing.topology.collect()] == [(1000, [])]


def test_epochs_and_merge_keep_tags(spark, base, built):
    topology, entries = built
    first = update.deleted_in(spark.createDataFrame([], "id long, epoch int"), base.where("id % 3 = 0").select("id"), 0)
    frozen, _ = update.next_epoch(first)
    later = update.deleted_in(first, base.where("id % 2 = 0").select("id"), 1)
    assert later.where("id = 6").first()["epoch"] == 0 and later.where("id = 2").first()["epoch"] == 1 and frozen.count() == 100
    tags = base.where("id > 9").select("id", (F.col("id") + 5000).alias("tag"))
    top, vec, starts, named = update.merge_deletes(topology, base, entries, tags, frozen, graph.GraphParams(degree=12, candidates=40))
    assert sorted(r["id"] for r in vec.collect()) == list(range(200)) and top.count() == 200 and starts.count() >= 1
    assert top.select(F.explode("nbrs").alias("n")).where("n < 0 OR n >= 200").count() == 0
    want = {(i + 5000 if i > 9 else i): v for i, v in ((r["id"], r["vec"]) for r in base.collect()) if i % 3}
    assert {r["tag"]: r["vec"] for r in vec.join(named, "id").collect()} == want


def test_deleted_entries_give_way(spark):
    topology = spark.createDataFrame([(1, [2, 3]), (2, [4]), (3, [5]), (4, [1])], "id long, nbrs array<long>")
    entries, live = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(3,), (5,)], "id long")
    dead = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    assert {r["id"] for r in update.replaced_entries(topology, entries, dead, live).collect()} == {3}
    assert {r["id"] for r in update.replaced_entries(topology, entries.where("id = 2"), dead, live, 1).collect()} == {3}


def test_prune_on_code_distances(spark, base):
    parts = pq.split(base, 16, 4)
    book = pq.train(base, 16, 4, codes=16).cache()
    codes = pq.encode(parts, book)
    known = {r["id"]: np.array(r["vec"]) for r in pq.decoded(codes, book).collect()}
    pairs = base.where("id < 5").select("id", F.explode(F.sequence(F.lit(0), F.lit(39)).cast("array<long>")).alias("nbr"))
    got = {r["id"]: r["nbrs"] for r in graph.prune(pairs, pq.decoded(codes, book), 6, 1.2, 40).collect()}
    for i, nbrs in got.items():
        order = sorted((((known[i] - known[j]) ** 2).sum(), j) for j in range(40) if j != i)
        dist, ids = np.array([d for d, _ in order]), [j for _, j in order]
        assert nbrs == [ids[k] for k in graph.robust_prune(dist, np.stack([known[j] for j in ids]), 6, 1.2)]


def test_merged_book_is_no_worse_than_the_first(base):
    parts = pq.split(base, 16, 4)
    first = pq.train(base, 16, 4, codes=8).cache()
    second = pq.refine(parts, pq.encode(parts, first), codes=8)
    merged = pq.merged_book(parts, first, second, codes=8).cache()
    assert merged.groupBy("chunk").count().agg(F.max("count")).first()[0] == 8
    err = [pq.encode(parts, b).agg(F.avg("err")).first()[0] for b in (first, merged)]
    assert err[1] < err[0] * 1.1


def test_worst_rows_are_exact_with_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i, c, float(np.round(rng.exponential(), 2))) for i in range(500) for c in range(2)] + [(i, 2, 1.0) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, chunk int, err double")
    want = set()
    for c in range(3):
        own = sorted((-e, i) for i, k, e in rows if k == c)
        want |= {(i, c) for _, i in own[: max(1, int(len(own) * 0.2))]}
    assert {tuple(r) for r in pq.worst(df, steps=16).collect()} == want


def test_index_from_build_to_merge(spark, base, points, tmp_path):
    path, p = str(tmp_path / "whole"), graph.GraphParams(degree=12, candidates=40)
    old, new = base.where("id < 280"), base.where("id >= 280")
    tags = base.select("id", (F.col("id") * 2).alias("tag"))
    assert index.build_index(old, path, chunks=4, codes=16, params=p, tags=tags) == 1
    x = index.open_index(spark, path)
    assert x.codes.count() == x.layout.count() == 280 and len(index.books_of(x.book, 16)) == 2
    asking = asked(base, 3)
    for mode in ("rerank", "page", "beam", "memory"):
        got = x.search(asking, 5, mode=mode, length=300, width=128)
        assert answers(got) == {q: brute(points, q, 5, set(range(280, 300))) for q in range(3)} and got.where("tag <> 2 * id").count() == 0
    assert index.insert(path, new, 16, p, length=40) == 2
    index.delete(path, base.where("id % 3 = 1").select("id"))
    gone = set(range(1, 300, 3))
    x = index.open_index(spark, path)
    assert x.vectors.count() == x.codes.count() == x.layout.count() == x.topology.count() == 300
    assert answers(x.search(asking, 5, length=400, width=128)) == {q: brute(points, q, 5, gone) for q in range(3)}
    index.repair(path, spark, p)
    x = index.open_index(spark, path)
    assert x.vectors.count() == x.topology.count() == 200 and x.tombstones.count() == 0
    assert x.topology.select(F.explode("nbrs").alias("n")).where("n % 3 = 1").count() == 0
    index.delete(path, base.where("id = 0").select("id"), epoch=1)
    index.merge(path, spark, p)
    x = index.open_index(spark, path)
    assert sorted(r["id"] for r in x.vectors.select("id").collect()) == list(range(199)) and x.codes.count() == 199
    got = x.search(asking, 5, length=400, width=128).orderBy("qid", "rank").collect()
    assert [r["tag"] // 2 for r in got if r["qid"] == 2] == brute(points, 2, 5, gone | {0})
    before = index.versions(spark, path)
    index.compact(path, spark)
    assert index.versions(spark, path)[:-1] == before and index.open_index(spark, path, 1).vectors.count() == 280
