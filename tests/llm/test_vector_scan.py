import numpy as np

from lakevec.llm import vector_scan as v


def test_recall_and_exact_scores(spark):
    x = np.random.default_rng(1).standard_normal((3000, 24))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    got = v.search(df, df.where("id % 100 = 0")).collect()
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == d[m[1]] for m in mine)
        hit += len({m[1] for m in mine} & set(np.argsort(d)[:10].tolist()))
    assert hit / 300 >= 0.9


def test_dimension_test_abandons_candidates(spark):
    """With a test that abandons nearly all, neighbours are lost: the scan's test decides."""
    x = np.random.default_rng(1).standard_normal((2000, 48))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    found = [v.search(df, df.where("id % 100 = 0"), epsilon=e).select("query_id", "vec_id").distinct().count() for e in (v.EPSILON, -3.0)]
    assert found[0] == 200 and found[1] < 200


def test_bound_tightens_while_scanning():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((3000, 32)), rng.standard_normal(32)
    rotation = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    turned = [np.ascontiguousarray((x @ rotation)[:, i : i + 8]) for i in range(0, 32, 8)]
    i, d = v.scan(q, -1, np.inf, np.arange(3000), x, turned, 10, rotation, epsilon=4.0)
    want = np.sqrt(((x - q) ** 2).sum(1))
    assert i.tolist() == np.argsort(want)[:10].tolist() and np.allclose(d, np.sort(want)[:10])


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = v.search(df, df.where("id % 2 = 0")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0][:2] == [1, 2]
    assert {r["vec_id"] for r in got} <= {0, 1, 2, 8} and all(r["query_id"] != r["vec_id"] for r in got)
    assert v.search(df.limit(0), df.limit(0)).count() == 0
    assert v.search(df, df.limit(0)).count() == 0


def test_many_equal_vectors(spark, monkeypatch):
    for name in ("PART", "ASKED", "CELL_PART"):
        monkeypatch.setattr(v, name, 64)
    df = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), -1.0]) for i in range(600)], "id long, vec array<double>")
    got = v.search(df.unionByName(df), df).where("query_id = 100").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(600) if i % 3 and i != 100][:10]
