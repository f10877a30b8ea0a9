import numpy as np

from lakevec import catalog
from lakevec.operators import exact

SF = "/root/testdata/sf0.001"


def brute(vecs, k):
    """Each row's k nearest others, ties by number."""
    d = ((vecs[:, None, :] - vecs[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.array([np.lexsort((np.arange(len(d)), row))[:k] for row in d])


def table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
    ids, vecs = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    return ids, vecs, ids[brute(vecs, 8)]


def test_stored_index_holds_the_nearest_rows(spark):
    """All rows' eight nearest, not a rule on their numbers."""
    ids, _, near = table(spark)
    got = {(r["id"], r["nbr"]) for r in catalog.QUERIES["stored_index"](spark, SF).collect()}
    assert got == {(i, n) for i, ns in zip(ids.tolist(), near.tolist(), strict=True) for n in ns}


def test_percentiles_are_those_of_the_nearest_rows(spark):
    ids, _, near = table(spark)
    named = np.sort(np.unique(near, return_counts=True)[1])
    want = {s: int(named[min(int(s * len(named)), len(named) - 1)]) for s in (0.5, 0.9, 0.99, 0.999)}
    assert {r["share"]: r["value"] for r in catalog.QUERIES["percentiles"](spark, SF).collect()} == want


def test_graph_in_cells(spark, monkeypatch):
    """Parts that meet parts give what one comparison of all rows gives; equal rows tie by id."""
    vecs = np.random.default_rng(4).standard_normal((150, 8)).astype(np.float32).astype(float)
    vecs[100:110] = vecs[0]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    monkeypatch.setattr(exact, "CELL_ROWS", 40)
    got = {r["id"]: r["nbrs"] for r in exact.neighbour_graph(base, 5).collect()}
    assert got == dict(enumerate(brute(vecs, 5).tolist()))
    assert exact.neighbour_graph(base.limit(0), 5).count() == 0
