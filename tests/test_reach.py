import numpy as np
import pytest

from lakevec.operators import graph


def clustered(clusters=12, each=50, dim=8):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((clusters, 1, dim)) * 50 + rng.standard_normal((clusters, each, dim))).reshape(-1, dim)
    x[7::100] = x[7]  # equal rows, which pruning never links
    return x


@pytest.fixture(scope="module")
def split(spark):
    x = clustered()
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    topology, entries = graph.build(base, graph.GraphParams(degree=8, candidates=30, part=60))
    return x, base, topology, entries


def test_every_row_is_led_to_from_an_entry(split):
    x, _, topology, entries = split
    lists, starts = {r["id"]: r["nbrs"] for r in topology.collect()}, [r["id"] for r in entries.collect()]
    assert set(lists) == set(range(len(x))) and max(map(len, lists.values())) <= 8
    seen, front = set(starts), starts
    while front:
        front = [b for a in front for b in lists[a] if b not in seen and not seen.add(b)]
    assert seen == set(lists)


def test_a_pool_of_the_whole_table_crosses_gaps(split):
    """Entries near the query lead to its own clusters alone; the pool isn't full then."""
    x, base, topology, entries = split
    asked = base.where("id % 50 = 0").selectExpr("id AS qid", "vec AS qvec")
    found = graph.search(asked, base, topology, entries, k=len(x), length=len(x), width=200, n_entries=1)
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    d = ((x[::50, None] - x[None]) ** 2).sum(2)
    assert got == {50 * q: np.lexsort((np.arange(len(x)), row)).tolist() for q, row in enumerate(d)}


def test_rows_out_of_reach_get_an_edge_in_place_of_one_that_no_path_needs():
    x = np.arange(6.0)[:, None]
    lists = [np.array(c) for c in ([1, 2], [0, 2], [1, 0], [4, 5], [3, 5], [4, 3])]
    got = graph.rooted(np.arange(6), lists, x, 2)
    assert all(len(c) <= 2 for c in got)
    seen, front = {0}, [0]
    while front:
        front = [int(b) for a in front for b in got[a] if b not in seen and not seen.add(int(b))]
    assert seen == set(range(6))
