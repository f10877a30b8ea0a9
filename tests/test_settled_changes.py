import numpy as np

from lakevec.operators import graph, update
from lakevec.sources import index


def test_an_insert_lays_earlier_changes_over_one_another_once(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(8).standard_normal((160, 8))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    path, real, plans = str(tmp_path / "index"), update.insertion, []
    index.build_index(base.where("id < 120"), path, chunks=4, codes=8, params=graph.GraphParams(part=200))
    index.insert(path, base.where("id >= 120 AND id < 140"))
    index.delete(path, base.where("id IN (3, 125)").select("id"))

    def seen(new, vectors, topology, entries, params, length, tombstones, coder, codes):
        plans.extend(t._jdf.queryExecution().optimizedPlan().toString() for t in (topology.changed, coder.codes.changed))
        return real(new, vectors, topology, entries, params, length, tombstones, coder, codes)

    monkeypatch.setattr(update, "insertion", seen)
    before = index.open_index(spark, path)
    index.insert(path, base.where("id >= 140"))
    assert len(plans) == 2 and not any("Aggregate" in p or "Join" in p for p in plans)
    at = before.settled("topology", "codes")
    for name in ("topology", "codes", "tombstones"):
        assert sorted(map(str, getattr(at, name).collect())) == sorted(map(str, getattr(before, name).collect()))
    now = index.open_index(spark, path)
    assert {r["id"] for r in now.topology.collect()} == set(range(160)) and {r["id"] for r in now.tombstones.collect()} == {3, 125}
