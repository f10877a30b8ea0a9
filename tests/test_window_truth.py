import numpy as np

from lakevec import catalog


def test_window_truth_is_whole_on_a_larger_table(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((6000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in catalog.QUERIES["window_truth"](spark, str(tmp_path)).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    d = ((x[::50, None].astype(float) - x[None, 100:400]) ** 2).sum(2)
    assert got == {50 * q: (100 + np.argsort(row, kind="stable")[:10]).tolist() for q, row in enumerate(d)}
    trace = catalog.QUERIES["update_trace_by_size"](spark, str(tmp_path))
    assert {(r["step"], r["op"]): r["count"] for r in trace.groupBy("step", "op").count().collect()} == {(s, op): 300 for s in range(8) for op in ("insert", "delete")}
