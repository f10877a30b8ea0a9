import numpy as np

from lakevec.operators import graph


def test_no_vector_of_the_node_itself_is_shuffled_with_its_pairs(spark, monkeypatch):
    x = np.random.default_rng(2).standard_normal((60, 6))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    pairs = spark.createDataFrame([(i, j) for i in range(60) for j in range(60)], "id long, nbr long")
    monkeypatch.setattr(graph, "FEW", 0)
    before, got = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), None
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists = graph.candidate_lists(pairs, base, 9)
        plan = lists._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: [(c["nbr"], round(c["dist"], 9)) for c in r["c"]] for r in lists.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 4  # pairs and rows, by nbr and by id; none after
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == {i: [(int(j), round(float(row[j]), 9)) for j in np.argsort(row)[:9]] for i, row in enumerate(d)}
