import numpy as np

from lakevec.operators import cluster


def test_seeds_cost_less_than_random_rows_where_there_are_no_clusters(spark):
    x = np.random.default_rng(1).standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.repeat(x, 3, axis=0))], "id long, vec array<double>")
    for seed in (42, 1, 2, 3):
        found = cluster.parallel_seeds(base, 16, seed)
        assert found.shape == (16, 64)
        assert cluster.cost(base, found) < cluster.cost(base, cluster.kmeans(base, 16, rounds=0, seed=seed, start="random"))
