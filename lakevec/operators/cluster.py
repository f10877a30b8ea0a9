"""Means, medoid, k-means and the partitioning of a base into overlapping shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevec.functions.storage import stored, work_folder
from lakevec.operators.metrics import SOUND, distances, l2sq, matrix


def mean_vector(base: DataFrame) -> DataFrame:
    """(dim, mean): the mean of each dimension, from 0. Sums combine before the shuffle."""
    return base.where(SOUND.format("vec")).select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def medoid(base: DataFrame) -> DataFrame:
    """(id, dist): the row nearest to the mean, ties by id."""
    mean = mean_vector(base).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("centre"))
    near = base.where(SOUND.format("vec")).crossJoin(F.broadcast(mean)).select("id", l2sq(F.col("vec"), F.col("centre")).alias("dist"))
    return near.orderBy("dist", "id").limit(1)


def assign(base: DataFrame, centres: np.ndarray, k: int = 1) -> DataFrame:
    """(id, vec, rank, centre, dist): each row's k nearest centres. The centres are a bounded table and travel with the tasks."""
    sent = base.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, c = matrix(b.column("vec")), sent.value
            m = min(k, len(c))
            dist = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2) if len(x) * c.size < 4_000_000 else distances(x, c)
            near = np.argsort(dist, axis=1, kind="stable")[:, :m]
            at = np.repeat(np.arange(len(x)), m)
            cols = [b.column("id").take(pa.array(at)), b.column("vec").take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(near.ravel().astype(np.int32)), pa.array(dist[at, near.ravel()])]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "vec", "rank", "centre", "dist"])

    rows = base.where(SOUND.format("vec")).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "id long, vec array<double>, rank int, centre int, dist double")


def lloyd_step(base: DataFrame, centres: np.ndarray) -> DataFrame:
    """(centre, dim, mean, n): one round: assign, then average; a centre without rows has none."""
    near = assign(base, centres).select("centre", F.posexplode("vec").alias("dim", "x"))
    return near.groupBy("centre", "dim").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


#: Rounds of oversampling, and rows that a round takes for each centre, about.
OVERSAMPLING = (5, 2.0)


def cost(base: DataFrame, centres: np.ndarray) -> float:
    """The sum of the squared distances of all rows to their nearest centre."""
    return assign(base, centres).agg(F.coalesce(F.sum("dist"), F.lit(0.0))).first()[0]


def parallel_seeds(base: DataFrame, k: int, seed: int = 42, rounds: int = OVERSAMPLING[0], factor: float = OVERSAMPLING[1]) -> np.ndarray:
    """k starting centres of a base of any size, far from one another (k-means||).

    From one row on, each round takes every row with a probability of factor k
    times its share of the cost so far, by a hash of its id. Each row knows the
    distance to the nearest row taken, which is updated by a round's own rows alone. What
    was taken, about rounds factor k rows, is weighed by the rows nearest to it
    and reduced to k locally: each next one with a probability by weight and squared distance, then
    weighted means in rounds, since rows that were taken for lying far off cost more than random ones where there are no clusters.
    """
    spark = base.sparkSession
    folder = work_folder(spark, "seeds")
    rows = base.where(SOUND.format("vec")).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    rows = stored(rows, f"{folder}/rows")
    new = matrix(rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).select("vec").toArrow().column("vec"))
    if not len(new):
        raise ValueError("no vectors")
    taken, known = [new], rows.withColumn("near", F.lit(float("inf")))
    for r in range(rounds):
        known = stored(_nearer(known, new), f"{folder}/near-{r}")
        total = known.agg(F.sum("near")).first()[0] or 0.0
        if total <= 0:
            break
        chance = F.pmod(F.xxhash64("id", F.lit(seed + 1 + r)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        new = matrix(known.where(chance < F.col("near") * F.lit(factor * k / total)).select("vec").toArrow().column("vec"))
        if len(new):
            taken.append(new)
    points = np.unique(np.concatenate(taken), axis=0)
    sizes = assign(rows, points).groupBy("centre").agg(F.count("*").alias("n")).toPandas()
    weights = np.zeros(len(points))
    weights[sizes["centre"].to_numpy()] = sizes["n"].to_numpy()
    return _weighted_means(points, weights, seeds(points, k, seed, weights))


def _weighted_means(points: np.ndarray, weights: np.ndarray, centres: np.ndarray, rounds: int = 30) -> np.ndarray:
    """centres moved to the weighted means of the bounded points nearest to them, until they stay; one without weight stays where it is."""
    for _ in range(rounds):
        near = distances(points, centres).argmin(1)
        n, sums = np.bincount(near, weights, len(centres)), np.zeros_like(centres)
        np.add.at(sums, near, points * weights[:, None])
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _nearer(known: DataFrame, new: np.ndarray) -> DataFrame:
    """known (id, vec, near) with near no larger than the squared distance to the nearest of new."""
    if not len(new):
        return known
    sent = known.sparkSession.sparkContext.broadcast(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vec"))
            near = np.minimum(b.column("near").to_numpy(), distances(x, sent.value).min(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(near)], names=["id", "vec", "near"])

    return known.mapInArrow(run, "id long, vec array<double>, near double")


def kmeans(base: DataFrame, k: int, rounds: int = 10, seed: int = 42, tolerance: float = 1e-5, start: str = "parallel") -> np.ndarray:
    """Centres by rounds over the whole base; starts from parallel_seeds or, with start `random`, from rows in the order of a hash. Empty clusters become zero vectors."""
    if start == "parallel":
        centres = parallel_seeds(base, k, seed)
    else:
        centres = matrix(base.where(SOUND.format("vec")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("vec").toArrow().column("vec"))
    last = None
    for _ in range(rounds):
        got = lloyd_step(base, centres).toPandas()
        new = np.zeros_like(centres)
        new[got["centre"].to_numpy(), got["dim"].to_numpy()] = got["mean"].to_numpy()
        moved = float(((new - centres) ** 2).sum())
        centres = new
        if last is not None and moved <= tolerance * max(float((centres**2).sum()), 1e-300):
            break
        last = moved
    return centres


def shards(base: DataFrame, centres: np.ndarray, overlap: int = 2) -> DataFrame:
    """(shard, id, vec): each row in the shards of its nearest centres."""
    return assign(base, centres, overlap).select(F.col("centre").alias("shard"), "id", "vec")


def _start_centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """At most k different centres of a bounded sample."""
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(k, len(c))).astype(int)]
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        n, sums = np.bincount(near, minlength=len(c)), np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def parts(base: DataFrame, folder: str, rows: int = 4096, overlap: int = 1, fan: int = 64, per_centre: int = 16) -> DataFrame:
    """(part, id, vec): base(id, vec) in parts of near rows, at most about so many in each, however large base is.

    Parts that are too large are cut around centres of a sample of theirs, up to
    fan at a time, again and again; in the last cut of a part each row goes to
    its `overlap` nearest pieces. What no centres can part, as equal rows, is cut
    by a hash of the id. A part's rows go through its cut in slices of a hash,
    so a hot part is many tasks.
    """
    spark = base.sparkSession
    open_, done = base.select(F.lit(0).cast("long").alias("part"), "id", "vec"), None
    for level in range(40):
        sizes = stored(open_.groupBy("part").agg(F.count("*").alias("n")), f"{folder}/sizes-{level}")
        fits = open_.join(sizes.where(F.col("n") <= rows).select("part"), "part", "left_semi").select("part", "id", "vec")
        done = fits if done is None else done.unionByName(fits)
        large = sizes.where(F.col("n") > rows)
        if large.limit(1).count() == 0:
            return done
        wanted = F.least(F.lit(fan), F.ceil(F.col("n") * overlap / F.lit(rows * 0.7))).cast("int")
        large = large.select("part", "n", wanted.alias("k"), F.ceil(F.col("n") / F.lit(65_536)).cast("int").alias("slices"), (F.col("n") * overlap <= rows * 0.7 * fan).alias("last"))
        there = open_.join(large, "part")
        spot = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))

        def centres(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("id").to_numpy(), kind="stable")
            c = _start_centres(matrix(table.column("vec"))[order], table.column("k")[0].as_py())
            return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(c)), "centre": pa.array(list(c), pa.list_(pa.float64()))})

        found = there.where(spot * F.col("n") < F.col("k") * per_centre).select("part", "k", "id", "vec").groupBy("part").applyInArrow(centres, "part long, centre array<double>")
        found = stored(found, f"{folder}/centres-{level}")
        # Pieces get new numbers by a hash of the part's and their own; one centre alone can't cut and a hash does.

        def assign(table: pa.Table, known: pa.Table) -> pa.Table:
            ids, part = table.column("id").to_numpy(), table.column("part")[0].as_py() if table.num_rows else 0
            if not len(ids):
                at, piece = np.zeros(0, int), np.zeros(0, np.int64)
            elif known.num_rows < 2:
                at, piece = np.arange(len(ids)), ids % max(2, -(-table.column("n")[0].as_py() // rows))
            else:
                c = matrix(known.column("centre"))
                c = c[np.lexsort(c.T)]
                m = min(overlap if table.column("last")[0].as_py() else 1, len(c))
                near = np.argsort(distances(matrix(table.column("vec")), c), axis=1, kind="stable")[:, :m]
                at, piece = np.repeat(np.arange(len(ids)), m), near.ravel()
            return pa.table({"part": pa.array(np.full(len(at), part)), "piece": pa.array(piece.astype(np.int64)), "id": pa.array(ids[at]), "vec": table.column("vec").take(pa.array(at))})

        left = there.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).select("part", "slice", "n", "last", "id", "vec")
        right = large.select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).join(found, "part", "left").where("centre IS NOT NULL")
        kind = base.schema["vec"].dataType.simpleString()
        cut = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(assign, f"part long, piece long, id long, vec {kind}")
        open_ = stored(cut.select(F.xxhash64("part", "piece", F.lit(level)).alias("part"), "id", "vec"), f"{folder}/parts-{level}")
    raise RuntimeError("parts don't get small enough")


def ram_estimate(n: int, dim: int, size: int, degree: int) -> float:
    """Bytes that a graph over n rows takes in memory."""
    return 1.1 * (n * degree * 4 * 1.3 + n * (-(-dim // 8) * 8) * size)


def seeds(points: np.ndarray, k: int, seed: int = 42, weights: np.ndarray | None = None) -> np.ndarray:
    """k rows of a bounded sample, each new one with a probability by its squared distance to those chosen, times its weight."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(points)))]
    near = distances(points, points[chosen]).ravel()
    while len(chosen) < min(k, len(points)):
        share = near if weights is None else near * weights
        total = share.sum()
        i = int(rng.choice(len(points), p=share / total)) if total > 0 else int(np.setdiff1d(np.arange(len(points)), chosen)[0])
        chosen.append(i)
        near = np.minimum(near, distances(points, points[i : i + 1]).ravel())
    return points[chosen]


def cluster_sizes(base: DataFrame, centres: np.ndarray, overlap: int = 2) -> DataFrame:
    """(shard, n): rows of each shard, counted over all of the base."""
    return shards(base, centres, overlap).groupBy("shard").agg(F.count("*").alias("n"))


def partition_for_memory(base: DataFrame, dim: int, budget: float, degree: int = 32, overlap: int = 2, start: int = 3, most: int = 1024) -> np.ndarray:
    """Centres of as few shards, from `start` on, as bring the largest shard's graph under a memory budget in bytes.

    More than `most` centres don't travel with the tasks; if so many aren't
    enough this raises, and parts() cuts a table of any size.
    """
    k = start
    while True:
        centres = kmeans(base, k, rounds=4)
        largest = cluster_sizes(base, centres, min(overlap, k)).agg(F.max("n")).first()[0] or 0
        if ram_estimate(largest, dim, 4, degree) <= budget:
            return centres
        if k >= most:
            raise ValueError(f"{most} shards don't fit a budget of {budget:.0f} bytes")
        k = min(most, k + max(1, k // 2))
