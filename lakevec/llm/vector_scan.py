"""Approximate nearest neighbours by adaptive dimension scans of inverted lists.

Vectors lie in coarse cells, and in lists inside the cells; both grow as the
fourth root of the table, so lists grow as its square root. A query looks into
its nearest lists, as many as a brute-force comparison of a sample of queries
says that the wanted recall needs. In a list the vectors are rotated and cut
into blocks of columns; after each block, a candidate whose partial distance is
already too large for its share of dimensions, by the test of the rotated
coordinates against the best distances so far, is abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakevec.llm.common import discard, stored, work_folder

#: Bounds: rows and bytes that cells are learned from, rows for each centre of a list, queries that the probed lists are calibrated on.
MAX_SAMPLE, MAX_BYTES, PER_CENTRE, CALIBRATION = 16_384, 64 << 20, 16, 128
#: First bounds come from one in so many rows, of the sample at most: the scan itself has to find the rest.
BOUND_SHARE = 16
#: Recall aimed at in calibration of lists and of cells, columns of a block, strictness of the test.
TARGET, CELL_TARGET, BLOCK, EPSILON = 0.97, 0.998, 16, 2.4
#: Rows and queries that one task holds of a list, and rows of a cell.
PART, ASKED, CELL_PART = 4096, 4096, 65_536

def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(rows: DataFrame) -> DataFrame:
    """(id, vec): rows with an id and a vector that is neither null nor zero, without null or non-finite components, of the most common length."""
    v = F.col("vec")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & sound)
    size = rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return rows.where(F.size("vec") == (size["size"] if size else 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def centres_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k different centres of the sample: starts are different rows, as equal centres would part equal vectors by rounding."""
    rng = np.random.default_rng(11)
    starts = np.unique(sample, axis=0)
    c = starts[rng.choice(len(starts), min(k, len(starts)), replace=False)]
    k = len(c)
    for _ in range(rounds):
        near = _distances(sample, c).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def scan(q: np.ndarray, own: int, bound: float, ids: np.ndarray, x: np.ndarray, turned: list[np.ndarray], k: int, rotation: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of a part of a list, of those within the bound: (rows, distances), by distance and id."""
    d = x.shape[1]
    turned_q = q @ rotation
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    for lo in range(0, len(ids), 256):
        alive = np.arange(lo, min(lo + 256, len(ids)))
        partial, seen = np.zeros(len(alive)), 0
        for block in turned:
            piece = block[alive] - turned_q[seen : seen + block.shape[1]]
            partial = partial + np.einsum("ij,ij->i", piece, piece)
            seen += block.shape[1]
            # Of a vector at the bound, this much of the squared distance is seen by now with near certainty.
            most = bound * bound * (seen / d) * (1 + epsilon / seen**0.5) ** 2 if seen < d else bound * bound
            stay = partial <= most * (1 + 1e-9) + 1e-12
            alive, partial = alive[stay], partial[stay]
            if not len(alive):
                break
        alive = alive[ids[alive] != own]
        if len(alive):
            exact = np.sqrt(((x[alive] - q) ** 2).sum(1))
            best_d, best_i = np.append(best_d, exact), np.append(best_i, alive)
            top = np.lexsort((ids[best_i], best_d))[:k]
            best_d, best_i = best_d[top], best_i[top]
            if len(best_d) == k:
                bound = min(bound, best_d[-1])
    return best_i, best_d


def _shares(table: DataFrame, keys: list[str], rows: int, name: str) -> DataFrame:
    """(keys, name): into how many parts of about so many rows each group is cut."""
    return table.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias(name))


def lists_of(base: DataFrame, centres: np.ndarray, per_cell: int, folder: str, kept: str) -> tuple[DataFrame, DataFrame]:
    """(lists, listed): centres (cell, list, centre) inside the cells, and the rows of base with their cell and list.

    A cell's centres come from PER_CENTRE rows for each, picked by a hash. Cells
    are cut into parts by a hash of the id, so many equal vectors are no hot group.
    """
    spark = base.sparkSession
    sent = spark.sparkContext.broadcast(centres)

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                s = b.slice(lo, 2048)
                near = _distances(vectors(s.column("vec")), sent.value).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([s.column("id"), s.column("vec"), pa.array(near)], names=["id", "vec", "cell"])

    cells = stored(base.mapInArrow(to_cell, f"id long, vec {kept}, cell int"), f"{folder}/cells")
    counts = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    sizes = spark.createDataFrame([(c, min(1.0, PER_CENTRE * per_cell / n), -(-n // CELL_PART)) for c, n in counts.items()], "cell int, share double, parts int")
    spot = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def split(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        x, cell = vectors(table.column("vec"))[order], table.column("cell")[0].as_py()
        c = centres_of(x, min(per_cell, len(x)))
        return pa.table({"cell": pa.array([cell] * len(c), pa.int32()), "list": cell * 65_536 + np.arange(len(c)), "centre": pa.array(list(c), pa.list_(pa.float64()))})

    picked = cells.join(F.broadcast(sizes), "cell").where(spot < F.col("share")).select("cell", "id", "vec")
    lists = stored(picked.groupBy("cell").applyInArrow(split, "cell int, list long, centre array<double>"), f"{folder}/centres")

    def to_list(rows: pa.Table, known: pa.Table) -> pa.Table:
        ids, x = rows.column("id").to_numpy(), vectors(rows.column("vec"))
        if len(np.unique(ids)) < len(ids):  # rows that repeat wholly have one id, so they meet here
            first = np.sort(np.unique(np.c_[ids, x.view(np.int64)], axis=0, return_index=True)[1])
            rows, x = rows.take(pa.array(first)), x[first]
        c, names = vectors(known.column("centre")), known.column("list").to_numpy()
        near = np.zeros(len(x), int)
        for lo in range(0, len(x) if len(c) else 0, 2048):
            near[lo : lo + 2048] = _distances(x[lo : lo + 2048], c).argmin(1)
        return pa.table({"id": rows.column("id"), "vec": rows.column("vec"), "cell": rows.column("cell"), "list": names[near] if len(c) else rows.column("cell").to_numpy().astype(np.int64) * 65_536})

    parts = cells.join(F.broadcast(sizes.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = lists.join(F.broadcast(sizes.select("cell", "parts")), "cell").select("cell", "list", "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    listed = parts.select("cell", "part", "id", "vec").groupBy("cell", "part").cogroup(every.groupBy("cell", "part"))
    listed = stored(listed.applyInArrow(to_list, f"id long, vec {kept}, cell int, list long"), f"{folder}/lists")
    discard(spark, f"{folder}/cells")
    return lists, listed


def search(base: DataFrame, queries: DataFrame, k: int = 10, target: float = TARGET, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, by distance, ties by less id.

    base and queries have id and vec. Rows that aren't `usable` take no part;
    base rows with a query's id are its own and no answer to it. Rows of base
    that repeat wholly are one candidate, queries that repeat are asked once.
    score is the Euclidean distance of the vectors as given, in double
    precision. Empty tables give an empty result; extra columns are left out.

    Cells, first bounds and the number of cells and lists to look into come from
    samples of bounded size; every usable row is in a list. Lists and the
    queries that look into one are cut into parts by hashes, so neither many
    equal vectors nor many queries of one list are a hot group.
    """
    spark = base.sparkSession
    folder = work_folder(spark, "vectors")
    kind = "query_id long, rank int, vec_id long, score double"
    # Vectors stay as narrow as given; tasks widen them.
    kept = "array<float>" if base.schema["vec"].dataType.simpleString() == queries.schema["vec"].dataType.simpleString() == "array<float>" else "array<double>"
    base = usable(base.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(kept).alias("vec")))
    queries = queries.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(kept).alias("vec"))
    n = base.count()
    if not n:
        return spark.createDataFrame([], kind)
    d = base.selectExpr("size(vec) AS d").first()["d"]
    usable_queries = stored(usable(queries).where(F.size("vec") == d).distinct(), f"{folder}/queries")
    spot = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30))
    most = max(64, min(MAX_SAMPLE, MAX_BYTES // (8 * d)))
    rows = base.where(spot <= int(min(1.0, most / n) * (1 << 30))).orderBy("id").limit(2 * most).toArrow()
    if not rows.num_rows:
        rows = base.orderBy("id").limit(most).toArrow()
    sample_ids, sample = rows.column("id").to_numpy(), vectors(rows.column("vec"))
    per_cell = max(1, round(n**0.25))
    centres = centres_of(sample, min(per_cell, len(sample)))
    rotation = np.linalg.qr(np.random.default_rng(5).standard_normal((d, d)))[0]
    lists, listed = lists_of(base, centres, per_cell, folder, kept)

    # The cells and lists to look into: enough that the true neighbours of the calibration queries lie there.
    few = usable_queries.orderBy(F.xxhash64("id", F.lit(9))).limit(CALIBRATION).toArrow()
    few_ids, few_vecs = few.column("id").to_numpy(), vectors(few.column("vec"))
    if not len(few_ids):
        return spark.createDataFrame([], kind)

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x, cell, near = b.column("id").to_numpy(), vectors(b.column("vec")), b.column("cell").to_numpy(), b.column("list").to_numpy()
            dist = _distances(few_vecs, x)
            dist[few_ids[:, None] == ids[None, :]] = np.inf
            m = min(k, len(ids))
            top = np.argpartition(dist, m - 1, axis=1)[:, :m]
            q, top = np.repeat(np.arange(len(few_ids)), m), top.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[top]), pa.array(dist[q, top]), pa.array(cell[top]), pa.array(near[top])], names=["q", "id", "dist", "cell", "list"])

    def least(needed: np.ndarray, share: float) -> int:
        needed = np.sort(needed)
        return int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))) - 1)]) if len(needed) else 1

    best = listed.mapInArrow(truth, "q long, id long, dist double, cell int, list long")
    best = best.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("dist", "id"))).where(f"r <= {k} AND dist < double('infinity')")
    best = stored(best.select("q", "cell", "list"), f"{folder}/truth")
    order = _distances(few_vecs, centres).argsort(1, kind="stable").argsort(1) + 1
    true = best.toPandas()  # k rows for each calibration query
    n_cells = least(order[true["q"].to_numpy(), true["cell"].to_numpy()], CELL_TARGET)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, names = b.column("cell").to_numpy(), b.column("list").to_numpy()
            q, at = np.nonzero(order[:, cell] <= n_cells)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(names[at]), pa.array(_distances(few_vecs, vectors(b.column("centre")))[q, at])], names=["q", "list", "dist"])

    by_list = lists.mapInArrow(ranks, "q long, list long, dist double").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("dist", "list")))
    probes = least(best.join(by_list, ["q", "list"]).select("r").toPandas()["r"].to_numpy(), target)

    # Each query to its nearest cells, from there to the nearest of their lists, with a first bound from a few rows that lie in its cells.
    few_rows = np.flatnonzero(np.arange(len(sample)) % BOUND_SHARE == 0)
    sent = spark.sparkContext.broadcast((centres, rotation, sample[few_rows], sample_ids[few_rows]))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                s = b.slice(lo, 1024)
                near = _distances(vectors(s.column("vec")), sent.value[0]).argsort(1, kind="stable")[:, :n_cells].astype(np.int32)
                at = pa.array(np.repeat(np.arange(s.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([s.column("id").take(at), s.column("vec").take(at), pa.array(near.ravel())], names=["id", "vec", "cell"])

    def to_lists(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows or not known.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "list": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        dist, names = _distances(vectors(asked.column("vec")), vectors(known.column("centre"))), known.column("list").to_numpy()
        top = dist.argsort(1, kind="stable")[:, :probes]
        at = np.repeat(np.arange(len(dist)), top.shape[1])
        return pa.table({"id": asked.column("id").to_numpy()[at], "list": names[top.ravel()], "dist": dist[at, top.ravel()]})

    routed = stored(usable_queries.mapInArrow(to_cells, f"id long, vec {kept}, cell int"), f"{folder}/asked")
    blocks = _shares(routed, ["cell"], ASKED, "blocks")
    left = routed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("cell", "block", "id", "vec")
    right = lists.join(blocks, "cell").select("cell", "list", "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    routes = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(to_lists, "id long, list long, dist double")
    routes = routes.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("dist", "list"))).where(F.col("r") <= probes).select("id", "list")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _, some, some_ids = sent.value
        cell = _distances(some, centres).argmin(1)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                v, ids = vectors(s.column("vec")), s.column("id").to_numpy()
                dist = _distances(v, some)
                near = np.zeros((len(ids), len(centres)), bool)
                np.put_along_axis(near, _distances(v, centres).argsort(1, kind="stable")[:, :n_cells], True, axis=1)
                dist[(ids[:, None] == some_ids[None, :]) | ~near[:, cell]] = np.inf
                bound = np.sqrt(np.partition(dist, k - 1, axis=1)[:, k - 1]) * 1.02 + 1e-6 if len(some) >= k else np.full(len(ids), np.inf)
                yield pa.RecordBatch.from_arrays([s.column("id"), s.column("vec"), pa.array(bound)], names=["id", "vec", "bound"])

    asked = usable_queries.mapInArrow(bounded, f"id long, vec {kept}, bound double").join(routes, "id")
    asked = stored(asked, f"{folder}/routes")
    parts = _shares(listed, ["list"], PART, "parts").join(_shares(asked, ["list"], ASKED, "blocks"), "list")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = listed.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("list", "part", every("blocks").alias("block"), "id", "vec")
    left = asked.join(parts, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("list", every("parts").alias("part"), "block", "id", "vec", "bound")

    def look(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and rows.num_rows:
            rotation = sent.value[1]
            x, ids = vectors(rows.column("vec")), rows.column("id").to_numpy()
            turned = x @ rotation
            blocks = [np.ascontiguousarray(turned[:, i : i + BLOCK]) for i in range(0, d, BLOCK)]
            for q, own, bound in zip(vectors(asked.column("vec")), asked.column("id").to_numpy(), asked.column("bound").to_numpy(), strict=True):
                i, dist = scan(q, own, bound, ids, x, blocks, k, rotation, epsilon)
                out.append((np.full(len(i), own), ids[i], dist))
        q, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    keys, n_parts = ["list", "part", "block"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(n_parts, *keys), right.repartition(n_parts, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vec")
    return search(rows, rows.where("id % 100 = 0"))
