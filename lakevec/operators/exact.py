"""Exact k nearest neighbours, truth sets, and the recall of approximate answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakevec.operators.metrics import SOUND, distances, matrix

#: Bytes of the base that one task holds; more make more parts.
BASE_BYTES = 64 << 20
#: A graph of all rows deals either side to a part for so many rows, up to so many parts; beyond that only BASE_BYTES adds any.
CELL_ROWS, MAX_CELLS = 8192, 16


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, dist): the first k by (dist, id), each id once a query."""
    order = F.row_number().over(W.partitionBy("qid").orderBy("dist", "id"))
    return found.select("qid", "id", "dist").distinct().withColumn("rank", order).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def nearest(qid: np.ndarray, qvec: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int, metric: str, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, ids, distances): of each query the k least distances to the rows of a part, ties by id."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, 4_000_000 // max(1, len(ids)))
    for lo in range(0, len(qid) if len(ids) else 0, step):
        dist = distances(qvec[lo : lo + step], vecs, metric)
        if exclude_self:
            dist[qid[lo : lo + step, None] == ids[None, :]] = np.inf
        m = min(k, len(ids))
        limit = np.partition(dist, m - 1, axis=1)[:, m - 1 : m]
        i, j = np.nonzero((dist <= limit + 1e-9 * (1 + np.abs(limit))) & np.isfinite(dist))
        exact = ((qvec[lo + i] - vecs[j]) ** 2).sum(1) if metric == "l2" else dist[i, j]
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((qid[lo + i[keep]], ids[j[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def met_in_parts(known: DataFrame, asked: DataFrame, parts: int, answer: Callable[[dict, dict], tuple], schema: str, splits: int = 1) -> DataFrame:
    """What answer(known, asked) gives for every part of one table and all rows of the other; both have id and columns of arrays.

    known is dealt to parts by a hash of id and moves once; asked goes to every
    part. Long tables of asked rows are dealt to splits too: then each part of
    known moves once for every split, and a task meets one with the other. A task holds one part as arrays, as rows are sorted by part and side,
    and the asked rows stream past it in Arrow batches: neither side's size
    bounds the other's. Rows of one id and the same values come once on either
    side, so an id that repeats is never held. answer gets and gives numpy
    arrays by name; asked rows that meet an empty part are passed over.
    """

    def sided(df: DataFrame, part: Column, side: int) -> DataFrame:
        same = F.xxhash64(*[c for c in df.columns if c != "id"])
        return df.withColumn("part", part).withColumn("side", F.lit(side)).withColumn("same", same)

    values = [[c for c in df.columns if c != "id"] for df in (known, asked)]
    mine, its = (F.pmod(F.xxhash64("id"), F.lit(n)).cast("int") for n in (parts, splits))
    left = sided(known, F.explode(F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), lambda j: mine * splits + j)), 0)
    right = sided(asked, F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: i * splits + its)), 1)
    rows = left.unionByName(right, allowMissingColumns=True).repartitionById(parts * splits, F.col("part")).sortWithinPartitions("side", "id", "same")
    names = [c.split()[0] for c in schema.split(", ")]

    def first_ones(piece: pa.RecordBatch, columns: list[str], before: dict | None) -> tuple[dict, dict]:
        """The piece as arrays without rows that equal the one before, and its last row."""
        got = {"id": piece.column("id").to_numpy(), **{c: matrix(piece.column(c)) for c in columns}}
        fresh = np.ones(piece.num_rows, bool)
        if before is not None:
            fresh[0] = any(not np.array_equal(got[c][0], before[c]) for c in got)
        fresh[1:] = got["id"][1:] != got["id"][:-1]
        for c in columns:
            fresh[1:] |= (got[c][1:] != got[c][:-1]).any(1)
        return {c: v[fresh] for c, v in got.items()}, {c: v[-1] for c, v in got.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table, last = [], None, [None, None]
        for batch in batches:
            cut = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            for side, piece in ((0, batch.slice(0, cut)), (1, batch.slice(cut))):
                if not piece.num_rows:
                    continue
                got, last[side] = first_ones(piece, values[side], last[side])
                if side == 0:
                    held.append(got)
                elif held and len(got["id"]):
                    table = table or {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in answer(table, got)], names=names)

    return rows.mapInArrow(run, schema)


def blocks_of(rows: DataFrame, column: str, size: int) -> int:
    """How many parts of about that many bytes the vectors of a column fill."""
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("d")).first()
    return max(1, -(-shape["n"] * (shape["d"] or 0) * 8 // size))


def knn(queries: DataFrame, base: DataFrame, k: int = 10, metric: str = "l2", exclude_self: bool = False, splits: int = 1) -> DataFrame:
    """(qid, rank, id, dist): the k least distances of each query, ties by id.

    queries has qid and qvec, base id and vec. Queries stream past parts of the
    base (met_in_parts), as matrix products; k rows of a query leave a task, and
    a ranking merges them. splits deals the queries to more tasks, and the base to
    as many parts at least. No vector comes to the driver. Null vectors, empty
    ones and ones with nulls take no part; rows that repeat count once.
    """
    q = queries.where(SOUND.format("qvec")).select(F.col("qid").cast("long").alias("id"), "qvec")
    rows = base.where(SOUND.format("vec")).select(F.col("id").cast("long").alias("id"), "vec")

    def near(known: dict, asked: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return nearest(asked["id"], asked["qvec"], known["id"], known["vec"], k, metric, exclude_self)

    parts = max(splits, blocks_of(rows, "vec", BASE_BYTES))
    return ranked(met_in_parts(rows, q, parts, near, "qid long, id long, dist double", splits), k)


def neighbour_graph(base: DataFrame, k: int) -> DataFrame:
    """topology (id, nbrs) of each row's k nearest other rows, nearest first, ties by id.

    All rows are compared with all, so work grows with the square of the table;
    a task meets one part of the rows with another.
    """
    splits = min(MAX_CELLS, max(1, -(-base.count() // CELL_ROWS)))
    near = knn(base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), base, k, exclude_self=True, splits=splits)
    lists = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("n"))
    return lists.select(F.col("qid").alias("id"), F.transform("n", lambda x: x["id"]).alias("nbrs"))


def window_truth(truth: DataFrame, start: int, end: int, k: int) -> DataFrame:
    """The first k of a deep truth set whose ids lie in [start, end): the truth of a sliding window."""
    return ranked(truth.where((F.col("id") >= start) & (F.col("id") < end)), k)


def active_recall(truth: DataFrame, found: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """recall() among live ids: truth and answers without the others, ranked anew."""

    def left(df: DataFrame) -> DataFrame:
        return ranked(df.join(live.select("id").distinct(), "id", "left_semi"), 2**31 - 1)

    return recall(left(truth), left(found), k)


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row, recall: the percentage of the first k found that are true; ids as near as the k-th true one count too.

    Restrict it to live tags by a semi-join of both before.
    """
    last = truth.where(F.col("rank") == k).select("qid", F.col("dist").alias("last"))
    true = truth.join(last, "qid", "left").where((F.col("rank") <= k) | (F.col("dist") == F.col("last"))).select("qid", "id").distinct()
    got = found.where(F.col("rank") <= k).select("qid", "id").distinct()
    hits = true.join(got, ["qid", "id"], "left_semi").agg(F.count("*").alias("hits"))
    return hits.crossJoin(truth.agg(F.countDistinct("qid").alias("n"))).select((F.lit(100.0) * F.col("hits") / F.nullif(F.col("n") * k, F.lit(0))).alias("recall"))
