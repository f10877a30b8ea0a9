"""Product quantization: training, codes, table distances, and a second codebook for rows that the first codes badly.

A codebook is a DataFrame (chunk, code, sub); codes are (id, chunk, code) rows
or, packed, (id, codes). Codebooks have at most 256 codes a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakevec.operators.cluster import seeds
from lakevec.operators.exact import met_in_parts, ranked
from lakevec.operators.metrics import SOUND, l2sq, matrix

CODES, MAX_TRAIN = 256, 256_000


def chunk_bounds(dim: int, chunks: int) -> list[tuple[int, int]]:
    """(start, size) of each chunk: neighbours of even size, the first dim mod chunks one wider."""
    small, wide = divmod(dim, chunks)
    sizes = [small + (i < wide) for i in range(chunks)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def chunk_count(budget: float, n: int, dim: int) -> int:
    """Chunks that a memory budget in bytes leaves to each row: 1 to 128 and at most dim."""
    return int(max(1, min(budget // max(n, 1), dim, 128)))


def split(base: DataFrame, dim: int, chunks: int) -> DataFrame:
    """(id, chunk, sub): rows cut into chunks."""
    cuts = F.array(*[F.struct(F.lit(i).alias("chunk"), F.slice("vec", s + 1, n).cast("array<double>").alias("sub")) for i, (s, n) in enumerate(chunk_bounds(dim, chunks))])
    return base.where(SOUND.format("vec")).select("id", F.explode(cuts).alias("c")).select("id", "c.chunk", "c.sub")


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    return _lloyd(x, x[np.linspace(0, len(x) - 1, k).astype(int)].copy(), rounds)


def _lloyd(x: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
    k = len(c)
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], 0.0)
    return c


def train(base: DataFrame, dim: int, chunks: int, codes: int = CODES, rounds: int = 15, max_train: int = MAX_TRAIN) -> DataFrame:
    """A codebook, each chunk trained by itself on the same sample of at most about max_train rows."""
    n = base.count()
    share = min(1.0, max_train / max(n, 1))
    sample = base if share == 1 else base.where(F.pmod(F.xxhash64("id", F.lit(42)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("id")["sub"])
        c = _kmeans(x, min(codes, len(x)), rounds)
        return pd.DataFrame({"chunk": key[0], "code": np.arange(len(c), dtype=np.int32), "sub": list(c)})

    return split(sample, dim, chunks).groupBy("chunk").applyInPandas(run, "chunk int, code int, sub array<double>")


def encode(parts: DataFrame, book: DataFrame) -> DataFrame:
    """(id, chunk, code, err): the nearest code of each part, ties to the less code. The codebook is bounded and travels along."""
    table = {int(c): (g.sort_values("code")["code"].to_numpy(), np.stack(g.sort_values("code")["sub"])) for c, g in book.toPandas().groupby("chunk")}
    sent = parts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk = b.column("chunk").to_numpy()
            for c in np.unique(chunk):
                part = b.filter(pa.array(chunk == c))
                codes, centres = sent.value[int(c)]
                x = matrix(part.column("sub"))
                dist = ((x[:, None, :] - centres[None]) ** 2).sum(2)
                best = dist.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("chunk"), pa.array(codes[best].astype(np.int32)), pa.array(dist[np.arange(len(x)), best])], names=["id", "chunk", "code", "err"])

    return parts.select(F.col("id").cast("long").alias("id"), F.col("chunk").cast("int").alias("chunk"), "sub").mapInArrow(run, "id long, chunk int, code int, err double")


def lookup(query_parts: DataFrame, book: DataFrame) -> DataFrame:
    """(qid, chunk, code, d): squared distances of a query's parts to all codes of their chunk."""
    q = query_parts.select(F.col("id").alias("qid"), "chunk", F.col("sub").alias("qsub"))
    return q.join(F.broadcast(book), "chunk").select("qid", "chunk", "code", l2sq(F.col("qsub"), F.col("sub")).alias("d"))


def packed(codes: DataFrame) -> DataFrame:
    """(id, codes[, books]): the codes of a row as an array, chunk by chunk."""
    fields = ["chunk", "code"] + (["book"] if "book" in codes.columns else [])
    rows = codes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
    return rows.select("id", F.col("c.code").alias("codes"), *([F.col("c.book").alias("books")] if "book" in fields else []))


def query_tables(table: DataFrame) -> DataFrame:
    """(qid, lut): a query's table distances (qid, chunk, code, d[, book]) as one array, by chunk, book and code.

    All queries must have the same codes of each chunk, numbered from 0.
    """
    book = F.col("book") if "book" in table.columns else F.lit(0)
    rows = table.select("qid", F.struct("chunk", book.alias("book"), "code", "d").alias("x"))
    return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]).alias("lut"))


def adc(table: DataFrame, codes: DataFrame, k: int, n_codes: int) -> DataFrame:
    """(qid, rank, id, dist): of each query the k rows of the least table distances summed over their codes, ties by id.

    table is that of lookup() with n_codes codes a chunk, codes (id, chunk, code)
    or of dual(); book is part of both or of neither. Queries stream past
    parts of the packed codes, as in exact.knn: k rows of a query leave a task.
    """
    books = 2 if "book" in codes.columns else 1
    luts, rows = query_tables(table).withColumnRenamed("qid", "id"), packed(codes)

    def near(known: dict, asked: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        ids, code = known["id"], known["codes"].astype(int)
        book = known["books"].astype(int) if books == 2 else 0
        spot = (np.arange(code.shape[1]) * books + book) * n_codes + code
        for q, lut in zip(asked["id"], asked["lut"], strict=True):
            dist = lut[spot].sum(1)
            top = np.lexsort((ids, dist))[:k] if len(ids) <= 4 * k else _least(dist, ids, k)
            out.append((np.full(len(top), q), ids[top], dist[top]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return ranked(met_in_parts(rows, luts, max(1, -(-rows.count() // 262_144)), near, "qid long, id long, dist double"), k)


def _least(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least, ties by id."""
    at = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
    return at[np.lexsort((ids[at], dist[at]))[:k]]


def rerank(found: DataFrame, queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, dist): answers found by codes, by their exact distances."""
    pairs = found.select("qid", "id").join(queries.select("qid", "qvec"), "qid").join(base.select("id", "vec"), "id")
    return ranked(pairs.select("qid", "id", l2sq(F.col("qvec"), F.col("vec")).alias("dist")), k)


def decoded(codes: DataFrame, book: DataFrame) -> DataFrame:
    """(id, vec): the vectors that codes (id, chunk, code) stand for. Their distances are those between the codes."""
    rows = codes.select("id", "chunk", "code").join(book.select("chunk", "code", "sub"), ["chunk", "code"])
    return rows.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sub"))), lambda x: x["sub"])).alias("vec"))


def centres(book: DataFrame) -> list[np.ndarray]:
    """Of each chunk the codes' centres, by code. Codebooks are bounded."""
    out = []
    for _, g in book.toPandas().groupby("chunk"):
        rows = np.stack(g["sub"])
        table = np.zeros((int(g["code"].max()) + 1, rows.shape[1]))
        table[g["code"].to_numpy()] = rows
        out.append(table)
    return out


def decode(codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """The vectors that packed codes stand for."""
    codes = codes.astype(int)
    return np.concatenate([t[codes[:, i]] for i, t in enumerate(tables)], axis=1) if len(codes) else np.zeros((0, sum(t.shape[1] for t in tables)))


def sdc_table(book: DataFrame) -> DataFrame:
    """(chunk, c1, c2, d): squared distances between the codes of a chunk."""
    a = book.select("chunk", F.col("code").alias("c1"), F.col("sub").alias("s1"))
    b = book.select("chunk", F.col("code").alias("c2"), F.col("sub").alias("s2"))
    return a.join(b, "chunk").select("chunk", "c1", "c2", l2sq(F.col("s1"), F.col("s2")).alias("d"))


def sdc(pairs: DataFrame, codes: DataFrame, table: DataFrame) -> DataFrame:
    """(a, b, dist): code distances of stored rows."""
    left = pairs.join(codes.select(F.col("id").alias("a"), "chunk", F.col("code").alias("c1")), "a")
    both = left.join(codes.select(F.col("id").alias("b"), "chunk", F.col("code").alias("c2")), ["b", "chunk"])
    return both.join(F.broadcast(table), ["chunk", "c1", "c2"]).groupBy("a", "b").agg(F.sum("d").alias("dist"))


def worst(codes: DataFrame, share: float = 0.2, most: int = MAX_TRAIN, steps: int = 1024) -> DataFrame:
    """(id, chunk): in each chunk the share of rows of the largest errors, ties by id, at least one.

    A histogram of each chunk's errors, taken twice, says which rows are surely
    in; only those of the bin of a bin where the share ends are ranked.
    """
    spans = codes.groupBy("chunk").agg(F.count("*").alias("n"), F.min("err").alias("lo"), F.max("err").alias("hi"))
    wanted = F.least(F.greatest(F.floor(F.col("n") * F.lit(share)), F.lit(1)), F.lit(most))
    spans = spans.select("chunk", wanted.alias("wanted"), "lo", "hi")
    inside, sure = codes.select("id", "chunk", "err").join(spans, "chunk"), None
    for _ in range(2):
        width = F.greatest((F.col("hi") - F.col("lo")) / F.lit(steps), F.lit(1e-300))
        inside = inside.withColumn("bin", F.least(F.floor((F.col("err") - F.col("lo")) / width), F.lit(steps - 1)).cast("int"))
        bins = inside.groupBy("chunk", "bin").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted"), F.min("err").alias("lo2"), F.max("err").alias("hi2"))
        upto = F.sum("n").over(W.partitionBy("chunk").orderBy(F.desc("bin")))  # at most `steps` rows for each chunk
        bins = bins.withColumn("upto", upto).withColumn("left", F.col("wanted") - (F.col("upto") - F.col("n"))).where("left > 0")
        bins = bins.select("chunk", "bin", "left", "lo2", "hi2", (F.col("n") <= F.col("left")).alias("whole"))
        found = inside.drop("wanted", "lo", "hi").join(bins, ["chunk", "bin"])
        taken = found.where("whole").select("id", "chunk")
        sure = taken if sure is None else sure.unionByName(taken)
        inside = found.where("NOT whole").select("id", "chunk", "err", F.col("left").alias("wanted"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))
    rank = F.row_number().over(W.partitionBy("chunk").orderBy(F.desc("err"), "id"))
    return sure.unionByName(inside.withColumn("rank", rank).where(F.col("rank") <= F.col("wanted")).select("id", "chunk"))


def refine(parts: DataFrame, first: DataFrame, codes: int = CODES, rounds: int = 15, share: float = 0.2) -> DataFrame:
    """A second codebook, trained on the rows that the first codes worst, chunk by chunk."""
    bad = parts.join(worst(first, share), ["id", "chunk"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("id")["sub"])
        c = _kmeans(x, min(codes, len(x)), rounds)
        return pd.DataFrame({"chunk": key[0], "code": np.arange(len(c), dtype=np.int32), "sub": list(c)})

    return bad.groupBy("chunk").applyInPandas(run, "chunk int, code int, sub array<double>")


def merged_book(parts: DataFrame, first: DataFrame, second: DataFrame, codes: int = CODES, rounds: int = 15, max_train: int = MAX_TRAIN, seed: int = 42) -> DataFrame:
    """One codebook of `codes` codes out of two: starts are picked among both books' codes by their distances, then averaged over a sample of all rows."""
    n = parts.select("id").distinct().count()
    share = min(1.0, max_train / max(n, 1))
    sample = parts.where(F.pmod(F.xxhash64("id", F.lit(43)), F.lit(1 << 30)) < int(share * (1 << 30)))
    books = first.select("chunk", "sub").unionByName(second.select("chunk", "sub"))

    def run(key, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(starts):
            return pd.DataFrame({"chunk": [], "code": [], "sub": []})
        x, c = np.stack(rows.sort_values("id")["sub"]), np.unique(np.stack(starts["sub"]), axis=0)
        c = _lloyd(x, seeds(c, codes, seed), rounds)
        return pd.DataFrame({"chunk": key[0], "code": np.arange(len(c), dtype=np.int32), "sub": list(c)})

    return sample.groupBy("chunk").cogroup(books.groupBy("chunk")).applyInPandas(run, "chunk int, code int, sub array<double>")


def dual(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, chunk, book, code, err): of two codings the closer one; book 1 only where it is strictly closer."""
    b = second.select("id", "chunk", F.col("code").alias("code2"), F.col("err").alias("err2"))
    closer = F.col("err2") < F.col("err")
    both = first.join(b, ["id", "chunk"])
    return both.select("id", "chunk", closer.cast("int").alias("book"), F.when(closer, F.col("code2")).otherwise(F.col("code")).alias("code"), F.least("err", "err2").alias("err"))


def dual_from_scratch(base: DataFrame, dim: int, chunks: int, codes: int = CODES) -> tuple[DataFrame, DataFrame]:
    """Two codebooks out of one training with twice the codes: even and odd ones."""
    both = train(base, dim, chunks, 2 * codes)
    half = F.floor(F.col("code") / 2).cast("int").alias("code")
    return tuple(both.where(F.col("code") % 2 == i).select("chunk", half, "sub") for i in (0, 1))


def joined_books(first: DataFrame, second: DataFrame, offset: int = CODES) -> DataFrame:
    """One codebook of two, the second's codes behind the first's `offset`: its sdc_table also has the distances across."""
    return first.select("chunk", "code", "sub").unionByName(second.select("chunk", (F.col("code") + offset).cast("int").alias("code"), "sub"))


def joined_codes(codes: DataFrame, offset: int = CODES) -> DataFrame:
    """Codes of dual() in terms of joined_books."""
    return codes.select("id", "chunk", (F.col("code") + F.col("book") * offset).cast("int").alias("code"), "err")
