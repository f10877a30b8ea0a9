"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents lie in blocks, in the order of a hash. A source's
target is met by whole passes over its blocks and a last, partial pass. These
block draws are exact quotas. A tree halves the output shards again and again
and deals each node's quotas between its halves by multivariate-hypergeometric
draws, so that every shard gets whole numbers of blocks of each source which
add up exactly. A shard then takes the next blocks of each source's permuted
list, disjoint from all others, and shuffles them locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakevec.llm.common import stored, unpacked, work_folder

#: Documents that a block of the permuted order holds, about (never twice as many); words of an output shard, about.
BLOCK_DOCS, SHARD_WORDS = 1024, 4_000_000
#: Output shards at most: beyond them shards grow. Sources whose table may be broadcast.
MAX_SHARDS, BROADCAST_SOURCES = 65_536, 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))


def source_targets(items: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target) of items(source, size, n), n rows each: one row a source, null last among them.

    Weights go 1, 2, 3 by code point order and share the sum of all sizes. By
    rising room for each unit of weight, a source stops at max_repeats times its
    size if its share of what the sources before it leave is more than that.
    """
    s = items.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("rank", rank).withColumn("w", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * max_repeats)
    whole, before = W.partitionBy(), W.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(whole), "weights": F.sum("w").over(whole)})
    s = s.withColumns({"c": F.coalesce(F.sum("cap").over(before), F.lit(0)), "wb": F.coalesce(F.sum("w").over(before), F.lit(0))})
    s = s.withColumn("full", (F.col("total") - F.col("c")) * F.col("w") > F.col("cap") * (F.col("weights") - F.col("wb")))
    capped = {"cc": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole), "cw": F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(whole)}
    share = (F.col("w") * (F.col("total") - F.col("cc"))).cast("double") / F.nullif(F.col("weights") - F.col("cw"), F.lit(0)).cast("double")
    s = s.withColumns(capped).withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share))
    return s.select("source", "source_size", "n_docs", "target")


def shard_draws(spark: SparkSession, quotas: list[int], n_shards: int, seed: int) -> DataFrame:
    """(source_no, draw, shard): the shard of each of a source's draws, numbered from 0.

    Every task walks the tree from the root to its own shards. A node's draw
    depends on the seed and the node alone, so all tasks see the same tree.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = np.sort(pdf["id"].to_numpy())
            nodes = [(0, n_shards, np.array(quotas, dtype=np.int64), np.zeros(len(quotas), dtype=np.int64))]
            while nodes:
                lo, hi, left, start = nodes.pop()
                if np.searchsorted(own, lo) == np.searchsorted(own, hi):
                    continue
                if hi - lo == 1:
                    source = np.repeat(np.arange(len(quotas)), left)
                    draw = np.arange(len(source)) - np.repeat(np.cumsum(left) - left, left) + np.repeat(start, left)
                    yield pd.DataFrame({"source_no": source.astype(np.int32), "draw": draw, "shard": np.int32(lo)})
                    continue
                mid = (lo + hi) // 2
                part = int(left.sum()) * (mid - lo) // (hi - lo)
                taken = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(left, part, method="marginals")
                nodes += [(lo, mid, taken, start), (mid, hi, left - taken, start + taken)]

    return spark.range(n_shards).mapInPandas(walk, "source_no int, draw long, shard int")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, the place key of each row and a hash of all its columns, and more columns."""
    key = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("key"), tie.alias("tie"), *more)


class Mix:
    """The draws of a mix: which blocks of which sources go to which shards.

    Rows of a source that are alike in id and text are one item with a count.
    Items are cut into pieces of at most BLOCK_DOCS copies, and pieces in the
    order of their keys into blocks, so rows that repeat lie in many blocks.
    """

    def __init__(self, sizes: DataFrame, n_shards: int | None, max_repeats: int, seed: int):
        self.spark, self.folder = sizes.sparkSession, work_folder(sizes.sparkSession, "mixing")
        items = stored(sizes.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n")), f"{self.folder}/items")
        targets = source_targets(items, max_repeats).withColumn("source_no", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / F.lit(float(BLOCK_DOCS))))).cast("int")
        passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("int")
        targets = targets.withColumns({"bits": bits, "passes": passes}).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        self.targets = stored(targets, f"{self.folder}/targets")
        self.n_sources = self.targets.count()
        self.pieces = stored(self.cut(items), f"{self.folder}/pieces")
        # Words of each block, and before it in its source.
        blocks = self.pieces.groupBy("source_no", "block", "part", "passes", "rest").agg(F.sum(F.col("size") * F.col("m")).alias("words"))
        ahead = W.partitionBy("source_no").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)
        self.blocks = stored(blocks.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))), f"{self.folder}/blocks")
        # Each pass over a block is a draw; the last, partial pass ends at the block that holds the rest's end.
        partial = (F.col("rest") > 0) & (F.col("ahead") <= F.col("rest"))
        turns = F.concat(F.array_repeat(F.lit(False), F.col("passes")), F.when(partial, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
        draws = self.blocks.select("source_no", "block", "part", F.posexplode(turns).alias("turn", "partial"))
        order = W.partitionBy("source_no").orderBy("turn", F.xxhash64(F.lit(seed), "block", "part", "turn"), "block", "part")
        self.draws = stored(draws.withColumn("draw", (F.row_number().over(order) - 1).cast("long")), f"{self.folder}/draws")
        quotas = {r["source_no"]: r["n"] for r in self.draws.groupBy("source_no").agg(F.count("*").alias("n")).collect()}
        words = self.targets.agg(F.sum("target")).first()[0] or 0.0
        self.n_shards = n_shards or max(1, min(sum(quotas.values()), math.ceil(words / SHARD_WORDS), MAX_SHARDS))
        self.tree = shard_draws(self.spark, [quotas.get(i, 0) for i in range(self.n_sources)], self.n_shards, seed)

    def numbered(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows with source_no and other columns of their source."""
        known = self.targets.select(F.col("source").alias("_s"), "source_no", *columns)
        known = F.broadcast(known) if self.n_sources <= BROADCAST_SOURCES else known
        return rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def cut(self, items: DataFrame) -> DataFrame:
        """The pieces of all items: m copies from copy number chunk * BLOCK_DOCS on, and their block, which is a range of the hash and a part of that range."""
        rows = self.numbered(items, "source_size", "target", "passes", "rest", "bits")
        first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
        rows = rows.withColumn("block", F.floor(first / F.pow(F.lit(2.0), 32 - F.col("bits"))).cast("long"))
        chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK_DOCS).cast("long"))
        rows = rows.withColumn("chunk", F.explode(chunks)).withColumn("m", F.least(F.col("n") - F.col("chunk") * BLOCK_DOCS, F.lit(BLOCK_DOCS)))
        before = W.partitionBy("source_no", "block").orderBy("key", "doc_id", "size", "chunk").rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn("part", F.floor(F.coalesce(F.sum("m").over(before), F.lit(0)) / BLOCK_DOCS).cast("long")).drop("bits", "n", "source")

    def dealt(self) -> DataFrame:
        """The pieces' copies, numbered in their piece, with shards, the shard of each draw of a copy, and taken, the words of these draws."""
        drawn = self.draws.join(self.tree, ["source_no", "draw"]).groupBy("source_no", "block", "part")
        drawn = drawn.agg(F.array_sort(F.collect_list(F.struct("turn", "partial", "shard"))).alias("drawn"))
        drawn = self.blocks.select("source_no", "block", "part", "ahead").join(drawn, ["source_no", "block", "part"], "left")
        d = self.pieces.join(drawn, ["source_no", "block", "part"])
        inside = W.partitionBy("source_no", "block", "part").orderBy("key", "doc_id", "size", "chunk").rowsBetween(W.unboundedPreceding, -1)
        d = d.withColumn("before", F.col("ahead") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0)))
        d = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        fits = F.col("before") + F.col("copy") * F.col("size") + F.col("size") * F.lit(0.5) <= F.col("rest")
        got = F.filter(F.coalesce("drawn", F.array().cast("array<struct<turn:int,partial:boolean,shard:int>>")), lambda x: (F.col("size") > 0) & (~x["partial"] | fits))
        d = d.withColumn("shards", F.transform(got, lambda x: x["shard"]))
        return d.withColumn("taken", F.col("size") * F.size("shards"))


def mix_table(docs: DataFrame, n_shards: int | None = None, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards): one row for each row of docs.

    size counts the words of the text (null: 0), shards names the output shard
    of each copy that the shards' draws hold of the document, and taken counts
    the words of these copies. A source's taken words differ from its target by
    at most half the size of one document. Rows that repeat are dealt
    separately, however many they are; rows without source are a source of their own,
    rows without id have the empty id; other columns are left out. Only one number for each
    source comes to the driver. n_shards follows from the size of the mix.
    """
    return Mix(_sized(docs), n_shards, max_repeats, seed).dealt().select("doc_id", "size", "source_size", "target", "taken", "shards")


def _with_copy_number(rows: DataFrame) -> DataFrame:
    """rows with no, from 0 among those of one source_no, key and doc_id: rows are numbered inside the task that wrote them (pid), so many like rows are no hot group."""
    same = ["source_no", "key", "doc_id"]
    there = rows.groupBy(*same, "pid").agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(W.partitionBy(*same).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    there = there.select(*[F.col(c).alias(f"_{c}") for c in (*same, "pid")], before.alias("_before"))
    rows = rows.withColumn("_in", F.row_number().over(W.partitionBy(*same, "pid").orderBy("mid")) - 1)
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*same, "pid")]
    rows = rows.join(there, on[0] & on[1] & on[2] & on[3])
    return rows.withColumn("no", F.col("_before") + F.col("_in")).drop(*[f"_{c}" for c in (*same, "pid", "before", "in")])


def mixed(docs: DataFrame, n_shards: int | None = None, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: docs' rows, once for each copy, with shard and place; each shard in its own shuffled order.

    Every row has its own number among those alike in source, id and text, and
    gets the shards of the copy of that number; which of several such rows is
    taken, where their other columns differ, follows from the order they are
    read in. A shard is one task. Empty documents have no words to take and are not in the mix. Own columns named
    shard or place are replaced; others may have any name.
    """
    own = [c for c in docs.columns if c not in ("shard", "place")]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    packed = _sized(docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("text").alias("text"), row), F.col("_row"))
    packed = stored(packed.withColumn("mid", F.monotonically_increasing_id()), work_folder(docs.sparkSession, "mixed"))
    mix = Mix(packed, n_shards, max_repeats, seed)
    rows = mix.numbered(packed.where("size > 0").select("doc_id", "source", "key", "mid", F.shiftright("mid", 33).alias("pid")))
    rows = _with_copy_number(rows).select("mid", F.col("doc_id").alias("_id"), "source_no", "key", F.floor(F.col("no") / BLOCK_DOCS).alias("chunk"), (F.col("no") % BLOCK_DOCS).alias("copy"))
    shards = mix.dealt().where(F.size("shards") > 0).select("source_no", "key", "chunk", "copy", "doc_id", "shards")
    shards = shards.join(rows, ["source_no", "key", "chunk", "copy"]).where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("mid", "shards")
    rows = packed.select("mid", "key", "tie", "_row").join(shards, "mid").select("_row", "key", "tie", F.posexplode("shards").alias("copy", "shard"))
    rows = rows.select(*unpacked(own), "shard", F.xxhash64(F.lit(seed), "key", "tie", "copy").alias("place"))
    return rows.repartitionById(mix.n_shards, "shard").sortWithinPartitions("shard", "place")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_table(docs).drop("shards")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
t AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
  coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM w),
f AS (SELECT *, (total - c) * w > cap * (weights - wb) AS is_full FROM t),
g AS (SELECT *, coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0) AS cc, coalesce(sum(w) FILTER (WHERE is_full) OVER (), 0) AS cw FROM f),
x AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
  ELSE CAST(w * (total - cc) AS DOUBLE) / CAST(nullif(weights - cw, 0) AS DOUBLE) END AS target FROM g),
y AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS passes FROM x),
j AS (SELECT doc_id, size, source_size, target, passes, target - passes * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (passes + CASE WHEN rest > 0 AND before + size * 0.5::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
