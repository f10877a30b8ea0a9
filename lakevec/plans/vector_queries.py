"""The registered queries of the vector engine, each with its SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakevec.functions.storage import stored, work_folder
from lakevec.operators import cluster, exact, graph, layout, metrics, pq, sampling, stats, update
from lakevec.sources import index
from lakevec.sources import vectors as files
from lakevec.streaming.replay import keep_up, replay, trace_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows of the table's start that serve as centres or codes where a query must have fixed ones.
CENTRES, CHUNKS, CODES = 16, 8, 16

PRELUDE = "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def base_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def queries_of(base: DataFrame, every: int = 50) -> DataFrame:
    return base.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def first_rows(base: DataFrame, n: int) -> np.ndarray:
    rows = base.where(F.col("id") < n).orderBy("id").select("vec").toArrow()
    return metrics.matrix(rows.column("vec"))


def fixed_book(base: DataFrame, offset: int = 0, dim: int = 64) -> DataFrame:
    """A codebook whose codes are the first rows from an offset on, cut into chunks."""
    rows = base.where((F.col("id") >= offset) & (F.col("id") < offset + CODES))
    return pq.split(rows, dim, CHUNKS).select("chunk", (F.col("id") - offset).cast("int").alias("code"), "sub")


@query(f"""{PRELUDE}, p AS (SELECT a.id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.id = a.id + 1)
SELECT id, round({D2.format(a='a', b='b')}, 6) AS l2sq, round(list_inner_product(a, b), 6) AS dot, round(list_cosine_similarity(a, b), 6) AS cosine,
  round(1 - list_cosine_similarity(a, b), 6) AS cosine_distance, round(sqrt(list_inner_product(a, a)), 6) AS norm FROM p""")
def distance_functions(spark, sf_dir):
    base = base_of(spark, sf_dir)
    other = base.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b"))
    a, b = F.col("vec"), F.col("b")
    out = {"l2sq": metrics.l2sq(a, b), "dot": metrics.dot(a, b), "cosine": metrics.cosine_similarity(a, b), "cosine_distance": metrics.cosine_distance(a, b), "norm": metrics.norm(a)}
    return base.join(other, "id").select("id", *[F.round(v, 6).alias(k) for k, v in out.items()])


@query(f"""{PRELUDE}, q AS (SELECT id, list_transform(v, lambda x: CAST(round(x * 100) AS BIGINT)) AS v FROM e)
SELECT a.id, CAST({D2.format(a='a.v', b='b.v')} AS BIGINT) AS l2sq FROM q a JOIN q b ON b.id = a.id + 1""")
def int8_distance(spark, sf_dir):
    base = base_of(spark, sf_dir).select("id", F.transform("vec", lambda x: F.round(x.cast("double") * 100).cast("tinyint")).alias("vec"))
    other = base.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b"))
    return base.join(other, "id").select("id", metrics.l2sq(F.col("vec"), F.col("b")).cast("long").alias("l2sq"))


@query(f"""{PRELUDE}, n AS (SELECT id, v, sqrt(list_inner_product(v, v) + 1.1920929e-07) AS n FROM e),
x AS (SELECT id, n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM n) SELECT id, CAST(dim AS INTEGER) AS dim, round(x / n, 6) AS x FROM x""")
def normalise(spark, sf_dir):
    rows = base_of(spark, sf_dir).select("id", F.posexplode(metrics.normalised(F.col("vec"))).alias("dim", "x"))
    return rows.select("id", "dim", F.round("x", 6).alias("x"))


@query(f"""{PRELUDE}, x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e)
SELECT id, CAST((dim * 7 + 3) % 64 AS INTEGER) AS dim, x FROM x""")
def permute_dimensions(spark, sf_dir):
    """Row dim of the result is the dimension that a permutation moves there."""
    back = sorted(range(64), key=lambda i: (i * 7 + 3) % 64)
    moved = F.transform(F.array(*map(F.lit, back)), lambda i: F.element_at("vec", i + 1))
    return base_of(spark, sf_dir).select("id", F.posexplode(moved).alias("dim", "x")).select("id", "dim", F.col("x").cast("double").alias("x"))


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS place FROM embeddings")
def shuffle_rows(spark, sf_dir):
    """A seeded permutation of the rows; numbers run on from one range of hashes to the next."""
    rows = base_of(spark, sf_dir).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("h")).withColumn("block", F.substring("h", 1, 2))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
    sizes = sizes.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("first"))
    place = F.row_number().over(W.partitionBy("block").orderBy("h", "id")) - 1
    return rows.withColumn("p", place).join(F.broadcast(sizes), "block").select("id", (F.col("first") + F.col("p")).alias("place"))


_KNN = f"""{PRELUDE}, d AS (SELECT q.id AS qid, b.id, {D2.format(a='q.v', b='b.v')} AS dist FROM e q, e b WHERE q.id % 50 = 0),
k AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id, dist FROM d)"""


@query(f"{_KNN} SELECT qid, rank, id, round(dist, 6) AS dist FROM k WHERE rank <= 10")
def exact_knn(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return exact.knn(queries_of(base), base, 10).select("qid", "rank", "id", F.round("dist", 6).alias("dist"))


@query(f"{_KNN} SELECT qid, rank, id, id * 3 + 1 AS tag FROM k WHERE rank <= 10")
def knn_tags(spark, sf_dir):
    """Results with external tags; the tag table is the rule tag = 3 id + 1."""
    base = base_of(spark, sf_dir)
    tags = base.select("id", (F.col("id") * 3 + 1).alias("tag"))
    return exact.knn(queries_of(base), base, 10).join(tags, "id", "left").select("qid", "rank", "id", F.coalesce("tag", "id").alias("tag"))


@query(f"""{_KNN}, s AS (SELECT qid, id, dist FROM k WHERE rank <= 200 AND id >= 100 AND id < 400)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id FROM s QUALIFY rank <= 10""")
def window_truth(spark, sf_dir):
    """The 10 nearest rows of the window. The SQL looks for them among the 200 nearest of all, which hold them in small tables."""
    base = base_of(spark, sf_dir)
    return exact.knn(queries_of(base), base.where("id >= 100 AND id < 400"), 10).select("qid", "rank", "id")


@query(f"""{_KNN}, s AS (SELECT qid, id, dist FROM k WHERE id % 3 <> 0)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id FROM s QUALIFY rank <= 10""")
def knn_live(spark, sf_dir):
    """Neighbours among what is left after every third row was deleted lazily."""
    base = base_of(spark, sf_dir)
    dead, _ = update.lazy_delete(base.select("id").limit(0), base.where("id % 3 = 0"), base)
    return exact.knn(queries_of(base), update.active(base, dead), 10).select("qid", "rank", "id")


@query(f"""{_KNN}, f AS (SELECT qid, rank, CASE WHEN rank % 4 = 0 THEN -id - 1 ELSE id END AS id FROM k WHERE rank <= 10),
t AS (SELECT k.qid, k.id FROM k LEFT JOIN (SELECT qid, dist AS last FROM k WHERE rank = 10) l USING (qid) WHERE rank <= 10 OR dist = last)
SELECT round(100.0::DOUBLE * (SELECT count(*) FROM (SELECT DISTINCT qid, id FROM t) t JOIN (SELECT DISTINCT qid, id FROM f) f USING (qid, id)) / ((SELECT count(DISTINCT qid) FROM k) * 10), 6) AS recall""")
def recall_of_answers(spark, sf_dir):
    """Recall of answers of which every fourth is wrong."""
    base = base_of(spark, sf_dir)
    truth = exact.knn(queries_of(base), base, 20)
    found = truth.where("rank <= 10").withColumn("id", F.when(F.col("rank") % 4 == 0, -F.col("id") - 1).otherwise(F.col("id")))
    return exact.recall(truth, found, 10).select(F.round("recall", 6).alias("recall"))


@query(f"""{PRELUDE}, x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e) SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM x GROUP BY dim""")
def mean_vector(spark, sf_dir):
    return cluster.mean_vector(base_of(spark, sf_dir)).select("dim", F.round("mean", 6).alias("mean"))


@query(f"""{PRELUDE}, x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e), m AS (SELECT dim, avg(x) AS m FROM x GROUP BY dim),
c AS (SELECT list(m ORDER BY dim) AS c FROM m) SELECT id, round({D2.format(a='v', b='c')}, 6) AS dist FROM e, c ORDER BY {D2.format(a='v', b='c')}, id LIMIT 1""")
def medoid(spark, sf_dir):
    return cluster.medoid(base_of(spark, sf_dir)).select("id", F.round("dist", 6).alias("dist"))


_NEAR = f"""{PRELUDE}, n AS (SELECT b.id, b.v, CAST(c.id AS INTEGER) AS centre, {D2.format(a='b.v', b='c.v')} AS dist,
CAST(row_number() OVER (PARTITION BY b.id ORDER BY {D2.format(a='b.v', b='c.v')}, c.id) AS INTEGER) AS rank FROM e b, e c WHERE c.id < {CENTRES})"""


@query(f"{_NEAR} SELECT id, rank, centre, round(dist, 6) AS dist FROM n WHERE rank <= 2")
def nearest_centres(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return cluster.assign(base, first_rows(base, CENTRES), 2).select("id", "rank", "centre", F.round("dist", 6).alias("dist"))


@query(f"{_NEAR} SELECT centre AS shard, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM n WHERE rank <= 2 GROUP BY centre")
def overlapping_shards(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return cluster.shards(base, first_rows(base, CENTRES), 2).groupBy("shard").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""{_NEAR}, x AS (SELECT centre, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM n WHERE rank = 1)
SELECT centre, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean, count(*) AS n FROM x GROUP BY centre, dim""")
def lloyd_step(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return cluster.lloyd_step(base, first_rows(base, CENTRES)).select("centre", "dim", F.round("mean", 6).alias("mean"), "n")


def _codes_sql(name: str, offset: int) -> str:
    return f"""{name} AS (SELECT id, chunk, code, err FROM (SELECT p.id, p.chunk, CAST(b.id - {offset} AS INTEGER) AS code, {D2.format(a='p.sub', b='b.sub')} AS err,
row_number() OVER (PARTITION BY p.id, p.chunk ORDER BY {D2.format(a='p.sub', b='b.sub')}, b.id) AS r FROM p JOIN p b USING (chunk) WHERE b.id >= {offset} AND b.id < {offset + CODES}) WHERE r = 1)"""


_PARTS = f"""{PRELUDE}, p AS (SELECT id, CAST(c AS INTEGER) AS chunk, v[c * 8 + 1:c * 8 + 8] AS sub FROM e, range(0, {CHUNKS}) t(c)), {_codes_sql('c1', 0)}"""


@query(f"{_PARTS} SELECT id, chunk, code, round(err, 6) AS err FROM c1")
def pq_encode(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return pq.encode(pq.split(base, 64, CHUNKS), fixed_book(base)).select("id", "chunk", "code", F.round("err", 6).alias("err"))


_LOOKUP = f"t AS (SELECT q.id AS qid, q.chunk, CAST(b.id AS INTEGER) AS code, {D2.format(a='q.sub', b='b.sub')} AS d FROM p q JOIN p b USING (chunk) WHERE q.id % 50 = 0 AND b.id < {CODES})"
_ADC = "SELECT qid, c1.id, sum(d) AS dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(sum(d), 9), c1.id) AS INTEGER) AS rank FROM c1 JOIN t USING (chunk, code) GROUP BY qid, c1.id"
_TOP = f"SELECT qid, rank, id, round(dist, 6) AS dist FROM ({_ADC}) WHERE rank <= 10"


def fixed_adc(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The first k rows of each query by the distances of fixed codes."""
    base = base_of(spark, sf_dir)
    book = fixed_book(base)
    table = pq.lookup(pq.split(base.where("id % 50 = 0"), 64, CHUNKS), book)
    return pq.adc(table, pq.encode(pq.split(base, 64, CHUNKS), book), k, CODES)


@query(f"""{_PARTS}, {_LOOKUP}
{_TOP}""")
def pq_adc(spark, sf_dir):
    """The ten rows of the least table distances for each query."""
    return fixed_adc(spark, sf_dir, 10).select("qid", "rank", "id", F.round("dist", 6).alias("dist"))


@query(f"""{_PARTS}, {_LOOKUP}, f AS ({_ADC} QUALIFY rank <= 50),
x AS (SELECT f.qid, f.id, {D2.format(a='q.v', b='b.v')} AS dist FROM f JOIN e q ON q.id = f.qid JOIN e b ON b.id = f.id WHERE f.id % 7 <> 3)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM x QUALIFY rank <= 10""")
def adc_truncate_rerank(spark, sf_dir):
    """The three stages without a graph: 50 rows by code distances, deleted ones out, ten of the rest by exact distances."""
    base, found = base_of(spark, sf_dir), fixed_adc(spark, sf_dir, 50)
    return pq.rerank(found.where("id % 7 <> 3"), queries_of(base), base, 10).select("qid", "rank", "id", F.round("dist", 6).alias("dist"))


@query(f"""{_PARTS}, {_LOOKUP}, f AS ({_ADC} QUALIFY rank <= 40), a AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM f WHERE id % 3 <> 0 QUALIFY place <= 10),
d AS (SELECT q.id AS qid, b.id, {D2.format(a='q.v', b='b.v')} AS dist FROM e q, e b WHERE q.id % 50 = 0 AND b.id % 3 <> 0),
k AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d QUALIFY rank <= 10)
SELECT round(100.0::DOUBLE * (SELECT count(*) FROM k JOIN a USING (qid, id)) / ((SELECT count(DISTINCT qid) FROM k) * 10), 6) AS recall""")
def recall_active(spark, sf_dir):
    """Recall of code distances among the rows that aren't deleted."""
    base = base_of(spark, sf_dir)
    live = base.where("id % 3 <> 0")
    truth = exact.knn(queries_of(base), live, 20)
    return exact.active_recall(truth, fixed_adc(spark, sf_dir, 40), live, 10).select(F.round("recall", 6).alias("recall"))


@query(f"""{_PARTS}, t AS (SELECT a.chunk, CAST(a.id AS INTEGER) AS x, CAST(b.id AS INTEGER) AS y, {D2.format(a='a.sub', b='b.sub')} AS d FROM p a JOIN p b USING (chunk) WHERE a.id < {CODES} AND b.id < {CODES})
SELECT a.id AS a, b.id AS b, round(sum(d), 6) AS dist FROM c1 a JOIN c1 b ON b.id = a.id + 1 AND a.chunk = b.chunk JOIN t ON t.chunk = a.chunk AND t.x = a.code AND t.y = b.code GROUP BY a.id, b.id""")
def pq_sdc(spark, sf_dir):
    base = base_of(spark, sf_dir)
    book = fixed_book(base)
    codes = pq.encode(pq.split(base, 64, CHUNKS), book)
    pairs = base.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return pq.sdc(pairs, codes, pq.sdc_table(book)).select("a", "b", F.round("dist", 6).alias("dist"))


@query(f"""{_PARTS}, {_codes_sql('c2', 100)}
SELECT id, chunk, CAST(CASE WHEN c2.err < c1.err THEN 1 ELSE 0 END AS INTEGER) AS book, CASE WHEN c2.err < c1.err THEN c2.code ELSE c1.code END AS code, round(least(c1.err, c2.err), 6) AS err FROM c1 JOIN c2 USING (id, chunk)""")
def pq_dual(spark, sf_dir):
    base = base_of(spark, sf_dir)
    parts = pq.split(base, 64, CHUNKS)
    both = pq.dual(pq.encode(parts, fixed_book(base)), pq.encode(parts, fixed_book(base, 100)))
    return both.select("id", "chunk", "book", "code", F.round("err", 6).alias("err"))


@query(f"""{_PARTS}, r AS (SELECT id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY err DESC, id) AS r, count(*) OVER (PARTITION BY chunk) AS n FROM c1)
SELECT id, chunk FROM r WHERE r <= greatest(floor(n * 0.2), 1)""")
def pq_worst(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return pq.worst(pq.encode(pq.split(base, 64, CHUNKS), fixed_book(base))).select("id", "chunk")


@query(f"""{_PARTS}, {_codes_sql('c2', 100)}, h AS (SELECT id, chunk, CASE WHEN c2.err < c1.err THEN c2.code + 100 ELSE c1.code END AS row_no FROM c1 JOIN c2 USING (id, chunk)),
t AS (SELECT q.id AS qid, q.chunk, b.id AS row_no, {D2.format(a='q.sub', b='b.sub')} AS d FROM p q JOIN p b USING (chunk) WHERE q.id % 50 = 0 AND (b.id < {CODES} OR b.id BETWEEN 100 AND {100 + CODES - 1}))
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(sum(d), 9), h.id) AS INTEGER) AS rank, h.id, round(sum(d), 6) AS dist FROM h JOIN t USING (chunk, row_no) GROUP BY qid, h.id QUALIFY rank <= 10""")
def pq_dual_adc(spark, sf_dir):
    """The ten least table distances where each part of a row is coded by the closer of two books."""
    base = base_of(spark, sf_dir)
    parts, books = pq.split(base, 64, CHUNKS), [fixed_book(base), fixed_book(base, 100)]
    codes = pq.dual(*(pq.encode(parts, b) for b in books))
    asked = pq.split(base.where("id % 50 = 0"), 64, CHUNKS)
    table = pq.lookup(asked, books[0]).withColumn("book", F.lit(0)).unionByName(pq.lookup(asked, books[1]).withColumn("book", F.lit(1)))
    return pq.adc(table, codes, 10, CODES).select("qid", "rank", "id", F.round("dist", 6).alias("dist"))


@query(f"""{_PARTS}, {_codes_sql('c2', 100)}, h AS (SELECT id, chunk, CASE WHEN c2.err < c1.err THEN c2.code + 100 ELSE c1.code END AS row_no FROM c1 JOIN c2 USING (id, chunk))
SELECT a.id AS a, b.id AS b, round(sum({D2.format(a='x.sub', b='y.sub')}), 6) AS dist FROM h a JOIN h b ON b.id = a.id + 1 AND a.chunk = b.chunk
JOIN p x ON x.chunk = a.chunk AND x.id = a.row_no JOIN p y ON y.chunk = b.chunk AND y.id = b.row_no GROUP BY a.id, b.id""")
def pq_cross_sdc(spark, sf_dir):
    """Code distances between rows that are coded by either of two books."""
    base = base_of(spark, sf_dir)
    parts, books = pq.split(base, 64, CHUNKS), [fixed_book(base), fixed_book(base, 100)]
    codes = pq.joined_codes(pq.dual(*(pq.encode(parts, b) for b in books)))
    pairs = base.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return pq.sdc(pairs, codes, pq.sdc_table(pq.joined_books(*books))).select("a", "b", F.round("dist", 6).alias("dist"))


@query("SELECT vec_id AS id FROM embeddings WHERE CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '/42'), 1, 8) AS BIGINT) < 0.25 * 4294967296")
def bernoulli_sample(spark, sf_dir):
    return sampling.bernoulli(base_of(spark, sf_dir), 0.25).select("id")


@query("SELECT vec_id AS id, vec_id AS tag FROM embeddings WHERE vec_id < 300")
def first_rows_with_tags(spark, sf_dir):
    return sampling.identity_tags(sampling.first_rows(base_of(spark, sf_dir), 300))


@query(f"{_KNN} SELECT qid, rank, id, round(dist, 6) AS dist FROM k WHERE rank <= 10")
def knn_after_rotation(spark, sf_dir):
    """A random rotation leaves the neighbours and their distances as they are."""
    base = sampling.rotated(base_of(spark, sf_dir), sampling.random_rotation(64))
    return exact.knn(queries_of(base), base, 10).select("qid", "rank", "id", F.round("dist", 6).alias("dist"))


@query("SELECT vec_id * 3 + 1 AS tag, vec_id AS id FROM embeddings WHERE (vec_id * 3 + 1) % 10 = 0")
def vectors_by_tag(spark, sf_dir):
    base = base_of(spark, sf_dir).select("id", "vec")
    tags = base.select("id", (F.col("id") * 3 + 1).alias("tag"))
    none = base.select("id").limit(0)
    return index.Index(base, none, none, tags, none).by_tag(tags.where("tag % 10 = 0").select("tag")).select("tag", "id")


@query()
def pq_train(spark, sf_dir):
    """Training, coding and refinement: the mean error of each chunk before and after the second codebook."""
    base = base_of(spark, sf_dir)
    parts = pq.split(base, 64, CHUNKS)
    first = pq.encode(parts, pq.train(base, 64, CHUNKS, codes=32))
    both = pq.dual(first, pq.encode(parts, pq.refine(parts, first, codes=32)))
    return first.groupBy("chunk").agg(F.avg("err").alias("before")).join(both.groupBy("chunk").agg(F.avg("err").alias("after")), "chunk")


def rule_graph(base: DataFrame) -> DataFrame:
    """topology of one to eight neighbours of each row by a rule on its number, a graph that SQL can make too and that grows with the table alone."""
    n = base.count()
    edges = base.select("id", F.explode(F.sequence(F.lit(1), (F.col("id") % 8 + 1).cast("int"))).alias("pos"))
    edges = edges.select("id", "pos", ((F.col("id") * 3 + F.col("pos") * F.col("pos") * 7 + 1) % max(n, 1)).alias("nbr")).where("nbr <> id")
    edges = edges.groupBy("id", "nbr").agg(F.min("pos").alias("pos"))
    return edges.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nbr"))), lambda x: x["nbr"]).alias("nbrs"))


_GRAPH = f"""{PRELUDE}, g AS (SELECT id, (id * 3 + pos * pos * 7 + 1) % (SELECT count(*) FROM embeddings) AS nbr, min(pos) AS pos FROM e, range(1, 9) r(pos) WHERE pos <= id % 8 + 1 GROUP BY 1, 2 HAVING nbr <> id)"""


@query(f"{_GRAPH}, d AS (SELECT id, count(*) AS n FROM g GROUP BY id) SELECT count(*) AS n, CAST(max(n) AS INTEGER) AS most, avg(n) AS mean, CAST(min(n) AS INTEGER) AS least, count(*) FILTER (WHERE n < 2) AS below_two FROM d")
def degree_statistics(spark, sf_dir):
    return stats.degrees(rule_graph(base_of(spark, sf_dir)))


_NEAREST = f"""{PRELUDE}, g AS (SELECT a.id, b.id AS nbr, row_number() OVER (PARTITION BY a.id ORDER BY {D2.format(a='a.v', b='b.v')}, b.id) AS pos FROM e a, e b WHERE a.id <> b.id QUALIFY pos <= 8)"""


@query(f"""{_NEAREST} SELECT id, nbr, v[1] AS first FROM g JOIN e USING (id)""")
def stored_index(spark, sf_dir):
    """An index is saved in two versions and the last one opened: vectors and edges side by side."""
    base = base_of(spark, sf_dir).select("id", "vec")
    topology, path = exact.neighbour_graph(base, 8), work_folder(spark, "index")
    index.save(path, base, topology.limit(0), base.select("id").limit(0))
    index.save(path, base, topology, cluster.medoid(base).select("id"))
    got = index.open_index(spark, path).coupled()
    return got.select("id", F.explode("nbrs").alias("nbr"), F.element_at("vec", 1).cast("double").alias("first"))


@query(f"""{_NEAREST}, i AS (SELECT nbr AS id, count(*) AS value FROM g GROUP BY nbr), o AS (SELECT list(value ORDER BY value) AS l, count(*) AS n FROM i)
SELECT s.s::DOUBLE AS share, l[least(CAST(floor(s.s::DOUBLE * n) AS BIGINT), n - 1) + 1] AS value FROM o, (VALUES (0.5), (0.9), (0.99), (0.999)) s(s)""")
def percentiles(spark, sf_dir):
    """Order statistics of how many rows name a row as a neighbour."""
    named = exact.neighbour_graph(base_of(spark, sf_dir), 8).select(F.explode("nbrs").alias("id")).groupBy("id").agg(F.count("*").alias("value"))
    named = stored(named, f"{work_folder(spark, 'named')}/counts")  # read three times below
    return stats.order_statistics(named, "value", [0.5, 0.9, 0.99, 0.999])


@query(f"""{_GRAPH}, own AS (SELECT * FROM g WHERE id % 5 <> 0), hurt AS (SELECT * FROM own WHERE nbr % 5 = 0),
heirs AS (SELECT id, nbr FROM (SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM g WHERE id % 5 = 0 AND nbr % 5 <> 0) WHERE r <= 20)
SELECT DISTINCT id, nbr FROM (SELECT id, nbr FROM own WHERE nbr % 5 <> 0 AND id IN (SELECT id FROM hurt) UNION ALL SELECT hurt.id, heirs.nbr FROM hurt JOIN heirs ON heirs.id = hurt.nbr) WHERE id <> nbr""")
def repair_candidates(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return update.repaired_neighbours(rule_graph(base), base.where("id % 5 = 0").select("id"))


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM embeddings WHERE vec_id % 3 <> 0")
def renumber(spark, sf_dir):
    return update.renumber(base_of(spark, sf_dir).where("id % 3 <> 0").select("id"))


@query("""WITH p AS (SELECT count(*) // 2 AS n, greatest(count(*) // 10, 1) AS b FROM embeddings)
SELECT CAST(vec_id // b AS INTEGER) AS step, 'delete' AS op, vec_id AS id FROM embeddings, p WHERE vec_id < 3 * b
UNION ALL SELECT CAST((vec_id - n) // b AS INTEGER), 'insert', vec_id FROM embeddings, p WHERE vec_id >= n AND vec_id < n + 3 * b""")
def update_trace(spark, sf_dir):
    """Half of the rows first, a tenth of them a batch, three batches."""
    base = base_of(spark, sf_dir)
    rows = base.count()
    return update.trace(base, rows // 2, max(rows // 10, 1), 3)


@query("""WITH s AS (SELECT count(*) AS c FROM embeddings), p AS (SELECT c * 3 // 5 AS n, greatest(c // 20, 1) AS b FROM s)
SELECT CAST(vec_id // b AS INTEGER) AS step, 'delete' AS op, vec_id AS id FROM embeddings, p WHERE vec_id < 8 * b
UNION ALL SELECT CAST((vec_id - n) // b AS INTEGER), 'insert', vec_id FROM embeddings, p WHERE vec_id >= n AND vec_id < n + 8 * b""")
def update_trace_by_size(spark, sf_dir):
    """The trace of FIXTURES.md, which grows with the table: 60 % initial rows, 5 % a batch, 8 batches."""
    base = base_of(spark, sf_dir)
    rows = base.count()
    return update.trace(base, rows * 3 // 5, max(rows // 20, 1), 8)


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 = 0 UNION SELECT vec_id FROM embeddings WHERE vec_id % 11 = 0")
def tombstone_union(spark, sf_dir):
    base = base_of(spark, sf_dir)
    one, _ = update.lazy_delete(base.select("id").limit(0), base.where("id % 7 = 0"), base)
    two, _ = update.lazy_delete(one, base.where("id % 11 = 0"), base)
    return two


@query("SELECT vec_id + 1000000 AS id FROM embeddings WHERE vec_id % 9 = 0")
def failed_deletes(spark, sf_dir):
    base = base_of(spark, sf_dir)
    asked = base.where("id % 9 = 0").select((F.col("id") + 1000000).alias("id")).unionByName(base.where("id % 4 = 0").select("id"))
    return update.lazy_delete(base.select("id").limit(0), asked, base)[1]


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS too_many, CAST(0 AS BIGINT) AS to_self, CAST(0 AS BIGINT) AS dangling FROM embeddings")
def graph_invariants(spark, sf_dir):
    """The built graph has every row once, no list over the degree, no edge to itself and none to a row that isn't there."""
    base = base_of(spark, sf_dir)
    topology, _ = graph.build(base)
    edges = topology.select("id", F.explode("nbrs").alias("nbr"))
    to_self = edges.agg(F.count_if(F.col("id") == F.col("nbr")).alias("to_self"))
    dangling = edges.join(base.select(F.col("id").alias("nbr")), "nbr", "left_anti").agg(F.count("*").alias("dangling"))
    return topology.agg(F.countDistinct("id").alias("n"), F.count_if(F.size("nbrs") > 32).alias("too_many")).crossJoin(to_self).crossJoin(dangling)


@query("SELECT count(*) AS n, count(*) AS places, CAST(0 AS BIGINT) AS over FROM embeddings")
def layout_invariants(spark, sf_dir):
    """Every row has one place of its own, and no page more rows than it can hold."""
    base = base_of(spark, sf_dir)
    where = layout.pages(graph.build(base)[0], base, 16)
    full = where.groupBy("page").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 16).alias("over"))
    return where.agg(F.countDistinct("id").alias("n"), F.countDistinct("page", "slot").alias("places")).crossJoin(full)


def coder_of(base: DataFrame) -> graph.Coder:
    book = pq.train(base, 64, 16, codes=64)
    folder = work_folder(base.sparkSession, "codes")
    book = stored(book, f"{folder}/book")
    codes = pq.packed(pq.encode(pq.split(base, 64, 16), book))
    return graph.Coder(stored(codes, f"{folder}/codes"), book, 64, 16)


def search_query(mode: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = base_of(spark, sf_dir)
        topology, entries = graph.build(base)
        extra = {"coder": coder_of(base)} if mode != "memory" else {}
        if mode == "page":
            extra["layout"] = layout.pages(topology, base, 16)
        return graph.search(queries_of(base), base, topology, entries, 10, mode=mode, **options, **extra)

    return run


for _mode, _options in {"memory": {}, "beam": {}, "pipe": {}, "page": {}, "rerank": {"keep": 40}}.items():
    QUERIES[f"search_{_mode}"] = search_query(_mode, length=100, width=32, **_options)


def full_query(mode: str, dead: str | None = None):
    """A search whose pool holds the whole table: it must find exactly the true neighbours."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = base_of(spark, sf_dir)
        topology, entries = graph.build(base, graph.GraphParams(part=200))
        extra = {"coder": coder_of(base)} if mode != "memory" else {}
        if mode == "page":
            extra["layout"] = layout.pages(topology, base, 16)
        if dead:
            extra["tombstones"] = base.where(dead).select("id")
        n = base.count()
        found = graph.search(queries_of(base), base, topology, entries, 10, length=n, width=max(64, n // 4), mode=mode, **extra)
        return found.select("qid", "rank", "id", F.round("dist", 6).alias("dist"))

    return run


def _knn_sql(live: str) -> str:
    return f"""{PRELUDE}, d AS (SELECT q.id AS qid, b.id, {D2.format(a='q.v', b='b.v')} AS dist FROM e q, e b WHERE q.id % 50 = 0 AND b.{live})
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM d QUALIFY rank <= 10"""


for _mode in ("memory", "beam", "pipe", "page", "rerank"):
    QUERIES[f"search_{_mode}_full"] = full_query(_mode)
    ORACLES[f"search_{_mode}_full"] = _knn_sql("id >= 0")
#: Nineteen of twenty rows are deleted.
QUERIES["search_live_full"] = full_query("rerank", "id % 20 <> 3")
ORACLES["search_live_full"] = _knn_sql("id % 20 = 3")


def churned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(base, topology, vectors, entries): a graph of most rows that took in the others, lost some and was repaired."""
    base = base_of(spark, sf_dir).select("id", F.col("vec").cast("array<double>").alias("vec"))
    old, new = base.where("id % 10 <> 1"), base.where("id % 10 = 1")
    topology, entries = graph.build(old)
    topology, vectors = update.insert(new, old, topology, entries, length=64)
    dead = base.where("id % 10 = 3").select("id")
    return base, *update.consolidate(topology, vectors, entries, dead)


@query(_knn_sql("id % 10 <> 3"))
def update_cycle_full(spark, sf_dir):
    """After inserts, deletes and repair a pool of the whole table finds exactly the true neighbours among the live rows."""
    base, topology, vectors, entries = churned(spark, sf_dir)
    n = base.count()
    found = graph.search(queries_of(base), vectors, topology, entries, 10, length=n, width=max(64, n // 4))
    return found.select("qid", "rank", "id", F.round("dist", 6).alias("dist"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 10 = 1) AS vectors_written, CAST(0 AS BIGINT) AS too_many, CAST(0 AS BIGINT) AS unlinked FROM embeddings""")
def insert_batch(spark, sf_dir):
    """A batch writes the vectors of its own rows alone, gives each a list and keeps all lists to the degree."""
    base = base_of(spark, sf_dir).select("id", F.col("vec").cast("array<double>").alias("vec"))
    old = base.where("id % 10 <> 1")
    topology, entries = graph.build(old)
    delta = update.insertion(base.where("id % 10 = 1"), old, topology, entries, length=64)
    lists = delta.on_topology(topology)
    own = lists.where("id % 10 = 1").agg(F.count_if(F.size("nbrs") == 0).alias("unlinked"))
    written = delta.vectors.agg(F.count("*").alias("vectors_written"))
    return lists.agg(F.countDistinct("id").alias("n"), F.count_if(F.size("nbrs") > 32).alias("too_many")).crossJoin(written).crossJoin(own)


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id * 3 + 1 AS tag, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings WHERE vec_id % 4 <> 2")
def merge_renumber(spark, sf_dir):
    """Deleted rows are merged away and ids are dense again; tags keep naming the same vectors."""
    base = base_of(spark, sf_dir).select("id", F.col("vec").cast("array<double>").alias("vec"))
    tags = base.select("id", (F.col("id") * 3 + 1).alias("tag"))
    topology, entries = graph.build(base)
    _, vectors, _, named = update.merge_deletes(topology, base, entries, tags, base.where("id % 4 = 2").select("id"))
    return vectors.join(named, "id").select("id", "tag", F.element_at("vec", 1).alias("first"))


@query("SELECT vec_id AS id, CAST(vec_id % 3 AS INTEGER) AS epoch FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 = 0")
def delete_epochs(spark, sf_dir):
    """Deletes of a second epoch: ids that were deleted before keep their first one."""
    base = base_of(spark, sf_dir)
    first = update.deleted_in(spark.createDataFrame([], "id long, epoch int"), base.where("id % 3 = 0"), 0)
    return update.deleted_in(first, base.where("id % 5 = 0"), 1).select("id", F.col("epoch").cast("int").alias("epoch"))


@query(f"SELECT CAST(c AS INTEGER) AS chunk, true AS lower FROM range(0, {CHUNKS}) t(c)")
def pq_train_lowers_the_error(spark, sf_dir):
    """In every chunk the second codebook lowers the mean error of the first."""
    return pq_train(spark, sf_dir).select("chunk", (F.col("after") < F.col("before")).alias("lower"))


@query(f"SELECT CAST(c AS INTEGER) AS chunk, 32 AS codes, true AS sound FROM range(0, {CHUNKS}) t(c)")
def pq_merged_book(spark, sf_dir):
    """Two codebooks become one of as many codes, which is at most a tenth worse than the first."""
    base = base_of(spark, sf_dir)
    parts, folder = pq.split(base, 64, CHUNKS), work_folder(spark, "books")
    first = stored(pq.train(base, 64, CHUNKS, codes=32), f"{folder}/first")
    merged = stored(pq.merged_book(parts, first, pq.refine(parts, pq.encode(parts, first), codes=32), codes=32), f"{folder}/merged")
    errors = [pq.encode(parts, b).groupBy("chunk").agg(F.avg("err").alias(f"e{i}")) for i, b in enumerate((first, merged))]
    sizes = merged.groupBy("chunk").agg(F.count("*").cast("int").alias("codes"))
    return sizes.join(errors[0], "chunk").join(errors[1], "chunk").select("chunk", "codes", (F.col("e1") <= F.col("e0") * 1.1).alias("sound"))


@query("SELECT 2 * count(*) AS n, true AS fits FROM embeddings")
def memory_partition(spark, sf_dir):
    """Overlapping shards whose graphs fit a memory budget that the whole graph doesn't."""
    base = base_of(spark, sf_dir)
    budget = cluster.ram_estimate(base.count(), 64, 4, 32) * 0.6 * 2
    sizes = cluster.cluster_sizes(base, cluster.partition_for_memory(base, 64, budget))
    largest = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).withColumn("most", F.col("most"))
    return largest.select("n", (F.lit(cluster.ram_estimate(1, 64, 4, 32)) * F.col("most") <= budget).alias("fits"))


@query("SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def bin_round_trip(spark, sf_dir):
    """Vectors written as matrix files and read again."""
    path = f"{work_folder(spark, 'files')}/bin"
    files.write_vectors(base_of(spark, sf_dir).select("id", "vec"), path)
    got = files.read_vectors(spark, path)
    return got.select("id", F.element_at("vec", 1).cast("double").alias("first"), F.element_at("vec", -1).cast("double").alias("last"))


@query("SELECT vec_id AS id, CAST(round(embedding[1] * 100) AS INTEGER) AS first FROM embeddings")
def int8_round_trip(spark, sf_dir):
    path = f"{work_folder(spark, 'files')}/int8"
    rounded = base_of(spark, sf_dir).select("id", F.transform("vec", lambda x: F.round(x.cast("double") * 100).cast("float")).alias("vec"))
    files.write_vectors(rounded, path, element="int8")
    return files.read_vectors(spark, path, element="int8").select("id", F.element_at("vec", 1).cast("int").alias("first"))


@query("SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def fvecs_round_trip(spark, sf_dir):
    path = f"{work_folder(spark, 'files')}/fvecs"
    files.write_vectors(base_of(spark, sf_dir).select("id", "vec"), path, "fvecs")
    got = files.read_vectors(spark, path, "fvecs")
    return got.select("id", F.element_at("vec", 1).cast("double").alias("first"), F.element_at("vec", -1).cast("double").alias("last"))


@query(f"{_KNN} SELECT qid // 50 AS qid, rank, id, id * 3 + 1 AS tag, CAST(CAST(dist AS FLOAT) AS DOUBLE) > 0 OR id = qid AS sound FROM k WHERE rank <= 10")
def truth_round_trip(spark, sf_dir):
    """A truth set with distances and tags, written as files and read again; queries are numbered in order."""
    base, path = base_of(spark, sf_dir), f"{work_folder(spark, 'files')}/truth"
    found = exact.knn(queries_of(base), base, 10).withColumn("tag", F.col("id") * 3 + 1)
    files.write_truth(found, path, 10)
    got = files.read_truth(spark, path)
    return got.select("qid", "rank", "id", "tag", ((F.col("dist") > 0) | (F.col("id") == F.col("qid") * 50)).alias("sound"))


@query("""WITH s AS (SELECT count(*) AS c FROM embeddings), p AS (SELECT c * 3 // 5 AS n, greatest(c // 20, 1) AS b FROM s)
SELECT 'delete' AS op, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings, p WHERE vec_id < 8 * b
UNION ALL SELECT 'insert', count(*), CAST(sum(vec_id) AS BIGINT) FROM embeddings, p WHERE vec_id >= p.n AND vec_id < p.n + 8 * b""")
def trace_replay(spark, sf_dir):
    """A trace replayed as a stream: what the micro-batches saw, added up."""
    folder = work_folder(spark, "replay")
    update_trace_by_size(spark, sf_dir).repartition(4, "step").write.parquet(f"{folder}/trace")

    def seen(inserts: DataFrame, deletes: DataFrame, number: int) -> None:
        inserts.unionByName(deletes).select("op", "id").write.parquet(f"{folder}/seen/batch-{number}")

    replay(spark, f"{folder}/trace", seen, f"{folder}/checkpoint")
    got = spark.read.schema("op string, id long").option("recursiveFileLookup", "true").parquet(f"{folder}/seen")
    return got.groupBy("op").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT vec_id AS id, vec_id * 2 AS tag, CAST(vec_id % 10 = 1 AS BOOLEAN) AS added FROM embeddings WHERE vec_id % 10 <> 3")
def index_cycle(spark, sf_dir):
    """An index built, added to, deleted from and repaired in its folder, and opened again: its rows, tags, codes, lists and pages belong together."""
    base, path = base_of(spark, sf_dir).select("id", "vec"), work_folder(spark, "index")
    tags = base.select("id", (F.col("id") * 2).alias("tag"))
    index.build_index(base.where("id % 10 <> 1"), path, chunks=16, codes=32, tags=tags)
    index.insert(path, base.where("id % 10 = 1"), 32)
    index.delete(path, base.where("id % 10 = 3").select("id"))
    index.repair(path, spark)
    x = index.open_index(spark, path)
    rows = x.vectors.select("id").join(x.topology.select("id"), "id").join(x.codes.select("id"), "id").join(x.layout.select("id"), "id")
    return rows.join(x.tags, "id").select("id", "tag", (F.col("id") % 10 == 1).alias("added"))


@query()
def update_cycle(spark, sf_dir):
    """A graph of the first part of the rows takes in the next rows, loses some and is repaired; then it is searched."""
    base, topology, vectors, entries = churned(spark, sf_dir)
    return graph.search(queries_of(base), vectors, topology, entries, 10, length=100, width=32)


def small_index(base: DataFrame, path: str) -> None:
    """A stored index with tags twice the ids."""
    index.build_index(base.select("id", "vec"), path, chunks=16, codes=32, two_books=False, tags=base.select("id", (F.col("id") * 2).alias("tag")))


@query("SELECT vec_id AS id, vec_id % 10 = 0 AS again FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 10 = 0")
def reinsert_cycle(spark, sf_dir):
    """Rows are deleted from a stored index and half of them inserted again: these live, and repair takes the others out."""
    base, path = base_of(spark, sf_dir), work_folder(spark, "index")
    small_index(base, path)
    index.delete(path, base.where("id % 5 = 0").select("id"))
    index.insert(path, base.where("id % 10 = 0").select("id", "vec"))
    index.repair(path, spark)
    x = index.open_index(spark, path)
    rows = x.vectors.join(x.topology.select("id"), "id").join(x.codes.select("id"), "id").join(x.layout.select("id"), "id")
    return rows.join(x.tombstones.select("id"), "id", "left_anti").select("id", (F.col("id") % 10 == 0).alias("again"))


@query("SELECT vec_id * 2 AS tag, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings WHERE vec_id % 7 <> 3 AND vec_id % 11 <> 4")
def merge_while_deleting(spark, sf_dir):
    """Rows are deleted while a merge gives all rows new ids: what lives in the end, by its tag."""
    base, path = base_of(spark, sf_dir), work_folder(spark, "index")
    small_index(base, path)
    index.delete(path, base.where("id % 7 = 3").select("id"))
    with ThreadPoolExecutor(2) as pool:
        merging = pool.submit(index.merge, path, spark)
        pool.submit(index.delete, path, base.where("id % 11 = 4").select("id")).result()
        merging.result()
    x = index.open_index(spark, path)
    live = x.vectors.join(x.tombstones.select("id"), "id", "left_anti").join(x.tags, "id")
    return live.select("tag", F.element_at("vec", 1).alias("first"))


@query("SELECT vec_id AS id, vec_id % 8 = 5 AS added FROM embeddings WHERE vec_id % 8 NOT IN (1, 2, 3)")
def concurrent_updates(spark, sf_dir):
    """Four writers change a stored index at once: nobody's change is lost."""
    base, path = base_of(spark, sf_dir), work_folder(spark, "index")
    small_index(base.where("id % 8 <> 5"), path)
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(index.delete, path, base.where(f"id % 8 = {i}").select("id")) for i in (1, 2, 3)]
        jobs.append(pool.submit(index.insert, path, base.where("id % 8 = 5").select("id", "vec")))
        for j in jobs:
            j.result()
    x = index.open_index(spark, path)
    return x.vectors.join(x.tombstones.select("id"), "id", "left_anti").select("id", (F.col("id") % 8 == 5).alias("added"))


@query("""WITH RECURSIVE p AS (SELECT count(*) AS n FROM embeddings),
w AS (SELECT vec_id AS qid, vec_id AS id, 0 AS hop FROM embeddings WHERE vec_id % 50 = 0
  UNION SELECT qid, CASE k WHEN 0 THEN (id * 2) % n WHEN 1 THEN (id * 3 + 1) % n ELSE id // 2 END, hop + 1 FROM w, p, range(0, 3) r(k) WHERE hop < 3),
f AS (SELECT qid, id, min(hop) AS hop FROM w GROUP BY qid, id),
c AS (SELECT qid, unnest(['compared', 'expanded']) AS what, unnest([count(*), count(*) FILTER (WHERE hop < 3)]) AS value FROM f GROUP BY qid),
l AS (SELECT what, list(value ORDER BY value) AS l, count(*) AS m FROM c GROUP BY what)
SELECT what, s.s::DOUBLE AS share, l[least(CAST(floor(s.s::DOUBLE * m) AS BIGINT), m - 1) + 1] AS value FROM l, (VALUES (0.5), (0.9), (0.99)) s(s)""")
def search_work(spark, sf_dir):
    """Percentiles of the rows that searches of three rounds measured and expanded, on a graph that a rule gives."""
    base = base_of(spark, sf_dir)
    n = base.count()
    nbrs = F.array_distinct(F.array((F.col("id") * 2) % n, (F.col("id") * 3 + 1) % n, F.floor(F.col("id") / 2)))
    asked = queries_of(base)
    found = graph.search(asked, base.select("id", "vec"), base.select("id", nbrs.alias("nbrs")), asked.select("qid", F.col("qid").alias("id")), 10, length=n, width=n, max_hops=3, counts=True)
    work = stored(found.select("qid", "compared", "expanded").distinct(), f"{work_folder(spark, 'work')}/counts")
    kinds = [stats.order_statistics(work, c, [0.5, 0.9, 0.99]).select(F.lit(c).alias("what"), "share", "value") for c in ("compared", "expanded")]
    return kinds[0].unionByName(kinds[1])


@query("""SELECT s AS one_of, count(*) FILTER (WHERE vec_id % s = 0) AS n, CAST(0 AS BIGINT) AS too_many, true AS not_below
FROM embeddings, (VALUES (4), (2), (1)) t(s) GROUP BY s""")
def grown_graph(spark, sf_dir):
    """Graphs built in doubling batches, at three sizes: recall at 10 is at most two points below that of the build in parts at equal degree and pool."""
    out, p = None, graph.GraphParams(part=100)
    for one_of in (4, 2, 1):
        base = base_of(spark, sf_dir).where(F.col("id") % one_of == 0).select("id", "vec")
        asked, recalls = queries_of(base), []
        truth = stored(exact.knn(asked, base, 20), f"{work_folder(spark, 'truth')}/knn")
        for build in (graph.build, graph.grow):
            topology, entries = build(base, p)
            found = graph.search(asked, base, topology, entries, 10, length=60, width=16)
            recalls.append(exact.recall(truth, found, 10).first()["recall"])
        row = topology.agg(F.count("*").alias("n"), F.count_if(F.size("nbrs") > p.degree).alias("too_many"))
        row = row.select(F.lit(one_of).alias("one_of"), "n", "too_many", F.lit(recalls[1] >= recalls[0] - 2).alias("not_below"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{_NEAR} SELECT round(sum(dist), 4) AS cost FROM n WHERE rank = 1")
def clustering_cost(spark, sf_dir):
    """The squared distances of all rows to the nearest of fixed centres, added up."""
    base = base_of(spark, sf_dir)
    total = cluster.cost(base, first_rows(base, CENTRES))
    return base.limit(1).select(F.round(F.lit(total), 4).alias("cost"))


@query("SELECT 16 AS centres, count(*) AS n, true AS not_above FROM embeddings")
def kmeans_seeding(spark, sf_dir):
    """Centres that k-means|| starts from cost no more than random rows do."""
    base = base_of(spark, sf_dir)
    found = cluster.parallel_seeds(base, CENTRES)
    random = cluster.kmeans(base, CENTRES, rounds=0, start="random")
    better = cluster.cost(base, found) <= cluster.cost(base, random)
    return base.agg(F.lit(len(found)).alias("centres"), F.count("*").alias("n"), F.lit(better).alias("not_above"))


@query("SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings WHERE vec_id >= (SELECT count(*) FROM embeddings) // 4")
def vector_source(spark, sf_dir):
    """Vector files read as a source, the ranges of rows chosen by a filter on the id."""
    base, path = base_of(spark, sf_dir), f"{work_folder(spark, 'files')}/source"
    files.write_vectors(base.select("id", "vec"), path, files=4)
    files.register(spark)
    got = spark.read.format("lakevec_vectors").load(path).where(F.col("id") >= base.count() // 4)
    return got.select("id", F.element_at("vec", 1).cast("double").alias("first"))


@query("""WITH p AS (SELECT count(*) // 2 AS n, greatest(count(*) // 10, 1) AS b FROM embeddings)
SELECT CAST(vec_id // b AS INTEGER) AS step, 'delete' AS op, vec_id AS id FROM embeddings, p WHERE vec_id < 3 * b
UNION ALL SELECT CAST((vec_id - n) // b AS INTEGER), 'insert', vec_id FROM embeddings, p WHERE vec_id >= n AND vec_id < n + 3 * b""")
def trace_source(spark, sf_dir):
    """The trace of update_trace in binary files, read as a stream."""
    folder = work_folder(spark, "traces")
    files.write_trace(update_trace(spark, sf_dir), f"{folder}/files")
    seen = trace_stream(spark, f"{folder}/files").select("step", "op", "id")
    seen.writeStream.format("parquet").option("path", f"{folder}/seen").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/seen")


@query("""WITH p AS (SELECT count(*) // 2 AS n, greatest(count(*) // 10, 1) AS b FROM embeddings)
SELECT vec_id AS id, vec_id >= n AS added FROM embeddings, p WHERE vec_id >= 3 * b AND vec_id < n + 3 * b""")
def stream_upkeep(spark, sf_dir):
    """A stored index of half the rows is kept up by the stream of update_trace, and the stream is run twice: every change is in it once."""
    base, folder = base_of(spark, sf_dir).select("id", "vec"), work_folder(spark, "upkeep")
    small_index(base.where(F.col("id") < base.count() // 2), f"{folder}/index")
    files.write_trace(update_trace(spark, sf_dir), f"{folder}/files")
    for run in range(2):  # the second one without the first one's checkpoint: all steps come again
        keep_up(spark, f"{folder}/index", trace_stream(spark, f"{folder}/files"), base, f"{folder}/checkpoint-{run}", repair_every=3)
    x = index.open_index(spark, f"{folder}/index")
    live = x.vectors.join(x.topology.select("id"), "id").join(x.tombstones.select("id"), "id", "left_anti")
    return live.select("id", (F.col("id") >= base.count() // 2).alias("added"))


@query("SELECT count(*) AS n, count(*) AS places, CAST(0 AS BIGINT) AS over FROM embeddings")
def page_growth(spark, sf_dir):
    """A layout of most rows takes in the others, which bid for the pages of their neighbours: every row has one place, and no page is over-full."""
    base = base_of(spark, sf_dir).select("id", "vec")
    topology, _ = graph.build(base)
    old = topology.join(base.where("id % 10 <> 1").select("id"), "id", "left_semi")
    where = stored(layout.pages(old, base.where("id % 10 <> 1"), 16), f"{work_folder(spark, 'layout')}/old")
    where = layout.with_new_rows(where, topology, base.where("id % 10 = 1"), 16)
    full = where.groupBy("page").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 16).alias("over"))
    return where.agg(F.countDistinct("id").alias("n"), F.countDistinct("page", "slot").alias("places")).crossJoin(full)


@query("SELECT count(*) AS n, count(*) AS places, CAST(0 AS BIGINT) AS over, true AS full, true AS nearer FROM embeddings")
def page_reorder(spark, sf_dir):
    """A layout of small parts whose groups are matched over ranked edges across parts: every row has one place, pages are over 0.7 full, more edges stay on a page than without the matching."""
    base = base_of(spark, sf_dir).select("id", "vec")
    topology, _ = graph.build(base)
    topology = stored(topology, f"{work_folder(spark, 'reorder')}/topology")
    where, apart = (stored(layout.pages(topology, base, 16, part=64, rounds=r), f"{work_folder(spark, 'reorder')}/pages") for r in (8, 0))
    near = layout.locality(topology, where).select((F.col("fill") > 0.7).alias("full"), "same_page")
    near = near.crossJoin(layout.locality(topology, apart).select(F.col("same_page").alias("before"))).select("full", (F.col("same_page") > F.col("before")).alias("nearer"))
    over = where.groupBy("page").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 16).alias("over"))
    return where.agg(F.countDistinct("id").alias("n"), F.countDistinct("page", "slot").alias("places")).crossJoin(over).crossJoin(near)  # one row each
