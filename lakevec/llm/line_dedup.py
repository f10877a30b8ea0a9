"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

Documents arrive in batches. A batch counts, for each line key, the documents
that hold it; these counts merge-anti-join the keys that the stored runs
together already know as frequent, and what is left is a new run of level 0.
When a level holds `fanout` runs they merge into one run of the next level.
Runs are Parquet tables in buckets of the key, sorted inside: batches and
runs meet bucket by bucket in merge joins, without a shuffle of what is stored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.llm.common import BLANKS, discard, hash_pair, lower_ascii, packed_rows, stored, with_row_key, work_folder


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def text_lines(text: Column) -> Column:
    """Lines of the text at \\n; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


#: Classes that documents are dealt into before batches are made of them, keys of a batch and of a bucket, and the least number of batches.
CLASSES, BATCH_KEYS, BUCKET_KEYS, MIN_BATCHES = 16, 200_000_000, 2_000_000, 4


class LineRuns:
    """The levelled store: runs of (h1, h2, n), n the documents that hold the key."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 10, fanout: int = 2, buckets: int = 8):
        self.spark, self.folder, self.min_docs, self.fanout, self.buckets = spark, folder, min_docs, fanout, buckets
        self.levels: list[list[str]] = []
        self.made, self.prefix = 0, f"line_runs_{uuid.uuid4().hex}"

    def _put(self, run: DataFrame, level: int) -> None:
        self.made += 1
        name = f"{self.prefix}_{level}_{self.made}"
        run.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs of these names as one, each key once. Two runs, the usual fanout, meet without a shuffle."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnRenamed("n", "m")
            out = out.join(more.hint("merge"), ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def names(self) -> list[str]:
        return [x for level in reversed(self.levels) for x in level]

    def _known(self, keys: DataFrame, names: list[str]) -> DataFrame:
        """keys (h1, h2, n) with `known`, the documents that the runs of these names count: merge joins that keep keys in their buckets."""
        out = keys.withColumn("known", F.lit(0).cast("long"))
        for name in names:
            more = self.spark.table(name).withColumnRenamed("n", "m")
            out = out.join(more.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", "n", (F.col("known") + F.coalesce("m", F.lit(0))).alias("known"))
        return out

    def add(self, keys: DataFrame) -> None:
        """Add a batch: one row (h1, h2) for each key of each of its documents."""
        counts = keys.groupBy("h1", "h2").agg(F.count("*").alias("n")).repartition(self.buckets, "h1", "h2")
        fresh = self._known(counts, self.names()).where(F.col("known") < self.min_docs)
        self._put(fresh.select("h1", "h2", "n"), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._put(self._merged(names), level + 1)
            self._drop(names)
            level += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, f"{self.folder}/{name}")

    def drop(self) -> None:
        """Delete all runs."""
        self._drop([x for level in self.levels for x in level])
        self.levels = []

    def frequent(self) -> DataFrame:
        """Keys (h1, h2) that at least min_docs documents hold: each run's, with what the others count of them."""
        names, out = self.names(), self.spark.createDataFrame([], "h1 long, h2 long")
        for name in names:
            every = self._known(self.spark.table(name), [x for x in names if x != name])
            out = out.unionByName(every.where(F.col("n") + F.col("known") >= self.min_docs).select("h1", "h2"))
        return out.distinct()


def _drop_lines(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        lines, dropped, kept, shas = [], [], [], []
        for text, drops in zip(d["text"], d["drops"], strict=True):
            parts = (text or "").split("\n")
            if drops:
                gone = set(drops)
                left = "\n".join(x for i, x in enumerate(parts) if i not in gone)
            else:
                gone, left = (), text or ""
            lines.append(len(parts))
            dropped.append(len(gone))
            shas.append(hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest())
            if with_text:
                kept.append(left)
        cols = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] not in ("text", "drops")]
        names = [x for x in b.schema.names if x not in ("text", "drops")]
        cols += [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())]
        names += ["n_lines", "n_dropped", "kept_sha256"]
        if with_text:
            cols.append(pa.array(kept, pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int | None = None, fanout: int = 2, with_text: bool = True) -> DataFrame:
    """Drop, in every document, the lines whose key at least min_docs documents hold.

    docs needs doc_id and text; other columns are left out of the result, so
    they may have any name. Every row counts as a document of its own, whether
    its id repeats or is null. Null and empty texts are one empty line, which
    has no key of min_chars characters and stays. Returns doc_id, n_lines,
    n_dropped, kept_sha256 and, with_text, kept_text. An empty table gives an
    empty result.

    Only hashes move in the counting; lines of frequent keys come back as
    positions by document, and the texts meet them in one join. The number of
    batches, up to CLASSES, and of buckets follows from the number of keys.
    """
    both = with_drops(with_row_key(docs.select("doc_id", "text")), min_docs, min_chars, n_batches, fanout).drop("r1", "r2")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    return both.mapInArrow(lambda it: _drop_lines(it, with_text), schema)


def kept_documents(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int | None = None, fanout: int = 2) -> DataFrame:
    """docs in their own columns, the text without the lines that dedup_lines drops. Null texts stay null."""
    both, names, schema = with_drops(packed_rows(docs), min_docs, min_chars, n_batches, fanout), docs.columns, docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, texts = b.column("_row"), []
            for text, drops in zip(row.field("text").to_pylist(), b.column("drops").to_pylist(), strict=True):
                gone = set(drops or ())
                texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == "text" else row.field(x) for x in names], names=names)

    return both.select("_row", "drops").mapInArrow(keep, schema)


def with_drops(docs: DataFrame, min_docs: int, min_chars: int, n_batches: int | None, fanout: int) -> DataFrame:
    """docs, which have r1 and r2, with drops: the positions of the lines whose key at least min_docs documents hold."""
    spark = docs.sparkSession
    folder = work_folder(spark, "lines")
    keyed = F.transform(text_lines(F.col("text")), line_key)
    long_enough = F.length("key") >= min_chars
    of = F.pmod(F.xxhash64("r1", F.lit(31)), F.lit(CLASSES)).cast("int").alias("class")
    keys = docs.select(of, F.explode(F.array_distinct(keyed)).alias("key")).where(long_enough).select("class", *hash_pair(F.col("key")))
    staged = stored(keys, f"{folder}/staged", "class")
    n = staged.count()
    n_batches = n_batches or min(CLASSES, max(MIN_BATCHES, -(-n // BATCH_KEYS)))
    runs = LineRuns(spark, f"{folder}/runs", min_docs, fanout, max(8, -(-n // BUCKET_KEYS)))
    for i in range(n_batches):
        runs.add(staged.where(F.col("class").isin([c for c in range(CLASSES) if c % n_batches == i])).select("h1", "h2"))
    frequent = stored(runs.frequent(), f"{folder}/frequent")
    runs.drop()
    discard(spark, f"{folder}/staged")
    lines = docs.select("r1", "r2", F.posexplode(keyed).alias("pos", "key")).where(long_enough).select("r1", "r2", "pos", *hash_pair(F.col("key")))
    drops = lines.join(frequent, ["h1", "h2"], "left_semi").groupBy("r1", "r2").agg(F.collect_set("pos").alias("drops"))
    return docs.join(drops, ["r1", "r2"], "left")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of line dedup over all documents."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
