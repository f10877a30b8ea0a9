"""Target-distribution importance resampling over hashed n-grams.

A 256-byte table lower-cases A-Z and blanks every separator of the UTF-8 bytes,
bytes.split then yields the words, and crc32 with the seed of the shorter n-gram
extends it by a word, so no n-gram is ever spelled out. Counters sum the buckets
of an Arrow batch, Spark sums those of the table. A document's weight is the sum
of its buckets' log ratios of target to corpus; Gumbel noise from its id turns the
highest scores into a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.functions.storage import placed
from lakevec.llm.common import stored, unpacked, work_folder

BUCKETS, MAX_N, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42

#: Lower-case letters, digits and bytes above 0x7F stay, A-Z become a-z, all other bytes blanks.
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def ngram_hashes(words: list[bytes], max_n: int = MAX_N) -> list[int]:
    """crc32 of every run of 1 to max_n words, joined by one space: runs of one word first, then of two."""
    level = [crc32(w) for w in words]
    out, more = list(level), [b" " + w for w in words]
    for n in range(1, max_n):
        level = [crc32(w, seed) for w, seed in zip(more[n:], level, strict=False)]
        out += level
    return out


def _texts(column: pa.Array) -> Iterator[bytes]:
    """The texts as UTF-8, one at a time; null is empty."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N) -> DataFrame:
    """(bucket, n): how many n-grams of docs (text) fall into each bucket; buckets without any have no row. Each batch sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for b in batches:
            for text in _texts(b.column(0)):
                hashes = np.array(ngram_hashes(words_of(text), max_n), np.int64)
                found.update((hashes % buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of its smoothed share of the target over that of docs. Tables without words count as all buckets alike."""
    spark = docs.sparkSession
    s, t = bucket_counts(docs, buckets, max_n).withColumnRenamed("n", "s"), bucket_counts(target, buckets, max_n).withColumnRenamed("n", "t")
    every = spark.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    every = stored(every, f"{work_folder(spark, 'buckets')}/counts")
    both = every.crossJoin(F.broadcast(every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))  # one row
    smooth = F.lit(float(buckets))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + smooth) / ((F.col("s") + 1.0) * (F.col("all_t") + smooth))
    return both.select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain"))


def weighed(docs: DataFrame, gains: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N) -> DataFrame:
    """docs (text, others) without the text, with n_words, n_features and weight: the sum of the gains of all n-grams, 0 where there are none. The gains, a row a bucket, travel with the tasks."""
    table = np.zeros(buckets, np.int64)
    for r in gains.collect():  # a row a bucket
        table[r["bucket"]] = r["gain"]
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, features, weights = [], [], []
            for text in _texts(b.column("text")):
                words = words_of(text)
                hashes = np.array(ngram_hashes(words, max_n), np.int64)
                counts.append(len(words))
                features.append(len(hashes))
                weights.append(int(table[hashes % buckets].sum()))
            cols = [b.column(c) for c in others] + [pa.array(x, pa.int64()) for x in (counts, features, weights)]
            yield pa.RecordBatch.from_arrays(cols, names=[*others, "n_words", "n_features", "weight"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{kinds}, n_words long, n_features long, weight long")


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """(_row, doc_id, n_features, weight, score, rank): every row of docs, its own columns but the text in _row.

    A row of at least min_words words takes part in the draw; percent of 100 of
    these, rounded down, are drawn by the highest score, ties to the smaller
    doc_id, then in the order of a hash of the text; rank is their order from 1
    and null for all others. The score is weight plus noise that
    follows from seed and doc_id alone, so reruns agree and repeated rows score
    alike. Null and empty texts have no features and weight 0; a null id gets the
    noise of an empty one and comes last among ties. docs or target may be empty;
    own columns may have any name.

    Ranks come from ranges of the sorted scores, so no task and not the driver
    sees all of them; only counts and a gain a bucket are collected.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "resampling")
    gains = stored(bucket_gains(docs, target, buckets, max_n), f"{folder}/gains")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    rows = docs.select(own, F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("hash"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)
    scored = weighed(rows, gains, buckets, max_n).withColumn("score", F.col("weight") + noise).withColumn("takes_part", F.col("n_words") >= min_words)
    ordered = scored.select("_row", "doc_id", "n_features", "weight", "score", (~F.col("takes_part")).cast("int").alias("out"), (-F.col("score")).alias("down"), F.isnull("doc_id").alias("no_id"), "hash", F.monotonically_increasing_id().alias("copy"))
    ordered = stored(ordered, f"{folder}/scored")  # once: texts aren't read again for the ranges
    ranks = placed(ordered, "out", "down", "no_id", "doc_id", "hash", "copy")  # copy: rows that repeat all else aren't one range
    n = ranks.where("out = 0").count()
    drawn = (F.col("out") == 0) & (F.col("place") < percent * n // 100)
    return ranks.select("_row", "doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs in their own columns: see ranked()."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("_row")).select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "_row")
    found = ranked(packed, target, percent, min_words, buckets, max_n, seed).where(F.col("rank").isNotNull()).select(F.col("_row._row").alias("_row"))
    return found.select(*unpacked(docs.columns))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_features, weight, score and rank of every document, drawn towards the benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")
