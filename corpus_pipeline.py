"""A training-corpus pipeline: language ID, line dedup, near duplicates, decontamination, mixing."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from lakevec.llm.common import discard, stored, work_folder

#: Work tables that a stage's result is read from. The next stage begins when that result is written, and deletes them.
_WORK: list[str] = []


def _begin(spark: SparkSession) -> None:
    while _WORK:
        discard(spark, _WORK.pop())


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict each document's language from its text; those go that have none or fit none.

    A text fits if the byte contexts of its language shorten it: null, empty and
    letterless texts go, and so do ones that no learned language can code, such
    as random letters. Where no row has both a language and a text, nothing is
    learned and all go. Repeated rows are judged alike; own columns may have any name.
    """
    _begin(spark)
    free = [next(x for i in count() if (x := f"{name}{i}") not in docs.columns) for name in ("lang_pred", "score", "fits")]
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    return language_id.predict(docs, model, tuple(free)).where(free[2]).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that many documents hold; a document of which nothing is left goes, as do null and blank ones.

    Repeated rows count as documents of their own; own columns may have any name.
    """
    _begin(spark)
    return line_dedup.kept_documents(docs).where(F.length(F.btrim("text", F.lit(line_dedup.BLANKS))) > 0)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: the one of the least id, of equal ids any one, rows without an id last.

    Rows are numbered first, as ids may be null, repeat, or stand on different texts. The numbered rows are
    a work table, which the stage that is called next deletes: the result must be written by then.
    """
    _begin(spark)
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    _WORK.append(f"{work_folder(spark, 'rows')}/rows")
    rows = stored(packed, _WORK[-1])
    found = ngram_join.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    ids = rows.select("row", F.col("doc.doc_id").alias("id")).join(found.select(F.col("doc_id").alias("row"), "class_id"), "row")
    heads = ids.groupBy("class_id").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "row")).alias("head")).select("head.row")
    return rows.join(heads, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts have none; repeated rows are judged alike; own columns may have any name."""
    _begin(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the sources to their target weights into shuffled shards; a document comes up to three times.

    Documents without a word go; null sources are a source of their own; repeated rows are drawn separately.
    """
    _begin(spark)
    return mixing.mixed(docs)


STAGES = [("language_id", languages), ("line_dedup", lines), ("ngram_jaccard", near_copies), ("decontamination", leaks), ("mixing", mix)]

#: The language model and the signatures have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    folder = work_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{i}-{name}")
    return docs
