"""What several operators of this subpackage share: text keys, work folders, loops over labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.functions.storage import work_folder

__all__ = ["BLANKS", "UPPER", "WORD", "connected_components", "crc_remainder", "discard", "hash_pair", "lower_ascii", "packed_rows", "stored", "unpacked", "with_row_key", "work_folder"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: A word of the contracts, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def stored(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet and read it back: cuts the lineage and survives the loss of executors."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a work folder through the file system that it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone. Texts of single bytes take the faster lower()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def hash_pair(*cols: Column) -> list[Column]:
    """128 bits of hash as two longs named h1 and h2."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(7919), *cols).alias("h2")]


def with_row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add r1, r2: a 128-bit key of (id, text). Rows that repeat both share it; ids may be null or repeat."""
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(F.col(text_col), F.lit("\x00"))]
    return df.withColumns({"r1": F.xxhash64(*parts), "r2": F.xxhash64(F.lit(104729), *parts)})


def packed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, r1, r2 and, as _row, all columns of docs: its own columns can then have any name."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return with_row_key(docs.select(row).select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "_row"))


def unpacked(names: list[str]) -> list[Column]:
    """The columns of that name out of _row."""
    return [F.col("_row").getField(c).alias(c) for c in names]


def crc_remainder(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; rows without an id get -1."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(m)), F.lit(-1))


def connected_components(edges: DataFrame, folder: str, max_rounds: int = 60) -> DataFrame:
    """(v, label) for every end of the edges (a, b): label is the least vertex of v's component.

    Each round every vertex goes to the vertex of least hash among itself and
    its neighbours, and the edges are rewritten to where their ends went. Edges
    inside what has grown together disappear, so the rounds shrink fast and are
    few even for long chains. Minimums combine before the shuffle, so a vertex
    with very many neighbours is no hot group. Tables are written each round;
    only whether edges are left comes to the driver.
    """

    def ranked(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{folder}/edges-0")
    went: DataFrame | None = None
    for i in range(max_rounds):
        if i and edges.limit(1).count() == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(ranked("b")).alias("n")).select(F.col("a").alias("v"), F.least(ranked("a"), "n")["v"].alias("to"))
        to = stored(to, f"{folder}/to-{i}")
        moved = edges.join(to.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), f"{folder}/edges-{i + 1}")
        step = to.withColumnsRenamed({"v": "root"})
        went = to.withColumnRenamed("to", "root") if went is None else went.join(step, "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        went = stored(went, f"{folder}/roots-{i}")
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    return went.join(went.groupBy("root").agg(F.min("v").alias("label")), "root").select("v", "label")
