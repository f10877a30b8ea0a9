"""Where intermediate tables and indexes live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, local sessions get a temporary folder and
    clusters a folder in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        base = tempfile.mkdtemp(prefix="lakevec-") if master == "local" or master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, *order: str) -> DataFrame:
    """df with `place`, from 0 in the order of the columns: ranges are sorted by themselves and their sizes added up, so no task sees all rows.

    The columns should tell rows apart; equal rows take places by chance, and
    many rows of one value share a range.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, f"{work_folder(df.sparkSession, 'places')}/ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("_before"))  # a row for each range
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_in", inside).join(before, "_range").withColumn("place", (F.col("_before") + F.col("_in")).cast("long")).drop("_range", "_before", "_in")
