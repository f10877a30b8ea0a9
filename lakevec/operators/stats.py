"""Statistics of graphs and of measured queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakevec.functions.storage import placed


def degrees(topology: DataFrame) -> DataFrame:
    """One row: n, the largest, mean and least degree, and how many nodes have fewer than two neighbours."""
    d = F.size("nbrs")
    return topology.agg(F.count("*").alias("n"), F.max(d).alias("most"), F.avg(d).alias("mean"), F.min(d).alias("least"), F.count_if(d < 2).alias("below_two"))


def order_statistics(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, value): the value at place floor(share n) of the ascending order, from 0, not interpolated.

    Values are counted first, so places go over distinct values, range by range;
    an empty table gives an empty result.
    """
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    spots = placed(counts, "value")
    blocks = spots.withColumn("block", (F.col("place") / F.lit(4096)).cast("long"))
    sizes = blocks.groupBy("block").agg(F.sum("n").alias("rows"))
    before = sizes.select("block", (F.sum("rows").over(W.orderBy("block")) - F.col("rows")).alias("before"))  # a row for 4096 distinct values
    inside = F.sum("n").over(W.partitionBy("block").orderBy("place"))
    upto = blocks.withColumn("inside", inside).join(before, "block").select("value", "n", (F.col("before") + F.col("inside")).alias("upto"))
    total = counts.agg(F.sum("n").alias("total"))
    asked = total.select("total", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    asked = asked.withColumn("at", F.least(F.floor(F.col("share") * F.col("total")), F.col("total") - 1))
    asked = F.broadcast(asked)  # one row for each share
    return upto.join(asked, (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select("share", "value")
