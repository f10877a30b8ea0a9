"""Tables by id that are stored as a base and the changes since."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to all executors rather than shuffled, where a table is met by few ids.
FEW = 200_000


@dataclass
class Keyed:
    """base has id and other columns, each id once; it may lie in buckets of id. changed has the same and `present`: the last state of the ids that changed, not present where they are gone."""

    base: DataFrame
    changed: DataFrame | None = None

    def rows(self) -> DataFrame:
        """The table as it is now."""
        if self.changed is None:
            return self.base
        return self.base.join(self.changed.select("id"), "id", "left_anti").unionByName(self.changed.where("present").drop("present"))

    def join(self, pairs: DataFrame, few: bool = False) -> DataFrame:
        """pairs (id, others) with the columns of their rows: only rows that are asked for are laid over one another.

        few says that pairs were counted and are at most FEW: they are broadcast
        then, and the base is filtered where it lies. Otherwise pairs go to the
        buckets of the base, if it has any, and the base isn't shuffled either.
        """
        asked = F.broadcast(pairs) if few else pairs
        met = self.base.join(asked, "id") if few else pairs.hint("shuffle_hash").join(self.base, "id")
        if self.changed is not None:
            met = met.join(self.changed.select("id"), "id", "left_anti").unionByName(self.changed.where("present").drop("present").join(asked, "id").select(*met.columns))
        return met


    def over(self, rows: DataFrame) -> Keyed:
        """With rows (id, columns) added or put in the place of theirs."""
        rows = rows.select(*self.base.columns).withColumn("present", F.lit(True))
        return Keyed(self.base, rows if self.changed is None else self.changed.join(rows.select("id"), "id", "left_anti").unionByName(rows))

    def without(self, ids: DataFrame) -> Keyed:
        """Without the rows of these ids."""
        none = [F.lit(None).cast(self.base.schema[c].dataType).alias(c) for c in self.base.columns if c != "id"]
        gone = ids.select("id", *none).withColumn("present", F.lit(False))
        return Keyed(self.base, gone if self.changed is None else self.changed.join(ids.select("id"), "id", "left_anti").unionByName(gone))


def keyed(table: DataFrame | Keyed) -> Keyed:
    return table if isinstance(table, Keyed) else Keyed(table)


def rows_of(table: DataFrame | Keyed) -> DataFrame:
    return table.rows() if isinstance(table, Keyed) else table


def write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    """df as Parquet in buckets of id, sorted inside; the name that Spark wants for it goes again at once."""
    name = f"lakevec_{uuid.uuid4().hex}"
    try:
        df.repartition(buckets, "id").write.format("parquet").bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def read_bucketed(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    """What write_bucketed wrote, known to lie in buckets: joins on id don't shuffle it."""
    name = f"lakevec_{uuid.uuid4().hex}"
    columns = ", ".join(f"{c} {t}" for c, t in (x.split() for x in schema.split(", ")))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay, and so does what was read of them
