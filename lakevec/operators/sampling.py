"""Samples, cuts and permutations that come out alike at every run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevec.operators.metrics import matrix


def bernoulli(base: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Each row with the probability share, by a hash of its id: the same rows on any cluster."""
    spot = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"/{seed}")).cast("binary")), 1, 8), 16, 10).cast("double")
    return base.where(spot < F.lit(share * 4294967296.0))


def at_least_one(base: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """bernoulli(), or the row of the least id where that picks none."""
    some = bernoulli(base, share, seed)
    if some.limit(1).count():
        return some
    return base.join(base.agg(F.min("id").alias("id")), "id", "left_semi")


def first_rows(base: DataFrame, n: int) -> DataFrame:
    """The rows of ids below n."""
    return base.where(F.col("id") < n)


def identity_tags(base: DataFrame) -> DataFrame:
    return base.select("id", F.col("id").alias("tag"))


def random_rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def rotated(base: DataFrame, rotation: np.ndarray) -> DataFrame:
    """(id, vec) times a matrix; distances stay if it is orthogonal."""
    sent = base.sparkSession.sparkContext.broadcast(rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vec")) @ sent.value if b.num_rows else np.zeros((0, 1))
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), flat], names=["id", "vec"])

    return base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, vec array<double>")
