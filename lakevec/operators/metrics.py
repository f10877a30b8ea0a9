"""Vector distances and transforms as Column expressions, and their numpy forms for batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, without the root; integers are widened first."""
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm_sq(v: Column) -> Column:
    return _total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(norm_sq(v))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity, for every element type."""
    return F.lit(1.0) - cosine_similarity(a, b)


def normalised(v: Column, eps: float = 1.1920929e-07) -> Column:
    n = F.sqrt(norm_sq(v) + F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / n)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def chunk(v: Column, start: int, size: int) -> Column:
    """Dimensions start, start + 1, ... of v, size of them, counted from 0."""
    return F.slice(v, start + 1, size)


METRICS = {"l2": l2sq, "cosine": cosine_distance}


def metric(name: str):
    """The distance of that name; inner product isn't one."""
    if name not in METRICS:
        raise ValueError(f"no such metric: {name}; there are {sorted(METRICS)}")
    return METRICS[name]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length and without nulls, as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray, name: str = "l2") -> np.ndarray:
    """All distances of the rows of a and b."""
    if name == "cosine":
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        return 1 - a @ b.T
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


SOUND = "{0} IS NOT NULL AND size({0}) > 0 AND forall({0}, x -> x IS NOT NULL)"
