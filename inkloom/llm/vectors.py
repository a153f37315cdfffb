"""Reading vectors: usable ones as matrices, blocks, bounded training samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, not zero, and every component finite."""
    x = F.col("x") if isinstance(vec, str) else vec
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def sample(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """At most ``n`` vectors, by keyed hash of their id (the fitting bound)."""
    # ids hash evenly, so the n smallest hashes are an even sample: a top-n, never a full sort
    rows = vectors.select("x", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h").limit(n).select("x").toArrow()
    return matrix(rows.column(0))
