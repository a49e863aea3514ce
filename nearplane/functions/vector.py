"""Vector arithmetic as Column expressions over array<double>, and the rule for unusable vectors.

A vector that is null, or holds a null, a NaN or an infinite element, has no distance: readers and searches
drop its row. A vector of another dimension than the rest is an error and raises.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of the values, each evaluated once a row, also where body uses them in a lambda."""
    return F.transform(F.array(F.struct(*(c.alias(n) for n, c in values.items()))), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def inner_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm_squared(v: Column) -> Column:
    return total(F.transform(v, lambda x: x * x))


def dot_codes(a: Column, b: Column) -> Column:
    """Inner product of integer codes, in bigint."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)


def l2_codes(a: Column, b: Column) -> Column:
    """Squared distance of integer codes, in bigint."""
    diff = F.zip_with(a, b, lambda x, y: (x - y).cast("long"))
    return dot_codes(diff, diff)


def code_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def is_usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def usable(df: DataFrame, key: str, column: str, dim: int | None = None) -> DataFrame:
    """The rows with a key and a usable vector; a vector that is not of dim elements raises, if dim is given."""
    v = F.col(column)
    kept = df.where(F.col(key).isNotNull() & is_usable(v))
    if dim is None:
        return kept
    same = F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.lit(f"a vector is not of dimension {dim}")))
    return kept.withColumn(column, same)


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the usable vectors of a list column, by the rule of usable()."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    rows = np.flatnonzero(np.asarray(col.is_valid()))
    col = col.drop_null()
    if not len(col):
        return rows, np.zeros((0, dim))
    if (np.diff(np.asarray(col.offsets)) != dim).any():
        raise ValueError(f"a vector is not of dimension {dim}")
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    ok = np.isfinite(x).all(1)
    return (rows, x) if ok.all() else (rows[ok], x[ok])
