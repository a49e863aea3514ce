"""Principal components: means, covariance, spectrum, rank selection, projection, index tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearplane.functions import quantization as Q
from nearplane.functions import vector as V

_SUMS = "n long, s binary, ss binary"


def dim_means(base: DataFrame) -> DataFrame:
    """pos, mean of every dimension over the usable vectors."""
    rows = base.where(V.is_usable(F.col("v")))
    return rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def centred(base: DataFrame) -> DataFrame:
    """base with the mean of all vectors taken from each; the D means stand in the plan."""
    mean = F.array(*(F.lit(float(r["mean"])) for r in dim_means(base).orderBy("pos").collect()))
    return base.where(V.is_usable(F.col("v"))).withColumn("v", F.zip_with("v", mean, lambda x, m: x - m))


def _packed(n: int, s: np.ndarray, ss: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([ss.tobytes()], pa.binary())], ["n", "s", "ss"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products of a task's usable vectors."""
    n, s, ss = 0, None, None
    for b in batches:
        col = b.column(0).drop_null()
        if not len(col):
            continue
        dim = int(np.asarray(col.offsets)[1] - np.asarray(col.offsets)[0]) if s is None else len(s)
        _, v = V.matrix(col, dim)
        n, s, ss = n + len(v), v.sum(0) + (0 if s is None else s), v.T @ v + (0 if ss is None else ss)
    if n:
        yield _packed(n, s, ss)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, ss = 0, None, None
    for b in batches:
        for m, t, tt in zip(*(c.to_pylist() for c in b.columns), strict=True):
            t, tt = np.frombuffer(t), np.frombuffer(tt)
            if s is not None and len(s) != len(t):
                raise ValueError(f"vectors of dimension {len(s)} and {len(t)}")
            n, s, ss = n + m, t + (0 if s is None else s), tt + (0 if ss is None else ss)
    if n:
        yield _packed(n, s, ss)


def summed(base: DataFrame) -> DataFrame:
    """One row (n, s, ss) of all vectors, added in two levels in executors, so one D x D sum leaves the cluster."""
    parts = base.select("v").mapInArrow(_moments, _SUMS)
    width = ceil(sqrt(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    if width > 4:
        parts = parts.repartition(width, F.spark_partition_id()).mapInArrow(_added, _SUMS)
    return parts.repartition(1).mapInArrow(_added, _SUMS)  # one small row from each of width tasks


def covariance_matrix(base: DataFrame) -> np.ndarray:
    row = summed(base).first()
    if row is None or row["n"] < 2:
        raise ValueError("two vectors at least")
    s = np.frombuffer(row["s"])
    cov = (np.frombuffer(row["ss"]).reshape(len(s), len(s)) - np.outer(s, s) / row["n"]) / (row["n"] - 1)
    if not np.isfinite(cov).all():
        raise ValueError("the covariance has values that are not finite")
    return (cov + cov.T) / 2


def covariance(base: DataFrame) -> DataFrame:
    """i, j, cov for i <= j."""
    cov = covariance_matrix(base)
    i, j = np.triu_indices(len(cov))
    return base.sparkSession.createDataFrame(pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32), "cov": cov[i, j]}))


def fit(base: DataFrame, cap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and the rotation with one axis per column; cap fits on the rows with id < cap only."""
    val, vec = np.linalg.eigh(covariance_matrix(base if cap is None else base.where(F.col("id") < cap)))
    return val[::-1].copy(), vec[:, ::-1].copy()


def rank_for(eigenvalues: np.ndarray, ratio: float) -> int:
    """The least d whose share of the variance reaches ratio, 0.95 if that is no share; 0 if there is no variance."""
    ratio = ratio if 0 < ratio <= 1 else 0.95
    v = np.maximum(np.sort(np.asarray(eigenvalues, np.float64))[::-1], 0)
    if v.sum() < 1e-12:
        return 0
    return int(min(len(v), np.searchsorted(np.cumsum(v) / v.sum(), ratio - 1e-12) + 1))


def spectrum_of(df: DataFrame) -> np.ndarray:
    """The eigenvalues of a table (component, eigenvalue), as long as a dimension, descending."""
    return np.sort(np.array([r[0] for r in df.select("eigenvalue").collect()], np.float64))[::-1]


def rank_selection(spectrum: DataFrame, ratio: float) -> DataFrame:
    """(component from 1, eigenvalue) -> one row d, by rank_for()."""
    return spectrum.sparkSession.createDataFrame([(rank_for(spectrum_of(spectrum), ratio),)], "d long")


def axis_spectrum(base: DataFrame) -> DataFrame:
    """(component from 1, eigenvalue): the variances along the stored axes, descending."""
    var = base.where(V.is_usable(F.col("v"))).select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.var_samp("x").alias("eigenvalue"))
    return var.select(F.row_number().over(Window.orderBy(F.desc("eigenvalue"), "pos")).alias("component"), "eigenvalue")  # a row a dimension


def scan_spectrum(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(component from 1, eigenvalue) of a CSV column with a header: nulls dropped, descending; if any is not
    above 0, all are raised to 1e-12 at least."""
    rows = spark.read.csv(path, header=True)
    if column not in rows.columns:
        raise ValueError(f"no column {column!r}")
    val = rows.select(F.col(f"`{column}`").cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    least = val.agg(F.min("x")).first()[0]
    if least is None:
        raise ValueError(f"no eigenvalues in {column!r}")
    order = Window.orderBy(F.desc("eigenvalue"))  # a spectrum is as long as the dimension
    return val.select((F.greatest("x", F.lit(1e-12)) if least <= 0 else F.col("x")).alias("eigenvalue")).select(F.row_number().over(order).alias("component"), "eigenvalue")


def cosine_rotation(dim: int) -> np.ndarray:
    """A fixed orthonormal rotation in closed form, for tests and for data without a fit: cosines of rising frequency."""
    rot = np.sqrt(2 / dim) * np.cos(np.pi * (2 * np.arange(dim)[:, None] + 1) * np.arange(dim)[None, :] / (2 * dim))
    rot[:, 0] /= np.sqrt(2)
    return rot


def _project(batches: Iterator[pa.RecordBatch], at: int, sent) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, v = V.matrix(b.column(at), len(sent.value))
        y = v @ sent.value
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
        yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows)).columns, flat], [*b.schema.names, "y"])


def project(df: DataFrame, column: str, rotation: np.ndarray | None) -> DataFrame:
    """df, without its rows of unusable vectors, with y, the rotated (not centred) vector."""
    if rotation is None:
        return df.where(V.is_usable(F.col(column))).withColumn("y", F.col(column))
    sent = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(rotation, np.float64))
    at = df.columns.index(column)
    return df.mapInArrow(lambda it: _project(it, at, sent), ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", y array<double>")


@dataclass
class Index:
    """The stored tables of an index: projected (id, head, tail, head_norm2) and coded (id, x) hold one row a vector."""

    dim: int
    head: int
    ratio: float
    n: int
    bits: int
    rotation: np.ndarray
    projected: DataFrame
    coded: DataFrame


_META = "dim int, head int, ratio double, n long, bits int"
_ROTATION = "component int, eigenvalue double, axis array<double>"
_PROJECTED = "id long, head array<double>, tail array<double>, head_norm2 double"
_CODED = "id long, x struct<xx: double, min_val: double, max_val: double, scale: double, code: array<smallint>, sum_code: long, xx_part: array<double>, sum_code_part: array<long>>"


def save_index(base: DataFrame, path: str, d: int | None = None, ratio: float | None = None, rotation: np.ndarray | None = None, bits: int = 8, cap: int | None = None) -> None:
    """Fit (unless a rotation is given), project and code base into tables under path.

    d is the length of the head; without it, the least that keeps ratio of the variance. Both searches read these
    tables only, the exact refine the base's candidates besides.
    """
    from nearplane.operators.search import split

    spark = base.sparkSession
    if rotation is None:
        val, rotation = fit(base, cap)
    else:
        val = np.einsum("ij,jk,ik->i", rotation.T, covariance_matrix(base), rotation.T)
    d = min(d, len(val)) if d else rank_for(val, ratio or 0.95)
    if d < 1:
        raise ValueError("the vectors do not vary")
    held = np.maximum(val, 0)
    rows = split(project(base.where("id is not null").select(F.col("id").cast("long").alias("id"), "v"), "v", rotation), "y", d)
    rows.select("id", "head", "tail", "head_norm2").write.parquet(f"{path}/projected")
    projected = spark.read.schema(_PROJECTED).parquet(f"{path}/projected")
    projected.select("id", _codes(F.col("tail"), bits).alias("x")).write.parquet(f"{path}/coded")
    spark.createDataFrame([(i + 1, float(v), rotation[:, i].tolist()) for i, v in enumerate(val)], _ROTATION).coalesce(1).write.parquet(f"{path}/rotation")
    spark.createDataFrame([(len(val), d, float(held[:d].sum() / held.sum()), projected.count(), bits)], _META).coalesce(1).write.parquet(f"{path}/meta")


def _codes(tail: Column, bits: int) -> Column:
    return Q.sq_info(tail, bits)


def load_index(spark: SparkSession, path: str) -> Index:
    """The index under path; a header out of range raises."""
    meta = spark.read.schema(_META).parquet(f"{path}/meta").first()
    if meta is None or not 0 < meta["head"] <= meta["dim"]:
        raise ValueError("the index has a head of no valid length")
    if not 0 < meta["ratio"] <= 1 + 1e-9:
        raise ValueError("the index keeps no valid share of the variance")
    rows = spark.read.schema(_ROTATION).parquet(f"{path}/rotation").orderBy("component").collect()
    if len(rows) != meta["dim"] or any(len(r["axis"]) != meta["dim"] for r in rows):
        raise ValueError("the rotation is not square")
    return Index(meta["dim"], meta["head"], meta["ratio"], meta["n"], meta["bits"], np.array([r["axis"] for r in rows]).T, spark.read.schema(_PROJECTED).parquet(f"{path}/projected"), spark.read.schema(_CODED).parquet(f"{path}/coded"))
