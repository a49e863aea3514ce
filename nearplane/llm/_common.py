"""Shared plumbing of the training-data operators: tables, the shared folder, id ranges."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWEST_ID = -(1 << 63)
TEXT_SLICE = 1 << 20  # bytes of text that one numpy pass works on


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only in local sessions that name none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="nearplane-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of df: write it as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def memory_returned(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """task for mapInArrow, after which the Python worker, which waits for further tasks, gives free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def table_bits(spark: SparkSession, least: int = 29) -> int:
    """log2 of the bits that a broadcast bitmap may have: a 32nd of an executor's memory, 2**least at least."""
    m = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get("spark.executor.memory", "1g").strip().lower())
    size = int(m[1]) << {"": 20, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 0
    return max(least, (size // 4).bit_length() - 1)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def order_id(doc_id: Column | str = "doc_id") -> Column:
    """doc_id as the sort key of the contracts; a null id sorts first."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(c.cast("long"), F.lit(LOWEST_ID))


def id_quantiles(df: DataFrame, parts: int, id_col: str = "doc_id") -> list[int]:
    """parts - 1 ascending cut points that split df into ranges of nearly equal row counts; one id may be several of them."""
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(id_col).cast("long"), F.lit(cuts), F.lit(max(10_000, 20 * parts))).alias("q")).first()
    return sorted(row["q"] or [])


def id_range(bounds: list[int], id_col: Column) -> Column:
    """The number of the range that an id falls in, found by binary search over literal cut points."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(id_col < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    if len(bounds) <= 64:
        return search(0, len(bounds))
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= id_col))


def range_of(bounds: list[int], value: int) -> int:
    return bisect_left(bounds, value + 1)
