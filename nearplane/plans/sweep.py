"""Parameter sweeps of the two-phase search: recall and queries a second of each configuration."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import astuple, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearplane.operators import evaluate, search

_RESULT = "head int, group_size int, phase1_topk int, refine string, qps long, recall double"


@dataclass(frozen=True)
class Config:
    head: int
    group_size: int
    phase1_topk: int
    refine: str = "exact"


def queries_per_second(queries: int, seconds: float) -> int:
    """Whole queries a second by whole milliseconds; 0 if it took none."""
    ms = int(seconds * 1000)
    return queries * 1000 // ms if ms else 0


def sweep(base: DataFrame, queries: DataFrame, truth: DataFrame, k: int, configs: Iterable[Config], rotation: np.ndarray | None = None) -> DataFrame:
    """head, group_size, phase1_topk, refine, qps, recall of each configuration; k answers a query reach the driver."""
    spark = base.sparkSession
    n, asked = base.count(), search.asked_of(queries)
    want = truth.where(F.col("rank") <= k).select("qid", "id").toArrow()  # k rows a query
    known = spark.createDataFrame(want).withColumn("rank", F.lit(1))
    rows = []
    for c in configs:
        began = time.perf_counter()
        got = search.search(base, asked, rotation, c.head, k, c.group_size, c.phase1_topk, c.refine, n).select("qid", "id").toArrow()
        took = time.perf_counter() - began
        recall = evaluate.recall(spark.createDataFrame(got), known, k, asked.n).first()[0]
        rows.append((*astuple(c), queries_per_second(asked.n, took), recall))
    return spark.createDataFrame(rows, _RESULT)


def save_summary(result: DataFrame, path: str) -> None:
    """CSV files phase1_topk, qps, recall with a header, in a folder for each head, group size and refine."""
    result.select("head", "group_size", "refine", "phase1_topk", "qps", "recall").coalesce(1).sortWithinPartitions("phase1_topk").write.partitionBy("head", "group_size", "refine").csv(path, header=True)
