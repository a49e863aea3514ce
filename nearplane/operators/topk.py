"""Grouped minima and top-k. Ties always go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k smallest of each qid with their rank from 1; Spark keeps k rows a task below the exchange."""
    w = Window.partitionBy("qid").orderBy(score, "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_min(scores: DataFrame, group: Column, *more: str) -> DataFrame:
    """The least (score, id, *more) of each query and group: qid, grp, score, id, *more."""
    best = F.min(F.struct("score", "id", *more)).alias("m")
    return scores.groupBy("qid", group.cast("long").alias("grp")).agg(best).select("qid", "grp", "m.*")


def fixed_groups(size: int) -> Column:
    """Groups of size neighbouring ids; the last may be short."""
    return F.floor(F.col("id") / size)


def even_sections(n: int, sections: int) -> Column:
    """sections groups of n div sections ids; the last takes the rest."""
    return F.least(F.floor(F.col("id") / (n // sections)), F.lit(sections - 1))


def phase1_candidates(scores: DataFrame, n: int, group_size: int, keep: int) -> DataFrame:
    groups = -(-n // group_size)
    if keep > groups:
        raise ValueError(f"phase1_topk {keep} exceeds the {groups} groups")
    return top_k(group_min(scores, fixed_groups(group_size)), keep)
