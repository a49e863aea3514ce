"""Recall, query batches, trimmed bases and permutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def recall_hits(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Distinct (qid, id) of result among the first k true neighbours."""
    return result.select("qid", "id").distinct().join(truth.where(F.col("rank") <= k).select("qid", "id").distinct(), ["qid", "id"], "left_semi")


def recall(result: DataFrame, truth: DataFrame, k: int, queries: int) -> DataFrame:
    if k <= 0 or queries <= 0:
        return result.sparkSession.createDataFrame([(0.0,)], "recall double")
    return recall_hits(result, truth, k).agg((F.count(F.lit(1)) / float(k * queries)).alias("recall"))


def recall_strict(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """The mean over queries of hits by distinct true neighbours."""
    want = truth.where(F.col("rank") <= k).groupBy("qid").agg(F.count_distinct("id").alias("want"))
    got = recall_hits(result, truth, k).groupBy("qid").agg(F.count(F.lit(1)).alias("got"))
    return want.join(got, "qid", "left").agg(F.avg(F.coalesce("got", F.lit(0)) / F.col("want")).alias("recall"))


def query_batches(queries: DataFrame, m: int, total: int, batch: int) -> DataFrame:
    """total queries by repeating the m given ones in turn: slot, batch_id, qid, q."""
    slots = queries.sparkSession.range(total).select(F.col("id").alias("slot"), (F.col("id") % m).alias("qid"))
    return slots.join(queries, "qid").select("slot", F.floor(F.col("slot") / batch).cast("long").alias("batch_id"), "qid", "q")


def permutation(base: DataFrame, seed: int) -> DataFrame:
    """id, new_id: a seeded uniform order, dense from 0."""
    key = base.select("id", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))).alias("h"))
    parts = key.repartitionByRange("h", "id").withColumn("p", F.spark_partition_id())
    inner = parts.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("h", "id")))
    first = inner.groupBy("p").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(first), "p").select("id", (F.col("before") + F.col("r") - 1).cast("long").alias("new_id"))  # a row a partition


def trim(base: DataFrame, n: int, multiple: int = 8) -> DataFrame:
    """The rows of a base of n dense ids up to the last whole multiple."""
    return base.where(F.col("id") < n - n % multiple)


def renumber(df: DataFrame, mapping: DataFrame) -> DataFrame:
    return df.join(mapping, "id").withColumn("id", F.col("new_id")).drop("new_id")


@dataclass
class Shuffled:
    """A base in another order, the truth in its ids, and the map (id, new_id) between them."""

    base: DataFrame
    truth: DataFrame
    mapping: DataFrame


def shuffled(base: DataFrame, truth: DataFrame, seed: int) -> Shuffled:
    """A seeded permutation of base, with truth rewritten to it."""
    mapping = permutation(base, seed)
    return Shuffled(renumber(base, mapping), renumber(truth, mapping), mapping)


def unshuffled(s: Shuffled) -> DataFrame:
    """The truth of a shuffled base in the ids it had before."""
    return renumber(s.truth, s.mapping.select(F.col("new_id").alias("id"), F.col("id").alias("new_id")))


def save_shuffled(s: Shuffled, path: str) -> None:
    for name in ("base", "truth", "mapping"):
        getattr(s, name).write.parquet(f"{path}/{name}")


def load_shuffled(spark: SparkSession, path: str) -> Shuffled:
    return Shuffled(*(spark.read.parquet(f"{path}/{name}") for name in ("base", "truth", "mapping")))
