"""fvecs and ivecs files: records of an int32 dimension and as many 4-byte values, little-endian."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearplane.sources.hdf5 import read_hdf5


def read_vecs(spark: SparkSession, path: str, dim: int, kind: str = "f") -> DataFrame:
    """(id, v): id is the record's place in the file. Fixed records make the file splittable.

    A record of another dimension, or a file that isn't whole records, raises.
    """
    if kind not in "fi":
        raise ValueError("kind is f or i")
    size = 4 * (dim + 1)
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(size)}
    # the format's key is the record's number, so no pass over the file counts records
    found = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)

    def rows(records: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, list]]:
        while held := list(islice(records, 4096)):
            x = np.frombuffer(b"".join(r for _, r in held), "<i4").reshape(len(held), dim + 1)
            if (x[:, 0] != dim).any():
                raise ValueError("a record of another dimension")
            yield from zip((i for i, _ in held), x[:, 1:].view(f"<{kind}4").tolist(), strict=True)

    return spark.createDataFrame(found.mapPartitions(rows), f"id long, v array<{'double' if kind == 'f' else 'int'}>")


def to_vecs(vectors: np.ndarray) -> bytes:
    head = np.full((len(vectors), 1), vectors.shape[1], "<i4").view(np.uint8).reshape(len(vectors), 4)
    return np.hstack([head, np.ascontiguousarray(vectors).view(np.uint8).reshape(len(vectors), -1)]).tobytes()


def truth_of(neighbours: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id), and distance if given, from a matrix of neighbours (id, v) with a row a query."""
    near = neighbours.select(F.col("id").alias("qid"), F.posexplode("v").alias("pos", "near")).select("qid", (F.col("pos") + 1).alias("rank"), F.col("near").cast("long").alias("id"))
    if distances is None:
        return near
    far = distances.select(F.col("id").alias("qid"), F.posexplode("v").alias("pos", "distance")).select("qid", (F.col("pos") + 1).alias("rank"), F.col("distance").cast("double").alias("distance"))
    return near.join(far, ["qid", "rank"])


def load(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """By suffix: .fvecs, .ivecs or .hdf5 files; all else is Parquet."""
    if path.endswith((".fvecs", ".ivecs")):
        if dim is None:
            raise ValueError("the dimension of a vecs file must be given")
        return read_vecs(spark, path, dim, path[-5])
    if path.endswith((".hdf5", ".h5")):
        return read_hdf5(spark, path, "train")
    return spark.read.parquet(path)
