"""Streamed queries against a static base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearplane.operators.search import knn_arrow


def serve(queries: DataFrame, base: DataFrame, k: int, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Answer each micro-batch of a streaming (qid, q) table; sink gets the answers and the batch's number."""
    return queries.writeStream.foreachBatch(lambda batch, number: sink(knn_arrow(base, batch, k), number)).start()
