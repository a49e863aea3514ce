"""Exact and two-phase nearest-neighbour search under Euclidean distance.

base(id bigint, v array<double>), queries(qid bigint, q array<double>); rows without a key or without a usable
vector are dropped (nearplane.functions.vector). The base is only ever scanned. Queries are a stated set: up
to `QUERY_BYTES` they are broadcast, beyond that packed blocks of queries meet packed blocks of the base.

A pass multiplies tiles of queries by tiles of rows in Arrow batches and keeps, of each query, the best few
groups of rows, so `keep` rows a query leave a task and no matrix of distances is ever whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearplane.functions import quantization as Q
from nearplane.functions import vector as V
from nearplane.operators.topk import group_min, top_k

QUERY_BYTES = 32 << 20  # of queries in a broadcast
FEW_QUERIES = 4096  # that are fetched without counting them first
CANDIDATE_BYTES = 64 << 20  # of candidates in a broadcast
TILE_BYTES = 16 << 20  # of a tile of distances
BLOCK_BYTES = 4 << 20  # of a packed block of vectors


@dataclass
class Asked:
    """A set of usable queries: how many, their dimension, and, if they fit a broadcast, ids and vectors in id order."""

    frame: DataFrame
    n: int
    dim: int
    qid: np.ndarray | None = None
    q: np.ndarray | None = None


def asked_of(queries: DataFrame | Asked) -> Asked:
    """Queries looked at once; several dimensions raise."""
    if isinstance(queries, Asked):
        return queries
    frame = V.usable(queries, "qid", "q").select(F.col("qid").cast("long").alias("qid"), "q")
    few = frame.limit(FEW_QUERIES + 1).toArrow()  # in most cases one job tells all
    if few.num_rows <= FEW_QUERIES and few.nbytes <= QUERY_BYTES:
        lengths = np.diff(np.asarray(few.column(1).combine_chunks().offsets)) if few.num_rows else np.zeros(0, np.int64)
        n, low, high = few.num_rows, *((lengths.min(), lengths.max()) if few.num_rows else (0, 0))
    else:
        size, few = F.size("q"), None
        n, low, high = frame.agg(F.count(F.lit(1)), F.min(size), F.max(size)).first()
    if n and low != high:
        raise ValueError("queries of several dimensions")
    dim = int(high or 0)
    if 8 * n * dim > QUERY_BYTES:
        return Asked(frame, n, dim)
    few = frame.toArrow() if few is None else few
    qid = few.column(0).to_numpy().astype(np.int64)
    order = np.argsort(qid, kind="stable")
    return Asked(frame, n, dim, qid[order], V.matrix(few.column(1), dim)[1][order] if n else np.zeros((0, dim)))


def all_pairs(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Every usable base row with every usable query of a stated set."""
    asked = asked_of(queries)
    rows = V.usable(base, "id", "v", asked.dim if asked.n else None)
    return rows.crossJoin(asked.frame if asked.q is None else F.broadcast(asked.frame))


def brute_force(base: DataFrame, queries: DataFrame) -> DataFrame:
    return all_pairs(base, queries).select("qid", "id", V.l2_squared(F.col("v"), F.col("q")).alias("score"))


def knn_exact(base: DataFrame, queries: DataFrame | Asked, k: int) -> DataFrame:
    """qid, rank, id, d2 of the k nearest, in column expressions."""
    return top_k(brute_force(base, queries), k).select("qid", "rank", "id", F.col("score").alias("d2"))


class Best:
    """Of each query the `keep` groups with the least (score, id); ties go to the smaller id."""

    def __init__(self, queries: int, keep: int, group: int):
        self.m, self.keep, self.size = queries, keep, group
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bar = np.full(queries, np.inf)  # a query's keep-th best score so far

    def add(self, ids: np.ndarray, scores: np.ndarray, exact=None, slack: float = 0.0) -> None:
        """scores (queries, rows) of rows ids; exact(query places, row places) gives scores anew where slack blurs them."""
        if not len(ids):
            return
        if self.size > 1:
            order = np.argsort(ids, kind="stable")
            if (order[1:] < order[:-1]).any():
                ids, scores = ids[order], scores[:, order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] // self.size != ids[:-1] // self.size]))
            least = np.minimum.reduceat(scores, first, axis=1)
        else:
            first, least = np.arange(len(ids)), scores
        bar = self.bar
        if least.shape[1] > self.keep:
            bar = np.minimum(bar, np.partition(least, self.keep - 1, axis=1)[:, self.keep - 1])
        q, g = np.nonzero(least <= bar[:, None] + slack)
        if not len(q):
            return
        if self.size > 1:  # the first row of a group that has its least score
            span = np.diff(np.append(first, len(ids)))[g]
            at = np.repeat(first[g] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
            which = np.repeat(np.arange(len(q)), span)
            hit = np.flatnonzero(scores[q[which], at] == least[q, g][which])
            at = at[hit[np.searchsorted(which[hit], np.arange(len(q)))]]
        else:
            at = g
        score = exact(q, at) if exact is not None else least[q, g]
        self._merge(np.concatenate([self.q, q]), np.concatenate([self.id, ids[at]]), np.concatenate([self.score, score]))

    def _merge(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if self.size > 1:  # a group may lie in several tiles
            order = np.lexsort((ids, score, ids // self.size, q))
            q, ids, score = q[order], ids[order], score[order]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (ids[1:] // self.size != ids[:-1] // self.size)
            q, ids, score = q[new], ids[new], score[new]
        order = np.lexsort((ids, score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.keep
        last = rank == self.keep - 1
        self.bar[q[last]] = score[last]
        self.q, self.id, self.score = q[kept], ids[kept], score[kept]

    def rows(self, qid: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(qid[self.q], pa.int64()), pa.array(self.id, pa.int64()), pa.array(self.score, pa.float64())], ["qid", "id", "score"])


_SCORES = "qid long, id long, score double"


def tiles(n: int, queries: int) -> Iterator[slice]:
    step = max(1, TILE_BYTES // (8 * max(1, queries)))
    return (slice(lo, min(n, lo + step)) for lo in range(0, n, step))


def _distances(best: Best, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """Squared distances; those that may be among the best are summed anew from differences, so ties stay ties."""
    qq = (q * q).sum(1)
    for s in tiles(len(ids), len(q)):
        y = x[s]
        yy = (y * y).sum(1)
        d = qq[:, None] + yy[None, :] - 2 * (q @ y.T)
        best.add(ids[s], d, lambda i, j, y=y: ((q[i] - y[j]) ** 2).sum(1), 1e-12 * float(qq.max(initial=0) + yy.max(initial=0)))


def half_scores(q: np.ndarray, y: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Scores with factors, norms and results in half precision and sums in single."""
    h = lambda a: a.astype(np.float16).astype(np.float32)
    with np.errstate(over="ignore"):
        return (h(norms)[None, :] - 2 * (h(q) @ h(y).T)).astype(np.float16).astype(np.float64)


def _head_scores(best: Best, q: np.ndarray, ids: np.ndarray, x: np.ndarray, half: bool) -> None:
    """Squared distances on the head, less the query's own norm, which does not change ranks."""
    for s in tiles(len(ids), len(q)):
        y = x[s]
        norms = (y * y).sum(1)
        best.add(ids[s], half_scores(q, y, norms) if half else norms[None, :] - 2 * (q @ y.T))


def _scan(batches: Iterator[pa.RecordBatch], sent, dim: int, keep: int, group: int, head: int | None, half: bool) -> Iterator[pa.RecordBatch]:
    qid, q, rotation = sent.value
    best = Best(len(qid), keep, group)
    for b in batches:
        rows, x = V.matrix(b.column(1), dim)
        ids = b.column(0).to_numpy(zero_copy_only=False)[rows]
        if b.column(0).null_count:
            ok = np.asarray(b.column(0).is_valid())[rows]
            ids, x = ids[ok], x[ok]
        ids = ids.astype(np.int64)
        if head is None:
            _distances(best, q, ids, x)
        else:
            _head_scores(best, q, ids, x @ rotation if rotation is not None else x[:, :head], half)
    yield best.rows(qid)


def pack(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(ids, values): blocks of vectors as bytes."""
    for b in batches:
        at, x = V.matrix(b.column(1), dim)
        ok = np.asarray(b.column(0).is_valid())[at]
        ids, x = b.column(0).to_numpy(zero_copy_only=False)[at][ok].astype(np.int64), x[ok]
        for lo in range(0, len(ids), rows):
            yield pa.RecordBatch.from_arrays([pa.array([ids[lo : lo + rows].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x[lo : lo + rows]).tobytes()], pa.binary())], ["ids", "vs"])


def _blocks(batches: Iterator[pa.RecordBatch], sent, dim: int, keep: int, group: int, head: int | None, half: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks; answers of a pair leave at once, so a task holds two blocks only."""
    rotation = sent.value
    for b in batches:
        for qids, qs, ids, vs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            qid, q = np.frombuffer(qids, np.int64), np.frombuffer(qs).reshape(-1, dim)
            i, x = np.frombuffer(ids, np.int64), np.frombuffer(vs).reshape(-1, dim)
            best = Best(len(qid), keep, group)
            if head is None:
                _distances(best, q, i, x)
            else:
                turn = lambda a: a @ rotation if rotation is not None else a[:, :head]
                _head_scores(best, turn(q), i, turn(x), half)
            yield best.rows(qid)


def _best_groups(base: DataFrame, queries: DataFrame | Asked, keep: int, group: int, rotation: np.ndarray | None, head: int | None, half: bool = False) -> DataFrame:
    """Parts of the answer: qid, id, score of at most `keep` groups a query from each task or pair of blocks."""
    spark, asked = base.sparkSession, asked_of(queries)
    if not asked.n:
        return spark.createDataFrame([], _SCORES)
    rows, dim, q = base.select(F.col("id").cast("long").alias("id"), "v"), asked.dim, asked.q
    if rotation is not None and head is not None:
        rotation = np.ascontiguousarray(rotation[:, :head])
    if q is not None:
        if head is not None:
            q = q @ rotation if rotation is not None else q[:, :head]
        sent = spark.sparkContext.broadcast((asked.qid, q, rotation))
        return rows.mapInArrow(lambda it: _scan(it, sent, dim, keep, group, head, half), _SCORES)
    block = max(1, BLOCK_BYTES // (8 * dim))
    left = asked.frame.mapInArrow(lambda it: pack(it, dim, block), "ids binary, vs binary").select(F.col("ids").alias("qids"), F.col("vs").alias("qs"))
    right = rows.mapInArrow(lambda it: pack(it, dim, block), "ids binary, vs binary")
    turned = spark.sparkContext.broadcast(rotation)
    return right.crossJoin(left).select("qids", "qs", "ids", "vs").mapInArrow(lambda it: _blocks(it, turned, dim, keep, group, head, half), _SCORES)  # blocks, not rows


def knn_arrow(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """knn_exact by matrix products over Arrow batches."""
    parts = _best_groups(base, queries, k, 1, None, None)
    return top_k(parts, k).select("qid", "rank", "id", F.col("score").alias("d2"))


def phase1(base: DataFrame, queries: DataFrame, rotation: np.ndarray | None, d: int, group_size: int, keep: int, half: bool = False) -> DataFrame:
    """qid, id, score: the row with the least head score of each of a query's `keep` best groups of neighbouring ids.

    Rows are rotated (None: taken as they are), scored on d coordinates and reduced in one pass. half computes
    in half precision.
    """
    parts = _best_groups(base, queries, keep, group_size, rotation, d, half)
    if group_size > 1:  # a group may lie in several tasks
        parts = group_min(parts, F.floor(F.col("id") / group_size))
    return top_k(parts, keep).select("qid", "id", "score")


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products along the last axis, summed in its order as SQL does; a matrix product's last bits change with the size of a tile."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for j in range(a.shape[-1]):
        out += a[..., j] * b[..., j]
    return out


def _pairs(batches: Iterator[pa.RecordBatch], sent, dim: int) -> Iterator[pa.RecordBatch]:
    qid, q, rotation = sent.value
    for b in batches:
        rows, x = V.matrix(b.column(1), dim)
        ids = b.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
        x = x @ rotation if rotation is not None else x[:, : q.shape[1]]
        for s in tiles(len(ids), len(q)):
            score = _summed(x[s], x[s])[None, :] - 2.0 * _summed(q[:, None, :], x[None, s, :])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, score.shape[1])), pa.array(np.tile(ids[s], len(q))), pa.array(score.ravel())], ["qid", "id", "score"])


def pair_scores(base: DataFrame, queries: DataFrame, rotation: np.ndarray | None = None, d: int | None = None) -> DataFrame:
    """qid, id, score of every pair: squared norm of the row less twice the product, on d coordinates.

    Products are summed in order, so without a rotation equal rows have equal scores wherever they lie.
    """
    spark, asked = base.sparkSession, asked_of(queries)
    if asked.q is None:
        raise ValueError("all pairs are only listed for a set of queries that can be broadcast")
    if not asked.n:
        return spark.createDataFrame([], _SCORES)
    dim, turn = asked.dim, None if rotation is None else np.ascontiguousarray(rotation[:, : d or asked.dim])
    sent = spark.sparkContext.broadcast((asked.qid, asked.q @ turn if turn is not None else asked.q[:, : d or dim], turn))
    return base.where("id is not null").select(F.col("id").cast("long").alias("id"), "v").mapInArrow(lambda it: _pairs(it, sent, dim), _SCORES)


def split(df: DataFrame, column: str, d: int) -> DataFrame:
    """head and tail of a (rotated) vector, and the head's squared norm."""
    rest = F.slice(F.col(column), F.lit(d + 1), F.greatest(F.size(column) - d, F.lit(0)))
    return df.withColumns({"head": F.slice(column, 1, d), "tail": rest}).withColumn("head_norm2", V.norm_squared(F.col("head")))


def check_sizes(groups: int, phase1_topk: int, k: int) -> None:
    if phase1_topk < k:
        raise ValueError("phase1_topk must not be below k")
    if phase1_topk > groups:
        raise ValueError(f"phase1_topk {phase1_topk} exceeds the {groups} groups")


def looked_up(cand: DataFrame, rows: DataFrame, bound: int | None) -> DataFrame:
    """cand (qid, id, ...) with the rows of its ids; bound is the most candidates there can be, if that is known."""
    if bound is not None and 32 * bound <= CANDIDATE_BYTES:
        # fetched first, as a broadcast must not wait for the whole first phase
        cand = F.broadcast(cand.sparkSession.createDataFrame(cand.toArrow(), cand.schema))
    return rows.join(cand, "id")


def refine_exact(cand: DataFrame, base: DataFrame, queries: DataFrame, k: int, bound: int | None = None) -> DataFrame:
    both = looked_up(cand.select("qid", "id"), base.select("id", "v"), bound).join(queries.frame if isinstance(queries, Asked) else queries.select("qid", "q"), "qid")
    return top_k(both.select("qid", "id", V.l2_squared(F.col("v"), F.col("q")).alias("score")), k).select("qid", "rank", "id", F.sqrt("score").alias("dist"))


def refine_quantized(cand: DataFrame, codes: DataFrame, queries: DataFrame, k: int, bits: int = 8, bound: int | None = None) -> DataFrame:
    """Phase-1 score plus the quantised score of the tails; on the scale of d2 less the query's squared norm.

    codes is (id, x), x the sq_info() of the row's tail, or (id, tail); queries is (qid, tail).
    """
    rows = looked_up(cand.select("qid", "id", "score"), codes.select("id", "x") if "x" in codes.columns else codes.select("id", "tail"), bound)
    if "x" not in codes.columns:  # only the candidates' tails are coded
        rows = rows.withColumn("x", Q.sq_info(F.col("tail"), bits)).drop("tail")
    q = queries.select("qid", Q.sq_info(F.col("tail"), bits).alias("y"), F.size("tail").alias("dim"))
    score = F.col("score") + Q.sq_score(F.col("x"), F.col("y"), F.col("dim"))
    return top_k(rows.join(q, "qid").select("qid", "id", score.alias("score")), k).select("qid", "rank", "id", "score")


def coded(x: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, least elements and scales of the rows of x, as functions.quantization.sq_encode() has them."""
    if not x.shape[1]:
        return x, np.zeros(len(x)), np.zeros(len(x))
    low = x.min(1)
    scale = (x.max(1) - low) / float(2**bits - 1)
    return np.where(scale[:, None] == 0, 0, np.floor((x - low[:, None]) / np.where(scale == 0, 1, scale)[:, None] + 0.5)), low, scale


def _add_tails(batches: Iterator[pa.RecordBatch], sent, dim: int, d: int) -> Iterator[pa.RecordBatch]:
    qid, codes, low, scale, rotation = sent.value
    for b in batches:
        rows, v = V.matrix(b.column(3), dim)
        x = v @ rotation if rotation is not None else v[:, d:]
        at = np.searchsorted(qid, b.column(0).to_numpy()[rows])
        c, lo, step = coded(x)
        cross = step * scale[at] * (c * codes[at]).sum(1) + scale[at] * lo * codes[at].sum(1) + step * low[at] * c.sum(1) + low[at] * lo * x.shape[1]
        score = b.column(2).to_numpy()[rows] + (x * x).sum(1) - 2.0 * cross
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(score)], ["qid", "id", "score"])


def _tail_scores(few: DataFrame, asked: Asked, rotation: np.ndarray | None, d: int) -> DataFrame:
    """qid, id, score of candidates (qid, id, score, v): the head's score plus the quantised score of the tail."""
    from nearplane.operators.pca import project

    if asked.q is not None:
        dim, turn = asked.dim, None if rotation is None else np.ascontiguousarray(rotation[:, d:])
        sent = few.sparkSession.sparkContext.broadcast((asked.qid, *coded(asked.q @ turn if turn is not None else asked.q[:, d:]), turn))
        return few.select(F.col("qid").cast("long").alias("qid"), F.col("id").cast("long").alias("id"), "score", "v").mapInArrow(lambda it: _add_tails(it, sent, dim, d), _SCORES)
    tails = split(project(few, "v", rotation), "y", d).select("qid", "id", "score", Q.sq_info(F.col("tail")).alias("x"))
    q = split(project(asked.frame, "q", rotation), "y", d).select("qid", Q.sq_info(F.col("tail")).alias("y"), F.size("tail").alias("dim"))
    return tails.join(q, "qid").select("qid", "id", (F.col("score") + Q.sq_score(F.col("x"), F.col("y"), F.col("dim"))).alias("score"))


def search(base: DataFrame, queries: DataFrame, rotation: np.ndarray | None, d: int, k: int, group_size: int, phase1_topk: int, refine: str = "exact", n: int | None = None, half: bool = False) -> DataFrame:
    """Two-phase search; rotation None keeps the given axes. n is the number of rows, counted if it is not given."""
    if refine not in ("exact", "quantized"):
        raise ValueError("refine is exact or quantized")
    n = base.count() if n is None else n
    check_sizes(-(-n // group_size), phase1_topk, k)
    asked = asked_of(queries)
    bound = asked.n * phase1_topk
    cand = phase1(base, asked, rotation, d, group_size, phase1_topk, half)
    if refine == "exact":
        return refine_exact(cand, base, asked, k, bound)
    # only candidates are rotated as a whole
    few = looked_up(cand, base.select("id", "v"), bound)
    return top_k(_tail_scores(few, asked, rotation, d), k).select("qid", "rank", "id", "score")


def search_index(index, queries: DataFrame, k: int, group_size: int, phase1_topk: int, refine: str = "quantized", base: DataFrame | None = None) -> DataFrame:
    """Two-phase search from the stored tables of an index (pca.Index); an exact refine reads base for its candidates."""
    from nearplane.operators.pca import project

    if refine not in ("exact", "quantized") or refine == "exact" and base is None:
        raise ValueError("refine is exact, which needs the base, or quantized")
    check_sizes(-(-index.n // group_size), phase1_topk, k)
    asked = asked_of(queries)
    if asked.n and asked.dim != index.dim:
        raise ValueError(f"the index holds vectors of dimension {index.dim}")
    bound, heads = asked.n * phase1_topk, index.projected.select("id", F.col("head").alias("v"))
    if asked.q is not None:
        y = asked.q @ index.rotation
        cand = phase1(heads, Asked(asked.frame, asked.n, index.head, asked.qid, y[:, : index.head]), None, index.head, group_size, phase1_topk)
        tails = index.projected.sparkSession.createDataFrame(pa.table({"qid": asked.qid, "tail": pa.array(list(y[:, index.head :]), pa.list_(pa.float64()))}))
    else:
        pq = split(project(asked.frame, "q", index.rotation), "y", index.head)
        cand, tails = phase1(heads, pq.select("qid", F.col("head").alias("q")), None, index.head, group_size, phase1_topk), pq.select("qid", "tail")
    if refine == "exact":
        return refine_exact(cand, base, asked, k, bound)
    return refine_quantized(cand, index.coded, tails, k, index.bits, bound)
