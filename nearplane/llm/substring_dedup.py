"""Exact removal of repeated word windows, behind a count-min prefilter.

A window is `width` consecutive words. Each window has an anchor: the smallest hash among its
`gram`-word sequences, so equal windows have equal anchors and neighbouring windows mostly share one.

1. Every partition counts its anchor positions in a count-min sketch (`DEPTH` rows). The sketches are
   merged block by block across the cluster; an anchor's merged count is never below the number of
   places where a window with that anchor stands, so no repeated window is lost.
2. A second pass keeps only windows whose anchor is estimated at two places or more. Each chunk of a
   partition keeps its own earliest copy of a window and marks the later ones; runs of windows with
   one anchor travel to the partition of that anchor, where equal windows (by the hashes of window and
   anchor, both of 64-bit word hashes) are grouped and all but the earliest are marked. A hot passage thus
   reaches its reducer once per chunk, not once per document, and the windows around a hot anchor, in
   whatever surroundings it stands, are dealt to many reducers by their own hash.
3. Marks, merged to intervals, join the documents by id, and covered words go.

The merged sketch is what is broadcast: 2 x 2**bits bits, with bits from the corpus size and at most a 32nd of an
executor's memory for each row (128 MB in all for executors up to 2 GB). Where a corpus outgrows that, more unique
windows pass the prefilter: by estimate about half at 30 GB of text for each 128 MB, nearly all at 100 GB. The result
stays exact, and what is shuffled grows to about 1.4 times the text.

Words and windows are known by 64-bit hashes: two given windows that differ are taken for equal with a probability
of about 2**-64, and only windows of one anchor are compared.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearplane.llm import _words as W
from nearplane.llm._common import TEXT_SLICE, memory_returned, order_id, table_bits

DEPTH = 2
CELLS = 1 << 16  # cells of a sketch block
MERGERS = 32  # tasks that merge the sketches; the driver takes their results one by one
HOT_BLOCK = -1  # stands for the list of anchors that are frequent in a task
SPREAD = 10  # log2 of the tasks that the windows of a hot anchor are dealt to
CHUNK = 1_000_000  # windows that are compared at once within a partition
HOT_LOCAL, HOT = 1000, 200_000  # positions of an anchor in a task that are reported, and in all that make it hot
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return W.mix(h * W.U(_ODD[row])) >> W.U(64 - bits)


def anchors(h: np.ndarray, doc: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flat word hashes: each window's anchor (0 where it leaves its text), if it is whole, and the hashes at anchor positions."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    whole = doc[: n] == doc[width - 1 :]
    grams = W.window_hashes(h, gram) | W.U(1)
    span = width - gram + 1
    low = W.sliding(grams, span, np.minimum)
    masked = np.where(whole, low, W.U(0))
    pad = np.zeros(span - 1, np.uint64)
    top = W.sliding(np.concatenate([pad, masked, pad]), span, np.maximum)
    return masked, whole, grams[top == grams]


def _sketch(batches: Iterator[pa.RecordBatch], width: int, gram: int, bits: int, often: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def blocks() -> Iterator[pa.RecordBatch]:
        at = np.concatenate(held) if held else np.zeros(0, np.uint64)
        names, count = np.unique(at, return_counts=True)
        if (count >= often).any():
            names, count = names[count >= often], count[count >= often].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([HOT_BLOCK], pa.int64()), pa.array([names.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], ["block", "once", "more"])
        for row in range(DEPTH):
            cells, count = np.unique(_cells(at, row, bits), return_counts=True)
            block = (cells >> W.U(16)).astype(np.int64)
            inner = (cells & W.U(0xFFFF)).astype(np.uint16)
            names, first = np.unique(block, return_index=True)
            cut = [*first, len(block)]
            once, more = [], []
            for a, b in zip(cut, cut[1:], strict=False):
                many = count[a:b] > 1
                once.append(inner[a:b][~many].tobytes())
                more.append(inner[a:b][many].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names + (row << 40), pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["block", "once", "more"])

    for b in W.slices(batches, TEXT_SLICE):
        buf, off = W.flat(b.column(0))
        s, e, wo = W.words(buf, off)
        held.append(anchors(W.word_hashes(buf, s, e), W.doc_of(wo), width, gram)[2])
        size += len(held[-1])
        if size > 4_000_000:
            yield from blocks()
            held, size = [], 0
    yield from blocks()


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    count: dict[int, np.ndarray] = {}
    often: Counter[int] = Counter()
    for b in batches:
        for block, once, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if block == HOT_BLOCK:
                often.update(dict(zip(np.frombuffer(once, np.uint64).tolist(), np.frombuffer(more, np.int64).tolist(), strict=True)))
                continue
            own = count.setdefault(block, np.zeros(CELLS, np.uint8))
            for data, by in ((once, 1), (more, 2)):
                at = np.frombuffer(data, np.uint16)
                own[at] = np.minimum(own[at] + by, 2)
    full = [(k, np.packbits(v > 1, bitorder="little").tobytes()) for k, v in count.items() if (v > 1).any()]
    if hot := sorted(a for a, n in often.items() if n >= least):
        full.append((HOT_BLOCK, np.array(hot, np.uint64).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in full], pa.int64()), pa.array([v for _, v in full], pa.binary())], ["block", "twice"])


def merged_sketch(docs: DataFrame, width: int, gram: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each sketch row the bitmap of cells that were counted twice or more; and the hot anchors, ascending."""
    often, least = HOT_LOCAL, HOT
    parts = docs.select("text").mapInArrow(memory_returned(lambda it: _sketch(it, width, gram, bits, often)), "block long, once binary, more binary")
    out, hot = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)], np.zeros(0, np.uint64)
    for r in parts.repartition(MERGERS, "block").mapInArrow(memory_returned(lambda it: _merge(it, least)), "block long, twice binary").toLocalIterator():
        if r["block"] == HOT_BLOCK:
            hot = np.frombuffer(r["twice"], np.uint64)
            continue
        at = (r["block"] & ((1 << 40) - 1)) * (CELLS // 8)
        out[r["block"] >> 40][at : at + CELLS // 8] = np.frombuffer(r["twice"], np.uint8)
    return out, hot


def _runs(ids, th, pos, anchor, wh=None) -> pa.RecordBatch:
    """Windows in text order as rows of consecutive windows (of one anchor, if hashes are sent along)."""
    n = len(pos)
    new = np.ones(n, bool)
    if n:
        new[1:] = (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1] + 1)
        if wh is not None:
            new[1:] |= anchor[1:] != anchor[:-1]
    at = np.flatnonzero(new)
    cut = np.append(at, n)
    key = anchor[at].view(np.int64) if wh is not None else th[at]
    hashes = W.binary_column(wh, cut) if wh is not None else pa.nulls(len(at), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids[at], pa.int64()), pa.array(th[at], pa.int64()), pa.array(pos[at], pa.int32()), pa.array(np.diff(cut), pa.int32()), hashes], _RUN_NAMES)


_RUN_NAMES = ["key", "oid", "th", "start", "n", "hashes"]
_RUN = "key long, oid long, th long, start int, n int, hashes binary"


def _later(ids, th, pos, anchor, wh) -> np.ndarray:
    """Which windows have an equal one at a smaller (id, position)."""
    order = np.lexsort((pos, ids, anchor, wh))
    a, w = anchor[order], wh[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    i, p = ids[order], pos[order]
    out = np.empty(len(order), bool)
    out[order] = (i > i[first]) | (p > p[first])
    return out


def _candidates(batches: Iterator[pa.RecordBatch], width: int, gram: int, bits: int, sketch) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    maps, hot = sketch.value

    def dealt(anchor: np.ndarray, wh: np.ndarray) -> np.ndarray:
        """The key of each window: its anchor, or for a hot one, a mix of the anchor and the window's own hash."""
        if not len(hot):
            return anchor
        often = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        return np.where(often, W.mix(anchor ^ (wh >> W.U(64 - SPREAD))), anchor)

    def flush() -> Iterator[pa.RecordBatch]:
        ids, th, pos, anchor, wh = (np.concatenate(x) for x in zip(*held, strict=True))
        late = _later(ids, th, pos, anchor, wh)
        yield _runs(ids[late], th[late], pos[late], anchor[late])
        keep = ~late
        yield _runs(ids[keep], th[keep], pos[keep], dealt(anchor[keep], wh[keep]), wh[keep])

    for b in W.slices(batches, TEXT_SLICE):
        buf, off = W.flat(b.column(2))
        s, e, wo = W.words(buf, off)
        h, doc = W.word_hashes(buf, s, e), W.doc_of(wo)
        low, whole, _ = anchors(h, doc, width, gram)
        at = np.flatnonzero(whole)
        for row in range(DEPTH):
            c = _cells(low[at], row, bits)
            at = at[(maps[row][c >> W.U(3)] >> (c & W.U(7)).astype(np.uint8)) & 1 == 1]
        if not len(at):
            continue
        d = doc[at]
        held.append((b.column(0).to_numpy()[d], b.column(1).to_numpy()[d], (at - wo[d]).astype(np.int32), low[at], W.window_hashes(h, width)[at]))
        size += len(at)
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    names = ["oid", "th", "start", "n"]
    if not got:
        return
    t = pa.Table.from_batches(got)
    ready = t.filter(t.column("hashes").is_null())
    if ready.num_rows:
        yield from ready.select(names).to_batches()
    t = t.filter(t.column("hashes").is_valid())
    if not t.num_rows:
        return
    wh, n = W.joined_binary(t.column("hashes"), np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(wh)) - np.repeat(np.cumsum(n) - n, n)
    col = lambda c: t.column(c).to_numpy()
    ids, th, pos = col("oid")[row], col("th")[row], (col("start")[row] + inner).astype(np.int32)
    late = _later(ids, th, pos, col("key").view(np.uint64)[row], wh)
    order = np.flatnonzero(late)
    order = order[np.lexsort((pos[order], th[order], ids[order]))]
    yield _runs(ids[order], th[order], pos[order], wh[order]).select(names)


def repeated_windows(docs: DataFrame, width: int = 20, gram: int = 8) -> DataFrame:
    """(oid, th, start, n): windows start .. start + n - 1 of the text (id, text hash) stand earlier elsewhere too."""
    spark = docs.sparkSession
    gram = min(gram, width)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors_about = size / 6 * 2 / (width - gram + 2)
    bits = int(min(table_bits(spark), max(20, np.ceil(np.log2(4 * anchors_about + 1)))))
    sketch = spark.sparkContext.broadcast(merged_sketch(docs, width, gram, bits))
    keyed = docs.select(order_id().alias("oid"), F.xxhash64("text").alias("th"), "text")
    runs = keyed.mapInArrow(memory_returned(lambda it: _candidates(it, width, gram, bits, sketch)), _RUN)
    return runs.repartition("key").mapInArrow(memory_returned(_marks), "oid long, th long, start int, n int")


def _kept(batches: Iterator[pa.RecordBatch], width: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, gone, digest, kept = [], [], [], []
        for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            ws = (text or "").encode().split()
            n_words.append(len(ws))
            if marks:
                edge = np.zeros(len(ws) + 1, np.int32)
                at = np.array([m["start"] for m in marks])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + np.array([m["n"] for m in marks]) + width - 1, -1)
                ws = [w for w, c in zip(ws, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
            gone.append(n_words[-1] - len(ws))
            joined = b" ".join(ws)
            digest.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined if texts else b"")
        cols = [b.column(0), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if texts:
            cols.append(pa.array([k.decode() for k in kept], pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(cols, names)


def dedup_substrings(docs: DataFrame, width: int = 20, gram: int = 8, keep_text: bool = False) -> DataFrame:
    """Remove every word covered by a `width`-word window that also starts earlier.

    Earlier is a smaller doc_id, or the same document and an earlier start. One row per input row:
    doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), and kept_text on request.
    Null and empty texts have no words. Rows that repeat a doc_id count as the same document, so equal
    windows at the same start remove nothing from each other. A null doc_id sorts before all others.
    An empty table gives no rows; other columns of docs are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = repeated_windows(docs, width, gram).groupBy("oid", "th").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    keyed = docs.withColumns({"oid": order_id(), "th": F.xxhash64("text")})
    both = keyed.join(marks.hint("shuffle_hash"), ["oid", "th"], "left").select("doc_id", "text", "marks")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return both.mapInArrow(memory_returned(lambda it: _kept(it, width, keep_text)), schema)
