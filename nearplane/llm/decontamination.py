"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers bit-parallel verification.

Text is compared in normal form: lower case, white-space runs as one space. An item of m characters may
differ from a passage by k = floor(rate * m) edits. Cut into k + 1 pieces, one piece must occur unchanged,
so an Aho-Corasick automaton over all pieces finds every candidate place in one pass over the text.
Overlapping places of one item merge, so verification is linear in the text for each item at worst.
Items are handled in blocks of `BLOCK_CHARS` characters; each block is broadcast and every document is
read against it, without joins or shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from uuid import uuid4

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearplane.llm._common import memory_returned

RATE = 0.05
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """item cut into k + 1 pieces of nearly equal length, with their offsets."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: Iterable[str], anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of text (a prefix, if anchored), and its first end."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full | anchored
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """All items of a block: their pieces in one automaton, and their bit masks."""

    def __init__(self, items: list[tuple[str, list[int]]], rate: float):
        import ahocorasick

        self.items, self.rate = items, rate
        self.budget = [int(rate * len(text)) for text, _ in items]
        self.masks: dict[int, tuple[dict, dict]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (text, _) in enumerate(items):
            for at, piece in pieces(text, self.budget[i]):
                found.setdefault(piece, []).append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        self.any = bool(found)
        if found:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of the best place of each item found in a normalised text."""
        out = []
        places: dict[int, list[int]] = {}
        if self.any:
            for last, (size, where) in self.auto.iter(text):
                for i, at in where:
                    places.setdefault(i, []).append(last + 1 - size - at)
        for i, starts in places.items():
            item, k = self.items[i][0], self.budget[i]
            m = len(item)
            if i not in self.masks:
                self.masks[i] = pattern_masks(item), pattern_masks(item[::-1])
            best = None
            lo = hi = -1
            for s in [*sorted(starts), None]:
                if s is not None and hi >= 0 and s - k <= hi:
                    hi = max(hi, s + m + k)
                    continue
                if hi >= 0:
                    lo = max(0, lo)
                    d, end = myers(self.masks[i][0], m, text[lo:hi])
                    if d <= k and (best is None or d < best[0]):
                        best = d, lo + end
                if s is not None:
                    lo, hi = s - k, s + m + k
            if best:
                _, size = myers(self.masks[i][1], m, text[max(0, best[1] - m - k) : best[1]][::-1], anchored=True)
                out.append((i, best[0], best[1] - size, best[1]))
        return out


_made: dict[str, Matcher] = {}  # of this Python worker, the last block only


def _matcher(block: Broadcast, rate: float) -> Matcher:
    name, items = block.value
    if name not in _made:
        _made.clear()
        _made[name] = Matcher(items, rate)
    return _made[name]


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[str, list[int]]]]:
    held: dict[str, list[int]] = {}
    size = 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        text = normal(r[1])
        if not text:
            continue
        held.setdefault(text, []).append(r[0])
        size += len(text)
        if size >= BLOCK_CHARS:
            yield list(held.items())
            held, size = {}, 0
    if held:
        yield list(held.items())


def _found(batches: Iterator[pa.RecordBatch], block: Broadcast, rate: float) -> Iterator[pa.RecordBatch]:
    m = _matcher(block, rate)
    for b in batches:
        rows = [(d, item, edits, start, end) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for i, edits, start, end in m.find(normal(t)) for item in m.items[i][1]]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)


_NAMES = ["doc_id", "item_id", "n_edits", "start", "end"]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, n_edits, start, end): the best place of each benchmark item in each document that has it.

    start and end are code points of the normalised text, end exclusive; ties go to the first end. A document
    or item that stands in several rows gives a row for each; a null id is given back as null. Null or empty texts
    and items match nothing. Whole texts are read, however long, and items of any length are searched for: one
    under 1 / rate characters must stand unchanged. Empty tables give no rows, and further columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{n} long" for n in _NAMES)
    parts = []
    for block in _item_blocks(items):
        sent = spark.sparkContext.broadcast((uuid4().hex, block))
        parts.append(docs.mapInArrow(memory_returned(lambda it, sent=sent: _found(it, sent, rate)), schema))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def _clean(batches: Iterator[pa.RecordBatch], text: int, block: Broadcast, rate: float) -> Iterator[pa.RecordBatch]:
    m = _matcher(block, rate)
    for b in batches:
        yield b.filter(pa.array([not (t and m.find(normal(t))) for t in b.column(text).to_pylist()], pa.bool_()))


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, with all their columns, whose text has no benchmark item; see contaminated().

    Rows with a null or empty text stay, and so do all rows if there are no items; repeated rows are decided alike.
    """
    spark = docs.sparkSession
    for block in _item_blocks(items):
        sent = spark.sparkContext.broadcast((uuid4().hex, block))
        docs = docs.mapInArrow(memory_returned(lambda it, sent=sent, at=docs.columns.index("text"): _clean(it, at, sent, rate)), docs.schema)
    return docs
