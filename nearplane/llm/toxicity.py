"""Toxicity by a subsequence string-kernel SVM with Nystrom landmarks.

The kernel counts common subsequences of `P` letters, each weighted by LAMBDA to the length it spans in
both strings, so gaps and inserted characters lower a match without breaking it. Strings are the words of
a text with everything but letters dropped (look-alike digits read as letters) and runs of single letters
joined; a start symbol stands before each. Labels are of documents, so training looks for the stems that
cover most toxic documents at few clean ones, and takes the strings with these stems as toxic examples.
Landmarks are the stems and further strings; Nystrom features over them feed a linear SVM with squared
hinge loss. A text scores by its worst strings, calibrated on training documents.

A string of two or three letters has a kernel of lower order: of all its letters and the start symbol, so
it is like an equal string only. Stems are added until no further one explains two toxic documents.

Every distinct string of a text is scored by its features; a bounded memo spares strings that a Python worker has
scored before. The bounds on what training looks at are the constants `TRAIN_*` and `FIT_*`.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearplane.llm import _words as W
from nearplane.llm._common import TEXT_SLICE, memory_returned

P = 4
LAMBDA = 0.6
WIDTH = 24  # letters of a string; longer words are read in windows that overlap by half
ROW = WIDTH + 1  # a string's row: START or INNER, its letters, zeros
START, INNER = 2, 3  # the row is from a word's start, or a later window
LEAST = 2  # toxic documents that a stem must add; what a single document says alone is no evidence
SHORTEST = 2  # letters of a string
LANDMARKS = 48
LAND_WIDTH = 14  # letters of a landmark, with its start symbol
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 4000  # bound of the labelled sample, in documents
FIT_TOXIC, FIT_NEAR, FIT_PLAIN = 6000, 12000, 6000  # bound of the SVM's examples: strings with a stem, near one, and others
SHARE = 0.8  # of a stem that a string has in order, to be an example near it
TOP = 3  # a text scores by its worst strings
DECIDE_ROWS = 1 << 15  # strings whose features stand in memory at once
MEMO = 1_000_000  # strings whose values a Python worker remembers, 12 bytes each

_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
for _digit, _as in zip(b"013457@$", b"oieastas", strict=True):
    _LETTER[_digit] = _as


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: distinct strings by ascending hash, these as rows of ROW bytes, and the (string, text) pairs."""
    buf, off = W.flat(col)
    s, e, wo = W.words(buf, off)
    doc = W.doc_of(wo)
    kept = _LETTER[buf]
    has = kept != 0
    place = np.concatenate([[0], np.cumsum(has)])
    small = kept[has]
    a, z = place[s], place[e]
    size = z - a
    single = size == 1
    if single.any():
        new = np.ones(len(single), bool)
        new[1:] = ~(single[1:] & single[:-1] & (doc[1:] == doc[:-1]))
        first = np.flatnonzero(new & single)
        run = np.cumsum(new)
        count = np.bincount(run[single], minlength=run[-1] + 1)[run[first]]
        first, count = first[count >= SHORTEST], count[count >= SHORTEST]
        a, z, doc = np.concatenate([a, a[first]]), np.concatenate([z, z[first + count - 1]]), np.concatenate([doc, doc[first]])
        size = z - a
    ok = size >= SHORTEST
    a, z, doc, size = a[ok], z[ok], doc[ok], size[ok]
    start = np.full(len(a), START, np.uint8)
    if (size > WIDTH).any():
        step = WIDTH // 2
        n = np.where(size > WIDTH, -(-(size - WIDTH) // step) + 1, 1)
        row = np.repeat(np.arange(len(a)), n)
        part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        a, start = a[row] + part * step, np.where(part > 0, INNER, START).astype(np.uint8)
        z, doc = np.minimum(z[row], a + WIDTH), doc[row]
        size = z - a
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros((0, ROW), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, first, inv = np.unique(W.word_hashes(small, a, z) * W.U(5) ^ start, return_index=True, return_inverse=True)
    at = a[first][:, None] + np.arange(WIDTH)[None, :]
    out = np.zeros((len(first), ROW), np.uint8)
    out[:, 0] = start[first]
    out[:, 1:] = small[np.minimum(at, len(small) - 1)]
    out[:, 1:][np.arange(WIDTH)[None, :] >= size[first][:, None]] = 0
    return names, out, inv, doc


def as_rows(words: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint8)
    for i, w in enumerate(words):
        out[i, : min(len(w), width)] = np.frombuffer(w[:width], np.uint8)
    return out


def _by_length(x: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Places of the rows of x in groups of about one length, as a group costs what its longest row does."""
    order = np.argsort((x != 0).sum(1), kind="stable")
    return (order[lo : lo + step] for lo in range(0, len(x), step))


def kernel(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of all rows of x with all rows of t; (rows of t, rows of x)."""
    out = np.zeros((len(t), len(x)), np.float32)
    for of in _by_length(t, 16):
        other = np.where(t[of] == 0, 1, t[of])[:, None, :]
        for at in _by_length(x, 2048):
            out[np.ix_(of, at)] = _kernel(x[None, at, :], other)
    return out


def self_kernel(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.float32)
    for at in _by_length(x, 8192):
        part = x[None, at, :]
        out[at] = _kernel(part, np.where(part == 0, 1, part))[0]
    return out


def _kernel(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    lam = np.float32(LAMBDA)
    length = int((x != 0).any(axis=(0, 1)).sum())
    shape = np.broadcast_shapes(x.shape[:2], t.shape[:2])
    width = int((t != 1).any(axis=(0, 1)).sum())
    prev = np.zeros((P, width + 1, *shape), np.float32)  # prev[i][j]: K'_i of x so far and t[:j]
    prev[0] = 1
    total = np.zeros(shape, np.float32)
    for a in range(length):
        same = [(x[:, :, a] == t[:, :, j]) for j in range(width)]
        hit = [m.any() for m in same]
        for j in range(width):
            if hit[j]:
                total += same[j] * prev[P - 1][j] * (lam * lam)
        for i in range(P - 1, 0, -1):
            inner = np.zeros(shape, np.float32)
            prev[i] *= lam
            for j in range(width):
                inner *= lam
                if hit[j]:
                    inner += same[j] * prev[i - 1][j] * (lam * lam)
                prev[i][j + 1] += inner
        # row 0 of the recurrence stays: K'_0 is 1 for all prefixes
    return total


@dataclass
class Gate:
    """Stems packed into 64-bit words, a spare bit after each, for a common-subsequence test that finds examples near them."""

    masks: np.ndarray  # (packs, 256)
    fields: list[tuple[int, int, int]]  # pack, bits, letters needed
    all: np.ndarray
    short: list[bytes]  # under P letters: whole strings

    @classmethod
    def of(cls, words: list[bytes]) -> Gate:
        masks: list[np.ndarray] = []
        fields, used = [], 64
        for w in (w for w in words if len(w) > P):
            if used + len(w) + 1 > 64:
                masks.append(np.zeros(256, np.uint64))
                used = 0
            for i, c in enumerate(w):
                masks[-1][c] |= np.uint64(1 << (used + i))
            fields.append((len(masks) - 1, ((1 << len(w)) - 1) << used, max(P, int(np.ceil(SHARE * len(w))))))
            used += len(w) + 1
        full = [sum(b for p, b, _ in fields if p == k) for k in range(len(masks))]
        return cls(np.array(masks), fields, np.array(full, np.uint64), [w for w in words if len(w) <= P])

    def passes(self, x: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(x), bool)
        length = (x != 0).sum(1)
        order = np.argsort(-length, kind="stable")
        for p in range(len(self.masks)):
            full = self.all[p]
            v = np.full(len(x), full, np.uint64)
            for a in range(int(length.max(initial=0))):
                live = int(np.searchsorted(-length[order], -a, "left"))
                m = self.masks[p][x[order[:live], a]]
                u = v[:live] & m
                v[:live] = ((v[:live] + u) | (v[:live] & ~m)) & full
            for q, bits, need in self.fields:
                if q == p:
                    ok[order] |= np.bitwise_count(~v & np.uint64(bits)) >= need
        ok &= ~is_short(x)
        return ok | same_short(x, as_rows(self.short, ROW)).any(1)


def is_short(x: np.ndarray) -> np.ndarray:
    return x[:, P] == 0


def same_short(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether the short strings of t, with their start symbols, are those of x; (rows of x, rows of t)."""
    out = is_short(x)[:, None] & is_short(t)[None, :]
    for i in range(P):
        out &= x[:, i, None] == t[None, :, i]
    return out


@dataclass
class Model:
    stems: list[bytes]
    toxic: list[bytes]  # further landmarks that are toxic
    landmarks: list[bytes]
    weights: np.ndarray  # of normalised kernel values
    bias: float
    calibration: np.ndarray  # weights of a text's TOP highest values, and an offset

    def __post_init__(self):
        self.rows = as_rows(self.landmarks, LAND_WIDTH)
        self.norm = np.sqrt(self_kernel(self.rows))
        self.memo = Memo()  # lives as long as the broadcast model in a Python worker

    def features(self, x: np.ndarray) -> np.ndarray:
        out = (kernel(x, self.rows) / np.maximum(self.norm[:, None] * np.sqrt(self_kernel(x))[None, :], 1e-12)).T
        return np.where(is_short(x)[:, None] | is_short(self.rows)[None, :], same_short(x, self.rows), out)

    def decide(self, x: np.ndarray) -> np.ndarray:
        """The SVM's value of each string."""
        out = np.full(len(x), self.bias, np.float32)
        for lo in range(0, len(x) if len(self.landmarks) else 0, DECIDE_ROWS):
            out[lo : lo + DECIDE_ROWS] = self.features(x[lo : lo + DECIDE_ROWS]) @ self.weights + self.bias
        return out

    def score(self, col: pa.Array) -> np.ndarray:
        names, x, inv, doc = strings(col)
        value = self.memo.values(self, names, x)
        some = np.flatnonzero(value[inv] > self.bias)
        pair = W.distinct(doc[some] * max(1, len(x)) + inv[some])
        return self.calibrated(highest(pair // max(1, len(x)), value[pair % max(1, len(x))], len(col), self.bias))

    def calibrated(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top @ self.calibration[:-1] + self.calibration[-1], -40, 40)))


class Memo:
    """Values of strings by hash, at most MEMO of them."""

    def __init__(self):
        self.names, self.known = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def values(self, model: Model, names: np.ndarray, x: np.ndarray) -> np.ndarray:
        if len(self.names) + len(names) > MEMO:
            self.__init__()
        place = np.searchsorted(self.names, names)
        new = np.ones(len(names), bool)
        if len(self.names):
            new = self.names[np.minimum(place, len(self.names) - 1)] != names
        out = np.empty(len(names), np.float32)
        out[~new], out[new] = self.known[place[~new]], model.decide(x[new])
        both = np.concatenate([self.names, names[new]])
        order = np.argsort(both, kind="stable")
        self.names, self.known = both[order], np.concatenate([self.known, out[new]])[order]
        return out


def highest(doc: np.ndarray, value: np.ndarray, n: int, floor: float) -> np.ndarray:
    """The TOP highest values of each of n texts, filled with floor."""
    out = np.full((n, TOP), floor, np.float64)
    order = np.lexsort((-value, doc))
    doc, value = doc[order], value[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    ok = rank < TOP
    out[doc[ok], rank[ok]] = np.maximum(value[ok], floor)
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in W.slices(batches, TEXT_SLICE, "text"):
        _, x, inv, doc = strings(b.column(1))
        pair = W.distinct(doc * max(1, len(x)) + inv)
        cut = np.searchsorted(pair, np.arange(b.num_rows + 1) * max(1, len(x)))
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), W.binary_column(x[pair % max(1, len(x))].reshape(-1), cut * ROW)], ["doc_id", "toxic", "strings"])


def _svm(f: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 400) -> np.ndarray:
    """Linear squared-hinge SVM by accelerated gradient; the last weight is the bias."""
    f = np.hstack([f, np.ones((len(f), 1))])
    w = v = np.zeros(f.shape[1])
    lip = 1 + 2 * c * np.linalg.norm(f * np.sqrt(weight)[:, None], 2) ** 2
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (f @ v))
        g = v - 2 * c * f.T @ (weight * y * slack)
        nxt = v - g / lip
        v, w = nxt + k / (k + 3) * (nxt - w), nxt
    return w


def _stems(x: np.ndarray, string: np.ndarray, doc: np.ndarray, label: np.ndarray) -> list[bytes]:
    """Letter sequences near word starts that cover the toxic documents, each with few clean ones; greedily."""
    nt, nc = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    found: dict[bytes, tuple[set[int], int]] = {}

    def count(part: np.ndarray, whole: np.ndarray) -> None:
        names, inv = np.unique(np.ascontiguousarray(part[whole]).view(f"V{part.shape[1]}").ravel(), return_inverse=True)
        of = np.full(len(x), -1)
        of[whole] = inv
        ok = of[string] >= 0
        pair = W.distinct(of[string[ok]] * len(label) + doc[ok])
        gram, where = pair // len(label), pair % len(label)
        toxic = np.bincount(gram, label[where], len(names))
        clean = np.bincount(gram, 1 - label[where], len(names))
        for g in np.flatnonzero((toxic >= LEAST) & (toxic / nt > 3 * clean / nc)):
            a, z = np.searchsorted(gram, [g, g + 1])
            w = where[a:z]
            found[names[g].tobytes().rstrip(b"\0")] = set(w[label[w] == 1].tolist()), int(clean[g])

    for lo in (0, 1, 2):
        for size in (5, 6, 7):
            part = x[:, lo : lo + size]
            count(part, np.flatnonzero((part[:, -1] != 0) & (part[:, 0] != INNER)))
    count(x[:, : P + 1], np.flatnonzero(is_short(x)))
    left, out = set(np.flatnonzero(label).tolist()), []

    def entry(s: bytes) -> tuple[float, int, int, bytes]:
        return 3 * found[s][1] * nt / nc - len(found[s][0] & left), -len(found[s][0]), -len(s), s

    heap = [entry(s) for s in found]
    heapq.heapify(heap)
    while heap and -heap[0][0] >= LEAST:  # gains only fall, so an entry that is still true is the best
        best = heap[0][-1]
        if entry(best) != heap[0]:
            heapq.heapreplace(heap, entry(best))
            continue
        heapq.heappop(heap)
        out.append(best)
        left -= found[best][0]
    return out


def distinct(every: np.ndarray, step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of strings in byte order, and the place of each row among them; by 64-bit hashes."""
    h = np.empty(len(every), np.uint64)
    for lo in range(0, len(every), step):
        part = np.zeros((len(every[lo : lo + step]), 32), np.uint8)
        part[:, :ROW] = every[lo : lo + step]
        own = np.zeros(len(part), np.uint64)
        for word in part.view(np.uint64).T:
            own = W.mix(own * W.U(5) ^ word)
        h[lo : lo + step] = own
    _, first, inv = np.unique(h, return_index=True, return_inverse=True)
    x = every[first]
    order = np.argsort(np.ascontiguousarray(x).view(f"S{ROW}").ravel(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return x[order], place[inv]


def fit(bags: list[tuple[int, np.ndarray]], seed: int = 11) -> Model:
    """From (label, rows of distinct strings) of training documents; takes the list's contents."""
    rng = np.random.default_rng(seed)
    label = np.array([int(y) for y, _ in bags], np.int64)
    none = Model([], [], [], np.zeros(0), -1.0, np.array([0.0] * TOP + [-4.0]))
    if not label.any():
        return none
    n = len(bags)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(x) for _, x in bags])
    every = np.concatenate([x for _, x in bags])
    bags.clear()
    x, string = distinct(every)
    del every
    stems = _stems(x, string, doc, label)
    if not stems:
        return none
    ct = np.bincount(string, label[doc], len(x))
    cc = np.bincount(string, 1 - label[doc], len(x))
    passed = Gate.of(stems).passes(x)
    text = [r.tobytes().rstrip(b"\0") for r in x[passed]]
    has = np.zeros(len(x), bool)
    has[passed] = [any(s == t if len(s) <= P else s in t for s in stems) for t in text]
    toxic = np.flatnonzero(has & (ct > 0))
    toxic = toxic[np.lexsort((toxic, -ct[toxic]))][:FIT_TOXIC]
    room = max(LANDMARKS // 4, (LANDMARKS - len(stems)) // 2)
    mark = lambda group: [x[i].tobytes().rstrip(b"\0")[:LAND_WIDTH] for i in group[:room]]
    toxic_marks = mark(toxic)
    passed |= Gate.of(toxic_marks).passes(x)
    clean = np.flatnonzero(passed & ((cc > 0) | (ct > 0) & ~has))
    clean = clean[np.lexsort((clean, -cc[clean]))][:FIT_NEAR]
    plain = np.flatnonzero(~passed & (cc > 0))
    plain = plain[rng.permutation(len(plain))[:FIT_PLAIN]]
    marks = list(dict.fromkeys([*stems, *toxic_marks, *mark(clean)]))
    model = Model(stems, toxic_marks, marks, np.zeros(len(marks)), -1.0, np.zeros(TOP + 1))  # weights follow; nothing is scored before
    f = model.features(np.concatenate([x[toxic], x[clean], x[plain]])).astype(np.float64)
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean) + len(plain))])
    nt, nc = max(1, label.sum()), max(1, (1 - label).sum())
    weight = np.concatenate([ct[toxic] / nt, np.maximum(cc[clean], 0.5) / nc * 3, np.full(len(plain), 1 / nc)]) * 100
    # a text without any string near a stem is clean
    f, y, weight = np.vstack([f, np.zeros(f.shape[1])]), np.append(y, -1.0), np.append(weight, 100.0)
    land = model.features(model.rows).astype(np.float64)
    val, vec = np.linalg.eigh((land + land.T) / 2)
    root = vec / np.sqrt(np.maximum(val, 1e-3))[None, :]
    w = _svm(f @ root, y, weight)
    model.weights, model.bias = root @ w[:-1], float(w[-1])
    value = model.decide(x)
    live = value[string] > model.bias
    top = highest(doc[live], value[string[live]], n, model.bias)
    model.calibration = _logistic(top, label)
    return model


def _logistic(top: np.ndarray, label: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights (not below 0) and offset that predict label, by Newton steps with a small ridge."""
    f = np.hstack([top, np.ones((len(top), 1))])
    w = np.zeros(f.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
        h = (f * (p * (1 - p) + 1e-6)[:, None]).T @ f + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(h, f.T @ (p - label) + 0.05 * w)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def _fit_task(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        ids, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
        data, size = W.joined_binary(b.column(2), np.uint8)
        for d, y, s in zip(ids, labels, np.split(data, np.cumsum(size)[:-1]), strict=True):
            rows.append((d, y, zlib.crc32(s), s.reshape(-1, ROW)))
    rows.sort(key=lambda r: r[:3])
    bags = [(y, s) for _, y, _, s in rows]
    rows.clear()
    model = fit(bags, seed)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """Fit on at most TRAIN_TOXIC toxic and TRAIN_CLEAN clean labelled documents, those with the smallest seeded hashes."""
    lab = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    part = lambda y, n: lab.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(n)
    some = part(1, TRAIN_TOXIC).union(part(0, TRAIN_CLEAN)).select("doc_id", "toxic").collect()  # bounded above
    some = F.broadcast(docs.sparkSession.createDataFrame(some, "doc_id long, toxic int"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = text.join(some, "doc_id").select("toxic", "text", "doc_id").mapInArrow(memory_returned(_bags), "doc_id long, toxic int, strings binary")
    # the sample is bounded, so one task can hold it; the driver only gets the model
    got = rows.repartition(1).mapInArrow(memory_returned(lambda it: _fit_task(it, seed)), "model binary").first()
    return pickle.loads(got["model"]) if got else fit([], seed)


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in W.slices(batches, TEXT_SLICE):
        score = m.score(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])


def score_toxicity(docs: DataFrame, model: Model, held: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (score >= 0.5).

    Whole texts are read. Null, empty and letterless texts get the score of a text without any toxic string.
    Repeated rows each give a row; only doc_id and text are read; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(False) if held is None else held).alias("held_out"))
    return rows.mapInArrow(memory_returned(lambda it: _scores(it, sent)), "doc_id long, held_out boolean, score double, predicted int")


def _passing(batches: Iterator[pa.RecordBatch], model, text: int) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in W.slices(batches, TEXT_SLICE):
        yield b.filter(pa.array(m.score(b.column(text)) < 0.5))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the model does not predict toxic.

    Whole texts are read. Rows with a null, empty or letterless text stay, unless the model scores an empty
    text 0.5 or more; repeated rows are decided alike; an empty table stays empty.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    return docs.mapInArrow(memory_returned(lambda it: _passing(it, sent, at)), docs.schema)
