"""Exact set-similarity self-join of word-shingle sets under several global token orders.

A pair with Jaccard >= t shares, under any global order of tokens, a token of both prefixes (the first
n - ceil(t n) + 1 tokens of a set of n). Each order is a filter of its own; a candidate must pass all.

1. Token classes: every partition reports tokens that several of its distinct sets have; the classes
   (log2 of the summed counts, for at most `MAX_FREQUENT` tokens) put frequent tokens last in every
   order. They only steer which tokens stand in prefixes; any classes give the same result.
2. Sets are named by a hash of their tokens, so exact copies meet as one set. Prefix tokens under the
   first order travel to the bucket of the token. There a set is paired with the larger sets of the token
   that its size allows; where these are many, a chain through them stands for all their pairs.
3. A parity bitmap bounds the difference of the sets of a pair from below and rules most chance pairs out.
   Pairs must also share a prefix token under each further order, checked on small prefix sketches.
   Components of the pairs that are left and of the chains are blocks. Blocks are cut by set size and hash
   into cells, and cell pairs of compatible sizes into tiles, inside which all pairs are verified together
   on whole sets; a set travels once to each tile, not once for each pair.
4. Verified links make components, which documents get back through their set's name.

Sets are rebuilt from the text where they are needed: sketches for sets in a candidate, whole sets for members of
blocks. A Bloom bitmap of bounded size names the rows to look at, one for each set, however many copies it has.

Words, shingles and sets are known by 64-bit hashes. Two given sets of a and b shingles share a false one with a
probability of a b / 2**64 (5e-11 for a = b = 32,000), which changes the answer only for pairs that are a single
shingle off the threshold; any two of N different sets share a name with a probability of N**2 / 2**65 (0.03 for a
billion). Within these odds the join is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearplane.llm import _words as W
from nearplane.llm._common import LOWEST_ID, TEXT_SLICE, memory_returned, order_id, shuffle_parts, stored, table_bits
from nearplane.llm.components import connected_components

MAX_FREQUENT = 1_000_000
LOCAL_FREQUENT = 3  # distinct sets of a partition that a token must stand in to be reported
PARTNERS = 16  # sets of one token and a matching size up to which pairs are listed
CELL, CELL_TOKENS = 128, 1_000_000  # sets and tokens of a cell of a block
CUT_ROWS = 200_000  # rows of the table of cut blocks up to which it is broadcast
BLOOM_BLOCK = 19  # log2 of the bits of a block of the bitmap
ORDERS = (0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
_SIG = (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of all texts end to end, and their n + 1 offsets."""
    buf, off = W.flat(col)
    buf = W.lower_ascii(buf)
    s, e, wo = W.words(buf, off)
    h = W.word_hashes(buf, s, e)
    n = np.diff(wo)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(out_off[-1], np.uint64)
    grams = W.window_hashes(h, k)
    long_ = np.flatnonzero(n >= k)
    if len(long_):
        at = np.repeat(wo[long_] - out_off[long_], size[long_]) + _spans(out_off[long_], size[long_])
        out[_spans(out_off[long_], size[long_])] = grams[at]
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[out_off[i]] = W.window_hashes(h[wo[i] : wo[i + 1]], int(n[i]))[0] ^ W.U(n[i])
    for i in long_:
        out[out_off[i] : out_off[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[out_off[:-1][size > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[out_off]


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i] .. first[i] + size[i] - 1 for all i, end to end."""
    total = int(size.sum())
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)


def signatures(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty set."""
    sums = np.concatenate([[W.U(0)], np.cumsum(W.mix(tokens ^ W.U(_SIG[0])), dtype=np.uint64)])
    n = np.diff(off).astype(np.uint64)
    sig = W.mix((sums[off[1:]] - sums[off[:-1]]) ^ (n * W.U(_SIG[1]))) | W.U(1)
    return np.where(n > 0, sig, W.U(0))


def _sets(batches: Iterator[pa.RecordBatch], k: int, text: int, once: bool = True):
    """(tokens, offsets, signatures, rows) of each slice; rows are the first of each set in the partition if once."""
    seen = np.zeros(0, np.uint64)
    for b in W.slices(batches, TEXT_SLICE):
        tokens, off = shingle_sets(b.column(text), k)
        sig = signatures(tokens, off)
        rows = np.arange(len(sig))
        if once:
            _, rows = np.unique(sig, return_index=True)
            rows = rows[(sig[rows] != 0) & ~np.isin(sig[rows], seen)]
            seen = W.distinct(np.concatenate([seen, sig[rows]]))
        yield b, tokens, off, sig, rows


_MIXED = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def row_keys(sig: np.ndarray, oid: np.ndarray, text_key: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row by its set, id and text; the least one of a set's rows stands for the set."""
    return W.mix(sig ^ W.mix(oid.view(np.uint64) * W.U(_MIXED[0]) ^ text_key.view(np.uint64) * W.U(_MIXED[1])))


def _frequent(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        t, c = np.unique(np.concatenate(held), return_counts=True)
        t, c = t[c >= LOCAL_FREQUENT], c[c >= LOCAL_FREQUENT]
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c, pa.int64())], ["token", "c"])

    for _, tokens, off, _, rows in _sets(batches, k, 0):
        n = off[rows + 1] - off[rows]
        held.append(tokens[_spans(off[rows], n)])
        size += len(held[-1])
        if size > 4_000_000:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def token_classes(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens and their classes."""
    local = docs.select("text").mapInArrow(memory_returned(lambda it: _frequent(it, k)), "token long, c long")
    total = local.groupBy("token").agg(F.sum("c").alias("c")).where("c >= 8").orderBy(F.desc("c"), "token").limit(MAX_FREQUENT)
    t = total.toArrow()
    token, c = t.column(0).to_numpy().astype(np.int64).view(np.uint64), t.column(1).to_numpy().astype(np.int64)
    at = np.argsort(token)
    return token[at], np.minimum(63, np.log2(np.maximum(c[at], 1))).astype(np.uint64)


def ranked(tokens: np.ndarray, order: int, classes) -> np.ndarray:
    """Each token's place in a global order: its class, then a seeded hash."""
    out = W.mix(tokens ^ W.U(ORDERS[order])) >> W.U(6)
    names, cls = classes
    if len(names):
        at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
        out |= np.where(names[at] == tokens, cls[at], W.U(0)) << W.U(58)
    return out


def prefix_sizes(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - (-(-n * num // den)) + 1


def _postings(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, classes, buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        token, sig, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (W.mix(token) % W.U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        token, sig, n, place = token[order], sig[order], n[order], place[order]
        names, first = np.unique(bucket[order], return_index=True)
        cut = np.append(first, len(token))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), W.binary_column(token, cut), W.binary_column(sig, cut), W.binary_column(n, cut), W.binary_column(place, cut)], ["bucket", "token", "sig", "n", "place"])

    for _, tokens, off, sig, rows in _sets(batches, k, 0):
        rank = ranked(tokens, 0, classes.value)
        for i in rows:
            a, z = off[i], off[i + 1]
            p = int(prefix_sizes(z - a, num, den))
            own = rank[a:z]
            own = np.sort(np.partition(own, p - 1)[:p] if p < len(own) else own)
            held.append((own, np.full(p, sig[i]), np.full(p, z - a, np.int32), np.arange(p, dtype=np.int32)))
            size += p
        if size > 800_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


_CAND = "kind int, a long, b long"


def _cand(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch], num: int, den: int, most: int) -> Iterator[pa.RecordBatch]:
    """Of the sets of each token: pairs (kind 0) of a set with the few sets of a size it may match, and chains
    (kind 1) of neighbours by size where a set has many, so that all these sets hang together."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    token, sig, n, spot = (W.joined_binary(t.column(c), d)[0] for c, d in (("token", np.uint64), ("sig", np.uint64), ("n", np.int32), ("place", np.int32)))
    order = np.lexsort((sig, n, token))
    token, sig, n, spot = token[order], sig[order], n[order], spot[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
    token, sig, n, spot = token[keep], sig[keep], n[keep], spot[keep]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    place = (np.cumsum(new) << 32) + n  # ascending: token, then size
    at = np.arange(len(token))
    partners = np.searchsorted(place, place - n + n.astype(np.int64) * den // num, "right") - at - 1
    few = np.flatnonzero((partners > 0) & (partners <= most))
    if len(few):
        i = np.repeat(few, partners[few])
        j = _spans(few + 1, partners[few])
        # if this is their first common token, at most the rest of either set is common
        m = n.astype(np.int64)
        ok = np.minimum(m[i] - spot[i], m[j] - spot[j]) * (den + num) >= num * (m[i] + m[j])
        i, j = i[ok], j[ok]
        low, high = np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        yield _cand(0, low[keep], high[keep])
    many = np.flatnonzero(partners > most)
    if len(many):
        edge = np.zeros(len(token) + 1, np.int64)
        np.add.at(edge, many, 1)
        np.add.at(edge, many + partners[many], -1)
        i = np.flatnonzero(np.cumsum(edge) > 0)
        both = np.unique(np.stack([sig[i], sig[i + 1]], 1), axis=0)
        yield _cand(1, both[:, 0].copy(), both[:, 1].copy())


def _bloom_cells(sig: np.ndarray, bits: int) -> list[np.ndarray]:
    return [W.mix(sig * W.U(m)) >> W.U(64 - bits) for m in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


def _bloom_part(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the bitmap that a task's sets touch."""
    at = [np.concatenate(_bloom_cells(b.column(0).to_numpy().view(np.uint64), bits)) for b in batches if b.num_rows]
    cells = W.distinct(np.concatenate(at)) if at else np.zeros(0, np.uint64)
    block = (cells >> W.U(BLOOM_BLOCK)).astype(np.int64)
    names, first = np.unique(block, return_index=True)
    inner = (cells & W.U((1 << BLOOM_BLOCK) - 1)).astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), W.binary_column(inner, np.append(first, len(inner)))], ["block", "cells"])


def _bloom_merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: dict[int, np.ndarray] = {}
    for b in batches:
        for block, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = have.setdefault(block, np.zeros((1 << BLOOM_BLOCK) // 8, np.uint8))
            at = np.frombuffer(cells, np.uint32)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int64()), pa.array([v.tobytes() for v in have.values()], pa.binary())], ["block", "bits"])


def bloom(involved: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the sets of involved, merged in executors block by block; the driver gets 2**bits bits at most."""
    out = np.zeros(1 << max(0, bits - 3), np.uint8)
    size = (1 << BLOOM_BLOCK) // 8
    merged = involved.mapInArrow(memory_returned(lambda it: _bloom_part(it, bits)), "block long, cells binary").repartition("block").mapInArrow(memory_returned(_bloom_merge), "block long, bits binary")
    for r in merged.collect():
        part = out[r["block"] * size : (r["block"] + 1) * size]
        part[:] = np.frombuffer(r["bits"], np.uint8)[: len(part)]
    return out


def _in_bloom(have: np.ndarray, sig: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(sig), bool)
    for c in _bloom_cells(sig, bits):
        ok &= (have[c >> W.U(3)] >> (c & W.U(7)).astype(np.uint8)) & 1 == 1
    return ok


def _standing(batches: Iterator[pa.RecordBatch], k: int, have: np.ndarray, bits: int):
    """(tokens, offsets, signatures, rows) of each slice of rows (text, oid, text_key); rows are those named in the bitmap."""
    for b, tokens, off, sig, _ in _sets(batches, k, 0, once=False):
        rows = np.flatnonzero((sig != 0) & _in_bloom(have, row_keys(sig, b.column(1).to_numpy(), b.column(2).to_numpy()), bits))
        if len(rows):
            yield tokens, off, sig, rows


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, classes, sent, bits: int) -> Iterator[pa.RecordBatch]:
    """Of sets in candidates: name, size, 16-bit sketches of their prefixes under the further orders, parity bitmap."""
    for tokens, off, sig, rows in _standing(batches, k, sent.value, bits):
        n = off[rows + 1] - off[rows]
        cut = np.concatenate([[0], np.cumsum(n)])
        kept = tokens[_spans(off[rows], n)]
        p = prefix_sizes(n, num, den)
        sketch = []
        for o in (1, 2):
            rank = ranked(kept, o, classes.value)
            own = []
            for i in range(len(rows)):
                x = rank[cut[i] : cut[i + 1]]
                own.append(W.distinct((np.partition(x, p[i] - 1)[: p[i]] if p[i] < len(x) else x).astype(np.uint16)).tobytes())
            sketch.append(pa.array(own, pa.binary()))
        odd = [parity(kept[cut[i] : cut[i + 1]]) for i in range(len(rows))]
        yield pa.RecordBatch.from_arrays([pa.array(sig[rows].view(np.int64)), pa.array(n, pa.int32()), *sketch, pa.array(odd, pa.binary())], ["sig", "n", "p2", "p3", "odd"])


def _whole_sets(batches: Iterator[pa.RecordBatch], k: int, sent, bits: int) -> Iterator[pa.RecordBatch]:
    for tokens, off, sig, rows in _standing(batches, k, sent.value, bits):
        n = off[rows + 1] - off[rows]
        yield pa.RecordBatch.from_arrays([pa.array(sig[rows].view(np.int64)), W.binary_column(tokens[_spans(off[rows], n)], np.concatenate([[0], np.cumsum(n)]))], ["sig", "tokens"])


def _meets(x: bytes, y: bytes) -> bool:
    return len(np.intersect1d(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), assume_unique=True)) > 0


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap of whether each cell has an odd number of tokens; about a bit for every two tokens."""
    bits = 1 << max(6, int(np.ceil(np.log2(max(1, len(tokens)) / 2))))
    cells = (W.mix(tokens ^ W.U(0x9FB21C651E98DF25)) & W.U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """At most as many tokens as stand in one of the two sets only; the larger bitmap is folded."""
    v, w = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(v) > len(w):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    while len(w) > len(v):
        w = w[: len(w) // 2] ^ w[len(w) // 2 :]
    return int(np.bitwise_count(v ^ w).sum())


def _parities_pass(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        ok = [_apart(x, y) * (den + num) <= (m + n) * (den - num) for x, y, m, n in zip(c["ao"], c["bo"], c["an"], c["bn"], strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _prefixes_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        ok = [_meets(x, y) and _meets(v, w) for x, y, v, w in zip(c["a2"], c["b2"], c["a3"], c["b3"], strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _tile(t: pa.Table, num: int, den: int, cols: int = 4096) -> pa.Table:
    """Of the links in a tile, between its two cells or within its one: for each set a row (set, set, documents
    linked), and edges (set, set, 0) of a spanning forest."""
    _, first = np.unique(t.column("sig").to_numpy(), return_index=True)
    t = t.take(pa.array(first))
    sig, cell = t.column("sig").to_numpy(), t.column("cell").to_numpy()
    tokens, n = W.joined_binary(t.column("tokens"), np.uint64)
    owner = np.repeat(np.arange(len(sig)), n)
    names, inv, count = np.unique(tokens, return_inverse=True, return_counts=True)
    del tokens
    shared = np.flatnonzero(count > 1)
    place = np.full(len(names), -1)
    place[shared] = np.arange(len(shared))
    at = place[inv]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sig), len(sig)), np.float32)
    for lo in range(0, len(shared), cols):
        a, z = np.searchsorted(at, [lo, lo + cols])
        m = np.zeros((len(sig), cols), np.float32)
        m[owner[a:z], at[a:z] - lo] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    ok = den * inter >= num * (n[:, None] + n[None, :] - inter)
    ok &= np.arange(len(sig))[:, None] < np.arange(len(sig))[None, :]
    if len(np.unique(cell)) > 1:
        ok &= cell[:, None] != cell[None, :]
    elif t.column("across")[0].as_py():
        ok[:] = False
    ok |= ok.T
    linked = np.flatnonzero(ok.any(1))
    copies = t.column("copies").to_numpy()
    out = [(sig[u], sig[u], int(copies[ok[u]].sum())) for u in linked]
    left = np.ones(len(sig), bool)
    for r in linked:
        todo = [r] if left[r] else []
        left[r] = False
        while todo:
            u = todo.pop()
            for v in np.flatnonzero(ok[u] & left):
                left[v] = False
                out.append((sig[u], sig[v], 0))
                todo.append(v)
    return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate("abw")})


def _named(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b, _, off, sig, _ in _sets(batches, k, 0, once=False):
        key = row_keys(sig, b.column(1).to_numpy(), b.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([b.column(3), b.column(2), pa.array(np.diff(off), pa.int64()), pa.array(sig.view(np.int64)), pa.array(key.view(np.int64))], ["doc_id", "text_key", "n_shingles", "sig", "row_key"])


def _named_in_bitmap(sets: DataFrame, per: DataFrame):
    """The bitmap of the rows that stand for sets (sig), broadcast, and log2 of its bits."""
    spark = sets.sparkSession
    keys = per.join(sets, "sig", "left_semi").select("row_key")
    bits = int(min(table_bits(spark, 27), max(16, np.ceil(np.log2(16 * keys.count() + 1)))))
    return spark.sparkContext.broadcast(bloom(keys, bits)), bits


def _links(docs: DataFrame, per: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, w): links that hold the components of different sets together, and rows (a, a, w) of linked documents.

    docs are (text, oid, text_key), per (sig, copies, row_key): row_key names the row that stands for the set.
    """
    spark = docs.sparkSession
    text = docs.select("text")
    classes = spark.sparkContext.broadcast(token_classes(docs, k))
    buckets, most = 4 * shuffle_parts(spark), PARTNERS
    posted = text.mapInArrow(memory_returned(lambda it: _postings(it, k, num, den, classes, buckets)), "bucket int, token binary, sig binary, n binary, place binary")
    cand = stored(posted.repartition("bucket").mapInArrow(memory_returned(lambda it: _candidates(it, num, den, most)), _CAND).distinct(), "candidates")
    have, bits = _named_in_bitmap(cand.select(F.col("a").alias("sig")).union(cand.select("b")).distinct(), per)
    # rows that repeat both id and text stand here several times
    small = docs.mapInArrow(memory_returned(lambda it: _prefixes(it, k, num, den, classes, have, bits)), "sig long, n int, p2 binary, p3 binary, odd binary")
    small = stored(small.dropDuplicates(["sig"]), "prefixes")
    odd = lambda n: small.select(F.col("sig").alias(n), F.col("n").alias(f"{n}n"), F.col("odd").alias(f"{n}o"))
    left = cand.where("kind = 0").select("a", "b").join(odd("a"), "a").join(odd("b"), "b").mapInArrow(memory_returned(lambda it: _parities_pass(it, num, den)), "a long, b long")
    side = lambda n: small.select(F.col("sig").alias(n), F.col("p2").alias(f"{n}2"), F.col("p3").alias(f"{n}3"))
    left = left.join(side("a"), "a").join(side("b"), "b").mapInArrow(memory_returned(_prefixes_meet), "a long, b long")
    blocks = stored(connected_components(left.union(cand.where("kind = 1").select("a", "b"))), "blocks")
    sent, width = _named_in_bitmap(blocks.select(F.col("node").alias("sig")), per)
    sets = docs.mapInArrow(memory_returned(lambda it: _whole_sets(it, k, sent, width)), "sig long, tokens binary").dropDuplicates(["sig"])
    return _block_links(blocks, small.select("sig", "n").join(per.select("sig", "copies"), "sig"), sets, num, den)


def _block_links(blocks: DataFrame, sizes_of: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Tiles of all blocks. A block of one cell is one tile; a larger one is cut by size into bands, and these into cells.

    Members learn their cells from the table of cut blocks, which has a row for each CELL members at most, so no
    block's members meet in a task before they are dealt to tiles.
    """
    step = float(np.log(den / num)) if num < den else 1e-9
    band = F.floor(F.log(F.col("n").cast("double")) / step) if num < den else F.col("n").cast("long")
    member = stored(blocks.join(sizes_of.withColumnRenamed("sig", "node"), "node").select("root", "node", "copies", "n", band.alias("band")), "members")
    sizes = member.groupBy("root", "band").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens"))
    large = sizes.groupBy("root").agg(F.sum("sets").alias("all_sets"), F.sum("tokens").alias("all_tokens")).where((F.col("all_sets") > CELL) | (F.col("all_tokens") > 2 * CELL_TOKENS))
    sizes = stored(sizes.join(large.select("root"), "root").select("root", "band", F.ceil(F.greatest(F.col("sets") / CELL, F.col("tokens") / CELL_TOKENS)).cast("int").alias("cells")), "cells")
    above = sizes.select("root", (F.col("band") - 1).alias("band"), F.col("cells").alias("above"))
    below = sizes.select("root", (F.col("band") + 1).alias("band"), F.col("cells").alias("below"))
    cut = stored(sizes.join(above, ["root", "band"], "left").join(below, ["root", "band"], "left"), "cut")
    few = F.broadcast if cut.count() <= CUT_ROWS else (lambda df: df)
    whole = member.join(few(cut.select("root").distinct()), "root", "left_anti")
    one = whole.select("root", F.lit(0).cast("long").alias("g"), F.lit(False).alias("across"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("node").alias("sig"), "copies", F.lit("0").alias("cell"))
    member = member.join(few(cut), ["root", "band"]).withColumn("c", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    count = lambda n: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    tile = lambda g, low, i, j: F.struct(g.alias("g"), F.lit(low).alias("across"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    here = F.transform(count("cells"), lambda x: tile(F.col("band"), False, F.least(x, F.col("c")), F.greatest(x, F.col("c"))))
    up = F.transform(count("above"), lambda x: tile(F.col("band"), True, F.col("c"), x))
    down = F.transform(count("below"), lambda x: tile(F.col("band") - 1, True, x, F.col("c")))
    dealt = member.select("root", "node", "copies", "band", "c", F.explode(F.concat(here, up, down)).alias("t"))
    dealt = dealt.select("root", "t.*", F.col("node").alias("sig"), "copies", F.concat_ws(":", "band", "c").alias("cell"))
    dealt = dealt.withColumn("across", F.col("across") | (F.col("i") != F.col("j")))
    tiled = one.unionByName(dealt).join(sets, "sig").select("root", "g", "across", "i", "j", "sig", "copies", "cell", "tokens")
    return tiled.groupBy("root", "g", "across", "i", "j").applyInArrow(lambda t: _tile(t, num, den), "a long, b long, w long")


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Link documents whose sets of distinct k-word shingles have Jaccard >= num / den, exactly.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of 1 to k - 1 words has its whole sequence
    as one shingle; a null or empty text has the empty set and links with nothing. One row per input row:
    doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) and n_links
    (rows it is linked with). Rows that repeat a doc_id count each; a null doc_id counts as the smallest
    id and is given back as null. An empty table gives no rows; other columns are not read.
    """
    return _joined(docs, k, num, den).drop("text_key")


def _joined(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """jaccard_join() with a hash of each row's text, text_key, which tells rows of one doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.select("text", order_id().alias("oid"), F.xxhash64("text").alias("text_key"), "doc_id")
    named = stored(rows.mapInArrow(memory_returned(lambda it: _named(it, k)), "doc_id long, text_key long, n_shingles long, sig long, row_key long"), "named")
    per = stored(named.where("sig <> 0").groupBy("sig").agg(F.count(F.lit(1)).alias("copies"), F.min(order_id()).alias("least"), F.min("row_key").alias("row_key")), "sets")
    links = stored(_links(rows.drop("doc_id"), per, k, num, den), "links")
    comp = connected_components(links.select("a", "b"))
    degree = links.groupBy(F.col("a").alias("sig")).agg(F.sum("w").alias("others"))
    per = per.join(comp.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = per.groupBy("root").agg(F.min("least").alias("component"))
    per = stored(per.join(least, "root").join(degree, "sig", "left").select("sig", "component", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "classes")
    out = named.join(per, "sig", "left")
    own = F.coalesce(F.col("component"), order_id())
    return out.select("doc_id", "text_key", "n_shingles", F.when(own == LOWEST_ID, F.lit(None).cast("long")).otherwise(own).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_per_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stand for their component: those with the smallest doc_id.

    Of a component's rows that repeat that doc_id all stay; rows of other components that have the id of a
    row that goes are not touched; texts without words are their own group.
    """
    joined = _joined(docs, k, num, den)
    gone = joined.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["text_key"])
    return docs.join(gone, same, "left_anti")
