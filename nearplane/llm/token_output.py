"""Token-id output: Re-Pair compressed shards with random access.

Documents are range-partitioned and sorted by doc_id; each task encodes its texts and writes shards of at
most about `SHARD_TOKENS` ids. In a shard, rounds of Re-Pair replace frequent id pairs by nonterminals until
no pair pays for its rule or the symbols run out (65,536 for a vocabulary below that); no
pair spans two documents, so every document starts at a symbol, whose place the shard lists. Rules and
their expansion lengths are stored, so one document decodes without its neighbours.

A shard is one row of a Parquet table: first_id, part, seq, n_docs, n_tokens, payload; part and seq name it. The payload is little-endian:
`RPR1`, then uint32 first nonterminal, bytes per symbol, documents, rules, symbols; int64 ids and uint8 id
flags of documents; int64 token counts; int64 first symbols; rule pairs; uint32 expansion lengths; symbols.

Words repeat, so ids are looked up per unit, and each distinct unit is encoded once. Texts are cut where
the byte-level pre-tokenizer always has an edge: before a space that a visible character follows, between
an ASCII letter and ASCII punctuation, and after a single line feed between visible characters.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearplane.llm import _words as W
from nearplane.llm._common import TEXT_SLICE, memory_returned, order_id, shared_dir, shuffle_parts, stored

END_ID = 0
SHARD_TOKENS = 2_000_000
PAIRS_A_ROUND = 3072
MIN_COUNT = 5  # a rule takes eight bytes and each use of it saves two
LEAST_GAIN = 1e-2  # of the symbols; a round that saves less is the last
CACHE_UNITS = 1_000_000
SLOT_BITS, PROBES = 22, 8  # of the table that finds them
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:] = True
_VISIBLE[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # may begin a Unicode space
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = _ASCII & ~_LETTER & ~_DIGIT
_KINDS = (np.arange(256) == 0x20) | _VISIBLE * 2 | _LETTER * 4 | _PUNCT * 8 | _ASCII * 16 | (np.arange(256) == 0x0A) * 32  # bits of a byte, as cuts ask for them
_KINDS = _KINDS.astype(np.uint8).tobytes()
JOINED = 64  # unknown units in one call of the tokenizer
SPECIAL = b"<|endoftext|>"
_HEAD = struct.Struct("<4s5I")


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def unit_hashes(buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """W.word_hashes() of spans that follow each other, from edge to edge."""
    out = np.empty(len(edges) - 1, np.uint64)
    at = 0
    while at < len(out):
        to = min(len(out), max(at + 1, int(np.searchsorted(edges, edges[at] + W.BLOCK))))
        lo, hi = edges[at], edges[to]
        up, down = W.powers(W._BASE, hi - lo + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(W.CODES[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
        e = edges[at : to + 1] - lo
        out[at:to] = W.mix(np.diff(sums[e]) * down[e[:-1]] + np.diff(e).astype(np.uint64) * W.U(0x2545F4914F6CDD1D))
        at = to
    return out


class _Units:
    """Where the ids of known units stand: an open hash table of places, looked up for many units at once."""

    def __init__(self) -> None:
        self.table = np.full((1 << SLOT_BITS) + PROBES, -1, np.int32)
        self.hashes, self.first, self.size = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each unit, -1 where it is not known."""
        slot = (h >> W.U(64 - SLOT_BITS)).astype(np.int64)
        out = self.table[slot]
        left = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        for k in range(1, PROBES):
            if not len(left):
                return out
            out[left] = self.table[slot[left] + k]
            left = left[(out[left] >= 0) & (self.hashes[out[left]] != h[left])]
        out[left] = -1
        return out

    def add(self, h: np.ndarray, first: np.ndarray, size: np.ndarray) -> int:
        """Add unknown, distinct units; their places start at the number given back. A unit without a free slot is not found later."""
        start, end = self.n, self.n + len(h)
        if end > len(self.hashes):
            more = lambda x: np.concatenate([x[:start], np.zeros(end - start + end // 2, x.dtype)])
            self.hashes, self.first, self.size = more(self.hashes), more(self.first), more(self.size)
        self.hashes[start:end], self.first[start:end], self.size[start:end] = h, first, size
        self.n = end
        slot, left = (h >> W.U(64 - SLOT_BITS)).astype(np.int64), np.arange(len(h))
        for k in range(PROBES):
            free = left[self.table[slot[left] + k] < 0]
            _, one = np.unique(slot[free], return_index=True)
            self.table[slot[free[one]] + k] = start + free[one]
            left = left[self.table[slot[left] + k] != start + left]
        return start


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own, through a bounded cache of units.

    When the cache is full, only units met since the last time stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(names.values(), default=0) + 1, np.int64)
        self.width[list(names.values())] = [len(x) for x in names]  # bytes of an id, as a byte-level token has a letter for each
        self.clear()

    def clear(self) -> None:
        self.units, self.met = _Units(), np.zeros(CACHE_UNITS, bool)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _make_room(self, more: int) -> None:
        if self.units.n + more <= CACHE_UNITS:
            return
        old, kept = self.units, np.flatnonzero(self.met[: self.units.n])
        ids = self.ids
        self.clear()
        if len(kept) + more > CACHE_UNITS // 2:
            return
        size = old.size[kept].astype(np.int64)
        self.ids = ids[spans(old.first[kept].astype(np.int64), size)]
        self.used = len(self.ids)
        self.units.add(old.hashes[kept], np.cumsum(size) - size, size)

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(size.sum())), size

    def _joined_ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """_ids() of units that may follow any other, many in a call; widths of ids tell where a unit ends."""
        flat, _ = self._ids([b"".join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)])
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        done = np.cumsum(self.width[flat])
        at = np.searchsorted(done, ends)
        if len(done) != at[-1] + 1 or (done[at] != ends).any():  # not byte-level widths
            return self._ids(units)
        return flat, np.diff(at, prepend=-1)

    def _learn(self, names: np.ndarray, units: list[bytes], joins: int) -> int:
        """Add units; the first `joins` of them may follow any other."""
        flat, size = self._joined_ids(units[:joins]) if joins else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if joins < len(units):
            more, sizes = self._ids(units[joins:])
            flat, size = np.concatenate([flat, more]), np.concatenate([size, sizes])
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(flat), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.units.add(names, self.used - len(flat) + np.cumsum(size) - size, size)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        buf, off = W.flat(col)
        n = len(buf)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(col), np.int64)
        raw = buf.tobytes()
        kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
        cut = np.zeros(n, np.uint8)
        cut[:-1] = kind[:-1] & (kind[1:] >> 1) & 1
        plain = SPECIAL not in raw
        if plain:
            cut[1:] |= (kind[:-1] >> 2) & (kind[1:] >> 3) & 1
            cut[2:] |= (kind[:-2] >> 4) & (kind[1:-1] >> 5) & (kind[2:] >> 1) & 1
        cut = cut.view(bool)
        cut[off[1:-1][off[1:-1] > 0] - 1] &= buf[off[1:-1][off[1:-1] > 0] - 1] != 0x20  # a space that ends its text
        cut[off[:-1][off[:-1] < n]] = True
        edges = np.append(np.flatnonzero(cut), n)
        starts, ends = edges[:-1], edges[1:]
        h = unit_hashes(buf, edges)
        place = self.units.find(h)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            names, at, inv = np.unique(h[unknown], return_index=True, return_inverse=True)
            if self.units.n + len(names) > CACHE_UNITS:
                self._make_room(len(names))
                place = self.units.find(h)  # places have changed
                unknown = np.flatnonzero(place < 0)
                names, at, inv = np.unique(h[unknown], return_index=True, return_inverse=True)
            at = unknown[at]
            a, z = starts[at], ends[at]
            joins = (kind[a] & 1 != 0) & (kind[np.minimum(a + 1, n - 1)] & 2 != 0) & (z - a > 1) & plain
            order = np.argsort(~joins, kind="stable")
            new = self._learn(names[order], [raw[i:j] for i, j in zip(a[order].tolist(), z[order].tolist(), strict=True)], int(joins.sum()))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place[unknown] = new + rank[inv]
        self.met[place if self.units.n <= CACHE_UNITS else place[place < CACHE_UNITS]] = True
        each = self.units.size[place].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        edge = total[np.searchsorted(starts, off)]
        return self.ids[spans(self.units.first[place].astype(np.int64), each)], np.diff(edge)


def repair(ids: np.ndarray, last: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their last flags, rules): rule k is nonterminal vocab + k. last marks ends of documents.

    Rounds replace the most frequent pairs until no pair is frequent enough to pay for its rule, the symbols
    of the width run out, or a round hardly saves anything.
    """
    small = vocab < 1 << 16  # then symbols stay under 2**16 and a pair fits 32 bits
    kind, shift, mask = (np.uint32, np.uint32(16), np.uint32(0xFFFF)) if small else (np.uint64, np.uint64(32), np.uint64(0xFFFFFFFF))
    seq, rules, ends = ids.astype(kind), [], np.flatnonzero(last)
    room = (1 << 16) - vocab if small else 1 << 20
    spot = lambda x: (x * kind(0x9E3779B1)) >> kind(kind(0).itemsize * 8 - 20)
    none, across = np.int16(-1), kind(np.iinfo(kind).max)  # a pair over an end of a document is no pair
    while len(seq) > 1 and room > 0:
        key = seq[:-1] << shift
        key |= seq[1:]
        key[ends[: np.searchsorted(ends, len(key))]] = across
        ordered = np.sort(key)
        ordered = ordered[: np.searchsorted(ordered, across)]
        if not len(ordered):
            break
        first = np.append(0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
        count = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(count >= MIN_COUNT)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")][: min(PAIRS_A_ROUND, room)]
        pairs = ordered[first[often]]
        pairs = pairs[np.sort(np.unique(spot(pairs), return_index=True)[1])]  # of those with one slot the most frequent; the others' turn comes
        table = np.full(1 << 20, none)
        table[spot(pairs)] = np.arange(len(pairs))
        found = table[spot(key)]
        at = np.flatnonzero(found >= 0)
        got = found[at]
        hit = pairs[got] == key[at]
        won, got = at[hit], got[hit]
        # of overlapping pairs the more frequent wins, and in a run of one pair every second place
        near = np.flatnonzero(np.diff(won) == 1)
        before, after = np.full(len(won), len(pairs), np.int16), np.full(len(won), len(pairs), np.int16)
        before[near + 1], after[near] = got[near], got[near + 1]
        run = np.arange(len(won), dtype=np.int32)
        run -= np.maximum.accumulate(np.where(before == got, np.int32(0), run))
        wins = (run & 1 == 0) & ((run > 0) | (got < before)) & (got <= after)
        won, got = won[wins], got[wins]
        used = np.flatnonzero(np.bincount(got, minlength=len(pairs)))
        number = np.zeros(len(pairs), kind)
        number[used] = np.arange(vocab + len(rules), vocab + len(rules) + len(used), dtype=kind)
        seq[won] = number[got]
        rules += [(p >> int(shift), p & int(mask)) for p in pairs[used].tolist()]
        room -= len(used)
        keep = np.ones(len(seq), bool)
        keep[won + 1] = False
        seq = seq[keep]
        ends -= np.searchsorted(won, ends)  # of places before an end, those that gave up the next one
        if len(won) < LEAST_GAIN * len(keep):
            break
    last = np.zeros(len(seq), bool)
    last[ends] = True
    return seq, last, np.array(rules, np.int64).reshape(-1, 2)


def expansions(rules: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat terminal strings of all nonterminals, with their firsts and lengths."""
    one = np.arange(vocab, dtype=np.uint32).tobytes()
    out: list[bytes] = []
    for a, b in rules.tolist():
        out.append((out[a - vocab] if a >= vocab else one[4 * a : 4 * a + 4]) + (out[b - vocab] if b >= vocab else one[4 * b : 4 * b + 4]))
    size = np.fromiter(map(len, out), np.int64, len(out)) // 4
    return np.frombuffer(b"".join(out), np.uint32), np.cumsum(size) - size, size


def lengths(rules: np.ndarray, vocab: int) -> np.ndarray:
    """The lengths of expansions() alone."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - vocab] if a >= vocab else 1) + (out[b - vocab] if b >= vocab else 1))
    return np.array(out, np.int64)


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    """A shard's payload; counts and ids include the end id of each document."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    seq, last, rules = repair(ids, last, vocab)
    wide = 2 if vocab + len(rules) <= 1 << 16 else 4
    symbol = np.uint16 if wide == 2 else np.uint32
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]).astype(np.int64)
    names = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
    flags = np.array([d is not None for d in doc_ids], np.uint8)
    head = _HEAD.pack(b"RPR1", vocab, wide, len(doc_ids), len(rules), len(seq))
    parts = (names, flags, counts.astype(np.int64), first, rules.astype(symbol), lengths(rules, vocab).astype(np.uint32), seq.astype(symbol))
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """Random access to the documents of a payload."""

    def __init__(self, payload: bytes):
        magic, self.vocab, wide, docs, rules, symbols = _HEAD.unpack_from(payload)
        if magic != b"RPR1":
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        kind = np.uint16 if wide == 2 else np.uint32

        def take(n: int, dtype) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, dtype, n, at)
            at += x.nbytes
            return x

        names, flags = take(docs, np.int64), take(docs, np.uint8)
        self.doc_ids = [int(d) if f else None for d, f in zip(names, flags, strict=True)]
        self.counts, self.first = take(docs, np.int64), take(docs, np.int64)
        self.rules = take(2 * rules, kind).reshape(-1, 2).astype(np.int64)
        self.lengths = take(rules, np.uint32)
        self.symbols = take(symbols, kind)
        flat, first, size = expansions(self.rules, self.vocab)
        # of every symbol; an id stands for itself
        self.flat = np.concatenate([np.arange(self.vocab, dtype=np.uint32), flat])
        self.flat_first = np.concatenate([np.arange(self.vocab), self.vocab + first])
        self.flat_size = np.concatenate([np.ones(self.vocab, np.int64), size])

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int64)
        return self.flat[spans(self.flat_first[s], self.flat_size[s])]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document with its end id; nothing else is decoded."""
        end = self.first[i + 1] if i + 1 < len(self.first) else len(self.symbols)
        return self.decode(self.symbols[self.first[i] : end])


_SHARD = "first_id long, part int, seq int, n_docs long, n_tokens long, payload binary"
_encoders: dict[str, Encoder] = {}


def _shards(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    enc = _encoders[path]
    docs: list[int | None] = []
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    part = TaskContext.get().partitionId()  # in range order
    size = seq = 0

    def shard() -> pa.RecordBatch:
        n = np.concatenate(counts)
        payload = pack(docs, n, np.concatenate(held), enc.vocab)
        low = -(1 << 63) if docs[0] is None else docs[0]
        return pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([payload], pa.binary())], ["first_id", "part", "seq", "n_docs", "n_tokens", "payload"])

    for b in W.slices(batches, TEXT_SLICE):
        ids, n = enc.encode(b.column(1))
        edge = np.cumsum(n)
        held.append(np.insert(ids, edge, END_ID))
        counts.append(n + 1)
        docs += b.column(0).to_pylist()
        size += len(held[-1])
        if size >= SHARD_TOKENS:
            yield shard()
            docs, held, counts, size, seq = [], [], [], 0, seq + 1
    if docs:
        yield shard()


def write_token_shards(docs: DataFrame, tokenizer_path: str, out: str) -> None:
    """Encode and write docs in ascending doc_id order (null first; repeated ids side by side) as shards under out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = rows.repartitionByRange(2 * shuffle_parts(docs.sparkSession), order_id(), F.xxhash64("text")).sortWithinPartitions(order_id(), F.xxhash64("text"))
    parts.mapInArrow(memory_returned(lambda it: _shards(it, tokenizer_path)), _SHARD).write.parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for base, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s = Shard(payload)
            start = base + np.cumsum(s.counts) - s.counts
            raw = memoryview(s.decode(s.symbols).astype("<u4").tobytes())
            edge = np.concatenate([[0], np.cumsum(s.counts)]).tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(edge, edge[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(s.counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row per document of a shard table: doc_id, start (ids before it), n_tokens (with the end id), ids_crc32."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one small row per shard
    base = stored(shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")), "bases")
    return shards.join(base, ["part", "seq"]).select("base", "payload").mapInArrow(memory_returned(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs as shards into the shared folder and read them back; see read_token_shards().

    Null and empty texts have only the end id. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_shards(docs, tokenizer_path, out)
    return read_token_shards(spark.read.schema(_SHARD).parquet(out))
