"""Vectorised word kernels over Arrow text columns: splitting, word hashes, window hashes.

All hashes are 64-bit: a polynomial over random byte codes modulo 2**64, finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 17  # items whose hashes are summed at once; few enough for a CPU's cache
_rng = np.random.Generator(np.random.PCG64(20240229))
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _WBASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 4096)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[base] = have = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text (one row at least)."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        if b.num_rows == 0:
            continue
        _, off = flat(col)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    return out


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words `[^\\x20\\x09-\\x0D]+`, and the n + 1 word offsets of the texts."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~SEPARATOR[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = off[(off > 0) & (off < n)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    first[cuts] = True
    last[cuts - 1] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    order = np.argsort(starts, kind="stable")
    out = np.empty(len(starts), np.uint64)
    s, e = starts[order], ends[order]
    # a span may end behind a later one's end
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(s, s[at] + BLOCK)))
        lo, hi = s[at], e[at:to].max()
        up, down = powers(_BASE, hi - lo + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(CODES[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, z = s[at:to] - lo, e[at:to] - lo
        out[order[at:to]] = mix((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64) * U(0x2545F4914F6CDD1D))
        at = to
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; windows run over the ends of texts, callers mask those."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        m = to - at + k - 1
        up, down = powers(_WBASE, m + 1)
        sums = np.empty(m + 1, np.uint64)
        sums[0] = 0
        np.cumsum(h[at : at + m] * up[:m], out=sums[1:])
        out[at:to] = mix((sums[k:] - sums[:-k]) * down[: to - at])
    return out


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each w neighbours, by doubling."""
    size, cur = 1, a
    while size * 2 <= w:
        cur = op(cur[:-size], cur[size:]) if len(cur) > size else cur[:0]
        size *= 2
    if size < w:
        d = w - size
        cur = op(cur[:-d], cur[d:]) if len(cur) > d else cur[:0]
    return cur


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; by sorting, which is much faster than np.unique() on many different integers."""
    a = np.sort(a)
    keep = np.ones(len(a), bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep]


def doc_of(word_off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array whose i-th value is the bytes of data[offsets[i]:offsets[i + 1]]."""
    size = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((np.asarray(offsets, np.int64) * size).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def joined_binary(col: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary array end to end, and how many items each has."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    size = np.dtype(dtype).itemsize
    if col.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, dtype), np.diff(off) // size
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].copy().view(dtype), np.diff(off) // size
