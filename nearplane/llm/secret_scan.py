"""Secret scans with multipart credential linking.

Base spans are found by pattern. Linking then joins parts of one credential by interval: every span
opens a scope of `SCOPE` code points to either side, and a weak candidate (a bare identifier, a bare key
or an endpoint), too common to report alone, counts only where it meets a scope of a complementary part,
a base span or a weak candidate of another kind. Weak patterns are searched over the whole text, so
matches are whole, and spans of a kind are sorted, so a look-up finds the nearest.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearplane.llm._common import memory_returned

SCOPE = 240
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # greedy runs, so the same as all runs that have 16 characters
IDENT = re.compile(r"""(?:client|account|access|user|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""", re.I | re.A)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,128}(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)+(?:amazonaws\.com|internal|local)(?![A-Za-z0-9-])""")
#: Weak kind -> kinds of which one must be near.
NEEDS = {"ident": ("assign", "hex", "weak", "endpoint"), "weak": ("access", "ident", "endpoint"), "endpoint": ("access", "assign", "ident", "weak")}
_WEAK = {"ident": IDENT, "weak": WEAK, "endpoint": ENDPOINT}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)


def _weak_spans(text: str) -> list[Span]:
    """Whole matches of the weak patterns, over the whole text."""
    return [(*m.span(), kind) for kind, pattern in _WEAK.items() for m in pattern.finditer(text) if kind != "weak" or _mixed(m[0])]


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates outside all base spans that a scope of a complementary base span or weak candidate touches."""
    weak = _weak_spans(text)
    if not weak:
        return []
    ends = {k: ([], []) for k in KINDS}
    taken = sorted((s, e) for s, e, _ in base)
    reach = list(accumulate((e for _, e in taken), max))  # the furthest end of the base spans so far

    def free(s: int, e: int) -> bool:
        at = bisect_left(taken, (e,))
        return not at or reach[at - 1] <= s

    weak = [x for x in weak if free(*x[:2])]
    for k, (starts, furthest) in ends.items():
        own = sorted((s, e) for s, e, kind in (*base, *weak) if kind == k)
        starts += [s for s, _ in own]
        furthest += accumulate((e for _, e in own), max)

    def near(s: int, e: int, kind: str) -> bool:
        """Whether a span of the kind starts at e + SCOPE at most and ends at s - SCOPE at least."""
        starts, furthest = ends[kind]
        at = bisect_right(starts, e + SCOPE)
        return at > 0 and furthest[at - 1] >= s - SCOPE

    return [(s, e, k) for s, e, k in weak if any(near(s, e, n) for n in NEEDS[k])]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            base = base_spans(text or "")
            more = linked_spans(text or "", base)
            n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            rows.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + more), len(more)))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans lists kind:start:end of base and linked spans by start, then kind; offsets are code points, ends
    exclusive; base_sha256 digests the same list of base spans alone. A null text counts as empty, without
    spans. Rows that repeat an id each give a row; other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(memory_returned(_scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")
