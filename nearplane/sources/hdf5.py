"""Matrices in HDF5 files of the classic layout, read by byte ranges without a library.

Understood are files with a version 0 superblock and, in their root group, contiguous little-endian matrices of
whole or floating-point numbers, as benchmark files of vectors have them. Whatever else there is (chunks,
compression, other superblocks) goes to h5py, if that is installed, and raises if it is not.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89HDF\r\n\x1a\n"
SLICE_BYTES = 32 << 20  # of a matrix that a task reads at once


class Unsupported(ValueError):
    """A file or matrix that this module does not read."""


@dataclass(frozen=True)
class Matrix:
    """Where a matrix stands in its file: rows of `columns` numbers from byte `start` on."""

    start: int
    rows: int
    columns: int
    kind: str  # of numpy

    @property
    def row_bytes(self) -> int:
        return self.columns * np.dtype(self.kind).itemsize


def _at(f: BinaryIO, where: int, form: str) -> tuple:
    f.seek(where)
    return struct.unpack(form, f.read(struct.calcsize(form)))


def _links(f: BinaryIO, tree: int, names: bytes) -> Iterator[tuple[str, int]]:
    """(name, address of its header) of all members below a node of a group's tree."""
    signature, kind, level, used = _at(f, tree, "<4sBBH")
    if signature != b"TREE" or kind:
        raise Unsupported("not a group")
    for i in range(used):
        child = _at(f, tree + 24 + 8 + 16 * i, "<Q")[0]
        if level:
            yield from _links(f, child, names)
            continue
        signature, _, _, count = _at(f, child, "<4sBBH")
        if signature != b"SNOD":
            raise Unsupported("not a node of names")
        for j in range(count):
            name, header = _at(f, child + 8 + 40 * j, "<QQ")
            yield names[name : names.index(b"\0", name)].decode(), header


def _messages(f: BinaryIO, header: int) -> Iterator[tuple[int, bytes]]:
    version, _, count, _, size = _at(f, header, "<BBHII")
    if version != 1:
        raise Unsupported("an object header of another version")
    blocks = [(header + 16, size)]
    while blocks and count:
        at, left = blocks.pop(0)
        while left >= 8 and count:
            kind, length = _at(f, at, "<HH")
            f.seek(at + 8)
            data = f.read(length)
            at, left, count = at + 8 + length, left - 8 - length, count - 1
            if kind == 0x10:
                blocks.append(struct.unpack_from("<QQ", data))
            yield kind, data


def _matrix(f: BinaryIO, header: int) -> Matrix:
    shape = kind = start = None
    for name, data in _messages(f, header):
        if name == 0x01:
            version, rank = data[0], data[1]
            shape = struct.unpack_from(f"<{rank}Q", data, {1: 8, 2: 4}[version])
        elif name == 0x03:
            what, size = data[0] & 15, struct.unpack_from("<I", data, 4)[0]
            if what > 1 or data[1] & 1:
                raise Unsupported("not little-endian numbers")
            kind = f"<f{size}" if what else f"<{'i' if data[1] & 8 else 'u'}{size}"
        elif name == 0x08:
            if data[0] != 3 or data[1] != 1:
                raise Unsupported("a matrix that is not contiguous")
            start = struct.unpack_from("<Q", data, 2)[0]
    if shape is None or kind is None or start is None or len(shape) != 2:
        raise Unsupported("not a matrix")
    return Matrix(start, *shape, kind)


def matrices(path: str) -> dict[str, Matrix]:
    """The matrices in a file's root group that can be read; others are left out."""
    with open(path, "rb") as f:
        head = f.read(96)
        if head[:8] != SIGNATURE or head[8] != 0 or head[13] != 8 or head[14] != 8:
            raise Unsupported("not a file with a version 0 superblock")
        kind, tree, heap = struct.unpack_from("<I4xQQ", head, 72)
        if kind != 1:
            raise Unsupported("no table of names in the root group")
        size, _, data = _at(f, heap + 8, "<QQQ")
        f.seek(data)
        names, found = f.read(size), {}
        for name, header in _links(f, tree, names):
            try:
                found[name] = _matrix(f, header)
            except Unsupported:
                continue
        return found


def _by_library(path: str, name: str) -> tuple[int, int]:
    import h5py

    with h5py.File(path) as f:
        return f[name].shape[0], f[name].shape[1] * f[name].dtype.itemsize


def _rows(path: str, name: str, m: Matrix | None, lo: int, hi: int) -> np.ndarray:
    if m is None:
        import h5py

        with h5py.File(path) as f:
            return f[name][lo:hi]
    with open(path, "rb") as f:
        f.seek(m.start + lo * m.row_bytes)
        return np.frombuffer(f.read((hi - lo) * m.row_bytes), m.kind).reshape(-1, m.columns)


def has_matrix(path: str, name: str) -> bool:
    try:
        return name in matrices(path)
    except Unsupported:
        import h5py

        with h5py.File(path) as f:
            return name in f


def read_hdf5(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(id, v) of a matrix in an HDF5 file that driver and executors can open; id is the row's place from 0."""
    try:
        m = matrices(path).get(name)
    except Unsupported:
        m = None
    n, row_bytes = (m.rows, m.row_bytes) if m else _by_library(path, name)
    step = max(1, SLICE_BYTES // max(1, row_bytes))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in b.column(0).to_pylist():
                x = _rows(path, name, m, lo, min(n, lo + step)).astype(np.float64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(x))), flat], ["id", "v"])

    return spark.range(0, n, step, max(1, -(-n // step))).mapInArrow(part, "id long, v array<double>")


@dataclass
class Dataset:
    """base (id, v), queries (qid, q), truth (qid, rank, id and, where the file has them, distance)."""

    base: DataFrame
    queries: DataFrame
    truth: DataFrame


def load_dataset(spark: SparkSession, path: str) -> Dataset:
    """The matrices train, test, neighbors (or neighbor_indices), and distances if there are any."""
    from nearplane.sources.vecs import truth_of

    near = read_hdf5(spark, path, "neighbors" if has_matrix(path, "neighbors") else "neighbor_indices")
    far = read_hdf5(spark, path, "distances") if has_matrix(path, "distances") else None
    asked = read_hdf5(spark, path, "test").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return Dataset(read_hdf5(spark, path, "train"), asked, truth_of(near, far))
