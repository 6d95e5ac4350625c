"""Bloom filter of the hashes seen more than once, built per partition, merged by hash range, read from shared files.

Each partition has two filters over its own rows: one of the hashes seen (once) and one of those met again (twice).
Merging is associative: ``twice = t1 | t2 | (o1 & o2)``, ``once = o1 | o2``. A hash met in two places therefore has
all its bits in ``twice``: the filter has false positives but no false negatives.

The filter has BITS_PER_HASH bits for each hash, however many there are: hashes fall into ranges of at most RANGE_BITS
bits, a partition's part of a range travels as the hashes that set its bits and their counts (12 bytes each, about as much
as the addresses of the bits), one task merges one range at a time, and the merged ranges are files in the shared folder. Tasks map a range's file
into memory when they first probe it, so neither the driver nor a worker's heap ever holds the filter. Where the shared
folder cannot be mapped (an object store), a worker reads ranges as it needs them and keeps the last KEEP.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trelliq.session import new_place, ship, store

BITS_PER_HASH = 12
PROBES = 3
#: A merging task holds two bitmaps of at most this size.
RANGE_BITS = 1 << 27
SMALL_BITS, MANY = 1 << 22, 1024
#: Hashes that a partition collects before it sends them on; a hash met in two such lots counts as met again.
LOT = 1 << 22
#: Ranges that a worker keeps where files cannot be mapped.
KEEP = 4


@dataclass(frozen=True)
class Layout:
    """Number of ranges, and of bits in each."""

    ranges: int
    bits: int

    @staticmethod
    def of(n_hashes: int, range_bits: int = RANGE_BITS) -> Layout:
        """Room for so many hashes: up to MANY ranges of SMALL_BITS for the sake of parallel merging, then larger ones, and
        from MANY of ``range_bits`` on more of them."""
        wanted = max(1 << 16, BITS_PER_HASH * n_hashes)
        ranges = max(-(-wanted // range_bits), min(MANY, -(-wanted // SMALL_BITS)))
        return Layout(ranges, min(range_bits, -(-wanted // ranges // 64) * 64 + 64))


def scattered(h: np.ndarray) -> np.ndarray:
    x = h.view(np.uint64) if h.dtype == np.int64 else h.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fraction(x: np.ndarray, n: int) -> np.ndarray:
    """The upper half of each 64-bit number, scaled to 0 .. n - 1."""
    return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def range_of(h: np.ndarray, layout: Layout) -> np.ndarray:
    return fraction(scattered(h), layout.ranges)


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash within its range, as rows of a matrix."""
    x, out = scattered(h), np.empty((PROBES, len(h)), dtype=np.int64)
    for k in range(PROBES):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
        out[k] = fraction(x, bits)
    return out


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all probed bits of each hash are set."""
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at.ravel() >> 3, np.left_shift(1, at.ravel() & 7).astype(np.uint8))


class Seen:
    """The hashes of one partition, lot by lot, as rows of PARTS."""

    def __init__(self, layout: Layout, lot: int = LOT):
        self.layout, self.lot, self.held, self.size = layout, lot, [], 0

    def add(self, h: np.ndarray, first: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """``first`` tells which hashes are the first of their text; all are where it is left out."""
        self.held.append((h.astype(np.int64), np.ones(len(h), bool) if first is None else first))
        self.size += len(h)
        if self.size >= self.lot:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        h, first = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        h, at, n = np.unique(h, return_inverse=True, return_counts=True)
        texts = np.bincount(at, weights=first, minlength=len(h)).astype(np.uint32)
        counts = (np.minimum(n, 0xFFFF).astype(np.uint32) << np.uint32(16)) | np.minimum(texts, np.uint32(0xFFFF))
        r = range_of(h, self.layout)
        order = np.argsort(r, kind="stable")
        h, counts, r = h[order], counts[order], r[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        ends = [*first[1:].tolist(), len(h)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(r[first].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()) for x in (h, counts))],
            names=["range", "hashes", "counts"],
        )


#: Hashes of a range, each with its count (upper half) and that of texts with it (lower half), at most 65,535 each.
PARTS = "range int, hashes binary, counts binary"


def unpacked(hashes: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, counts of texts)."""
    both = np.frombuffer(counts.as_py(), np.uint32)
    return np.frombuffer(hashes.as_py(), np.int64), both >> np.uint32(16), both & np.uint32(0xFFFF)


class Merged:
    """The merged filters of one range."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.once, self.twice = (np.zeros(-(-layout.bits // 8), np.uint8) for _ in range(2))

    def add(self, hashes: pa.Array, counts: pa.Array) -> None:
        for parts in zip(hashes, counts):
            h, n, _ = unpacked(*parts)
            at = positions(h, self.layout.bits)
            put(self.twice, at[:, has(self.once, at) | (n > 1)])
            put(self.once, at)

    def done(self) -> bytes | None:
        return self.twice.tobytes() if self.twice.any() else None


def range_files(rows: DataFrame, name: str, begin: Callable, columns: int) -> str:
    """Folder in the shared storage with one file for each value of ``range``, the first of the columns of ``rows``.

    ``begin()`` makes the state of a range, which takes slices of the other columns by ``add(*columns)`` and becomes the
    bytes of the file by ``done()``, or None for no file. One task folds one range after the other.
    """
    spark = rows.sparkSession
    ship(spark)
    folder = new_place(spark, name)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        files.create_dir(path)

        def keep(now: int, state) -> pa.RecordBatch:
            if (made := state.done()) is not None:
                # Written under a name of its own and then moved: a task that is run twice leaves one whole file.
                part = f"{path}/{uuid.uuid4().hex}.part"
                with files.open_output_stream(part) as out:
                    out.write(made)
                files.move(part, f"{path}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], names=["range"])

        now, state = None, None
        for batch in batches:
            r = batch.column(0).to_numpy()
            cuts = [*np.flatnonzero(np.r_[True, r[1:] != r[:-1]]).tolist(), len(r)] if len(r) else []
            for a, b in zip(cuts, cuts[1:]):
                if r[a] != now:
                    if state is not None:
                        yield keep(now, state)
                    now, state = int(r[a]), begin()
                state.add(*(batch.column(i).slice(a, b - a) for i in range(1, columns)))
        if state is not None:
            yield keep(now, state)

    rows.repartition("range").sortWithinPartitions("range").mapInArrow(fold, "range int").write.format("noop").mode("overwrite").save()
    return folder


class RangeFiles:
    """The files of ``range_files``, as a worker reads them."""

    def __init__(self, folder: str):
        self.ranges: OrderedDict[int, np.ndarray | None] = OrderedDict()
        self.files, self.path = store(folder)

    def of(self, r: int) -> np.ndarray | None:
        """The bytes of a range, mapped where the storage allows it."""
        from pyarrow import fs

        if r not in self.ranges:
            name = f"{self.path}/{r}"
            if self.files.get_file_info(name).type == fs.FileType.NotFound:
                self.ranges[r] = None
            elif isinstance(self.files, fs.LocalFileSystem):
                self.ranges[r] = np.memmap(name, np.uint8, "r")
            else:
                while sum(x is not None for x in self.ranges.values()) >= KEEP:
                    self.ranges.popitem(last=False)
                with self.files.open_input_stream(name) as f:
                    self.ranges[r] = np.frombuffer(f.read(), np.uint8)
        return self.ranges[r]

    def split(self, h: np.ndarray, layout: Layout) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``h``, bytes) of each range that has a file."""
        r = range_of(h, layout)
        order = np.argsort(r, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(r[order])) + 1) if len(h) else []:
            if (found := self.of(int(r[own[0]]))) is not None:
                yield own, found


_opened: dict[str, RangeFiles] = {}


def opened(folder: str) -> RangeFiles:
    """One reader for each worker and folder; of those before it the last stays."""
    if folder not in _opened:
        while len(_opened) > 1:
            _opened.pop(next(iter(_opened)))
        _opened[folder] = RangeFiles(folder)
    return _opened[folder]


def merged_filter(parts: DataFrame, layout: Layout) -> str:
    """Folder of the merged ``twice`` filters of a frame of PARTS; ranges without repeats have no file."""
    return range_files(parts, "bloom", lambda: Merged(layout), 3)


def repeated(folder: str, layout: Layout, h: np.ndarray) -> np.ndarray:
    """Whether each hash may occur more than once; never false for one that does."""
    found = np.zeros(len(h), bool)
    for own, bitmap in opened(folder).split(h, layout):
        found[own] = has(bitmap, positions(h[own], layout.bits))
    return found


def seen_twice(df: DataFrame, column: str, layout: Layout) -> str:
    """Folder of the filter of the values of a bigint column that occur more than once; nulls are left out."""
    ship(df.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Seen(layout)
        for batch in batches:
            yield from own.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
        yield from own.rest()

    return merged_filter(df.select(column).mapInArrow(build, PARTS), layout)


def maybe_repeated(folder: str, layout: Layout, h: Column) -> Column:
    """Whether the hash may occur more than once; never false for one that does, false for null."""

    @F.pandas_udf("boolean")
    def probe(values: pd.Series) -> pd.Series:
        return pd.Series(repeated(folder, layout, values.to_numpy()))

    # A nullable column would reach pandas as doubles, which cannot hold a hash.
    return h.isNotNull() & probe(F.coalesce(h, F.lit(0).cast("bigint")))
