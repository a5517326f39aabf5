"""Words, shingles and hashes of whole text columns in numpy, and small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerloom.session import shared_dir

#: The bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: The same words for Java's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of the lineage that outlives any executor."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal digits modulo 4; fold 2 is held out of every training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.uint64(seed)) | np.uint64(1)


def text_blocks(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``first`` to ``last`` of a text column as (first, last, bytes, offsets), about ``size`` bytes at a time.

    A null counts as an empty text; no text is ever cut.
    """
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of a block of texts: ``start``, ``end`` (byte positions), ``doc`` (row in the block), ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, also: np.ndarray | None = None):
        inside = ~(SPACE if also is None else also)[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        letters = (LOWER if lower else np.arange(256, dtype=np.uint8))[np.arange(256)]
        self.sums, self.back = prefix_hashes(data, constants(256, 7)[letters])
        self.hash = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges, whichever place they have in the block."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def prefix_hashes(data: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    forth = np.full(n, _BASE, dtype=np.uint64)
    back = np.full(n + 1, _INVERSE, dtype=np.uint64)
    if n:
        forth[0] = 1
    back[0] = 1
    np.multiply.accumulate(forth, out=forth)
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(n + 1, dtype=np.uint64)
    forth *= codes[data]
    np.cumsum(forth, out=sums[1:])
    return sums, back


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, row) of each run of ``size`` words; a shorter text has all its words as one run."""
    n, h = len(words.hash), words.hash
    factors = constants(size, 11)
    value, is_one = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    if n >= size:
        m = n - size + 1
        for j in range(size):
            value[:m] += h[j : j + m] * factors[j]
        is_one[:m] = words.doc[:m] == words.doc[size - 1 :]
    first = np.cumsum(words.count) - words.count
    for k in range(1, size):
        at = first[words.count == k]
        value[at] = np.uint64(k)
        for j in range(k):
            value[at] += h[at + j] * factors[j]
        is_one[at] = True
    at = np.flatnonzero(is_one)
    return mix(value[at]), at, words.doc[at]


def over_batches(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], by: str | None = None, size: int = 1 << 22) -> Callable:
    """For mapInArrow: the results of each batch, one after another; with ``by``, of pieces of about ``size`` bytes of that
    column's text, which bounds what a task holds (a row is never split)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if by is None:
                yield from work(batch)
            else:
                for first, last, _, _ in text_blocks(batch.column(by), size):
                    yield from work(batch.slice(first, last - first))

    return run


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Of a partition sorted by ``keys``: tables that hold whole groups only, several groups to a table."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        last = np.ones(rows.num_rows, dtype=bool)
        for k in keys:
            column = rows.column(k).to_numpy()
            last &= column == column[-1]
        cut = rows.num_rows - int(last[::-1].argmin() if not last.all() else len(last))
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal rows, and the end."""
    change = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(np.append([True], change[1:])), len(columns[0])) if len(columns[0]) else np.zeros(1, dtype=int)
