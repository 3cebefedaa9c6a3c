"""Vector code compression: product codes, assigned by memoised grid cells.

Vectors become whole numbers and are cut into equal parts; each part position
has a codebook, and a part's code is the index of its nearest entry.  A task
hashes every part's coarse grid cell.  For a cell that it has not seen, the
least and the largest distance from the cell's box to every entry say which
entries can be nearest to any point of the box: an entry whose least distance
is more than the least of all largest distances is dominated.  The entries that
are left are remembered for the cell, and only they are evaluated, exactly, for
the points of the cell.

Training alternates assignments with componentwise means, of which only sums
and counts leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.store import Scratch, small

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: larger components could overflow a sum of squares
LIMIT = 1 << 28
#: cells that a task remembers for a part position
CACHE_CELLS = 1 << 16
#: rows that one vectorised step works on
_ROWS = 8192
_FAR = np.iinfo(np.int64).max


class GridMemo:
    """Nearest entries of one codebook (entries x width, whole numbers), with the memory of grid cells of side ``side``."""

    def __init__(self, book: np.ndarray, side: int, most: int = CACHE_CELLS):
        self.book, self.side, self.most = book, side, most
        self.weights = np.random.default_rng(12).integers(1, 1 << 62, book.shape[1], dtype=np.int64) * 2 + 1
        self.evaluated = 0
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.int64)  # in order
        self.cells = np.zeros((0, self.book.shape[1]), np.int64)
        self.open = np.zeros((0, len(self.book)), bool)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, which entries are not dominated across its box."""
        low = cells[:, None, :] * self.side
        high = low + (self.side - 1)  # points are whole numbers
        below, above = low - self.book, self.book - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
        return least <= most.min(1)[:, None]

    def _open(self, cells: np.ndarray) -> np.ndarray:
        """The same, looked up by the cell's hash; a cell that shares its hash with another is not remembered."""
        keys = (cells * self.weights).sum(1)  # modulo 2^64
        distinct, first = np.unique(keys, return_index=True)
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if new.any():
            if len(self.hashes) + new.sum() > self.most:
                self._clear()
                new[:] = True
            fresh = cells[first[new]]
            at = np.searchsorted(self.hashes, distinct[new])
            self.hashes = np.insert(self.hashes, at, distinct[new])
            self.cells = np.insert(self.cells, at, fresh, axis=0)
            self.open = np.insert(self.open, at, self.candidates(fresh), axis=0)
        place = np.searchsorted(self.hashes, keys)
        found = self.open[place]
        other = (self.cells[place] != cells).any(1)
        if other.any():
            found[other] = self.candidates(cells[other])
        return found

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every point (ties to the lower index) and its squared distance."""
        index, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for at in range(0, len(points), _ROWS):
            some = points[at:at + _ROWS]
            row, entry = np.nonzero(self._open(some // self.side))
            self.evaluated += len(row)
            apart = np.full((len(some), len(self.book)), _FAR)
            apart[row, entry] = ((some[row] - self.book[entry]) ** 2).sum(1)
            index[at:at + _ROWS] = apart.argmin(1)
            error[at:at + _ROWS] = apart.min(1)
        return index, error


def whole_numbers(vectors: DataFrame, column: str, scale: int = SCALE) -> DataFrame:
    """The rows whose vector is not null and holds no null or non-finite component, with floor(scale * x) of each as ``__vector``."""
    x = F.col(column)
    usable = F.coalesce(x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    return vectors.where(usable).withColumn("__vector", F.transform(column, lambda e: F.floor(scale * e.cast("double")).cast("long")))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def train(rows: DataFrame, order: list[Column], side: int, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components) of ``rows`` (with ``__vector``), begun from the first rows in ``order``."""
    first = rows.orderBy(*order, "__vector").limit(entries).select("__vector").toArrow()
    each = width // parts
    books = _matrix(first.column("__vector").combine_chunks(), width).reshape(-1, parts, each).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            memos = [GridMemo(book, side) for book in books]
            total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                points = _matrix(batch.column("__vector"), width).reshape(-1, parts, each)
                for p, memo in enumerate(memos):
                    index, _ = memo.assign(points[:, p])
                    np.add.at(total[p], index, points[:, p])
                    count[p] += np.bincount(index, minlength=books.shape[1])
            part, entry = np.nonzero(count)
            flat = total[part, entry]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(flat), pa.list_(pa.int64()))],
                names=["part", "entry", "count", "sums"])

        # a row an entry and task; parts * entries * components rows come back
        found = rows.select("__vector").mapInArrow(sums, "part int, entry int, count long, sums array<long>") \
            .select("part", "entry", "count", F.posexplode("sums").alias("at", "sum")) \
            .groupBy("part", "entry", "at").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count")).collect()
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"], r["at"]] = r["sum"] // r["count"]
    return books


def encode(rows: DataFrame, books: np.ndarray, side: int) -> DataFrame:
    """``rows`` (with ``__vector``) and the code (an index a part, as array) and error of each."""
    parts, _, each = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [GridMemo(book, side) for book in books]
        for batch in batches:
            points = _matrix(batch.column("__vector"), parts * each).reshape(-1, parts, each)
            found = [memo.assign(points[:, p]) for p, memo in enumerate(memos)]
            code = np.stack([index for index, _ in found], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(np.arange(len(code) + 1, dtype=np.int32) * parts, pa.array(code.reshape(-1))),
                 pa.array(sum(error for _, error in found))], names=[*batch.schema.names, "__code", "__error"])

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("__code array<int>, __error long").fields])
    return rows.mapInArrow(run, schema)


def compress(vectors: DataFrame, key: str, column: str, label: str, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (array of int), error and label_error of every usable row; and the codebooks.

    Rows whose vector is null or holds null or non-finite components are
    dropped, all others have a row, also repeated ones and those without key
    or label (null labels are one group).  Codebooks begin with the vectors of
    the smallest keys (null keys last, equal keys by vector); fewer rows than
    entries give fewer entries.  All vectors must have one length that
    ``parts`` divides, and scaled components below 2^28: else a ValueError.
    An empty table gives no rows and no codebooks.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    plain = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(column).alias("__source"))
    rows = scratch.write(whole_numbers(plain, "__source").drop("__source"), "rows")
    size, values = F.size("__vector"), F.transform("__vector", lambda e: F.abs(e))
    facts = rows.agg(F.min(size), F.max(size), F.max(F.array_max(values)),
                     F.sum(F.aggregate(values, F.lit(0.0), lambda a, e: a + e)), F.sum(size)).first()
    least, width, largest, total, count = facts
    if width is None:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error")), np.zeros((parts, 0, 0), np.int64)
    if least != width or width % parts or not width:
        raise ValueError(f"vectors must have one length that {parts} divides, not {least} to {width}")
    if largest >= LIMIT:
        raise ValueError(f"scaled components must be below 2^28, not {largest}")
    # cells as wide as the components' mean size: a power of two
    side = 1 << max(0, round(np.log2(max(1.0, total / count))))
    books = train(rows, [F.asc_nulls_last("vec_id")], side, width, parts, entries, rounds)
    coded = scratch.write(encode(rows, books, side).drop("__vector"), "coded")
    by_label = scratch.write(coded.groupBy(F.col("label").alias("of")).agg(F.sum("__error").alias("label_error")), "labels")
    out = coded.join(small(by_label), F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "label", F.col("__code").alias("code"), F.col("__error").alias("error"), "label_error"), books
