"""Compression of vectors to one codebook entry a part, found by a ball tree.

Method: every component becomes the integer ``floor(SCALE * component)``, and a
vector is cut into ``PARTS`` consecutive parts. Each part position has a codebook
of entries. The nearest entry of a part is found in a ball tree over the
position's entries (Omohundro 1989) by branch and bound: a ball is left out only
if its least possible distance is above the best one found, where radii are
rounded up, distances down and the best one up, and balls at an equal distance
are visited. So rounding leaves none out, ties included. Distances that decide
are of integers and exact, of equal ones the lower index wins.

Scale: codebooks hold a fixed number of entries and are shipped with the tasks.
A round returns sums and counts of each entry from every task, never rows. A
batch goes down the tree at once, its rows splitting up between the children, so
the work is numpy's.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.sound_vectors import scaled_down, sound_vectors
from quern.plans.stage_table import drop_stage_table, stage_table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries of a leaf.
LEAF = 8
#: Rows that go down a tree together.
BATCH = 4096
#: Labels up to which their sums are broadcast; more are joined by a shuffle.
SMALL = 100_000


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer arrays that are broadcast against each other."""
    gap = a - b
    return np.einsum("...j,...j->...", gap, gap)


def _down(squares: np.ndarray) -> np.ndarray:
    """A number not above the square root of exact integers."""
    return np.maximum(np.nextafter(np.sqrt(np.nextafter(squares.astype(float), -np.inf).clip(0)), -np.inf), 0)


def _up(squares: np.ndarray) -> np.ndarray:
    """A number not below the square root of exact integers."""
    return np.nextafter(np.sqrt(np.nextafter(squares.astype(float), np.inf)), np.inf)


class BallTree:
    """Nearest entry of integer points, with their numbers as given."""

    def __init__(self, entries: np.ndarray, numbers: np.ndarray | None = None, leaf: int = LEAF):
        self.numbers = np.arange(len(entries)) if numbers is None else numbers
        self.entries, self.children = entries, ()
        self.centre = np.rint(entries.mean(0)).astype(np.int64)
        self.radius = float(_up(_squares(entries, self.centre)).max())
        if len(entries) > leaf and (entries != entries[0]).any():
            along = entries[:, np.ptp(entries, axis=0).argmax()].argsort(kind="stable")
            # Numbers stay in rising order within a part, so that a leaf's first least distance has the lowest.
            self.children = tuple(BallTree(entries[part], self.numbers[part], leaf) for part in (np.sort(along[: len(along) // 2]), np.sort(along[len(along) // 2 :])))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each point's nearest entry, the lowest of equal ones, and the squared distance."""
        best, number = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int64)
        self._visit(points, np.arange(len(points)), best, number)
        return number, best

    def _least(self, points: np.ndarray) -> np.ndarray:
        """No point of the ball is nearer to the points than this."""
        return np.nextafter(_down(_squares(points, self.centre)) - self.radius, -np.inf)

    def _visit(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, number: np.ndarray) -> None:
        if not len(rows):
            return
        if not self.children:
            found = _squares(points[rows][:, None], self.entries[None])
            at = found.argmin(1)
            square, of = found[np.arange(len(rows)), at], self.numbers[at]
            better = (square < best[rows]) | ((square == best[rows]) & (of < number[rows]))
            best[rows[better]], number[rows[better]] = square[better], of[better]
            return
        one, other = self.children
        least = one._least(points[rows]), other._least(points[rows])
        nearer = least[0] <= least[1]
        one._visit(points, rows[nearer], best, number)
        other._visit(points, rows[~nearer], best, number)
        within = _up(best[rows])
        one._visit(points, rows[~nearer & (least[0] <= within)], best, number)
        other._visit(points, rows[nearer & (least[1] <= within)], best, number)


def _bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """First and end component of each part; where parts can't be equal, the first ones are longer by one."""
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(dim), parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _vectors(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.int64)


def _coded(books: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row's parts."""
    codes, squares = np.zeros((len(x), len(books)), np.int64), np.zeros((len(x), len(books)), np.int64)
    trees = [BallTree(b) for b in books]
    for p, (tree, (a, b)) in enumerate(zip(trees, _bounds(x.shape[1], len(books)), strict=True)):
        for at in range(0, len(x), BATCH):
            codes[at : at + BATCH, p], squares[at : at + BATCH, p] = tree.nearest(x[at : at + BATCH, a:b])
    return codes, squares


def _refined(rows: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks whose entries are the floored means of the parts that they are nearest to; unused ones stay."""
    bounds = _bounds(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(b) for b in books]
        counts = np.zeros((len(books), len(books[0])), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(0), batch.num_rows)
                codes = _coded(books, x)[0]
                for p, (a, b) in enumerate(bounds):
                    np.add.at(sums[p], codes[:, p], x[:, a:b])
                    counts[p] += np.bincount(codes[:, p], minlength=len(books[p]))
        part, entry = np.nonzero(counts)
        held = [[int(counts[p, e]), *sums[p][e].tolist()] for p, e in zip(part, entry, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(held, pa.list_(pa.int64()))], ["part", "entry", "held"])

    found = rows.select("x").mapInArrow(run, "part int, entry int, held array<long>")
    found = found.select("part", "entry", F.posexplode("held").alias("at", "value")).groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).orderBy("part", "entry", "at").collect()
    new, count = [b.copy() for b in books], 0
    for r in found:
        if r["at"] == 0:
            count = r["value"]
        else:
            new[r["part"]][r["entry"], r["at"] - 1] = r["value"] // count
    return new


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per vector: ``id_col, code, error, label_error, codebooks_sha256``.

    The codebooks start as the parts of the ``entries`` vectors with the smallest
    ids, of equal ids those with the lower components, null ids last; fewer
    vectors give fewer entries. Vectors that are null, empty, hold a null or
    non-finite component or have another length than most go; components beyond
    ``MOST`` count as ``MOST``. Where the length isn't a multiple of ``parts``
    the first parts are longer by one, and some are empty where there are fewer
    components than parts. Repeated rows stay and count in the means. Null labels
    are equal to each other, a null id stays null, an empty table gives an empty
    one; other columns are ignored.
    """
    rows, dim = sound_vectors(vectors, vector_col, id=id_col, label=label_col)
    rows = stage_table(rows.select("id", "label", scaled_down("vector", scale).alias("x")), "integers")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").toArrow() if dim else None
    start = _vectors(first.column("x").combine_chunks(), first.num_rows) if dim else np.zeros((1, 0), np.int64)
    books = [start[:, a:b].copy() for a, b in _bounds(dim, parts)]
    for _ in range(rounds if dim else 0):
        books = _refined(rows, books, dim)
    digest = sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, squares = _coded(books, _vectors(batch.column(2), batch.num_rows))
                names = ["".join(map("{:02x}".format, c)) for c in codes.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(squares.sum(1))], ["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = stage_table(rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    drop_stage_table(rows)
    of_label = coded.groupBy(F.col("label").alias("label_")).agg(F.try_sum("error").alias("label_error"))
    small = of_label.limit(SMALL + 1).count() <= SMALL
    out = coded.join(F.broadcast(of_label) if small else of_label, F.col("label").eqNullSafe(F.col("label_")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
