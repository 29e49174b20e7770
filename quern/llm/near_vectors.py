"""Near-duplicate vectors by an inverted multi-index.

Method: unit vectors are cut into halves; a codebook for each half spans a
product grid of cells (Babenko & Lempitsky 2012). Every vector lives in the
cell of its nearest codewords. It visits cells in the order of a lower bound of
their distance, the squared distances to the bisecting hyperplanes summed over
the halves, which a heap walks by multi-sequence traversal, until a reach that is calibrated for the target recall of pairs at
the threshold, and every vector met there is verified by its cosine in double
precision. Pairs whose squared distance lies within the reach can't be missed at
all, since it bounds them exactly; with ``recall=1`` the reach is the distance of
the threshold itself and no pair can be missed, but many more cells are visited.

Scale: codebooks are fitted on a bounded sample (``SAMPLE`` rows with the
smallest hashes), every row is indexed. Cells hold about ``CELL`` vectors of the
largest label, crowded ones are dealt out in blocks, residents against visitors,
so that a task never holds more than a block. Blocks return counts and a
spanning forest of their links, not pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.plans.stage_table import drop_stage_table, stage_table

SAMPLE = 20_000
CELL = 256
#: Codewords a half: as many as make cells of ``CELL`` vectors, up to this (cells then grow from 268 million vectors a label on).
MOST_WORDS = 1024
RESIDENTS, VISITORS = 1024, 4096
#: Share of synthetic pairs at the threshold that the calibrated reach covers.
RECALL = 0.9999


def units(column: pa.ListArray) -> list[np.ndarray]:
    """Unit vectors in double precision; the caller has removed what has none. Runs of equal lengths go as one matrix."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out: list[np.ndarray] = []
    starts = np.flatnonzero(np.diff(sizes, prepend=-1))
    at = 0
    for first, end in zip(starts, np.append(starts[1:], len(sizes)), strict=True):
        x = values[at : at + (end - first) * sizes[first]].reshape(end - first, sizes[first])
        at += x.size
        x = x / np.abs(x).max(1, keepdims=True)
        out += list(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None])
    return out


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    words = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (words @ words.T).diagonal() - 2 * (x @ words.T)
        own = near.argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return np.unique(words, axis=0)


class Grid:
    """Codebooks of two halves, and how far a traversal goes."""

    def __init__(self, first: np.ndarray, second: np.ndarray, reach: float = 0.0):
        self.books, self.reach = (first, second), reach
        #: Distances of the codewords of a half from each other.
        self.apart = [np.sqrt(np.maximum((w * w).sum(1)[:, None] - 2 * w @ w.T + (w * w).sum(1), 1e-300)) for w in self.books]

    @property
    def split(self) -> int:
        return self.books[0].shape[1]

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Own codewords of each half, and least squared distances to the other codewords' regions."""
        owns, bounds = [], []
        for half, words, apart in zip((x[:, : self.split], x[:, self.split :]), self.books, self.apart, strict=True):
            near = (words * words).sum(1) - 2 * half @ words.T
            own = near.argmin(1)
            gap = (near - near[np.arange(len(x)), own][:, None]) / (2 * apart[own])
            gap[np.arange(len(x)), own] = 0
            owns.append(own)
            bounds.append(np.maximum(gap, 0) ** 2)
        return owns, bounds

    def visits(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Own cell of each row, and the cells it visits: from its own on, nearest first.

        The two halves' codewords are sorted by their bounds, and a heap walks the
        grid of both lists in the order of the sums until the reach is passed.
        """
        k = len(self.books[1])
        for at in range(0, len(x), 256):
            owns, (a, b) = self.bounds(x[at : at + 256])
            for r in range(len(a)):
                rows, columns = a[r].argsort(kind="stable"), b[r].argsort(kind="stable")
                rows, columns = rows[a[r][rows] <= self.reach].tolist(), columns[b[r][columns] <= self.reach].tolist()
                left, right = a[r][rows].tolist(), b[r][columns].tolist()
                own = int(owns[0][r] * k + owns[1][r])
                cells, front = [], [(left[0] + right[0], 0, 0)]
                while front and front[0][0] <= self.reach:
                    _, i, j = heapq.heappop(front)
                    if (cell := rows[i] * k + columns[j]) >= own:
                        cells.append(cell)
                    if j + 1 < len(right):
                        heapq.heappush(front, (left[i] + right[j + 1], i, j + 1))
                    if j == 0 and i + 1 < len(left):
                        heapq.heappush(front, (left[i + 1] + right[0], i + 1, 0))
                yield own, np.array(cells, np.int64)


def fit_grid(x: np.ndarray, n_words: int, cosine: float, recall: float) -> Grid:
    """Codebooks for unit rows ``x``, with the reach for ``recall``."""
    cut = x.shape[1] // 2
    one = np.zeros((1, cut)), np.zeros((1, x.shape[1] - cut))
    grid = Grid(*(_k_means(h, n_words) if h.shape[1] and n_words > 1 else o for h, o in zip((x[:, :cut], x[:, cut:]), one, strict=True)))
    grid.reach = 2 - 2 * cosine + 1e-9
    if recall < 1 and x.shape[1] > 2:
        rng = np.random.default_rng(8)
        u = x[rng.integers(0, len(x), 20_000)]
        off = rng.standard_normal(u.shape)
        off -= (off * u).sum(1, keepdims=True) * u
        v = cosine * u + np.sqrt(1 - cosine**2) * off / np.sqrt((off * off).sum(1, keepdims=True))
        total = np.zeros(len(u))
        for at in range(0, len(u), 1000):
            (_, bounds), (owns, _) = grid.bounds(u[at : at + 1000]), grid.bounds(v[at : at + 1000])
            total[at : at + 1000] = sum(b[np.arange(len(b)), o] for b, o in zip(bounds, owns, strict=True))
        grid.reach = min(grid.reach, float(np.quantile(total, recall)))
    return grid


def _placed(grids: dict[int, Grid]):
    """(rep, label, mult, vector) -> a resident row (role 0), and visitor rows (role 1) for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                vectors = units(batch.column("vector"))
                take, cell, role, home = [], [], [], []
                dims = np.array([len(v) for v in vectors], int)
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    grid = grids.get(int(dim)) or Grid(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))
                    for r, (own, cells) in zip(rows, grid.visits(np.stack([vectors[i] for i in rows])), strict=True):
                        take += [r] * (1 + len(cells))
                        cell += [own, *cells.tolist()]
                        role += [0] + [1] * len(cells)
                        home += [own] * (1 + len(cells))
                out = batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(dims[take], pa.int32()), pa.array(cell, pa.int64()), pa.array(role, pa.int32()), pa.array(home, pa.int64())], [*out.schema.names, "dim", "cell", "role", "own"])

    return run


def _met(cosine: float):
    """Blocks, residents first -> (a, null, n) counts of links and (a, b, null) forest edges."""
    names = ("label", "dim", "cell", "h", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, mult, vectors, label, linked = None, [], [], [], np.zeros(0, int), np.zeros(0)

        def closed() -> tuple[list, list]:
            return [home[i] for i in np.flatnonzero(linked)], linked[linked > 0].astype(int).tolist()

        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            role, reps, mults = (batch.column(n).to_pylist() for n in ("role", "rep", "mult"))
            x, own = units(batch.column("vector")), np.array(batch.column("own").to_pylist())
            a, b, n = [], [], []
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and role[end] == role[at]:
                    end += 1
                if keys[at] != key:
                    done, count = closed()
                    a += done
                    n += count
                    b += [None] * len(done)
                    key, home, mult, vectors, label, linked = keys[at], [], [], [], np.zeros(0, int), np.zeros(0)
                if role[at] == 0:
                    home += reps[at:end]
                    mult += mults[at:end]
                    vectors += x[at:end]
                    label, linked = np.arange(len(home)), np.zeros(len(home))
                elif home:
                    r, weight, block = np.array(home), np.array(mult, float), np.stack(vectors)
                    for lo in range(at, end, 512):
                        hi = min(end, lo + 512)
                        near = block @ np.stack(x[lo:hi]).T >= cosine
                        q = np.array(reps[lo:hi])
                        near &= (own[lo:hi] != key[2])[None, :] | (q[None, :] > r[:, None])  # neighbours at home meet once
                        linked += near @ np.array(mults[lo:hi], float)
                        count = weight @ near
                        for c in np.flatnonzero(count):
                            a.append(int(q[c]))
                            b.append(None)
                            n.append(int(count[c]))
                            classes, first = np.unique(label[near[:, c]], return_index=True)
                            hits = np.flatnonzero(near[:, c])[first]
                            a += [int(q[c])] * len(hits)
                            b += r[hits].tolist()
                            n += [None] * len(hits)
                            if len(classes) > 1:
                                label[np.isin(label, classes)] = classes[0]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])
        done, count = closed()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array([None] * len(done), pa.int64()), pa.array(count, pa.int64())], ["a", "b", "n"])

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, recall: float = RECALL) -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``.

    Vectors of equal labels are linked at ``cosine`` or more. A vector that is
    null, empty, zero or holds a null or non-finite component, and a row whose
    label or id is null, is linked with nothing: 0 links, its own component.
    Equal vectors of a label are one class from the start and count as links of
    each other; vectors of different lengths are never linked. Rows that share
    an id are one node for components and each counts as a vector for links. An
    empty table gives an empty one; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False)))
    classes = rows.where("sound").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    classes = stage_table(classes.select("rep", "label", "mult", "vector"), "vectors")

    sizes = classes.groupBy(F.size("vector").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("n")).orderBy(F.desc("n")).limit(8).collect()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toArrow()
    drawn = units(sample.column("vector").combine_chunks()) if sample.num_rows else []
    grids = {}
    for s in sizes:
        x = [v for v in drawn if len(v) == s["dim"]]
        if x:
            words = int(np.clip(np.ceil(np.sqrt(s["n"] / CELL)), 1, min(MOST_WORDS, max(1, len(x) // 8))))
            grids[s["dim"]] = fit_grid(np.stack(x), words, cosine, recall)

    kind = dict(classes.dtypes)
    schema = f"rep long, label {kind['label']}, mult long, vector {kind['vector']}, dim int, cell long, role int, own long"
    placed = classes.mapInArrow(_placed(grids), schema)
    placed = stage_table(placed, "cells")
    where = ["label", "dim", "cell"]
    blocks = placed.groupBy(where).agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("role") == 0) / RESIDENTS)).cast("int").alias("hs"),
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("role") == 1) / VISITORS)).cast("int").alias("qs"),
        F.count_if(F.col("role") == 0).alias("residents"),
    ).where("residents > 0").drop("residents")
    dealt = placed.join(blocks, where)
    everyone = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda n: F.array(F.pmod(F.xxhash64("rep"), F.col(n)).cast("int"))
    dealt = dealt.withColumn("h", F.explode(F.when(F.col("role") == 0, one("hs")).otherwise(everyone("hs")))).withColumn("q", F.explode(F.when(F.col("role") == 1, one("qs")).otherwise(everyone("qs"))))
    keys = [*where, "h", "q"]
    met = dealt.select(*keys, "role", "rep", "mult", "vector", "own").repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(_met(cosine), "a long, b long, n long")
    met = stage_table(met, "met")
    drop_stage_table(placed)

    counts = met.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    found = stage_table(connected_components(met.where("b is not null").select("a", "b")), "components")
    known = classes.join(counts, F.col("rep") == F.col("a"), "left").join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("label").alias("label_"), F.col("vector").alias("vector_"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    out = rows.join(known, F.col("sound") & (F.col("label") == F.col("label_")) & (F.col("vector") == F.col("vector_")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
