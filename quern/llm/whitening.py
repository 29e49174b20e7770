"""Whitening of embeddings by the eigenvectors of their covariance.

Method: every component is brought to an integer, ``floor(SCALE * component)``.
The fit list holds each distinct integer vector once. Its sums are exact, so its
rows can be centred exactly: ``(n * x - S) / n`` has an integer numerator. The
covariance is MLlib's ``RowMatrix.computeGramianMatrix`` of these rows, divided
by n. Its eigenvectors are found locally, scaled to unit variance and broadcast,
and all rows are whitened by one matrix product a batch in ``mapInPandas``.

Scale: a covariance of d dimensions is d * d numbers, which is all that reaches
the driver beside sums. Rows are read three times, and only distinct vectors are
shuffled, after each task has dropped its own repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.sound_vectors import scaled_down, sound_vectors
from quern.plans.stage_table import drop_stage_table, stage_table

SCALE = 64
#: The contract's integers are those above plus this, which cancels out of all results.
OFFSET = 1_000_000
COMPONENTS = 16
#: Share of all variance up to which a component's variance is taken for rounding.
NOTHING = 1e-12


def _gramian(rows: DataFrame, vector: Column) -> np.ndarray:
    """Sum of the outer products of the rows' vectors with themselves, by MLlib."""
    one = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(vector).alias("v")), "v")
    return RowMatrix(one).computeGramianMatrix().toArray()


def _sums(rows: DataFrame, column: str, kind: str) -> tuple[int, list]:
    """Number of rows and the sum of each place of an array column; a task sums its batches up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                total = total + batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(0)
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()])], ["n", "sums"])

    parts = rows.select(column).mapInArrow(run, f"n long, sums array<{kind}>")
    found = parts.select("n", F.posexplode("sums").alias("at", "sum")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).orderBy("at").collect()
    return (found[0]["n"] if found else 0), [r["sum"] for r in found]


def _squares(centred: np.ndarray) -> list[int | None]:
    """Exact sum of each row's squares, null beyond 64 bits."""
    most = int(np.abs(centred).max(initial=0))
    if most * most * centred.shape[1] < 1 << 63:
        return np.einsum("ij,ij->i", centred, centred).tolist()
    sums = (centred.astype(object) ** 2).sum(1)
    return [s if s < 1 << 63 else None for s in sums]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    Components are numbered from 1 by falling variance; fewer than
    ``components`` are returned where there are fewer dimensions or where the
    rest of the variance is ``NOTHING``, so that equal vectors only, or a single
    one, give no row. Vectors that are null, empty, hold a null or non-finite
    component or have another length than most go; components beyond ``MOST``
    count as ``MOST``. ``deviation`` is null beyond 64 bits. Repeated rows are
    whitened alike and fitted once; a null id stays null; an empty table gives an
    empty one. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, dim = sound_vectors(vectors, vector_col, id=id_col)
    rows = rows.select("id", scaled_down("vector", scale).alias("x"))
    fit = stage_table(rows.select("x").distinct(), "fit")
    n, sums = _sums(fit, "x", "long") if dim else (0, [])
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not n:
        return spark.createDataFrame([], schema).select(names)

    total = F.array(*[F.lit(s) for s in sums])
    centred = lambda x: F.zip_with(x, total, lambda v, s: (v * F.lit(n) - s).cast("double") / n)
    covariance = _gramian(fit, centred("x")) / n
    variance, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = [k for k in np.argsort(-variance, kind="stable")[:components] if variance[k] > NOTHING * max(np.trace(covariance), 0)]
    if not order:
        return spark.createDataFrame([], schema).select(names)
    turn = spark.sparkContext.broadcast((np.array(sums, np.int64), axes[:, order] / np.sqrt(variance[order])))

    def whitened(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        centred = np.stack(x.to_numpy()).astype(np.int64) * n - turn.value[0]
        return centred, (centred / n) @ turn.value[1]

    def of_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"w": list(whitened(batch["x"])[1])})

    white = fit.mapInPandas(of_fit, "w array<double>")
    means = F.array(*[F.lit(s / n) for s in _sums(white, "w", "double")[1]])
    error = float(np.abs(_gramian(white, F.zip_with("w", means, lambda v, m: v - m)) / n - np.eye(len(order))).max())
    explained = variance[order] / np.trace(covariance)
    drop_stage_table(fit)  # what is returned reads the vectors alone

    def of_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(order)
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.iloc[at : at + 4096]
                centred, white = whitened(batch["x"])
                yield pd.DataFrame({
                    "id": batch["id"].repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1), len(batch)).astype(np.int32), "n": n,
                    "deviation": pd.array(_squares(centred), dtype="Int64").repeat(k), "whitened": white.ravel(), "explained": np.tile(explained, len(batch)), "identity_error": error,
                })

    return rows.mapInPandas(of_all, schema).select(names)
