"""Rows of a vector column that whitening and compression can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Magnitude from which a component counts as this, so that squares and sums of many rows stay exact.
MOST = float(1 << 18)


def sound_vectors(vectors: DataFrame, vector_col: str, **columns: str) -> tuple[DataFrame, int]:
    """The rows whose vector has only finite components, as ``vector`` beside ``columns``, and its length.

    Null vectors and vectors with null or non-finite components go. So do vectors
    of another length than the most frequent one (of equally frequent ones the
    greatest), which have no place in the same space, and empty ones. The length
    is 0 where nothing stays.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(*[F.col(c).alias(name) for name, c in columns.items()], F.col(vector_col).alias("vector")).where((F.size("vector") > 0) & finite)
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    return rows.where(F.size("vector") == dim), dim


def scaled_down(vector: str, scale: int) -> Column:
    """``floor(scale * component)`` of all components, each within ``MOST`` either way before; ``scale`` is a power of two."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-MOST)), F.lit(MOST)) * scale))
