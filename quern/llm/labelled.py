"""Labelled rows for the classifiers, split by a checksum of the document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on: those with the smallest id hashes.
FIT_ROWS = 20_000


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, id_col: str = "doc_id", text_col: str = "text", most: int = FIT_ROWS) -> DataFrame:
    """``(text, y)`` of at most ``most`` labelled documents outside the held-out fold.

    Of several labels of an id the mean decides, 0.5 counting as 1; null ids and
    labels are ignored. The chosen ids number ``most`` at the most and hold a
    long and a byte each, so they are broadcast; the other documents stay in
    place. An id counts once however many rows have it: of several texts the one
    with the least hash.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, modulus, remainder))
        .groupBy(F.col(id_col).alias("id_"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("id_"), "id_")
        .limit(most)
    )
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id_")
    return rows.groupBy("id_", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")).select("first.text", "y")


def scored(docs: DataFrame, score, modulus: int, remainder: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``score`` maps Arrow batches (id, text) to (id, score)."""
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
