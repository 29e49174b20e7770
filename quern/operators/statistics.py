"""Aggregates of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import word_tokens


def count_by(df: DataFrame, key, out: str = "n") -> DataFrame:
    """AGG-03: rows of each key, null or empty as Unknown."""
    key = F.col(key) if isinstance(key, str) else key
    name = F.when(key.isNotNull() & (key.cast("string") != ""), key.cast("string")).otherwise("Unknown")
    return df.groupBy(name.alias("key")).agg(F.count(F.lit(1)).alias(out))


def count_true(condition: Column) -> Column:
    """AGG-06: rows for which a condition holds; null doesn't count."""
    return F.count(F.when(condition, 1))


def lenient_flag(c) -> Column:
    """Q19: ``true``, ``True``, ``1`` and the boolean itself."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string").isin("true", "True", "1"), F.lit(False))


def nearest_rank(df: DataFrame, value: str, percents: dict[str, float]) -> DataFrame:
    """AGG-07: one row: n, min, nearest-rank percentiles, max and mean of a whole-number column.

    The rank is half-to-even of p/100 * (n - 1). Equal values are counted first,
    so the running count is over the distinct values only.
    """
    counts = df.groupBy(F.coalesce(F.col(value), F.lit(0)).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    run = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(whole))
    own = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p / 100.0) * (F.col("n") - 1), 0), F.col("v")))
    zero = F.lit(0)
    return counts.agg(
        F.coalesce(F.sum("c"), zero).alias("n"), F.coalesce(F.min("v"), zero).alias("min"),
        *[F.coalesce(own(p).cast("double"), F.lit(0.0)).alias(name) for name, p in percents.items()],
        F.coalesce(F.max("v"), zero).alias("max"), F.coalesce(F.bround(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 2), F.lit(0.0)).alias("mean"),
    )


def vocabulary(df: DataFrame, text: str, order: str) -> DataFrame:
    """AGG-08: ``(token, n, first)``: word tokens, how often, and where first (order, place)."""
    rows = df.select(F.col(order).alias("o"), F.posexplode(word_tokens(text)).alias("p", "token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "p")).alias("first"))


def top(counts: DataFrame, k: int, *ties) -> DataFrame:
    """ORD-03: the ``k`` most frequent rows, ties in the given order."""
    return counts.orderBy(F.desc("n"), *ties).limit(k)


def gap_to(df: DataFrame, target: int) -> DataFrame:
    """AGG-12: how many rows are missing to a target."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.greatest(F.lit(0), F.lit(target) - F.count(F.lit(1))).cast("long").alias("gap"))


def bins(value: Column, low: float, high: float, n: int) -> Column:
    """AGG-16: the bin from 1 to ``n`` of a histogram; the upper end belongs to the last bin."""
    return F.least(F.lit(n), F.greatest(F.lit(1), F.floor((value - F.lit(low)) / F.lit((high - low) / n)).cast("int") + 1))
