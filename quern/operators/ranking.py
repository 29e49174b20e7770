"""Keep-first, renumbering and other orders over the rows of a sheet.

Sheets carry their order in a column; ``ord`` names it below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.stage_table import drop_stage_table, stage_table

#: Rows that one task numbers at the most, on average.
PART_ROWS = 4_000_000


def keep_first(df: DataFrame, key: str, *order) -> DataFrame:
    """WIN-01/08: the first row of each key, decided by a partial aggregation and not by a sort of the key.

    The order must be unique within a key; null keys are one key. Only the order
    travels with the key before the join, so a frequent key costs one row a task.
    """
    first = df.groupBy(F.col(key).alias("key_")).agg(F.min(F.struct(*order)).alias("first_"))
    own = F.struct(*order)
    return df.withColumn("own_", own).join(first, F.col(key).eqNullSafe(F.col("key_")) & (F.col("own_") == F.col("first_"))).drop("own_", "key_", "first_")


def dense_number(df: DataFrame, out: str, *order: str, buckets: int | None = None) -> DataFrame:
    """WIN-02: numbers from 1 without gaps, without one task for all rows.

    ``order`` names columns that are unique together, nulls first. Only these
    are range-partitioned: each partition's rows are counted, and a row's number is
    its place within the partition after all before. There are as many partitions
    as a shuffle has, or more, so that none sorts more than ``PART_ROWS`` or so.
    The rows then get their numbers by a join. Other columns may have any name.
    """
    keys = stage_table(df.select(*order), "order")
    buckets = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // PART_ROWS))
    named = [f"o{i}_" for i in range(len(order))]
    placed = stage_table(keys.toDF(*named).repartitionByRange(buckets, *named).withColumn("part_", F.spark_partition_id()), "numbered")
    drop_stage_table(keys)
    sizes = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part_", before.alias("before_"))  # one row for each of the buckets
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*named))
    numbers = placed.join(F.broadcast(sizes), "part_").select(*named, (F.col("before_") + within).cast("long").alias("number_"))
    # The rows' own columns go as one, so that none of their names is in the way.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"))
    same = reduce(lambda a, b: a & b, [rows["row_"][c].eqNullSafe(numbers[o]) for c, o in zip(order, named, strict=True)])
    return rows.join(numbers, same).select("row_.*", F.col("number_").alias(out))


def renumber(df: DataFrame, id_col: str, prefix: str, year: int, *order, original: str = "original_id") -> DataFrame:
    """WIN-02: ids ``prefix_year_000001`` in order, the old id kept beside."""
    df = dense_number(df.withColumn(original, F.col(id_col)), "number_", *order)
    return df.withColumn(id_col, F.format_string(f"{prefix}_%d_%06d", F.lit(year), F.col("number_"))).drop("number_")


def next_ids(new: DataFrame, stored_numbers: DataFrame, number_col: str, out: str, *order) -> DataFrame:
    """WIN-03: numbers that go on from the largest one stored, so none is used twice."""
    top = stored_numbers.agg(F.coalesce(F.max(number_col), F.lit(0)).alias("top_"))
    return dense_number(new, out, *order).crossJoin(F.broadcast(top)).withColumn(out, F.col(out) + F.col("top_")).drop("top_")


def shuffle_key(seed: int, id_col: str) -> Column:
    """WIN-07: the sort key of a seeded shuffle, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")).cast("binary"))


def one_then_fill(df: DataFrame, n: int, group: str, *order) -> DataFrame:
    """WIN-05: the best row of every group in order, then the rest, ``n`` rows in all.

    The order must be unique within a group. As in :func:`keep_first` only it is
    aggregated and joined, so the largest group is no single task's.
    """
    own = df.withColumn("own_", F.struct(*order))
    first = own.groupBy(F.col(group).alias("key_")).agg(F.min("own_").alias("first_"))
    marked = own.join(first, F.col(group).eqNullSafe(F.col("key_")) & (F.col("own_") == F.col("first_")), "left").withColumn("later_", F.col("first_").isNull().cast("int"))
    return marked.orderBy("later_", *order).limit(n).drop("own_", "key_", "first_", "later_")


def prefix_then_filter(df: DataFrame, passed: str, scored: str, limit: int, scan: int, order: str) -> DataFrame:
    """WIN-06: passing rows of the first ``scan`` until more than half of ``limit`` are kept, then only scored ones.

    The last row scanned is taken whatever its score; at twice the limit it
    stops. ``order`` numbers the rows from 1. At most ``scan`` rows, a parameter
    of the feature, meet in the running counts.
    """
    rows = df.where(F.col(passed) & (F.col(order) <= scan))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("passed_", F.count(F.lit(1)).over(w))
    rows = rows.where((F.col("passed_") <= limit // 2 + 1) | (F.col(scored) > 0) | (F.col(order) >= scan))
    return rows.withColumn("kept_", F.count(F.lit(1)).over(w)).where(F.col("kept_") <= 2 * limit).drop("passed_", "kept_")
