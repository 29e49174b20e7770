"""Running sums over a hash order within groups, without a task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a key that :func:`hash_key` makes.
KEY_BITS = 60
#: Most bits that name a bucket, so that a group's sums stay some million rows.
MOST_BITS = 20
#: Rows that one bucket of the order holds on average.
BUCKET_ROWS = 256
#: Rows that are assumed where nobody counted: 16,384 buckets a group.
SOME_ROWS = BUCKET_ROWS << 13


def hash_key(*columns):
    """A 60-bit key from the MD5 of the columns as text; nulls count as empty."""
    text = F.concat_ws("#", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def exclusive_sums(rows: DataFrame, group: list[str], key: str, weight: str, out: str, n_rows: int = SOME_ROWS, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``out``, the sum of ``weight`` of all rows of the group that come before by ``key``.

    The key's first bits name buckets of about ``BUCKET_ROWS`` rows, their number
    follows ``n_rows``; a group's buckets are summed up first and each row then
    looks only within its own bucket. A group that holds most of the rows is
    spread over as many tasks as it has buckets. The group columns must hold no
    null; columns named ``bucket_``, ``sum_`` and ``before_`` are this function's.
    Which buckets there are changes nothing in the sums.
    """
    bits = min(max((max(n_rows, 1) // BUCKET_ROWS).bit_length(), 4), MOST_BITS)
    rows = rows.withColumn("bucket_", F.shiftright(F.col(key), KEY_BITS - bits))
    at = [*group, "bucket_"]
    totals = rows.groupBy(at).agg(F.sum(weight).alias("sum_"))
    before = Window.partitionBy(*group).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*at, F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("before_"))
    within = Window.partitionBy(*at).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(totals, at).withColumn(out, F.col("before_") + F.sum(weight).over(within) - F.col(weight)).drop("bucket_", "before_")
