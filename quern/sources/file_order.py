"""The order of rows in files: by path, by place within the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.stage_table import stage_table

#: Splits or files up to which a table with a row for each is broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a table of ``SMALL`` rows or fewer; any larger one as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def in_file_order(scan: DataFrame, headers: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Rows of files with ``ord``, their place from 0 in the order of paths and lines, and ``path_``, ``file_``.

    ``scan`` comes straight from a reader of files. A file may be read in several
    splits and a task may read splits of several files, the largest first, so
    neither the partition nor the number of a row in it tells its place. A split
    is named by its path and the byte where it begins, and its rows stand in one
    partition in the order of their lines. So splits are counted and summed up in
    name order, and a row's place is its distance from the first row of its split
    after all splits before: no rows are sorted. The rows are written once, so
    that both readings see the same splits.

    With ``headers`` the first row of every file is set apart and has no place;
    the second result holds these rows.
    """
    meta = F.col("_metadata")
    rows = scan.select("*", meta["file_path"].alias("path_"), meta["file_name"].alias("file_"), meta["file_block_start"].alias("block_"), F.monotonically_increasing_id().alias("at_"))
    rows = stage_table(rows, "files")
    own = (F.col("block_") == 0).cast("long") if headers else F.lit(0).cast("long")
    splits = rows.groupBy("path_", "block_").agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_")).withColumn("first_", F.col("first_") + own).withColumn("n_", F.col("n_") - own)
    before = Window.orderBy("path_", "block_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    splits = splits.select("path_", "block_", "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    placed = rows.join(small(splits), ["path_", "block_"]).withColumn("ord", F.col("before_") + F.col("at_") - F.col("first_"))
    columns = [*scan.columns, "path_", "file_"]
    if not headers:
        return placed.select(*columns, "ord"), None
    is_header = (F.col("block_") == 0) & (F.col("at_") < F.col("first_"))
    return placed.where(~is_header).select(*columns, "ord"), placed.where(is_header).select(columns)
