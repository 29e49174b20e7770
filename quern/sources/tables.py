"""Tables at rest, and scans that keep all cores busy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file below which a task of its own isn't worth it, and from which on files have row groups enough.
LEAST_BYTES, SPLIT_BYTES = 1 << 20, 128 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A Parquet table; ``spread`` deals its rows out where the scan has fewer splits than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_rows(df) if spread else df


def spread_rows(df: DataFrame) -> DataFrame:
    """Deals rows out to all cores before costly expressions, if they come from a few files of one row group or so.

    A row group is read by one task, so a table in one small file keeps one core
    busy whatever the rest of the plan does. Only a table of fewer files than
    cores and of less than ``SPLIT_BYTES`` a core is dealt out, at the cost of one
    exchange of the columns that the plan needs; any other is returned as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df._jdf.inputFiles()  # its length comes alone, however many there are
    if len(files) >= cores:
        return df
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return df.repartition(cores) if LEAST_BYTES <= size < cores * SPLIT_BYTES else df
