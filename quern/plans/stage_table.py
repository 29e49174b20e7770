"""Written tables between the steps of an iterative or branching job.

A step that is read more than once, or that ends an iteration, is written as
Parquet below the folder that ``spark.checkpoint.dir`` names and read again.
That cuts the lineage, survives the loss of any executor, and stores columns
compressed. Only where the setting is absent and all runs on this machine (tests,
a notebook) a folder of this machine is used; on a cluster that is an error.

Tables that a result still reads stay in the folder until the application that
owns it removes it; operators drop those that nothing reads any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one set here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stage_table(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once into the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop_stage_table(df: DataFrame) -> None:
    """Delete a table that :func:`stage_table` wrote and that nothing reads any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
