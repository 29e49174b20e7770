"""The ingest path and the log roll-up as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.first_choice import first_choice
from quern.operators.ranking import dense_number
from quern.plans.jobs import in_order, item_columns
from quern.plans.stage_table import stage_table
from quern.sources.sheets import path_exists

#: Folders of known keys. A batch reads those that its own keys fall into.
BUCKETS = 1024
#: Files of a folder of keys from which on they are made one.
MOST_FILES = 8


def stream_items(spark: SparkSession, path: str, schema, most_files: int = 100) -> DataFrame:
    """A stream of raw items from files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


class KeyTable:
    """Hashes and addresses that are stored, in ``BUCKETS`` folders by a hash of the key.

    A look-up reads only the folders that its keys fall into, and a folder is kept
    to ``MOST_FILES`` files, so the files that a batch reads don't grow with what
    is stored. Keys carry the batch that stored them: one that runs again after a
    failure doesn't meet its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self) -> dict[int, list]:
        """The files of each folder."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[int, list] = {}
        for f in fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket=*/*.parquet")) or []:
            found.setdefault(int(f.getPath().getParent().getName().partition("=")[2]), []).append(f.getPath())
        return found

    @staticmethod
    def of(rows: DataFrame) -> DataFrame:
        """``key, bucket`` of rows with a hash or an address."""
        keys = F.array(F.concat(F.lit("h:"), "content_hash"), F.concat(F.lit("u:"), "source_url"))
        return rows.select(F.explode(F.array_compact(keys)).alias("key")).distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))

    def scan(self, buckets: list[int], but: str) -> DataFrame | None:
        """The keys of some folders that other batches than ``but`` stored; None where there is no file."""
        there = self._files()
        paths = [p.toString() for b in buckets for p in there.get(b, [])]
        return self.spark.read.schema("key string, batch string").parquet(*paths).where(F.col("batch") != but) if paths else None

    def add(self, rows: DataFrame, batch: str) -> None:
        """The rows' keys, and folders of too many files made one; a second adding of the same keys changes nothing."""
        new = stage_table(self.of(rows), "keys")
        new.select("key", F.lit(batch).alias("batch"), "bucket").repartition("bucket").write.partitionBy("bucket").mode("append").parquet(self.path)
        crowded = {b: files for b, files in self._files().items() if len(files) > MOST_FILES}
        if crowded:
            whole = self.spark.read.schema("key string, batch string, bucket int").option("basePath", self.path).parquet(*[p.toString() for files in crowded.values() for p in files])
            whole.groupBy("bucket", "key").agg(F.min("batch").alias("batch")).repartition("bucket").select("key", "batch", "bucket").write.partitionBy("bucket").mode("append").parquet(self.path)
            for files in crowded.values():  # only once their keys stand in the new files
                for p in files:
                    p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, False)


def store_batch(batch: DataFrame, batch_id: int, stored_path: str, run: str = "0", year: int = 2026) -> None:
    """JOB-01 for one batch of item columns: what is new by hash and address, numbered on from the batch before.

    Rows go to ``batch=run-N`` below ``stored_path``, keys and the last number to
    folders beside that readers of the table don't see. A batch that runs again
    writes the same rows over its own. A ``run`` names a stream with its
    checkpoint; the first batch of a new one goes on from the largest number.
    """
    spark, label = batch.sparkSession, f"{run}-{batch_id}"
    rows = stage_table(in_order(batch.withColumn("ord", F.col("scraped_at"))), "batch")
    keys = stage_table(KeyTable.of(rows), "batch-keys")
    table = KeyTable(spark, f"{stored_path}/_keys")
    known = table.scan([r["bucket"] for r in keys.select("bucket").distinct().collect()], label)  # at most BUCKETS
    if known is not None:
        known = stage_table(keys.join(known.select("key").distinct(), "key", "left_semi").select("key"), "known")
        for c, mark in (("content_hash", "h:"), ("source_url", "u:")):
            rows = rows.join(known.where(F.col("key").startswith(mark)).select(F.expr("substr(key, 3)").alias(c)), c, "left_anti")
    new = stage_table(first_choice(rows, "order_", "content_hash", "source_url"), "first")
    numbers = f"{stored_path}/_numbers"
    last = f"{numbers}/batch={run}-{batch_id - 1}" if batch_id else f"{numbers}/batch=*"
    top = 0
    if path_exists(spark, last):
        before = spark.read.schema("last long").parquet(last).where(~F.col("_metadata.file_path").contains(f"/batch={label}/"))
        top = before.agg(F.coalesce(F.max("last"), F.lit(0)).alias("last")).first()["last"]
    new = dense_number(new, "number_", "order_").withColumn("number_", F.col("number_") + F.lit(top))
    new = new.withColumn("psa_id", F.format_string("psa_%d_%06d", F.lit(year), "number_")).drop("number_", "order_", "ord")
    new = stage_table(new, "new")
    new.write.mode("overwrite").parquet(f"{stored_path}/batch={label}")
    table.add(new, label)
    new.agg((F.count(F.lit(1)) + F.lit(top)).alias("last")).write.mode("overwrite").parquet(f"{numbers}/batch={label}")


def ingest_stream(items: DataFrame, stored_path: str, checkpoint: str, year: int = 2026, **trigger) -> StreamingQuery:
    """JOB-01 as a stream: items in the order of ``scraped_at`` within a batch, batch after batch.

    Late rows are items like any others: what is stored is known by a key table
    and not by a state that expires. Ids go on from batch to batch without gaps.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "0"
        store_batch(batch, batch_id, stored_path, run, year)

    return item_columns(items).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def log_windows(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """AGG-13 over time: events and values of each type in tumbling windows; batch or stream."""
    events = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
