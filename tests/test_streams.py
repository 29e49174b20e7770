"""Adapters as Data Sources, failures of single sources, and the ingest as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans import jobs
from quern.sources.adapters import Adapter, read_sources
from quern.streaming import ingest as stream
from tests.test_jobs import NOTICE, items


class Numbered(Adapter):
    """Items that a source's ``texts`` hold; it fails at the place ``fails``."""

    def fetch(self, source, start, end):
        for k in range(start, len(source["texts"]) if end is None else end):
            if k == source.get("fails"):
                raise OSError(f"no page {k}")
            yield {"source_url": f"https://x/{source['source_id']}/{k}", "title": "PUBLIC NOTICE", "raw_text": source["texts"][k]}

    def latest(self, source):
        return len(source["texts"])


HERE = "tests.test_streams:Numbered"


def work(spark):
    rows = [("a", HERE), ("b", HERE), ("c", "no_such_adapter"), ("d", "manual_upload"), ("e", HERE)]
    return [{"source_id": i, "adapter": a, "texts": [f"{NOTICE} {i} {k}" for k in range(3)], "fails": 1 if i == "b" else None} for i, a in rows]


def test_sources_as_partitions(spark):
    df = read_sources(spark, work(spark))
    assert df.rdd.getNumPartitions() == 5
    got = sorted((r["source_id"], r["place"], r["error"]) for r in df.collect() if r["place"] is not None)
    assert got == [("a", 0, None), ("a", 1, None), ("a", 2, None), ("b", 0, None), ("e", 0, None), ("e", 1, None), ("e", 2, None)]
    assert sorted((r["source_id"], r["error"]) for r in df.where("error is not null").collect()) == [("b", "OSError: no page 1"), ("c", "LookupError: unknown adapter: no_such_adapter")]


def test_sources_as_a_stream(spark, tmp_path):
    sources = [s for s in work(spark) if s["source_id"] != "c"]
    for _ in range(2):  # what has been read isn't read again
        q = read_sources(spark, sources, stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["source_id"], r["place"]) for r in got.where("error is null").collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("e", 0), ("e", 1), ("e", 2)]
    assert [r["error"] for r in got.where("error is not null").collect()] == ["OSError: no page 1"]
    sources[0]["texts"].append("one more")
    q = read_sources(spark, sources, stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("source_id = 'a'").count() == 4


def test_two_of_five_sources_fail_while_running(spark):
    registry = spark.createDataFrame([(i,) for i in "abcde"], "source_id string").withColumn("domains_covered", F.array(F.lit("health"))).withColumn("organization", F.lit("o")).withColumn("adapter", F.lit("own")).withColumn("primary_language", F.lit("en")).withColumn("trust_score", F.lit(80))
    stored = spark.createDataFrame([], "psa_id string, content_hash string, source_url string")

    def read(source):
        i = source["source_id"]
        rows = spark.range(4).select(F.lit(i).alias("source_id"), F.concat(F.lit(f"https://x/{i}/"), "id").alias("source_url"), F.lit("PUBLIC NOTICE").alias("title"), F.lit(None).cast("string").alias("raw_html"), F.lit(None).cast("timestamp").alias("published_at"), "id")
        broken = F.when(F.col("id") == 3, F.raise_error(F.lit(f"page of {i} is broken")).cast("string")).otherwise("x") if i in "bd" else F.lit("")
        return rows.withColumn("raw_text", F.concat(F.lit(f"{NOTICE} {i} "), "id", broken))

    out = jobs.ingest_sources(registry, read, stored)
    log = {r["source_id"]: (r["status"], r["items_found"], r["items_stored"], r["items_rejected"]) for r in out["log"].collect()}
    assert log == {"a": ("success", 4, 4, 0), "c": ("success", 4, 4, 0), "e": ("success", 4, 4, 0), "b": ("failed", 0, 0, 0), "d": ("failed", 0, 0, 0)}
    assert all("is broken" in r["error"] for r in out["log"].where("status = 'failed'").collect())
    assert {r["source_id"] for r in out["notices"].collect()} == set("ace")


def write(spark, path, texts, first=0, urls=None):
    batch = items(spark, *texts)
    batch = batch.withColumn("source_url", F.element_at(F.array(*[F.lit(u) for u in urls]), (F.col("ord") + 1).cast("int")) if urls else F.concat(F.lit("https://x/"), F.col("ord") + first))
    batch.withColumn("scraped_at", F.timestamp_seconds(F.lit(1_767_225_600) + F.col("ord") + first)).drop("ord").coalesce(1).write.mode("append").parquet(path)
    return batch.drop("ord").schema


def run(spark, tmp_path, schema, checkpoint="cp"):
    stream.ingest_stream(stream.stream_items(spark, str(tmp_path / "in"), schema), str(tmp_path / "store"), str(tmp_path / checkpoint)).awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "store"))


def test_batches_know_what_is_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "MOST_FILES", 2)
    monkeypatch.setattr(stream, "BUCKETS", 4)
    read = []
    scan = stream.KeyTable.scan

    def spy(self, buckets, but):
        df = scan(self, buckets, but)
        read.append(len(df.inputFiles()) if df is not None else 0)
        return df

    monkeypatch.setattr(stream.KeyTable, "scan", spy)
    schema = write(spark, str(tmp_path / "in"), [NOTICE, NOTICE.upper(), "other " + NOTICE], urls=["https://x/1", "https://x/2", None])
    assert run(spark, tmp_path, schema).count() == 2  # the second has the first one's hash
    for k in range(4):  # a late repeat, a known address, a new text
        write(spark, str(tmp_path / "in"), [NOTICE, f"known address {k} " + NOTICE, f"new {k} " + NOTICE], urls=[None, "https://x/1", f"https://x/new{k}"])
        got = run(spark, tmp_path, schema)
    assert got.count() == 6 and sorted(r["psa_id"] for r in got.collect()) == [f"psa_2026_{n:06d}" for n in range(1, 7)]
    assert max(read) <= 4 * 3  # as many files as folders have at the most, however many batches there were
    assert run(spark, tmp_path, schema).count() == 6
    # Another checkpoint reads all files again, stores nothing twice, and numbers go on.
    write(spark, str(tmp_path / "in"), ["last " + NOTICE], first=100)
    got = run(spark, tmp_path, schema, "cp2")
    assert got.count() == 7 and got.agg(F.max("psa_id")).first()[0] == "psa_2026_000007"


def test_a_batch_that_runs_again(spark, tmp_path):
    rows = jobs.item_columns(items(spark, NOTICE, "other " + NOTICE).drop("ord"))
    more = jobs.item_columns(items(spark, "third " + NOTICE, NOTICE).drop("ord").withColumn("source_url", F.concat("source_url", F.lit("/b"))))
    path = str(tmp_path / "store")
    for batch, n in ((rows, 0), (rows, 0), (more, 1), (more, 1)):
        stream.store_batch(batch, n, path)
    got = sorted(r["psa_id"] for r in spark.read.parquet(path).collect())
    assert got == ["psa_2026_000001", "psa_2026_000002", "psa_2026_000003"]
