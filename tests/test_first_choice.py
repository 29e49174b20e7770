"""The ingest's choice in order beside the plain loop."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators.first_choice import first_choice
from quern.operators.ranking import keep_first
from quern.plans import jobs
from tests.test_jobs import NOTICE, items

KINDS = "ord long, h string, u string, more string"


def loop(rows):
    """Rows in order, stored unless the hash or the address is stored by then."""
    hashes, urls, kept = set(), set(), []
    for o, h, u, _ in sorted(rows, key=lambda r: r[0]):
        if (h is not None and h in hashes) or (u is not None and u in urls):
            continue
        hashes.add(h)
        urls.add(u)
        kept.append(o)
    return kept


@pytest.mark.parametrize("tail", [0, 3, 1000])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.integers(0, 6))), max_size=30))
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
def test_as_the_loop(spark, tail, pairs):
    rows = [(i, None if h is None else f"h{h}", None if u is None else f"u{u}", f"x{i}") for i, (h, u) in enumerate(pairs)]
    df = spark.createDataFrame(rows + rows[:2], KINDS).repartition(3)
    assert sorted(r["ord"] for r in first_choice(df, "ord", "h", "u", tail=tail).collect()) == loop(rows)


def test_rounds(spark):
    # A row that isn't stored bars none: the third shares its hash with the second only.
    rows = [(1, "a", "x", ""), (2, "b", "x", ""), (3, "b", "y", "")]
    seen: list[int] = []
    assert sorted(r["ord"] for r in first_choice(spark.createDataFrame(rows, KINDS), "ord", "h", "u", tail=0, rounds=seen).collect()) == [1, 3]
    assert seen == [3, 1]
    # Plain copies take one round, however many; a chain takes one for every two links.
    copies = [(i, f"h{i % 7}", f"u{i % 7}", "") for i in range(200)]
    seen = []
    assert sorted(r["ord"] for r in first_choice(spark.createDataFrame(copies, KINDS), "ord", "h", "u", tail=0, rounds=seen).collect()) == list(range(7))
    assert seen == [200]
    chain = [(i, f"h{i // 2}", f"u{(i + 1) // 2}", "") for i in range(8)]
    seen = []
    assert sorted(r["ord"] for r in first_choice(spark.createDataFrame(chain, KINDS), "ord", "h", "u", tail=0, rounds=seen).collect()) == loop(chain)
    assert seen == [8, 6, 4, 2]
    seen = []
    first_choice(spark.createDataFrame(chain, KINDS), "ord", "h", "u", tail=4, rounds=seen)
    assert seen == [8, 6]


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "ord long, h string")
    assert sorted(r["ord"] for r in keep_first(df, "h", "ord").collect()) == [1, 3]


def test_ingest_without_addresses_and_with_chains(spark):
    stored = spark.createDataFrame([], "psa_id string, content_hash string, source_url string")
    texts = [NOTICE, NOTICE + " once more", "other " + NOTICE, NOTICE + " once more", "third " + NOTICE]
    urls = ["https://x/1", "https://x/1", None, "https://x/3", None]
    df = items(spark, *texts).drop("source_url").join(spark.createDataFrame(list(enumerate(urls)), "ord long, source_url string"), "ord")
    out = jobs.ingest(df.unionByName(df.where("ord = 4")), stored)
    got = sorted((r["ord"], r["source_url"], r["status"], "missing_source_url" in r["errors"]) for r in out["notices"].collect())
    assert got == [(0, "https://x/1", "active", False), (2, None, "quarantined", True), (3, "https://x/3", "active", False), (4, None, "quarantined", True)]
    assert sorted(r["psa_id"][-6:] for r in out["notices"].collect()) == ["000001", "000002", "000003", "000004"]
    assert tuple(out["log"].first()) == ("s", 6, 2, 4)  # a repeat is found, too


def test_repeats_of_a_source_are_found(spark):
    registry = spark.createDataFrame([("a", 80)], "source_id string, trust_score int").withColumn("domains_covered", F.array(F.lit("health"))).withColumn("organization", F.lit("o")).withColumn("adapter", F.lit("rss")).withColumn("primary_language", F.lit("en"))
    stored = spark.createDataFrame([], "psa_id string, content_hash string, source_url string")
    read = lambda source: spark.createDataFrame([("a", "https://x/1", "PUBLIC NOTICE", None, NOTICE, None)] * 3, "source_id string, source_url string, title string, raw_html string, raw_text string, published_at timestamp")
    log = jobs.ingest_sources(registry, read, stored)["log"].first()
    assert (log["items_found"], log["items_stored"], log["items_rejected"]) == (3, 1, 2)
