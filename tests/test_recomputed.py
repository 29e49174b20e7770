"""Queries that SQL can't express, recomputed in plain Python; rule files, parallel sheets, source runs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern import schemas as S
from quern.catalog import QUERIES
from quern.functions import lexicons as L
from quern.operators.sampling import allocate
from quern.plans import jobs
from quern.queries import boundary
from quern.sources import rulesets, sheets, tables

WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def words(text):
    return [w for w in re.split(f"[{WHITE}]+", text) if w]


def sentences(text, least=6, most=80):
    """TXT-27 one chunk at a time."""
    out = []
    for s in re.split(r"(?<=[.!?]) +(?=[A-Z\"'(])", " ".join(words(text))):
        s = s.strip(" \t\n\"'")
        if s.startswith("#") or s.startswith("http") or len(words(s)) < least:
            continue
        if len(words(s)) <= most:
            out.append(s)
            continue
        chunks, buf = re.split(r"(?<=[,;:]) +", s), ""
        for chunk in chunks:
            buf = f"{buf} {chunk}" if buf else chunk
            n = len(words(buf))
            if n >= least and (n >= most // 2 or chunk == chunks[-1]):
                out += [buf] if n <= most else []
                buf = ""
        out += [buf] if least <= len(words(buf)) <= most else []
    return out


def test_sentence_sheet(spark, sf):
    got = {r["sentence_id"]: (r["source_text"], r["token_count"]) for r in QUERIES["sentence_sheet"](spark, sf).collect()}
    expected = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for k, s in enumerate(sentences(r["text"] or "")):
            expected["psa_%06d_s%02d" % (r["doc_id"], k + 1)] = (s, len(words(s)))
    assert got == expected and len(got) > 500


def test_nfkc(spark):
    from quern.functions.python_hooks import nfkc, with_nfkc

    texts = ["plain", "ﬁne ２０ ½", "é", None, "Ⅳ℃㌔", "ｶﾞ", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    expected = {i: unicodedata.normalize("NFKC", t or "") for i, t in enumerate(texts)}
    assert {r["i"]: r["n"] for r in df.select("i", nfkc("t").alias("n")).collect()} == expected
    assert {r["i"]: r["t"] for r in with_nfkc(df, "t").collect()} == expected


def test_sizes_of_a_sample(spark, sf):
    counts = Counter(r["source"] or "Unknown" for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["key"]: r["n"] for r in QUERIES["stratified_sample_counts"](spark, sf).collect()}
    assert got == {g: n for g, n in allocate(dict(counts), 100, 3).items() if n} and sum(got.values()) == 100


def test_rule_files(spark, tmp_path):
    config = {"domains": {"a": {"sub_categories": {"x": {"keywords": ["k", 1]}, "y": {}}}}, "terms": [{"term": "M-PESA", "aliases": ["Mpesa", "", "Mpesa"]}, {"term": "m-pesa"}, {"term": "t", "keep_form": "T t"}, {}], "languages": [{"id": "sw", "nllb": "swh_Latn"}], "seed_defaults": {"max_source_tokens": 9}}
    (tmp_path / "rules.json").write_text(json.dumps(config))
    rules = rulesets.load_rules(spark, str(tmp_path / "rules.json"))
    assert rulesets.domain_rules(rules) == [("a", "x", ["k", "1"]), ("a", "y", [])]
    assert rulesets.glossary_rules(rules) == [("M-PESA", ["Mpesa"]), ("T t", ["t"])]
    assert rulesets.language_rules(rules) == [("sw", "", "swh_Latn", "")] and rulesets.seed_rules(rules)["max_source_tokens"] == 9
    assert rulesets.load_rules(spark, str(tmp_path / "none.yaml")) == {} and rulesets.parse_rules(" ") == {}
    with pytest.raises(ValueError):
        rulesets.parse_rules("[1, 2]")
    pytest.importorskip("yaml")
    (tmp_path / "rules.yaml").write_text("terms:\n  - term: KSh\n    aliases: [KES, Ksh]\n")
    assert rulesets.glossary_rules(rulesets.load_rules(spark, str(tmp_path / "rules.yaml"))) == [("KSh", ["KES", "Ksh"])]


def test_parallel_sheets(spark, tmp_path):
    head = ",".join(S.PAIRS.names[:4])
    for name in ("a_pairs.csv", "en_sw_pairs.csv", "b_pairs.csv"):
        (tmp_path / name).write_text(f'{head}\n{name}-1,p,"Health, all",en\n{name}-2,q,"two\nlines",en\n')
    got = sheets.read_parallel(spark, str(tmp_path / "*_pairs.csv")).select("pair_id", "Domain", "split", "_from_file").collect()
    assert sorted(map(tuple, got)) == [(f"{f}-{i}", d, None, f) for f in ("a_pairs.csv", "b_pairs.csv") for i, d in ((1, "Health, all"), (2, "two\nlines"))]
    assert sheets.read_parallel(spark, str(tmp_path / "*_pairs.csv"), include_external=True).count() == 6


def test_sources_fail_by_themselves(spark, sf):
    registry = spark.createDataFrame([("en",), ("xx",), ("yy",), ("none",)], "source_id string").withColumn("domains_covered", F.array(F.lit("health"))).withColumn("organization", F.lit("o"))
    work = rulesets.work_list(registry, ["yy", "en", "xx", "gone", "none"]).orderBy("place")
    out = jobs.ingest_sources(work, boundary._read(spark, sf), spark.createDataFrame([], "psa_id string, content_hash string, source_url string"))
    log = {r["source_id"]: r for r in out["log"].collect()}
    assert {i: r["status"] for i, r in log.items()} == {"en": "success", "xx": "failed", "yy": "failed", "gone": "failed", "none": "success"}
    assert log["none"]["items_found"] == 0 and "gone" in log["gone"]["error"]
    assert "no route to host" in log["xx"]["error"] and "no_such_column" in log["yy"]["error"]
    assert jobs.notice_records(out["notices"]).columns == S.NOTICE.names
    none = jobs.ingest_sources(work.where("source_id = 'xx'"), boundary._read(spark, sf), spark.createDataFrame([], "psa_id string, content_hash string, source_url string"))
    assert none["notices"].count() == 0 and none["log"].count() == 1


def test_synthetic_statistics(spark):
    """AGG-17: attempts end with the last one needed; each is added, a duplicate or rejected by its label."""
    slots = {
        "orgs": {d: ["The ministry"] for d in ("Governance", "Health")}, "audiences": {d: ["citizens", "traders"] for d in ("Governance", "Health")}, "verbs": {d: ["register early", "report cases"] for d in ("Governance", "Health")},
        "actions": ["urges {audience} to {verb_phrase}", "walks by"], "deadlines": ["before {day} {month}", "soon"], "closers": ["Thank you.", "Stay safe."], "months": ["May", "June"], "locations": ["Nairobi", "Kisumu"],
        "templates": ["{org} {action} {deadline} in {location} at the centre. {closer}", "Short."],
    }
    real = spark.createDataFrame([("p", "Health", "A real text", "", "", "", "", "{}", 0)], ", ".join(f"`{c}` string" for c in S.CORPUS.names) + ", ord long")
    ideal = {"Governance": 0.5, "Health": 0.5}
    out = jobs.synthesise(spark, slots, real, target=21, ideal=ideal, attempts=3000)
    added, attempts = out["added"].count(), out["attempts"].first()["attempts"]
    rejected = {r["key"]: r["n"] for r in out["rejected"].collect()}
    assert added == 20 and attempts == added + sum(rejected.values()) < 3000 and "not_psa" in rejected
    assert attempts == out["added"].agg(F.max("ord")).first()[0] + 1
    assert {r["key"]: r["n"] for r in out["by_origin"].collect()} == {"real": 1, "synthetic": 20}
    more = jobs.synthesise(spark, slots, real, target=5000, ideal=ideal, attempts=400)
    assert more["attempts"].first()["attempts"] == 400 and sum(r["n"] for r in more["rejected"].collect()) + more["added"].count() == 400
    assert {r["key"] for r in more["rejected"].collect()} >= {"duplicate", "not_psa"}


def test_spread_rows(spark, sf, tmp_path):
    small = tables.read_table(spark, sf, "nation", spread=True)
    assert small.rdd.getNumPartitions() == 1
    big = spark.range(400_000).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    big.coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    big.repartition(8).write.parquet(str(tmp_path / "many.parquet"))
    assert tables.read_table(spark, str(tmp_path), "one", spread=True).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = tables.read_table(spark, str(tmp_path), "many", spread=True)
    assert "Exchange" not in many._jdf.queryExecution().toString() and many.count() == 400_000


def test_numbers_whatever_the_columns(spark):
    from quern.operators.ranking import dense_number

    df = spark.createDataFrame([(3, "x", 7, 1), (None, "y", 8, 2), (1, "z", 9, 3)], "ord int, part_ string, number_ int, o0_ int")
    got = sorted(map(tuple, dense_number(df, "n", "ord").collect()), key=lambda r: r[-1])
    assert got == [(None, "y", 8, 2, 1), (1, "z", 9, 3, 2), (3, "x", 7, 1, 3)]


def test_literals_of_patterns():
    import re._parser

    from quern.functions import rules as R

    for p in [*L.POSITIVE_CUES, *L.NEGATIVE_CUES, L.ACTION, L.PRESS, L.OTHER, L.FORCE, L.GENRE]:
        assert R._literals(re._parser.parse(p))
    assert R._literals(re._parser.parse(r"\d+|a")) is None and R._literals(re._parser.parse(r"(ab)?c+(de|f)")) in (["c"], ["de", "f"])


def test_unknown_sources(spark):
    from quern.operators.lookups import with_source

    sources = spark.createDataFrame([(1, "x")], "id int, name string")
    assert [tuple(r) for r in with_source(spark.createDataFrame([(7, 1)], "a int, s int"), sources, "s", "id").select("a", "name").collect()] == [(7, "x")]
    for bad in (2, None):
        with pytest.raises(Exception, match="unknown source"):
            with_source(spark.createDataFrame([(7, 1), (8, bad)], "a int, s int"), sources, "s", "id").select("a").collect()


def test_expand(spark):
    """JOB-17: what each step of the whole run hands to the next, and the gap that is left."""
    texts = [t for _, t, _, _ in boundary.texts.NOTICES if t] * 2
    rows = [(f"s{i % 2}", f"https://x/{i % len(texts[: len(texts) // 2])}", "", None, t, None, i, "health", "en", "o", 80, "generic_html") for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "source_id string, source_url string, title string, raw_html string, raw_text string, published_at timestamp, ord long, domain string, language_default string, organization string, trust_score int, adapter string")
    sheet = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in S.CORPUS.names) + ", ord long")
    stored = spark.createDataFrame([], "psa_id string, content_hash string, source_url string")
    out = jobs.expand(items, stored, sheet, sheet, target=50)
    n = {k: out[k].count() for k in ("notices", "export_added", "export_quarantined", "audit", "strict", "candidates", "sentences")}
    active = out["notices"].where("status = 'active'").count()
    assert 0 < n["notices"] <= len(texts) // 2 and 0 < n["export_added"] and n["export_added"] + n["export_quarantined"] <= active
    assert n["audit"] == n["export_added"] >= n["strict"] >= n["candidates"] and out["gap"].first()["gap"] == 50 - n["strict"]
    assert {r["psa_id"] for r in out["sentences"].collect()} <= {r["psa_id"] for r in out["candidates"].collect()}
