"""Composite jobs, sheets and streams on small inputs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quern import schemas as S
from quern.operators import lookups
from quern.plans import jobs
from quern.sources import sheets
from quern.streaming.ingest import ingest_stream, log_windows, stream_items
from tests.test_single_passes import _counting

NOTICE = "The commission reminds voters to register and avoid the polling crowd before the deadline, and members of the public to report any case."
ITEM = "source_id string, source_url string, title string, raw_text string, raw_html string, published_at timestamp, scraped_at timestamp, domain string, language_default string, organization string, trust_score int, adapter string, ord long"


def items(spark, *texts):
    return spark.createDataFrame([("s", f"https://x/{i}", "PUBLIC NOTICE", t, None, None, None, "governance", "en", "o", 80, "rss", i) for i, t in enumerate(texts)], ITEM).withColumn("scraped_at", F.lit("2026-01-01").cast("timestamp"))


def test_ingest(spark):
    stored = spark.createDataFrame([("psa_2025_000041", "h", "https://x/2")], "psa_id string, content_hash string, source_url string")
    out = jobs.ingest(items(spark, NOTICE, NOTICE.upper(), "known address " + NOTICE, "", "short text here"), stored)
    got = {r["source_url"]: (r["psa_id"], r["status"]) for r in out["notices"].collect()}
    assert got == {"https://x/0": ("psa_2026_000042", "active"), "https://x/4": ("psa_2026_000043", "quarantined")}
    assert tuple(out["log"].first()) == ("s", 5, 1, 4)
    told = {r["source_url"][-1]: r["outcome"] for r in jobs.diagnose(items(spark, NOTICE, "tiny", "x"), stored).collect()}
    assert told["0"] == "WOULD_STORE" and told["1"].startswith("reject:too_short") and told["2"] == "duplicate"
    again = jobs.promote(out["notices"].withColumn("status", F.lit("quarantined")).withColumn("is_psa", F.lit(False)))
    assert again.where("status = 'active' and is_psa").count() == 1
    assert jobs.store_stats(out["notices"])["total"].first()["n"] == 1


def sheet(spark, rows):
    return spark.createDataFrame([(f"i{k}", "Health", t, "", "", "", "", m, k) for k, (t, m) in enumerate(rows)], "PSA_ID string, Domain string, English string, Kiswahili string, `Target Languages` string, Source string, Date string, Metadata string, ord long")


def test_merge_refilter_recover_audit(spark):
    s = sheet(spark, [(NOTICE, '{"lang_detected": "en"}'), (NOTICE.lower(), "x"), ("word " * 30, "{}"), ("word " * 400, "{}")])
    out = jobs.merge([s])
    assert [r["PSA_ID"] for r in out["clean"].collect()] == ["psa_2026_000001"]
    assert {r["Quarantine_Reason"] for r in out["quarantine"].collect()} == {"low_psa_score:0.15", "too_long_for_psa"}
    assert json.loads(out["clean"].first()["Metadata"])["original_psa_id"] == "i0"
    assert tuple(out["totals"].first()) == (4, 3)
    long = sheet(spark, [(NOTICE + "\n\n" + "word " * 400, "{}")]).withColumn("Quarantine_Reason", F.lit("too_long_for_psa"))
    back = jobs.recover_cores(s.limit(0), long)
    assert back["recovered"].count() == 1 and back["quarantine"].count() == 0
    assert jobs.recover_cores(sheet(spark, [(back["recovered"].first()["English"], "{}")]), long)["quarantine"].count() == 1
    again = jobs.refilter(s, long)
    assert again["clean"].count() + again["quarantine"].count() == 4
    audit = jobs.audit(s)
    assert audit["stats"].first()["total"] == 4 and audit["audit"].columns == S.AUDIT.names
    assert audit["strict"].count() + audit["quarantine"].count() == 4


def test_export(spark):
    export = spark.createDataFrame([("security & safety", "Alert", NOTICE, "en", "u", "", "o", 0), ("x", "", NOTICE, "en", "u", "", "o", 1), ("x", "", "", "en", "u", "", "o", 2), ("x", "t", "word " * 30, None, "u", "", "o", 3)], "domain string, title string, text string, language string, source_url string, published_at string, organization string, ord long")
    none = sheet(spark, [("", "")]).limit(0)
    out = jobs.ingest_export(export, none, none)
    assert [r["Domain"] for r in out["added"].orderBy("ord").collect()] == ["Security", "X"]
    assert [r["Quarantine_Reason"] for r in out["quarantined"].collect()] == ["low_psa_score:0.15"]


def test_process(spark):
    s = sheet(spark, [(f"Notice{i} for the IEBC, Mpesa and you" if i else "  ", "Language: en") for i in range(31)])
    out = jobs.process_and_split(s, 5)
    assert out["cleaned"].count() == 30 and out["cleaned"].columns == S.CLEANED.names and out["validation"].columns == S.VALIDATION.names
    r = out["cleaned"].where("PSA_ID = 'i7'").first()
    assert r["English_norm"] == "Notice 7 for the IEBC, M-PESA and you" and r["glossary_hits"] == "IEBC|M-PESA"
    assert out["validation"].count() == 6 or out["validation"].count() == 5
    assert {r["split"]: r["n"] for r in out["cleaned"].groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {"train": 24, "dev": 3, "test": 3}
    assert jobs.review_validation(out["validation"]).where("verified = ''").count() == out["validation"].count()


def test_parallel_jobs(spark):
    c = jobs.seed_candidates(sheet(spark, [(NOTICE + " " + NOTICE, "{}"), ("short", "{}")]))
    sents = jobs.sentence_sheet(c).withColumn("ord", F.monotonically_increasing_id())
    assert c.columns == S.SEED_CANDIDATES.names and [r["sentence_id"] for r in sents.collect()] == ["i0_s01", "i0_s02"]
    seeds = jobs.dry_run_seeds(sents)
    assert [r["pair_id"] for r in seeds.orderBy("pair_id").collect()] == [f"seed_00000{k}" for k in range(1, 5)]
    silver = seeds.withColumn("target_text", F.concat(F.lit("tafsiri "), "target_lang")).withColumn("ord", F.monotonically_increasing_id())
    human = jobs.human_evaluation(sents, sheet(spark, [(NOTICE, '{"synthetic": "false"}')]), silver, 2)
    assert human.columns == S.HUMAN_EVAL.names
    assert {(r["mt_suggestion_sw"], r["synthetic_source"]) for r in human.collect()} == {("tafsiri sw", "false")}
    bitext = spark.createDataFrame([(i, f"please report the water case number {i} to them", f"tafadhali toa habari ya maji namba {i} kwao") for i in range(1, 9)], "line int, en string, sw string")
    got = jobs.harvest(bitext, 2, 8)
    assert [r["pair_id"] for r in got.orderBy("pair_id").collect()] == ["opus_en_sw_000001", "opus_en_sw_000002"] and got.columns == S.EXTERNAL_PAIRS.names
    assert jobs.checked_pairs(got.withColumn("ord", F.lit(1))).count() == 0  # external pairs aren't training data
    assert jobs.checked_pairs(got.withColumn("ord", F.lit(1)), psa_only=False).count() == 2
    assert jobs.training_report(silver.withColumn("split", F.lit("train")), "en", "sw").first()["ready"] is False
    assert jobs.evaluate(bitext, "sw", "sw").first()["bleu"] > 99


SLOTS = {
    "orgs": {d: ["IEBC", "KNEC"] for d in ("Governance", "Health", "Security", "Education", "Agriculture")}, "audiences": {d: ["all citizens"] for d in ("Governance", "Health", "Security", "Education", "Agriculture")},
    "verbs": {d: [f"verify step {k} in {d} today" for k in range(40)] for d in ("Governance", "Health", "Security", "Education", "Agriculture")}, "actions": ["urges {audience} to {verb_phrase}"],
    "deadlines": ["Deadline: {day} {month} 2026."], "closers": ["Follow official channels only."], "months": ["May"], "locations": ["Nairobi"], "templates": ["PUBLIC NOTICE. {org} {action}. {deadline} {closer}"],
}


def test_synthesis(spark):
    real = sheet(spark, [(NOTICE, "{}")])
    out = jobs.synthesise(spark, SLOTS, real, 21, attempts=300)
    assert out["merged"].count() == 21 and out["merged"].select("English").distinct().count() == 21
    assert out["added"].where("English like '%{%'").count() == 0
    assert sorted(r["English"] for r in out["added"].collect()) == sorted(r["English"] for r in jobs.synthesise(spark, SLOTS, real, 21, attempts=300)["added"].collect())


def test_sheets(spark, tmp_path):
    s = sheet(spark, [('He said "go",\nthen left ' + "word " * 8, "Language: en"), ("few", "")])
    sheets.write_sheet(s, str(tmp_path / "a"), S.CORPUS)
    back = sheets.read_sheet(spark, str(tmp_path / "a"), S.CORPUS)
    assert sorted(r["English"] for r in back.collect()) == sorted(r["English"] for r in s.collect())
    assert sheets.read_sheet(spark, str(tmp_path / "none"), S.CORPUS).count() == 0
    media = sheets.load_media(sheets.read_sheet(spark, str(tmp_path / "a"), S.MEDIA), "c", "f.csv")
    assert media.count() == 1 and json.loads(media.first()["Metadata"])["source_metadata_raw"] == "Language: en"
    export = spark.createDataFrame([("", None, "T", "b " * 9, "en", "u", None, None, None, '{"k": 1}', 0)], "psa_id string, domain string, title string, text string, language string, source_url string, published_at string, urgency string, organization string, metadata string, ord long")
    r = sheets.load_export(export, "c", "f").first()
    meta = json.loads(r["Metadata"])
    assert r["PSA_ID"] == "GOV_00001" and r["Domain"] == "Governance" and meta["src_k"] == "1" and meta["token_count"] == 10 and meta["organization"] is None
    agri = spark.createDataFrame([("p", None, "w " * 9, None, None, None, "o", "{bad", "{'Luo': 'x'}", 0)], "PSA_ID string, Domain string, English string, Kiswahili string, Source string, Date string, Org string, Metadata string, Target_Languages string, ord long")
    assert json.loads(sheets.load_agriculture(agri, "c", "f").first()["Target Languages"]) == ["Luo", "Kikuyu"]
    raw = spark.createDataFrame([("", "r " * 9, "u", 4)], "cleaned_text string, raw_text string, source_url string, ord long")
    assert sheets.load_raw_text(raw, "c", "f", "RAW").first()["PSA_ID"] == "RAW_00005"
    edu = spark.createDataFrame([("e", None, "w " * 9, "", "", "", "", "", "", "", "", "", 0)], S.strings(*S.EDUCATION.names).add("ord", "long"))
    assert sheets.load_education(edu, "c", "f").first()["Domain"] == "Education"
    assert sheets.merge_stats is not None and spark.range(1).select(sheets.merge_stats(F.lit('{"a": 1}'), F.lit('{"b": 2}')).alias("x")).first()["x"] == '{"a":1,"b":2}'


def test_feed_bitext_and_registry(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>u</link><description>&lt;p&gt;one two three four five six seven eight nine ten&lt;/p&gt;</description><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate></item><item><title>x</title><description>few</description></item></channel></rss>")
    item = sheets.read_feed(spark, str(tmp_path / "f.xml"), "s").first()
    assert item["title"] == "T" and item["published_at"].year == 2026 and item["raw_text"].startswith("one two")
    (tmp_path / "a.en").write_text("one\n\nthree\nfour\n")
    (tmp_path / "a.sw").write_text("moja\nmbili\n tatu \n")
    assert sorted(tuple(r) for r in sheets.read_bitext(spark, str(tmp_path / "a.en"), str(tmp_path / "a.sw")).collect()) == [(1, "one", "moja"), (3, "three", "tatu")]
    both = spark.createDataFrame([("a\n\nc\nd", "x\ny\nz")], "l string, r string")
    assert [tuple(r) for r in sheets.bitext_lines(both, "l", "r").collect()] == [(1, "a", "x"), (3, "c", "z")]
    src = sheets.source_defaults(spark.createDataFrame([("s", None)], "source_id string, country string")).first()
    assert (src["country"], src["trust_score"], src["adapter"]) == ("Kenya", 80, "generic_html")
    assert sheets.no_items(spark).count() == 0 and sheets.listing_urls({"listing_url": "u?x", "max_listing_pages": 2}) == ["u?x", "u?x&page=1"]
    try:
        sheets.adapter("none")
        raise AssertionError
    except ValueError:
        pass


def test_curated_and_frozen(spark, tmp_path):
    feed = spark.createDataFrame([("<b>One two three four five six.</b> Few words here. Serikali na watu wa Kenya wapo leo hapa.", 0)], "text string, ord int")
    known = spark.createDataFrame([("One two three four five six.", "Health", "en", 0)], "text string, domain string, lang string, ord int")
    got = jobs.curated_sentences(feed, known)
    assert sorted(tuple(r) for r in got.collect()) == [("One two three four five six.", "Health", "en"), ("Serikali na watu wa Kenya wapo leo hapa.", "Governance", "sw")]
    assert sheets.freeze(got, str(tmp_path / "v1")).count() == 2
    try:
        sheets.freeze(got, str(tmp_path / "v1"))
        raise RuntimeError
    except RuntimeError:
        raise
    except Exception as e:
        assert "already exists" in str(e).lower()


def test_streams(spark, tmp_path):
    batch = items(spark, NOTICE, NOTICE.upper(), "another text that is new").drop("ord")
    batch.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run over the same files adds nothing
        q = ingest_stream(stream_items(spark, str(tmp_path / "in"), batch.schema), str(tmp_path / "store"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    events = spark.createDataFrame([("2026-01-01 00:10:00", "a", 1.0), ("2026-01-01 00:50:00", "a", 2.0), ("2026-01-01 01:10:00", "a", 4.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    assert [(r["n"], r["total"]) for r in log_windows(events).orderBy("start").collect()] == [(2, 3.0), (1, 4.0)]


def test_export_job_judges_every_text(spark, sf):
    from quern.queries.corpus import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {" ".join(r["text"].lower().split()) for r in docs.select("text").collect()}
    assert sum(r["n"] for r in QUERIES["export_job"](spark, sf).collect()) == len(texts - {""})


def test_export_writes_and_shuffles_each_text_once(spark, monkeypatch):
    """a text is written once, rows are chosen without it; a sheet's text is read once for its digest."""
    steps, own, digest = {}, jobs.stage_table, lookups.content_hash
    same, calls = _counting(spark)
    monkeypatch.setattr(jobs, "stage_table", lambda df, label: steps.setdefault(label, own(df, label)))
    monkeypatch.setattr(lookups, "content_hash", lambda c: same(digest(c)))
    texts = ["", "  ", "Seen  before", "a new text", "A new  text", NOTICE, NOTICE.upper(), "title. a new text"]
    export = spark.createDataFrame([("x", "title" if t == "a new text" else "", t, "en", "u", "", "o", k) for k, t in enumerate(texts)], "domain string, title string, text string, language string, source_url string, published_at string, organization string, ord long")
    out = jobs.ingest_export(export, sheet(spark, [("seen before", "{}"), ("", "{}")]), sheet(spark, [("", "{}")]))
    found = {k: {(r["ord"], r["English"]) for r in df.collect()} for k, df in out.items()}
    assert found == {"added": {(5, NOTICE)}, "quarantined": {(3, "title. a new text"), (4, "A new  text")}}
    long = {k: [c for c in df.columns if any(len(str(r[c])) > 64 for r in df.collect())] for k, df in steps.items()}
    assert long == {"judged": ["full_"], "seen": [], "decided": []}
    assert calls.value == 3
