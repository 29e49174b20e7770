"""Sheets, records, rule files and work lists: written to the shared folder and read again, and the small functions at the boundary."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import lexicons as L
from quern.functions import text as T
from quern.functions.lexicon_match import infer_domain
from quern.functions.python_hooks import translate
from quern.operators.statistics import count_by
from quern.plans import jobs
from quern.plans.stage_table import shared_folder
from quern.queries import duck as D
from quern.queries import texts
from quern.queries.pages import _el
from quern.queries.pairs import TURNS_SQL, turns
from quern.queries.texts import CORPUS_SQL, corpus, documents
from quern.sources import rulesets, sheets
from quern.sources.tables import read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the columns of a corpus sheet."""
    values = {"PSA_ID": F.col("doc_id"), "Domain": F.col("lang"), "English": F.col("text"), "Source": F.col("source"), "Metadata": F.to_json(F.struct("lang", "n_chars"))}
    return documents(spark, sf_dir).select(*[values.get(c, F.lit(None)).cast("string").alias(c) for c in S.CORPUS.names])


_SHEET = "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, n_chars, ''::VARCHAR AS date FROM documents"


@query("sheet_round_trip", _SHEET)
def sheet_round_trip(spark, sf_dir):
    """SNK-01, SRC-11: a CSV sheet with texts of many lines, quotes and marks, written and read by name; nulls come back empty."""
    path = folder(spark, "sheet")
    sheets.write_sheet(sheet_rows(spark, sf_dir), path, S.CORPUS)
    back = sheets.read_sheet(spark, path, S.CORPUS)
    text = lambda c: F.coalesce(c, F.lit(""))
    return back.select(F.col("PSA_ID").cast("long").alias("doc_id"), F.sha2(text("English").cast("binary"), 256).alias("text_sha256"), F.get_json_object("Metadata", "$.n_chars").cast("long").alias("n_chars"), text("Date").alias("date"))


@query("json_round_trip", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, n_chars, source FROM documents")
def json_round_trip(spark, sf_dir):
    """SNK-02, 05: JSON lines written and read again."""
    path = folder(spark, "json")
    sheets.write_json(documents(spark, sf_dir).select("doc_id", "text", "source", "n_chars"), path)
    back = spark.read.schema("doc_id long, text string, source string, n_chars long").json(path)
    return back.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "n_chars", "source")


@query("appended_log", "SELECT event_type AS source_id, 2 * count(*) AS items FROM events GROUP BY 1")
def appended_log(spark, sf_dir):
    """SNK-04: rows added to a log twice."""
    path, rows = folder(spark, "log"), read_table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), "event_id")
    for _ in range(2):
        sheets.append_log(rows, path)
    return spark.read.parquet(path).groupBy("source_id").agg(F.count(F.lit(1)).alias("items"))


@query("frozen_table", "SELECT n_nationkey, n_name FROM nation")
def frozen_table(spark, sf_dir):
    """SNK-08: a version that is written once."""
    return sheets.freeze(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), folder(spark, "frozen"))


@query("first_path", "SELECT r_regionkey, r_name FROM region")
def first_path(spark, sf_dir):
    """SRC-18: the first of several paths that exists."""
    return spark.read.parquet(sheets.fallback(spark, f"{sf_dir}/no-such-table.parquet", f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet")).select("r_regionkey", "r_name")


@query("manual_items", f"SELECT CASE WHEN page_id % 2 = 0 THEN 'generic_html' ELSE 'manual_upload' END AS adapter, count(*) AS pages, count(*) FILTER (WHERE page_id % 2 = 0 AND {D.wc('a')} >= 10) AS items FROM (SELECT page_id, {_el('article')} AS a FROM pages) GROUP BY 1")
def manual_items(spark, sf_dir):
    """SRC-07, 08: items of pages by the readers of two names; the one of manual uploads has none, whatever lies there."""
    p = read_table(spark, sf_dir, "pages", spread=True).select("page_id", F.col("page_id").cast("string").alias("url"), "html", F.when(F.col("page_id") % 2 == 0, "generic_html").otherwise("manual_upload").alias("adapter"))
    found = sheets.adapter("generic_html")(p.where("adapter = 'generic_html'"), "generic_html").unionByName(sheets.adapter("manual_upload")(spark), allowMissingColumns=True)
    items = found.groupBy(F.col("source_id").alias("adapter")).agg(F.count(F.lit(1)).alias("items"))
    return p.groupBy("adapter").agg(F.count(F.lit(1)).alias("pages")).join(items, "adapter", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored notices."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("psa_id"), F.col("lang").alias("domain"), T.title_hint("text").alias("title"), "text", F.col("lang").alias("language"), F.concat(F.lit("https://x/"), "doc_id").alias("source_url"),
        F.lit(None).cast("timestamp").alias("published_at"), F.lit("medium").alias("urgency"), F.lit("x").alias("organization"), F.lit("{}").alias("metadata"), F.col("source").alias("source_id"),
        F.when(F.col("n_chars") < 500, "active").otherwise("quarantined").alias("status"), T.word_count("text").alias("token_count"), T.content_hash("text").alias("content_hash"),
    )


@query("export_rows", f"SELECT doc_id, {D.title_hint('text')} AS title FROM documents WHERE n_chars < 500")
def export_rows(spark, sf_dir):
    """SNK-07: the active rows as other tools take them."""
    return sheets.export_view(notices(spark, sf_dir)).select(F.col("psa_id").cast("long").alias("doc_id"), "title")


@query("stored_by_domain", "SELECT lang AS key, count(*) AS n FROM documents WHERE n_chars < 500 GROUP BY 1")
def stored_by_domain(spark, sf_dir):
    """JOB-03: active rows by domain."""
    return jobs.store_stats(notices(spark, sf_dir))["by_domain"]


@query("stored_notices", f"SELECT source AS source_id, count(*) AS n, sum({D.wc('text')})::BIGINT AS tokens, count(DISTINCT sha256({D.collapse('lower(text)')})) AS texts, 0::BIGINT AS placed FROM documents GROUP BY 1")
def stored_notices(spark, sf_dir):
    """SNK-06, SRC-10: notices added to the stored table in the record's columns, and read from it."""
    path = folder(spark, "notices")
    jobs.append_notices(notices(spark, sf_dir), path)
    back = spark.read.schema(S.NOTICE).parquet(path)
    return back.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"), F.countDistinct("content_hash").alias("texts"), F.count("location").alias("placed"))


@query("deleted_source", "SELECT source AS key, count(*) AS n FROM documents WHERE source <> (SELECT min(source) FROM documents) GROUP BY 1 UNION ALL SELECT 'deleted', count(*) FROM documents WHERE source = (SELECT min(source) FROM documents)")
def deleted_source(spark, sf_dir):
    """JOB-21: what is left without a source, and how many rows went."""
    rows = notices(spark, sf_dir)
    kept, deleted = jobs.without_source(rows, rows.agg(F.min("source_id")).first()[0])
    return count_by(kept, "source_id").union(deleted.select(F.lit("deleted"), "deleted"))


def _read(spark: SparkSession, sf_dir: str):
    """Items of a source, which is a language here; two of the sources can't be read."""
    docs = documents(spark, sf_dir)

    def read(source) -> DataFrame:
        if source["source_id"] == "xx":
            raise OSError("no route to host")
        rows = docs.where(F.col("lang") == source["source_id"])
        rows = rows.unionByName(rows.where("doc_id % 3 = 0"))
        return rows.select(
            F.lit(source["source_id"]).alias("source_id"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("https://x/"), "doc_id")).alias("source_url"), F.lit("").alias("title"), F.lit(None).cast("string").alias("raw_html"),
            F.col("no_such_column" if source["source_id"] == "yy" else "text").alias("raw_text"), F.lit(None).cast("timestamp").alias("published_at"),
        )

    return read


@query("source_runs", "SELECT lang AS source_id, 'success' AS status, count(*) + count(*) FILTER (WHERE doc_id % 3 = 0) AS items_found, true AS consistent FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('xx', 'failed', 0::BIGINT, true), ('yy', 'failed', 0::BIGINT, true)) v")
def source_runs(spark, sf_dir):
    """JOB-02: the log of a run over four sources, of which two fail by themselves; some items are repeats, some have no address."""
    registry = spark.createDataFrame([("en",), ("xx",), ("fr",), ("yy",), ("de",)], "source_id string").withColumn("domains_covered", F.array(F.lit("health"))).withColumn("organization", F.lit("x"))
    work = rulesets.work_list(registry, ["en", "xx", "fr", "yy"]).orderBy("place")
    stored = spark.createDataFrame([], "psa_id string, content_hash string, source_url string")
    log = jobs.ingest_sources(work, _read(spark, sf_dir), stored)["log"]
    consistent = (F.col("items_found") == F.col("items_stored") + F.col("items_rejected")) & ((F.col("status") == "failed") == F.col("error").isNotNull())
    return log.select("source_id", "status", F.col("items_found").cast("long").alias("items_found"), consistent.alias("consistent"))


@query("work_list", "SELECT s_suppkey::VARCHAR AS source_id, 80 AS trust_score FROM supplier WHERE s_acctbal > 0")
def work_list(spark, sf_dir):
    """SRC-09, 20: the active sources of a registry with their defaults."""
    registry = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), (F.col("s_acctbal") > 0).alias("active"))
    return rulesets.work_list(registry).select("source_id", "trust_score")


@query("rules_from_file", texts.ORACLE_SQL["infer_domain"])
def rules_from_file(spark, sf_dir):
    """SRC-17: domains by a rule file, which holds the default lexicon."""
    config: dict = {"domains": {}}
    for d, s, kws in L.DOMAINS:
        config["domains"].setdefault(d, {"sub_categories": {}})["sub_categories"][s] = {"keywords": kws}
    path = folder(spark, "rules")
    spark.createDataFrame([(json.dumps(config, indent=1),)], "value string").coalesce(1).write.text(path)
    rules = rulesets.domain_rules(rulesets.load_rules(spark, f"{path}/part-*"))
    df = corpus(spark, sf_dir).withColumn("d", infer_domain("text", domains=rules))
    return df.select("id", "d.domain", "d.sub_category")


_TITLE = D.title_hint("text")


@query("joined_titles", f"SELECT id, CASE WHEN t <> '' AND b <> '' THEN trim(t || '. ' || b, '. ') WHEN b <> '' THEN b ELSE t END AS joined FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE {_TITLE} END AS t, CASE WHEN id % 5 = 0 THEN '' ELSE lang END AS b FROM {CORPUS_SQL})")
def joined_titles(spark, sf_dir):
    """SRC-13."""
    title, body = F.when(F.col("id") % 3 == 0, "").otherwise(T.title_hint("text")), F.when(F.col("id") % 5 == 0, "").otherwise(F.col("lang"))
    return corpus(spark, sf_dir).select("id", T.join_title(title, body).alias("joined"))


_EXPORTED = "CASE doc_id % 5 WHEN 0 THEN 'public_health' WHEN 1 THEN 'security & safety' WHEN 2 THEN upper(lang) WHEN 3 THEN '' END"


@query("export_domains", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Public Health' WHEN 1 THEN 'Security' WHEN 2 THEN upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) ELSE 'Governance' END AS label FROM (SELECT doc_id, lang, {_EXPORTED} AS domain FROM documents)")
def export_domains(spark, sf_dir):
    """TXT-31: labels of the domains that an export names; a fifth of the documents has an empty one, a fifth none."""
    return documents(spark, sf_dir).select("doc_id", F.expr(_EXPORTED).alias("domain")).select("doc_id", T.export_domain("domain").alias("label"))


_RUNS = f"list_filter(list_transform(string_split(regexp_replace({D.strip('text')}, '([.!?])[{D.WS}]+', '\\1' || chr(30), 'g'), chr(30)), lambda s: {D.strip('s')}), lambda s: {D.wc('s')} >= 5)"


@query("simple_sentences", f"SELECT id, len({_RUNS})::BIGINT AS n, md5(array_to_string({_RUNS}, '|')) AS joined FROM {CORPUS_SQL}")
def simple_sentences(spark, sf_dir):
    """TXT-28."""
    return corpus(spark, sf_dir).withColumn("s", T.simple_sentences("text")).select("id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("joined"))


@query("glossary_tops", f"SELECT key, count(*) AS n FROM (SELECT unnest({texts._GLOSS}) AS key FROM {CORPUS_SQL}) GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def glossary_tops(spark, sf_dir):
    """AGG-09, through the statistics of a cleaned sheet."""
    from quern.functions.lexicon_match import glossary_hits

    rows = corpus(spark, sf_dir).select(
        F.col("id"), F.lower(F.coalesce("text", F.lit(""))).alias("English_norm"), F.array_join(glossary_hits("text"), "|").alias("glossary_hits"), F.lit("true").alias("has_kiswahili"), F.lit("false").alias("code_switch"),
        F.lit("Health").alias("Domain"), F.lit("en").alias("lang_primary"), F.lit(1).alias("token_count"),
    )
    return jobs.corpus_statistics(rows, "id")["top_glossary_hits"]


@query("stub_translation", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'sw' ELSE 'kik' END AS lang, length(text) + 3 + (doc_id % 2) AS chars FROM documents")
def stub_translation(spark, sf_dir):
    """UDF-04 to 06: the model hook with a stub that puts the language in front."""
    load = lambda: lambda xs, lang: [f"{lang} {x}" for x in xs]
    rows = documents(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "sw").otherwise("kik").alias("lang"))
    return translate(rows, "text", "lang", "out", load).select("doc_id", "lang", F.length("out").cast("long").alias("chars"))


_SPLIT = "(SELECT *, CASE WHEN id % 10 < 8 THEN 'train' WHEN id % 10 = 8 THEN 'dev' ELSE 'test' END AS split FROM " + TURNS_SQL + ")"


def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as split pairs."""
    split = F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "dev").otherwise("test")
    return turns(spark, sf_dir).select(F.lit("en").alias("source_lang"), F.col("lang").alias("target_lang"), F.col("t").alias("target_text"), split.alias("split"))


@query("training_rows", f"SELECT count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'dev') AS dev, count(*) FILTER (WHERE split = 'train') >= 50 AND count(*) FILTER (WHERE split = 'dev') >= 5 AS ready FROM {_SPLIT} WHERE lang = 'en' AND NOT starts_with(t, '[DRY_RUN')")
def training_rows(spark, sf_dir):
    """JOB-18, CLS-12."""
    return jobs.training_report(split_pairs(spark, sf_dir), "en", "en")


@query("scale_gate", f"SELECT lang AS target_lang, coalesce(n, 0) AS kept, CASE WHEN coalesce(n, 0) >= 4 THEN 'OK' ELSE 'BELOW_4_SCALE_MORE' END AS verdict FROM (VALUES ('sw'), ('kik'), ('en')) v(lang) LEFT JOIN (SELECT lang, count(*) AS n FROM {TURNS_SQL} GROUP BY 1) t USING (lang)")
def scale_gate(spark, sf_dir):
    """JOB-20: whether enough pairs are kept, with a low bound."""
    return jobs.scale_gate(split_pairs(spark, sf_dir), ("sw", "kik", "en"), 4)
