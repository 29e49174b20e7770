"""Jobs and readers of whole results: harvests, sheets for reviewers, contributors' sheets, curated sentences, merged documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import lexicons as L
from quern.functions import text as T
from quern.plans import jobs
from quern.queries import duck as D
from quern.queries import texts as X
from quern.queries.boundary import _RUNS
from quern.queries.pairs import TURNS_SQL, _check_sql, turns
from quern.queries.texts import documents
from quern.sources import sheets
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


def sha(c) -> F.Column:
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


_OWN_LANG = f"(SELECT line AS id, s, t, CASE WHEN words < 1 THEN 'unknown' WHEN best.n > 0 THEN best.code END AS lang FROM (SELECT *, {X._GUESS} AS best FROM (SELECT row_number() OVER (ORDER BY id) AS line, s, t, {D.wc('substr(t, 1, 2000)')} AS words, regexp_extract_all(lower(substr(t, 1, 2000)), '[\\pL]+') AS own FROM {TURNS_SQL})))"


@query(
    "harvest_job",
    f"""WITH checked AS MATERIALIZED (SELECT c.id AS line, len(reasons) = 0 AS ok, round_even(greatest(0::DOUBLE, least(1::DOUBLE, cf)), 3) AS confidence, r.s AS source FROM {_check_sql(_OWN_LANG)} c JOIN (SELECT row_number() OVER (ORDER BY id) AS line, s FROM {TURNS_SQL}) r ON r.line = c.id),
      scored AS (SELECT line, ok, confidence, source, len(list_intersect({X._SPACED}, [{', '.join(map(D.q, L.NOTICE_WORDS))}])) AS score FROM (SELECT *, source AS text FROM checked)),
      kept AS (SELECT *, count(*) OVER (ORDER BY line) AS kept FROM (SELECT *, count(*) OVER (ORDER BY line) AS passed FROM scored WHERE ok AND line <= 50000) WHERE passed <= 1501 OR score > 0 OR line >= 50000),
      best AS (SELECT * FROM kept WHERE kept <= 6000 ORDER BY score DESC, line LIMIT 3000)
      SELECT printf('opus_en_sw_%06d', row_number() OVER (ORDER BY score DESC, line)) AS pair_id, sha256(source) AS source_sha256, confidence, score::VARCHAR AS psaish_score FROM best""",
)
def harvest_job(spark, sf_dir):
    """JOB-16: turns as an external bitext: checked, filtered by prefix, the most notice-like first, numbered."""
    from quern.operators.ranking import dense_number

    bitext = dense_number(turns(spark, sf_dir), "line", "id").select("line", F.col("s").alias("en"), F.col("t").alias("sw"))
    rows = jobs.harvest(bitext)
    return rows.select("pair_id", sha(F.col("source_text")).alias("source_sha256"), "confidence", F.get_json_object("Metadata", "$.psaish_score").alias("psaish_score"))


_TEXT = D.collapse("text")


@query(
    "human_eval_sheet",
    f"""WITH d AS (SELECT doc_id, source || '-' || (doc_id % 40) AS psa, {_TEXT} AS t, lang FROM documents WHERE source IS NOT NULL),
      flags AS (SELECT psa, arg_max(doc_id % 2 = 0, doc_id) AS synthetic FROM d WHERE doc_id % 3 = 0 GROUP BY 1),
      r AS (SELECT d.*, synthetic, coalesce(synthetic, true)::INT AS r, {D.wc('t')} AS n FROM d LEFT JOIN flags USING (psa) WHERE {D.wc('t')} >= 8),
      picked AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY psa ORDER BY r, -n, doc_id) > 1)::INT AS later FROM r) ORDER BY later, r, -n, doc_id LIMIT 100),
      sw AS (SELECT psa, arg_max('T' || doc_id, doc_id) AS sw FROM d WHERE doc_id % 8 = 0 GROUP BY 1), kik AS (SELECT psa, arg_max('T' || doc_id, doc_id) AS kik FROM d WHERE doc_id % 8 = 4 GROUP BY 1)
      SELECT printf('heval_%04d', row_number() OVER (ORDER BY md5('42|' || doc_id))) AS eval_id, psa AS psa_id, lang AS domain, sha256(t) AS source_sha256, coalesce(synthetic::VARCHAR, '') AS synthetic_source,
        coalesce(sw, '') AS mt_suggestion_sw, coalesce(kik, '') AS mt_suggestion_kik FROM picked LEFT JOIN sw USING (psa) LEFT JOIN kik USING (psa)""",
)
def human_eval_sheet(spark, sf_dir):
    """JOB-15: the reviewers' sheet: one sentence of each notice before any second, real ones first, the last translations beside."""
    psa = F.concat("source", F.lit("-"), F.col("doc_id") % 40)
    docs = documents(spark, sf_dir).where("source is not null").select("doc_id", psa.alias("psa_id"), T.collapse("text").alias("source_text"), F.col("lang").alias("Domain"), F.col("doc_id").alias("ord"))
    sheet = docs.where("doc_id % 3 = 0").select(F.col("psa_id").alias("PSA_ID"), F.to_json(F.struct((F.col("doc_id") % 2 == 0).cast("string").alias("synthetic"))).alias("Metadata"), "ord")
    silver = docs.where("doc_id % 4 = 0").select("psa_id", F.when(F.col("doc_id") % 8 == 0, "sw").otherwise("kik").alias("target_lang"), F.concat(F.lit("T"), "doc_id").alias("target_text"), "ord")
    out = jobs.human_evaluation(docs, sheet, silver)
    return out.select("eval_id", "psa_id", F.col("Domain").alias("domain"), sha(F.col("source_text")).alias("source_sha256"), "synthetic_source", "mt_suggestion_sw", "mt_suggestion_kik")


_LONG = f"{D.wc(X._CLEAN)} >= 8"
_LABEL = "CASE WHEN lang IS NULL OR lang = '' THEN {} ELSE upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) END"


@query(
    "contributor_sheets",
    f"""SELECT 'm' AS contributor, doc_id::VARCHAR AS psa_id, {_LABEL.format(D.q('Governance'))} AS domain, sha256({X._CLEAN}) AS english_sha256, 'media_archives' AS source_schema FROM documents WHERE {_LONG}
      UNION ALL SELECT 'e', doc_id::VARCHAR, {_LABEL.format(D.q('Education'))}, sha256({X._CLEAN}), 'psa_dataset_final' FROM documents WHERE {_LONG}
      UNION ALL SELECT 'r', printf('RAW_%05d', doc_id + 1), 'Governance', sha256({X._CLEAN}), 'psa_dataset_raw_text' FROM documents WHERE {_LONG}
      UNION ALL SELECT 'a', doc_id::VARCHAR, {_LABEL.format(D.q('Agriculture'))}, sha256({X._CLEAN}), 'agriculture_psa_export' FROM documents WHERE {_LONG}""",
)
def contributor_sheets(spark, sf_dir):
    """SRC-12b to e: documents as four contributors' sheets, brought to the canonical columns."""
    none = F.lit("").cast("string")
    docs = documents(spark, sf_dir).withColumn("ord", F.col("doc_id"))
    base = {"PSA_ID": F.col("doc_id").cast("string"), "Domain": F.col("lang"), "English": F.col("text"), "Kiswahili": none, "Source": F.col("source"), "Date": none, "Metadata": F.to_json(F.struct("n_chars")), "Org": none, "Target_Languages": F.lit("{'Luo': 1}")}
    wide = docs.select("ord", *[c.alias(k) for k, c in base.items()], *[none.alias(k) for k in ("Sub_Category", "Urgency", "Audience", "psa_score", "lang_detected")])
    raw = docs.select("ord", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("cleaned_text"), F.col("text").alias("raw_text"), F.col("source").alias("source_url"))
    parts = [sheets.load_media(wide, "m", "f"), sheets.load_education(wide, "e", "f"), sheets.load_raw_text(raw, "r", "f", "RAW"), sheets.load_agriculture(wide, "a", "f")]
    whole = reduce(DataFrame.unionByName, [p.select("PSA_ID", "Domain", "English", "Metadata") for p in parts])
    meta = lambda k: F.get_json_object("Metadata", f"$.{k}").alias(k)
    return whole.select(meta("contributor"), F.col("PSA_ID").alias("psa_id"), F.col("Domain").alias("domain"), sha(F.col("English")).alias("english_sha256"), meta("source_schema"))


_SENTENCES = _RUNS.replace("coalesce(text, '')", "regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g')")
_BY_WORD = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), {D.q(w)})" for w in k) + f" THEN {D.q(n)}" for n, k in L.BILINGUAL_DOMAINS) + " ELSE 'Governance' END"


@query(
    "curated_rows",
    f"""WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS text, unnest(range(len({_SENTENCES}))) AS pos FROM documents),
      n AS (SELECT text, {_BY_WORD} AS domain, CASE WHEN len(list_intersect({X._OWN}, [{', '.join(map(D.q, L.SWAHILI_MARKERS))}])) >= 2 THEN 'sw' ELSE 'en' END AS lang, 1 AS src, doc_id AS ord, pos FROM s WHERE {D.wc('text')} BETWEEN 6 AND 45),
      whole AS (SELECT * FROM n UNION ALL SELECT text, 'Curated', 'en', 0, item_id, 0 FROM benchmark)
      SELECT sha256(text) AS text_sha256, domain, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY src, ord, pos) AS r FROM whole) WHERE r = 1""",
)
def curated_rows(spark, sf_dir):
    """SRC-19: sentences of documents after curated rows, the first of equal texts."""
    docs = documents(spark, sf_dir).select("text", F.col("doc_id").alias("ord"))
    curated = read_table(spark, sf_dir, "benchmark").select("text", F.lit("Curated").alias("domain"), F.lit("en").alias("lang"), F.col("item_id").alias("ord"))
    return jobs.curated_sentences(docs, curated).select(sha(F.col("text")).alias("text_sha256"), "domain", "lang")


@query("merged_stats", "SELECT event_id, json_extract_string(props, '$.page') AS page, '2.5' AS k, '7' AS nested, len(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'stage'))) + 2 AS keys FROM events")
def merged_stats(spark, sf_dir):
    """SNK-03: documents with new keys over the previous ones, nested values as they are."""
    merged = sheets.merge_stats(F.col("props"), F.lit('{"k": 2.5, "stage": {"n": [7]}}'))
    rows = read_table(spark, sf_dir, "events").select("event_id", merged.alias("m"))
    of = lambda p: F.get_json_object("m", p)
    return rows.select("event_id", of("$.page").alias("page"), of("$.k").alias("k"), of("$.stage.n[0]").alias("nested"), F.size(F.json_object_keys("m")).cast("long").alias("keys"))


_KEPT_LINES = f"array_to_string(list_filter({X._LINES}, lambda x: x <> '' AND NOT regexp_matches(x, {D.q('(?i)' + L.BOILERPLATE)})), chr(10))"
#: ``doc_id, url, h, errors``: documents as items of an ingest, up to its checks. NFKC, which SQL lacks, changes none of these.
_ITEMS = f"""(SELECT doc_id, url, sha256({D.collapse('lower(b)')}) AS h, list_filter([CASE WHEN {D.wc('b')} < 10 THEN 'too_short' END, CASE WHEN {D.score('title', 'b', L.NOTICE_RULES)} < 0.28::DOUBLE THEN 'not_classified_as_psa' END,
    CASE WHEN coalesce(url, '') = '' THEN 'missing_source_url' END], lambda x: x IS NOT NULL) AS errors FROM (
  SELECT doc_id, title, url, CASE WHEN {D.wc('c')} >= 12 THEN c ELSE t0 END AS b FROM (SELECT *, CASE WHEN {D.wc('t0')} > 320 THEN {D.core('title', 't0', 340, L.FORCE)} END AS c FROM (
    SELECT doc_id, {D.title_hint('text')} AS title, CASE WHEN doc_id % 7 > 0 THEN source || ':' || (doc_id // 3) END AS url, {D.collapse(_KEPT_LINES)} AS t0 FROM documents) WHERE t0 <> '')))"""


def _items(docs: DataFrame) -> DataFrame:
    address = F.when(F.col("doc_id") % 7 > 0, F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / 3)))
    rest = {"source_id": "s", "domain": "governance", "language_default": "en", "organization": "x", "adapter": "rss"}
    rows = docs.select("doc_id", address.alias("source_url"), T.title_hint("text").alias("title"), F.lit(None).cast("string").alias("raw_html"), F.col("text").alias("raw_text"), F.lit(None).cast("timestamp").alias("published_at"), F.col("doc_id").alias("ord"))
    return rows.select("*", F.lit(80).alias("trust_score"), *[F.lit(v).alias(k) for k, v in rest.items()])


@query(
    "ingested_documents",
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, * FROM {_ITEMS}),
      run(n, doc_id, valid, kept, hs, us) AS (SELECT 0::BIGINT, NULL::BIGINT, false, false, []::VARCHAR[], []::VARCHAR[] UNION ALL
        SELECT n, doc_id, valid, k, CASE WHEN k THEN list_append(hs, h) ELSE hs END, CASE WHEN k AND url IS NOT NULL THEN list_append(us, url) ELSE us END
        FROM (SELECT d.n, d.doc_id, d.h, d.url, len(errors) = 0 AS valid, hs, us, NOT (list_contains(hs, h) OR coalesce(list_contains(us, url), false)) AS k FROM run JOIN d ON d.n = run.n + 1))
      SELECT doc_id, printf('psa_%d_%06d', 2026, row_number() OVER (ORDER BY doc_id) + 41) AS psa_id, CASE WHEN valid THEN 'active' ELSE 'quarantined' END AS status FROM run WHERE kept""",
)
def ingested_documents(spark, sf_dir):
    """JOB-01/02, JON-02: documents through the whole ingest, with chains of hashes and addresses and items without an address; numbers go on."""
    stored = spark.createDataFrame([("psa_2025_000041", "h", "u")], "psa_id string, content_hash string, source_url string")
    return jobs.ingest(_items(documents(spark, sf_dir)), stored)["notices"].select("doc_id", "psa_id", "status")


@query(
    "diagnosed_items",
    f"""WITH known AS (SELECT sha256({D.collapse('lower(text)')}) AS h, source || ':' || (doc_id // 3) AS u FROM documents WHERE doc_id % 10 = 3),
      i AS (SELECT *, h IN (SELECT h FROM known) OR coalesce(url IN (SELECT u FROM known), false) AS there FROM {_ITEMS})
      SELECT CASE WHEN there THEN 'duplicate' WHEN len(errors) > 0 THEN 'reject:' || array_to_string(errors, ',') ELSE 'WOULD_STORE' END AS outcome, count(*) AS n FROM i GROUP BY 1""",
)
def diagnosed_items(spark, sf_dir):
    """CLS-13: what would become of each document as an item, where some hashes and addresses are stored."""
    docs = documents(spark, sf_dir)
    stored = docs.where("doc_id % 10 = 3").select(T.content_hash("text").alias("content_hash"), F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / 3)).alias("source_url"))
    return jobs.diagnose(_items(docs), stored).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
