"""Deduplication, joins, aggregates, samples and splits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import jsonmeta as J
from quern.functions import lexicons as L
from quern.functions import rules as R
from quern.functions import text as T
from quern.operators import lookups as JN
from quern.operators import ranking as K
from quern.operators import sampling as SM
from quern.operators import statistics as ST
from quern.queries import duck as D
from quern.queries.texts import CORPUS_SQL, corpus, documents
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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def count(name: str):
    return F.count(F.lit(1)).alias(name)


_HASH = f"sha256({D.collapse('lower(text)')})"


@query("content_hash_dedup", f"SELECT doc_id, source, h AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM (SELECT *, {_HASH} AS h FROM documents)) WHERE r = 1")
def content_hash_dedup(spark, sf_dir):
    """WIN-01, TXT-21: the first document of each content hash."""
    return K.keep_first(documents(spark, sf_dir).select("doc_id", "source", T.content_hash("text").alias("content_hash")), "content_hash", "doc_id")


@query("dedup_counts", f"SELECT source AS key, count(*) AS loaded, count(DISTINCT {_HASH}) AS distinct_texts FROM documents GROUP BY 1")
def dedup_counts(spark, sf_dir):
    """AGG-04 of a merge: rows and distinct texts by contributor."""
    return documents(spark, sf_dir).groupBy(F.col("source").alias("key")).agg(count("loaded"), F.countDistinct(T.content_hash("text")).alias("distinct_texts"))


@query("renumber_ids", "SELECT printf('psa_%d_%06d', 2026, row_number() OVER (ORDER BY source, doc_id)) AS psa_id, doc_id AS original_id FROM documents")
def renumber_ids(spark, sf_dir):
    """WIN-02: ids without gaps in an order of their own."""
    df = documents(spark, sf_dir).select(F.col("doc_id").alias("psa_id"), "source").withColumn("at", F.col("psa_id"))
    return K.renumber(df, "psa_id", "psa", 2026, "source", "at").select("psa_id", "original_id")


@query("next_ids", "SELECT page_id, row_number() OVER (ORDER BY page_id) + (SELECT coalesce(max(doc_id), 0) FROM documents) AS number FROM pages")
def next_ids(spark, sf_dir):
    """WIN-03: numbers that go on from the largest stored one."""
    return K.next_ids(table(spark, sf_dir, "pages").select("page_id"), documents(spark, sf_dir), "doc_id", "number", "page_id")


_KNOWN_PAGES = "SELECT url FROM pages WHERE page_id % 3 = 0"


@query("skip_known_urls", f"SELECT p.page_id FROM pages p WHERE p.url NOT IN ({_KNOWN_PAGES})")
def skip_known_urls(spark, sf_dir):
    """JON-01, SRC-08: pages whose address isn't known; every third page stands for the known ones."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return JN.not_known(pages, pages.where("page_id % 3 = 0"), "url").select("page_id")


_KNOWN_DOCS = f"SELECT {_HASH} AS h, source || ':' || (doc_id // 4) AS u FROM documents WHERE doc_id % 5 = 0"


@query("not_known_either", f"SELECT doc_id FROM (SELECT *, {_HASH} AS h, source || ':' || (doc_id // 4) AS u FROM documents WHERE doc_id % 5 <> 0) WHERE h NOT IN (SELECT h FROM ({_KNOWN_DOCS})) AND u NOT IN (SELECT u FROM ({_KNOWN_DOCS}))")
def not_known_either(spark, sf_dir):
    """JON-02: rows that are new by hash and by address, both."""
    df = documents(spark, sf_dir).select("doc_id", T.content_hash("text").alias("h"), F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / 4).cast("string")).alias("u"))
    return JN.not_known(df.where("doc_id % 5 <> 0"), df.where("doc_id % 5 = 0"), "h", "u").select("doc_id")


_KEY = D.collapse("lower(text)")
_REASON = f"CASE WHEN {D.wc('text')} < 12 THEN 'too_short' WHEN {D.wc('text')} > 350 THEN 'too_long_for_psa' END"


@query(
    "first_decides",
    f"""WITH seen AS (SELECT DISTINCT {_KEY} AS k FROM benchmark WHERE {_KEY} <> '' UNION SELECT {_KEY} FROM documents WHERE doc_id < 20 AND {_KEY} <> ''),
      r AS (SELECT doc_id, {_KEY} AS k, {_REASON} AS reason FROM documents WHERE doc_id >= 20)
      SELECT doc_id, coalesce(reason, 'added') AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM r WHERE k <> '' AND k NOT IN (SELECT k FROM seen)) WHERE n = 1""",
)
def first_decides(spark, sf_dir):
    """JON-03, WIN-08, SET-02: of unseen texts the first row, whatever becomes of it."""
    docs = documents(spark, sf_dir)
    seen = JN.seen_keys(table(spark, sf_dir, "benchmark").select("text"), docs.where("doc_id < 20").select("text"))
    n = T.word_count("text")
    rows = docs.where("doc_id >= 20").select("doc_id", T.dedup_key("text").alias("key"), F.when(n < 12, "too_short").when(n > 350, "too_long_for_psa").alias("reason"))
    return JN.first_decides(rows, seen, "doc_id").select("doc_id", F.coalesce("reason", F.lit("added")).alias("outcome"))


@query(
    "first_passing",
    f"""WITH seen AS (SELECT DISTINCT {_KEY} AS k FROM documents WHERE doc_id < 20 AND {_KEY} <> ''), r AS (SELECT doc_id, {_KEY} AS k, {_REASON} AS reason FROM documents WHERE doc_id >= 20)
      SELECT min(doc_id) AS doc_id, md5(k) AS key FROM r WHERE k <> '' AND reason IS NULL AND k NOT IN (SELECT k FROM seen) GROUP BY k""",
)
def first_passing(spark, sf_dir):
    """JON-04: of unseen whole texts the first row that passes."""
    docs = documents(spark, sf_dir)
    n = T.word_count("text")
    rows = docs.where("doc_id >= 20").select("doc_id", T.dedup_key("text").alias("key"), F.when(n < 12, "too_short").when(n > 350, "too_long_for_psa").alias("reason"))
    return JN.first_passing(rows, JN.seen_keys(docs.where("doc_id < 20").select("text")), "reason", "doc_id").select("doc_id", F.md5(F.col("key").cast("binary")).alias("key"))


_MD5 = lambda seed, c: f"md5('{seed}|' || {c}::VARCHAR)"


def _split_sql(rows: str, idc: str, g: str, seed: int = 42) -> str:
    return f"""(SELECT *, CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + dv THEN 'dev' ELSE 'test' END AS split FROM (
      SELECT *, CASE WHEN n >= 2 AND dv1 = 0 AND tr1 > 1 THEN tr1 - 1 ELSE tr1 END AS tr, CASE WHEN n >= 2 AND dv1 = 0 AND tr1 > 1 THEN 1 ELSE dv1 END AS dv FROM (
        SELECT *, CASE WHEN n >= 3 AND n - tr0 - dv0 = 0 AND tr0 > dv0 THEN tr0 - 1 ELSE tr0 END AS tr1, CASE WHEN n >= 3 AND n - tr0 - dv0 = 0 AND tr0 <= dv0 THEN greatest(0, dv0 - 1) ELSE dv0 END AS dv1 FROM (
          SELECT *, floor(n * 0.8::DOUBLE)::BIGINT AS tr0, floor(n * 0.1::DOUBLE)::BIGINT AS dv0 FROM (
            SELECT {idc} AS id, {g} AS g, count(*) OVER (PARTITION BY {g}) AS n, row_number() OVER (PARTITION BY {g} ORDER BY {_MD5(seed, idc)}, {idc}) AS rk FROM {rows})))))"""


@query("stratified_split_rows", f"SELECT id, g AS source, split FROM {_split_sql('documents', 'doc_id', 'source')}")
def stratified_split_rows(spark, sf_dir):
    """SMP-02, WIN-07."""
    return SM.stratified_split(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source"), "id", "source").select("id", "source", "split")


@query("split_counts", f"SELECT split, g AS source, count(*) AS n FROM {_split_sql('documents', 'doc_id', 'source')} GROUP BY 1, 2")
def split_counts(spark, sf_dir):
    """AGG-10."""
    return stratified_split_rows(spark, sf_dir).groupBy("split", "source").agg(count("n"))


@query("small_group_split", f"SELECT id, g, split FROM {_split_sql('nation', 'n_nationkey', 'n_regionkey')}")
def small_group_split(spark, sf_dir):
    """SMP-02 with strata of a few rows."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("g"))
    return SM.stratified_split(df, "id", "g").select("id", "g", "split")


def _allocated(sizes: str, n: str, least: int) -> str:
    """``(g, c, alloc)`` of ``sizes(g, c)``: shares of ``n`` rows, corrected one by one to ``n``; all rows where there are no more."""
    step = f"CASE WHEN list_sum(o) > want THEN list_transform(range(1, len(o) + 1), lambda i: o[i] - (i = list_position(o, list_max(o)))::INT) ELSE list_transform(range(1, len(o) + 1), lambda i: o[i] + (i = list_position(list_transform(range(1, len(o) + 1), lambda j: cs[j] - o[j]), list_max(list_transform(range(1, len(o) + 1), lambda j: cs[j] - o[j]))))::INT) END"
    left = "list_max(list_transform(range(1, len(o) + 1), lambda j: cs[j] - o[j]))"
    done = f"(list_sum(o) = want OR (list_sum(o) > want AND list_max(o) <= 1) OR (list_sum(o) < want AND {left} <= 0))"
    return f"""(WITH RECURSIVE z AS (SELECT list(g ORDER BY g) AS gs, list(c ORDER BY g) AS cs, sum(c) AS total, {n} AS want FROM {sizes}),
      walk(gs, cs, want, o) AS (SELECT gs, cs, least(want, total), list_transform(cs, lambda c: least(c, greatest({least}, round_even(c::DOUBLE / total * want, 0)::BIGINT))) FROM z
        UNION ALL SELECT gs, cs, want, {step} FROM walk WHERE want > 0 AND NOT {done})
      SELECT unnest(gs) AS g, unnest(cs) AS c, unnest(o) AS alloc FROM walk WHERE want > 0 AND {done})"""


@query("stratified_sample_counts", f"SELECT g AS key, alloc::BIGINT AS n FROM {_allocated('(SELECT source AS g, count(*) AS c FROM documents GROUP BY 1)', '100', 3)} WHERE alloc > 0")
def stratified_sample_counts(spark, sf_dir):
    """SMP-01: rows of each source in a sample of 100."""
    return ST.count_by(SM.stratified_sample(documents(spark, sf_dir).select("doc_id", "source"), 100, "doc_id", "source", least=3), "source")


def _sampled(rows: str, n: str, seed: int) -> str:
    """Rows of a sample of ``rows(id, g, split)``."""
    ranked = f"(SELECT split, id, g, row_number() OVER (PARTITION BY g ORDER BY md5('{seed}|' || id::VARCHAR), id) AS r FROM {rows})"
    return f"SELECT h.split, h.g AS source FROM {ranked} h JOIN {_allocated(f'(SELECT g, count(*) AS c FROM {rows} GROUP BY 1)', n, 10)} a ON a.g = h.g WHERE h.r <= a.alloc"


_HELD, _TRAIN = (f"(SELECT * FROM {_split_sql('documents', 'doc_id', 'source')} WHERE split IN ({parts}))" for parts in ("'test', 'dev'", "'train'"))


@query("validation_set_counts", f"SELECT split, source, count(*) AS n FROM ({_sampled(_HELD, '50', 42)} UNION ALL {_sampled(_TRAIN, f'(SELECT greatest(50 - count(*), 0) FROM {_HELD})', 43)}) GROUP BY 1, 2")
def validation_set_counts(spark, sf_dir):
    """SMP-03: a validation set by split and source."""
    split = stratified_split_rows(spark, sf_dir)
    return SM.validation_set(split, 50, "id", "source").groupBy("split", "source").agg(count("n"))


@query("split_lookup", f"SELECT d.doc_id, coalesce(s.split, '') AS split, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT * FROM {_split_sql('documents', 'doc_id', 'source')} WHERE id % 10 < 7) s ON s.id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def split_lookup(spark, sf_dir):
    """JON-05, 06: splits where there is one, and whether a label exists."""
    split = stratified_split_rows(spark, sf_dir).where("id % 10 < 7").select(F.col("id").alias("doc_id"), "split")
    rows = JN.with_split(documents(spark, sf_dir).select("doc_id"), split, "doc_id")
    return JN.with_flag(rows, table(spark, sf_dir, "labels"), "doc_id", "labelled")


@query("domain_counts", "SELECT coalesce(nullif(source, ''), 'Unknown') AS key, count(*) AS n FROM documents GROUP BY 1")
def domain_counts(spark, sf_dir):
    """AGG-02, 03."""
    return ST.count_by(documents(spark, sf_dir), "source")


@query(
    "eda_summary",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE toxic = 1) AS flagged, count(*) FILTER (WHERE lang IN ('fr', 'es')) AS second_language, sum({D.wc('text')})::BIGINT AS words,
      sum(coalesce(nullif({D.wc('text')}, 0), 1))::BIGINT AS at_least_one FROM documents LEFT JOIN labels USING (doc_id)""",
)
def eda_summary(spark, sf_dir):
    """AGG-01, 05, 06."""
    df = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = T.word_count("text")
    return df.agg(
        count("rows"), ST.count_true(ST.lenient_flag("toxic")).alias("flagged"), ST.count_true(F.col("lang").isin("fr", "es")).alias("second_language"), F.sum(n).alias("words"),
        F.sum(F.when(n > 0, n).otherwise(1)).alias("at_least_one"),
    )


_PCT = lambda p: f"list_extract(v, round_even({p}::DOUBLE / 100.0::DOUBLE * (n - 1), 0)::BIGINT + 1)::DOUBLE"


@query("eda_percentiles", f"SELECT n, v[1] AS min, {_PCT(25)} AS p25, {_PCT(50)} AS median, {_PCT(75)} AS p75, v[n] AS max, mean FROM (SELECT count(*) AS n, list(w ORDER BY w) AS v, round_even(sum(w)::DOUBLE / count(*), 2) AS mean FROM (SELECT {D.wc('text')}::BIGINT AS w FROM documents))")
def eda_percentiles(spark, sf_dir):
    """AGG-07."""
    return ST.nearest_rank(documents(spark, sf_dir).select(T.word_count("text").alias("w")), "w", {"p25": 25, "median": 50, "p75": 75})


_TOKENS = f"(SELECT doc_id, unnest({D.word_tokens('text')}) AS token, unnest(range(len({D.word_tokens('text')}))) AS p FROM documents)"


@query("word_vocab_topk", f"SELECT token, n FROM (SELECT token, count(*) AS n, min({{'o': doc_id, 'p': p}}) AS f FROM {_TOKENS} GROUP BY token ORDER BY n DESC, f LIMIT 40)")
def word_vocab_topk(spark, sf_dir):
    """AGG-08, ORD-03."""
    return ST.top(ST.vocabulary(documents(spark, sf_dir), "text", "doc_id"), 40, "first").select("token", "n")


@query("vocabulary_size", f"SELECT count(DISTINCT token) AS size, count(*) AS tokens FROM {_TOKENS}")
def vocabulary_size(spark, sf_dir):
    """AGG-08."""
    return ST.vocabulary(documents(spark, sf_dir), "text", "doc_id").agg(count("size"), F.sum("n").alias("tokens"))


@query(
    "keep_rate_verdict",
    f"SELECT key, kept, total, round_even(kept::DOUBLE / total, 4) AS keep_rate, CASE WHEN kept::DOUBLE / total < 0.45::DOUBLE THEN 'poor_needs_clean' WHEN kept::DOUBLE / total < 0.7::DOUBLE THEN 'mixed_review' ELSE 'mostly_psa' END AS verdict FROM (SELECT source AS key, count(*) FILTER (WHERE {D.wc('text')} BETWEEN 12 AND 350) AS kept, count(*) AS total FROM documents GROUP BY 1)",
)
def keep_rate_verdict(spark, sf_dir):
    """AGG-11, CLS-11."""
    df = documents(spark, sf_dir).groupBy(F.col("source").alias("key")).agg(ST.count_true(T.word_count("text").between(12, 350)).alias("kept"), count("total"))
    return df.withColumn("keep_rate", F.bround(F.col("kept") / F.col("total"), 4)).withColumn("verdict", R.corpus_verdict("kept", "total"))


@query("gap_and_readiness", "SELECT n AS rows, greatest(0, 5000 - n)::BIGINT AS gap, train >= 50 AND dev >= 5 AS ready FROM (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 10 < 8) AS train, count(*) FILTER (WHERE doc_id % 10 = 8) AS dev FROM documents)")
def gap_and_readiness(spark, sf_dir):
    """AGG-12, CLS-12."""
    docs = documents(spark, sf_dir)
    ready = docs.agg(ST.count_true(F.col("doc_id") % 10 < 8).alias("train"), ST.count_true(F.col("doc_id") % 10 == 8).alias("dev")).select(R.training_ready("train", "dev").alias("ready"))
    return ST.gap_to(docs, 5000).crossJoin(ready)


@query("log_rollup", "SELECT event_type AS source_id, count(*) AS items_found, count(*) FILTER (WHERE value >= 10) AS items_stored, count(*) FILTER (WHERE value < 10 OR value IS NULL) AS items_rejected FROM events GROUP BY 1")
def log_rollup(spark, sf_dir):
    """AGG-13: outcomes by source."""
    good = F.coalesce(F.col("value") >= 10, F.lit(False))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_id")).agg(count("items_found"), ST.count_true(good).alias("items_stored"), ST.count_true(~good).alias("items_rejected"))


@query("log_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def log_windows(spark, sf_dir):
    """AGG-13 in tumbling windows: the batch form of the stream."""
    from quern.streaming.ingest import log_windows as windows

    return windows(table(spark, sf_dir, "events")).select("start", "event_type", "n")


@query("histogram_bins", f"SELECT least(40, greatest(1, floor((w - 0.0::DOUBLE) / 25.0::DOUBLE)::INT + 1)) AS bin, count(*) AS n FROM (SELECT {D.wc('text')} AS w FROM documents) GROUP BY 1")
def histogram_bins(spark, sf_dir):
    """AGG-16."""
    return documents(spark, sf_dir).groupBy(ST.bins(T.word_count("text"), 0.0, 1000.0, 40).alias("bin")).agg(count("n"))


@query("language_pivot", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(DISTINCT lang) AS languages FROM documents GROUP BY 1")
def language_pivot(spark, sf_dir):
    """AGG-16: a pivot beside a distinct count."""
    docs = documents(spark, sf_dir)
    pivot = docs.groupBy("source").pivot("lang", ["en", "fr", "de"]).agg(F.count(F.lit(1)))
    pivot = pivot.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("en", "fr", "de")])
    return pivot.join(docs.groupBy("source").agg(F.countDistinct("lang").alias("languages")), "source")


@query("json_overlay", """SELECT event_id, json_extract_string(props, '$.page') AS page, coalesce(json_extract_string(props, '$.k'), 'base') AS k, len(json_keys(props)) + (NOT list_contains(json_keys(props), 'stage'))::INT AS keys FROM events""")
def json_overlay(spark, sf_dir):
    """JSN-01, 02, 06: fields of a free JSON column, with keys over and under it."""
    m = J.overlay(J.set_default(J.parse("props"), F.create_map(F.lit("k"), F.lit("base"))), F.create_map(F.lit("stage"), F.lit("x")))
    size = F.size(J.overlay(J.parse("props"), F.create_map(F.lit("stage"), F.lit("x")))).cast("long")
    return table(spark, sf_dir, "events").select("event_id", J.field("props", "page").alias("page"), m["k"].alias("k"), size.alias("keys"))


@query("json_prefix", """SELECT event_id, array_to_string(list_sort(list_transform(json_keys(props), lambda k: 'src_' || k)), ',') AS keys FROM events""")
def json_prefix(spark, sf_dir):
    """JSN-03 to 05: keys with a prefix, one taken away again."""
    m = J.without(J.prefixed(J.overlay(J.parse("props"), F.create_map(F.lit("gone"), F.lit("1"))), "src_"), "src_gone")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"))


@query("literal_keys", "SELECT doc_id, 'Kikuyu,s' || (doc_id % 3) AS keys FROM documents")
def literal_keys(spark, sf_dir):
    """JSN-07, SET-05: keys of a dictionary written as a literal."""
    text = F.concat(F.lit("{'Kikuyu': 1, 's"), (F.col("doc_id") % 3).cast("string"), F.lit("': 'x'}"))
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.array_distinct(J.literal_keys(text)), ",").alias("keys"))


@query("fk_check", "SELECT 'lineitem_orders' AS link, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans UNION ALL SELECT 'labels_documents', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'orders_customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0))")
def fk_check(spark, sf_dir):
    """JON-14."""
    t = lambda n: table(spark, sf_dir, n)
    links = [("lineitem_orders", t("lineitem"), t("orders"), "l_orderkey", "o_orderkey"), ("labels_documents", t("labels"), t("documents"), "doc_id", "doc_id"), ("orders_customer", t("orders"), t("customer").where("c_custkey % 7 <> 0"), "o_custkey", "c_custkey")]
    out = [JN.orphans(c, p, k, pk).agg(count("orphans")).select(F.lit(name).alias("link"), "orphans") for name, c, p, k, pk in links]
    return out[0].union(out[1]).union(out[2])


@query("source_lookup", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def source_lookup(spark, sf_dir):
    """JON-09: rows with what their source says."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return JN.with_source(JN.with_source(orders, customer, "o_custkey", "c_custkey"), nation, "c_nationkey", "n_nationkey").select("o_orderkey", "c_mktsegment", "n_name")


@query("upsert_sources", "SELECT s_suppkey, s_name, trust FROM (SELECT s_suppkey, s_name, 80 AS trust FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, lower(s_name), 50 FROM supplier WHERE s_acctbal <= 0)")
def upsert_sources(spark, sf_dir):
    """SRC-09: stored rows that new ones replace."""
    from quern.sources.sheets import upsert

    s = table(spark, sf_dir, "supplier")
    stored = s.select("s_suppkey", F.lower("s_name").alias("s_name"), F.lit(50).alias("trust"))
    return upsert(stored, s.where("s_acctbal > 0").select("s_suppkey", "s_name", F.lit(80).alias("trust")), "s_suppkey")


_PROMOTED = f"(SELECT id, CASE WHEN id % 4 = 0 THEN 'archived' ELSE 'quarantined' END AS status, {D.score('t', 'text', L.NOTICE_RULES)} >= 0.28::DOUBLE AS ok, {D.wc('text')} AS n, src FROM (SELECT *, {D.title_hint('text')} AS t FROM {CORPUS_SQL}))"


@query("status_changes", f"SELECT id, CASE WHEN status = 'quarantined' AND ok AND n >= 10 AND src <> '' THEN 'active' ELSE status END AS status, CASE WHEN status = 'quarantined' THEN ok ELSE false END AS is_psa FROM {_PROMOTED}")
def status_changes(spark, sf_dir):
    """SRC-10, FLT-06, CLS-10: quarantined rows that are valid when judged again become active, archived ones stay."""
    from quern.plans.jobs import promote

    rows = corpus(spark, sf_dir).select(
        "id", T.title_hint("text").alias("title"), "text", F.col("src").alias("source_url"), F.lit(80).alias("trust_score"), F.lit(None).cast("timestamp").alias("published_at"), F.col("lang").alias("language"),
        F.when(F.col("id") % 4 == 0, "archived").otherwise("quarantined").alias("status"), F.lit(False).alias("is_psa"),
    )
    return promote(rows).select("id", "status", "is_psa")


@query("title_alignment", f"""SELECT a.doc_id AS en_id, b.doc_id AS sw_id, 'date_title_fuzzy' AS method, 1.0::DOUBLE - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t), 1) AS score
  FROM (SELECT doc_id, doc_id // 8 AS d, lower(regexp_replace({D.title_hint('text')}, '[^ -~]', '?', 'g')) AS t FROM documents WHERE doc_id % 2 = 0) a JOIN (SELECT doc_id, doc_id // 8 AS d, lower(regexp_replace({D.title_hint('text')}, '[^ -~]', '?', 'g')) AS t FROM documents WHERE doc_id % 2 = 1) b ON a.d = b.d
  WHERE 1.0::DOUBLE - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t), 1) >= 0.3::DOUBLE""")
def title_alignment(spark, sf_dir):
    """JON-13 with a low threshold, so that there are rows."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.format_string("https://x/%d", "doc_id").alias("url"), F.floor(F.col("doc_id") / 8).alias("date"), F.regexp_replace(T.title_hint("text"), "[^ -~]", "?").alias("title"))
    return JN.aligned_versions(d.where("id % 2 = 0"), d.where("id % 2 = 1"), 0.3)


@query("domain_bag", "SELECT d AS domain, greatest(1, floor(greatest(0.01::DOUBLE, ideal - coalesce(n, 0)::DOUBLE / total) * 100)::INT)::BIGINT AS slots FROM (VALUES ('en', 0.28::DOUBLE), ('fr', 0.20::DOUBLE), ('de', 0.20::DOUBLE), ('es', 0.16::DOUBLE), ('sw', 0.16::DOUBLE)) v(d, ideal) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) c ON c.lang = d CROSS JOIN (SELECT count(*) AS total FROM documents)")
def domain_bag(spark, sf_dir):
    """SMP-05."""
    counts = documents(spark, sf_dir).groupBy(F.col("lang").alias("domain")).agg(count("n"))
    return SM.domain_bag(counts, {"en": 0.28, "fr": 0.20, "de": 0.20, "es": 0.16, "sw": 0.16}).groupBy("domain").agg(count("slots"))


@query("ordered_tops", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def ordered_tops(spark, sf_dir):
    """ORD-01, 02, 04."""
    return documents(spark, sf_dir).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("set_operations", "SELECT 'union' AS op, (SELECT count(*) FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) AS n UNION ALL SELECT 'distinct', (SELECT count(*) FROM (SELECT text FROM documents UNION SELECT text FROM benchmark)) UNION ALL SELECT 'except', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def set_operations(spark, sf_dir):
    """SET-01, 02, 04."""
    d, b, l = documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "labels")
    both = d.select("text").unionByName(b.select("text"))
    parts = [("union", both), ("distinct", both.distinct()), ("except", d.join(l.select("doc_id").distinct(), "doc_id", "left_anti"))]
    out = [x.agg(count("n")).select(F.lit(name).alias("op"), "n") for name, x in parts]
    return out[0].union(out[1]).union(out[2])


@query("merge_job", f"""SELECT CASE WHEN reason IS NULL THEN 'clean' ELSE 'quarantine' END AS sheet, count(*) AS n FROM ({D.gate("(SELECT doc_id AS id, " + "t" + " AS text, '' AS src, lang FROM (SELECT doc_id, lang, h, t, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM (SELECT doc_id, lang, t, sha256(" + D.collapse("lower(t)") + ") AS h FROM (SELECT doc_id, lang, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), " + D.q(f"^[{D.WS}]+|[{D.WS}]+$") + ", '', 'g') AS t FROM documents)) WHERE " + D.wc("t") + " >= 8) WHERE r = 1)", L.NOTICE_RULES)}) GROUP BY 1""")
def merge_job(spark, sf_dir):
    """JOB-04 over documents as one contributor's sheet, counted by sheet."""
    from quern.plans.jobs import merge
    from quern.sources.sheets import canonical

    rows = documents(spark, sf_dir).withColumn("ord", F.col("doc_id"))
    sheet = canonical(rows, F.col("doc_id").cast("string"), F.lit("health"), F.col("text"), F.lit(""), F.lit(""), F.lit(""), {"contributor": F.col("source")})
    sheet = sheet.join(rows.select("ord", "lang"), "ord").withColumn("Metadata", J.serialise(J.overlay(J.parse("Metadata"), F.create_map(F.lit("lang_detected"), F.col("lang"))))).drop("lang")
    out = merge([sheet])
    return out["clean"].select(F.lit("clean").alias("sheet")).union(out["quarantine"].select(F.lit("quarantine").alias("sheet"))).groupBy("sheet").agg(count("n"))


_BOTH_SHEETS = f"(SELECT doc_id AS ord, {D.strip('text')} AS text, source, lang, doc_id % 2 AS src, CASE WHEN n_chars > 2500 THEN 'too_long_for_psa' ELSE 'genre_news_not_psa' END AS why FROM documents)"
_REFILTERED = f"""(SELECT ord AS id, CASE WHEN {D.wc('text')} > 350 THEN {D.core(D.title_hint('text'), 'text', 350, L.FORCE)} ELSE text END AS text, source AS src, lang FROM (
  SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY src, ord) AS r FROM {_BOTH_SHEETS} WHERE {_KEY} <> '') WHERE r = 1)"""


@query("refilter_job", f"SELECT reason AS key, count(*) AS n FROM ({D.gate(_REFILTERED, L.NOTICE_RULES)}) WHERE reason IS NOT NULL GROUP BY 1")
def refilter_job(spark, sf_dir):
    """JOB-05: reasons of both sheets after long texts are cut to their cores."""
    from quern.plans.jobs import refilter

    clean, quarantine = _sheets(spark, sf_dir)
    return ST.count_by(refilter(clean, quarantine)["quarantine"], "Quarantine_Reason")


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as a clean sheet (even ids) and a quarantine sheet (odd ids)."""
    d = documents(spark, sf_dir)
    sheet = d.select(
        F.col("doc_id").cast("string").alias("PSA_ID"), F.lit("Health").alias("Domain"), F.col("text").alias("English"), F.lit("").alias("Kiswahili"), F.lit('["Kikuyu"]').alias("Target Languages"),
        F.col("source").alias("Source"), F.lit("").alias("Date"), F.to_json(F.struct(F.col("lang").alias("lang_detected"))).alias("Metadata"),
        F.when(F.col("n_chars") > 2500, "too_long_for_psa").otherwise("genre_news_not_psa").alias("Quarantine_Reason"), F.col("doc_id").alias("ord"),
    )
    return sheet.where("ord % 2 = 0").drop("Quarantine_Reason"), sheet.where("ord % 2 = 1")


_CORES = f"(SELECT ord AS id, {D.core(D.title_hint('text'), 'text', 340, L.FORCE)} AS text, source AS src, 'en' AS lang, why FROM {_BOTH_SHEETS} WHERE src = 1)"


@query(
    "recover_job",
    f"""WITH cores AS MATERIALIZED (SELECT * FROM {_CORES}), judged AS (SELECT c.*, {_KEY} AS k, g.reason FROM cores c JOIN ({D.gate('cores', L.NOTICE_RULES)}) g USING (id)),
      back AS (SELECT min(id) AS id FROM judged WHERE reason IS NULL AND k <> '' AND k NOT IN (SELECT {_KEY} FROM {_BOTH_SHEETS} WHERE src = 0) GROUP BY k)
      SELECT coalesce('core_failed:' || reason, why) AS key, count(*) AS n FROM judged WHERE id NOT IN (SELECT id FROM back) GROUP BY 1 UNION ALL SELECT 'recovered', count(*) FROM back""",
)
def recover_job(spark, sf_dir):
    """JOB-07, FLT-07: reasons of what stays, and how many cores return."""
    from quern.plans.jobs import recover_cores

    clean, quarantine = _sheets(spark, sf_dir)
    out = recover_cores(clean, quarantine)
    return ST.count_by(out["quarantine"], "Quarantine_Reason").union(out["recovered"].agg(F.lit("recovered").alias("key"), count("n")))


@query("audit_job", f"SELECT label AS key, count(*) AS n FROM (SELECT id, CASE WHEN a > 0 THEN 'has_action' ELSE 'no_action' END AS label FROM (SELECT doc_id AS id, {D.count('trim(' + D.collapse(D.title_hint('text')) + chr(32) + '|| ' + chr(39) + '. ' + chr(39) + ' || ' + D.collapse('text') + ', ' + chr(39) + '. ' + chr(39) + ')', '(?i)' + L.ACTION)} AS a FROM documents)) GROUP BY 1")
def audit_job(spark, sf_dir):
    """JOB-08: rows of an audit with and without an action cue."""
    from quern.plans.jobs import audit

    clean, quarantine = _sheets(spark, sf_dir)
    out = audit(clean.unionByName(quarantine.drop("Quarantine_Reason")))
    return out["audit"].groupBy(F.when(F.col("action_hits") > 0, "has_action").otherwise("no_action").alias("key")).agg(count("n"))


_FULL = f"(SELECT ord, lang, source, title, CASE WHEN title <> '' THEN {D.strip(chr(116) + 'rim(title || ' + D.q('. ') + ' || text, ' + D.q('. ') + ')')} ELSE text END AS full_ FROM (SELECT *, {D.strip(D.title_hint('text'))} AS title FROM {_BOTH_SHEETS}) WHERE title <> '' OR text <> '')"
_EXPORTED = f"(SELECT ord AS id, lang[1:2] AS lang, source AS src, title, CASE WHEN {D.wc('full_')} > 320 AND {D.wc('core')} >= 12 THEN core ELSE full_ END AS text FROM (SELECT *, {D.core('title', 'full_', 340, L.FORCE)} AS core FROM {_FULL}))"


@query(
    "export_job",
    f"""WITH rows AS MATERIALIZED (SELECT * FROM {_EXPORTED}), judged AS (SELECT r.id, {_KEY} AS k, coalesce(g.reason, CASE WHEN NOT f.is_strict THEN 'framework_' || f.label || ':' || f.reason END) AS reason
        FROM rows r JOIN ({D.gate('rows', L.NOTICE_RULES)}) g USING (id) JOIN ({D.framework('rows', L.NOTICE_RULES)}) f USING (id)),
      first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM judged WHERE k <> '' AND k NOT IN (SELECT {_KEY} FROM documents)) WHERE n = 1)
      SELECT reason AS key, count(*) AS n FROM first WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'added', count(*) FROM first WHERE reason IS NULL""",
)
def export_job(spark, sf_dir):
    """JOB-06: outcomes of an export against both sheets."""
    from quern.plans.jobs import ingest_export

    clean, quarantine = _sheets(spark, sf_dir)
    export = documents(spark, sf_dir).select(
        F.lit("health").alias("domain"), T.title_hint("text").alias("title"), "text", F.col("lang").alias("language"), F.col("source").alias("source_url"), F.lit("").alias("published_at"), F.lit("x").alias("organization"), F.col("doc_id").alias("ord"),
    )
    out = ingest_export(export, clean, quarantine)
    return ST.count_by(out["quarantined"], "Quarantine_Reason").union(out["added"].agg(F.lit("added").alias("key"), count("n")))


@query("process_job", f"SELECT split, g AS Domain, count(*) AS n FROM {_split_sql('(SELECT doc_id::VARCHAR AS pid FROM documents WHERE ' + D.strip('text') + ' <> ' + D.q('') + ')', 'pid', D.q('Health'))} GROUP BY 1, 2")
def process_job(spark, sf_dir):
    """JOB-11: the cleaned sheet by split and domain."""
    from quern.plans.jobs import process_and_split

    clean, quarantine = _sheets(spark, sf_dir)
    return process_and_split(clean.unionByName(quarantine.drop("Quarantine_Reason")), 20)["split_counts"].withColumnRenamed("count", "n")


@query("seed_candidates", f"SELECT doc_id, {D.wc('text')}::BIGINT AS full_token_count, {D.wc('s')}::BIGINT AS token_count FROM (SELECT doc_id, text, {D.strip('substr(' + D.collapse('text') + ', 1, 600)')} AS s FROM documents WHERE {D.wc('text')} BETWEEN 12 AND 200) WHERE {D.wc('s')} >= 12")
def seed_candidates(spark, sf_dir):
    """JOB-10, FLT-03."""
    from quern.plans.jobs import seed_candidates as candidates

    clean, quarantine = _sheets(spark, sf_dir)
    df = candidates(clean.unionByName(quarantine.drop("Quarantine_Reason")))
    return df.select(F.col("psa_id").cast("long").alias("doc_id"), F.col("full_token_count").cast("long").alias("full_token_count"), F.col("token_count").cast("long").alias("token_count"))


@query("long_or_short", f"SELECT doc_id FROM documents WHERE {D.wc('text')} >= 8 OR {D.wc('lang')} >= 8")
def long_or_short(spark, sf_dir):
    """FLT-01."""
    return documents(spark, sf_dir).where(T.long_in_either("text", "lang")).select("doc_id")


@query("navigation_crumbs", f"SELECT id, {D.count('text', 'Home')} >= 2 AND contains(text, 'About') AS crumb FROM (SELECT page_id AS id, html || ' Home Home About' AS text FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, html FROM pages WHERE page_id % 2 = 1)")
def navigation_crumbs(spark, sf_dir):
    """FLT-09."""
    p = table(spark, sf_dir, "pages")
    text = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit(" Home Home About"))).otherwise(F.col("html"))
    return p.select(F.col("page_id").alias("id"), T.navigation_crumb(text).alias("crumb"))
