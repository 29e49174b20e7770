"""Fetched pages of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import html as H
from quern.functions import text as T
from quern.queries import duck as D
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


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", spread=True)


def _bare(x: str) -> str:
    """A page without comments, scripts, styles and its document type."""
    return f"regexp_replace({x}, {D.q('(?is)<!--.*?-->|<script' + chr(92) + 'b[^>]*>.*?</script' + chr(92) + 's*>|<style' + chr(92) + 'b[^>]*>.*?</style' + chr(92) + 's*>|<!doctype[^>]*>')}, '', 'g')"


def _text(x: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex(regexp_replace({x}, '(?s)<[^>]*>', chr(10), 'g'), '\\n+'), lambda l: {D.strip('l')}), lambda l: l <> '')"
    out = f"array_to_string({lines}, chr(10))"
    for name, char in H._ENTITIES:
        out = f"replace({out}, {D.q(name)}, {D.q(char)})"
    return out


@query("page_text", f"SELECT page_id, sha256({_text(_bare('html'))}) AS text_sha256, {D.wc(_text(_bare('html')))}::BIGINT AS words FROM pages")
def page_text(spark, sf_dir):
    """TXT-02."""
    return pages(spark, sf_dir).withColumn("t", H.html_to_text("html")).select("page_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), T.word_count("t").cast("long").alias("words"))


def _el(tag: str) -> str:
    p = D.q(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>")
    return f"CASE WHEN regexp_matches({_bare('html')}, {p}) THEN {_text(f'regexp_extract({_bare(chr(104) + chr(116) + chr(109) + chr(108))}, {p}, 1)')} END"


@query("page_extract", f"SELECT page_id, title, sha256(CASE WHEN {D.wc('a')} >= 10 THEN a WHEN {D.wc('m')} >= 10 THEN m WHEN a IS NULL THEN coalesce(m, '') WHEN {D.wc('m')} > {D.wc('a')} THEN m ELSE a END) AS body_sha256 FROM (SELECT page_id, coalesce({_el('h1')}, {_el('title')}) AS title, {_el('article')} AS a, {_el('main')} AS m FROM pages)")
def page_extract(spark, sf_dir):
    """SRC-01 to 03."""
    p = pages(spark, sf_dir).select("page_id", H.page_tokens("html").alias("tokens"))
    return p.select("page_id", H.first_text(F.col("tokens"), "h1, title").alias("title"), F.sha2(H.body_text(F.col("tokens"), "article, main").cast("binary"), 256).alias("body_sha256"))


@query(
    "page_links",
    r"""SELECT page_id, len(l)::BIGINT AS links, array_to_string(l, '|') AS joined FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1), lambda h:
      regexp_extract(url, '^[^:/]+://[^/?#]*', 0) || h), lambda u: length(regexp_extract(u, '([^/]*)/*$', 1)) >= 3) AS l0, list_filter(l0, lambda x: true) AS d,
      list_distinct(l0) AS u, list_transform(list_sort(list_transform(u, lambda x: {'p': list_position(l0, x), 'x': x})), lambda s: s.x) AS l FROM pages)""",
)
def page_links(spark, sf_dir):
    """SRC-04, SET-05: links of a page's navigation, ending on at least three characters."""
    links = H.article_links("html", F.col("url"), needle="://", least_slug=3, article="nav")
    return pages(spark, sf_dir).withColumn("l", links).select("page_id", F.size("l").cast("long").alias("links"), F.array_join("l", "|").alias("joined"))


@query("page_items", f"SELECT page_id FROM (SELECT page_id, {_el('article')} AS a FROM pages) WHERE {D.wc('a')} >= 10")
def page_items(spark, sf_dir):
    """SRC-01: pages that give an item of ten words or more."""
    from quern.sources.sheets import read_pages

    p = pages(spark, sf_dir)
    items = read_pages(p.select(F.col("page_id").cast("string").alias("url"), "html"), "s")
    return items.select(F.col("source_url").cast("long").alias("page_id"))


@query("ingest_job")
def ingest_job(spark, sf_dir):
    """JOB-01/02: pages through the whole ingest: what is stored, by status, domain and urgency."""
    from quern.plans.jobs import ingest
    from quern.sources.sheets import read_pages

    items = read_pages(pages(spark, sf_dir), "s").withColumn("ord", F.xxhash64("source_url", "raw_text"))
    items = items.withColumn("domain", F.lit("governance")).withColumn("language_default", F.lit("en")).withColumn("organization", F.lit("x")).withColumn("trust_score", F.lit(80)).withColumn("adapter", F.lit("generic_html"))
    stored = spark.createDataFrame([("psa_2026_000007", "", "")], "psa_id string, content_hash string, source_url string")
    return ingest(items, stored)["notices"].groupBy("status", "domain", "urgency").agg(F.count(F.lit(1)).alias("n"))
