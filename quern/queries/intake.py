"""What comes in: the ingest's choice, and sheets, bitext, feeds and pages of many files and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import html as H
from quern.functions import text as T
from quern.operators.first_choice import first_choice
from quern.queries import duck as D
from quern.queries.boundary import folder, sheet_rows
from quern.queries.pages import _bare, _text, pages
from quern.queries.pairs import TURNS_SQL, turns
from quern.queries.texts import documents
from quern.sources import sheets

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "ingest_choice",
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, sha256({D.collapse("lower(text)")}) AS h, CASE WHEN doc_id % 7 > 0 THEN source || ':' || (doc_id // 3) END AS u FROM documents),
      run(n, doc_id, kept, hs, us) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[], []::VARCHAR[] UNION ALL
        SELECT n, doc_id, k, CASE WHEN k THEN list_append(hs, h) ELSE hs END, CASE WHEN k AND u IS NOT NULL THEN list_append(us, u) ELSE us END
        FROM (SELECT d.*, hs, us, NOT (list_contains(hs, h) OR coalesce(list_contains(us, u), false)) AS k FROM run JOIN d ON d.n = run.n + 1))
      SELECT doc_id FROM run WHERE kept""",
)
def ingest_choice(spark, sf_dir):
    """JOB-01, JON-02: documents in order, each kept unless its hash or its address is kept by then; some have no address."""
    address = F.when(F.col("doc_id") % 7 > 0, F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / 3)))
    rows = documents(spark, sf_dir).select("doc_id", T.content_hash("text").alias("h"), address.alias("u"))
    return first_choice(rows, "doc_id", "h", "u", tail=64).select("doc_id")


#: Rows of a part or file that one task writes or reads, on average.
PART_ROWS = 8192


def _uneven(df: DataFrame, order: str, least: int = 6) -> tuple[DataFrame, int]:
    """Written with so many rows to a file, this makes files of different sizes that follow the order of their names.

    The parts grow in number with the rows, so that none is a large share of
    them; a part fills one file and begins another with what is left.
    """
    rows = df.count()
    parts = max(least, -(-rows // PART_ROWS))
    return df.repartitionByRange(parts, order).sortWithinPartitions(order), max(1, 3 * rows // (4 * parts))


@query("sheet_order", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def sheet_order(spark, sf_dir):
    """SRC-11: a sheet in files of different sizes comes back in the order of names and lines."""
    path = folder(spark, "uneven")
    rows, most = _uneven(sheet_rows(spark, sf_dir).withColumn("at", F.col("PSA_ID").cast("long")), "at")
    sheets.write_sheet(rows, path, S.CORPUS, most=most)
    back = sheets.read_sheet(spark, path, S.CORPUS)
    return back.select(F.col("PSA_ID").cast("long").alias("doc_id"), "ord", F.sha2(F.coalesce("English", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("parallel_sheets", f"SELECT id::VARCHAR AS pair_id, sha256(s) AS source_sha256, sha256(t) AS target_sha256, CASE WHEN id % 2 = 0 THEN lang END AS target_lang FROM {TURNS_SQL}")
def parallel_sheets(spark, sf_dir):
    """SRC-14: pair sheets whose headers differ in order and columns, each read by its own."""
    path = folder(spark, "pairs")
    rows = turns(spark, sf_dir).select(F.col("id").cast("string").alias("pair_id"), F.col("s").alias("source_text"), F.col("t").alias("target_text"), F.col("lang").alias("target_lang"), F.col("id"))
    for name, part in (("even", rows.where("id % 2 = 0").drop("id")), ("odd", rows.where("id % 2 <> 0").select("target_text", "pair_id", F.lit("x").alias("unknown"), "source_text"))):
        part.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}")
    back = sheets.read_parallel(spark, f"{path}/*/*.csv")
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    return back.select("pair_id", digest("source_text").alias("source_sha256"), digest("target_text").alias("target_sha256"), "target_lang")


_LINE = D.collapse("text")


@query("bitext_files", f"SELECT n AS line, md5({_LINE}) AS en_md5, md5(upper(lang)) AS sw_md5 FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE {_LINE} <> ''")
def bitext_files(spark, sf_dir):
    """SRC-15: two folders of text files of other sizes each, side by side line by line."""
    docs = documents(spark, sf_dir).select("doc_id", T.collapse("text").alias("en"), F.upper("lang").alias("sw"))
    left, right = folder(spark, "en"), folder(spark, "sw")
    for side, path, least in (("en", left, 6), ("sw", right, 3)):
        rows, most = _uneven(docs.select("doc_id", side), "doc_id", least)
        rows.select(side).write.option("maxRecordsPerFile", most).text(path)
    back = sheets.read_bitext(spark, left, right)
    return back.select("line", F.md5(F.col("en").cast("binary")).alias("en_md5"), F.md5(F.col("sw").cast("binary")).alias("sw_md5"))


_PLAIN = f"trim({D.collapse('regexp_replace(text, ' + D.q('[^!-%(-;=?-~]+') + ', ' + D.q(' ') + ', ' + D.q('g') + ')')}, ' ')"


@query("feed_items", f"SELECT doc_id, title, md5({_PLAIN}) AS text_md5, TIMESTAMP '2026-01-01 07:30:00' + INTERVAL 1 DAY * (doc_id % 28) AS published_at FROM (SELECT *, 'Item ' || doc_id AS title FROM documents) WHERE {D.wc(_PLAIN)} >= 10")
def feed_items(spark, sf_dir):
    """SRC-06: a feed of all documents in five files, more for many documents, with dates in forms that feeds use."""
    plain = T.collapse(F.regexp_replace("text", "[^!-%(-;=?-~]+", " "))
    day, zone = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.element_at(F.array(*map(F.lit, ("07:30:00 GMT", "10:30 +0300", "02:30:00 EST"))), (F.col("doc_id") % 3 + 1).cast("int"))
    when = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("2026-01-"), day, F.lit("T07:30:00Z"))).otherwise(F.concat(F.lit("Wed, "), day, F.lit(" January 2026 "), zone))
    item = F.concat(F.lit("<item><title>Item "), F.col("doc_id"), F.lit("</title><link>https://x/"), F.col("doc_id"), F.lit("</link><description>"), plain, F.lit("</description><pubDate>"), when, F.lit("</pubDate></item>"))
    path = folder(spark, "feed")
    docs = documents(spark, sf_dir)
    n = docs.count()
    parts = max(5, -(-n // PART_ROWS))
    part = F.pmod(F.col("doc_id"), F.lit(parts))
    ends = docs.select(part.alias("part")).distinct().select("part", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("<rss><channel>").alias("value")), F.struct(F.lit(2).alias("at"), F.lit("</channel></rss>").alias("value")))).alias("e"))
    lines = docs.select(part.alias("part"), F.lit(1).alias("at"), item.alias("value")).unionByName(ends.select("part", "e.at", "e.value"))
    lines.repartition(parts, "part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)
    back = sheets.read_feed(spark, f"{path}/part=*", "s", most=n)
    return back.select(F.regexp_extract("source_url", r"(\d+)$", 1).cast("long").alias("doc_id"), "title", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"), "published_at")


def _first(x: str, pattern: str) -> str:
    return f"regexp_extract({x}, {D.q(pattern)}, 1)"


_ARTICLE = _first(_bare("html"), r"(?s)<article>(.*?)</article>")
_NAV = _first(_bare("html"), r"(?s)<nav>(.*?)</nav>")


@query("page_parts", f"SELECT page_id, {_text(_first(_ARTICLE, '(?s)<h1>(.*?)</h1>'))} AS title, sha256({_text(_first(_ARTICLE, '(?s)<p>(.*?)(?:</?p>|$)'))}) AS first_sha256, len(regexp_extract_all({_NAV}, '<a href='))::BIGINT AS links, {_first(_NAV, 'href=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34))} AS first_link, {_text(_first(_bare('html'), '(?s)<div class=' + chr(34) + 'ad' + chr(34) + '>(.*?)</div>'))} AS ad FROM pages")
def page_parts(spark, sf_dir):
    """SRC-02 to 04: selectors of several parts, classes and attributes; a paragraph without end tag ends at the next."""
    tokens = F.col("tokens")
    p = pages(spark, sf_dir).select("page_id", H.page_tokens("html").alias("tokens")).withColumn("links", H.start_tags(tokens, "nav li a[href]"))
    return p.select(
        "page_id", H.first_text(tokens, "body article h1").alias("title"), F.sha2(H.first_text(tokens, "article p", "\n").cast("binary"), 256).alias("first_sha256"), F.size("links").cast("long").alias("links"),
        H.attribute(F.get("links", F.lit(0)), "href").alias("first_link"), H.first_text(tokens, "div.none, body div.ad").alias("ad"),
    )
