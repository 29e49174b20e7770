"""Sheets, logs, feeds and parallel text at the boundary; Parquet within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import schemas as S
from quern.functions.jsonmeta import literal_keys, parse, prefixed
from quern.functions.lexicons import EXTERNAL_FILES
from quern.functions.text import blank_to_null, clean_text, collapse, collapsed_count, collapsed_hash, collapsed_parts, guess_language, join_title, let, normalize_domain, strip, text_or_empty, word_count
from quern.sources.file_order import in_file_order, small

TARGETS = '["Kikuyu"]'
#: Most columns of a sheet.
MOST_COLUMNS = 128


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _records(spark: SparkSession, path: str, names: list[str], multi_line: bool = True) -> DataFrame:
    """``names`` of all sheets of a path, each by its own file's header, with ``ord`` and ``file_``.

    Columns are read by place in one scan, however many headers there are. A
    file's first row names its columns, the first of equal names counting; where
    each of ``names`` stands is worked out once a file and looked up by its rows.
    """
    wide = S.strings(*[f"c{k}" for k in range(MOST_COLUMNS)])
    raw = spark.read.schema(wide).option("header", False).option("multiLine", multi_line).option("escape", '"').csv(path)
    values = raw.select(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(wide.names)]), lambda x: x["v"].isNotNull()).alias("values"))
    rows, headers = in_file_order(values, headers=True)
    place = lambda name: F.get(F.filter("values", lambda x: F.regexp_replace(x["v"], "^\ufeff", "") == name), F.lit(0))["k"]
    headers = headers.select("path_", F.struct(*[place(F.lit(n)).alias(f"p{k}") for k, n in enumerate(names)]).alias("places"))
    value = lambda k: F.get(F.filter("values", lambda x: x["k"] == F.col(f"places.p{k}")), F.lit(0))["v"]
    return rows.join(small(headers), "path_").select(*[value(k).alias(n) for k, n in enumerate(names)], "ord", "file_")


def read_sheet(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """SRC-11: a CSV sheet of text columns by name, with ``ord``; missing columns are null, a missing file is empty.

    ``ord`` counts rows from 0 in the order of file names and lines, however many
    files the sheet has and however they are split. Quoted values may span lines,
    so a file is one task; split big sheets into files, or turn ``multi_line``
    off where no value holds a line break. At most ``MOST_COLUMNS`` columns.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.strings(*schema.names).add("ord", T.LongType()))
    return _records(spark, path, schema.names, multi_line).drop("file_")


def write_sheet(df: DataFrame, path: str, schema: T.StructType, mode: str = "overwrite", most: int = 0) -> None:
    """SNK-01: a CSV sheet of the schema's columns in order; missing ones and nulls are empty, booleans lower case.

    ``most`` rows go to a file, where it isn't 0; a partition's files follow each other by name.
    """
    there = set(df.columns)
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string") if c in there else F.lit(None), F.lit("")).alias(c) for c in schema.names])
    out.write.mode(mode).option("maxRecordsPerFile", most).option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-02/05: JSON lines."""
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """SNK-04: rows added to a log."""
    df.write.mode("append").parquet(path)


def merge_stats(previous: Column, new: Column) -> Column:
    """SNK-03: a stats document with new keys over the previous ones; values keep their kinds, nested ones too.

    A document that is null or no JSON object counts as empty.
    """
    of = lambda c: F.coalesce(F.when(F.json_object_keys(c).isNotNull(), F.from_json(c, "map<string,variant>")), F.from_json(F.lit("{}"), "map<string,variant>"))
    old, more = of(previous), of(new)
    stays = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return F.to_json(F.map_concat(stays, more))


def freeze(df: DataFrame, path: str) -> DataFrame:
    """SNK-08: a version of a table that is written once; an existing one is an error, other names read this one."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_view(notices: DataFrame) -> DataFrame:
    """SNK-07: the active rows as other tools take them, all values as text."""
    return notices.where("status = 'active'").select(*[F.col(c).cast("string").alias(c) for c in S.EXPORT.names])


def fallback(spark: SparkSession, *paths: str) -> str:
    """SRC-18: the first path that exists."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_parallel(spark: SparkSession, pattern: str, psa_only: bool = True, include_external: bool = False) -> DataFrame:
    """SRC-14: all pair sheets of a pattern, each by its own header, with ``_from_file`` and ``ord``; external ones only if asked for."""
    df = _records(spark, pattern, S.PAIRS.names).withColumnRenamed("file_", "_from_file")
    return df.where(~F.col("_from_file").isin(EXTERNAL_FILES)) if psa_only and not include_external else df


def read_bitext(spark: SparkSession, left: str, right: str) -> DataFrame:
    """SRC-15: lines of two text files side by side, none of them blank; ``line`` counts from 1.

    Both sides may be folders of files, which then count as one text in the order
    of their names.
    """

    def lines(path: str, name: str) -> DataFrame:
        placed, _ = in_file_order(spark.read.text(path))
        return placed.select((F.col("ord") + 1).alias("line"), strip("value").alias(name))

    return lines(left, "en").join(lines(right, "sw"), "line").where("en <> '' and sw <> ''")


def bitext_lines(df: DataFrame, left: str, right: str, *carried: str) -> DataFrame:
    """SRC-15 for two columns that hold whole files: ``(line, en, sw)`` up to the shorter one, beside ``carried`` columns."""
    pairs = F.arrays_zip(F.split(left, "\n").alias("en"), F.split(right, "\n").alias("sw"))
    rows = df.select(*carried, F.posexplode(pairs).alias("line", "p")).select(*carried, (F.col("line") + 1).alias("line"), strip("p.en").alias("en"), strip("p.sw").alias("sw"))
    return rows.where("en <> '' and sw <> ''")


# Fixed values of the standard for dates in mail and feeds: zones by name.
_ZONES = {"UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_MAIL_DATE = r"(?i)\b(\d{1,2})[ -]+([a-z]{3})[a-z]*\.?[ -]+(\d{4}|\d{2})[ ,]+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([+-]\d{2}):?(\d{2})|\s+([a-z]+))?"


def feed_date(c) -> Column:
    """SRC-06: the moment of a feed's date, of mail's form or ISO 8601; null for anything else.

    Weekday and seconds may be missing, months may be whole words, years of two
    digits are of 1970 to 2069. A zone that is missing or not known is UTC.
    """
    c = strip(c)
    part = lambda k: F.regexp_extract(c, _MAIL_DATE, k)
    month = (F.instr(F.lit(_MONTHS), F.initcap(part(2))) + 2) / 3
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(F.concat(F.when(part(3) < "70", "20").otherwise("19"), part(3)))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in _ZONES.items() for x in kv]), F.upper(part(9)))
    zone = F.when(part(7) != "", F.concat(part(7), F.lit(":"), part(8))).otherwise(F.coalesce(named, F.lit("+00:00")))
    two = lambda x: F.lpad(x, 2, "0")
    mail = F.concat(year, F.lit("-"), two(month.cast("int").cast("string")), F.lit("-"), two(part(1)), F.lit("T"), two(part(4)), F.lit(":"), part(5), F.lit(":"), F.when(part(6) != "", part(6)).otherwise("00"), zone)
    iso = F.regexp_replace(F.regexp_replace(c, r"(?<=[T ]\d{2}:\d{2}.{0,10})([+-]\d{2})(\d{2})$", "$1:$2"), "Z$", "+00:00")
    return F.when(c.rlike(_MAIL_DATE), F.try_to_timestamp(mail)).when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(iso))


def read_feed(spark: SparkSession, path: str, source_id: str, most: int = 50, least: int = 10) -> DataFrame:
    """SRC-06: items of RSS files: text without tags, of ``least`` words or more.

    ``most`` keeps the first entries in the order of files and of their lines,
    blank or not.
    """
    from quern.functions.html import html_to_text, title_or_default

    schema = "title string, link string, description string, summary string, pubDate string"
    raw, _ = in_file_order(spark.read.format("xml").option("rowTag", "item").schema(schema).load(path))
    text = html_to_text(F.coalesce(blank_to_null(F.col("summary")), F.col("description")))
    items = raw.where(F.col("ord") < most).select(
        F.lit(source_id).alias("source_id"), F.col("link").alias("source_url"), title_or_default("title").alias("title"), F.lit(None).cast("string").alias("raw_html"), text.alias("raw_text"),
        feed_date("pubDate").alias("published_at"),
    )
    return items.where(word_count("raw_text") >= least)


def read_pages(pages: DataFrame, source_id: str, title: str = "h1", body: str = "article", date: str = "time", most: int = 50, least: int = 10) -> DataFrame:
    """SRC-01: items of fetched pages ``(url, html)``: selected title and body of ``least`` words or more.

    The date is what the selected element's ``datetime`` attribute says, null if that is no date.
    """
    from quern.functions.html import body_text, first_attribute, first_text, page_tokens, title_or_default

    tokens = F.col("tokens_")
    when = F.try_to_timestamp(F.regexp_replace(first_attribute(tokens, date, "datetime"), "Z$", "+00:00"))
    return pages.withColumn("tokens_", page_tokens("html")).select(
        F.lit(source_id).alias("source_id"), F.col("url").alias("source_url"), title_or_default(first_text(tokens, title)).alias("title"),
        F.lit(None).cast("string").alias("raw_html"), body_text(tokens, body).alias("raw_text"), when.alias("published_at"),
    ).where(word_count("raw_text") >= least)


def no_items(spark: SparkSession) -> DataFrame:
    """SRC-07: the adapter of manual uploads has none."""
    return spark.createDataFrame([], S.RAW_ITEM)


#: SRC-08: readers by name; an application may add its own.
ADAPTERS = {"generic_html": read_pages, "rss": read_feed, "manual_upload": no_items}


def adapter(name: str):
    """SRC-08: the reader of a name; ValueError if there is none."""
    if name not in ADAPTERS:
        raise ValueError(f"unknown adapter: {name}")
    return ADAPTERS[name]


def listing_urls(config: dict) -> list[str]:
    """SRC-01: addresses of a source's listing pages; the first is bare."""
    base, param = config["listing_url"], config.get("page_param", "page")
    return [base if k == 0 else f"{base}{'&' if '?' in base else '?'}{param}={k}" for k in range(max(1, config.get("max_listing_pages", 1)))]


def source_defaults(sources: DataFrame) -> DataFrame:
    """SRC-09: registry rows with their defaults filled in."""
    defaults = {"country": F.lit("Kenya"), "trust_score": F.lit(80), "priority": F.lit("medium"), "adapter": F.lit("generic_html"), "active": F.lit(True), "primary_language": F.lit("en")}
    for c, v in defaults.items():
        sources = sources.withColumn(c, F.coalesce(c, v) if c in sources.columns else v)
    return sources


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SRC-09: stored rows that aren't named again, and the new ones."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


# --- Contributors' sheets in the canonical columns (SRC-12) ---------------------------------------


def _long_versions(english, kiswahili, least: int = 8) -> Column:
    """Both versions and what is said of the longer one, the first on a tie, in an array; an empty one unless either has ``least`` words.

    All of it is one value, made once and exploded, since a filter of rows would have their texts cleaned and counted again.
    """
    sized = lambda t: F.struct(t["text"].alias("text"), t["flat"].alias("flat"), collapsed_count(t["flat"]).alias("n"))
    version = lambda c: let(let(clean_text(c), lambda t: F.struct(t.alias("text"), collapse(t).alias("flat"))), sized)
    said = lambda b, m: F.struct(b["en"].alias("en"), b["sw"].alias("sw"), guess_language(m["text"]).alias("lang"), m["n"].alias("n"), collapsed_parts(m["flat"]).alias("parts"), collapsed_hash(m["flat"]).alias("hash"))
    long = F.filter(F.array(F.struct(version(english).alias("en"), version(kiswahili).alias("sw"))), lambda b: (b["en"]["n"] >= least) | (b["sw"]["n"] >= least))
    return F.transform(long, lambda b: let(F.when(b["en"]["n"] >= b["sw"]["n"], b["en"]).otherwise(b["sw"]), lambda m: said(b, m)))


def canonical(df: DataFrame, psa_id, domain, english, kiswahili, source, date, fixed: dict[str, Column], extra: Column | None = None, targets: Column | None = None) -> DataFrame:
    """Rows with eight words in either language; metadata gets language, counts and hash where it has none."""
    rows = df.select(
        "ord", psa_id.alias("PSA_ID"), normalize_domain(domain).alias("Domain"), F.explode(_long_versions(english, kiswahili)).alias("v_"),
        (targets if targets is not None else F.lit(TARGETS)).alias("Target Languages"), text_or_empty(source).alias("Source"), text_or_empty(date).alias("Date"),
        *[v.alias(f"m_{k}") for k, v in fixed.items()], (extra if extra is not None else F.create_map().cast("map<string,string>")).alias("m_extra_"),
    )
    rows = rows.select("*", F.col("v_.en.text").alias("English"), F.col("v_.sw.text").alias("Kiswahili"))
    own = F.struct(
        *[F.col(f"m_{k}").alias(k) for k in fixed], F.coalesce(F.col("v_.lang"), F.lit("unknown")).alias("lang_detected"), F.col("v_.n").alias("token_count"),
        F.col("v_.parts").alias("sentence_count"), F.col("v_.hash").alias("content_hash"),
    )
    whole = F.to_json(own, {"ignoreNullFields": "false"})
    more = F.to_json("m_extra_")
    meta = F.when(F.size("m_extra_") > 0, F.concat(F.expr("substr(w_, 1, length(w_) - 1)"), F.lit(","), F.substring(more, F.lit(2), F.length(more)))).otherwise(F.col("w_"))
    return rows.withColumn("w_", whole).withColumn("Metadata", meta).select("ord", *S.CORPUS.names)


def _origin(contributor: str, file: str, schema: str, **more: Column) -> dict[str, Column]:
    return {"contributor": F.lit(contributor), "origin_file": F.lit(file), **more, "source_schema": F.lit(schema)}


def load_export(df: DataFrame, contributor: str, file: str) -> DataFrame:
    """SRC-12a: title and body; the export's own metadata under ``src_``."""
    english = strip(join_title(clean_text("title"), clean_text("text")))
    fixed = _origin(contributor, file, "all_psa_export", origin_psa_id=F.col("psa_id"), organization=F.col("organization"), urgency=F.col("urgency"), language=F.col("language"))
    ids = F.coalesce(blank_to_null(F.col("psa_id")), F.format_string("GOV_%05d", F.col("ord") + 1))
    return canonical(df, ids, F.coalesce(blank_to_null(F.col("domain")), F.lit("governance")), english, F.lit(""), F.col("source_url"), F.col("published_at"), fixed, prefixed(parse("metadata"), "src_"))


def load_education(df: DataFrame, contributor: str, file: str) -> DataFrame:
    """SRC-12b."""
    fixed = _origin(
        contributor, file, "psa_dataset_final", origin_psa_id=F.col("PSA_ID"), sub_category=F.col("Sub_Category"), urgency=F.col("Urgency"), audience=F.col("Audience"),
        psa_score=F.col("psa_score"), lang_detected_source=F.col("lang_detected"),
    )
    return canonical(df, text_or_empty("PSA_ID"), F.coalesce(blank_to_null(F.col("Domain")), F.lit("Education")), F.col("English"), F.col("Kiswahili"), F.col("Source"), F.col("Date"), fixed)


def _source_metadata() -> Column:
    return F.when(F.json_object_keys("Metadata").isNotNull(), F.create_map(F.lit("source_metadata"), F.col("Metadata"))).when(blank_to_null(F.col("Metadata")).isNotNull(), F.create_map(F.lit("source_metadata_raw"), F.col("Metadata"))).otherwise(F.create_map().cast("map<string,string>"))


def load_agriculture(df: DataFrame, contributor: str, file: str) -> DataFrame:
    """SRC-12c: JSON metadata or its raw text; targets from a dictionary's keys."""
    targets = F.to_json(F.array_distinct(F.concat(literal_keys("Target_Languages"), F.array(F.lit("Kikuyu")))))
    fixed = _origin(contributor, file, "agriculture_psa_export", origin_psa_id=F.col("PSA_ID"), organization=F.col("Org"))
    return canonical(df, text_or_empty("PSA_ID"), F.coalesce(blank_to_null(F.col("Domain")), F.lit("Agriculture")), F.col("English"), F.col("Kiswahili"), F.col("Source"), F.col("Date"), fixed, _source_metadata(), targets)


def load_media(df: DataFrame, contributor: str, file: str) -> DataFrame:
    """SRC-12d: no dates; metadata that isn't JSON stays as text."""
    fixed = _origin(contributor, file, "media_archives", origin_psa_id=F.col("PSA_ID"))
    return canonical(df, text_or_empty("PSA_ID"), F.coalesce(blank_to_null(F.col("Domain")), F.lit("Governance")), F.col("English"), F.col("Kiswahili"), F.col("Source"), F.lit(""), fixed, _source_metadata())


def load_raw_text(df: DataFrame, contributor: str, file: str, prefix: str) -> DataFrame:
    """SRC-12e: cleaned or raw text, ids by place with the contributor's prefix."""
    english = F.coalesce(blank_to_null(F.col("cleaned_text")), F.col("raw_text"))
    return canonical(df, F.format_string(prefix + "_%05d", F.col("ord") + 1), F.lit("Governance"), english, F.lit(""), F.col("source_url"), F.lit(""), _origin(contributor, file, "psa_dataset_raw_text"))
