"""Joins that stand for set and dictionary look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import content_hash, dedup_key
from quern.operators.ranking import keep_first


def not_known(items: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """JON-01/02: items none of whose ``columns`` equals a known one; each by an anti join of its own."""
    for c in columns:
        items = items.join(known.select(F.col(c)).where(F.col(c).isNotNull()).distinct(), c, "left_anti")
    return items


def seen_keys(*texts: DataFrame) -> DataFrame:
    """SET-02: distinct dedup keys of one-column frames of texts, none empty."""
    keys = [t.select(dedup_key(F.col(t.columns[0])).alias("key")) for t in texts]
    out = keys[0]
    for k in keys[1:]:
        out = out.union(k)
    return out.where("key <> ''").distinct()


def seen_digests(*texts: DataFrame) -> DataFrame:
    """SET-02 by 64 characters a text: distinct digests of dedup keys, also that of an empty one, which rows leave out themselves."""
    # Never null, as a test for nulls would make each key again.
    keys = [t.select(F.coalesce(content_hash(F.col(t.columns[0])), F.lit("")).alias("key")) for t in texts]
    return reduce(DataFrame.union, keys).distinct()


def first_decides(rows: DataFrame, seen: DataFrame, *order) -> DataFrame:
    """JON-03: of each unseen ``key`` the first row, whether or not it passes later rules."""
    return keep_first(rows.where("key <> ''").join(seen, "key", "left_anti"), "key", *order)


def first_passing(rows: DataFrame, seen: DataFrame, reason: str, *order) -> DataFrame:
    """JON-04: of each unseen ``key`` the first row without a reason against it."""
    return keep_first(rows.where((F.col("key") != "") & F.col(reason).isNull()).join(seen, "key", "left_anti"), "key", *order)


def with_split(rows: DataFrame, splits: DataFrame, id_col: str) -> DataFrame:
    """JON-05: each row's split, empty without one; of several the later of train, dev, test."""
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2)
    last = splits.groupBy(id_col).agg(F.max(F.struct(rank.alias("r"), F.col("split"))).alias("s")).select(id_col, F.col("s.split").alias("split"))
    return rows.join(last, id_col, "left").withColumn("split", F.coalesce("split", F.lit("")))


def with_flag(rows: DataFrame, members: DataFrame, id_col: str, flag: str) -> DataFrame:
    """JON-06: whether a row's id is among the members."""
    own = members.select(F.col(id_col)).distinct().withColumn(flag, F.lit(True))
    return rows.join(own, id_col, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def last_value(rows: DataFrame, keys: list[str], value: str, *order) -> DataFrame:
    """JON-08: the value of the last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def positional(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """JON-10: rows of equal place side by side, as many as the shorter side has."""
    from quern.operators.ranking import dense_number

    return dense_number(left, "line", left_order).join(dense_number(right, "line", right_order), "line")


def for_each(rows: DataFrame, values: list[str], out: str) -> DataFrame:
    """JON-12: every row for every value, by an explode in place."""
    return rows.withColumn(out, F.explode(F.array(*map(F.lit, values))))


def aligned_versions(en: DataFrame, sw: DataFrame, least: float = 0.85) -> DataFrame:
    """JON-13: versions of one notice: the same address but for its language part, or the same date and a like title.

    Both frames have ``id, url, date, title``. Titles compare by Levenshtein
    distance against the longer one, within equal dates only, different titles
    once each, and without all pairs of a date (:func:`like_titles`).
    """
    from quern.operators.title_join import like_titles

    bare = lambda c: F.regexp_replace(F.lower(c), r"/(en|sw)(/|$)", "/*$2")
    e = en.select(F.col("id").alias("en_id"), bare(F.col("url")).alias("u"), F.col("date").alias("en_date"), F.lower("title").alias("en_title"))
    s = sw.select(F.col("id").alias("sw_id"), bare(F.col("url")).alias("v"), F.col("date").alias("sw_date"), F.lower("title").alias("sw_title"))
    by_url = e.join(s, e["u"] == s["v"]).select("en_id", "sw_id", F.lit("url_match").alias("method"), F.lit(1.0).alias("score"))
    like = like_titles(e.select(F.col("en_date").alias("date"), F.col("en_title").alias("title")), s.select(F.col("sw_date").alias("date"), F.col("sw_title").alias("title")), least)
    by_title = e.join(like, (F.col("en_date") == F.col("date")) & (F.col("en_title") == F.col("l_title"))).join(s, (F.col("sw_date") == F.col("date")) & (F.col("sw_title") == F.col("r_title")))
    by_title = by_title.select("en_id", "sw_id", F.lit("date_title_fuzzy").alias("method"), "score")
    both = by_url.union(by_title)
    return both.groupBy("en_id", "sw_id").agg(F.max("method").alias("method"), F.max("score").alias("score"))


def with_source(rows: DataFrame, sources: DataFrame, key: str, source_key: str) -> DataFrame:
    """JON-09: rows with what their source says; an unknown source is an error, a null one too."""
    found = rows.join(sources.withColumn("known_", F.lit(True)), F.col(key) == F.col(source_key), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(dict(rows.dtypes)[key])
    checked = F.when(F.col("known_"), F.col(key)).otherwise(unknown).alias(key)
    # The other columns hang on the check, so that it isn't pruned away.
    return found.where(F.col("known_") | unknown.isNotNull()).select(*[checked if c == key else F.col(c) for c in found.columns if c != "known_"])


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """JON-14: child rows whose key has no parent."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
