"""Pairs of like titles of the same date, exact and without all pairs of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.stage_table import stage_table
from quern.sources.file_order import small

#: Letters of a group.
ORDER = 3


def _groups(title: Column) -> Column:
    """Different groups of letters of a title."""
    places = F.when(F.length(title) >= ORDER, F.sequence(F.lit(1), F.length(title) - ORDER + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(title, i, F.lit(ORDER))))


def like_titles(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``date, l_title, r_title, score`` of all pairs of different ``(date, title)`` rows that are as like as ``least``.

    The score is 1 minus the Levenshtein distance by the longer title's length,
    at least 1. Titles that reach ``least`` differ in length by a known share, so
    each has a largest distance d from any partner. A change of one letter
    touches ``ORDER`` groups, so of two such titles the first ``ORDER * d + 1``
    groups in any common order, here the rarest first, share one (Xiao, Wang &
    Lin 2008); pairs are made of titles with such a group in common. A title with
    too few groups for that meets all of a fitting length, by a word for the
    length. So the largest date is dealt out by its titles' rare groups, and all
    pairs of a date are made only where ``least`` lets everything through.
    """
    if not 0 < least <= 1:
        raise ValueError("titles are like each other to a share above 0, up to 1")
    sides = {}
    for name, df in (("l", left), ("r", right)):
        d = F.floor((1 - least) * F.floor(F.length("title") / least + 1e-9) + 1e-9).cast("int")
        rows = df.where(F.col("date").isNotNull() & F.col("title").isNotNull()).select("date", "title").distinct()
        sides[name] = stage_table(rows.withColumn("groups", _groups(F.col("title"))).withColumn("most", d * ORDER + 1).withColumn("n", F.length("title")), "titles")
    both = sides["l"].select("groups").unionByName(sides["r"].select("groups"))
    uses = stage_table(both.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("uses")), "groups")
    short = F.size("groups") < F.col("most")

    def words(name: str, other: str) -> DataFrame:
        """The words by which a side's titles may meet the other's."""
        rows = sides[name]
        rare = rows.where(~short).select("date", "title", "most", F.explode("groups").alias("g")).join(small(uses), "g")
        rare = rare.groupBy("date", "title", "most").agg(F.sort_array(F.collect_list(F.struct("uses", "g"))).alias("gs"))  # a title's own groups
        by_group = rare.select("date", "title", F.explode(F.slice("gs.g", F.lit(1), F.col("most"))).alias("word"))
        of_length = lambda side, n: F.concat(F.lit(f"{side}:"), n.cast("string"))
        own = rows.where(short).select("date", "title", of_length(name, F.col("n")).alias("word"))
        lengths = sides[other].where(short).select(F.col("n").alias("m")).distinct()  # as many as titles have letters at the most
        fits = F.col("m").between(F.ceil(F.col("n") * least - 1e-9), F.floor(F.col("n") / least + 1e-9))
        met = rows.join(F.broadcast(lengths), fits).select("date", "title", of_length(other, F.col("m")).alias("word"))
        return by_group.unionByName(own).unionByName(met)

    a, b = (words("l", "r").withColumnRenamed("title", "l_title"), words("r", "l").withColumnRenamed("title", "r_title"))
    fit = F.least(F.length("l_title"), F.length("r_title")) >= F.greatest(F.length("l_title"), F.length("r_title")) * least - 1e-9
    pairs = a.join(b, ["date", "word"]).where(fit).select("date", "l_title", "r_title").distinct()
    longer = F.greatest(F.length("l_title"), F.length("r_title"), F.lit(1))
    score = F.lit(1.0) - F.levenshtein("l_title", "r_title") / longer
    return pairs.withColumn("score", score).where(F.col("score") >= least)
