"""Languages by learned profiles: log-probabilities of the letter groups within words (Cavnar & Trenkle 1994; Dunning 1994)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import text_or_empty

#: Letters of a group, groups of a profile.
ORDER, MOST = 3, 3000
#: Characters of a text that are looked at, words it must have, and share of its groups that the profile must know.
SAMPLE, LEAST_WORDS, LEAST_KNOWN = 2000, 5, 0.5


def _words(c) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"\p{L}+"), F.lit(0))


def _groups(word: Column, order: int) -> Column:
    """Groups of letters of a word with a space at either end."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) + 3 - order, F.lit(1))), lambda i: F.substring(padded, i, F.lit(order)))


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, most: int = MOST) -> DataFrame:
    """``group_, language, logp``: of the ``most`` groups that are most frequent over all, what each language gives them.

    Words are counted first, over all rows, so that only different words are cut
    into groups. A group that a language lacks has half a count there. Rows
    without a language teach nothing; no rows give no profile. The result has
    ``most`` rows for each language.
    """
    words = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("language"), F.explode(_words(text_col)).alias("word"))
    counted = words.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    groups = counted.select("language", F.explode(_groups(F.col("word"), order)).alias("group_"), "n").groupBy("language", "group_").agg(F.sum("n").alias("n"))
    frequent = groups.groupBy("group_").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "group_").limit(most).select("group_")
    totals = groups.groupBy("language").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    each = F.broadcast(frequent).crossJoin(F.broadcast(totals))  # ``most`` groups, a row for each language
    logp = F.log((F.coalesce("n", F.lit(0)) + 0.5) / (F.col("total") + 0.5 * F.col("kinds")))
    return each.join(groups, ["language", "group_"], "left").select("group_", "language", logp.alias("logp"))


def detect_languages(docs: DataFrame, profiles: DataFrame, id_col: str, text_col: str = "text", order: int = ORDER, least_words: int = LEAST_WORDS, least_known: float = LEAST_KNOWN) -> DataFrame:
    """TXT-17/18: ``id_col, language, known``: the language with the largest sum over the first ``SAMPLE`` characters' groups.

    ``unknown`` with fewer than ``least_words`` words or where the profile knows
    less than ``least_known`` of the groups, as with text of another script or
    none at all; ties go to the first by name. Groups meet the profile by a
    broadcast join, as a profile's size is a parameter of learning it; each row's
    sums are put together where the row lies. Ids must tell rows apart.
    """
    by_group = profiles.groupBy("group_").agg(F.sort_array(F.collect_list(F.struct("language", "logp"))).alias("p"))
    rows = docs.select(F.col(id_col).alias("id_"), _words(F.substring(text_or_empty(text_col), 1, SAMPLE)).alias("words"))
    cut = rows.select("id_", F.size("words").alias("n"), F.explode_outer(F.flatten(F.transform("words", lambda w: _groups(w, order)))).alias("group_"))
    met = cut.join(F.broadcast(by_group), "group_", "left").select("id_", "n", "group_", F.explode_outer("p").alias("p"))
    sums = met.groupBy("id_", "n", F.col("p.language").alias("language")).agg(F.sum("p.logp").alias("sum"), F.count("group_").alias("groups"))
    # Of each row's few sums the largest, of equal ones the first by name.
    one = F.struct((-F.col("sum")).alias("down"), "language")
    best = sums.groupBy("id_", "n").agg(F.min(F.when(F.col("language").isNotNull(), one)).alias("best"), F.max(F.when(F.col("language").isNotNull(), F.col("groups"))).alias("met"), F.max(F.when(F.col("language").isNull(), F.col("groups"))).alias("unmet"))
    met_, all_ = F.coalesce("met", F.lit(0)), F.coalesce("met", F.lit(0)) + F.coalesce("unmet", F.lit(0))
    known = F.when(all_ > 0, met_ / all_).otherwise(0.0)
    language = F.when((F.col("n") >= least_words) & (known >= least_known), F.col("best.language")).otherwise("unknown")
    return best.select(F.col("id_").alias(id_col), language.alias("language"), known.alias("known"))
