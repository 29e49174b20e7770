"""Mixing of sources to target weights by cuts in a hash order.

Method: every document gets a hash-random key; within each source, documents
are put in the order of their keys and their word counts are summed up in a
distributed prefix sum; a source is taken as many whole times as its budget
holds, and once more up to the cut at the rest of the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.prefix_sums import exclusive_sums, hash_key
from quern.plans.stage_table import stage_table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Sources up to which their cuts are broadcast.
SMALL = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size)`` -> ``(source, source_size, target)``.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; no target passes ``most`` times its source, and
    what is left over is shared again by weight. In the order of the level at
    which sources fill up, the levels of the rest rise while sources fill up and
    fall from then on, so the last level is the highest one.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - filled) / left
    return ranked.withColumn("level", level).select("source", "source_size", F.least("cap", F.col("weight") * F.max("level").over(everything)).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_, keep_*, source, size, key`` of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id_"), *[F.col(c).alias(f"keep_{c}") for c in keep], F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        hash_key(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary"))).alias("key"),
    )


def _named(df: DataFrame) -> DataFrame:
    """Null sources as a group of their own that joins."""
    return df.withColumn("none_", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))


def _placed(sized: DataFrame) -> DataFrame:
    """Adds ``source_size, target``, the whole times ``whole`` that a source is taken, and ``cut``: whether a row is taken once more."""
    sized = stage_table(sized, "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = exclusive_sums(_named(sized), ["none_", "source"], "key", "size", "before", sized.count())
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    cut = (F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * rest)
    return placed.join(_named(targets), ["none_", "source"]).withColumn("whole", whole.cast("long")).withColumn("cut", cut)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id_col, *keep, size, source_size, target, epochs, taken``.

    The size is the number of words of ASCII white space; null, empty and blank
    texts have size 0 and are never taken. ``epochs`` says how many times the
    mix takes the document, ``taken`` is that many sizes. The document on which
    the cut falls is taken if its middle lies before it, so a source misses its
    target by half a document at most. Keys depend on id and text alone, so
    reruns agree; equal rows share a key and are taken in any order. Other
    columns are ignored unless named in ``keep``.
    """
    out = _placed(_sized(docs, id_col, text_col, source_col, keep))
    out = out.withColumn("epochs", F.when(F.col("size") > 0, F.col("whole") + F.col("cut").cast("long")).otherwise(F.lit(0)).cast("long"))
    return out.select(F.col("id_").alias(id_col), *[F.col(f"keep_{c}").alias(c) for c in keep], "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as many times as :func:`mix_sources` takes it, all columns kept.

    Only sizes and keys are shuffled. What they decide is one cut in the order
    of the keys for each source, by which the documents are judged in place;
    equal rows at a cut share its side. Cuts of up to ``SMALL`` sources are
    broadcast, more are joined by a shuffle. Null, empty and blank texts are never
    taken, an empty table gives an empty one, a very long text costs its hash and
    its words once; whatever the columns are called, none is touched.
    """
    cuts = _placed(_sized(docs, id_col, text_col, source_col)).groupBy("none_", F.col("source").alias("source_")).agg(F.first("whole").alias("whole_"), F.max(F.when(F.col("cut"), F.col("key"))).alias("cut_"))
    cuts = stage_table(cuts.withColumnRenamed("none_", "none_of_"), "cuts")
    few = cuts.count() <= SMALL
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = hash_key(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary")))
    # The documents' own columns go as one, so no name of theirs meets one of these.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    own = docs.select(whole, key.alias("key"), F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), text.rlike(r"[^\x20\x09-\x0D]").alias("words"))
    out = own.join(F.broadcast(cuts) if few else cuts, (F.col("none") == F.col("none_of_")) & (F.col("source") == F.col("source_")))
    times = F.when(F.col("words"), F.col("whole_") + F.coalesce(F.col("key") <= F.col("cut_"), F.lit(False)).cast("long")).otherwise(F.lit(0))
    out = out.withColumn("times", times.cast("int")).where("times > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
