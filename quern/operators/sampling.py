"""Stratified samples and splits; sizes are the reference ones, membership follows a seeded hash order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix_sums import KEY_BITS, exclusive_sums
from quern.operators.ranking import shuffle_key

#: Strata whose sizes may be collected for an allocation.
MOST_GROUPS = 100_000


def group_key(key: str) -> Column:
    """The stratum of a row, ``Unknown`` for a null or empty one."""
    return F.when(F.col(key).isNotNull() & (F.col(key).cast("string") != ""), F.col(key).cast("string")).otherwise("Unknown")


def levelled(values: np.ndarray, target: int, floor: int) -> np.ndarray:
    """``values`` with the largest one lowered by 1, of equal ones the first, until they sum up to ``target`` or none is above ``floor``.

    The level that this ends at is searched for: all above it come down to it, and
    the first ones of these by one more.
    """
    if values.sum() <= target or not len(values):
        return values
    low, high = floor, max(int(values.max()), floor)
    while low < high:  # the lowest level that leaves the target or more
        level = (low + high) // 2
        low, high = (low, level) if np.minimum(values, level).sum() >= target else (level + 1, high)
    out = np.minimum(values, np.maximum(low, floor)) if low > floor else np.where(values > floor, floor, values)
    more = int(out.sum()) - target
    if low > floor and more > 0:
        out[np.flatnonzero(values >= low)[:more]] -= 1
    return out


def allocate(sizes: dict[str, int], n: int, least: int = 10) -> dict[str, int]:
    """SMP-01: rows for each stratum: its share, at least ``least``, corrected to ``n``.

    Rows too many are taken one by one from the stratum that has most, but not its
    last; rows too few are given to the one that leaves most out; of equal strata
    the first by name. What this comes to is worked out by :func:`levelled`.
    """
    groups = sorted(sizes)
    have = np.array([sizes[g] for g in groups], np.int64)
    total = int(have.sum())
    out = np.array([min(sizes[g], max(least, round(sizes[g] / total * n))) for g in groups], np.int64)
    out = levelled(out, n, 1)
    left = have - out
    out = have - levelled(left, int(left.sum()) - max(n - int(out.sum()), 0), 0)
    return dict(zip(groups, out.tolist(), strict=True))


def stratified_sample(df: DataFrame, n: int, id_col: str, key: str, seed: int = 42, least: int = 10) -> DataFrame:
    """SMP-01: ``n`` rows (all, if there are no more) in shares of the strata.

    Sizes of at most ``MOST_GROUPS`` strata are collected for the allocation;
    more are an error.
    """
    if n <= 0:
        return df.limit(0)
    sizes = {r["g"]: r["n"] for r in df.groupBy(group_key(key).alias("g")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_GROUPS + 1).collect()}
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} strata")
    if n >= sum(sizes.values()):
        return df
    alloc = allocate(sizes, n, least)
    table = df.sparkSession.createDataFrame(list(alloc.items()), "stratum_ string, alloc_ int")
    return _ranked(df, id_col, key, seed).join(F.broadcast(table), "stratum_").where("rank_ <= alloc_").drop("stratum_", "alloc_", "rank_")


def _ranked(df: DataFrame, id_col: str, key: str, seed: int) -> DataFrame:
    return _shuffled(df.withColumn("stratum_", group_key(key)), ["stratum_"], id_col, seed)


def _shuffled(df: DataFrame, group: list[str], id_col: str, seed: int) -> DataFrame:
    """Adds ``rank_`` from 1 in the order of the shuffle's hashes; a group of most rows is ranked in many tasks."""
    hashed = shuffle_key(seed, id_col)
    df = df.withColumn("md5_", hashed).withColumn("key_", F.conv(F.substring(hashed, 1, KEY_BITS // 4), 16, 10).cast("long")).withColumn("one_", F.lit(1).cast("long"))
    return exclusive_sums(df, group, "key_", "one_", "rank_", ties=("md5_", id_col)).withColumn("rank_", F.col("rank_") + 1).drop("md5_", "key_", "one_")


def split_sizes(n: Column, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> Column:
    """SMP-02: struct (train, dev) of a stratum of ``n`` rows; the rest is test.

    Small strata give up a row of a larger part for an empty test or dev set.
    """
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"ratios must sum to 1.0, got {ratios}")
    train, dev = F.floor(n * F.lit(ratios[0])), F.floor(n * F.lit(ratios[1]))
    short = (n >= 3) & (n - train - dev == 0)
    train2 = F.when(short & (train > dev), train - 1).otherwise(train)
    dev2 = F.when(short & (train <= dev), F.greatest(F.lit(0), dev - 1)).otherwise(dev)
    none = (n >= 2) & (dev2 == 0) & (train2 > 1)
    return F.struct(F.when(none, train2 - 1).otherwise(train2).alias("train"), F.when(none, F.lit(1)).otherwise(dev2).alias("dev"))


def stratified_split(df: DataFrame, id_col: str, key: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """SMP-02: adds ``split``: train, dev or test in the ratios within each stratum."""
    ranked = _ranked(df, id_col, key, seed)
    sizes = df.groupBy(group_key(key).alias("stratum_")).agg(F.count(F.lit(1)).alias("n_")).withColumn("cut_", split_sizes(F.col("n_"), ratios)).drop("n_")
    split = F.when(F.col("rank_") <= F.col("cut_.train"), "train").when(F.col("rank_") <= F.col("cut_.train") + F.col("cut_.dev"), "dev").otherwise("test")
    return ranked.join(sizes, "stratum_").withColumn("split", split).drop("stratum_", "rank_", "cut_")


def validation_set(df: DataFrame, n: int, id_col: str, key: str, seed: int = 42) -> DataFrame:
    """SMP-03: ``n`` rows of a split frame: from test and dev, filled up from train where these are too few."""
    held = df.where("split in ('test', 'dev')")
    there = held.count()
    if there >= n:
        return stratified_sample(held, n, id_col, key, seed)
    return held.unionByName(stratified_sample(df.where("split = 'train'"), n - there, id_col, key, seed + 1))


def pair_split_sizes(n: Column, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> Column:
    """SMP-04: struct (train, dev) of a language's ``n`` pairs; from 10 on, no part stays empty."""
    train, dev = F.floor(n * F.lit(ratios[0])), F.floor(n * F.lit(ratios[1]))
    short = (n >= 10) & (n - train - dev == 0) & (train > 0)
    train2 = train - short.cast("int")
    none = (n >= 10) & (dev == 0) & (train2 > 0)
    return F.struct((train2 - none.cast("int")).alias("train"), (dev + none.cast("int")).alias("dev"), short.alias("stole_test"), none.alias("stole_dev"))


def pair_split(df: DataFrame, id_col: str, language: str = "target_lang", ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """SMP-04: adds ``split`` within each target language."""
    named = df.withColumn("none_", F.col(language).isNull()).withColumn("group_", F.coalesce(F.col(language).cast("string"), F.lit("")))
    ranked = _shuffled(named, ["none_", "group_"], id_col, seed).drop("none_", "group_")
    sizes = df.groupBy(F.col(language).alias("lang_")).agg(F.count(F.lit(1)).alias("n_")).withColumn("cut_", pair_split_sizes(F.col("n_"), ratios)).drop("n_")
    split = F.when(F.col("rank_") <= F.col("cut_.train"), "train").when(F.col("rank_") <= F.col("cut_.train") + F.col("cut_.dev"), "dev").otherwise("test")
    return ranked.join(sizes, F.col(language).eqNullSafe(F.col("lang_"))).withColumn("split", split).drop("rank_", "cut_", "lang_")


def domain_bag(counts: DataFrame, ideal: dict[str, float]) -> DataFrame:
    """SMP-05: ``(domain, slot)``: a slot for each hundredth that a domain lacks of its ideal share, one at least.

    ``counts`` has ``domain, n``.
    """
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(d, i, v) for i, (d, v) in enumerate(ideal.items())], "domain string, ord int, ideal double")
    total = counts.agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    rows = wanted.join(counts, "domain", "left").crossJoin(F.broadcast(total))
    gap = F.greatest(F.lit(0.01), F.col("ideal") - F.coalesce("n", F.lit(0)) / F.coalesce("total", F.lit(1)))
    rows = rows.withColumn("weight", F.greatest(F.lit(1), F.floor(gap * 100).cast("int")))
    return rows.select("domain", "ord", F.explode(F.sequence(F.lit(1), F.col("weight"))).alias("slot"))
