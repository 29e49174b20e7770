"""DataFrame operators: order, sizes and counts on small tables."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import jsonmeta as J
from quern.operators import lookups as JN
from quern.operators import ranking as K
from quern.operators import sampling as SM
from quern.operators import statistics as ST
from quern.operators.translation_metrics import corpus_bleu, corpus_chrf


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_keep_first_and_numbers(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (9, "c")], "ord int, k string")
    assert rows(K.keep_first(df, "k", "ord")) == [(1, "a"), (2, "b"), (9, "c")]
    assert rows(K.keep_first(K.keep_first(df, "k", "ord"), "k", "ord")) == [(1, "a"), (2, "b"), (9, "c")]
    assert rows(K.dense_number(df, "n", "ord"), "ord", "n") == [(1, 1), (2, 2), (3, 3), (9, 4)]
    assert rows(K.dense_number(df.limit(0), "n", "ord")) == []
    assert rows(K.renumber(df, "k", "psa", 2026, "ord"), "ord", "k")[0] == (1, "psa_2026_000001")


def test_seen_sets_differ(spark):
    df = spark.createDataFrame([(1, "k", "bad"), (2, "k", None), (3, "s", None), (4, "", None)], "ord int, key string, reason string")
    seen = spark.createDataFrame([("s",)], "key string")
    assert rows(JN.first_decides(df, seen, "ord"), "ord") == [(1,)]
    assert rows(JN.first_passing(df, seen, "reason", "ord"), "ord") == [(2,)]


def test_split_look_up_takes_the_last(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    splits = spark.createDataFrame([("a", "test"), ("a", "train")], "id string, split string")
    assert rows(JN.with_split(ids, splits, "id")) == [("a", "test"), ("b", "")]
    assert rows(JN.with_flag(ids, splits, "id", "f")) == [("a", True), ("b", False)]


def test_prefix_then_filter(spark):
    df = spark.createDataFrame([(i, i % 4 != 0, int(i % 10 == 0 or i % 7 == 0)) for i in range(1, 101)], "line int, ok boolean, s int")
    kept = []
    for i in range(1, 101):
        if i > 60 or i % 4 == 0:
            continue
        if len(kept) > 10 // 2 and not (i % 10 == 0 or i % 7 == 0) and i < 60:
            continue
        kept.append(i)
        if len(kept) >= 20:
            break
    assert rows(K.prefix_then_filter(df, "ok", "s", 10, 60, "line"), "line") == [(i,) for i in kept]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(1, 200), min_size=1, max_size=8), st.integers(1, 300), st.integers(1, 20))
def test_allocation(sizes, n, least):
    n = min(n, sum(sizes.values()) - 1) or 1
    out = SM.allocate(sizes, n, least)
    assert all(0 < out[g] <= sizes[g] for g in sizes) or n < len(sizes)
    assert sum(out.values()) == n or n < len(sizes)


def test_splits(spark):
    df = spark.createDataFrame([(f"{g}{i}", g) for g, n in (("a", 40), ("b", 20), ("c", 10), ("d", 2), ("e", 1)) for i in range(n)] + [("x", None)], "id string, g string")
    out = SM.stratified_split(df, "id", "g")
    got = {(r["g"], r["split"]): r["n"] for r in out.groupBy("g", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [got.get(("a", s)) for s in ("train", "dev", "test")] == [32, 4, 4]
    assert [got.get(("b", s)) for s in ("train", "dev", "test")] == [16, 2, 2]
    assert [got.get(("c", s)) for s in ("train", "dev", "test")] == [8, 1, 1]
    assert out.count() == df.count() == out.select("id").distinct().count()
    with pytest.raises(ValueError):
        SM.split_sizes(F.lit(3), (0.5, 0.1, 0.1))


def test_sample(spark):
    df = spark.createDataFrame([(f"{g}{i}", g) for g, n in (("a", 50), ("b", 30), ("c", 20)) for i in range(n)], "id string, g string")
    out = SM.stratified_sample(df, 25, "id", "g", least=3)
    assert out.count() == 25 and out.select("g").distinct().count() == 3
    assert SM.stratified_sample(df, 0, "id", "g").count() == 0
    assert SM.stratified_sample(df, 1000, "id", "g").count() == 100


def test_nearest_rank(spark):
    df = spark.createDataFrame([(v,) for v in [5, 1, 3, 3, 9, None]], "v int")
    r = ST.nearest_rank(df, "v", {"p25": 25, "median": 50, "p75": 75}).first()
    values = sorted([5, 1, 3, 3, 9, 0])
    assert [r["p25"], r["median"], r["p75"]] == [values[round(p / 100 * 5)] for p in (25, 50, 75)]
    assert tuple(ST.nearest_rank(df.limit(0), "v", {"median": 50}).first()) == (0, 0, 0.0, 0, 0.0)


def test_top_ties_by_first_place(spark):
    df = spark.createDataFrame([(1, "b a"), (2, "a b c")], "o int, t string")
    assert [r["token"] for r in ST.top(ST.vocabulary(df, "t", "o"), 2, "first").collect()] == ["b", "a"]


def test_json(spark):
    df = spark.createDataFrame([('{"a": "1", "b": 2}',), ("Language: en",), ("",), (None,), ("[1]",)], "m string")
    base = J.parse("m")
    out = df.select(J.serialise(J.overlay(base, F.create_map(F.lit("a"), F.lit("x")))).alias("x")).collect()
    assert [r["x"] for r in out] == ['{"a":"x","b":"2"}', '{"a":"x"}', '{"a":"x"}', '{"a":"x"}', '{"a":"x"}']
    kept = df.limit(1).select(J.serialise(J.set_default(base, F.create_map(F.lit("a"), F.lit("x"), F.lit("é"), F.lit("y")))).alias("x")).first()["x"]
    assert kept == '{"a":"1","b":"2","é":"y"}'


def test_metrics(spark):
    same = spark.createDataFrame([("the cat sat on the mat today", "the cat sat on the mat today")], "h string, r string")
    assert corpus_bleu(same, "h", "r").first()["bleu"] == pytest.approx(100)
    assert corpus_chrf(same, "h", "r").first()["chrf"] == pytest.approx(100)
    pair = spark.createDataFrame([("the the the the", "the cat is here")], "h string, r string")
    # One of four unigrams, smoothed halves for the higher orders: 25, 100/(2*3), 100/(4*2), 100/(8*1).
    assert corpus_bleu(pair, "h", "r").first()["bleu"] == pytest.approx((25 * 100 / 6 * 12.5 * 12.5) ** 0.25)
    none = same.limit(0)
    assert tuple(corpus_bleu(none, "h", "r").first()) == (0.0, 0) and tuple(corpus_chrf(none, "h", "r").first()) == (0.0, 0)


def test_schemas():
    assert len(S.CORPUS) == 8 and len(S.CLEANED) == 24 and len(S.PAIRS) == 14 and len(S.HUMAN_EVAL) == 20 and len(S.NOTICE) == 23
