"""Like titles beside all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.operators.title_join import like_titles


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(rng, title, n):
    t = list(title)
    for _ in range(n):
        at = rng.randrange(len(t) + 1)
        kind = rng.random()
        if kind < 0.4 and at < len(t):
            t[at] = rng.choice("abcdefgh é")
        elif kind < 0.7:
            t.insert(at, rng.choice("abcdefgh é"))
        elif at < len(t):
            del t[at]
    return "".join(t)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.85, 1.0])
def test_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(30)]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(30)] + ["", "a", "ab", "aaaaaaaa", "aaaaaaaaaa"]
    left = [(rng.randrange(2), t) for t in titles] + [(None, "x"), (1, None)]
    right = [(rng.randrange(2), edited(rng, t, rng.randrange(6))) for t in titles * 2] + [(0, t) for t in titles] + [(None, "x"), (0, None)]
    got = like_titles(spark.createDataFrame(left + left[:3], "date int, title string"), spark.createDataFrame(right, "date int, title string"), least)
    plain = set()
    for d, a in set(left):
        for e, b in set(right):
            if d is not None and d == e and a is not None and b is not None and (s := 1.0 - distance(a, b) / max(len(a), len(b), 1)) >= least:
                plain.add((d, a, b, round(s, 9)))
    found = [(r["date"], r["l_title"], r["r_title"], round(r["score"], 9)) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain


def test_one_date_of_many_titles(spark):
    # Unlike titles of a date meet in few pairs: the rarest groups tell them apart.
    rng = random.Random(3)
    title = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6))
    for n in (500, 2000):
        rows = [(1, title()) for _ in range(n)]
        left = spark.createDataFrame(rows, "date int, title string")
        right = spark.createDataFrame([(1, edited(rng, t, 2)) for _, t in rows], "date int, title string")
        df = like_titles(left, right, 0.9)
        assert df.count() == n
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" in plan and "Cross" not in plan


def test_bounds(spark):
    df = spark.createDataFrame([(1, "x")], "date int, title string")
    assert like_titles(df, df, 1.0).select(F.col("score")).first()[0] == 1.0
    for least in (0, -1, 1.1):
        with pytest.raises(ValueError):
            like_titles(df, df, least)
