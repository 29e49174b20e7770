"""Corpus BLEU and chrF as their papers define them (Papineni 2002, Popovic 2015).

N-grams are counted within each pair's row; the counts add up to one row, from
which the score follows in closed form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import collapse, let, text_or_empty, words


def mt_tokens(c) -> Column:
    """Tokens of the standard ``13a`` rules: entities back, marks apart, periods and commas kept within numbers."""
    c = F.regexp_replace(text_or_empty(c), "<skipped>", "")
    for name, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.concat(F.lit(" "), F.regexp_replace(c, "\n", " "), F.lit(" "))
    c = F.regexp_replace(c, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    c = F.regexp_replace(c, r"([^0-9])([\.,])", "$1 $2 ")
    c = F.regexp_replace(c, r"([\.,])([^0-9])", " $1 $2")
    return words(F.regexp_replace(c, r"([0-9])(-)", "$1 $2 "))


def _joined(a: Column, b: Column, f) -> Column:
    """``f`` of the elements of two arrays at equal places, as far as both go."""
    return F.filter(F.zip_with(a, b, lambda x, y: F.when(y.isNotNull(), f(x, y))), lambda x: x.isNotNull())


def _after(c: Column, k: int) -> Column:
    return F.when(F.size(c) > k, F.slice(c, F.lit(k + 1), F.size(c) - k)).otherwise(F.array().cast("array<bigint>"))


def _hashed(shorter: list[Column], units: Column) -> Column:
    """Codes of the next order's n-grams of an array of longs: hashes of 64 bits, which two n-grams of a pair share with a probability of some 10^-13."""
    return _joined(shorter[-1], _after(units, len(shorter)), F.xxhash64) if shorter else units


def _rolled(shorter: list[Column], units: Column) -> Column:
    """Codes of the next order's n-grams of an array of numbers below 2^21: three side by side fit a long; more are hashed as in :func:`_hashed`."""
    n = len(shorter)
    if n >= 3:
        return _joined(shorter[2], _after(shorter[n - 3], 3), F.xxhash64)
    return _joined(shorter[-1], _after(units, n), lambda a, b: F.shiftleft(a, 21).bitwiseOR(b)) if n else units


def _matched(h: Column, r: Column) -> Column:
    """Codes of two lists that pair off: both are sorted as one, and each run of equal ones gives its smaller side.

    A code's last bit tells the side, so longs are sorted and no structs. The
    running state is one long: pairs so far above, codes of the reference that
    the run has left below 2^32.
    """
    side = lambda codes, own: F.transform(codes, lambda c: F.shiftleft(c, 1).bitwiseOR(F.lit(own).cast("long")))
    low, one = F.lit((1 << 32) - 1), F.lit(1).cast("long")

    def steps(codes: Column) -> Column:
        """The side of each code, and 2 more where it is that of the one before; a run's codes of the reference come first."""
        before = F.concat(F.array(F.lit(None).cast("long")), codes)
        return F.zip_with(codes, F.slice(before, F.lit(1), F.size(codes)), lambda x, y: x.bitwiseAND(one).cast("int") + F.when(F.shiftright(x, 1) == F.shiftright(y, 1), 2).otherwise(0))

    def step(s: Column, x: Column) -> Column:
        left = s.bitwiseAND(low)
        paired = F.when(left > 0, s + low).otherwise(s)  # one pair more, one left fewer
        return F.when(x == 3, paired).when(x == 2, s + 1).when(x == 1, s - left).otherwise(s - left + 1)

    runs = let(F.sort_array(F.concat(side(h, 1), side(r, 0))), steps)
    return F.shiftright(F.aggregate(runs, F.lit(0).cast("long"), step), 32)


def _counts(df: DataFrame, sides: dict[str, Column], orders: int, codes) -> DataFrame:
    """One row: matched n-grams ``m1..``, and each side's totals ``h1.., r1..``, and the number of pairs ``n``.

    The sides are arrays of longs that stand for units, ``codes`` makes those of their n-grams.

    N-grams are counted within the pair's row and clipped to the smaller count,
    so that only sums leave it: nothing but one row a task is shuffled.
    """
    rows = df.select(*[c.alias(s) for s, c in sides.items()])
    h, r = F.col("h"), F.col("r")
    for n in range(1, orders + 1):  # each order's codes from those before it
        rows = rows.withColumns({f"{s}g{n}": codes([F.col(f"{s}g{k}") for k in range(1, n)], u) for s, u in (("h", h), ("r", r))})
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    size = lambda c, n: F.greatest(F.size(c) - (n - 1), F.lit(0)).cast("long")
    parts = [x for n in range(1, orders + 1) for x in (total(_matched(F.col(f"hg{n}"), F.col(f"rg{n}")), f"m{n}"), total(size(h, n), f"h{n}"), total(size(r, n), f"r{n}"))]
    return rows.agg(*parts, F.count(F.lit(1)).alias("n"))


def corpus_bleu(df: DataFrame, hypothesis: str, reference: str, orders: int = 4) -> DataFrame:
    """AGG-15: one row: ``bleu, n``; exponential smoothing, brevity penalty, 0 to 100."""
    pairs = df.select(F.col(hypothesis).alias("hyp_"), F.col(reference).alias("ref_"))
    units = lambda c: F.transform(mt_tokens(c), lambda t: F.xxhash64(t))
    total = _counts(pairs, {"h": units("hyp_"), "r": units("ref_")}, orders, _hashed)
    smooth, logs, dead = F.lit(1.0), [], F.lit(False)
    for n in range(1, orders + 1):
        m, t = F.col(f"m{n}"), F.col(f"h{n}")
        smooth = F.when((m == 0) & (t > 0), smooth * 2).otherwise(smooth)
        logs.append(F.log(F.when(m > 0, F.lit(100.0) * m / t).when(t > 0, F.lit(100.0) / (smooth * t)).otherwise(F.lit(1.0))))
        dead = dead | (t == 0)
    brevity = F.when(F.col("h1") >= F.col("r1"), 1.0).when(F.col("h1") > 0, F.exp(1 - F.col("r1") / F.col("h1"))).otherwise(0.0)
    score = brevity * F.exp(reduce(lambda a, b: a + b, logs) / orders)
    return total.select(F.when(dead | (F.col("m1") == 0), 0.0).otherwise(score).alias("bleu"), "n")


def corpus_chrf(df: DataFrame, hypothesis: str, reference: str, orders: int = 6, beta: float = 2.0) -> DataFrame:
    """AGG-15: one row: ``chrf, n``; character orders 1 to ``orders``, white space removed, 0 to 100."""
    chars = lambda c: F.transform(F.regexp_extract_all(F.replace(collapse(c), F.lit(" "), F.lit("")), F.lit("(?s)."), F.lit(0)), lambda x: F.ascii(x).cast("long"))
    pairs = df.select(F.col(hypothesis).alias("hyp_"), F.col(reference).alias("ref_"))
    total = _counts(pairs, {"h": chars("hyp_"), "r": chars("ref_")}, orders, _rolled)
    # Orders that either side is too short for don't count.
    k = range(1, orders + 1)
    both = [(F.col(f"h{n}") > 0) & (F.col(f"r{n}") > 0) for n in k]
    many = reduce(lambda a, b: a + b, [x.cast("int") for x in both])
    mean = lambda side: reduce(lambda a, b: a + b, [F.when(x, F.col(f"m{n}") / F.col(f"{side}{n}")).otherwise(0.0) for n, x in zip(k, both, strict=True)]) / many
    p, r = mean("h"), mean("r")
    factor = beta**2
    return total.select(F.when((many > 0) & (p + r > 0), F.lit(100.0) * (1 + factor) * p * r / (factor * p + r)).otherwise(0.0).alias("chrf"), "n")
