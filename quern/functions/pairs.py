"""Checks of sentence pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.lexicon_match import glossary_preservation
from quern.functions.text import _col, collapse, let, word_count


def length_ratio(source, target) -> Column:
    """CLS-08: words of the target for each of the source's, each at least 1."""
    return F.greatest(word_count(target), F.lit(1)) / F.greatest(word_count(source), F.lit(1))


def near_copy(source, target, threshold: float = 0.92) -> Column:
    """CLS-07: whether the target repeats the source's words, or either has none."""
    cut = lambda c: F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")

    def repeats(x: Column) -> Column:
        s, t = x["s"], x["t"]
        overlap = F.size(F.array_intersect(s, t)) / F.size(F.array_distinct(s))
        return F.when((F.size(s) == 0) | (F.size(t) == 0), True).otherwise((overlap >= threshold) & (F.abs(F.size(s) - F.size(t)) <= 3))

    return let(F.struct(cut(source).alias("s"), cut(target).alias("t")), repeats)


def pair_check(source, target, target_language, wants_swahili, least: int = 5, most: int = 100, low: float = 0.45, high: float = 2.2) -> Column:
    """CLS-06: struct (ok, reasons, length_ratio, glossary_preservation, language, confidence).

    ``target_language`` is the detected language of the target; it counts only
    where ``wants_swahili`` holds and the target isn't a placeholder.
    """
    both = F.struct(collapse(source).alias("s"), collapse(target).alias("t"))

    def facts(x: Column) -> Column:
        s, t = x["s"], x["t"]
        there = t != ""
        return F.struct(
            s.alias("s"), t.alias("t"), word_count(s).alias("n"), word_count(t).alias("m"), there.alias("there"), t.startswith("[DRY_RUN").alias("dry"),
            F.when(there, length_ratio(s, t)).otherwise(0.0).alias("ratio"), F.when(there, glossary_preservation(s, t)).otherwise(0.0).alias("kept"),
        )

    def judged(f: Column) -> Column:
        n, m, there, dry, ratio, kept = (f[k] for k in ("n", "m", "there", "dry", "ratio", "kept"))
        language = F.when(there & ~dry, _col(target_language))
        reasons = F.array_compact(
            F.array(
                F.when(n < least, "src_too_short"), F.when(n > most, "src_too_long"), F.when(m < 3, "tgt_too_short"), F.when(~there | dry, "tgt_missing_or_dry_run"),
                F.when(there & ~ratio.between(low, high), "bad_length_ratio"), F.when(there & near_copy(f["s"], f["t"]), "near_copy"), F.when(there & (kept < 0.5), "glossary_dropped"),
                F.when(_col(wants_swahili) & language.isin("fr", "de", "es", "pt", "it"), F.concat(F.lit("unexpected_lang:"), language)),
            )
        )

        def bundle(r: Column) -> Column:
            confidence = F.lit(1.0) - F.lit(0.15) * F.size(r) + F.when(ratio.between(0.7, 1.4), 0.05).otherwise(0.0)
            confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
            return F.struct(
                (F.size(r) == 0).alias("ok"), r.alias("reasons"), F.bround(ratio, 3).alias("length_ratio"), F.bround(kept, 3).alias("glossary_preservation"),
                F.coalesce(language, F.lit("")).alias("language"), F.bround(confidence, 3).alias("confidence"),
            )

        return let(reasons, bundle)

    return let(let(both, facts), judged)
