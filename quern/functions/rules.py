"""Ordered rule cascades: notice score, framework label, gate, validation.

Each takes its rule set as a parameter (``lexicons.NOTICE_RULES`` by default).
Scores are sums of doubles in a fixed order, so that thresholds fall the same
way everywhere.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import lexicons as L
from quern.functions.text import _col, collapse, collapsed_count, let, navigation_crumb, strip, strip_chars, text_or_empty, title_and_body, word_count

THRESHOLD = 0.28


def _literals(items) -> list[str] | None:
    """Lower-case texts one of which every match of a parsed pattern holds; the longest that can be had."""
    found, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is re._parser.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            found.append([run])
            run = ""
        if op in (re._parser.MAX_REPEAT, re._parser.MIN_REPEAT) and value[0] > 0:
            found.append(_literals(value[2]))
        elif op is re._parser.SUBPATTERN:
            found.append(_literals(value[3]))
        elif op is re._parser.BRANCH:
            parts = [_literals(b) for b in value[1]]
            found.append(None if None in parts else [x for p in parts for x in p])
    return max((f for f in found if f), key=lambda f: (min(map(len, f)), -len(f)), default=None)


def _may_match(lowered: Column, pattern: str) -> Column:
    """Whether a lower-cased text has letters without which the pattern can't match: a cheap look before the pattern itself."""
    texts = _literals(re._parser.parse(pattern))
    return reduce(lambda a, b: a | b, [lowered.contains(x) for x in dict.fromkeys(texts)]) if texts else F.lit(True)


#: What stands between two words as the boundaries of patterns see them: neither letter, digit, underscore nor a mark on one of these.
_BETWEEN_WORDS = r"(?:[^\p{javaLetterOrDigit}_\p{Mn}]|(?<![\p{javaLetterOrDigit}_\p{Mn}])\p{Mn})+"

#: The ASCII characters between words of a lower-cased text, one by one: a class that is a table, without ranges to try in turn.
_ASCII_GAP = "[" + "".join(f"\\x{i:02X}" for i in range(128) if not re.match("[A-Za-z0-9_]", chr(i))) + "]+"


def _alternatives(inner: str) -> list[str]:
    """The alternatives of a pattern, split where no bracket is open."""
    out, depth, start, k = [], 0, 0, 0
    while k < len(inner):
        if inner[k] == "\\":
            k += 1
        elif inner[k] in "([":
            depth += 1
        elif inner[k] in ")]":
            depth -= 1
        elif inner[k] == "|" and depth == 0:
            out.append(inner[start:k])
            start = k + 1
        k += 1
    return [*out, inner[start:]]


@lru_cache(maxsize=256)
def _word_index(pattern: str) -> tuple[tuple[str, ...], str | None]:
    """The single words among a pattern's alternatives between word boundaries, and a pattern of the others."""
    if not (pattern.startswith(r"\b(") and pattern.endswith(r")\b") and not pattern.startswith(r"\b(?")):
        return (), pattern
    words, rest = [], []
    for x in _alternatives(pattern[3:-3]):
        if re.fullmatch("[a-z0-9_]+", x):
            words.append(x)
        elif re.fullmatch("[a-z0-9_]{2,}[?]", x):
            words += [x[:-2], x[:-1]]
        else:
            rest.append(x)
    return tuple(words), rf"\b({'|'.join(rest)})\b" if rest else None


def _whole_words(alternative: str) -> tuple[str, ...]:
    """Words one of which stands by itself in every match of an alternative between word boundaries; none if that can't be told.

    They come from the letters that the alternative begins with, where one more may be there or not.
    """
    texts, ended = [""], True
    for op, value in re._parser.parse(alternative):
        if op is re._parser.LITERAL:
            texts = [t + chr(value).lower() for t in texts]
        elif op is re._parser.MAX_REPEAT and value[:2] == (0, 1) and len(value[2]) == 1 and value[2][0][0] is re._parser.LITERAL:
            texts = [t + x for t in texts for x in ("", chr(value[2][0][1]).lower())]
        else:
            ended = False
            break
    found = [max(re.findall("[a-z0-9_]+" if ended else "[a-z0-9_]+(?![a-z0-9_]|$)", t), key=len, default="") for t in texts]
    return tuple(dict.fromkeys(found)) if all(found) and "".join(texts).isascii() else ()


def _beginnings(items, most: int = 12) -> tuple[list[str], bool]:
    """Lower-case texts with one of which every match of a parsed pattern begins, and whether they are all of it."""
    texts = [""]
    for op, value in items:
        more, whole = None, True
        if op is re._parser.LITERAL:
            more = [chr(value).lower()]
        elif op is re._parser.SUBPATTERN:
            more, whole = _beginnings(value[3], most)
        elif op is re._parser.BRANCH:
            parts = [_beginnings(b, most) for b in value[1]]
            more, whole = [x for p, _ in parts for x in p], all(w for _, w in parts)
        elif op is re._parser.MAX_REPEAT and value[:2] == (0, 1):
            more, whole = _beginnings(value[2], most)
            more = ["", *more] if whole else None
        if more is None or len(texts) * len(more) > most:
            return texts, False
        texts = [t + x for t in texts for x in more]
        if not whole:
            return texts, False
    return texts, True


def _near(alternative: str) -> tuple[str, ...]:
    """Texts one of which every match of an alternative holds: its beginnings, unless other letters of it tell more."""
    parsed = re._parser.parse(alternative)
    begin, other = _beginnings(parsed)[0], _literals(parsed) or []
    return tuple(dict.fromkeys(begin if min(map(len, begin)) >= min(map(len, other), default=0) else other))


@lru_cache(maxsize=256)
def _rest_index(rest: str) -> tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]:
    """Of each alternative that isn't a word: words of :func:`_whole_words` and texts of :func:`_near`."""
    inner = rest[3:-3] if rest.startswith(r"\b(") and rest.endswith(r")\b") and not rest.startswith(r"\b(?") else None
    if inner is None:
        return (((), tuple(dict.fromkeys(_literals(re._parser.parse(rest)) or ()))),)
    return tuple((_whole_words(x), _near(x)) for x in _alternatives(inner))


def _rest_may_match(lowered: Column, rest: str, words: Column | None) -> Column:
    """As :func:`_may_match`, but letters are looked for only where ``words`` have what stands by itself in a match."""
    if words is None:
        return _may_match(lowered, rest)
    found = []
    for whole, texts in _rest_index(rest):
        near = reduce(lambda a, b: a | b, [lowered.contains(x) for x in texts]) if texts else F.lit(True)
        found.append(reduce(lambda a, b: a | b, [F.array_contains(words, w) for w in whole]) & near if whole else near)
    return reduce(lambda a, b: a | b, found)


def _words_of(lowered: Column, *patterns: str) -> Column:
    """The text's words that are alternatives of the patterns, or stand by themselves in other alternatives: one pass for all of them."""
    known = []
    for own, rest in map(_word_index, patterns):
        known += [*own, *[w for whole, _ in (_rest_index(rest) if rest else ()) for w in whole]]
    known = list(dict.fromkeys(known))
    if not known:
        return F.array().cast("array<string>")
    # Cut at ASCII characters; only pieces with others are cut again as these ask for, all at once, and known words have none.
    is_known = lambda w: w.isin(*known)
    pieces = F.filter(F.split(lowered, _ASCII_GAP), lambda w: is_known(w) | (F.octet_length(w) > F.length(w)))
    far = lambda x: F.filter(F.split(F.array_join(F.filter(x, lambda w: ~is_known(w)), " "), _BETWEEN_WORDS), is_known)
    return let(pieces, lambda x: F.when(F.forall(x, is_known), x).otherwise(F.concat(F.filter(x, is_known), far(x))))


def _low_has(lowered: Column, pattern: str, words: Column | None = None) -> Column:
    """Whether a pattern matches a lower-cased text: by ``words`` of :func:`_words_of`, else by its other alternatives where these may match."""
    own, rest = _word_index(pattern) if words is not None else ((), pattern)
    found = [F.arrays_overlap(words, F.array(*map(F.lit, own)))] if own else []
    found += [_rest_may_match(lowered, rest, words) & lowered.rlike(rest)] if rest else []
    return reduce(lambda a, b: a | b, found)


def _has(c: Column, pattern: str, lowered: Column | None = None, words: Column | None = None) -> Column:
    """Whether a pattern matches, whatever the case; with the lower-cased text at hand, tried only where it may."""
    if lowered is None:
        return c.rlike("(?i)" + pattern)
    own, rest = _word_index(pattern) if words is not None else ((), pattern)
    found = [F.arrays_overlap(words, F.array(*map(F.lit, own)))] if own else []
    found += [_rest_may_match(lowered, rest, words) & c.rlike("(?i)" + rest)] if rest else []
    return reduce(lambda a, b: a | b, found)


def _number(c: Column, pattern: str, lowered: Column, words: Column) -> Column:
    """How often a pattern matches: its words, unless another of its alternatives matches too."""
    own, rest = _word_index(pattern)
    of_words = F.size(F.filter(words, lambda w: w.isin(*own))) if own else F.lit(0)
    return F.when(_rest_may_match(lowered, rest, words) & lowered.rlike(rest), F.regexp_count(c, F.lit("(?i)" + pattern))).otherwise(of_words) if rest else of_words


def _points(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def notice_score(title, text, rules: SimpleNamespace = L.NOTICE_RULES) -> Column:
    """CLS-01: struct (is_notice, score); the threshold applies before rounding."""
    title, text = text_or_empty(title), text_or_empty(text)
    facts = F.struct(strip(title).alias("title"), F.lower(F.concat(title, F.lit("\n"), text)).alias("both"), word_count(text).alias("n"))
    words = lambda f: _words_of(f["both"], *rules.positive, *rules.negative, rules.organisations, rules.imperatives)
    score = let(facts, lambda f: let(words(f), lambda w: _score(f["title"], f["both"], f["n"], w, rules)))
    return let(score, lambda s: F.struct((s >= THRESHOLD).alias("is_notice"), F.bround(s, 3).alias("score")))


def _score(title: Column, both: Column, n: Column, words: Column, rules: SimpleNamespace) -> Column:
    score = F.lit(0.0)
    for p in rules.positive:
        score = score + _points(_low_has(both, p, words), 0.12)
    for p in rules.negative:
        score = score - _points(_low_has(both, p, words), 0.25)
    score = score + _points(_has(title, rules.prefix), 0.2)
    score = score + _points(_low_has(both, rules.organisations, words), 0.15)
    score = score + F.least(_number(both, rules.imperatives, both, words) * F.lit(0.05), F.lit(0.2))
    score = score + F.when(n > 500, -0.25).when(n > 300, -0.15).when(n < 12, -0.2).when(n.between(15, 250), 0.15).when(n.between(251, 300), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def framework_label(text, title, rules: SimpleNamespace = L.NOTICE_RULES) -> Column:
    """CLS-02: struct (label, confidence, reason, action_hits, press_hits, other_hits, token_count, is_strict)."""
    both = let(collapse(text), lambda body: F.struct(strip_chars(F.concat(collapse(title), F.lit(". "), body), ". ").alias("both"), collapsed_count(body).alias("n")))
    low = let(both, lambda b: F.struct(b["both"].alias("both"), b["n"].alias("n"), F.lower(b["both"]).alias("low")))
    kinds = {"a": rules.action, "p": rules.press, "o": rules.other}
    counts = lambda b, w: F.struct(b["both"].alias("both"), b["n"].alias("n"), b["low"].alias("low"), *[_number(b["both"], x, b["low"], w).alias(k) for k, x in kinds.items()])
    facts = let(low, lambda b: let(_words_of(b["low"], *kinds.values()), lambda w: counts(b, w)))
    return let(facts, lambda f: _framework(f["both"], f["low"], f["n"], f["a"], f["p"], f["o"], rules))


def _framework(both: Column, low: Column, n: Column, a: Column, p: Column, o: Column, rules: SimpleNamespace) -> Column:
    quoted = (F.regexp_count(both, F.lit('"')) >= 4) | _has(both, rules.quotes, low)
    long = n > 280

    def verdict(label: str, reason: str, confidence) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))

    action = F.lit(0.55) + F.least(F.lit(0.35), a * F.lit(0.08))
    action = action + F.when(n <= 180, 0.08).otherwise(0.0) - F.when(long, 0.12).otherwise(0.0)
    notice = F.when(n < 8, verdict("not_psa", "too_short_for_psa", 0.15)).when(n > 400, verdict("not_psa", "too_long_for_framework_psa", 0.35)).otherwise(verdict("psa", "public_action_advisory_or_alert", action))
    tree = (
        F.when(
            (a > 0) & ~((p > 0) & (p >= a + 2) & long),
            F.when(quoted & (a <= 1) & long, verdict("press_release", "narrative_media_coverage_over_weak_action", 0.55))
            .when(long & (a <= 1) & (p >= 2), verdict("press_release", "long_press_style_with_weak_psa_cue", 0.6))
            .otherwise(notice),
        )
        .when(p > 0, verdict("press_release", "government_activity_or_media_narrative", F.lit(0.5) + F.least(F.lit(0.3), p * F.lit(0.07))))
        .when(o > 0, verdict("other_gov_comm", "legal_admin_tender_or_gazette_style", F.lit(0.55) + F.least(F.lit(0.25), o * F.lit(0.08))))
        .otherwise(verdict("not_psa", "no_framework_intent_match", 0.2))
    )

    def result(t: Column) -> Column:
        confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(t["confidence"], 3)))
        return F.struct(
            t["label"].alias("label"), confidence.alias("confidence"), t["reason"].alias("reason"), a.alias("action_hits"), p.alias("press_hits"), o.alias("other_hits"), n.alias("token_count"),
            ((t["label"] == "psa") & (confidence >= 0.55)).alias("is_strict"),
        )

    return let(tree, result)


def gate_reason(text, source="", lang="en", contributor="", origin_file="", rules: SimpleNamespace = L.NOTICE_RULES, raw_contributor: str | None = None, raw_file: str = "psa_dataset.csv") -> Column:
    """CLS-03: why a row leaves the clean sheet, null if it stays.

    ``raw_contributor`` names a contributor whose rows are raw scrapes; their
    reason is that name followed by ``_raw_scrape``, as it is for ``raw_file``.
    Arguments but the text may be columns or plain values.
    """
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    raw = F.coalesce(lit(origin_file), F.lit("")) == raw_file
    if raw_contributor:
        raw = raw | F.lower(F.coalesce(lit(contributor), F.lit(""))).contains(raw_contributor.lower())
    raw_reason = f"{(raw_contributor or 'unreviewed').lower()}_raw_scrape"
    facts = let(
        collapse(text),
        lambda w: F.struct(
            w.alias("w"), F.lower(w).alias("low"), collapsed_count(w).alias("n"), F.lower(F.coalesce(lit(source), F.lit(""))).alias("source"),
            F.coalesce(lit(lang), F.lit("unknown")).alias("lang"), raw.alias("raw"),
        ),
    )
    words = lambda f: _words_of(f["low"], rules.force, rules.off_topic, rules.listicle, rules.report, rules.genre)
    forced = lambda f, w: let(_has(f["w"], rules.force, f["low"], w), lambda force: _gate(f["w"], f["low"], w, f["n"], force, f["source"], f["lang"], f["raw"], raw_reason, rules))
    return let(facts, lambda f: let(words(f), lambda w: forced(f, w)))


def _gate(whole: Column, low: Column, words: Column, n: Column, force: Column, source: Column, lang: Column, raw: Column, raw_reason: str, rules: SimpleNamespace) -> Column:
    any_of = lambda names: source.rlike("|".join(x.replace(".", r"\.") for x in names))
    none = F.lit(None).cast("string")

    def by_score(s: Column) -> Column:
        scored = lambda name: F.concat(F.lit(name + ":"), F.format_string("%.2f", s))
        return (
            F.when((s < THRESHOLD) & ~force, scored("low_psa_score"))
            .when(force & (s < 0.15) & (n > 220), scored("weak_forced_narrative"))
            .when((s < 0.18) & (n > 250), scored("weak_long_narrative"))
            .otherwise(none)
        )

    return (
        F.when(n == 0, "empty_text")
        .when(raw, raw_reason)
        .when(_has(whole, rules.navigation, low), "nav_boilerplate")
        .when(_has(whole, rules.listing, low), "listing_page_dump")
        .when(navigation_crumb(whole, 3), "menu_like")
        .when(_has(whole, rules.stub, low) & ~force, "ngo_website_stub")
        .when(any_of(L.ABOUT_PAGES) & (~force | (n < 40)), "ngo_about_page")
        .when(_has(whole, rules.off_topic, low, words) & ~force, "off_topic_news")
        .when(_has(whole, rules.listicle, low, words) & ~force, "listicle_not_psa")
        .when((n < 12) & force & (n >= 8), none)
        .when(n < 12, "too_short")
        .when(n > 350, "too_long_for_psa")
        .when(~lang.isin(L.GATE_LANGUAGES), F.concat(F.lit("non_target_language:"), lang))
        .when((n < 25) & ~force & any_of(L.NGO_HOSTS), "short_ngo_non_psa")
        .when(_has(whole, rules.report, low, words), "report_not_psa")
        .when(_has(whole, rules.genre, low, words) & ~force, "genre_news_not_psa")
        .otherwise(let(title_and_body(whole), lambda p: let(notice_score(p["title"], p["body"], rules)["score"], by_score)))
    )


def core_passes(text, source="", lang="en", rules: SimpleNamespace = L.NOTICE_RULES) -> Column:
    """CLS-04: whether the gate has nothing against a text."""
    return gate_reason(text, source, lang, rules=rules).isNull()


def validation(text, token_count, is_notice, url, trust, published, language) -> Column:
    """CLS-05: struct (valid, errors, warnings) of a record."""
    n, language = _col(token_count), _col(language)
    known = language.isin("en", "sw", "kik", "ki", "luo", "guz", "som")
    errors = F.array_compact(
        F.array(
            F.when(strip(text) == "", "empty_text"), F.when(n < 10, "too_short"),
            F.when(~F.coalesce(_col(is_notice), F.lit(False)), "not_classified_as_psa"), F.when(text_or_empty(url) == "", "missing_source_url"),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(n > 500, "too_long"), F.when(_col(trust) < 50, "low_trust_source"), F.when(_col(published).isNull(), "missing_publish_date"),
            F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unexpected_language:"), F.coalesce(language, F.lit("None")))),
        )
    )
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"))


def review_ok(normalised, least: int = 12) -> Column:
    """CLS-09: whether a validation row passes by score and length."""
    from quern.functions.text import word_token_count

    return notice_score(F.lit(""), normalised)["is_notice"] & (word_token_count(normalised) >= least)


def corpus_verdict(kept, total) -> Column:
    """CLS-11: what a keep rate says of a corpus."""
    rate = F.when(_col(total) > 0, _col(kept) / _col(total)).otherwise(0.0)
    return F.when(rate < 0.45, "poor_needs_clean").when(rate < 0.7, "mixed_review").otherwise("mostly_psa")


def training_ready(train, dev) -> Column:
    """CLS-12: whether there are enough pairs to train and tune on."""
    return (_col(train) >= 50) & (_col(dev) >= 5)
