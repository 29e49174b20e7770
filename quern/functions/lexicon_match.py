"""Dictionary matches: domains, urgency, audience, keywords, glossary.

Lexicons are literals of the plan; a text is matched in place, so none of these
needs a join or a broadcast.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import lexicons as L
from quern.functions.text import _col, let, text_or_empty

#: Regex metacharacters get a backslash, nothing else does.
_META = re.compile(r"([\\.^$|?*+()\[\]{}-])")


def literal(form: str) -> str:
    return _META.sub(r"\\\1", form)


def _any(lowered: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(k) for k in keywords])


def _tree(keywords: list[str]) -> str:
    """A pattern of ASCII keywords by their beginnings, which are looked at once; of several that begin alike the longest matches."""
    branches: dict[str, list[str]] = {}
    for k in keywords:
        if k:
            branches.setdefault(k[0], []).append(k[1:])
    parts = [literal(c) + _tree(rest) for c, rest in branches.items()]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)})" + ("?" if "" in keywords else "") if len(parts) > 1 or "" in keywords else parts[0]


def _in_class(c: str) -> str:
    return c if c.isalnum() else f"\\x{ord(c):02X}"


def _halved(keywords: list[str], least: int = 3) -> str:
    """As :func:`_tree`, where the first character tells by halves of the alphabet which beginnings are tried."""
    firsts = sorted({k[0] for k in keywords})
    if len(firsts) <= least:
        return _tree(keywords)
    half = len(firsts) // 2
    low, high = ([k for k in keywords if (k[0] in firsts[:half]) == side] for side in (True, False))
    return f"(?:(?=[{_in_class(firsts[0])}-{_in_class(firsts[half - 1])}]){_halved(low)}|{_halved(high)})"


def _anywhere(keywords: list[str]) -> str:
    """A pattern that matches, without taking a character, where a keyword begins, and names the longest one."""
    firsts = "".join(map(_in_class, sorted({k[0] for k in keywords})))
    seconds = "".join(map(_in_class, sorted({k[1] for k in keywords if len(k) > 1})))
    look = f"(?=[{firsts}][{seconds}])" if all(len(k) > 1 for k in keywords) else f"(?=[{firsts}])"
    return f"{look}(?=({_halved(keywords)}))"


def keywords_in(text, *lists: list[str]) -> Column:
    """The different keywords of all lists that a lower-cased text holds anywhere, also within words, in no order.

    The text is gone through once, whatever the number of keywords: at each
    character the longest keyword that begins there is taken, and those that it
    begins with are added. Keywords beyond ASCII are looked for one by one.
    """
    known = list(dict.fromkeys(k for ks in lists for k in ks))
    plain = [k for k in known if k.isascii() and k]
    others = [k for k in known if k not in plain]
    within = {k: [x for x in plain if x != k and k.startswith(x)] for k in plain}

    def found(low: Column) -> Column:
        parts = []
        if plain:
            at = lambda: F.array_distinct(F.regexp_extract_all(low, F.lit(_anywhere(plain)), F.lit(1)))
            longer = [k for k in plain if within[k]]
            add = lambda x: F.concat(x, *[F.when(F.array_contains(x, k), F.array(*map(F.lit, within[k]))).otherwise(F.array().cast("array<string>")) for k in longer])
            parts.append(F.array_distinct(let(at(), add)) if longer else at())
        if others:
            parts.append(F.array_compact(F.array(*[F.when(low.contains(k), k) for k in others])))
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    return let(F.lower(text_or_empty(text)), found)


def _own(found: Column, keywords: list[str]) -> Column:
    """Whether any of the keywords is among those found."""
    return F.arrays_overlap(found, F.array(*map(F.lit, keywords)))


def every_keyword(domains=L.DOMAINS, levels=L.URGENCY, groups=L.AUDIENCES) -> list[list[str]]:
    """The keywords that LEX-01 to 04 ask for, for one :func:`keywords_in` that serves all of them."""
    return [ks for *_, ks in (*domains, *levels, *groups)]


def infer_domain(text, default="governance", domains=L.DOMAINS, found: Column | None = None) -> Column:
    """LEX-01: struct (domain, sub_category) with the most keywords, the first on a tie.

    Another domain than the default needs two hits and more than the default has.
    ``found``, here and below, is what :func:`keywords_in` has found of these
    keywords and maybe of others.
    """
    default = default if isinstance(default, Column) else F.lit(default)
    found = keywords_in(text, *[ks for _, _, ks in domains]) if found is None else found

    def scores(own: Column) -> Column:
        hits = lambda kws: reduce(lambda a, b: a + b, [F.array_contains(own, k).cast("int") for k in kws])
        return F.array(*[F.struct(hits(kws).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("domain"), F.lit(s).alias("sub")) for i, (d, s, kws) in enumerate(domains)])

    def choice(x: Column) -> Column:
        best, own = x["best"], x["own"]
        own_n = F.coalesce(own["n"], F.lit(0))
        keep = (best["n"] == 0) | ((best["domain"] != default) & (best["n"] < F.greatest(F.lit(2), own_n + 1)))
        return F.struct(F.when(keep, default).otherwise(best["domain"]).alias("domain"), F.when(~keep, best["sub"]).when(own_n > 0, own["sub"]).alias("sub_category"))

    def bests(scored: Column) -> Column:
        return F.struct(F.array_max(scored).alias("best"), F.array_max(F.filter(scored, lambda x: x["domain"] == default)).alias("own"))

    return let(let(let(found, scores), bests), choice)


def infer_urgency(text, levels=L.URGENCY, found: Column | None = None) -> Column:
    """LEX-02: the first level with a keyword, else medium."""
    first = lambda own: reduce(lambda c, lv: c.when(_own(own, lv[1]), lv[0]), levels[1:], F.when(_own(own, levels[0][1]), levels[0][0])).otherwise("medium")
    return let(keywords_in(text, *[ks for _, ks in levels]) if found is None else found, first)


def infer_audience(text, groups=L.AUDIENCES, found: Column | None = None) -> Column:
    """LEX-03: every group with a keyword, else everyone."""
    own = keywords_in(text, *[ks for _, ks in groups]) if found is None else found
    groups_ = let(own, lambda own: F.array_compact(F.array(*[F.when(_own(own, kws), name) for name, kws in groups])))
    return let(groups_, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("everyone"))))


def extract_keywords(text, limit: int = 5, domains=L.DOMAINS, found: Column | None = None) -> Column:
    """LEX-04: the first distinct keywords in the order of the lexicon."""
    known = list(dict.fromkeys(k for _, _, kws in domains for k in kws))
    own = keywords_in(text, known) if found is None else found
    return let(own, lambda own: F.slice(F.filter(F.array(*map(F.lit, known)), lambda k: F.array_contains(own, k)), 1, limit))


def _forms(keep: str, others: list[str]) -> list[str]:
    """Distinct forms, longest first; equal lengths by the alphabet, which changes no result."""
    return sorted({keep, *others}, key=lambda f: (-len(f), f))


def _bounded(form: str) -> str:
    return f"(?i)(?<![A-Za-z0-9]){literal(form)}(?![A-Za-z0-9])"


def _with_lower(text, body) -> Column:
    """``body`` of a text and of its lower-cased self, each worked out once."""
    return let(text_or_empty(text), lambda t: let(F.lower(t), lambda low: body(t, low)))


def _found(text: Column, lowered: Column, forms: list[str]) -> Column:
    """Whether any form stands as a word of its own; patterns are tried only where the letters are there."""
    return _any(lowered, [f.lower() for f in forms]) & text.rlike("|".join(_bounded(f) for f in forms))


def glossary_hits(text, glossary=L.GLOSSARY) -> Column:
    """LEX-05: kept forms of the entries found as words of their own."""
    return _with_lower(text, lambda t, low: F.array_compact(F.array(*[F.when(_found(t, low, _forms(k, o)), k) for k, o in glossary])))


def glossary_rewrite(text, glossary=L.GLOSSARY) -> Column:
    """LEX-06: other forms replaced by the kept one, entry by entry, longest first."""
    out = text_or_empty(text)
    for keep, others in glossary:
        forms = [f for f in _forms(keep, others) if f != keep]
        replaced = lambda t: reduce(lambda c, f: F.regexp_replace(c, _bounded(f), keep.replace("$", r"\$")), forms, t)  # noqa: B023, E731
        if forms:
            out = let(out, lambda t: F.when(let(F.lower(t), lambda low: _any(low, [f.lower() for f in forms])), replaced(t)).otherwise(t))  # noqa: B023
    return out


def glossary_preservation(source, target, glossary=L.GLOSSARY) -> Column:
    """LEX-07: share of the source's entries whose kept form is in the target; 1 without any."""
    target = text_or_empty(target)
    # The kept forms of the entries that the source has, as the target is asked for those only.
    found = _with_lower(source, lambda t, low: F.array_compact(F.array(*[F.when(_found(t, low, _forms(k, o)), F.struct(F.lit(i).alias("i"))) for i, (k, o) in enumerate(glossary)])))
    has = lambda t, low, i: reduce(lambda c, x: c.when(i == x[0], _found(t, low, [x[1][0]])), enumerate(glossary), F.when(F.lit(False), F.lit(False)))
    kept = lambda f: _with_lower(target, lambda t, low: F.size(F.filter(f, lambda x: has(t, low, x["i"]))))
    return let(found, lambda f: F.when(F.size(f) == 0, 1.0).otherwise(kept(f) / F.size(f)))


def bilingual_domain(text, domains=L.BILINGUAL_DOMAINS) -> Column:
    """LEX-08: the first domain with a keyword, else Governance."""
    first = lambda low: reduce(lambda c, d: c.when(_any(low, d[1]), d[0]), domains[1:], F.when(_any(low, domains[0][1]), domains[0][0])).otherwise("Governance")
    return let(F.lower(text_or_empty(text)), first)


def model_code(language) -> Column:
    """LEX-09: the model's code of a language id; an unknown id is an error."""
    codes = F.create_map(*[F.lit(x) for code, _, model, _ in L.LANGUAGES for x in (code, model)])
    return F.coalesce(F.try_element_at(codes, _col(language)), F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(_col(language), F.lit("null")))))
