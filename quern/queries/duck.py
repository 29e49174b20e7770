"""Pieces of DuckDB SQL that the oracles are put together from."""

from __future__ import annotations

from types import SimpleNamespace

#: White space as Unicode's White_Space property has it, for RE2.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def bounded(pattern: str) -> str:
    r"""A pattern whose ``\b`` at its ends take other letters than ASCII as parts of words, too."""
    return pattern


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(f'[{WS}]+')}, ' ', 'g'), ' ')"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def wc(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), {q(f'[^{WS}]+')}))"


def words(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), {q(f'[^{WS}]+')})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def word_tokens(x: str) -> str:
    tok = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?"
    return f"list_transform(regexp_extract_all({x}, {q(tok)}), lambda w: lower(w))"


def title_hint(x: str) -> str:
    t = collapse(x)
    return f"CASE WHEN contains(substr({t}, 1, 160), '. ') THEN split_part({t}, '. ', 1) ELSE substr({t}, 1, 100) END"


def score(title: str, text: str, rules: SimpleNamespace) -> str:
    """The unrounded notice score."""
    both = f"lower({title} || chr(10) || {text})"
    parts = ["0.0::DOUBLE"]
    parts += [f"+ CASE WHEN {has(both, p)} THEN 0.12::DOUBLE ELSE 0::DOUBLE END" for p in rules.positive]
    parts += [f"- CASE WHEN {has(both, p)} THEN 0.25::DOUBLE ELSE 0::DOUBLE END" for p in rules.negative]
    parts += [f"+ CASE WHEN {has(strip(title), '(?i)' + rules.prefix)} THEN 0.2::DOUBLE ELSE 0::DOUBLE END"]
    parts += [f"+ CASE WHEN {has(both, rules.organisations)} THEN 0.15::DOUBLE ELSE 0::DOUBLE END"]
    parts += [f"+ least({count(both, rules.imperatives)} * 0.05::DOUBLE, 0.2::DOUBLE)"]
    n = wc(text)
    parts += [f"+ CASE WHEN {n} > 500 THEN -0.25::DOUBLE WHEN {n} > 300 THEN -0.15::DOUBLE WHEN {n} < 12 THEN -0.2::DOUBLE WHEN {n} BETWEEN 15 AND 250 THEN 0.15::DOUBLE WHEN {n} BETWEEN 251 AND 300 THEN 0.05::DOUBLE ELSE 0::DOUBLE END"]
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {' '.join(parts)}))"


def gate(cte: str, rules: SimpleNamespace, source: str = "''", lang: str = "'en'") -> str:
    """A SELECT of ``id, reason`` from ``cte(id, text, src, lang)``."""
    from quern.functions import lexicons as L

    any_of = lambda names: " OR ".join(f"contains(source_l, {q(n)})" for n in names)
    return f"""
    SELECT id, CASE
      WHEN n = 0 THEN 'empty_text'
      WHEN {has('w', '(?i)' + rules.navigation)} THEN 'nav_boilerplate'
      WHEN {has('w', '(?i)' + rules.listing)} THEN 'listing_page_dump'
      WHEN {count('w', 'Home')} >= 3 AND contains(w, 'About') THEN 'menu_like'
      WHEN {has('w', '(?i)' + rules.stub)} AND NOT force THEN 'ngo_website_stub'
      WHEN ({any_of(L.ABOUT_PAGES)}) AND (NOT force OR n < 40) THEN 'ngo_about_page'
      WHEN {has('w', '(?i)' + rules.off_topic)} AND NOT force THEN 'off_topic_news'
      WHEN {has('w', '(?i)' + rules.listicle)} AND NOT force THEN 'listicle_not_psa'
      WHEN n < 12 AND force AND n >= 8 THEN NULL
      WHEN n < 12 THEN 'too_short'
      WHEN n > 350 THEN 'too_long_for_psa'
      WHEN lang NOT IN ('en', 'sw', '', 'unknown') THEN 'non_target_language:' || lang
      WHEN n < 25 AND NOT force AND ({any_of(L.NGO_HOSTS)}) THEN 'short_ngo_non_psa'
      WHEN {has('w', '(?i)' + rules.report)} THEN 'report_not_psa'
      WHEN {has('w', '(?i)' + rules.genre)} AND NOT force THEN 'genre_news_not_psa'
      WHEN score < 0.28::DOUBLE AND NOT force THEN 'low_psa_score:' || printf('%.2f', score)
      WHEN force AND score < 0.15::DOUBLE AND n > 220 THEN 'weak_forced_narrative:' || printf('%.2f', score)
      WHEN score < 0.18::DOUBLE AND n > 250 THEN 'weak_long_narrative:' || printf('%.2f', score)
    END AS reason
    FROM (SELECT *, round_even({score('t', 'b', rules)}, 3) AS score FROM (
      SELECT id, w, lang, source_l, n, force,
        CASE WHEN own THEN head ELSE substr(w, 1, 120) END AS t, CASE WHEN own AND rest <> '' THEN rest ELSE w END AS b
      FROM (SELECT *, split_part(w, '. ', 1) AS head, substr(w, length(split_part(w, '. ', 1)) + 3) AS rest,
              contains(substr(w, 1, 180), '. ') AND {wc("split_part(w, '. ', 1)")} BETWEEN 3 AND 25 AS own
            FROM (SELECT id, {collapse('text')} AS w, lang, lower(src) AS source_l, {wc('text')} AS n,
                    {has(collapse('text'), '(?i)' + rules.force)} AS force FROM {cte}))))"""


def core(title: str, text: str, most: int, force: str) -> str:
    """The core of a text: its title and leading paragraphs, folded one by one."""
    from quern.functions import lexicons as L

    # A class within a class in the pattern isn't SQL's way; white space is spelled out.
    marker = L.STOP_MARKERS.replace("\\s", f"[{WS}]")
    body = strip(f"regexp_replace(string_split_regex(replace(coalesce({text}, ''), chr(13), chr(10)), {q('(?i)' + marker)})[1], '\\n{{3,}}', chr(10) || chr(10), 'g')")
    cut = q(f"\\n[{WS}]*\\n")
    paragraphs = f"list_filter(list_transform(string_split_regex(core_body, {cut}), lambda p: {collapse('p')}), lambda p: p <> '')"
    joined = "trim(a.text || ' ' || x.text, ' ')"
    room = f"({most} - {wc('a.text')})"
    part = f"CASE WHEN {room} >= 20 THEN trim(a.text || ' ' || array_to_string(list_slice({words('x.text')}, 1, greatest({room}, 0)), ' '), ' ') ELSE a.text END"
    step = f"""CASE WHEN a.done OR {wc('x.text')} < 5 OR ({count('x.text', 'Home')} >= 2 AND contains(x.text, 'About')) THEN a
      WHEN {wc(joined)} > {most} THEN {{'text': {part}, 'done': true}}
      ELSE {{'text': {joined}, 'done': ({wc(joined)} >= 80 AND {has(joined, '(?i)' + force)}) OR {wc(joined)} >= 160}} END"""
    head = "CASE WHEN core_title <> '' AND NOT starts_with(lower(coalesce(core_parts[1], '')), substr(lower(core_title), 1, 40)) THEN regexp_replace(core_title, '[.]+$', '') || '.' ELSE '' END"
    fold = f"trim(list_reduce(list_prepend({{'text': {head}, 'done': false}}, list_transform(core_parts, lambda p: {{'text': p, 'done': false}})), lambda a, x: {step}).text, ' ')"
    first = f"array_to_string(list_slice({words('core_body')}, 1, {most}), ' ')"
    return (
        f"(SELECT CASE WHEN core_out <> '' THEN core_out ELSE {first} END FROM (SELECT *, {fold} AS core_out FROM (SELECT *, {paragraphs} AS core_parts FROM "
        f"(SELECT {body} AS core_body, {collapse(title)} AS core_title))))"
    )


def framework(cte: str, rules: SimpleNamespace) -> str:
    """A SELECT of ``id, label, confidence, reason, a, p, o, n, is_strict`` from ``cte(id, text, title)``."""
    both = "trim(t || '. ' || w, '. ')"
    quoted = f"({count('c', chr(34))} >= 4 OR {has('c', '(?i)' + rules.quotes)})"
    tree = f"""CASE WHEN a > 0 AND NOT (p > 0 AND p >= a + 2 AND n > 280) THEN
          CASE WHEN {quoted} AND a <= 1 AND n > 280 THEN {{'l': 'press_release', 'r': 'narrative_media_coverage_over_weak_action', 'c': 0.55::DOUBLE}}
            WHEN n > 280 AND a <= 1 AND p >= 2 THEN {{'l': 'press_release', 'r': 'long_press_style_with_weak_psa_cue', 'c': 0.6::DOUBLE}}
            WHEN n < 8 THEN {{'l': 'not_psa', 'r': 'too_short_for_psa', 'c': 0.15::DOUBLE}}
            WHEN n > 400 THEN {{'l': 'not_psa', 'r': 'too_long_for_framework_psa', 'c': 0.35::DOUBLE}}
            ELSE {{'l': 'psa', 'r': 'public_action_advisory_or_alert', 'c': 0.55::DOUBLE + least(0.35::DOUBLE, a * 0.08::DOUBLE) + (CASE WHEN n <= 180 THEN 0.08::DOUBLE ELSE 0::DOUBLE END) - (CASE WHEN n > 280 THEN 0.12::DOUBLE ELSE 0::DOUBLE END)}} END
        WHEN p > 0 THEN {{'l': 'press_release', 'r': 'government_activity_or_media_narrative', 'c': 0.5::DOUBLE + least(0.3::DOUBLE, p * 0.07::DOUBLE)}}
        WHEN o > 0 THEN {{'l': 'other_gov_comm', 'r': 'legal_admin_tender_or_gazette_style', 'c': 0.55::DOUBLE + least(0.25::DOUBLE, o * 0.08::DOUBLE)}}
        ELSE {{'l': 'not_psa', 'r': 'no_framework_intent_match', 'c': 0.2::DOUBLE}} END"""
    return f"""SELECT id, x.l AS label, cf AS confidence, x.r AS reason, a, p, o, n, x.l = 'psa' AND cf >= 0.55::DOUBLE AS is_strict
          FROM (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, round_even(x.c, 3))) AS cf FROM (SELECT *, {tree} AS x FROM (
            SELECT id, n, c, {count('c', '(?i)' + rules.action)} AS a, {count('c', '(?i)' + rules.press)} AS p, {count('c', '(?i)' + rules.other)} AS o
            FROM (SELECT id, n, {both} AS c FROM (SELECT id, {wc('text')} AS n, {collapse('text')} AS w, {collapse('title')} AS t FROM {cte})))))"""


def sentences(x: str, least: int = 6) -> str:
    """Sentences of at least ``least`` words, long ones not cut."""
    t = collapse(x)
    cut = "regexp_replace({t}, {p}, {r}, 'g')".format(t=t, p=q("([.!?]) +([A-Z\"'(])"), r=q("\\1\x1e\\2"))
    parts = f"list_transform(string_split({cut}, chr(30)), lambda p: trim(p, {q(' ' + chr(9) + chr(10) + chr(34) + chr(39))}))"
    return f"list_filter({parts}, lambda s: NOT starts_with(s, '#') AND NOT starts_with(s, 'http') AND {wc('s')} >= {least})"
