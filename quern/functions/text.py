"""Text functions: Column to Column, built-in expressions only.

White space is Unicode's White_Space property, spelled out so that a pattern
needs no Unicode mode. Functions take a column or its name and treat null as
the empty text unless they say otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import lexicons as L

WS = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same characters themselves.
_WHITE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Those beyond ASCII, after a range that rules out most characters at one look.
_FAR_WHITE = r"[\x85-\u3000&&[\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
#: Characters of a text's start among which its title is looked for first.
_HEAD = 1000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and named, however often the body uses it.

    Without it, a plan repeats the value's expression at each use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def blank_to_null(c) -> Column:
    """``x or y`` of a language where the empty text is false: null for empty."""
    c = _col(c)
    return F.when(c != "", c)


def strip(c) -> Column:
    """Without white space at either end."""
    return F.trim(text_or_empty(c), F.lit(_WHITE))


def strip_chars(c, chars: str) -> Column:
    """Without any of ``chars`` at either end."""
    return F.trim(text_or_empty(c), F.lit(chars))


def _holds(t: Column, characters: str) -> Column:
    return reduce(lambda a, b: a | b, [t.contains(w) for w in characters])


def _may_be_far(t: Column) -> Column:
    """Whether a text can hold white space beyond ASCII: by its characters, those from U+2000 on by the two bytes they begin with."""
    return _holds(t, "\x85\xa0\u1680\u205f\u3000") | F.contains(t.cast("binary"), F.unhex(F.lit("E280")))


def _spaced(t: Column) -> Column:
    """A space for each white-space character.

    A replacement of one character by another passes over a text several times as
    fast as a pattern of many or a translation, which is left to texts with white space beyond ASCII.
    """
    lines = F.when(t.contains("\n"), F.replace(t, F.lit("\n"), F.lit(" "))).otherwise(t)
    plain = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit(" ")), "\t\n\x0b\f\r", t)
    rare = _holds(t, "\t\x0b\f\r")
    far = (F.octet_length(t) > F.length(t)) & _may_be_far(t) & t.rlike(_FAR_WHITE)
    return F.when(far, F.translate(t, _WHITE, " " * len(_WHITE))).when(rare, plain).otherwise(lines)


def collapse(c) -> Column:
    """TXT-01: runs of white space become one space; stripped."""
    single = lambda s: F.when(s.contains("  "), F.regexp_replace(s, " {2,}", " ")).otherwise(s)
    return F.trim(let(let(text_or_empty(c), _spaced), single))


def words(c) -> Column:
    """Words of white space, as an array.

    White space of all kinds becomes single spaces first: a text is cut at one
    character several times as fast as by a pattern of many.
    """
    return let(collapse(c), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def word_count(c) -> Column:
    """TXT-05: number of words of white space."""
    return let(collapse(c), collapsed_count)


def collapsed_count(t: Column) -> Column:
    """Number of words of a text that is collapsed already."""
    return F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def long_in_either(en, sw, least: int = 8) -> Column:
    """FLT-01: whether either version has ``least`` words."""
    return (word_count(en) >= least) | (word_count(sw) >= least)


def first_words(c, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def strip_boilerplate(c) -> Column:
    """TXT-03: stripped lines without empty ones and those that start as menus do."""
    lines = F.transform(F.split(text_or_empty(c), r"\R"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike("(?i)" + L.BOILERPLATE)), "\n")


def extract_text(raw, html_text) -> Column:
    """TXT-02: the raw text if it isn't blank, else the page's text."""
    return F.coalesce(blank_to_null(strip(raw)), text_or_empty(html_text))


def alnum_boundaries(c) -> Column:
    """TXT-07: a space between letters and digits, but within ordinals."""
    c = F.regexp_replace(text_or_empty(c), r"([A-Za-z])(\d)", "$1 $2")
    return F.regexp_replace(c, r"(?i)(\d)(?!(?:st|nd|rd|th)\b)([A-Za-z])", "$1 $2")


def collapse_punctuation(c) -> Column:
    """TXT-08: three or more of the same ``!?.,:;`` become two."""
    return F.regexp_replace(text_or_empty(c), r"([!?.,:;])\1{2,}", "$1$1")


def tokens(c) -> Column:
    """TXT-10: alphanumeric tokens with one inner apostrophe or hyphen, and single marks."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(L.TOKEN.replace("\\s", WS)), F.lit(0))


def token_count(c) -> Column:
    """TXT-10: how many tokens there are, without making a list of them.

    These are the word tokens and every mark but the inner ones; each inner mark
    joins two runs of letters and digits to one word token.
    """

    def count(t: Column) -> Column:
        marks = F.length(F.regexp_replace(t, f"[A-Za-z0-9{WS}]+", ""))
        return let(word_token_count(t), lambda n: marks + n + n - F.regexp_count(t, F.lit("[A-Za-z0-9]+")))

    return let(text_or_empty(c), count)


def word_token_count(c) -> Column:
    """TXT-11: how many word tokens there are."""
    return F.regexp_count(text_or_empty(c), F.lit(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?"))


def word_tokens(c) -> Column:
    """TXT-11: lower-cased tokens that hold an ASCII letter or digit."""
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?"), F.lit(0)), F.lower)


def sentence_marks(c) -> Column:
    """TXT-12: runs of ``.!?``, at least 1 for a text that isn't empty."""
    n = F.regexp_count(text_or_empty(c), F.lit(r"[.!?]+"))
    return F.when(n > 0, n).otherwise((text_or_empty(c) != "").cast("int"))


def sentence_parts(c) -> Column:
    """TXT-13: parts after ``.!?`` and white space that have three words, at least 1."""
    return collapsed_parts(collapse(c))


def collapsed_parts(t: Column) -> Column:
    """The same of a text that is collapsed already, without a list of the parts.

    A part has three words if none of the first two that it begins with ends it.
    """
    return F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"(?<=^|[.!?] )[^ ]*[^ .!?] [^ ]*[^ .!?] [^ ]")))


def simple_sentences(c, least: int = 5) -> Column:
    """TXT-28: stripped sentences of at least ``least`` words."""
    parts = F.transform(F.split(text_or_empty(c), rf"(?<=[.!?])[{WS}]+"), strip)
    return F.filter(parts, lambda p: word_count(p) >= least)


def url_count(c) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(rf"(?i)https?://[^{WS}]+|www\.[^{WS}]+"))


def hashtag_count(c) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(r"#[\p{L}\p{N}_]+"))


def mention_count(c) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(r"@[\p{L}\p{N}_]+"))


def code_switching(normalised, language, cues: list[str] = L.SWAHILI_CUES) -> Column:
    """TXT-15: struct (code_switch, sw_cue_count, sw_cue_ratio, lang_primary)."""
    language = _col(language)

    def signals(f: Column) -> Column:
        hits, n = f["hits"], f["n"]
        ratio = hits / n
        mixed = (ratio.between(0.08, 0.55) & (hits >= 2)) | (F.coalesce(language == "en", F.lit(False)) & (hits >= 3)) | (F.coalesce(language == "sw", F.lit(False)) & (ratio < 0.5))
        value = F.struct(mixed.alias("code_switch"), hits.alias("sw_cue_count"), F.bround(ratio, 4).alias("sw_cue_ratio"), language.alias("lang_primary"))
        none = F.struct(F.lit(False).alias("code_switch"), F.lit(0).alias("sw_cue_count"), F.lit(0.0).alias("sw_cue_ratio"), F.lit(None).cast("string").alias("lang_primary"))
        return F.when(n > 0, value).otherwise(none)

    return let(word_tokens(normalised), lambda own: let(F.struct(F.size(_hits(own, cues)).alias("hits"), F.size(own).alias("n")), signals))


def language_by_markers(c, markers: list[str] = L.SWAHILI_MARKERS) -> Column:
    """TXT-19: ``sw`` if two different markers are among the words, else ``en``."""
    own = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.when(F.size(F.array_intersect(own, F.array(*map(F.lit, markers)))) >= 2, "sw").otherwise("en")


#: Frequent short words that tell five languages apart, for :func:`guess_language`.
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with as it on be by this are".split(),
    "fr": "le la les de des et un une du en que qui est pour dans sur au".split(),
    "de": "der die das und ist von zu den mit im ein eine nicht des auf für dem".split(),
    "es": "el la los las de del y que en un una es por con para se no".split(),
    "sw": L.SWAHILI_CUES,
}


def guess_language(c, least_words: int = 5) -> Column:
    """TXT-17/18: the language whose function words are most frequent in the first 2,000 characters.

    ``unknown`` with fewer than ``least_words`` words, null where no function word is found; ties go to the first.
    """
    sample = F.substring(text_or_empty(c), 1, 2000)

    def best(own: Column) -> Column:
        scores = [F.struct(F.size(_hits(own, ws)).alias("n"), F.lit(-i).alias("o"), F.lit(code).alias("code")) for i, (code, ws) in enumerate(FUNCTION_WORDS.items())]
        return let(F.greatest(*scores), lambda b: F.when(b["n"] > 0, b["code"]))

    own = F.regexp_extract_all(F.lower(sample), F.lit(r"[\p{L}]+"), F.lit(0))
    return F.when(word_count(sample) < least_words, "unknown").otherwise(let(own, best))


def _hits(own: Column, known: list[str]) -> Column:
    return F.filter(own, lambda w: w.isin(known))


def clean_text(c) -> Column:
    """TXT-20: blanks and tabs collapse, at most one empty line; newlines stay."""
    # Each pattern is tried only where a text has what it would change.
    blanks = lambda t: F.when(t.contains("\t") | t.contains("  "), F.regexp_replace(t, r"[ \t]+", " ")).otherwise(t)
    lines = lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    return strip(let(let(F.replace(text_or_empty(c), F.lit("\r"), F.lit("\n")), blanks), lines))


def dedup_key(c) -> Column:
    """TXT-22: lower case, collapsed, stripped."""
    return collapse(F.lower(text_or_empty(c)))


def content_hash(c) -> Column:
    """TXT-21: SHA-256 of the dedup key."""
    return F.sha2(dedup_key(c).cast("binary"), 256)


def collapsed_hash(t: Column) -> Column:
    """TXT-21 of a text that is collapsed already; lower-casing makes no white space and takes none away."""
    return F.sha2(F.lower(t).cast("binary"), 256)


def primary_text(en, sw) -> Column:
    """TXT-23: the version with more words, the first on a tie."""
    both = F.struct(text_or_empty(en).alias("en"), text_or_empty(sw).alias("sw"))
    return let(both, lambda b: F.when(word_count(b["en"]) >= word_count(b["sw"]), b["en"]).otherwise(b["sw"]))


def title_hint(c) -> Column:
    """TXT-24: up to the first ``. `` if it comes within 160 characters, else 100 characters."""

    def hint(t: Column) -> Column:
        """By the start alone where that is long enough when collapsed."""
        return let(collapse(F.substring(t, 1, _HEAD)), lambda head: F.when((F.length(head) > 160) | (F.length(t) <= _HEAD), _hint(head)).otherwise(_hint(collapse(t))))

    return let(text_or_empty(c), hint)


def _hint(t: Column) -> Column:
    return F.when(F.substring(t, 1, 160).contains(". "), F.substring_index(t, ". ", 1)).otherwise(F.substring(t, 1, 100))


def title_and_body(c) -> Column:
    """TXT-25: struct (title, body) as the gate scores them."""

    def cut(t: Column) -> Column:
        parts = let(F.substring_index(t, ". ", 1), lambda title: F.struct(title.alias("title"), F.substring(t, F.length(title) + 3, F.length(t)).alias("rest"), (F.substring(t, 1, 180).contains(". ") & word_count(title).between(3, 25)).alias("own")))
        return let(parts, lambda p: F.struct(F.when(p["own"], p["title"]).otherwise(F.substring(t, 1, 120)).alias("title"), F.when(p["own"] & (p["rest"] != ""), p["rest"]).otherwise(t).alias("body")))

    return let(collapse(c), cut)


def join_title(title, body) -> Column:
    """SRC-13: ``title. body`` without dots and spaces at the ends, or whichever there is."""
    title, body = text_or_empty(title), text_or_empty(body)
    both = strip_chars(F.concat(title, F.lit(". "), body), ". ")
    return F.when((title != "") & (body != ""), both).when(body != "", body).otherwise(title)


def first_sentences(c, most: int = 600) -> Column:
    """TXT-26: short texts whole; of long ones two sentences, or 120 characters of them."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    grow = lambda a, p: F.when((a["n"] >= 2) | (F.length(a["text"]) >= 120), a).otherwise(F.struct(F.when(a["n"] == 0, p).otherwise(F.concat(a["text"], F.lit(" "), p)).alias("text"), (a["n"] + 1).alias("n")))

    def cut(t: Column) -> Column:
        parts = F.filter(F.split(t, r"(?<=[.!?]) +"), lambda p: collapsed_count(p) >= 5)
        long = let(F.aggregate(parts, start, grow)["text"], lambda x: F.when(x != "", x).otherwise(t))
        return strip(F.substring(F.when(collapsed_count(t) <= 200, t).otherwise(long), 1, most))

    return let(collapse(c), cut)


def split_sentences(c, least: int = 6, most: int = 80) -> Column:
    """TXT-27: sentences of ``least`` to ``most`` words; longer ones are cut after commas."""
    parts = F.split(collapse(c), r"(?<=[.!?]) +(?=[A-Z\"'(])")
    parts = F.filter(F.transform(parts, lambda p: strip_chars(p, " \t\n\"'")), lambda s: ~s.startswith("#") & ~s.startswith("http") & (word_count(s) >= least))

    def cut(s: Column) -> Column:
        def add(a: Column, ch: Column, last: Column) -> Column:
            joined = F.when(a["buf"] == "", ch).otherwise(F.concat(a["buf"], F.lit(" "), ch))
            sized = let(joined, lambda j: F.struct(j.alias("text"), word_count(j).alias("n")))
            flushed = lambda x: F.struct(x["text"].alias("text"), x["n"].alias("n"), ((x["n"] >= least) & ((x["n"] >= most // 2) | (ch == last))).alias("flush"))
            done = lambda x: F.struct(F.when(x["flush"] & (x["n"] <= most), F.concat(a["out"], F.array(x["text"]))).otherwise(a["out"]).alias("out"), F.when(x["flush"], "").otherwise(x["text"]).alias("buf"))
            return let(let(sized, flushed), done)

        def close(a: Column) -> Column:
            n = word_count(a["buf"])
            return F.when(n.between(least, most), F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"])

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
        fold = lambda chunks: let(F.element_at(chunks, -1), lambda last: F.aggregate(chunks, start, lambda a, ch: add(a, ch, last), close))
        return let(F.split(s, r"(?<=[,;:]) +"), fold)

    return F.flatten(F.transform(parts, lambda s: F.when(word_count(s) > most, cut(s)).otherwise(F.array(s))))


def navigation_crumb(c, homes: int = 2) -> Column:
    """FLT-09: whether a text is a site's menu: ``homes`` times the word of its first page, and that of the page about it."""
    c = _col(c)
    return (F.regexp_count(c, F.lit("Home")) >= homes) & c.contains("About")


def extract_core(title, text, most: int = 350, force: str = L.FORCE) -> Column:
    """TXT-29: title and leading paragraphs of up to ``most`` words, stopping at a solid notice."""
    stop = "(?i)" + L.STOP_MARKERS.replace("\\s", f"[{WS}]")
    lines = lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    body = strip(let(F.element_at(F.split(F.replace(text_or_empty(text), F.lit("\r"), F.lit("\n")), stop, 2), 1), lines))

    def add(a: Column, p: Column) -> Column:
        """A paragraph, collapsed as what is held already, so that words are counted by their spaces and the sum is known beforehand."""
        joined = F.trim(F.concat(a["text"], F.lit(" "), p))

        def whole(n: Column) -> Column:
            full = lambda j: (n >= 160) | ((n >= 80) & j.rlike("(?i)" + force))
            return let(joined, lambda j: F.struct(j.alias("text"), n.alias("n"), full(j).alias("done")))

        def cut(n: Column) -> Column:
            room = F.lit(most) - a["n"]
            part = F.trim(F.concat(a["text"], F.lit(" "), F.call_function("substring_index", p, F.lit(" "), room)))
            return F.struct(F.when(room >= 20, part).otherwise(a["text"]).alias("text"), n.alias("n"), F.lit(True).alias("done"))

        grown = lambda k: F.when((k < 5) | navigation_crumb(p), a).otherwise(let(a["n"] + k, lambda n: F.when(n > most, cut(n)).otherwise(whole(n))))
        return F.when(a["done"], a).otherwise(let(collapsed_count(p), grown))

    def fold(title: Column, body: Column, paragraphs: Column) -> Column:
        # Of the first paragraph more than the title's 40 characters can reach.
        first = F.lower(F.substring(F.coalesce(F.get(paragraphs, F.lit(0)), F.lit("")), 1, 400))
        head = F.when((title != "") & ~first.startswith(F.substring(F.lower(title), 1, 40)), F.concat(F.regexp_replace(title, r"\.+$", ""), F.lit("."))).otherwise("")
        start = let(head, lambda h: F.struct(h.alias("text"), collapsed_count(h).alias("n"), F.lit(False).alias("done")))
        core = F.trim(F.aggregate(paragraphs, start, add)["text"])
        return let(core, lambda x: F.when(x != "", x).otherwise(first_words(body, most)))

    paragraphs = lambda b: F.filter(F.transform(F.split(b, rf"\n[{WS}]*\n"), collapse), lambda p: p != "")
    return let(collapse(title), lambda t: let(body, lambda b: let(paragraphs(b), lambda ps: fold(t, b, ps))))


def normalize_domain(c) -> Column:
    """TXT-30: the known label, else title case; blank is Governance."""
    key = F.lower(strip(c))
    known = F.create_map(*[F.lit(x) for kv in L.DOMAIN_LABELS.items() for x in kv])
    return F.when(key == "", "Governance").otherwise(F.coalesce(F.try_element_at(known, key), F.initcap(key)))


def export_domain(c) -> Column:
    """TXT-31: underscores to spaces, title case, ``Security & Safety`` shortened."""
    d = F.initcap(F.translate(F.coalesce(blank_to_null(c), F.lit("governance")), "_", " "))
    return F.when(F.lower(d) == "security & safety", "Security").otherwise(d)


def numbered(pattern: str, *columns) -> Column:
    """TXT-32: ids such as ``psa_%d_%06d``."""
    return F.format_string(pattern, *columns)


def model_prompt(c, language) -> Column:
    """TXT-33: the translation prompt for a language id."""
    names = F.create_map(*[F.lit(x) for code, name, _, _ in L.LANGUAGES for x in (code, name)])
    return F.concat(F.lit("translate English to "), F.coalesce(F.try_element_at(names, _col(language)), _col(language)), F.lit(": "), text_or_empty(c))


def dry_run_target(c, language) -> Column:
    """TXT-34: the placeholder of a translation that hasn't been made."""
    return F.concat(F.lit("[DRY_RUN "), _col(language), F.lit("] "), F.substring(text_or_empty(c), 1, 80))


def strip_tags(c) -> Column:
    """TXT-35: without anything between angle brackets."""
    return F.regexp_replace(text_or_empty(c), "<[^>]+>", "")


def notice_score_words(c, known: list[str] = L.NOTICE_WORDS) -> Column:
    """TXT-36: how many of the known words are among the words, dots and commas being spaces."""
    own = words(F.translate(F.lower(text_or_empty(c)), ".,", "  "))
    return F.size(F.array_intersect(own, F.array(*map(F.lit, known))))
