"""Personal data and the terms that reveal it, by information theory.

Method: base patterns find protected entities. How strongly a term discloses an
entity is the pointwise mutual information of the two, estimated from the
corpus: in how many of the term's texts it stands near the entity, against the
share of all words that do. A term that carries at least ``GENERALISE`` of the
entity's information content is replaced by a general word, one that carries
``REMOVE`` of it is removed (after Sanchez & Batet's C-sanitized). Each text
counts once, so copies of it prove nothing. A term counts if the lower confidence
bound of its share of texts carries that much; how much it carries is told by the
share smoothed by ``DOUBT`` texts. So an entity of a single text is protected, but
a common word that met it once is not taken for a disclosure.

DataFrame functions only. Positions come from the pieces between matches, as no
function returns them, by running sums in blocks. Patterns use possessive
repeats, so that no text makes them backtrack or recurse. A text of n characters
with m spans or words takes some n + m^1.5 steps in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let
from quern.plans.stage_table import stage_table

KINDS = ("email", "ip", "card", "phone")
REACH = 64
CHUNK = 1024
#: Texts without the entity that each term is taken to have besides its own.
DOUBT = 0.5
#: Normal quantile of the one-sided 95 % bound (Wilson's).
BOUND = 1.645
GENERALISE, REMOVE = 0.85, 0.95
#: Rows up to which a table is broadcast; beyond, it is joined by a shuffle.
SMALL = 100_000

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # A match may start at the first local character of a run, or right after a match.
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap look at whether a kind can be there at all.
_HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
#: Noncharacters that stand for what base spans cover.
_WORDLIKE, _OTHER = "\ufffe", "\uffff"
_WORD_BREAK = r"[^\p{L}\p{N}]+"
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _running(values: Column, join, first: Column) -> Column:
    """Array of ``first`` and of what ``join`` makes of it and each value in turn.

    By blocks of as many values as there are blocks: an array that grows by one
    value at a time is copied each time, which for n values in one go costs n^2.
    """

    def grown(xs: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

    def joined(xs: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(xs))).cast("int")
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), wide)).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(starts, lambda at: grown(F.slice(xs, at, wide)))
        whole = lambda bs, before: F.flatten(F.transform(bs, lambda b, j: F.transform(F.slice(b, 2, wide), lambda x: join(F.get(before, j), x))))
        return let(blocks, lambda bs: let(grown(F.transform(bs, lambda b: F.element_at(b, -1))), lambda before: F.concat(F.array(first), whole(bs, before))))

    return let(values, joined)


def _found(text: Column, pattern: str, guard: Column) -> Column:
    """Start, end (code points, exclusive) and value of each leftmost match; none where the guard says so."""

    def spans(matches: Column, pieces: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))
        struct = lambda ends: lambda m, i: F.struct((F.get(ends, i + 1) - F.length(m)).alias("start"), F.get(ends, i + 1).alias("end"), m.alias("value"))
        return let(_running(lengths, lambda a, b: a + b, F.lit(0)), lambda ends: F.transform(matches, struct(ends)))

    pattern = F.lit(pattern)
    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda p: spans(m, p))))
    return F.coalesce(F.when(guard, found), F.array()).cast(_SPAN)


def _chunks(text: Column) -> Column:
    """A text in parts of ``CHUNK`` code points: a part of a long text is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, empty where that is not after ``start``."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    part = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(part, start - first * CHUNK + 1, end - start)).otherwise("")


def _tops(spans: Column) -> Column:
    """The largest end of all spans before each one, and of all."""
    return _running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))


def _only(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _tagged(spans: str, place: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def base_spans(df: DataFrame) -> DataFrame:
    """Adds an array ``<kind>_`` of valid spans for each kind to rows with ``text``."""
    text = F.col("text")
    for kind in KINDS:
        df = df.withColumn(f"{kind}_", _found(text, PATTERNS[kind], text.rlike(_HINTS[kind])))
        df = df.withColumn(f"{kind}_", _only(f"{kind}_", kind))
    return df


def _all_spans(kinds: tuple[str, ...]) -> Column:
    """Sorted (start, kind's place, end, kind, value)."""
    return F.array_sort(F.concat(*[_tagged(f"{k}_", i, k) for i, k in enumerate(kinds)]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), _WORD_BREAK)), lambda t: (F.length(t) >= 3) & t.rlike(r"\p{L}"))


def _surroundings(found: DataFrame) -> DataFrame:
    """(node, entity, term) of every word near a base span; words cut by the reach are left out."""

    def of_span(chunks: Column, s: Column) -> Column:
        value = F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(F.regexp_replace(s["value"], "[^0-9]", ""))
        low = F.greatest(s["start"] - REACH, F.lit(0))
        left = _between(chunks, low, s["start"])
        left = F.when(low > 0, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
        right = F.regexp_replace(_between(chunks, s["end"], s["end"] + REACH), r"[\p{L}\p{N}]+$", "")
        return F.struct(F.concat(s["kind"], F.lit(":"), value).alias("entity"), _terms(F.concat(left, F.lit(" "), right)).alias("terms"))

    # What a span's row needs is worked out before the spans part, so that they don't each take the text along.
    near = let(_chunks(F.col("text")), lambda chunks: F.transform("base", lambda s: of_span(chunks, s)))
    spans = found.select("node", near.alias("near")).select("node", F.explode("near").alias("s"))
    return spans.select("node", F.col("s.entity").alias("entity"), F.explode("s.terms").alias("term"))


def disclosing_terms(texts: DataFrame, near: DataFrame) -> DataFrame:
    """``(entity, term, share)``: terms that carry at least ``GENERALISE`` of an entity's information.

    ``texts(words, terms)`` are the different texts, ``near(node, entity,
    term)`` the terms near each entity, once a text.
    """
    by_pair = stage_table(near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("joint")), "pairs")
    total = texts.agg(F.sum("words")).first()[0] or 0
    used = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    sizes = by_pair.groupBy("entity").agg(F.sum("joint").alias("words"))
    content = -F.log2(F.least(F.col("words") / F.lit(float(max(total, 2))), F.lit(0.5)))
    n, z2 = F.greatest("uses", "joint"), BOUND**2
    p = F.col("joint") / n
    least = (p + z2 / 2 / n - BOUND * F.sqrt(p * (1 - p) / n + z2 / 4 / n / n)) / (1 + z2 / n)
    share = lambda chance: (F.log2(chance) + content) / content
    both = by_pair.join(used, "term").join(sizes, "entity").select("entity", "term", share(least).alias("least"), share(F.col("joint") / (n + DOUBT)).alias("share"))
    return both.where(F.least("least", "share") >= GENERALISE).drop("least")


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows with ``*keep, text, base, all``: spans (start, place, end, kind, value) in order.

    ``base`` holds the patterns' valid matches, ``all`` also kinds ``general``
    and ``removed`` of disclosing terms outside of base spans, in every text that
    has the term, whether or not it prints the entity. Null counts as empty and
    has no span. Equal texts are treated alike, repeated rows stay; an empty table
    gives an empty one; only ``keep`` of the other columns is returned. A very
    long text is one row's work: its spans are found without backtracking and
    placed by sums in blocks, some n + m^1.5 steps for n characters and m spans.
    """
    rows = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = base_spans(rows).withColumn("base", _all_spans(KINDS))
    with_base = found.where(F.size("base") > 0).withColumn("node", F.md5(F.col("text").cast("binary")))
    near = stage_table(_surroundings(with_base).distinct(), "near")
    texts = rows.where("text <> ''").select("text").distinct()
    texts = texts.select(F.md5(F.col("text").cast("binary")).alias("node_"), F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")).alias("words"), _terms(F.col("text")).alias("terms"))
    texts = stage_table(texts, "texts")
    shown = stage_table(disclosing_terms(texts, near), "shown")
    # A term gives its entity away wherever it stands; the strongest claim on it decides.
    strongest = stage_table(shown.groupBy("term").agg(F.max("share").alias("share")), "strongest")
    of_doc = texts.select("node_", F.explode("terms").alias("term")).join(F.broadcast(strongest) if strongest.count() <= SMALL else strongest, "term")
    of_doc = of_doc.groupBy("node_").agg(F.collect_list(F.when(F.col("share") < REMOVE, F.col("term"))).alias("general_t"), F.collect_list(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("removed_t"))
    of_doc = stage_table(of_doc, "terms")
    placed = found.withColumn("node", F.md5(F.col("text").cast("binary")))
    joined = placed.join(F.broadcast(of_doc) if of_doc.count() <= SMALL else of_doc, F.col("node") == F.col("node_"), "left")
    return _with_terms(joined).select(*[F.col(f"keep_{c}").alias(c) for c in keep], "text", "base", "all")


def _masked(text: Column, base: Column) -> Column:
    """A text of the same length with base spans blotted out: letters and digits by one noncharacter, the rest by another."""
    blot = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\p{L}\p{N}]", _WORDLIKE), f"[^{_WORDLIKE}]", _OTHER)

    def whole(chunks: Column, tops: Column) -> Column:
        piece = lambda s, i: F.concat(_between(chunks, F.get(tops, i), s["start"]), blot(_between(chunks, F.greatest(F.get(tops, i), s["start"]), s["end"])))
        return F.concat(F.array_join(F.transform(base, piece), ""), _between(chunks, F.element_at(tops, -1), F.length(text)))

    return F.when(F.size(base) > 0, let(_chunks(text), lambda c: let(_tops(base), lambda t: whole(c, t)))).otherwise(text)


def _with_terms(df: DataFrame) -> DataFrame:
    """Adds ``all``: base spans, and those of a document's ``general_t`` and ``removed_t`` outside of them."""
    kinds = ("general", "removed")
    some = F.coalesce(F.size("general_t") + F.size("removed_t") > 0, F.lit(False))
    df = df.withColumn("masked_", F.when(some, _masked(F.col("text"), F.col("base"))))
    # A run of letters that reaches into a base span holds a blot and so is no term.
    df = df.withColumn("words_", _found(F.col("masked_"), rf"[\p{{L}}\p{{N}}{_WORDLIKE}]+", some))
    for kind in kinds:
        df = df.withColumn(f"{kind}_", F.when(some, F.filter("words_", lambda s: F.array_contains(f"{kind}_t", F.lower(s["value"])))).otherwise(F.array().cast(_SPAN)))  # noqa: B023
    return df.withColumn("all", _all_spans((*KINDS, *kinds)))


def sanitise(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces ``text``: base spans by ``[KIND]``, general terms by ``[TERM]``, removed ones by nothing.

    Of overlapping spans the first to start names the replacement of their
    union. Rows without a span keep their text.
    """
    word = lambda s: F.when(s["kind"] == "removed", "").when(s["kind"] == "general", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def whole(chunks: Column, tops: Column) -> Column:
        piece = lambda s, i: F.when(s["start"] >= F.get(tops, i), F.concat(_between(chunks, F.get(tops, i), s["start"]), word(s))).otherwise("")
        return F.concat(F.array_join(F.transform("all", piece), ""), _between(chunks, F.element_at(tops, -1), F.length("text")))

    new = let(_chunks(F.col("text")), lambda c: let(_tops(F.col("all")), lambda t: whole(c, t)))
    return found.withColumn("text", F.when(F.size("all") > 0, new).otherwise(F.col("text")))


def personal_data_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Nulls, empty and very long texts, repeated rows and clashing columns are as
    :func:`find_personal_data` has them: a null or empty text has no span and the
    digest of an empty string, a null id stays null, an empty table gives an empty one.
    """
    found = find_personal_data(docs, text_col, (id_col,))
    counts = [_number(k).alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
