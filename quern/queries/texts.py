"""Text functions, lexicons and rules over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import lexicons as L
from quern.functions import lexicon_match as M
from quern.functions import rules as R
from quern.functions import text as T
from quern.functions.python_hooks import nfkc
from quern.queries import duck as D
from quern.sources.tables import read_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", spread=True)


#: Texts that take the branches ordinary prose never takes; unioned to the corpus where rules are tested.
NOTICES = [
    (-1, "PUBLIC NOTICE. The commission reminds voters to register before the deadline. It is prohibited to carry more than one card.", "en", "https://x.go.ke/notices"),
    (-2, "Ministry of Health advises members of the public to avoid stagnant water and report any cholera outbreak to the nearest clinic within 24 hours.", "en", "https://health.go.ke"),
    (-3, "The match report said the premier league side won again; the stadium was full and the celebrity gossip went on for days in the city.", "en", "news"),
    (-4, "The cabinet secretary said the centre was launched on an official visit. He said it was announced, and signed an MOU to strengthen collaboration.", "en", "gov"),
    (-5, "Gazette Notice. Pursuant to the act of parliament, invitation to tender no. 15 for the county headquarters, expression of interest closes soon.", "en", "gov"),
    (-6, "Home About Us Home News Home Contact", "en", "https://www.amref.org/about-us/"),
    (-7, "Wash your hands and boil water in the ward.", "sw", "x"),
    (-8, "Mpesa and M-PESA users of KES and IEBC, NHIF: visit huduma centres; matatu and boda boda drivers too.", "fr", "x"),
    (-9, "", "en", ""),
    (-10, "Katika kaunti ya Nairobi serikali na wizara ya afya ni kwa umma wa Kenya.", "sw", "x"),
]
_NOTICE_SQL = ", ".join(f"({i}, {D.q(t)}, {D.q(l)}, {D.q(s)})" for i, t, l, s in NOTICES)
CORPUS_SQL = f"(SELECT doc_id AS id, text, lang, source AS src FROM documents UNION ALL SELECT * FROM (VALUES {_NOTICE_SQL}) v(id, text, lang, src))"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the notices, as ``id, text, lang, src``."""
    extra = spark.createDataFrame(NOTICES, "id long, text string, lang string, src string")
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("src")).unionByName(extra)


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_SENT = "greatest(1, len(list_filter(string_split(regexp_replace({t}, {p}, {r}, 'g'), chr(30)), lambda p: {w} >= 3)))".format(
    t=D.strip("text"), p=D.q(f"([.!?])[{D.WS}]+"), r=D.q("\\1\x1e"), w=D.wc("p")
)


@query(
    "token_stats",
    f"""SELECT id, {D.wc('text')}::BIGINT AS words, len(regexp_extract_all(text, {D.q(L.TOKEN.replace(chr(92) + 's', D.WS))}))::BIGINT AS tokens,
      len({D.word_tokens('text')})::BIGINT AS word_tokens, length(text)::BIGINT AS chars,
      CASE WHEN {D.count('text', '[.!?]+')} > 0 THEN {D.count('text', '[.!?]+')} WHEN text <> '' THEN 1 ELSE 0 END::BIGINT AS marks, {_SENT}::BIGINT AS sentences,
      {D.count('text', f'(?i)https?://[^{D.WS}]+|www[.][^{D.WS}]+')}::BIGINT AS urls, {D.count('text', '#[' + chr(92) + 'pL' + chr(92) + 'pN_]+')}::BIGINT AS hashtags,
      {D.count('text', '@[' + chr(92) + 'pL' + chr(92) + 'pN_]+')}::BIGINT AS mentions FROM {CORPUS_SQL}""",
)
def token_stats(spark, sf_dir):
    """TXT-05, 10 to 14."""
    long = lambda c, name: c.cast("long").alias(name)
    return corpus(spark, sf_dir).select(
        "id", long(T.word_count("text"), "words"), long(T.token_count("text"), "tokens"), long(T.word_token_count("text"), "word_tokens"), long(F.length("text"), "chars"),
        long(T.sentence_marks("text"), "marks"), long(T.sentence_parts("text"), "sentences"), long(T.url_count("text"), "urls"), long(T.hashtag_count("text"), "hashtags"), long(T.mention_count("text"), "mentions"),
    )


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), " + D.q(f"^[{D.WS}]+|[{D.WS}]+$") + ", '', 'g')"


@query(
    "clean_text",
    f"SELECT id, sha256({_CLEAN}) AS clean_sha256, sha256({D.collapse('lower(text)')}) AS content_hash, sha256({D.collapse('text')}) AS collapsed_sha256, sha256(regexp_replace(text, '<[^>]+>', '', 'g')) AS untagged_sha256 FROM {CORPUS_SQL}",
)
def clean_text(spark, sf_dir):
    """TXT-01, 20, 21, 35."""
    sha = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    return corpus(spark, sf_dir).select("id", sha(T.clean_text("text"), "clean_sha256"), T.content_hash("text").alias("content_hash"), sha(T.collapse("text"), "collapsed_sha256"), sha(T.strip_tags("text"), "untagged_sha256"))


_LINES = f"list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\x0B\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {D.strip('x')})"


@query("boilerplate_lines", f"SELECT id, sha256(array_to_string(list_filter({_LINES}, lambda x: x <> '' AND NOT regexp_matches(x, {D.q('(?i)' + L.BOILERPLATE)})), chr(10))) AS kept_sha256, len(list_filter({_LINES}, lambda x: x <> ''))::BIGINT AS lines FROM {CORPUS_SQL}")
def boilerplate_lines(spark, sf_dir):
    """TXT-03."""
    lines = F.filter(F.transform(F.split("text", r"\R"), T.strip), lambda x: x != "")
    return corpus(spark, sf_dir).select("id", F.sha2(T.strip_boilerplate("text").cast("binary"), 256).alias("kept_sha256"), F.size(lines).cast("long").alias("lines"))


_ALNUM = r"""replace(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])((?i:st|nd|rd|th))\b', '\1' || chr(1) || '\2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), chr(1), '')"""
_PUNCT = _ALNUM
for _c in "!?.,:;":
    _PUNCT = f"regexp_replace({_PUNCT}, '[{_c}]{{3,}}', '{_c}{_c}', 'g')"


@query("alnum_punctuation", f"SELECT id, sha256({_PUNCT}) AS sha256 FROM {CORPUS_SQL}")
def alnum_punctuation(spark, sf_dir):
    """TXT-07, 08."""
    return corpus(spark, sf_dir).select("id", F.sha2(T.collapse_punctuation(T.alnum_boundaries("text")).cast("binary"), 256).alias("sha256"))


@query("nfkc_text")
def nfkc_text(spark, sf_dir):
    """TXT-04, 09: composed and normalised texts."""
    from quern.plans.jobs import normalised

    return corpus(spark, sf_dir).select("id", normalised(nfkc("text")).alias("text_norm"))


_HITS = f"len(list_filter({D.word_tokens('text')}, lambda w: w IN ({', '.join(map(D.q, L.SWAHILI_CUES))})))"
_N = f"len({D.word_tokens('text')})"


@query(
    "code_switch",
    f"""SELECT id, CASE WHEN n = 0 THEN false ELSE (hits::DOUBLE / n BETWEEN 0.08::DOUBLE AND 0.55::DOUBLE AND hits >= 2) OR (lang = 'en' AND hits >= 3) OR (lang = 'sw' AND hits::DOUBLE / n < 0.5::DOUBLE) END AS code_switch,
      CASE WHEN n = 0 THEN 0 ELSE hits END::BIGINT AS sw_cue_count, CASE WHEN n = 0 THEN 0 ELSE round_even(hits::DOUBLE / n, 4) END::DOUBLE AS sw_cue_ratio, CASE WHEN n > 0 THEN lang END AS lang_primary
      FROM (SELECT id, lang, {_HITS} AS hits, {_N} AS n FROM {CORPUS_SQL})""",
)
def code_switch(spark, sf_dir):
    """TXT-15, with the languages that the table gives."""
    return corpus(spark, sf_dir).withColumn("c", T.code_switching("text", "lang")).select("id", "c.code_switch", F.col("c.sw_cue_count").cast("long").alias("sw_cue_count"), "c.sw_cue_ratio", "c.lang_primary")


_OWN = "regexp_extract_all(lower(text), '[\\pL\\pN_]+')"
_SPACED = D.words("translate(lower(text), '.,', '  ')")


@query(
    "marker_language",
    f"""SELECT id, CASE WHEN len(list_intersect({_OWN}, [{', '.join(map(D.q, L.SWAHILI_MARKERS))}])) >= 2 THEN 'sw' ELSE 'en' END AS lang,
      len(list_intersect({_SPACED}, [{', '.join(map(D.q, L.NOTICE_WORDS))}]))::BIGINT AS notice_words FROM {CORPUS_SQL}""",
)
def marker_language(spark, sf_dir):
    """TXT-19, 36."""
    return corpus(spark, sf_dir).select("id", T.language_by_markers("text").alias("lang"), T.notice_score_words("text").cast("long").alias("notice_words"))


_GUESS = "list_max([" + ", ".join(f"{{'n': len(list_filter(own, lambda w: w IN ({', '.join(map(D.q, ws))}))), 'o': {-i}, 'code': {D.q(code)}}}" for i, (code, ws) in enumerate(T.FUNCTION_WORDS.items())) + "])"


@query(
    "guessed_language",
    f"""SELECT lang, CASE WHEN words < 5 THEN 'unknown' WHEN best.n > 0 THEN best.code END AS guess, count(*) AS n FROM (SELECT lang, words, {_GUESS} AS best FROM (
      SELECT lang, {D.wc('substr(text, 1, 2000)')} AS words, regexp_extract_all(lower(substr(text, 1, 2000)), '[\\pL]+') AS own FROM documents)) GROUP BY 1, 2""",
)
def guessed_language(spark, sf_dir):
    """TXT-17/18: guesses against the table's languages."""
    return documents(spark, sf_dir).groupBy("lang", T.guess_language("text").alias("guess")).agg(F.count(F.lit(1)).alias("n"))


_LETTERS = r"regexp_extract_all(lower(coalesce({}, '')), '[\pL]+')"
_GROUPS = "unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3)))"


@query(
    "learned_language",
    f"""WITH words AS (SELECT lang AS language, word, count(*) AS n FROM (SELECT lang, unnest({_LETTERS.format('text')}) AS word FROM documents WHERE doc_id % 5 > 0 AND lang IS NOT NULL) GROUP BY 1, 2),
      groups AS MATERIALIZED (SELECT language, g, sum(n) AS n FROM (SELECT language, n, {_GROUPS} AS g FROM words) GROUP BY 1, 2),
      frequent AS (SELECT g FROM groups GROUP BY g ORDER BY sum(n) DESC, g LIMIT 3000), totals AS (SELECT language, sum(n) AS total, count(*) AS kinds FROM groups GROUP BY 1),
      profile AS MATERIALIZED (SELECT f.g, t.language, ln((coalesce(x.n, 0)::DOUBLE + 0.5::DOUBLE) / (total::DOUBLE + 0.5::DOUBLE * kinds)) AS p FROM frequent f CROSS JOIN totals t LEFT JOIN groups x ON x.g = f.g AND x.language = t.language),
      cut AS MATERIALIZED (SELECT doc_id, {_GROUPS} AS g FROM (SELECT doc_id, unnest({_LETTERS.format('substr(text, 1, 2000)')}) AS word FROM documents)),
      sizes AS (SELECT doc_id, len({_LETTERS.format('substr(text, 1, 2000)')}) AS n FROM documents), known AS (SELECT doc_id, count(*) AS groups, count(*) FILTER (WHERE g IN (SELECT g FROM frequent)) AS met FROM cut GROUP BY 1),
      sums AS (SELECT doc_id, language, round(sum(p), 6) AS s FROM cut JOIN profile USING (g) GROUP BY 1, 2), best AS (SELECT doc_id, arg_min(language, {{'s': -s, 'l': language}}) AS language FROM sums GROUP BY 1)
      SELECT doc_id, CASE WHEN n >= 5 AND met >= 0.5::DOUBLE * groups AND groups > 0 THEN best.language ELSE 'unknown' END AS language FROM sizes LEFT JOIN known USING (doc_id) LEFT JOIN best USING (doc_id)""",
)
def learned_language(spark, sf_dir):
    """TXT-17/18, UDF-02: languages by profiles that are learned from four fifths of the documents."""
    from quern.operators.language_profiles import detect_languages, learn_profiles

    docs = documents(spark, sf_dir)
    return detect_languages(docs, learn_profiles(docs.where("doc_id % 5 > 0")), "doc_id").select("doc_id", "language")


_W = D.collapse("text")
_OWNT = f"contains(substr(w, 1, 180), '. ') AND {D.wc('head')} BETWEEN 3 AND 25"


@query(
    "title_parts",
    f"""SELECT id, {D.title_hint('text')} AS hint, CASE WHEN {_OWNT} THEN head ELSE substr(w, 1, 120) END AS title, sha256(CASE WHEN {_OWNT} AND rest <> '' THEN rest ELSE w END) AS body_sha256
      FROM (SELECT id, text, {_W} AS w, split_part({_W}, '. ', 1) AS head, substr({_W}, length(split_part({_W}, '. ', 1)) + 3) AS rest FROM {CORPUS_SQL})""",
)
def title_parts(spark, sf_dir):
    """TXT-24, 25."""
    return corpus(spark, sf_dir).withColumn("p", T.title_and_body("text")).select("id", T.title_hint("text").alias("hint"), "p.title", F.sha2(F.col("p.body").cast("binary"), 256).alias("body_sha256"))


@query("extract_core", f"SELECT id, {D.core('hint', 'text', 350, L.FORCE)} AS core, {D.core('hint', 'text', 60, L.PROSE_RULES.force)} AS short_core FROM (SELECT id, text, {D.title_hint('text')} AS hint FROM {CORPUS_SQL})")
def extract_core(spark, sf_dir):
    """TXT-29: cores of every text under both rule sets."""
    return corpus(spark, sf_dir).select("id", T.extract_core(T.title_hint("text"), F.col("text")).alias("core"), T.extract_core(T.title_hint("text"), F.col("text"), 60, L.PROSE_RULES.force).alias("short_core"))


_PARTS = f"list_filter(string_split(regexp_replace({_W}, '([.!?]) +', '\\1' || chr(30), 'g'), chr(30)), lambda p: {D.wc('p')} >= 5)"


@query(
    "first_sentences",
    f"""SELECT id, {D.strip("substr(CASE WHEN n <= 200 THEN w WHEN len(p) = 0 THEN w WHEN len(p) = 1 OR length(p[1]) >= 120 THEN p[1] ELSE p[1] || ' ' || p[2] END, 1, 600)")} AS seed_text
      FROM (SELECT id, {_W} AS w, {D.wc('text')} AS n, {_PARTS} AS p FROM {CORPUS_SQL})""",
)
def first_sentences(spark, sf_dir):
    """TXT-26."""
    return corpus(spark, sf_dir).select("id", T.first_sentences("text").alias("seed_text"))


@query("whole_sentences", f"SELECT id, unnest(list_filter({D.sentences('text')}, lambda s: {D.wc('s')} <= 1000000)) AS sentence FROM {CORPUS_SQL}")
def whole_sentences(spark, sf_dir):
    """TXT-27 with a bound that cuts no sentence of the corpus; what is cut is in ``sentence_sheet``."""
    return corpus(spark, sf_dir).select("id", F.explode(T.split_sentences("text", most=1_000_000)).alias("sentence"))


@query("normalize_domain", f"SELECT DISTINCT src, CASE lower({D.strip('src')}) WHEN '' THEN 'Governance' " + " ".join(f"WHEN {D.q(k)} THEN {D.q(v)}" for k, v in L.DOMAIN_LABELS.items()) + f" ELSE upper(substr({D.strip('src')}, 1, 1)) || lower(substr({D.strip('src')}, 2)) END AS domain FROM (SELECT source AS src FROM documents UNION ALL SELECT * FROM (VALUES ('health'), ('Security & Safety'), (''), (' general ')) v(src))")
def normalize_domain(spark, sf_dir):
    """TXT-30."""
    extra = spark.createDataFrame([("health",), ("Security & Safety",), ("",), (" general ",)], "src string")
    return documents(spark, sf_dir).select(F.col("source").alias("src")).union(extra).distinct().select("src", T.normalize_domain("src").alias("domain"))


@query("formatted_ids", "SELECT doc_id, printf('psa_%d_%06d', 2026, doc_id) AS psa_id, printf('GOV_%05d', doc_id) AS gov_id, md5('translate English to Kikuyu: ' || text) AS prompt_md5, '[DRY_RUN kik] ' || substr(text, 1, 80) AS target FROM documents")
def formatted_ids(spark, sf_dir):
    """TXT-32 to 34."""
    return documents(spark, sf_dir).select(
        "doc_id", T.numbered("psa_%d_%06d", F.lit(2026), F.col("doc_id")).alias("psa_id"), T.numbered("GOV_%05d", F.col("doc_id")).alias("gov_id"),
        F.md5(T.model_prompt(F.col("text"), F.lit("kik")).cast("binary")).alias("prompt_md5"), T.dry_run_target("text", F.lit("kik")).alias("target"),
    )


# --- Lexicons -------------------------------------------------------------------------------------


def _hits(kws: list[str]) -> str:
    return " + ".join(f"contains(t, {D.q(k)})::INT" for k in kws)


def _any(kws: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, {D.q(k)})" for k in kws) + ")"


_SCORED = "[" + ", ".join(f"{{'n': {_hits(k)}, 'o': {-i}, 'd': {D.q(d)}, 's': {D.q(s)}}}" for i, (d, s, k) in enumerate(L.DOMAINS)) + "]"


@query(
    "infer_domain",
    f"""SELECT id, CASE WHEN keep THEN 'governance' ELSE best.d END AS domain, CASE WHEN NOT keep THEN best.s WHEN coalesce(own.n, 0) > 0 THEN own.s END AS sub_category
      FROM (SELECT id, best, own, best.n = 0 OR (best.d <> 'governance' AND best.n < greatest(2, coalesce(own.n, 0) + 1)) AS keep
        FROM (SELECT id, list_max(sc) AS best, list_max(list_filter(sc, lambda x: x.d = 'governance')) AS own FROM (SELECT id, {_SCORED} AS sc FROM (SELECT id, lower(text) AS t FROM {CORPUS_SQL}))))""",
)
def infer_domain(spark, sf_dir):
    """LEX-01."""
    return corpus(spark, sf_dir).withColumn("d", M.infer_domain("text")).select("id", "d.domain", "d.sub_category")


_KNOWN = list(dict.fromkeys(k for _, _, kws in L.DOMAINS for k in kws))


@query(
    "urgency_audience",
    f"""SELECT id, CASE {' '.join(f'WHEN {_any(k)} THEN {D.q(n)}' for n, k in L.URGENCY)} ELSE 'medium' END AS urgency,
      CASE WHEN len(a) > 0 THEN array_to_string(a, '|') ELSE 'everyone' END AS audience, array_to_string(list_slice(k, 1, 5), '|') AS keywords, {'CASE ' + ' '.join(f'WHEN {_any(k)} THEN {D.q(n)}' for n, k in L.BILINGUAL_DOMAINS) + " ELSE 'Governance' END"} AS bilingual
      FROM (SELECT id, t, list_filter([{', '.join(f'CASE WHEN {_any(k)} THEN {D.q(n)} END' for n, k in L.AUDIENCES)}], lambda x: x IS NOT NULL) AS a,
        list_filter([{', '.join(f'CASE WHEN contains(t, {D.q(k)}) THEN {D.q(k)} END' for k in _KNOWN)}], lambda x: x IS NOT NULL) AS k FROM (SELECT id, lower(text) AS t FROM {CORPUS_SQL}))""",
)
def urgency_audience(spark, sf_dir):
    """LEX-02 to 04, 08."""
    return corpus(spark, sf_dir).select("id", M.infer_urgency("text").alias("urgency"), F.array_join(M.infer_audience("text"), "|").alias("audience"), F.array_join(M.extract_keywords("text"), "|").alias("keywords"), M.bilingual_domain("text").alias("bilingual"))


def _form(f: str) -> str:
    return f"(?i)(^|[^A-Za-z0-9]){M.literal(f)}([^A-Za-z0-9]|$)"


_GLOSS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(D.has("text", _form(f)) for f in [k, *o]) + f" THEN {D.q(k)} END" for k, o in L.GLOSSARY) + "], lambda x: x IS NOT NULL)"
_REWRITE = "text"
for _k, _o in L.GLOSSARY:
    for _f in M._forms(_k, _o):
        if _f != _k:
            for _ in range(2):  # neighbours share the character between them
                _REWRITE = f"regexp_replace({_REWRITE}, {D.q(_form(_f))}, {D.q(chr(92) + '1' + _k + chr(92) + '2')}, 'g')"


@query("glossary_terms", f"SELECT id, array_to_string({_GLOSS}, '|') AS hits, sha256({_REWRITE}) AS rewritten_sha256 FROM {CORPUS_SQL}")
def glossary_terms(spark, sf_dir):
    """LEX-05, 06."""
    return corpus(spark, sf_dir).select("id", F.array_join(M.glossary_hits("text"), "|").alias("hits"), F.sha2(M.glossary_rewrite("text").cast("binary"), 256).alias("rewritten_sha256"))


@query("language_codes", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'swh_Latn' WHEN 'de' THEN 'kik_Latn' END AS code FROM documents WHERE lang IN ('en', 'fr', 'de')")
def language_codes(spark, sf_dir):
    """LEX-09: the model's codes of documents in languages that it knows, two of which stand for others here."""
    lang = F.when(F.col("lang") == "fr", "sw").when(F.col("lang") == "de", "kik").otherwise(F.col("lang"))
    return documents(spark, sf_dir).where(F.col("lang").isin("en", "fr", "de")).select("doc_id", M.model_code(lang).alias("code"))


# --- Rules ----------------------------------------------------------------------------------------

RULE_SETS = {"": L.NOTICE_RULES, "_prose": L.PROSE_RULES}


def _rule_queries(suffix: str, rules) -> None:
    title = D.title_hint("text")

    @query(f"notice_score{suffix}", f"SELECT id, s >= 0.28::DOUBLE AS is_notice, round_even(s, 3) AS score FROM (SELECT id, {D.score('t', 'text', rules)} AS s FROM (SELECT id, text, {title} AS t FROM {CORPUS_SQL}))")
    def notice_score(spark, sf_dir):
        """CLS-01."""
        return corpus(spark, sf_dir).withColumn("s", R.notice_score(T.title_hint("text"), "text", rules)).select("id", "s.is_notice", "s.score")

    @query(
        f"framework_label{suffix}",
        f"SELECT id, label, confidence, reason, a::BIGINT AS action_hits, p::BIGINT AS press_hits, o::BIGINT AS other_hits, n::BIGINT AS token_count, is_strict FROM ({D.framework(f'(SELECT id, text, {title} AS title FROM {CORPUS_SQL})', rules)})",
    )
    def framework_label(spark, sf_dir):
        """CLS-02."""
        long = lambda c: F.col(f"f.{c}").cast("long").alias(c)
        df = corpus(spark, sf_dir).withColumn("f", R.framework_label("text", T.title_hint("text"), rules))
        return df.select("id", "f.label", "f.confidence", "f.reason", *map(long, ("action_hits", "press_hits", "other_hits", "token_count")), "f.is_strict")

    @query(f"gate_reason{suffix}", D.gate(CORPUS_SQL, rules))
    def gate_reason(spark, sf_dir):
        """CLS-03, 04."""
        return corpus(spark, sf_dir).select("id", R.gate_reason("text", F.col("src"), F.col("lang"), rules=rules).alias("reason"))


for _suffix, _rules in RULE_SETS.items():
    _rule_queries(_suffix, _rules)


@query("gate_reason_counts", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, count(*) FILTER (WHERE s >= 0.28::DOUBLE) AS notices FROM ({D.gate(CORPUS_SQL, L.NOTICE_RULES)}) g JOIN (SELECT id, {D.score('t', 'text', L.NOTICE_RULES)} AS s FROM (SELECT id, text, {D.title_hint('text')} AS t FROM {CORPUS_SQL})) USING (id) GROUP BY 1")
def gate_reason_counts(spark, sf_dir):
    """AGG-04 over CLS-01 and CLS-03."""
    df = corpus(spark, sf_dir).select(F.coalesce(R.gate_reason("text", F.col("src"), F.col("lang")), F.lit("kept")).alias("reason"), R.notice_score(T.title_hint("text"), "text")["is_notice"].alias("notice"))
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("notice"), 1)).alias("notices"))


_NOTICE = f"{D.score('t', 'text', L.NOTICE_RULES)} >= 0.28::DOUBLE"
_ERR = "list_filter([CASE WHEN " + D.strip("text") + " = '' THEN 'empty_text' END, CASE WHEN n < 10 THEN 'too_short' END, CASE WHEN NOT ok THEN 'not_classified_as_psa' END, CASE WHEN src = '' THEN 'missing_source_url' END], lambda x: x IS NOT NULL)"
_WARN = "list_filter([CASE WHEN n > 500 THEN 'too_long' END, CASE WHEN id % 100 < 50 THEN 'low_trust_source' END, CASE WHEN id % 7 = 0 THEN 'missing_publish_date' END, CASE WHEN lang NOT IN ('en', 'sw', 'kik', 'ki', 'luo', 'guz', 'som') THEN 'unexpected_language:' || lang END], lambda x: x IS NOT NULL)"


@query(
    "validate_record",
    f"SELECT id, len({_ERR}) = 0 AS valid, array_to_string({_ERR}, '|') AS errors, array_to_string({_WARN}, '|') AS warnings FROM (SELECT *, {_NOTICE} AS ok FROM (SELECT *, {D.wc('text')} AS n, {D.title_hint('text')} AS t FROM {CORPUS_SQL}))",
)
def validate_record(spark, sf_dir):
    """CLS-05, with trust and dates made from the id."""
    df = corpus(spark, sf_dir).withColumn("n", T.word_count("text")).withColumn("ok", R.notice_score(T.title_hint("text"), "text")["is_notice"])
    v = R.validation("text", "n", "ok", "src", F.col("id") % 100, F.when(F.col("id") % 7 != 0, F.lit("2026-01-01")), "lang")
    return df.withColumn("v", v).select("id", "v.valid", F.array_join("v.errors", "|").alias("errors"), F.array_join("v.warnings", "|").alias("warnings"))


@query("review_validation", f"SELECT id, {D.score(D.q(''), 'text', L.NOTICE_RULES)} >= 0.28::DOUBLE AND {_N} >= 12 AS ok FROM {CORPUS_SQL}")
def review_validation(spark, sf_dir):
    """CLS-09."""
    return corpus(spark, sf_dir).select("id", R.review_ok("text").alias("ok"))
