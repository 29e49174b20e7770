"""Parallel pairs, from turns of ``conversations``: a user's turn beside the assistant's answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import lexicons as L
from quern.functions import pairs as P
from quern.functions import text as T
from quern.functions.lexicon_match import _forms
from quern.operators import lookups as JN
from quern.operators import ranking as K
from quern.operators import sampling as SM
from quern.operators import translation_metrics as TM
from quern.plans import jobs
from quern.queries import duck as D
from quern.queries.texts import _GUESS, _form, documents
from quern.sources.tables import read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Pairs that take the branches that turns of a conversation rarely take.
EXTRA = [
    (1, "IEBC reminds all voters to verify their details at the centre.", "IEBC inawakumbusha wapiga kura wote kuhakiki maelezo yao katika kituo.", "sw"),
    (2, "The ministry asks parents to take children to the nearest clinic today.", "The ministry asks parents to take children to the nearest clinic today.", "en"),
    (3, "Report any case to the health office in your ward now.", "[DRY_RUN sw] Report any case to the health office in your ward now.", "en"),
    (4, "Pay by M-PESA or at the HELB office before the deadline please.", "Lipa katika ofisi iliyo karibu nawe kabla ya siku ya mwisho tafadhali.", "sw"),
    (5, "Stay away from the river banks during the heavy rains of April.", "Restez loin des rives de la rivière pendant les fortes pluies.", "fr"),
    (6, "Too short.", "Fupi sana.", "sw"),
    (7, "", "Hakuna chanzo cha maneno haya.", "sw"),
    (8, "There is a source text of enough words here.", "", "sw"),
]
_EXTRA_SQL = ", ".join(f"({-i}, {D.q(s)}, {D.q(t)}, {D.q(l)})" for i, s, t, l in EXTRA)
TURNS_SQL = f"""(SELECT u.conv_id * 1000 + u.turn AS id, u.text AS s, a.text AS t, 'en' AS lang FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'
  UNION ALL SELECT * FROM (VALUES {_EXTRA_SQL}) v(id, s, t, lang))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, s, t, lang``: source, target and the target's language."""
    c = read_table(spark, sf_dir, "conversations", spread=True)
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("s"))
    a = c.where("role = 'assistant'").select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("before"), F.col("text").alias("t"))
    both = u.join(a, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("before"))).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "s", "t", F.lit("en").alias("lang"))
    return both.unionByName(spark.createDataFrame([(-i, s, t, l) for i, s, t, l in EXTRA], "id long, s string, t string, lang string"))


_CUT = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
_NEAR = f"CASE WHEN len({_CUT('s')}) = 0 OR len({_CUT('t')}) = 0 THEN true ELSE len(list_intersect(list_distinct({_CUT('s')}), {_CUT('t')}))::DOUBLE / len(list_distinct({_CUT('s')})) >= 0.92::DOUBLE AND abs(len({_CUT('s')}) - len({_CUT('t')})) <= 3 END"
_RATIO = f"(greatest({D.wc('t')}, 1)::DOUBLE / greatest({D.wc('s')}, 1))"
_IN = lambda k, o: "(" + " OR ".join(D.has("s", _form(f)) for f in _forms(k, o)) + ")"
_FOUND = " + ".join(f"{_IN(k, o)}::INT" for k, o in L.GLOSSARY)
_KEPT = " + ".join(f"({_IN(k, o)} AND {D.has('t', _form(k))})::INT" for k, o in L.GLOSSARY)
def _check_sql(rows: str) -> str:
    """Checked pairs of ``rows(id, s, t, lang)``."""
    return f"""(SELECT *, 1.0::DOUBLE - 0.15::DOUBLE * len(reasons) + CASE WHEN ratio BETWEEN 0.7::DOUBLE AND 1.4::DOUBLE THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS cf FROM (
  SELECT *, list_filter([CASE WHEN n < 5 THEN 'src_too_short' END, CASE WHEN n > 100 THEN 'src_too_long' END, CASE WHEN m < 3 THEN 'tgt_too_short' END, CASE WHEN t = '' OR dry THEN 'tgt_missing_or_dry_run' END,
    CASE WHEN t <> '' AND NOT ratio BETWEEN 0.45::DOUBLE AND 2.2::DOUBLE THEN 'bad_length_ratio' END, CASE WHEN t <> '' AND near THEN 'near_copy' END, CASE WHEN t <> '' AND gloss < 0.5::DOUBLE THEN 'glossary_dropped' END,
    CASE WHEN t <> '' AND NOT dry AND lang IN ('fr', 'de', 'es', 'pt', 'it') THEN 'unexpected_lang:' || lang END], lambda x: x IS NOT NULL) AS reasons FROM (
    SELECT *, starts_with(t, '[DRY_RUN') AS dry, {D.wc('s')} AS n, {D.wc('t')} AS m, CASE WHEN t <> '' THEN {_RATIO} ELSE 0::DOUBLE END AS ratio, {_NEAR} AS near,
      CASE WHEN t = '' THEN 0::DOUBLE WHEN {_FOUND} = 0 THEN 1::DOUBLE ELSE ({_KEPT})::DOUBLE / ({_FOUND}) END AS gloss FROM (SELECT id, {D.collapse('s')} AS s, {D.collapse('t')} AS t, lang FROM {rows}))))"""


_CHECK = _check_sql(TURNS_SQL)


def _checked(spark, sf_dir) -> DataFrame:
    return turns(spark, sf_dir).withColumn("q", P.pair_check("s", "t", "lang", F.lit(True)))


@query(
    "pair_qc",
    f"SELECT id, len(reasons) = 0 AS ok, array_to_string(reasons, '|') AS reasons, round_even(ratio, 3) AS length_ratio, round_even(gloss, 3) AS glossary_preservation, CASE WHEN t <> '' AND NOT dry THEN lang ELSE '' END AS language, round_even(greatest(0::DOUBLE, least(1::DOUBLE, cf)), 3) AS confidence FROM {_CHECK}",
)
def pair_qc(spark, sf_dir):
    """CLS-06 to 08, LEX-07."""
    return _checked(spark, sf_dir).select("id", "q.ok", F.array_join("q.reasons", "|").alias("reasons"), "q.length_ratio", "q.glossary_preservation", "q.language", "q.confidence")


@query("pair_stats", f"SELECT r AS reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['kept'] ELSE reasons END) AS r FROM {_CHECK}) GROUP BY 1")
def pair_stats(spark, sf_dir):
    """AGG-14, FLT-04."""
    rows = _checked(spark, sf_dir).select(F.explode(F.when(F.col("q.ok"), F.array(F.lit("kept"))).otherwise(F.col("q.reasons"))).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pair_splits",
    f"""SELECT id, lang, CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + dv THEN 'dev' ELSE 'test' END AS split FROM (
      SELECT *, tr0 - (n >= 10 AND n - tr0 - dv0 = 0 AND tr0 > 0)::INT - (n >= 10 AND dv0 = 0 AND tr0 > 0)::INT AS tr, dv0 + (n >= 10 AND dv0 = 0 AND tr0 > 0)::INT AS dv FROM (
        SELECT id, lang, rk, n, floor(n * 0.8::DOUBLE)::BIGINT AS tr0, floor(n * 0.1::DOUBLE)::BIGINT AS dv0 FROM (
          SELECT id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || id::VARCHAR), id) AS rk FROM {TURNS_SQL})))""",
)
def pair_splits(spark, sf_dir):
    """SMP-04."""
    return SM.pair_split(turns(spark, sf_dir).select("id", "lang"), "id", "lang").select("id", "lang", "split")


def _gram_sql(n: int, units: str, sep: str) -> str:
    return f"list_transform(range(1, greatest(len({units}) - {n - 1}, 0) + 1), lambda i: array_to_string(list_slice({units}, i, i + {n - 1}), {D.q(sep)}))"


def _match_sql(n: int, sep: str) -> str:
    """Clipped matches and totals of one order, summed over the corpus."""
    g = lambda u: f"SELECT id, unnest({_gram_sql(n, u, sep)}) AS g FROM rows"
    return f"""(SELECT coalesce(sum(least(h.c, r.c)), 0) FROM (SELECT id, g, count(*) AS c FROM ({g('h')}) GROUP BY 1, 2) h JOIN (SELECT id, g, count(*) AS c FROM ({g('r')}) GROUP BY 1, 2) r USING (id, g))"""


_TOK = lambda x: D.words(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || replace({x}, chr(10), ' ') || ' ', '([\\{{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])', ' \\1 ', 'g'), '([^0-9])([\\.,])', '\\1 \\2 ', 'g'), '([\\.,])([^0-9])', ' \\1 \\2', 'g'), '([0-9])(-)', '\\1 \\2 ', 'g')".format(x=x)
)
_BLEU_M = ", ".join(f"{_match_sql(n, ' ')} AS m{n}, (SELECT sum(greatest(len(h) - {n - 1}, 0)) FROM rows) AS t{n}" for n in range(1, 5))
_BLEU_LOG = " + ".join(f"ln(100.0::DOUBLE * m{n} / t{n})" for n in range(1, 5))


@query(
    "corpus_bleu",
    f"""WITH rows AS (SELECT id, {_TOK('t')} AS h, {_TOK("s || ' ' || t")} AS r FROM {TURNS_SQL}), x AS (SELECT {_BLEU_M}, (SELECT sum(len(h)) FROM rows) AS hl, (SELECT sum(len(r)) FROM rows) AS rl, (SELECT count(*) FROM rows) AS n)
      SELECT CASE WHEN hl >= rl THEN 1.0::DOUBLE ELSE exp(1 - rl::DOUBLE / hl) END * exp(({_BLEU_LOG}) / 4) AS bleu, n FROM x""",
)
def corpus_bleu(spark, sf_dir):
    """AGG-15: answers against question and answer as a reference."""
    return TM.corpus_bleu(turns(spark, sf_dir).withColumn("r", F.concat_ws(" ", "s", "t")), "t", "r")


_CHARS = lambda x: f"list_filter(string_split(replace({D.collapse(x)}, ' ', ''), ''), lambda c: c <> '')"
_CHRF_M = ", ".join(f"{_match_sql(n, '')}::DOUBLE AS m{n}, (SELECT sum(greatest(len(h) - {n - 1}, 0)) FROM rows) AS h{n}, (SELECT sum(greatest(len(r) - {n - 1}, 0)) FROM rows) AS r{n}" for n in range(1, 7))


@query(
    "corpus_chrf",
    f"""WITH rows AS (SELECT id, {_CHARS('t')} AS h, {_CHARS("s || ' ' || t")} AS r FROM {TURNS_SQL} WHERE id < 40000), x AS (SELECT {_CHRF_M}, (SELECT count(*) FROM rows) AS n)
      SELECT 100.0::DOUBLE * 5 * p * r / (4 * p + r) AS chrf, n FROM (SELECT ({' + '.join(f'm{n} / h{n}' for n in range(1, 7))}) / 6 AS p, ({' + '.join(f'm{n} / r{n}' for n in range(1, 7))}) / 6 AS r, n FROM x)""".replace(" WHERE id < 40000", ""),
)
def corpus_chrf(spark, sf_dir):
    """AGG-15."""
    return TM.corpus_chrf(turns(spark, sf_dir).withColumn("r", F.concat_ws(" ", "s", "t")), "t", "r")


@query("sentence_sheet")
def sentence_sheet(spark, sf_dir):
    """JOB-12, TXT-27, WIN-04: numbered sentences of every document, long ones cut after commas."""
    docs = documents(spark, sf_dir)
    return jobs.sentence_sheet(docs.select(F.format_string("psa_%06d", "doc_id").alias("psa_id"), F.lit("Health").alias("Domain"), F.col("source").alias("Source"), F.col("text").alias("seed_text")))


@query(
    "cross_targets_dry_run",
    """SELECT printf('seed_%06d', row_number() OVER (ORDER BY doc_id, k)) AS pair_id, doc_id, lang AS target_lang, '[DRY_RUN ' || lang || '] ' || substr(text, 1, 80) AS target_text
      FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 1000) CROSS JOIN (VALUES (1, 'sw'), (2, 'kik')) v(k, lang)""",
)
def cross_targets_dry_run(spark, sf_dir):
    """JOB-13, JON-12."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("psa_id"), F.lit("").alias("Domain"), F.lit("").alias("Source"), F.col("text").alias("source_text"), F.col("doc_id").alias("ord"))
    return jobs.dry_run_seeds(docs).select("pair_id", F.col("psa_id").alias("doc_id"), "target_lang", "target_text")


_EVAL = f"(SELECT doc_id, source, {D.wc('text')} AS n, coalesce(toxic = 1, true)::INT AS r FROM documents LEFT JOIN labels USING (doc_id) WHERE {D.wc('text')} >= 8)"


@query("human_eval_pick", f"SELECT doc_id, source FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY r, -n, doc_id) > 1)::INT AS later FROM {_EVAL}) ORDER BY later, r, -n, doc_id LIMIT 100")
def human_eval_pick(spark, sf_dir):
    """WIN-05, JON-07, FLT-10: one row of each source before any second one; unknown rows count as synthetic."""
    rows = documents(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").where(T.word_count("text") >= 8)
    rows = rows.withColumn("r", F.coalesce(F.col("toxic") == 1, F.lit(True)).cast("int")).withColumn("l", -T.word_count("text"))
    return K.one_then_fill(rows, 100, "source", "r", "l", "doc_id").select("doc_id", "source")


@query("last_translation", "SELECT role, turn, max_by(conv_id, conv_id) AS conv_id FROM conversations GROUP BY 1, 2")
def last_translation(spark, sf_dir):
    """JON-08: the last row of each key."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("o", F.col("conv_id"))
    return JN.last_value(c, ["role", "turn"], "conv_id", "o")


_HARVEST = f"(SELECT doc_id + 1 AS line, {D.wc('text')} >= 30 AS ok, (doc_id % 3 = 0)::INT AS score FROM documents)"


@query(
    "harvest_prefix_filter",
    f"""SELECT line, score FROM (SELECT *, count(*) OVER (ORDER BY line) AS kept FROM (SELECT *, count(*) OVER (ORDER BY line) AS passed FROM {_HARVEST} WHERE ok AND line <= 50000) WHERE passed <= 1501 OR score > 0 OR line >= 50000) WHERE kept <= 6000 ORDER BY score DESC, line LIMIT 3000""",
)
def harvest_prefix_filter(spark, sf_dir):
    """JOB-16, WIN-06, ORD-01 with the feature's own limit and scan."""
    rows = documents(spark, sf_dir).select((F.col("doc_id") + 1).alias("line"), (T.word_count("text") >= 30).alias("ok"), (F.col("doc_id") % 3 == 0).cast("int").alias("score"))
    return K.prefix_then_filter(rows, "ok", "score", 3000, 50_000, "line").orderBy(F.desc("score"), "line").limit(3000).select("line", "score")


@query("positional_bitext", "SELECT d.n AS line, d.doc_id, b.item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) d JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark) b USING (n)")
def positional_bitext(spark, sf_dir):
    """SRC-15, JON-10."""
    d = documents(spark, sf_dir).select("doc_id")
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id")
    return JN.positional(d, b, "doc_id", "item_id").select("line", "doc_id", "item_id")




@query("bitext_lines", f"SELECT doc_id, line, sha256(a) AS en_sha256 FROM (SELECT doc_id, i AS line, {D.strip('string_split(text, chr(10))[i]')} AS a, {D.strip('string_split(lower(text), chr(10))[i]')} AS b FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE a <> '' AND b <> ''")
def bitext_lines(spark, sf_dir):
    """SRC-15: lines of two columns side by side."""
    from quern.sources.sheets import bitext_lines as lines

    docs = documents(spark, sf_dir).select("doc_id", "text", F.lower("text").alias("low"))
    return lines(docs, "text", "low", "doc_id").select("doc_id", F.col("line").cast("long").alias("line"), F.sha2(F.col("en").cast("binary"), 256).alias("en_sha256"))


@query("evaluation_rows", "SELECT id FROM (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user' AND NOT starts_with(text, '[DRY_RUN')) ORDER BY id LIMIT 50")
def evaluation_rows(spark, sf_dir):
    """FLT-05."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("en").alias("source_lang"), F.lit("sw").alias("target_lang"), F.lit(None).cast("string").alias("auto_qc_pass"), F.col("text").alias("target_text"))
    return jobs.evaluation_rows(c.withColumn("ord", F.col("id")), "en", "sw", 50).select("id")


@query("valid_requests", f"SELECT doc_id, length(text) BETWEEN 1 AND 2000 AND {D.strip('text')} <> '' AND doc_id % 300 BETWEEN 16 AND 256 AS ok FROM documents")
def valid_requests(spark, sf_dir):
    """JOB-19."""
    return documents(spark, sf_dir).select("doc_id", jobs.valid_request("text", F.col("doc_id") % 300).alias("ok"))


_GUESSED = f"""(SELECT id, s, t, CASE WHEN id % 2 = 0 THEN CASE WHEN words < 1 THEN 'unknown' WHEN best.n > 0 THEN best.code ELSE '' END ELSE '' END AS lang FROM (SELECT *, {_GUESS} AS best FROM (
  SELECT id, s, t, {D.wc('substr(t, 1, 2000)')} AS words, regexp_extract_all(lower(substr(t, 1, 2000)), '[\\pL]+') AS own FROM {TURNS_SQL} WHERE {D.strip('s')} <> '' AND {D.strip('t')} <> '')))"""


@query(
    "prepared_pairs",
    f"""SELECT target_lang, CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + dv THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM (
      SELECT *, tr0 - (c >= 10 AND c - tr0 - dv0 = 0 AND tr0 > 0)::INT - (c >= 10 AND dv0 = 0 AND tr0 > 0)::INT AS tr, dv0 + (c >= 10 AND dv0 = 0 AND tr0 > 0)::INT AS dv FROM (
        SELECT *, floor(c * 0.8::DOUBLE)::BIGINT AS tr0, floor(c * 0.1::DOUBLE)::BIGINT AS dv0 FROM (
          SELECT target_lang, count(*) OVER (PARTITION BY target_lang) AS c, row_number() OVER (PARTITION BY target_lang ORDER BY md5('42|' || pair_id), pair_id) AS rk FROM (
            SELECT printf('mt_%06d', id) AS pair_id, CASE WHEN id % 2 = 0 THEN 'sw' ELSE 'kik' END AS target_lang FROM {_check_sql(_GUESSED)} WHERE len(reasons) = 0)))) GROUP BY 1, 2""",
)
def prepared_pairs(spark, sf_dir):
    """JOB-12: pair sheets through checks and splits, counted."""
    t = turns(spark, sf_dir)
    rows = t.select(
        F.lit("").alias("pair_id"), F.format_string("psa_%d", "id").alias("psa_id"), F.lit("").alias("Domain"), F.lit("en").alias("source_lang"), F.when(F.col("id") % 2 == 0, "sw").otherwise("kik").alias("target_lang"),
        F.col("s").alias("source_text"), F.col("t").alias("target_text"), F.lit("nllb").alias("method"), F.lit("").alias("confidence"), F.lit("false").alias("verified"), F.lit("").alias("Source"), F.lit("{}").alias("Metadata"), F.col("id").alias("ord"),
    )
    return jobs.prepare_pairs(rows)["pairs"].groupBy("target_lang", "split").agg(F.count(F.lit(1)).alias("n"))
