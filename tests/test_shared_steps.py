"""Steps that many queries share, beside plainer forms of them."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quern.functions import lexicon_match as M
from quern.functions import lexicons as L
from quern.functions import rules as R
from quern.functions import text as T


def _texts(n: int = 300) -> list[str | None]:
    rng = random.Random(7)
    bits = ["a", "b2", "don't", "x-y-z", ". ", "! ", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "é", "é", "́", "😀", ",", "-", "'", "İ", "was held", "ministry of", "public", "report to", "alert"]
    return [None, "", " ", *["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(n)], " " * 1200 + "Far title. rest", "x " * 2000 + ". y", "w" * 150 + ". z" + " v" * 900]


def test_white_space_and_titles(spark):
    df = spark.createDataFrame([(t,) for t in _texts()], "t string")
    rows = df.select("t", T.collapse("t").alias("c"), T.words("t").alias("w"), T.word_count("t").alias("n"), T.collapsed_count(T.collapse("t")).alias("m"), T.title_hint("t").alias("h"), T.token_count("t").alias("k"), F.size(T.tokens("t")).alias("all")).collect()
    for r in rows:
        own = [x for x in re.split(f"[{T._WHITE}]+", r["t"] or "") if x]
        whole = " ".join(own)
        hint = whole.split(". ", 1)[0] if ". " in whole[:160] else whole[:100]
        assert (r["c"], r["w"], r["n"], r["m"], r["h"], r["k"]) == (whole, own, len(own), len(own), hint, r["all"]), repr(r["t"])


def test_words_and_rests_of_patterns(spark):
    patterns = [*L.POSITIVE_CUES, *L.NEGATIVE_CUES, L.ORGANISATIONS, L.IMPERATIVES, L.ACTION, L.PRESS, L.OTHER, L.FORCE, L.OFF_TOPIC, L.LISTICLE, L.GENRE, L.REPORT]
    forms = [b for p in patterns for x in R._alternatives(p[3:-3]) for b in R._beginnings(R.re._parser.parse(x))[0]]
    texts = [f"{a}{f}{b}" for i, f in enumerate(forms) for a, b in [("é ", " é"), ("Xé", "́x"), ("(", " 3 days to any tb)")][i % 3 :][:1]] + _texts(100)
    df = spark.createDataFrame([(t or "",) for t in texts], "t string").withColumn("low", F.lower("t"))
    words = R._words_of(F.col("low"), *patterns)
    checks = [F.array(F.col("low").rlike(p), R._low_has(F.col("low"), p, F.col("w"))).alias(f"p{i}") for i, p in enumerate(patterns)]
    rows = df.withColumn("w", words).select("t", *checks).collect()
    assert all(r[i + 1][0] == r[i + 1][1] for r in rows for i in range(len(patterns)))
    assert R._whole_words("citizens? are (advised|reminded)") == ("citizen", "citizens") and R._near("was (held|attended)") == ("was held", "was attended")


def test_keywords(spark):
    df = spark.createDataFrame([("Emergency OUTBREAK of malaria, parents and nurses",), ("",), (None,), ("said",)], "t string")
    out = df.select(M.infer_urgency("t").alias("u"), M.infer_audience("t").alias("a"), M.extract_keywords("t").alias("k"), M.bilingual_domain("t").alias("d"))
    assert [tuple(r) for r in out.collect()] == [
        ("emergency", ["parents", "health_workers"], ["malaria", "tb", "outbreak"], "Health"), ("medium", ["everyone"], [], "Governance"), ("medium", ["everyone"], [], "Governance"), ("medium", ["everyone"], ["id"], "Governance"),
    ]
