"""Functions on small texts: documented cases, and quirks that must stay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import html as H
from quern.functions import lexicon_match as M
from quern.functions import lexicons as L
from quern.functions import pairs as P
from quern.functions import rules as R
from quern.functions import text as T
from quern.functions.python_hooks import nfkc, translate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def score(spark, title, text):
    return one(spark, R.notice_score(lit(title), lit(text)))


def gate(spark, text, **more):
    return one(spark, R.gate_reason(lit(text), **more))


@pytest.mark.parametrize("title, text", [
    ("Ministry of Health advisory", "Residents must avoid stagnant water and report any cholera case to the nearest clinic immediately."),
    ("PUBLIC NOTICE", "The commission reminds voters that campaign material is prohibited near polling stations on election day."),
    ("EACC urges citizens to report corruption", "The public is advised to report corruption and demand accountability from every public office today."),
])
def test_notices_score(spark, title, text):
    s = score(spark, title, text)
    assert s["is_notice"] and s["score"] >= 0.28


def test_match_report_is_no_notice(spark):
    assert not score(spark, "Derby ends level", "The match report says both sides drew in a premier league game that had two late goals.")["is_notice"]


def test_threshold_before_rounding(spark):
    # Four cues and fewer than twelve words: 4 * 0.12 - 0.2 is just below 0.28 as a double.
    s = score(spark, "", "advised verify flood farmer")
    assert not s["is_notice"] and s["score"] == 0.28


def test_stems_do_not_match(spark):
    assert score(spark, "", "they vaccinated " + "word " * 20)["score"] == score(spark, "", "they jumped " + "word " * 20)["score"]
    assert one(spark, R.framework_label(lit("please vaccinate your children at the clinic near you"), lit("")))["action_hits"] == 0
    assert score(spark, "", "by 5 " + "word " * 20)["score"] > score(spark, "", "by 15 " + "word " * 20)["score"]


def test_framework_labels(spark):
    label = lambda t: one(spark, R.framework_label(lit(t), lit("")))
    r = label("This is a reminder. The public is advised to verify their details before the deadline.")
    assert r["label"] == "psa" and r["is_strict"]
    assert label("The minister launched the centre on an official visit, signed an MOU and made a statement in a speech.")["label"] == "press_release"
    assert label("Gazette notice pursuant to section 4: invitation to tender for the supply of chairs.")["label"] == "other_gov_comm"
    assert label("Nothing of the kind is said in these few words.")["label"] == "not_psa"
    assert label("must act now")["reason"] == "too_short_for_psa"
    weak = label("must " + "word " * 280)
    assert weak["label"] == "psa" and weak["confidence"] == 0.51 and not weak["is_strict"]
    assert label("must " + "word " * 400)["reason"] == "too_long_for_framework_psa"


PLAIN = "word " * 30


@pytest.mark.parametrize("text, more, reason", [
    (None, {}, "empty_text"), ("  ", {}, "empty_text"), (PLAIN, {"contributor": "Some One", "raw_contributor": "some"}, "some_raw_scrape"), (PLAIN, {"origin_file": "psa_dataset.csv"}, "unreviewed_raw_scrape"),
    ("quick links " + PLAIN, {}, "nav_boilerplate"), ("SNo Notice Description " + PLAIN, {}, "listing_page_dump"), ("Home Home Home About " + PLAIN, {}, "menu_like"), ("get involved " + PLAIN, {}, "ngo_website_stub"),
    (PLAIN, {"source": "https://x/about-us/y"}, "ngo_about_page"), ("football " + PLAIN, {}, "off_topic_news"), ("full list " + PLAIN, {}, "listicle_not_psa"), ("public notice to the people of this small town", {}, None),
    ("a few words only", {}, "too_short"), ("word " * 351, {}, "too_long_for_psa"), (PLAIN, {"lang": "fr"}, "non_target_language:fr"), ("word " * 20, {"source": "https://wvi.org/x"}, "short_ngo_non_psa"),
    ("alert: situation report " + PLAIN, {}, "report_not_psa"), ("strengthen collaboration " + PLAIN, {}, "genre_news_not_psa"), (PLAIN, {}, "low_psa_score:0.15"),
    ("curfew " + "word " * 300, {}, "weak_forced_narrative:0.00"), ("The commission reminds voters to register and avoid the polling crowd before the deadline. " + PLAIN, {}, None),
])
def test_gate(spark, text, more, reason):
    assert gate(spark, text, **more) == reason


def test_validation(spark):
    v = one(spark, R.validation(lit(""), F.lit(3), F.lit(None).cast("boolean"), lit(None), F.lit(10), lit(None), lit("xx")))
    assert v["errors"] == ["empty_text", "too_short", "not_classified_as_psa", "missing_source_url"]
    assert v["warnings"] == ["low_trust_source", "missing_publish_date", "unexpected_language:xx"]
    assert one(spark, R.validation(lit("x"), F.lit(501), F.lit(True), lit("u"), F.lit(80), lit("d"), lit("en")))["warnings"] == ["too_long"]


def test_values(spark):
    cases = [
    (T.alnum_boundaries(F.lit("NOTICE15th of May, 3rd and 20kg")), "NOTICE 15th of May, 3rd and 20 kg"), (T.collapse_punctuation(F.lit("Stop!!!! Now??? ok..")), "Stop!! Now?? ok.."),
    (T.collapse(F.lit("  a \t b ")), "a b"), (T.word_count(F.lit("  \n")), 0), (T.word_count(F.lit(None).cast("string")), 0), (T.tokens(F.lit("don't e-mail: 5%")), ["don't", "e-mail", ":", "5", "%"]),
    (T.sentence_marks(F.lit("Hi")), 1), (T.sentence_marks(F.lit("")), 0), (T.sentence_parts(F.lit("")), 1), (T.join_title(F.lit("A"), F.lit("B.")), "A. B"), (T.join_title(F.lit(""), F.lit("B.")), "B."),
    (T.normalize_domain(F.lit(" Security & Safety ")), "Security"), (T.normalize_domain(F.lit(None).cast("string")), "Governance"), (T.export_domain(F.lit("security_&_safety")), "Security"),
    (T.language_by_markers(F.lit("Serikali na watu wa Kenya")), "sw"), (T.language_by_markers(F.lit("na na na")), "en"), (T.strip_boilerplate(F.lit("Home\r\n text \nHomes for all\nShare this\n\nend")), "text\nend"),
    (T.title_hint(F.lit("Title here. And more")), "Title here"), (T.title_hint(F.lit("x" * 170 + ". y")), "x" * 100), (T.model_prompt(F.lit("Hi"), F.lit("kik")), "translate English to Kikuyu: Hi"),
    (T.notice_score_words(F.lit("Please report. please, WATER")), 3), (T.guess_language(F.lit("a b")), "unknown"), (T.guess_language(F.lit("der Mann und die Frau sind mit dem Kind")), "de"), (nfkc(F.lit("ﬁne ①")), "fine 1"),
    (M.glossary_rewrite(F.lit("Pay by Mpesa or m-pesa, KES 5 and boda boda")), "Pay by M-PESA or M-PESA, KSh 5 and bodaboda"), (M.glossary_hits(F.lit("iebc and washing; wash")), ["IEBC", "WASH"]),
    (M.infer_urgency(F.lit("a reminder")), "medium"), (M.infer_urgency(F.lit("nothing")), "medium"), (M.infer_audience(F.lit("nothing")), ["everyone"]), (M.bilingual_domain(F.lit("shule mpya")), "Education"),
    (P.near_copy(F.lit("The same words."), F.lit("the same words")), True), (P.near_copy(F.lit("é"), F.lit("x")), True), (P.near_copy(F.lit("one two three"), F.lit("four five six")), False),
    ]
    found = spark.range(1).select(*[c.alias(str(k)) for k, (c, _) in enumerate(cases)]).first()
    for k, (_, expected) in enumerate(cases):
        assert found[k] == expected, k


def test_domain_needs_two_hits_against_the_default(spark):
    d = lambda t: tuple(one(spark, M.infer_domain(F.lit(t))))
    assert d("malaria") == ("governance", None)
    assert d("malaria and cholera") == ("health", "disease_prevention_and_control")
    assert d("malaria cholera iebc voter") == ("governance", "elections_and_voter_education")
    assert d("malaria cholera crop harvest") == ("health", "disease_prevention_and_control")


def test_code_switching(spark):
    c = one(spark, T.code_switching(F.lit("tafadhali epuka this and that thing over there near here"), F.lit("en")))
    assert c["code_switch"] and c["sw_cue_count"] == 2
    assert one(spark, T.code_switching(F.lit(""), F.lit("en")))["lang_primary"] is None


def test_sentences(spark):
    s = one(spark, T.split_sentences(F.lit("One two three four five. Six seven eight nine ten! Eleven twelve thirteen fourteen?"), 4, 40))
    assert s == ["One two three four five.", "Six seven eight nine ten!", "Eleven twelve thirteen fourteen?"]
    long = ", ".join(" ".join(f"w{i}{j}" for j in range(9)) for i in range(9))
    parts = one(spark, T.split_sentences(F.lit(long)))
    assert [len(p.split()) for p in parts] == [45, 36] and all(p.count("w") == len(p.split()) for p in parts)
    assert one(spark, T.split_sentences(F.lit("word " * 81))) == []
    assert one(spark, T.split_sentences(F.lit("#tag one two three four five six."))) == []


def test_core(spark):
    core = lambda title, text, most=350: one(spark, T.extract_core(lit(title), lit(text), most))
    assert core("Title", "First paragraph has many words.\n\nfew words\n\nRelated articles\n\nNot this one at all please.") == "Title. First paragraph has many words."
    assert core("First para", "First paragraph has many words.") == "First paragraph has many words."
    assert len(core("", "a " * 30 + "\n\n" + "b " * 60, 60).split()) == 60
    assert len(core("", "a " * 50 + "\n\n" + "b " * 60, 60).split()) == 50
    assert core("", "Home Home About us here now\n\nreal words are in this one") == "real words are in this one"
    assert core(None, None) == ""


def test_first_sentences(spark):
    assert one(spark, T.first_sentences(F.lit("Short text."))) == "Short text."
    long = "This sentence has just eight words in it. " * 40
    assert one(spark, T.first_sentences(F.lit(long))) == ("This sentence has just eight words in it. " * 2).strip()


def test_pair_check(spark):
    check = lambda s, t, lang=None: one(spark, P.pair_check(lit(s), lit(t), lit(lang), F.lit(True)))
    assert check("IEBC reminds all voters to check details.", "IEBC inawakumbusha wapiga kura wote kuhakiki.", "sw")["ok"]
    assert "tgt_missing_or_dry_run" in check("a b c d e f", "[DRY_RUN sw] a b c")["reasons"]
    assert check("", None)["reasons"] == ["src_too_short", "tgt_too_short", "tgt_missing_or_dry_run"]
    assert "unexpected_lang:fr" in check("one two three four five six", "un deux trois quatre cinq six", "fr")["reasons"]
    assert "glossary_dropped" in check("Visit the HELB office near the old market today", "Tembelea ofisi iliyo karibu na soko la zamani leo", "sw")["reasons"]


def test_html(spark):
    page = '<html><head><script>var t="</p>";</script></head><body><nav><a href="/a-long-slug#x">n</a></nav><h1>The  title</h1><article><p>One &amp; two</p><a href="news-item">x</a></article></body></html>'
    assert one(spark, H.html_to_text(F.lit(page))).split("\n")[-2:] == ["One & two", "x"]
    assert one(spark, H.select_first(F.lit(page), ".none, h1")) == "The  title"
    assert one(spark, H.select_body(F.lit(page), "article, body", 2)) == "One & two\nx"
    assert one(spark, H.article_links(F.lit(page), F.lit("https://h.org/p/q?z=1"))) == ["https://h.org/p/news-item"]
    assert one(spark, H.article_links(F.lit(page), F.lit("https://h.org/p"), needle="long", article="section")) == ["https://h.org/a-long-slug"]
    assert one(spark, H.title_or_default(F.lit(None).cast("string"))) == "Untitled"


def test_unknown_language_fails_before_a_model_loads(spark):
    def load():
        raise AssertionError("loaded")

    df = spark.createDataFrame([("x", "zz")], "s string, lang string")
    with pytest.raises(Exception, match="unsupported language"):
        translate(df, "s", "lang", "out", load).collect()
    with pytest.raises(Exception, match="unsupported language"):
        one(spark, M.model_code(F.lit("zz")))
    done = translate(df.withColumn("lang", F.lit("sw")), "s", "lang", "out", lambda: lambda texts, lang: [f"{lang}:{t}" for t in texts])
    assert done.first()["out"] == "sw:x"


def test_lexicons_are_parameters(spark):
    assert one(spark, M.infer_urgency(F.lit("zzz"), [("high", ["zzz"]), ("low", ["y"])])) == "high"
    assert len(L.DOMAINS) == 25 and len(L.GLOSSARY) == 24 and len(L.POSITIVE_CUES) == 17
