"""Texts that rows are chosen by are made once; keywords and cores in single passes, beside plain loops."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quern.functions import lexicon_match as M
from quern.functions import lexicons as L
from quern.functions import text as T
from quern.plans import jobs
from quern.queries import boundary
from tests.test_jobs import items, sheet
from tests.test_single_passes import _counting

TEXTS = ["One two three four five six seven.", "É two three four five six seven.", "", " \n "] * 5


def _counted(monkeypatch, spark, name):
    """Counts how often a step of the jobs is worked out."""
    same, calls = _counting(spark)
    own = getattr(jobs, name)
    monkeypatch.setattr(jobs, name, lambda *a, **k: same(own(*a, **k)))
    return calls


def test_items_texts_made_once(spark, monkeypatch):
    """F15, F17, F19."""
    calls = _counted(monkeypatch, spark, "strip_boilerplate")
    assert jobs.ingest(items(spark, *TEXTS), spark.createDataFrame([], "psa_id string, content_hash string, source_url string"))["notices"].count() == 2
    assert calls.value == len(TEXTS)


def test_refiltered_texts_made_once(spark, monkeypatch):
    """F9."""
    calls = _counted(monkeypatch, spark, "primary_text")
    s = sheet(spark, [(t, "{}") for t in TEXTS])
    out = jobs.refilter(s.where("ord < 10"), s.where("ord >= 10"))
    assert out["clean"].count() + out["quarantine"].count() == 2
    assert calls.value == len(TEXTS)


def test_processed_texts_made_once(spark, monkeypatch):
    """no row is chosen by a text that is normalised for it and then again."""
    plans, own = [], jobs.stage_table
    monkeypatch.setattr(jobs, "stage_table", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), own(df, *a))[1])
    assert jobs.process_and_split(sheet(spark, [(t, "{}") for t in TEXTS]), 5)["cleaned"].count() == 10
    assert any("regexp_replace" in p for p in plans)
    assert not any("regexp_replace" in step for p in plans for step in re.findall(r"(?s)\bFilter (.*?)(?=\n[ :]*\+- |\n[ :]*:- |\Z)", p))


def test_keywords_in_one_pass(spark):
    """keywords within words, within and over each other, and beyond ASCII."""
    lists = M.every_keyword()
    known = list(dict.fromkeys(k for ks in lists for k in ks)) + ["é", "", "a&", "a-b"]
    texts = [x + y + z for i, x in enumerate(known) for y, z in ((" ", known[i - 7]), ("s", known[i - 3]), (x[-1:], known[i - 11].upper()))] + ["", None, "vaccinatio drought-resistan"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.keywords_in("t", known).alias("k"))
    for r in rows.collect():
        assert sorted(r.k) == sorted(k for k in known if k in (r.t or "").lower())
    plan = rows.select(M.infer_domain("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(?i)(?<!_)\bcontains\(", plan)  # before: a pass for each keyword


def _core(title, text, most):
    """TXT-29 by a loop."""
    words = lambda t: t.split()
    stop = re.split("(?i)" + L.STOP_MARKERS, text.replace("\r", "\n"), maxsplit=1)[0]
    body = re.sub(r"\n{3,}", "\n\n", stop.strip())
    parts = [p for p in (" ".join(words(p)) for p in re.split(r"\n\s*\n", body)) if p]
    title = " ".join(words(title))
    out = re.sub(r"\.+$", "", title) + "." if title and not (parts[0] if parts else "").lower().startswith(title.lower()[:40]) else ""
    for p in parts:
        if len(words(p)) < 5 or (p.count("Home") >= 2 and "About" in p):
            continue
        joined = f"{out} {p}".strip()
        if len(words(joined)) > most:
            room = most - len(words(out))
            out = f"{out} {' '.join(words(p)[:room])}".strip() if room >= 20 else out
            break
        out = joined
        if len(words(out)) >= 160 or (len(words(out)) >= 80 and re.search("(?i)" + L.FORCE, out)):
            break
    return out or " ".join(words(body)[:most])


def test_cores_by_counts(spark):
    """F9, F16: a core's words are counted as it grows; white space is looked for once in a paragraph."""
    parts = ["word " * 7, "a  b\tc d e f", "\n\n", "\n \n", "\r\n\r", "few words", "Home Home About us and more", "the deadline is near " * 20, "x y z u v " * 40, "\nTags: a", "."]
    rows = [(parts[i % 5] + "." * (i % 3), "".join(parts[(i * k + k // 3) % 11] for k in range(1, 9))) for i in range(150)] + [("", ""), ("a b", "a B c d e f"), ("...", "one two three four five")]
    df = spark.createDataFrame(rows, "title string, t string")
    got = df.select("title", "t", *[T.extract_core("title", F.col("t"), most).alias(f"c{most}") for most in (25, 60, 340)]).collect()
    assert all(r[f"c{most}"] == _core(r.title, r.t, most) for r in got for most in (25, 60, 340))
    plan = df.select(T.extract_core("title", F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 6  # before: 14, most of them passes over all that is held


def test_stored_words_counted_without_a_list(spark, sf):
    """F12."""
    rows = boundary.notices(spark, sf).select("text", "token_count")
    assert "split(" not in rows.select("token_count")._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.token_count == len((r.text or "").split()) for r in rows.collect())
