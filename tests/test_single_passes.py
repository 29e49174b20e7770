"""Jobs read and judge a text once, and no part or file grows with its table."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans import jobs
from quern.queries import intake as I
from quern.sources import sheets
from tests.test_shared_steps import _texts


def _counting(spark):
    """A function of texts that changes nothing, and the number of its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(t):
        calls.add(1)
        return t

    return F.udf(same, "string"), calls


def test_human_evaluation_reads_texts_once(spark):
    same, calls = _counting(spark)
    rows = [(i, f"p{i % 4}", "a b c d e f g" + " h" * (i % 7), "Health") for i in range(60)]
    sentences = spark.createDataFrame(rows, "ord long, psa_id string, source_text string, Domain string").withColumn("source_text", same("source_text"))
    sheet = spark.createDataFrame([("p0", '{"synthetic": "false"}', 1)], "PSA_ID string, Metadata string, ord long")
    silver = spark.createDataFrame([("p1", "sw", "T", 1)], "psa_id string, target_lang string, target_text string, ord long")
    got = jobs.human_evaluation(sentences, sheet, silver, n=5).collect()
    real = lambda r: r[1] != "p0"
    first = {}
    for r in sorted((r for r in rows if r[0] % 7), key=lambda r: (real(r), -len(r[2]), r[0])):
        first.setdefault(r[1], r)
    left = sorted((r for r in rows if r[0] % 7 and r not in first.values()), key=lambda r: (real(r), -len(r[2]), r[0]))
    assert Counter((r.psa_id, r.source_text) for r in got) == Counter((r[1], r[2]) for r in [*first.values(), left[0]])
    assert {(r.psa_id, r.synthetic_source, r.mt_suggestion_sw) for r in got} == {("p0", "false", ""), ("p1", "", "T"), ("p2", "", ""), ("p3", "", "")}
    assert calls.value <= 60 + 2 * 5  # before: 333


def test_canonical_sheets_clean_texts_once(spark):
    same, calls = _counting(spark)
    texts = ["One two three four. Five six seven eight! " + "x " * i for i in range(20)] + ["too short"] * 20
    df = spark.createDataFrame([(i, t, "moja mbili" if i % 2 else None) for i, t in enumerate(texts)], "ord long, English string, Kiswahili string").withColumn("English", same("English"))
    none = F.lit("")
    rows = sheets.canonical(df, F.col("ord").cast("string"), none, F.col("English"), F.col("Kiswahili"), none, none, {}).collect()
    assert sorted(r.ord for r in rows) == list(range(20))
    assert calls.value == 40  # before: 60


def test_texts_cleaned_and_cut_as_patterns_do(spark):
    white = re.escape(T._WHITE)
    more = ["A b c. D e! f g h? i j k", "! a b c. d e f ! ", "a. b. c d e", "a b.c d. e", "x\t\ty  z\n\n\n\nq\r\r\rw", "caf\xe9\xa0x y “z”", " 　a b\x85c", "AΣ Σ", "İ I"]
    for r in spark.createDataFrame([(t,) for t in _texts() + more], "t string").select("t", T.clean_text("t").alias("c"), T.sentence_parts("t").alias("p"), T.collapsed_hash(T.collapse("t")).alias("h"), T.content_hash("t").alias("own")).collect():
        t = r["t"] or ""
        clean = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t.replace("\r", "\n"))).strip(T._WHITE)
        parts = [p for p in re.split(f"(?<=[.!?])[{white}]+", t.strip(T._WHITE)) if len([w for w in re.split(f"[{white}]+", p) if w]) >= 3]
        assert (r["c"], r["p"], r["h"]) == (clean, max(1, len(parts)), r["own"]), repr(t)


def test_parts_and_files_stay_small(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PART_ROWS", 20)
    monkeypatch.setattr(I, "folder", lambda _, name: str(tmp_path / name))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(I.sheet_order(spark, sf).collect()) == len(docs)
    lines = {r.line: r.en_md5 for r in I.bitext_files(spark, sf).collect()}
    flat = [" ".join(x for x in re.split(f"[{re.escape(T._WHITE)}]+", docs[i] or "") if x) for i in sorted(docs)]
    assert lines == {n: hashlib.md5(t.encode()).hexdigest() for n, t in enumerate(flat, 1) if t}
    I.feed_items(spark, sf).collect()
    for name, count in (("en", lambda s: s.count("\n")), ("sw", lambda s: s.count("\n")), ("feed", lambda s: s.count("<item>"))):
        files = [p for p in Path(tmp_path, name).rglob("part-*") if p.suffix == ".txt"]
        sizes = [count(p.read_text()) for p in files]
        assert sum(sizes) == len(docs) and max(sizes) <= 60, (name, sizes)  # before: half, a third and a fifth of all rows
    assert len(list(Path(tmp_path, "uneven").glob("part-*.csv"))) >= len(docs) // 20
