"""Classifiers, personal data, encoding and media."""

from __future__ import annotations

import time
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import pii_information as I
from quern.llm import quality_gam as Q
from quern.llm import telephony_audio as A
from quern.llm import toxicity_ngrams as X
from quern.llm import bpe_index as B
from quern.llm.bpe_index import PairIndexBpe, encode
from quern.llm.labelled import fit_rows
from tests.llm import brute, odd

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("score", [Q.score_quality, X.score_toxicity])
def test_classifiers_on_odd_tables(spark, score):
    docs, labels = odd.documents(spark), odd.labels(spark)
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    again = {(r["doc_id"], r["score"]) for r in score(docs, labels).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in rows}
    none = score(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert score(odd.no_documents(spark), labels).collect() == []


def test_quality_learns_shapes(spark):
    good, bad = odd.texts(seed=3, n=300)[:300], [" ".join(["same"] * 40) if i % 2 else " ".join(w.upper() + "!!" for w in t.split()) for i, t in enumerate(odd.texts(seed=4, n=150)[:150])]
    rows = [(i, t, int(i < 300)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in Q.score_quality(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.98


def test_pair_tables_hold_interactions():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (4000, 3)).astype(float)
    y = (x[:, 0] != x[:, 1]).astype(float)
    model = Q.PairwiseAdditiveModel(3).fit(x, y)
    assert (1, 0) in model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.99


def test_toxicity_learns_words(spark):
    clean = odd.texts(seed=5, n=400)[:400]
    rows = [(i, t if i % 4 else t + [" vile", " nastyab", " nastycd"][i % 3], int(i % 4 == 0)) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.score_toxicity(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.98


def test_quality_scores_table_by_table(spark):
    """The fitted tables' sums, recomputed one row and one bin at a time, are the scores."""
    docs, labels = odd.documents(spark), odd.labels(spark)
    model = Q.fit_quality(docs, labels)
    assert model.pairs and any(len(t) > 1 for t in model.tables)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id > 4").collect()}  # ids below have more than one text
    got = {r["doc_id"]: r["score"] for r in Q.score_quality(docs, labels).collect()}
    for i, t in texts.items():
        data = np.frombuffer((t or "").encode(), np.uint8)
        figures = Q.text_features(data, np.array([0, len(data)]))[0]
        assert got[i] == pytest.approx(brute.additive_score(model, figures), abs=1e-9)


def test_quality_figures():
    """Figures of a text by plain Python."""
    text = "Good day, GOOD day. a# a# a# a#\n\nline two\nline two 42"
    data = np.frombuffer(text.encode(), np.uint8)
    x = dict(zip(Q.FEATURES, Q.text_features(data, np.array([0, len(data)]))[0], strict=True))
    words, lines = text.split(), [line for line in text.split("\n") if line]
    n = len(words)
    expected = {
        "bytes": np.log1p(len(text)), "words": np.log1p(n), "word_bytes": np.mean([len(w) for w in words]), "upper": sum(c.isupper() for c in text) / len(text), "digits": 2 / len(text), "stops": 2 / n, "symbols": 4 / len(text),
        "word_symbols": 4 / n, "repeats": 3 / (n - 1), "longest_run": 4 / n, "distinct": len({*words}) / n, "top_word": 4 / n, "distinct_runs": len({*zip(words, words[1:], words[2:])}) / (n - 2), "lines": np.log1p(3),
        "repeated_lines": 0.0, "word_spread": np.std([len(w) for w in words]),
    }
    assert len(lines) == 3 and x == pytest.approx(expected)


def plain_code(gram):
    """The hash of an n-gram in whole numbers."""
    word = (1 << 64) - 1
    x = (len(gram) + sum((b + 1) * int(p) for b, p in zip(gram, X._PLACES, strict=False))) & word
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & word
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & word
    return (x ^ (x >> 31)) >> (64 - X.BITS)


def test_toxicity_scores_gram_by_gram(spark):
    """Log-count ratios and scores recomputed from sets of n-grams."""
    docs, labels = odd.documents(spark), odd.labels(spark)
    model = X.fit_toxicity(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id > 4").collect()}
    codes = {i: {plain_code(g) for g in brute.ngrams(t)} for i, t in texts.items()}
    weight = {int(c): float(r * w) for c, r, w in zip(model.codes, model.ratios, model.weights, strict=True)}
    got = {r["doc_id"]: r["score"] for r in X.score_toxicity(docs, labels).collect()}
    for i, found in codes.items():
        z = model.bias + sum(weight.get(c, 0.0) for c in found)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    # Ratios of a table whose ids are unique, by counting documents.
    rows = [(i, t, i % 2) for i, t in enumerate(odd.texts(n=60)[:80])]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = X.fit_toxicity(docs, labels)
    kept = [(plain, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 for plain in [{plain_code(g) for g in brute.ngrams(t)}]]
    n = [sum(y == v for _, y in kept) for v in (0, 1)]
    for code, ratio in zip(model.codes.tolist(), model.ratios.tolist(), strict=True):
        neg, pos = (sum(code in found for found, y in kept if y == v) for v in (0, 1))
        assert ratio == pytest.approx(np.log((pos + 0.5) / (n[1] + 1)) - np.log((neg + 0.5) / (n[0] + 1)))


def test_fit_rows_are_bounded(spark):
    """One id in many rows counts once, whatever its texts."""
    docs = spark.createDataFrame([(3, f"text {i % 7}") for i in range(500)] + [(6, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (6, 0)], "doc_id long, quality int")
    assert len(fit_rows(docs, labels, "quality", 3, 9, most=1).collect()) == 1
    assert sorted(r["y"] for r in fit_rows(docs, labels, "quality", 3, 9, most=9).collect()) == [0, 1]


def test_ngrams_stay_within_their_text():
    data = np.frombuffer("one two".encode() + "three".encode(), np.uint8)
    many = sorted(zip(*map(np.concatenate, zip(*X.ngram_codes(data, np.array([0, 7, 7, 12])), strict=True)), strict=True))
    alone = [(r, c) for k, t in enumerate(("one two", "", "three")) for rows, codes in X.ngram_codes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for r, c in zip(rows + k, codes, strict=True)]
    assert many == sorted(alone)


# --- Personal data --------------------------------------------------------------------------------

TRICKY = [
    "a@b.c_x@d.e", "x@y", "a@b.c.", "a@@b.c", "me+you%x@sub-1.example.co.uk,", "é@b.c", "1.2.3.4.5.6.7.8", "1.2.3.256", "0001.02.3.4", "300.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 4111", "4111  1111 1111 1111",
    "+1 (555) 123-4567", "+1 (555) 123-4567 89012345678", "+12", "++441234567890-", "+44 20 7946 0958. 1.2.3.4", "9" * 40, "4" * 12 + "-", "", "é 😀 a@b.co 😀 10.0.0.1", "a" * 50 + "@" + "b." * 50, ".@-.-", "%@a.b-c.d_e",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for r in I.personal_data_digest(df).collect():
        assert tuple(r)[1:6] == brute.pii_row(TRICKY[r["doc_id"]]), TRICKY[r["doc_id"]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("a1.@-+ ()4é", max_size=60), min_size=30, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in I.personal_data_digest(df).collect():
        assert tuple(r)[1:6] == brute.pii_row(texts[r["doc_id"]])


def test_personal_data_on_odd_tables(spark):
    df = odd.documents(spark)
    assert sorted(tuple(r)[1:6] for r in I.personal_data_digest(df).collect()) == sorted(brute.pii_row(r["text"]) for r in df.collect())
    assert I.personal_data_digest(odd.no_documents(spark)).collect() == []


def test_very_long_runs(spark):
    long = ["a." * 50_000, "1" * 100_000, "x" * 200_000, "+1" + "-" * 50_000, "a@" + "b." * 20_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in I.personal_data_digest(df).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0), 4: (1, 0, 0, 0)}


def test_terms_that_reveal_an_entity(spark):
    """A code word that only ever stands by one address goes; common words beside it stay."""
    rng = np.random.default_rng(2)
    common = [f"com{i}x" for i in range(20)]
    filler = lambda k: " ".join(common[j % 20] for j in rng.integers(0, 20, k))
    rows = [(i, f"{filler(8)} Zorblat {filler(2)} boss@corp.example {filler(8)}") for i in range(6)]
    rows += [(6 + i, filler(40)) for i in range(300)] + [(400, "Zorblat alone, and z@x.y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = I.find_personal_data(df)
    kinds = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["all"]] for r in found.collect()}
    assert all(("removed", "Zorblat") in kinds[i] and ("email", "boss@corp.example") in kinds[i] and len(kinds[i]) == 2 for i in range(6))
    assert kinds[400] == [("removed", "Zorblat"), ("email", "z@x.y")] and kinds[7] == []  # it gives the address away there too
    clean = {r["doc_id"]: r["text"] for r in I.sanitise(found).collect()}
    assert "Zorblat" not in clean[0] and "[EMAIL]" in clean[0] and "boss" not in clean[0] and clean[7] == dict(rows)[7]


def test_disclosing_terms_go_wherever_they_stand(spark):
    """Also far from the entity, in texts that don't print it, and in texts without any base span."""
    rng = np.random.default_rng(2)
    filler = lambda k: " ".join(f"com{j}x" for j in rng.integers(0, 20, k))
    rows = [(i, f"{filler(8)} Zorblat {filler(2)} boss@corp.example {filler(30)}") for i in range(30)] + [(100 + i, filler(40)) for i in range(300)]
    rows += [(500, f"{filler(9)} ZORBLAT {filler(9)}"), (501, f"Zorblat {filler(2)}, {filler(1)} z@x.y"), (502, f"boss@corp.example {filler(40)} zorblat"), (503, "Zorblats stay")]
    found = I.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    terms = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["all"] if s["kind"] in ("general", "removed")] for r in found.collect()}
    assert {i: t for i, t in terms.items() if t} == {i: ["Zorblat"] for i in range(30)} | {500: ["ZORBLAT"], 501: ["Zorblat"], 502: ["zorblat"]}
    clean = {r["doc_id"]: r["text"] for r in I.sanitise(found).collect()}
    assert all("zorblat" not in clean[i].lower() for i in (0, 500, 501, 502)) and clean[503] == "Zorblats stay"


def test_terms_of_an_entity_in_a_single_text(spark):
    """One text holds the address and the name beside it; a word of five other texts that stands there too is no disclosure."""
    rng = np.random.default_rng(2)
    filler = lambda k: " ".join(f"com{j}x" for j in rng.integers(0, 20, k))
    rows = [(0, f"{filler(6)} Zorblat seldom {filler(1)} boss@corp.example {filler(8)}")] + [(1 + i, f"{filler(40)} {'seldom' if i < 5 else ''}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["all"]] for r in I.find_personal_data(df).collect()}
    assert [v for _, v in got.pop(0)] == ["Zorblat", "boss@corp.example"]
    assert not any(got.values())
    # Copies add nothing to what a term is known to disclose.
    copies = spark.createDataFrame(rows + rows[:1] * 40 + rows[5:6] * 40, "doc_id long, text string")
    again = {(r["doc_id"], *((s["kind"], s["start"]) for s in r["all"])) for r in I.find_personal_data(copies).collect()}
    assert again == {(r["doc_id"], *((s["kind"], s["start"]) for s in r["all"])) for r in I.find_personal_data(df).collect()}


def test_copies_prove_nothing(spark):
    rows = [(i, "quorzle thentary boss@corp.example vinter") for i in range(50)] + [(100 + i, "other words fill this") for i in range(50)]
    assert all(len(r["all"]) == len(r["base"]) for r in I.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_sanitise_overlaps(spark):
    df = spark.createDataFrame([(1, "call +4111111111111111 or mail a@b.co!"), (2, None), (3, "plain")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in I.sanitise(I.find_personal_data(df)).collect()}
    assert got[2] == "" and got[3] == "plain" and got[1].endswith("or mail [EMAIL]!") and "4111" not in got[1]


def test_terms_as_brute_force(spark):
    """Disclosing terms, their spans and the sanitised texts of a small corpus by plain counting."""
    rng = np.random.default_rng(11)
    vocab = [f"w{chr(97 + i % 26)}{i}" for i in range(150)]
    filler = lambda k: " ".join(vocab[j] for j in rng.integers(0, len(vocab), k))
    texts = [None, "", "none at all"] + [filler(30) for _ in range(200)]
    for p in range(20):
        name, mail = f"Name{chr(97 + p)}xo", [f"p{p}@corp.example", f"10.0.{p}.7", "+1 (555) 123-45%02d" % p][p % 3]
        texts += [f"{filler(5)} {name} {filler(p % 4)} {mail}, {filler(6)} {name.upper()}{'' if k % 2 else '@x.io'} {filler(3)}é😀 {name}" for k in range(1 + p)]
        texts += [f"{filler(6)} {name} {filler(4)}" for _ in range(p % 2 * (p + 1) // 3)]
    texts += texts[-3:]
    shares = brute.disclosing(texts)
    assert len(shares) > 8 and any(s >= 0.95 for s in shares.values()) and any(s < 0.95 for s in shares.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = I.find_personal_data(df)
    word = {"general": "[TERM]", "removed": ""}
    clean = {r["doc_id"]: r["text"] for r in I.sanitise(found).collect()}
    for r in found.collect():
        t, expected = texts[r["doc_id"]] or "", brute.all_spans(texts[r["doc_id"]] or "", shares)
        assert sorted((s["start"], s["end"], s["kind"]) for s in r["all"]) == expected
        out, at = "", 0
        for s, e, k in expected:
            if s >= at:
                out += t[at:s] + word.get(k, f"[{k.upper()}]")
            at = max(at, e)
        assert clean[r["doc_id"]] == out + t[at:]


def test_many_spans_in_one_text(spark):
    """A megabyte of addresses in one text, with a name that they disclose all over it."""
    many = "1.2.3.4 " * 125_000
    df = spark.createDataFrame([(0, many), (1, "Zorblat x@y.io " * 20_000)], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r for r in I.personal_data_digest(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in I.sanitise(I.find_personal_data(df)).collect()}
    assert time.monotonic() - began < 100
    assert got[0]["n_ip"] == 125_000 and tuple(got[0])[1:6] == brute.pii_row(many) and got[1]["n_email"] == 20_000
    assert clean[0] == "[IP] " * 125_000 and "@" not in clean[1]


# --- Encoding -------------------------------------------------------------------------------------


def test_encoding_as_the_library(spark):
    df = odd.documents(spark)
    rows = {}
    for r in encode(df, PATH, digests=True).collect():
        rows.setdefault(r["doc_id"], set()).add(tuple(r)[1:])
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    for (i, _), expected in zip(texts, brute.bpe_rows([t for _, t in texts], PATH), strict=True):
        assert expected in rows[i]
    assert encode(odd.no_documents(spark), PATH).collect() == []


@pytest.fixture(scope="module")
def bpe():
    return PairIndexBpe.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=40), min_size=1, max_size=20))
def test_any_text(bpe, texts):
    from hashlib import sha256

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = [(n, sha256(i.encode()).hexdigest(), sha256(d.encode()).hexdigest()) for n, i, d in bpe.encoded(texts)]
    assert got == list(brute.bpe_rows(texts, PATH))


def test_tricky_texts(bpe):
    texts = ["<|startoftext|>A<|endoftext|>", "it's WE'LL don't", "\x1c\x1f a\x85b", "ΑΣ ΣΑΣ İ ß ﬁ ² ½ Ⅳ", "e\u0301 \u0301x", "a" * 5000, "<|", "", " \n "]
    assert [(g[0]) for g in bpe.encoded(texts)] == [r[0] for r in brute.bpe_rows(texts, PATH)]


def test_letters_that_python_does_not_know(bpe):
    """Every code point that Python doesn't assign, between letters and by itself."""
    import unicodedata

    points = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn"]
    texts = [" ".join(f"a{c}b {c}" for c in points[at : at + 5000]) for at in range(0, len(points), 5000)]
    assert [g[0] for g in bpe.encoded(texts)] == [r[0] for r in brute.bpe_rows(texts, PATH)]
    some = [f"x{chr(first)}{chr(last)}é{chr(first)}" for first, last in [*B._LATER_LETTERS, *B._LATER_NUMBERS, *[r[:2] for r in B._LATER_CAPITALS]]]
    assert list(bpe.digests(some)) == list(brute.bpe_rows(some, PATH))


def test_memory_and_pieces(monkeypatch):
    """Tokens that are forgotten and met again, and texts longer than a piece, change nothing."""
    monkeypatch.setattr(B, "REMEMBERED", 50)
    monkeypatch.setattr(B, "RUN", 400)
    monkeypatch.setattr(B, "TOGETHER", 8)
    texts = odd.texts(n=20) * 2 + ["x" * 3000, " ".join(odd.texts(n=10)), "<|endoftext|> " * 100, "a\u2003b\x1cc " * 200]
    bpe = PairIndexBpe.from_file(PATH)
    assert list(bpe.digests(texts)) == list(brute.bpe_rows(texts, PATH))
    assert len(bpe.young.at) < 500


def test_merges_in_any_order_of_ranks():
    """Merges may bring up lower ranks, overlap, and have parts that other merges make."""
    import json

    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    spec = json.load(open(PATH, encoding="utf-8"))
    letters = B.byte_letters()
    for _ in range(25):
        vocab = {t: i for i, t in enumerate([*letters, *(c + "</w>" for c in letters)])}
        parts, merges = ["a", "b", "a</w>", "b</w>"], []
        for _ in range(12):
            x, y = parts[rng.integers(len(parts))], parts[rng.integers(len(parts))]
            if x.endswith("</w>") or [x, y] in merges:
                continue
            merges.append([x, y])
            vocab.setdefault(x + y, len(vocab))
            parts.append(x + y)
        rng.shuffle(merges)
        own = spec | {"added_tokens": [], "model": spec["model"] | {"vocab": vocab, "merges": merges}}
        texts = ["".join(rng.choice(["a", "b"], rng.integers(1, 14))) for _ in range(60)]
        library = Tokenizer.from_str(json.dumps(own))
        assert [g[1] for g in PairIndexBpe(own).encoded(texts)] == [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_files_of_another_kind():
    import json

    with pytest.raises(ValueError):
        PairIndexBpe(json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8")))


def test_plain_output(spark):
    r = encode(spark.createDataFrame([(1, "Hello world")], "doc_id long, text string"), PATH).first()
    assert r["n_tokens"] == len(r["ids"]) == 2 and r["decoded"] == "hello</w> world</w>"


# --- Media ----------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    df = odd.documents(spark)
    got = sorted(tuple(r)[1:5] for r in A.text_media(df).collect())
    assert got == sorted(brute.media_row(r["text"]) for r in df.collect())
    by_text = {}
    for r in df.join(A.text_media(df).withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).where("doc_id not in (3, 4)").collect():
        by_text.setdefault(r["text"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert A.text_media(odd.no_documents(spark)).collect() == []


def test_companding_tables():
    assert A.MU[0xFF] == 0 and A.MU[0x00] == -32124 and A.MU[0x80] == 32124
    assert A.A[0xD5] == 8 and A.A[0x55] == -8 and A.A[0x2A] == -32256 and A.A[0xAA] == 32256
    assert len(set(A.A.tolist())) == 256 and len(A.STEPS) == 89


def test_adpcm():
    rng = np.random.default_rng(7)
    blocks = rng.integers(0, 256, (50, A.BLOCK)).astype(np.uint8)
    assert A.decode_adpcm(blocks).tolist() == [brute.scalar_adpcm(b.tolist()) for b in blocks]
    wave = (8000 * np.sin(np.arange(2000) / 20)).astype(np.int16)
    back = A.decode_adpcm(np.frombuffer(A.encode_adpcm(wave), np.uint8).reshape(-1, A.BLOCK)).ravel()[: len(wave)]
    assert np.abs(back.astype(int) - wave).max() < 1500


def test_figures_of_media(spark):
    """Loudness, crossings and the stored PCM, recomputed sample by sample; the files themselves."""
    df = odd.documents(spark, n=12)
    got = {}
    for r in A.text_media(df).collect():
        got.setdefault(r["doc_id"], set()).add((r["feature"], r["pcm_bytes"], r["pcm_sha256"], r["media_sha256"]))
    files = A.media_of_texts(df).collect()
    for r in files:
        assert any((f[1], f[2], f[3]) == (len(r["pcm"]), sha256(r["pcm"]).hexdigest(), sha256(r["media"]).hexdigest()) for f in got[r["doc_id"]])
        tag, rate, block, data = A.read_wave(bytes(r["pcm"]))
        assert (tag, rate, block, len(data)) == (A.PCM, 16000, 2, 4 * len(A.read_wave(bytes(r["media"]))[3]))
    for r in df.collect():
        assert brute.media_features(r["text"]) in {f[0] for f in got[r["doc_id"]]}


def test_files_that_cannot_be(spark):
    """Blocks and rates that make no sense give null, and don't end the task."""
    good = A.wave_file(bytes(64), A.MU_LAW)
    stereo = bytearray(good)
    stereo[22] = 2
    adpcm = A.wave_file(bytes(64), A.IMA_ADPCM, bits=4, block=64)
    files = [adpcm[:32] + bytes([b, 0]) + adpcm[34:] for b in (0, 1, 2, 4)] + [A.wave_file(bytes(64), t, rate=r) for t in (A.MU_LAW, A.PCM) for r in (0, 1, 10**9)]
    files += [A.wave_file(bytes(64), A.PCM, bits=24, block=3), A.wave_file(bytes(63), A.PCM, bits=16, block=2), bytes(stereo), good[:20], good[:-70], b"", good]
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "id int, media binary")
    got = {r["id"]: r["pcm"] for r in A.to_pcm(df).collect()}
    assert [i for i in got if got[i] is not None] == [len(files) - 1]


def test_to_pcm(spark):
    wave = (8000 * np.sin(np.arange(400) / 20)).astype(np.int16)
    files = [A.wave_file(bytes(range(64)), A.MU_LAW), A.wave_file(bytes(range(64)), A.A_LAW), A.wave_file(A.encode_adpcm(wave), A.IMA_ADPCM, bits=4, block=A.BLOCK), A.wave_file(b"", A.MU_LAW), b"no media", None, A.wave_file(b"x", 99)]
    df = spark.createDataFrame([(i, bytearray(f) if f is not None else None, b"old") for i, f in enumerate(files)], "id int, media binary, pcm binary")
    got = {r["id"]: r["pcm"] for r in A.to_pcm(df).collect()}
    assert [got[i] for i in (4, 5, 6)] == [None] * 3
    tag, rate, block, data = A.read_wave(bytes(got[0]))
    assert (tag, rate, block, len(data)) == (A.PCM, 16000, 2, 256) and (np.frombuffer(data, "<i2")[::2] == A.MU[np.arange(64)]).all()
    assert A.read_wave(bytes(got[3]))[3] == b"" and len(A.read_wave(bytes(got[2]))[3]) == 4 * 121 * 4
    assert (A.resample(np.array([0, 10], np.int16), 1, 2) == [0, 5, 10, 10]).all()
