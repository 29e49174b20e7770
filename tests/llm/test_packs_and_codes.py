"""Packing, whitening and vector codes beside plain versions."""

from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import packing as P
from quern.llm import queries as Q
from quern.llm import vector_codes as C
from quern.llm import whitening as W
from tests.llm import odd

FILE = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids, 1]


def check_packed(rows, window, texts):
    """Every id in exactly one piece, sequences without gaps and within the window; returns the share of padding."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end and 0 < r["length"] <= window
            end += r["length"]
        assert end <= window
    assert sorted(sequences) == list(range(len(sequences)))
    wanted = defaultdict(list)
    for i, text in texts:
        ids = plain_ids(text)
        wanted[i, len(ids)] += [(at, zlib.crc32(np.array(ids[at : at + window], "<u4").tobytes())) for at in range(0, len(ids), window)]
    assert {k: sorted((r["start"], r["ids_crc32"]) for r in v) for k, v in documents.items()} == {k: sorted(v) for k, v in wanted.items()}
    return 1 - sum(r["length"] for r in rows) / (len(sequences) * window)


@pytest.mark.parametrize("window", [2048, 64])
def test_packs_odd_tables(spark, window):
    docs = odd.documents(spark)
    rows = P.pack_documents(docs, FILE, window=window).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_packed(rows, window, texts)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_packs_all_documents(spark, sf):
    rows = Q.QUERIES["op11_packing"](spark, sf).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packed(rows, 2048, texts) < 0.03


def test_packs_nothing(spark):
    assert P.pack_documents(odd.no_documents(spark), FILE).count() == 0


def test_sequences_hold_their_pieces(spark):
    docs = odd.documents(spark, n=20)
    pieces = P.pack_documents(docs, FILE, window=256)
    at = {}
    for r in pieces.collect():
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["doc_id"], r["ids"]))
    for s in P.packed_sequences(pieces).collect():
        own = sorted(at[s["sequence_id"]], key=lambda x: x[0])
        assert s["ids"] == [i for _, _, ids in own for i in ids] and s["starts"] == [x[0] for x in own] and s["doc_ids"] == [x[1] for x in own]


def test_long_texts_by_pieces(monkeypatch):
    with open(FILE, encoding="utf-8") as file:
        spec = file.read()
    texts = ["a long text, of 12 words that's cut.  Twice,\n or more! " * 40, "", "no", " x" * 50 + "<|endoftext|> y z" * 9]
    whole = [v.tolist() for v in P.document_ids(spec, texts)]
    monkeypatch.setattr(P, "RUN", 37)
    assert [v.tolist() for v in P.document_ids(spec, texts)] == whole == [plain_ids(t) for t in texts]


@given(st.dictionaries(st.integers(1, 24), st.integers(1, 60), max_size=12), st.sampled_from([8, 24]))
@settings(max_examples=60, deadline=None)
def test_plan_uses_every_piece(histogram, classes):
    histogram = {c: n for c, n in histogram.items() if c <= classes}
    used = defaultdict(int)
    for repeats, pieces in P.packing_plan(histogram, classes):
        assert repeats > 0 and sum(c * n for c, n in pieces.items()) <= classes
        for c, n in pieces.items():
            used[c] += repeats * n
    assert used == histogram


def test_combinations_are_all_of_three():
    plain = {tuple(sorted(x for x in (a, b, 12 - a - b) if x)) for a in range(13) for b in range(13 - a)}
    found = P.shallow_combinations(12)
    assert {tuple(sorted(x for x in row if x)) for row in found.tolist()} == plain and len(found) == len(plain)


def test_least_squares_are_optimal():
    rng = np.random.default_rng(3)
    combos = P.shallow_combinations(24)
    for _ in range(10):
        wanted = np.append(0, rng.integers(0, 500, 24)).astype(float)
        weight = np.arange(25) / 24
        x = P.non_negative_least_squares(combos, wanted, weight.copy())
        use = np.zeros(25)
        for c, n in zip(combos, x, strict=True):
            np.add.at(use, c, n)
        use[0] = 0
        # What makes a solution the optimum: no gradient points into the allowed region.
        gradient = (np.where(np.arange(25) > 0, weight**2, 0) * (wanted - use))[combos].sum(1)
        assert (x >= 0).all() and gradient.max() < 1e-4 and np.abs(gradient[x > 0]).max() < 1e-4


def test_plan_beats_no_plan_and_little_is_padded():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 20_000).astype(int), 1, 2048)
    histogram = dict(enumerate(np.bincount(-(-lengths // 8), minlength=257).tolist()))
    plan = P.packing_plan({c: n for c, n in histogram.items() if n}, 256)
    assert 1 - lengths.sum() / (2048 * sum(n for n, _ in plan)) < 0.01
    exact = sum(n for n, p in plan if sum(p.values()) <= 3 and sum(c * k for c, k in p.items()) == 256)
    assert exact > 0.7 * sum(n for n, _ in plan)
    # Counts of any size cost the same.
    assert sum(n for n, _ in P.packing_plan({c: n * 10**6 for c, n in histogram.items() if n}, 256)) > 10**9


# Whitening


def vectors(spark, n=300, dim=20, seed=5):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dim)) @ rng.standard_normal((dim, dim)) / 3 + rng.standard_normal(dim)).round(3)
    rows = [(i, x[i].tolist(), i % 4) for i in range(n)]
    rows += [(n, x[0].tolist(), None), (n + 1, x[0].tolist(), 1), (None, x[1].tolist(), None), (3, x[3].tolist(), 3)]
    rows += [(n + 2, None, 1), (n + 3, [], 1), (n + 4, [None] * dim, 1), (n + 5, [float("nan")] * dim, 1), (n + 6, [float("-inf")] * dim, 1), (n + 7, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in ["x", "id", "vector", "component", "n", "code", "error", "part"]:
        df = df.withColumn(c, F.lit("clash"))
    return df


def kept_rows(df, dim):
    return [(r["vec_id"], r["label"], np.array(r["embedding"], float)) for r in df.collect() if r["embedding"] and len(r["embedding"]) == dim and all(v is not None and np.isfinite(v) for v in r["embedding"])]


@pytest.mark.parametrize("dim", [20, 5])
def test_whitening_as_numpy(spark, dim):
    df = vectors(spark, dim=dim)
    kept = kept_rows(df, dim)
    x = np.array([np.floor(64 * v).astype(np.int64) + 1_000_000 for _, _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums) / n
    variance, axes = np.linalg.eigh(centred.T @ centred / n)
    variance, axes = variance[::-1], axes[:, ::-1]
    k = min(16, dim)
    rows = W.whiten(df).collect()
    assert len(rows) == len(kept) * k and {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1
    assert rows[0]["identity_error"] < 1e-8
    white = ((x * n - sums) / n) @ axes[:, :k] / np.sqrt(variance[:k])
    plain = defaultdict(list)
    for (i, _, _), own, w in zip(kept, x, white, strict=True):
        for c in range(k):
            plain[i, c + 1].append((sum(int(v) ** 2 for v in own * n - sums), round(abs(w[c]), 6), round(variance[c] / variance.sum(), 9)))
    found = defaultdict(list)
    for r in rows:
        found[r["vec_id"], r["component"]].append((r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 9)))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in plain.items()}


def test_whitening_of_what_does_not_vary(spark):
    kind = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], kind)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    line = W.whiten(spark.createDataFrame([(1, [1.0, 7.0]), (2, [2.0, 7.0]), (2, [2.0, 7.0])], kind)).collect()
    assert [(r["vec_id"], r["component"], r["n"], round(abs(r["whitened"]), 9)) for r in sorted(line, key=lambda r: r["vec_id"])] == [(1, 1, 2, 1.0), (2, 1, 2, 1.0), (2, 1, 2, 1.0)]
    huge = W.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0])], kind)).collect()
    assert all(np.isfinite(r["whitened"]) for r in huge) and huge


def test_squares_beyond_64_bits():
    x = np.array([[1 << 40, 1 << 40], [1, 2]])
    assert W._squares(x) == [None, 5]
    assert W._squares(x[:, :1] >> 10) == [1 << 60, 0]


def test_whitening_query(spark, sf):
    rows = Q.QUERIES["op12_whitening"](spark, sf)
    assert rows.agg(F.max("identity_error")).first()[0] < 1e-4
    assert rows.count() == 16 * spark.read.parquet(f"{sf}/embeddings.parquet").count()


# Vector codes


@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=80), st.integers(0, 2**32), st.sampled_from([1, 4, 8]), st.sampled_from([1, 10**6, 1 << 26]))
@settings(max_examples=80, deadline=None)
def test_tree_finds_the_nearest(entries, seed, leaf, wide):
    entries = np.array(entries) * wide
    points = np.random.default_rng(seed).integers(-4, 5, (60, 3)) * wide
    far = ((points[:, None].astype(object) - entries[None]) ** 2).sum(2)
    number, square = C.BallTree(entries, leaf=leaf).nearest(points)
    assert number.tolist() == [int(min(range(len(entries)), key=lambda e: (f[e], e))) for f in far]
    assert square.tolist() == far.min(1).tolist()


def test_tree_leaves_balls_out():
    rng = np.random.default_rng(2)
    tree = C.BallTree(rng.integers(-1000, 1000, (64, 2)))
    visited = []
    leaf_of = C.BallTree._visit

    def spy(self, points, rows, best, number):
        if not self.children:
            visited.append(len(rows))
        leaf_of(self, points, rows, best, number)

    C.BallTree._visit = spy
    try:
        tree.nearest(rng.integers(-1000, 1000, (500, 2)))
    finally:
        C.BallTree._visit = leaf_of
    assert sum(visited) < 0.5 * 500 * 8


def plain_codes(kept, dim, parts=16, entries=64, rounds=2):
    """Codes by trying every entry with Python's integers."""
    x = [[int(np.floor(256 * v)) for v in vec] for _, _, vec in kept]
    ends = np.cumsum([0, *[len(p) for p in np.array_split(np.arange(dim), parts)]]).tolist()
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i]))[:entries]
    books = [[x[i][a:b] for i in first] for a, b in zip(ends, ends[1:], strict=False)]

    def near(p, row):
        part = row[ends[p] : ends[p + 1]]
        return min((sum((u - w) ** 2 for u, w in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for row in x:
            for p in range(parts):
                groups[p, near(p, row)[1]].append(row[ends[p] : ends[p + 1]])
        for (p, e), own in groups.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for (i, label, _), row in zip(kept, x, strict=True):
        found = [near(p, row) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(s for s, _ in found)))
    of_label = defaultdict(int)
    for _, label, _, error in out:
        of_label[label] += error
    return [(i, code, error, of_label[label], digest) for i, label, code, error in out]


@pytest.mark.parametrize("dim", [32, 20, 5])
def test_codes_as_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(C, "BATCH", 100)
    df = vectors(spark, dim=dim)
    key = lambda r: tuple(str(v) for v in r)
    found = [tuple(r) for r in C.compress_vectors(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(found, key=key) == sorted(plain_codes(kept_rows(df, dim), dim), key=key)


def test_codes_of_odd_tables(spark, monkeypatch):
    kind = "vec_id long, embedding array<float>, label int"
    assert C.compress_vectors(spark.createDataFrame([], kind)).count() == 0
    assert C.compress_vectors(spark.createDataFrame([(1, None, 1), (2, [], 1)], kind)).count() == 0
    one = C.compress_vectors(spark.createDataFrame([(1, [3e38, -3e38, 0.5], None)], kind)).collect()
    assert [(r["vec_id"], r["error"], r["label_error"], r["code"]) for r in one] == [(1, 0, 0, "00" * 16)]
    monkeypatch.setattr(C, "SMALL", 1)
    df = vectors(spark, n=80, dim=16)
    assert sorted(r["label_error"] for r in C.compress_vectors(df).collect()) == sorted(r[3] for r in plain_codes(kept_rows(df, 16), 16))


def test_codes_as_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    theirs = con.sql(Q.ORACLE_SQL["op13_vector_codes"])
    mine = Q.QUERIES["op13_vector_codes"](spark, sf).select(theirs.columns)
    assert sorted(map(tuple, mine.collect())) == sorted(theirs.fetchall())


def test_both_libraries_agree():
    with open(FILE, encoding="utf-8") as file:
        ids = P.Ids(file.read())
    assert ids.fast
    plain = lambda t: ids.tokenizer.encode(t, add_special_tokens=False).ids
    settled = [chr(k) for k in range(1, 0x110000, 7) if not 0xD800 <= k < 0xE000 and not P._unsettled().search(chr(k))]
    assert len(settled) > 30_000 and all(P._unsettled().search(c) for c in "͸\U0001f600\U00010d50\U0001e5d0")
    settled += [chr(k) for k in range(1, 0x3000) if not P._unsettled().search(chr(k))]
    for at in range(0, len(settled), 100):
        text = "".join(f"a{c}1 {c}{c} {c} b" for c in settled[at : at + 100])
        assert ids.of(text).tolist() == plain(text)
    for text in ["a<|endoftext|> b", "we're \n\n  they'd  ", "\U0001f600 \U00010d50x", "x" * 3000 + "é" * 3000, "\x85\xa0 a b"]:
        assert ids.of(text).tolist() == plain(text)
