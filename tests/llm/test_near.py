"""Near duplicates of documents and of vectors, and connected components."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import near_minhash as N
from quern.llm import near_vectors as V
from quern.llm.components import connected_components
from tests.llm import brute, odd


def test_documents_as_brute_force(spark):
    df = odd.documents(spark).where("n_chars is null or n_chars <> 3 or doc_id <> 4")  # the id with two texts has a test of its own
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    expected = brute.near_classes({i: t for i, t in rows if i is not None}.items())
    got = N.near_duplicate_classes(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*expected[r["doc_id"]], r["doc_id"] == expected[r["doc_id"]][1])


def test_two_texts_of_an_id_have_their_own_classes(spark):
    t = odd.texts(n=10)
    df = spark.createDataFrame([(1, t[0]), (2, t[1]), (3, t[0]), (3, t[1])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in N.near_duplicate_classes(df).collect()) == [(1, 1), (2, 2), (3, 1), (3, 2)]
    first = spark.createDataFrame([(1, t[0]), (1, t[1]), (3, t[0]), (4, t[1])], "doc_id long, text string")
    assert {r["component_id"] for r in N.near_duplicate_classes(first).collect()} == {1}


def test_no_documents(spark):
    assert N.near_duplicate_classes(odd.no_documents(spark)).collect() == []


def test_group_of_edited_copies(spark):
    """Copies with few and many edits of one text, more than one leader can hold together."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(int(rng.integers(0, 7))):
            w[int(rng.integers(0, 150))] = f"e{i}.{k}"
        rows.append((1000 - i, " ".join(w)))
    expected = brute.near_classes(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_chain_across_leaders(spark):
    """a-b, b-c and c-d are links, a-d isn't."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([f"n{k if i < 4 * k else ''}.{i}" if i < 4 * k else w for i, w in enumerate(base)])) for k in range(5)]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute.near_classes(rows)


def test_remaining_links_are_complete(spark):
    rows = [(i, t) for i, t in enumerate(odd.texts(n=40))]
    df = spark.createDataFrame(rows, "id long, text string")
    nodes = spark.createDataFrame([(i, i) for i, _ in rows], "node long, c long")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in N.remaining_links(nodes, df, 85).collect()}
    sets = {i: brute.shingles(t) for i, t in rows}
    assert got == {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}


def test_bands_follow_the_threshold():
    assert N.bands_and_rows(85) == (40, 8)
    for percent in (50, 70, 80, 90, 99, 100):
        bands, rows = N.bands_and_rows(percent)
        assert bands * rows <= N.REGISTERS and (1 - (percent / 100) ** rows) ** bands <= 3e-6


def test_pipeline_stage_at_similarity_080(spark):
    """Pairs from 0.80 to below 0.85 go, pairs right below 0.80 stay."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        base = [f"w{i}.{k}" for k in range(int(rng.integers(60, 160)))]
        shingles = len(base) - 4
        lost = int(shingles * rng.uniform(0.08, 0.13))  # shingles that the copy's end lacks
        edited = [*base[: len(base) - lost], *(f"e{i}.{k}" for k in range(lost))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited))]
    found = {p: {i for i, (_, c) in brute.near_classes(rows, p).items() if i == c} for p in (80, 85)}
    assert 60 < len(found[80]) < len(found[85])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == found[80]


def test_joint_estimate():
    rng = np.random.default_rng(5)
    for j in (0.5, 0.85, 0.95):
        both = int(1000 * j)
        x = rng.integers(0, 2**63, 2000 - both).astype(np.uint64)
        a, b = x[:1000], np.concatenate([x[:both], x[1000:]])
        true = both / len(x)
        est = N.joint_estimate(N.registers(a)[None], N.registers(b)[None], np.array([1000.0]), np.array([float(len(b))]))[0]
        assert abs(est - true) < 0.1
    whole = np.maximum(N.registers(a), N.registers(b))
    assert (whole == N.registers(np.concatenate([a, b]))).all()  # registers are mergeable


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == brute.components(nodes, [e for e in edges if e[0] != e[1]])


def test_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 502


def vectors(seed=4, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    near = x[: n // 2] + rng.standard_normal((n // 2, dim)) * rng.uniform(0.02, 0.6, (n // 2, 1))
    rows = [(i, v.tolist(), int(b % 3)) for i, (b, v) in enumerate([*enumerate(x), *enumerate(near), *enumerate(x[:10]), *enumerate(x[:10] * 3)])]
    k = len(rows)
    rows = [(i, [float(np.float32(a)) for a in v], label) for i, v, label in rows]
    rows += [(k, None, 1), (k + 1, [], 1), (k + 2, [0.0] * dim, 1), (k + 3, [None] * dim, 1), (k + 4, [float("nan")] + [1.0] * (dim - 1), 1), (k + 5, [float("inf")] * dim, 1), (k + 6, rows[0][1], None), (k + 7, [1.0, 2.0], 1), (k + 8, [1.0, 2.0], 1), (k + 9, [5.0], 1), (k + 10, [-5.0], 1)]
    return rows


@pytest.mark.parametrize("recall, cell", [(V.RECALL, 256), (1.0, 4), (V.RECALL, 4)])
def test_vectors_as_brute_force(spark, monkeypatch, recall, cell):
    monkeypatch.setattr(V, "CELL", cell)
    monkeypatch.setattr(V, "RESIDENTS", 16)
    monkeypatch.setattr(V, "VISITORS", 32)
    rows = vectors()
    df = spark.createDataFrame([*rows, (None, rows[0][1], 0)], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cell", "2 as rep", "3 as id", "4 as role")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.near_duplicate_vectors(df, recall=recall).collect()}
    assert got.pop(None) == (0, None)
    expected = brute.vector_links(rows)
    assert got == expected and sum(n for n, _ in expected.values()) > 100


def test_crowd_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(V, "RESIDENTS", 64)
    monkeypatch.setattr(V, "VISITORS", 64)
    rng = np.random.default_rng(6)
    x = rng.standard_normal(8)
    rows = [(i, [float(np.float32(a)) for a in x + rng.standard_normal(8) * 0.35], 0) for i in range(300)] + [(300 + i, [1.0] * 8, 0) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    expected = brute.vector_links(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.near_duplicate_vectors(df, recall=1.0).collect()} == expected
    # By default, pairs near the threshold may be missed in a crowd to one side of them.
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.near_duplicate_vectors(df).collect()}
    assert all(got[i][0] <= expected[i][0] for i in expected) and {c for _, c in got.values()} == {c for _, c in expected.values()}
    assert sum(n for n, _ in got.values()) > 0.999 * sum(n for n, _ in expected.values())


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert V.near_duplicate_vectors(none).collect() == []


def test_recall_at_the_threshold():
    """Traversal up to the calibrated reach meets nearly every pair at the threshold."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = V.fit_grid(x, 16, 0.93, V.RECALL)
    off = rng.standard_normal(x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    met = [(a, set(ca.tolist()), b, set(cb.tolist())) for (a, ca), (b, cb) in zip(grid.visits(x), grid.visits(y), strict=True)]
    assert np.mean([b in ca or a in cb for a, ca, b, cb in met]) > 0.998
    assert np.mean([len(ca) for _, ca, _, _ in met]) < 256
