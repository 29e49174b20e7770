"""Mixing, sharding, url rules, the pipeline and the registry."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import sharding as H
from quern.llm import url_filter as U
from quern.llm.mixing import mix_documents, mix_sources, source_targets
from quern.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from quern.llm.sharding import assign_shards, longest_first
from tests.llm import brute, odd


def test_mixing(spark):
    df = odd.documents(spark)
    rows = df.collect()
    got = mix_sources(df, keep=("source", "text")).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(brute.SPACE.findall(r["text"] or ""))
    expected, taken = brute.targets(dict(sizes)), Counter()
    for r in got:
        n = len(brute.SPACE.findall(r["text"] or ""))
        assert r["size"] == n and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]]) and r["taken"] in (0, n, 2 * n)
        taken[r["source"]] += r["taken"]
    largest = defaultdict(int)
    for r in got:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - expected[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df, keep=("source", "text")).collect()))
    assert mix_sources(odd.no_documents(spark)).collect() == []


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("abé", max_size=3)), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(brute.targets(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_sharding(spark):
    df = odd.documents(spark)
    rows = df.collect()
    got = assign_shards(df).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    of, slots = {}, defaultdict(list)
    for r in got:
        assert of.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"] and 0 <= r["shard"] < 16 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert assign_shards(odd.no_documents(spark)).collect() == []


@pytest.mark.parametrize("most", [1, 4096])
def test_shards_as_a_heap_over_all_groups(spark, monkeypatch, most):
    """Each group to the least-loaded shard, largest first; which of the groups of a size goes where is by hash."""
    monkeypatch.setattr(H, "HOT", most)
    df = odd.documents(spark)
    df = df.unionByName(spark.createDataFrame([(5000 + i, f"{'y' * (i % 9)}{i % 150:03d}", "en", "s", 1) for i in range(700)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    texts = [r["text"] for r in df.collect()]
    loads, of_size, sizes = brute.sharded(texts)
    crc = {(zlib.crc32(t.encode()), len(t.encode()) + 1): n for t, n in sizes.items()}
    got, placed, seen = Counter(), defaultdict(list), set()
    for r in assign_shards(df).collect():
        got[r["shard"]] += r["size"]
        if (r["text_crc32"], r["size"]) not in seen:
            seen.add((r["text_crc32"], r["size"]))
            placed[crc[r["text_crc32"], r["size"]]].append(r["shard"])
    assert dict(got) == {s: n for s, n in loads.items() if n} and {k: sorted(v) for k, v in placed.items()} == of_size


def test_shards_are_balanced(spark):
    df = spark.createDataFrame([(i, "x" * (i % 97 + 1) + str(i)) for i in range(4000)] + [(9000 + i, "hot") for i in range(300)], "doc_id long, text string")
    loads = Counter()
    for r in assign_shards(df).collect():
        loads[r["shard"]] += r["size"]
    assert len(loads) == 16 and max(loads.values()) < 1.03 * min(loads.values())


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 300), max_size=20), st.integers(1, 8))
def test_longest_first(counts, shards):
    sizes = np.array(sorted(counts, reverse=True), int)
    out = longest_first(sizes, np.array([counts[s] for s in sizes.tolist()], int), shards)
    loads, expected = [(0, s) for s in range(shards)], np.zeros((len(sizes), shards), int)
    for i, size in enumerate(sizes.tolist()):
        for _ in range(counts[size]):
            load, shard = loads[0]
            heapq.heapreplace(loads, (load + size, shard))
            expected[i, shard] += 1
    assert (out == expected).all()
    if len(sizes):  # Graham's bound
        least = max(sizes.max(), (sizes * out.sum(1)).sum() / shards)
        assert (sizes[:, None] * out).sum(0).max() <= (4 / 3) * least + sizes.max()


URLS = [
    "http://a.example.com/en/1", "https://EXAMPLE.com/en/7x?q", "http://x.com/de/1", "http://netx/de/1", "http://a.net/de/8#f", "http://example.net/de/81", "http://x.example.net:80/de/8", "http://com/en/", "http://notexample.com/en/7", "/en/1", None, "",
    "http://a.org?x=/es/", "http://a.org/es/1://b.com/en/2", "a://b.org/es/\n1", "http://İ.com/en/1", "://org/es/1", "http://a.org#/es/",
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)] * 2, "page_id long, url string, html string").selectExpr("*", "1 as node", "2 as host")
    rows = U.judge_pages(df).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path, rule = brute.url_row(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, brute.RULES.get(rule, "allow"))
    assert U.judge_pages(df.limit(0)).collect() == []


def test_contract_rules(spark):
    """Each rule by the word that the contract gives it."""
    urls = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"), "http://a.example.net/de/8": ("example.net/de/8", "block"), "http://a.org/es/1": ("org/es/", "block")}
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert [(r["rule"], r["verdict"]) for r in U.judge_pages(df).orderBy("page_id").collect()] == list(urls.values())


def test_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (1, "http://a.fr/x", link("http://b.com/en/1")), (2, "http://c.fr/y", "<LINK href='http://a.fr/x#top' rel=canonical>"), (3, "http://example.com/en/7", link("http://a.fr/x")), (4, "http://d.fr/", link("/z")),
        (5, "http://d.fr/z", '<meta http-equiv="refresh" content="0; url=http://b.com/en/1">'), (6, "http://e.fr/q", link("http://f.fr/")), (7, "http://f.fr/", "<p>canonical</p>"), (8, "http://g.fr/a/b", link("c")), (9, "http://g.fr/a/c", link("//h.net/de/1")),
        (10, "http://i.fr/1", '<link rel="stylesheet" href="http://b.com/en/1">'), (11, None, link("http://b.com/en/1")),
    ]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v[1] == "block"} == {1, 2, 4, 5, 8, 9}
    assert got[3] == ("example.com/en/7", "allow") and got[1][0] is None


@pytest.mark.parametrize("seed", range(3))
def test_random_alias_graphs(spark, seed):
    """Chains, cycles, hubs and strangers, addressed in different ways, with several rules in a component, beside a union-find."""
    rng = np.random.default_rng(seed)
    hosts, kinds = ["a.com", "b.example.com", "c.net", "x.example.net", "d.org", "e.fr", "f.fr", "g.de"], ["en/1", "en/7", "de/1", "de/8", "es/2", "q/1", "q/2", "q/3", "r/é", "r/b&c"]
    urls = [f"http://{h}/{k}" for h in hosts for k in kinds]
    pages = []
    for i, u in enumerate(urls * 2):
        links = [urls[j] for j in rng.integers(0, len(urls), rng.integers(0, 2 + seed))] if rng.random() < 0.35 else []
        pages.append((i, u, links))
    pages += [(1000 + i, f"http://chain.fr/{i}", [f"http://chain.fr/{i + 1}"]) for i in range(30)] + [(1030, "http://chain.fr/30", ["http://z.com/en/1"])]
    pages += [(2000 + i, f"http://ring.fr/{i}", [f"http://ring.fr/{(i + 1) % 12}"]) for i in range(12)]

    def tag(u, v):
        host, path = v.split("/", 3)[2:]
        ways = [v, v.upper().replace(path.upper(), path) if rng.random() < 0.5 else v + "#part"]
        if host == u.split("/")[2]:
            ways += ["/" + path, "//" + host + "/" + path, *([path.split("/")[1]] if path.split("/")[0] == u.split("/")[3] else [])]
        way = ways[rng.integers(len(ways))].replace("&", "&amp;")
        return [f'<link rel="canonical" href="{way}">', f"<LINK href='{way}' rel='nofollow canonical' />", f'<meta http-equiv="Refresh" content="0; URL={way}">', f"<meta content='5;url={way}' http-equiv=refresh>"][rng.integers(4)]

    html = [(i, u, "<html><head>" + "".join(tag(u, v) for v in vs) + '<link rel="stylesheet" href="http://a.com/en/1"></head>') for i, u, vs in pages]
    got = {r["page_id"]: r["verdict"] for r in U.judge_pages(spark.createDataFrame(html, "page_id long, url string, html string")).collect()}
    expected = brute.verdicts(pages, brute.RULES)
    assert got == expected and {"allow", "block"} == set(expected.values())
    assert any(expected[i] == "block" and brute.url_row(u)[2] is None for i, u, _ in pages)


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    odd.documents(spark, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    odd.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, odd.no_documents(spark), str(tmp_path)).count() == 0
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_mix_documents(spark):
    df = odd.documents(spark)
    expected = Counter()
    for r in mix_sources(df, keep=("text", "source")).collect():
        expected[r["doc_id"], r["text"], r["source"]] += r["epochs"]
    got = mix_documents(df)
    assert got.columns == df.columns
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == +expected


def test_pipeline_stages_decide(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op1_quality_gam"](spark, sf).collect()}
    assert one == {i for i, p in scores.items() if p}
    two = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    classes = brute.near_classes([(r["doc_id"], r["text"]) for r in docs.collect()], corpus_pipeline.NEAR_PERCENT)
    assert two == {i for i, (_, c) in classes.items() if i == c}
    three = {r["doc_id"]: r for r in corpus_pipeline.personal_data(spark, docs, sf).collect()}
    for r in docs.collect():
        new = three[r["doc_id"]]["text"]
        assert (new == r["text"]) == (not brute.base_spans(r["text"])) and not brute.base_spans(new)
    expected = dict(zip(three, brute.bpe_rows([three[i]["text"] for i in three], tokenizer_path()), strict=True))
    five = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.tokens(spark, corpus_pipeline.personal_data(spark, docs, sf), sf).collect()}
    assert five == expected
    four = Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, sf).collect())
    assert four == Counter({r["doc_id"]: r["taken"] // r["size"] for r in QUERIES["op3_mixing"](spark, sf).collect() if r["taken"]})


def test_registry(spark, sf):
    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in QUERIES
    assert set(ORACLE_SQL) <= set(QUERIES)
