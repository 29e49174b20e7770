"""Selectors beside a plain walk over the tree that a page was written from."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import html as H

NAMES, CLASSES = ["div", "section", "article", "span", "b", "h1", "em"], ["body", "lead", "x", "main-text"]
SELECTORS = ["div", ".body", "div.body", "div.lead.x", "article .body b", "section div span", "#one", "div#two b", "*[data-k]", "article [data-k=v1]", "span, b", "em.x, section .main-text"]


def random_tree(rng, depth=0):
    """``(name, attributes, children)``; children are texts or trees, some elements have no content."""
    if depth and rng.random() < 0.1:
        return (rng.choice(["br", "img", "hr"]), {}, [])
    attributes = {}
    if rng.random() < 0.6:
        attributes["class"] = " ".join(rng.sample(CLASSES, rng.randint(1, 3)))
    if rng.random() < 0.1:
        attributes["id"] = rng.choice(["one", "two"])
    if rng.random() < 0.2:
        attributes["data-k"] = rng.choice(["v1", "v2", "a > b", 'say "x" class=body'])
    children = []
    for _ in range(rng.randint(0, 4) if depth < 6 else 0):
        children.append(random_tree(rng, depth + 1) if rng.random() < 0.6 else rng.choice([" word ", "two words", "\n", "1 < 2", "a&amp;b"]))
    return (rng.choice(NAMES), attributes, children)


def written(rng, tree):
    name, attributes, children = tree
    pairs = []
    for k, v in attributes.items():
        bare = not any(c in v for c in " \"'>=")
        quote = rng.choice(["'", "" if bare else "'"] if '"' in v else ['"', "'", "" if bare else '"'])
        pairs.append(f"{rng.choice([' ', chr(10), '  '])}{rng.choice([k, k.upper()])}{rng.choice(['=', ' = '] if quote else ['='])}{quote}{v}{quote}")
    inner = "".join(c if isinstance(c, str) else written(rng, c) for c in children)
    name_ = rng.choice([name, name.upper()])
    return f"<{name_}{''.join(pairs)}>" + ("" if name in ("br", "img", "hr") else f"{rng.choice(['', '<!-- </div> -->', '<script>if (a</b>/.test(x)) {}</script>'])}{inner}</{name}>")


def plain_fits(tree, part):
    if part.startswith("*"):
        part = part[1:]
    name, attributes, _ = tree
    for p in H._PART.finditer(part):
        if p["tag"] and p["tag"] != name or p["cls"] and p["cls"] not in attributes.get("class", "").split() or p["id"] and attributes.get("id") != p["id"]:
            return False
        if p["name"]:
            value = next((p[k] for k in "abc" if p[k] is not None), None)
            if p["name"] not in attributes or value is not None and attributes[p["name"]] != value:
                return False
    return True


def plain_all(tree, parts, above=()):
    """Elements in the order of their start tags whose ancestors fit the parts before the last, in order."""
    out = []

    def ancestors(parts, above):
        for a in reversed(range(len(above))):
            if parts and plain_fits(above[a], parts[-1]) and ancestors(parts[:-1], above[:a]):
                return True
        return not parts

    if plain_fits(tree, parts[-1]) and ancestors(parts[:-1], above):
        out.append(tree)
    for c in tree[2]:
        if not isinstance(c, str):
            out += plain_all(c, parts, (*above, tree))
    return out


def plain_texts(tree):
    out = []
    for c in tree[2]:
        out += [c] if isinstance(c, str) else plain_texts(c)
        if not isinstance(c, str):
            continue
    return out


def plain_text(tree, gap):
    runs, run = [], ""

    def walk(t):
        nonlocal run
        runs.append(run)
        run = ""
        for c in t[2]:
            if isinstance(c, str):
                run += c
            else:
                walk(c)
        runs.append(run)
        run = ""

    walk(tree)
    return gap.join(r.replace("&amp;", "&") for r in (x.strip() for x in runs) if r)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_pages(spark, seed):
    rng = random.Random(seed)
    trees = [("html", {}, [random_tree(rng) for _ in range(3)]) for _ in range(60)]
    df = spark.createDataFrame([(i, written(rng, t)) for i, t in enumerate(trees)], "i int, html string").repartition(4)
    tokens = df.select("i", "html", H.page_tokens("html").alias("t"))
    got = tokens.select(
        "i", F.array(*[H.select_first("html", s, "|") for s in SELECTORS]).alias("first"),
        F.array(*[F.size(H.start_tags(F.col("t"), s)) for s in SELECTORS if "," not in s]).alias("all"), H.select_attribute("html", "article [data-k], [data-k]", "data-k").alias("value"),
    ).collect()
    for r in got:
        tree = trees[r["i"]]
        for s, text in zip(SELECTORS, r["first"], strict=True):
            found = [e for one in s.split(", ") for e in plain_all(tree, one.split())[:1]]
            assert text == (plain_text(found[0], "|") if found else None), (s, tree)
        assert r["all"] == [len(plain_all(tree, s.split())) for s in SELECTORS if "," not in s]
        found = plain_all(tree, ["article", "[data-k]"]) or plain_all(tree, ["[data-k]"])
        assert r["value"] == (found[0][1]["data-k"] if found else None)


def first(spark, page, selector, gap="|"):
    return spark.createDataFrame([(page,)], "html string").select(H.select_first("html", selector, gap)).first()[0]


def test_end_tags_that_may_be_left_out(spark):
    page = "<div><p>one<p id=b>two <b>x</b><div>three</div><ul id=u><li>a<ul><li>b<li>c</ul>d<li id=e>e</ul></div><table><tr><td>1<td class=k>2<table><tr><td>in</table>3<tr><td>4</table>"
    asked = {"p": "one", "#b": "two|x", "ul": "a|b|c|d|e", "li": "a|b|c|d", "#e": "e", "li li": "b", "tr": "1|2|in|3", "td.k": "2|in|3", "td td": "in", "div": "one|two|x|three|a|b|c|d|e"}
    got = spark.createDataFrame([(page,)], "html string").select(*[H.select_first("html", s, "|") for s in asked]).first()
    assert dict(zip(asked, got, strict=True)) == asked


def test_pages_that_are_no_pages(spark):
    pages = [None, "", "no tags at all", "<", "<div", "<div>never closed", "</div>", "<div></p></span>x</div>y", "<div>" * 300 + "deep" + "</div>" * 300, "<div title=\"5\" tall\">q</div>", "<p " + "a=1 " * 2000 + ">t</p>"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r["i"]: r["t"] for r in df.select("i", H.select_first("html", "div, p").alias("t")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: None, 5: "never closed", 6: None, 7: "x", 8: "deep", 9: "q", 10: "t"}
    none = df.select(H.select_first("html", "").alias("a"), H.select_body("html", " , ").alias("b"), H.select_attribute("html", "img", "src").alias("c"), F.size(H.article_links("html", F.lit("http://x/"))).alias("n"))
    assert {tuple(r) for r in none.collect()} == {(None, "", None, 0)}
    with pytest.raises(ValueError):
        H.select_first("html", "div > p")


def test_title_body_date_and_links(spark):
    page = """<h1>Two <i>parts</i></h1><div class="body"><div>one two three four five</div> six seven eight <p>nine ten eleven</p></div><time datetime='2026-01-05T10:00:00Z'>yesterday</time>
      <article><a href='/one'>1</a><a title="x > href=no" HREF=two?a=1&amp;b=2#frag>2</a><a>none</a><a href="">empty</a><a href='/one'>again</a></article><a href="/three">3</a>"""
    from quern.sources.sheets import read_pages

    got = read_pages(spark.createDataFrame([("http://h/d/p", page)], "url string, html string"), "s", body="div.none, div.body").first()
    assert got["title"] == "Twoparts" and got["raw_text"].split() == "one two three four five six seven eight nine ten eleven".split() and str(got["published_at"]) == "2026-01-05 10:00:00"
    links = spark.createDataFrame([(page,)], "html string").select(H.article_links("html", F.lit("http://h/d/p"), needle="h"), H.article_links("html", F.lit("http://h/d/p"), needle="three")).first()
    assert links[0] == ["http://h/one", "http://h/d/two?a=1&b=2"] and links[1] == ["http://h/three"]
