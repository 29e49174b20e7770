"""Pages: text, links and selectors without a browser.

A page is cut once into an array of its tags and texts. A selector is then one
fold over that array, which keeps the elements open that the selector's parts
have found so far, each with the number of elements of its own name open within
it, so that an element ends at its own closing tag. Nothing but the page itself
is needed, so pages of any number are read where they lie.

A selector is a list of parts between white space, each within the one before:
a tag name or ``*``, followed by any of ``.class``, ``#id``, ``[name]`` and
``[name=value]``. Several selectors are separated by commas. Elements whose end
tag may be left out end as the standard has it, elements without content at
once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.lexicon_match import literal
from quern.functions.text import WS, let, strip, text_or_empty, word_count

_DROPPED = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>"
_ENTITIES = (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&eacute;", "é"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def unescape(c) -> Column:
    """The entities that pages commonly hold; ``&amp;`` last, so that nothing is unescaped twice."""
    c = text_or_empty(c)
    for name, char in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_to_text(c) -> Column:
    """TXT-02: text nodes without scripts, styles and comments, one stripped node a line."""
    bare = F.regexp_replace(F.regexp_replace(text_or_empty(c), _DROPPED, ""), r"(?s)<[^>]*>", "\n")
    lines = F.filter(F.transform(F.split(bare, "\n+"), strip), lambda x: x != "")
    return unescape(F.array_join(lines, "\n"))


# Fixed values of the standard: elements without content, and what ends those whose end tag may be left out.
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
)
#: Element -> start tags that end it, end tags that end it, elements within which neither counts.
_OPTIONAL_ENDS = {
    "p": (_BLOCKS, tuple(b for b in _BLOCKS if b != "p"), ()), "li": (("li",), ("ul", "ol", "menu"), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",), ("dl",)), "dd": (("dt", "dd"), ("dl",), ("dl",)),
    "option": (("option", "optgroup"), ("select",), ("select",)), "tr": (("tr", "tbody", "thead", "tfoot"), ("table", "tbody", "thead", "tfoot"), ("table",)),
    "td": (("td", "th", "tr", "tbody"), ("tr", "table", "tbody", "thead", "tfoot"), ("table",)), "th": (("td", "th", "tr", "tbody"), ("tr", "table", "tbody", "thead", "tfoot"), ("table",)),
}

#: A tag, whose values in quotes may hold any mark, or a run of text, in which a mark that begins no tag is text.
_TOKEN = r"""</?[A-Za-z](?:[^"'=>]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+>|(?:[^<]++|<(?![/A-Za-z!?]))(?:<(?![/A-Za-z!?])[^<]*+)*+"""
_TEXT, _START, _END, _EMPTY = 0, 1, 2, 3


def page_tokens(c) -> Column:
    """Tags and texts of a page in order, ``(at, raw, name, kind)``; comments, scripts, styles and the document type are left out.

    It is the costly part of a selection, so several of them are best made of one column of tokens.
    """
    bare = F.regexp_replace(text_or_empty(c), _DROPPED, "")

    def token(raw: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(raw, r"^</?([A-Za-z][^\s/>]*)", 1))
        kind = F.when(~raw.rlike("^</?[A-Za-z]"), _TEXT).when(raw.startswith("</"), _END).when(name.isin(*_VOID) | raw.endswith("/>"), _EMPTY).otherwise(_START)
        return F.struct((i + 1).alias("at"), raw.alias("raw"), name.alias("name"), kind.alias("kind"))

    return F.transform(F.regexp_extract_all(bare, F.lit(_TOKEN), F.lit(0)), token)


def _to_attribute(name: str) -> str:
    """A pattern from a start tag's beginning to an attribute's name, which skips other attributes with their values."""
    n = f"(?i:{literal(name)})"
    return rf"""(?s)^<[A-Za-z][^\s/>]*+(?:[\s/]++(?!{n}[\s=/>])[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+[\s/]++{n}(?=[\s=/>])"""


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, in either quotes or none, unescaped; empty without a value, null without the attribute."""
    value = F.regexp_extract(tag, _to_attribute(name) + r"""\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", 1)
    return F.when(tag.rlike(_to_attribute(name)), unescape(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")))


_PART = re.compile(r"""(?P<tag>^(?:\*|[A-Za-z][\w-]*))|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]*))\s*)?\]""")


def _part(part: str) -> Callable[[Column], Column]:
    """Whether a start tag fits one part of a selector."""
    at, tests = 0, []
    while at < len(part):
        m = _PART.match(part, at)
        if not m:
            raise ValueError(f"not a selector: {part}")
        at = m.end()
        if m["tag"] and m["tag"] != "*":
            tests.append(lambda t, x=m["tag"].lower(): t["name"] == x)
        elif m["cls"]:
            x = literal(m["cls"])
            pattern = _to_attribute("class") + rf"""\s*+=\s*+(?:"(?:[^"]*\s)?{x}(?:\s[^"]*)?"|'(?:[^']*\s)?{x}(?:\s[^']*)?'|{x}(?=[\s>/]))"""
            tests.append(lambda t, p=pattern: t["raw"].rlike(p))
        elif m["id"] or m["name"]:
            name = "id" if m["id"] else m["name"]
            value = m["id"] or next((m[k] for k in "abc" if m[k] is not None), None)
            tests.append(lambda t, n=name, v=value: t["raw"].rlike(_to_attribute(n)) if v is None else F.coalesce(attribute(t["raw"], n) == v, F.lit(False)))

    def fits(t: Column) -> Column:
        out = F.lit(True)
        for test in tests:
            out = out & test(t)
        return out

    return fits


def _steps(selector: str) -> list[Callable[[Column], Column]]:
    return [_part(p) for p in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector)]


_OPEN = "array<struct<name:string,n:int,inner:int>>"


def _next_open(open_: Column, t: Column) -> Column:
    """The open elements after a tag: what it ends is cut off, counts of the others are brought up to date."""
    pairs = lambda k: [f"{e} {x}" for e, ends in _OPTIONAL_ENDS.items() for x in ends[k]]
    start = t["kind"] == _START

    def moved(o: Column) -> Column:
        key = F.concat(o["name"], F.lit(" "), t["name"])
        optional = o["name"].isin(*_OPTIONAL_ENDS)
        within = F.when(optional & key.isin(*pairs(2)), F.when(start, o["inner"] + 1).otherwise(F.greatest(o["inner"] - 1, F.lit(-1)))).otherwise(o["inner"])
        ends = optional & (o["inner"] == 0) & F.when(start | (t["kind"] == _EMPTY), key.isin(*pairs(0))).otherwise(key.isin(*pairs(1)))
        n = F.when(t["name"] != o["name"], o["n"]).when(start, o["n"] + 1).when(t["kind"] == _END, o["n"] - 1).otherwise(o["n"])
        n = F.when(ends, 0).when((within == 0) & (o["inner"] > 0), 1).otherwise(n)  # what an inner list or table left open has ended with it
        return F.struct(o["name"].alias("name"), n.cast("int").alias("n"), F.greatest(within, F.lit(0)).cast("int").alias("inner"))

    def cut(now: Column) -> Column:
        ended = F.array_position(F.transform(now, lambda o: o["n"] <= 0), True)
        return F.when(ended > 0, F.slice(now, F.lit(1), (ended - 1).cast("int"))).otherwise(now)

    return let(F.transform(open_, moved), cut)


def _walk(tokens: Column, selector: str, all_: bool) -> Column:
    """A fold over tokens: where the first element that fits begins and ends, or the places of all of them.

    Ancestors are held as far out as they fit, which finds all descendants.
    """
    steps = _steps(selector)
    last = len(steps) - 1

    def begins(open_: Column, t: Column) -> Column:
        """Whether a start tag fits the next part; an ancestor has content."""
        out = F.lit(False)
        for k, fits in enumerate(steps[: last + 1]):
            ok = fits(t) if k == last else (t["kind"] == _START) & fits(t)
            out = F.when(F.size(open_) == k, ok).otherwise(out)
        return out

    def seen(s: Column, t: Column) -> Column:
        def with_open(open_: Column) -> Column:
            started = t["kind"].isin(_START, _EMPTY) & begins(open_, t)

            def with_start(hit: Column) -> Column:
                is_last = F.size(open_) == last
                found = hit & is_last
                grown = F.when(hit & (t["kind"] == _START) & ~(is_last & F.lit(all_)), F.concat(open_, F.array(F.struct(t["name"].alias("name"), F.lit(1).alias("n"), F.lit(0).alias("inner"))))).otherwise(open_)
                if all_:
                    places = F.when(found, F.concat(s["places"], F.array(t["at"]))).otherwise(s["places"])
                    return F.struct(grown.cast(_OPEN).alias("open"), places.alias("places"))
                begin = F.when(s["begin"].isNull() & found, t["at"]).otherwise(s["begin"])
                end = F.when(found & (t["kind"] == _EMPTY), t["at"]).when(s["begin"].isNotNull() & (F.size(open_) <= last), t["at"] - 1).otherwise(s["end"])
                return F.struct(grown.cast(_OPEN).alias("open"), begin.alias("begin"), end.alias("end"))

            return let(started, with_start)

        return let(_next_open(s["open"], t), with_open)

    none, tags = F.array().cast(_OPEN), F.filter(tokens, lambda t: t["kind"] != _TEXT)

    def step(s: Column, t: Column) -> Column:
        # A tag that changes nothing, with nothing open that it could end, is passed over.
        idle = (F.size(s["open"]) == 0) & ~(t["kind"].isin(_START, _EMPTY) & (steps[0](t)))
        return F.when(idle if all_ else s["end"].isNotNull() | (s["begin"].isNull() & idle), s).otherwise(seen(s, t))

    if all_:
        return F.aggregate(tags, F.struct(none.alias("open"), F.array().cast("array<int>").alias("places")), step)["places"]
    return F.aggregate(tags, F.struct(none.alias("open"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end")), step)


def element(tokens: Column, selector: str) -> Column:
    """The tokens of the first element that fits, its start tag first; null without one. One that never ends has the rest of the page."""
    span = lambda s: F.when(s["begin"].isNotNull(), F.slice(tokens, s["begin"], F.coalesce(s["end"], F.size(tokens)) - s["begin"] + 1))
    return let(_walk(tokens, selector, False), span)


def start_tags(tokens: Column, selector: str) -> Column:
    """Start tags of all elements that fit, as they stand in the page."""
    return F.transform(_walk(tokens, selector, True), lambda at: F.element_at(tokens, at)["raw"])


def tokens_text(tokens: Column, separator: str = "\n") -> Column:
    """Texts of an element's tokens, each without white space around it, the empty ones left out."""
    texts = F.transform(F.filter(tokens, lambda t: t["kind"] == _TEXT), lambda t: strip(unescape(t["raw"])))
    return F.array_join(F.filter(texts, lambda x: x != ""), separator)


def _selectors(selectors: str) -> list[str]:
    return [p.strip() for p in (selectors or "").split(",") if p.strip()]


def _first_element(tokens: Column, selectors: str) -> Column:
    found = [element(tokens, s) for s in _selectors(selectors)]
    return F.coalesce(*found) if found else F.lit(None).cast("array<struct<at:int,raw:string,name:string,kind:int>>")


def first_text(tokens: Column, selectors: str, separator: str = "") -> Column:
    """SRC-02: text of the first selector in the list that is on the page; texts within it are joined without a gap."""
    return let(_first_element(tokens, selectors), lambda e: F.when(e.isNotNull(), tokens_text(e, separator)))


def first_attribute(tokens: Column, selectors: str, name: str) -> Column:
    """SRC-02: an attribute of the first selector in the list that is on the page; null where that element lacks it."""
    return let(_first_element(tokens, selectors), lambda e: attribute(F.get(e, F.lit(0))["raw"], name))


def body_text(tokens: Column, selectors: str, least: int = 10) -> Column:
    """SRC-03: the first selected text of ``least`` words, else the longest, the earlier on a tie."""

    def chosen(texts: Column) -> Column:
        first = F.get(F.filter(texts, lambda t: word_count(t) >= least), F.lit(0))
        longest = F.array_max(F.transform(texts, lambda t, i: F.struct(word_count(t).alias("n"), (-i).alias("o"), t.alias("t"))))["t"]
        return F.coalesce(first, longest, F.lit(""))

    found = [let(element(tokens, s), lambda e: F.when(e.isNotNull(), tokens_text(e))) for s in _selectors(selectors)]
    return let(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), chosen)


def select_first(c, selectors: str, separator: str = "") -> Column:
    """:func:`first_text` of a page's markup."""
    return let(page_tokens(c), lambda tokens: first_text(tokens, selectors, separator))


def select_attribute(c, selectors: str, name: str) -> Column:
    """:func:`first_attribute` of a page's markup."""
    return let(page_tokens(c), lambda tokens: first_attribute(tokens, selectors, name))


def select_body(c, selectors: str, least: int = 10) -> Column:
    """:func:`body_text` of a page's markup."""
    return let(page_tokens(c), lambda tokens: body_text(tokens, selectors, least))


def resolve_link(base, href) -> Column:
    """A link's address as seen from a page, without its fragment."""
    href = F.regexp_replace(text_or_empty(href), "#.*$", "")
    base = F.regexp_replace(text_or_empty(base), r"[?#].*$", "")
    site = F.regexp_extract(base, r"^[^:/]+://[^/]*", 0)
    folder = F.regexp_replace(base, r"(?<=[^:/])/[^/]*$", "/")
    folder = F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.substring_index(site, ":", 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href == "", base)
        .otherwise(F.concat(folder, href))
    )


def article_links(c, base, needle: str = "", least_slug: int = 0, article: str = "article") -> Column:
    """SRC-04: distinct links within the articles, a selector; of the whole page, where these have none.

    Links must contain ``needle`` in any case and end on a segment of at least
    ``least_slug`` characters. Without a needle the fallback takes links that
    look like news.
    """

    def kept(found: Column) -> Column:
        full = F.transform(found, lambda h: resolve_link(base, h))
        slug = lambda u: F.substring_index(F.regexp_replace(u, "/+$", ""), "/", -1)
        full = F.filter(full, lambda u: F.lower(u).contains(needle.lower()) & (F.length(slug(u)) >= least_slug))
        return F.array_distinct(full)

    def links(tags: Column) -> Column:
        return F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda h: F.coalesce(h != "", F.lit(False)))

    def of_page(tokens: Column) -> Column:
        whole = F.transform(F.filter(tokens, lambda t: (t["name"] == "a") & t["kind"].isin(_START, _EMPTY)), lambda t: t["raw"])
        rest = links(whole) if needle else F.filter(links(whole), lambda h: h.rlike("(?i)(news|press|announce|alert|notice)"))
        return let(kept(links(start_tags(tokens, f"{article} a[href]"))), lambda own: F.when(F.size(own) > 0, own).otherwise(kept(rest)))

    return let(page_tokens(c), of_page)


def title_or_default(title) -> Column:
    """SRC-01: ``Untitled`` for a page without a title."""
    t = F.regexp_replace(strip(title), f"[{WS}]+", " ")
    return F.when(t != "", t).otherwise("Untitled")
