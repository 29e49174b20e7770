"""Free-form JSON columns as maps of text.

Values stay as JSON holds them, text without its quotes; in overlays the later
key wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import _col, text_or_empty

_MAP = "map<string,string>"


def parse(c) -> Column:
    """JSN-01: a map; blank, malformed and non-object texts give an empty one."""
    found = F.from_json(F.when(F.json_object_keys(_col(c)).isNotNull(), _col(c)), _MAP)
    return F.coalesce(found, F.create_map().cast(_MAP))


def overlay(base: Column, *more: Column) -> Column:
    """JSN-02: later maps win, whatever the session's policy on equal keys."""
    out = base
    for later in more:
        out = F.map_concat(_keys_not_in(out, later), later)
    return out


def _keys_not_in(m: Column, later: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.map_contains_key(later, k))


def set_default(base: Column, defaults: Column) -> Column:
    """JSN-02: keys that are there already stay."""
    return overlay(defaults, base)


def prefixed(m: Column, prefix: str) -> Column:
    """JSN-03: every key with a prefix."""
    return F.transform_keys(m, lambda k, v: F.concat(F.lit(prefix), k))


def without(m: Column, *keys: str) -> Column:
    """JSN-04: without some keys."""
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def serialise(m: Column) -> Column:
    """JSN-05: JSON text, keys in order, other letters than ASCII as they are."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def field(c, name: str) -> Column:
    """JSN-06: one field as text."""
    return F.get_json_object(_col(c), f"$.{name}")


def literal_keys(c) -> Column:
    """JSN-07: keys of a dictionary written as a Python literal, none for anything else."""
    c = text_or_empty(c)
    return F.when(c.startswith("{"), F.regexp_extract_all(c, F.lit(r"['\"]([^'\"]+)['\"]\s*:"), F.lit(1))).otherwise(F.array().cast("array<string>"))
