"""SRC-17, SRC-20: rule sets and work lists from configuration files, as the lexicons' literals.

A file is JSON, or YAML where its library is installed. It is read once by the
driver, through Spark, from whatever file system its path names.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.sheets import path_exists, source_defaults


def parse_rules(text: str) -> dict:
    """The mapping of a JSON or YAML text; an empty text is an empty mapping, any other value an error."""
    try:
        found = json.loads(text) if text.strip() else {}
    except json.JSONDecodeError as no_json:
        try:
            import yaml
        except ImportError:
            raise ValueError("not JSON, and no library for YAML is installed") from no_json
        found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise ValueError("a rule set is a mapping")
    return found


def load_rules(spark: SparkSession, path: str) -> dict:
    """SRC-17: the mapping of a file; a missing file is an empty one."""
    if not path_exists(spark, path):
        return {}
    return parse_rules(spark.read.text(path, wholetext=True).first()[0])


def domain_rules(config: dict) -> list[tuple[str, str, list[str]]]:
    """(domain, sub-category, keywords) in the file's order, as ``lexicons.DOMAINS``."""
    return [(d, s, [str(k) for k in sub.get("keywords") or []]) for d, data in (config.get("domains") or {}).items() for s, sub in (data.get("sub_categories") or {}).items()]


def glossary_rules(config: dict) -> list[tuple[str, list[str]]]:
    """(kept form, other forms) of each term, as ``lexicons.GLOSSARY``; the first of equal kept forms, whatever the case."""
    out: dict[str, tuple[str, list[str]]] = {}
    for entry in config.get("terms") or []:
        term = str(entry.get("term") or "").strip()
        keep = str(entry.get("keep_form") or "").strip() or term
        forms = [f for f in (term, *(str(a).strip() for a in entry.get("aliases") or [])) if f and f != keep]
        if keep:
            out.setdefault(keep.lower(), (keep, list(dict.fromkeys(forms))))
    return list(out.values())


def language_rules(config: dict) -> list[tuple[str, str, str, str]]:
    """(id, name, model code, role) of each language, as ``lexicons.LANGUAGES``."""
    return [(str(x["id"]), str(x.get("name") or ""), str(x.get("nllb") or ""), str(x.get("role") or "")) for x in config.get("languages") or []]


def seed_rules(config: dict) -> dict:
    """Targets and bounds of seeding, with the defaults of what the file leaves out."""
    return {"source_nllb": "eng_Latn", "target_ids": ["sw", "kik"], "max_source_tokens": 200, "min_source_tokens": 12} | (config.get("seed_defaults") or {})


def work_list(sources: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """SRC-20: the registry's rows to work through: those of ``ids`` with their ``place``, else all active ones by id.

    An id that the registry lacks gives a row without an adapter, which the
    ingest reports as failed.
    """
    known = source_defaults(sources)
    if ids is None:
        return known.where("active").withColumn("place", F.lit(None).cast("int")).orderBy("source_id")
    asked = sources.sparkSession.createDataFrame([(i, k + 1) for k, i in enumerate(dict.fromkeys(ids))], "source_id string, place int")
    return asked.join(known, "source_id", "left")
