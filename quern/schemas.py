"""Schemas of the sheets and records, in the order of their columns."""

from __future__ import annotations

import re

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    """A sheet at rest: every value is text."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_TEXT = T.StringType()
_KINDS = {
    "string": _TEXT, "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(_TEXT), "map<string,string>": T.MapType(_TEXT, _TEXT),
}


def record(fields: str) -> T.StructType:
    """A typed record of ``name kind`` pairs; needs no session, as parsing DDL would."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split(" ", 1) for f in re.split(r",\s+", fields))])


# Names, order and types of the columns that sheets and records have.

CORPUS = strings("PSA_ID", "Domain", "English", "Kiswahili", "Target Languages", "Source", "Date", "Metadata")
QUARANTINE = strings(*CORPUS.names, "Quarantine_Reason")
CLEANED = strings(
    "PSA_ID", "Domain", "English", "English_norm", "Kiswahili", "Kiswahili_norm", "Target Languages", "Source", "Date", "Metadata", "token_count", "char_count",
    "sentence_count", "lang_primary", "code_switch", "sw_cue_count", "has_kiswahili", "glossary_hits", "glossary_hit_count", "url_count", "hashtag_count",
    "mention_count", "split", "validation_subset",
)
VALIDATION = strings(*CLEANED.names, "reviewer", "is_valid_psa", "fluency_ok", "adequacy_ok", "cultural_ok", "review_notes", "verified")
AUDIT = strings(
    *CORPUS.names, "framework_label", "framework_confidence", "framework_reason", "action_hits", "press_hits", "other_hits", "token_count",
    "legacy_classifier_score", "legacy_gate_reason", "keep_strict_psa",
)
SEED_CANDIDATES = strings("psa_id", "Domain", "seed_text", "token_count", "Source", "Date", "full_token_count")
SENTENCES = strings("sentence_id", "psa_id", "Domain", "source_text", "token_count", "Source", "status")
PAIRS = strings("pair_id", "psa_id", "Domain", "source_lang", "target_lang", "source_text", "target_text", "method", "confidence", "verified", "auto_qc_pass", "Source", "Metadata", "split")
EXTERNAL_PAIRS = strings(*[n for n in PAIRS.names if n != "split"])
SEED_PAIRS = strings(*[n for n in EXTERNAL_PAIRS.names if n != "auto_qc_pass"])
ABLATION = strings("pair_id", "psa_id", "source_text", "reference_silver", "hypothesis_finetuned", "model_family", "pair", "note")
HUMAN_EVAL = strings(
    "eval_id", "psa_id", "Domain", "source_lang", "source_text", "synthetic_source", "target_lang_sw", "mt_suggestion_sw", "target_lang_kik", "mt_suggestion_kik",
    "fluency_sw", "adequacy_sw", "cultural_sw", "fluency_kik", "adequacy_kik", "cultural_kik", "preferred_sw_edit", "preferred_kik_edit", "reviewer_id", "notes",
)
EXPERIMENTS = strings("timestamp", "pair", "model_family", "model_name", "train_rows", "dev_rows", "epochs", "device", "output_dir", "notes")
DEMO_FEEDBACK = strings("timestamp", "source_text", "target_lang", "hypothesis", "model_family", "score", "comment")

EXPORT = strings("psa_id", "domain", "title", "text", "language", "source_url", "published_at", "urgency", "organization", "metadata")
EDUCATION = strings("PSA_ID", "Domain", "English", "Kiswahili", "Kikuyu", "Source", "Date", "Sub_Category", "Urgency", "Audience", "psa_score", "lang_detected")
AGRICULTURE = strings("PSA_ID", "Domain", "English", "Kiswahili", "Source", "Date", "Org", "Metadata", "Target_Languages")
MEDIA = strings("PSA_ID", "Domain", "English", "Kiswahili", "Target Languages", "Source", "Metadata")
RAW_TEXT = strings("cleaned_text", "raw_text", "source_url")

SCRAPE_CONFIG = record(
    "listing_url string, article_selector string, title_selector string, body_selector string, date_selector string, rate_limit_seconds double, "
    "requires_psa_filter boolean, link_href_contains string, link_min_slug_chars int, max_items int, max_listing_pages int, page_param string, fetch_full_article boolean"
)
SOURCE = record(
    "source_id string, name string, organization string, source_type string, base_url string, country string, domains_covered array<string>, primary_language string, "
    "trust_score int, priority string, adapter string, active boolean"
).add("scrape_config", SCRAPE_CONFIG)
RAW_ITEM = record("source_id string, source_url string, title string, raw_html string, raw_text string, published_at timestamp, scraped_at timestamp")
NOTICE = record(
    "psa_id string, title string, text string, language string, domain string, sub_category string, urgency string, audience array<string>, location map<string,string>, "
    "organization string, published_at timestamp, scraped_at timestamp, source_id string, source_url string, trust_score int, verified boolean, is_psa boolean, "
    "classification_confidence double, keywords array<string>, token_count int, content_hash string, metadata map<string,string>, status string"
)
TRANSLATION = record("psa_id string, target_language string, method string, source_text string, target_text string, confidence double, verified boolean, metadata map<string,string>, created_at timestamp")
RUN_LOG = record("source_id string, status string, items_found int, items_stored int, items_rejected int, error string")
SCRAPE_LOG = record("source_id string, started_at timestamp, finished_at timestamp, status string, items_found int, items_stored int, items_rejected int, error string")
PSA_PAIRS = record("en_psa_id string, sw_psa_id string, alignment_method string, alignment_score double, verified boolean, created_at timestamp")
FEEDBACK = record("translation_id string, verdict string, suggestion string, reviewer string, created_at timestamp")
