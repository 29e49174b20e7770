"""From raw documents to token digests of a mixed training set, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe_index import encode
from quern.llm.mixing import mix_documents
from quern.llm.near_minhash import near_duplicate_classes
from quern.llm.pii_information import find_personal_data, sanitise
from quern.llm.quality_gam import keep_good
from quern.llm.queries import table, tokenizer_path
from quern.plans.stage_table import stage_table

#: Similarity of five-word shingles, in percent, from which documents are near duplicates here.
NEAR_PERCENT = 80
#: Ids up to which a table of them is broadcast (8 MB).
SMALL = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, judged where they are.

    A null or empty text is judged by figures of 0, repeated rows alike; without
    labels all stay.
    """
    return keep_good(docs.select(_columns(docs)), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    The ids of the others are broadcast up to ``SMALL`` of them, so that the
    documents stay in place; more are joined by a shuffle. A document whose id
    is null can't be told from another by its id and stays.
    """
    docs = docs.select(_columns(docs))
    gone = stage_table(near_duplicate_classes(docs, percent=NEAR_PERCENT).where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= SMALL else gone, "doc_id", "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the text.

    A null text stays null and an empty one empty; repeated rows are treated alike
    and stay, a null id stays null. Only the text and its count of characters
    change, and only where something was found. A very long text is one row's work.
    """
    names = _columns(docs)
    found = find_personal_data(docs.withColumn("had_text", F.col("text").isNotNull()), keep=(*[c for c in names if c != "text"], "had_text"))
    done = sanitise(found).withColumn("text", F.when(F.col("had_text"), F.col("text")))
    # A text that nothing was found in keeps its count of characters.
    changed = F.size("all") > 0
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in names else F.lit(None)).select(names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source fills its target: documents appear as many times as the mix takes them.

    Null, empty and blank texts are never taken; a null source is one of its own;
    repeated rows share their key and are taken alike.
    """
    return mix_documents(docs.select(_columns(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, as digests; a null text counts as empty, repeated rows stay, a null id stays null."""
    return encode(docs, tokenizer_path(), digests=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("tokens", tokens)]

#: Classifiers, sketches and merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, f"stage-{name}")
    return docs
