"""The few functions that Spark has no expression for, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions.text import text_or_empty


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(c) -> Column:
    """TXT-04: compatibility composition; ASCII texts pass through."""
    return _nfkc(text_or_empty(c))


def with_nfkc(df: DataFrame, column: str) -> DataFrame:
    """TXT-04 where most texts are ASCII: only the others go to Python, in one branch of a union."""
    other = F.coalesce(F.col(column), F.lit("")).rlike(r"[^\x00-\x7F]")
    return df.where(~other).withColumn(column, text_or_empty(column)).unionByName(df.where(other).withColumn(column, nfkc(column)))


def translate(df: DataFrame, source: str, language: str, out: str, load: Callable[[], Callable[[list[str], str], list[str]]], languages: tuple[str, ...] = ("sw", "kik")) -> DataFrame:
    """UDF-04/05/06: ``out`` by a model that ``load`` returns, once for each task.

    ``load`` gives a function of texts and a target language. A language that
    isn't among ``languages`` is an error before any model is loaded.
    """
    wrong = ~F.coalesce(F.col(language).isin(*languages), F.lit(False))
    checked = df.withColumn(language, F.when(wrong, F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(F.col(language), F.lit("null"))))).otherwise(F.col(language)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            if len(pdf):
                model = model or load()
                parts = [pd.Series(model(g[source].fillna("").tolist(), lang), index=g.index) for lang, g in pdf.groupby(language, sort=False)]
                pdf = pdf.assign(**{out: pd.concat(parts)})
            else:
                pdf = pdf.assign(**{out: pd.Series([], dtype=str)})
            yield pdf

    return checked.mapInPandas(run, f"{df.drop(out)._jdf.schema().toDDL()}, {out} string")
