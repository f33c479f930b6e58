"""How often every word and n-gram occurs, and in how many records.

Defined results: null texts are left out; texts without words count as records but hold nothing;
repeated rows each count (their keys must differ); an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.layout import spread
from .suffixes import ngrams

COMMON_SHARE = 0.05


def ngram_counts(rows: DataFrame, record: str, text: str = "text", profile: str = "v1", lone: int = 0, longest: int | None = None) -> DataFrame:
    """``n``, ``ngram``, ``occurrences``, ``records`` of the n-grams of every length in two records or more.

    Those of one record alone are given up to ``lone`` words: all of them would be the square of a text's length.
    """
    return ngrams(rows.where(F.col(text).isNotNull()), record, tokens(text, profile), lone, longest)


def marked_words(rows: DataFrame, record: str, text: str = "text", profile: str = "v1", common_share: float = COMMON_SHARE) -> DataFrame:
    """``term``, ``occurrences``, ``records``, ``mark``: ``rare`` in exactly one record, ``common`` in more than ``common_share`` of those with text."""
    total = rows.where(F.col(text).isNotNull()).count()
    mark = F.when(F.col("records") == 1, F.lit("rare")).when(F.col("records") > F.lit(total) * F.lit(common_share), F.lit("common"))
    return ngram_counts(rows, record, text, profile, 1, 1).select(F.col("ngram").alias("term"), "occurrences", "records", mark.alias("mark"))


def _intents(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/intents_v1.parquet").select("row_no", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_counts(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words with their counts and mark."""
    return marked_words(_intents(spark, d), "row_no")


def p2_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Word n-grams of every length found in at least two prompts."""
    return ngram_counts(_intents(spark, d), "row_no")
