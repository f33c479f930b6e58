"""Vocabulary and sparse TF-IDF features of a corpus.

Defined results: null texts have no terms; a text without words, or none of the vocabulary, has no
features; an empty corpus has an empty vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_terms, quantize, run_lengths, tokens


@dataclass(frozen=True)
class Vectorizer:
    """Sizes of the n-grams and of the vocabulary. The latter is bounded, so it is broadcast."""

    word: tuple[int, int] = (1, 2)
    char: tuple[int, int] = (3, 5)
    max_features: int = 512
    min_df: int = 1

    def __post_init__(self) -> None:
        for what, (low, high), least, most in (("word", self.word, 1, 3), ("char", self.char, 2, 6)):
            if not least <= low <= high <= most:
                raise ValueError(f"{what} n-grams must lie within {least}..{most}")
        if not 32 <= self.max_features <= 100_000 or not 1 <= self.min_df <= 1_000_000:
            raise ValueError("max_features must be 32..100000 and min_df 1..1000000")


def term_counts(rows: DataFrame, key: str, text: str = "text", profile: str = "v1", vectorizer: Vectorizer = Vectorizer()) -> DataFrame:
    """key, ``term``, ``n``: counted within each row."""
    counted = rows.select(key, F.explode(run_lengths(extract_terms(tokens(text, profile), vectorizer.word, vectorizer.char))).alias("e"))
    return counted.select(key, F.col("e.item").alias("term"), "e.n")


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(frequency: DataFrame, n_docs: DataFrame, vectorizer: Vectorizer = Vectorizer()) -> DataFrame:
    """``position``, ``term``, ``df``, ``idf`` of the most frequent terms, ties by code point. ``n_docs``: one row (n_docs)."""
    top = frequency.where(F.col("df") >= vectorizer.min_df).orderBy(F.desc("df"), "term").limit(vectorizer.max_features)
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1)  # of at most max_features rows
    idf = quantize(F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    return placed.join(F.broadcast(n_docs), how="cross").select("position", "term", "df", idf.alias("idf"))


def fit(rows: DataFrame, key: str, text: str = "text", profile: str = "v1", vectorizer: Vectorizer = Vectorizer()) -> DataFrame:
    return vocabulary(document_frequency(term_counts(rows, key, text, profile, vectorizer)), rows.agg(F.count(F.lit(1)).alias("n_docs")), vectorizer)


def weights(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """key, ``position``, ``value`` = (1 + ln n) * idf; terms outside the vocabulary are dropped."""
    met = counts.join(F.broadcast(vocab.select("position", "term", "idf")), "term")
    return met.select(key, "position", ((F.lit(1.0) + F.log("n")) * F.col("idf")).alias("value"))


def sparse_batch(lists: pa.ListArray, vocabulary: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions and values of a batch of term lists, by row and position; each row of Euclidean length one."""
    n = len(lists)
    rec = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    found = pc.index_in(lists.flatten(), value_set=vocabulary)
    at = pc.is_valid(found).to_numpy(zero_copy_only=False)
    position = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)[at]
    width = max(1, len(idf))
    code, count = np.unique(rec[at] * width + position, return_counts=True)
    rec, position = code // width, code % width
    if not len(code):
        return rec, position, np.zeros(0)
    logs = np.array([1.0 + math.log(c) for c in range(1, int(count.max()) + 1)])
    value = logs[count - 1] * idf[position]
    # bincount adds in order, so a row's squares are summed by position.
    return rec, position, value / np.sqrt(np.bincount(rec, weights=value * value, minlength=n))[rec]


def transform(rows: DataFrame, vocab: DataFrame, key: str, text: str = "text", profile: str = "v1", vectorizer: Vectorizer = Vectorizer()) -> DataFrame:
    """key, ``features``: array of (position, value) by position, of Euclidean length one; empty without known terms.

    Map-only: terms are made in the JVM and looked up in Arrow batches against the vocabulary, whose size is
    bounded by ``max_features``. Rows without text are left out.
    """
    terms = vocab.orderBy("position").select("term", "idf").collect()
    held = rows.sparkSession.sparkContext.broadcast(([t["term"] for t in terms], [t["idf"] for t in terms]))
    kind = rows.schema[key].dataType.simpleString()
    prepared = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), extract_terms(tokens(text, profile), vectorizer.word, vectorizer.char).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = held.value
        vocabulary, idf = pa.array(names, pa.string()), np.array(idf, float)
        for batch in batches:
            rec, position, value = sparse_batch(batch.column("terms"), vocabulary, idf)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rec, minlength=batch.num_rows))])
            pairs = pa.StructArray.from_arrays([pa.array(position, pa.int32()), pa.array(value, pa.float64())], ["position", "value"])
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["k", "features"])

    return prepared.mapInArrow(run, f"k {kind}, features array<struct<position:int,value:double>>").withColumnRenamed("k", key)
