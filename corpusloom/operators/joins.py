"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_join(rows: DataFrame, stats: DataFrame, key: str, heavy: Column, spread: Column) -> DataFrame:
    """Inner join of many rows with one row of statistics per key; ``rows`` is read once.

    ``heavy`` picks the keys of ``stats`` that hold more than a fixed share of all rows: at most the
    inverse of that share, so they are broadcast. The other keys are shuffled, each holding less than
    that share. Rows already matched are shuffled by ``spread`` instead of their key, so that no
    partition gathers them. Null keys match nothing.
    """
    carried = [c for c in stats.columns if c != key]
    flagged = stats.withColumn("__heavy", F.coalesce(heavy, F.lit(False)))
    top = flagged.where("__heavy").select(key, *[F.col(c).alias(f"__h_{c}") for c in carried], "__heavy")
    rest = flagged.where(~F.col("__heavy")).select(F.col(key).alias("__v"), F.lit(0).cast("bigint").alias("__s2"), *[F.col(c).alias(f"__l_{c}") for c in carried], F.lit(True).alias("__light"))
    first = rows.join(F.broadcast(top), key, "left")
    # Light rows: (key, 0). Heavy ones: (key, 1 + spread), which nothing on the other side equals.
    first = first.withColumn("__s", F.when(F.col("__heavy"), F.lit(1).cast("bigint") + F.pmod(F.xxhash64(spread), F.lit(1 << 40))).otherwise(F.lit(0).cast("bigint")))
    joined = first.join(rest, (F.col(key) == F.col("__v")) & (F.col("__s") == F.col("__s2")), "left").where(F.col("__heavy") | F.col("__light"))
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__l_{c}")).alias(c) for c in carried])
