"""Ranks and running sums whose order spans all rows, without sorting them in one task.

Rows are range-partitioned by the order, summed per part, summed up over the parts (as many rows as there
are partitions), and finished within each part. The partitioning is written to the checkpoint folder, so that
a lost executor can't move its borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut

Order = list[Column]


def _parted(rows: DataFrame, group: list[str], order: Order) -> tuple[DataFrame, Order]:
    """Rows with their part and a tie-break by the whole row."""
    tied = rows.withColumn("__tie", F.xxhash64(*[F.col(c) for c in rows.columns]))
    keys = [*map(F.col, group), *order, F.col("__tie")]
    return cut(tied.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())), [*order, F.col("__tie")]


def running_sums(rows: DataFrame, group: list[str], order: Order, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name, the sum of its column over the group's rows up to and with this one.

    Equal orders are told apart by a hash of the whole row, so only equal rows can change places.
    """
    parts, full = _parted(rows.withColumns({f"__v_{n}": c for n, c in sums.items()}), group, order)
    at = parts.groupBy(*group, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
    up = Window.partitionBy(*group).orderBy("__part")
    before = at.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__part").alias("__p"), *[(F.sum(f"__s_{n}").over(up) - F.col(f"__s_{n}")).alias(f"__b_{n}") for n in sums])
    within = Window.partitionBy(*group, "__part").orderBy(*full).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(within) for n in sums})
    on = F.col("__part") == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    joined = local.join(before, on)
    return joined.select(*rows.columns, *[(F.col(f"__b_{n}") + F.col(f"__l_{n}")).alias(n) for n in sums])


def ranked(rows: DataFrame, group: list[str], order: Order, out: str = "rank") -> DataFrame:
    """``rows`` with their number from 1 within the group."""
    return running_sums(rows, group, order, {out: F.lit(1).cast("bigint")})
