"""Spreading small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A freshly read table in at least as many partitions as there are cores.

    A single small file is one partition however much work its rows make. Large tables have more
    partitions than cores and come back unchanged. Only for plain scans, whose partitions are known
    without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
