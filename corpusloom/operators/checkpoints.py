"""Cutting lineage so that the loss of an executor doesn't lose the result."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the folder all executors share (spark.checkpoint.dir) and reads it from there.

    Only where no such folder is configured and all runs in one process, as in tests, a temporary one is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-"))
    return df.checkpoint(eager=True)
