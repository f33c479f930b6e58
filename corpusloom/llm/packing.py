"""Filling containers of fixed capacity with documents, by deficit round-robin over their sources.

Documents are spread over packing partitions by hash, so every partition holds its share of each
source. A source's deficit is its target share of the tokens packed so far less what it has had; targets are given, or
the sources' own shares. Windows (one container each) are filled from the source with the largest deficit, with the
largest of its documents that fits. A document after which nothing would fit any more is the window's last: it is the
best fit among the sources that aren't ahead by more than a ``QUANTUM`` of the capacity, or of all if none of those
fits. Deficits are carried from window to window. What partitions before this one leave
over is known from sums per partition and source, so partitions carry deficits without waiting for each other.

A document larger than the capacity alone is cut: full containers of its own, and a last piece that
is packed like a document. Defined results: a document without a token count counts its UTF-8 bytes
and one end mark; one without text or count is left out; a null source is a source; a source without a target has the
target zero and is packed when no other fits; a source that runs out leaves its deficit standing.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTITION_DOCS = 16384
QUANTUM = 16  # a source in credit isn't ahead by more than one in so many of the capacity
NONE = "\x1f"  # the name of the null source in targets


def token_count(text: str = "text", stored: str = "n_tokens") -> Column:
    return F.coalesce(F.col(stored), F.octet_length(text).cast("bigint") + 1)


def fill(sizes: np.ndarray, sources: np.ndarray, shares: np.ndarray, deficit: np.ndarray, capacity: int) -> tuple[np.ndarray, int, np.ndarray]:
    """The container of every item (sizes up to the capacity), their number, and its source's deficit after every item."""
    n_src, never = len(shares), np.iinfo(np.int64).max
    order = np.lexsort((np.arange(len(sizes)), sizes))
    queues: list[list[int]] = [[] for _ in range(n_src)]
    items: list[list[int]] = [[] for _ in range(n_src)]
    for i in order:
        queues[sources[i]].append(int(sizes[i]))
        items[sources[i]].append(int(i))
    smallest = np.array([q[0] if q else never for q in queues])
    deficit = deficit.astype(float).copy()
    home, after = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes))
    left, window = len(sizes), -1
    while left:
        window += 1
        free = capacity
        while True:
            open_ = smallest <= free
            if not open_.any():
                break
            credit = open_ & (deficit * QUANTUM > -capacity)
            turn = credit if credit.any() else open_
            s = int(np.argmax(np.where(turn, deficit, -np.inf)))
            k = bisect.bisect_right(queues[s], free) - 1
            if free - queues[s][k] < smallest.min():
                for c in np.flatnonzero(turn):
                    j = bisect.bisect_right(queues[c], free) - 1
                    if queues[c][j] > queues[s][k]:
                        s, k = int(c), j
            size, i = queues[s].pop(k), items[s].pop(k)
            free -= size
            left -= 1
            deficit += shares * size
            deficit[s] -= size
            home[i], after[i] = window, deficit[s]
            smallest[s] = queues[s][0] if queues[s] else never
    return home, window + 1, after


def pack(documents: DataFrame, specs: Mapping[str, int], key: str = "doc_id", source: str = "source", tokens: Column | None = None, partition_docs: int = PARTITION_DOCS, targets: Mapping[str, float] | None = None) -> DataFrame:
    """``container_kind``, ``container``, key, ``piece`` (from 0), ``pieces``, ``first_token``, ``n_tokens``, ``deficit``.

    ``targets``: shares by source (``NONE`` for the null one), scaled to one; without them the sources' own shares.
    ``deficit``: the tokens that the source is behind its target after the piece; null for full containers of one document.
    """
    kind = documents.schema[key].dataType.simpleString()
    docs = documents.select(F.col(key).alias("k"), F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name")).alias("s"), (token_count() if tokens is None else tokens).alias("t")).where("t IS NOT NULL")
    parts = max(1, -(-docs.count() // partition_docs))
    placed = docs.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"))
    sums = placed.groupBy("s", "part").agg(F.sum("t").alias("t"))
    by_part = sums.groupBy("part").agg(F.sum("t").alias("all"))
    by_source = sums.groupBy("s").agg(F.sum("t").alias("had"))
    total = by_part.agg(F.sum("all").alias("total"))
    running = by_part.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("all_before"))  # one row per packing partition
    share = F.col("had") / F.greatest(F.col("total"), F.lit(1))
    if targets is not None:
        whole = sum(targets.values())
        of = documents.sparkSession.createDataFrame([(None if n == NONE else n, v / whole) for n, v in targets.items()], "name string, target double")
        aim = F.struct(F.col("name").isNull().alias("none"), F.coalesce("name", F.lit("")).alias("name"))
        by_source = by_source.join(F.broadcast(of.select(aim.alias("s"), "target")), "s", "left")
        share = F.coalesce("target", F.lit(0.0))
    carried = (
        sums.withColumn("before", F.sum("t").over(Window.partitionBy("s").orderBy("part")) - F.col("t"))
        .join(by_source, "s").join(F.broadcast(running), "part").join(F.broadcast(total), how="cross")
        .select("s", "part", share.alias("share"), (share * F.col("all_before") - F.col("before")).alias("deficit"))
    )
    ready = placed.join(carried, ["s", "part"]).select("k", F.concat_ws("|", F.col("s.none").cast("string"), "s.name").alias("s"), "t", "part", "share", "deficit")
    kinds = F.array(*[F.struct(F.lit(n).alias("container_kind"), F.lit(int(c)).cast("bigint").alias("capacity")) for n, c in sorted(specs.items())])
    work = ready.withColumn("spec", F.explode(kinds)).select("*", "spec.*").drop("spec")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable").reset_index(drop=True)
        capacity, kind_, part = int(pdf["capacity"][0]), pdf["container_kind"][0], int(pdf["part"][0])
        t = pdf["t"].to_numpy(np.int64)
        names, src = np.unique(pdf["s"].to_numpy(str), return_inverse=True)
        first = pdf.groupby("s", sort=True).first()
        full = np.where(t > capacity, t // capacity, 0)
        rest = t - full * capacity
        alone = rest > 0
        alone |= full == 0
        home, windows, after = fill(rest[alone], src[alone], first["share"].to_numpy(float), first["deficit"].to_numpy(float), capacity)
        pieces = full + alone
        at = np.repeat(np.arange(len(t)), full)
        number = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
        whole = pd.DataFrame({"row": at, "piece": number, "container": windows + np.arange(len(at)), "n_tokens": np.full(len(at), capacity), "deficit": np.full(len(at), np.nan)})
        last = pd.DataFrame({"row": np.flatnonzero(alone), "piece": full[alone], "container": home, "n_tokens": rest[alone], "deficit": after})
        out = pd.concat([whole, last], ignore_index=True)
        out["container_kind"], out["k"], out["pieces"] = kind_, pdf["k"].to_numpy()[out["row"]], pieces[out["row"]]
        out["first_token"] = out["piece"] * capacity
        out["container"] += part << 32
        return out[["container_kind", "container", "k", "piece", "pieces", "first_token", "n_tokens", "deficit"]]

    packed = work.groupBy("container_kind", "part").applyInPandas(one, f"container_kind string, container bigint, k {kind}, piece bigint, pieces bigint, first_token bigint, n_tokens bigint, deficit double")
    return packed.withColumn("deficit", F.nanvl("deficit", F.lit(None).cast("double"))).withColumnRenamed("k", key)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    specs = {r["container_kind"]: r["capacity_tokens"] for r in spark.read.parquet(f"{d}/pack_specs.parquet").collect()}  # a fixed table of three rows
    return pack(spark.read.parquet(f"{d}/documents.parquet"), specs)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lie in more than one container."""
    return _packed(spark, d).groupBy("container_kind", "doc_id").agg(F.count("container").alias("n")).where("n > 1").select("container_kind", "doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document or piece with its container."""
    return _packed(spark, d).drop("deficit")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: containers, tokens, the share of the capacity that is used, and how far sources are off their target shares, in capacities."""
    packed = _packed(spark, d)
    specs = spark.read.parquet(f"{d}/pack_specs.parquet")
    used = packed.groupBy("container_kind", "container").agg(F.sum("n_tokens").alias("t"), F.sum(F.abs("deficit")).alias("off"), F.count("deficit").alias("m"))
    whole = used.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("n_tokens"), (F.sum("off") / F.sum("m")).alias("off"))
    capacity = F.col("capacity_tokens")
    return whole.join(F.broadcast(specs), "container_kind").select(
        "container_kind", "containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("containers") * capacity), 4).alias("used_share"), F.round(F.col("off") / capacity, 4).alias("mean_deviation")
    )


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers, per kind: documents, tokens, documents in several containers, containers over the capacity and pieces out of order."""
    packed, specs = _packed(spark, d), spark.read.parquet(f"{d}/pack_specs.parquet")
    each = packed.groupBy("container_kind", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max("first_token").alias("last"), F.max("piece").alias("p"), F.min("pieces").alias("of"))
    wrong = F.count_if((F.col("n") != F.col("of")) | (F.col("p") + 1 != F.col("of")) | (F.col("last") >= F.greatest("t", F.lit(1))))
    documents = each.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("t").alias("n_tokens"), F.count_if(F.col("n") > 1).alias("cut_docs"), wrong.alias("misplaced"))
    full = packed.groupBy("container_kind", "container").agg(F.sum("n_tokens").alias("t")).join(F.broadcast(specs), "container_kind")
    return documents.join(full.groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("over_full")), "container_kind")
