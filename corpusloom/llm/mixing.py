"""Mixing sources to target shares of the tokens, by balanced (cube) sampling.

A source that must give ``r`` times its tokens (as often as it may at most) gives every document ``floor(r)`` times and a balanced
sample of them once more, each with probability ``r - floor(r)``. The flight phase of the cube
method moves these probabilities along the null space of two constraints, the source's tokens and its
number of documents, three documents at a time, until at most two in a block are undecided; blocks'
rests are flown again together until one block is left. The landing decides the last two or fewer
so that the tokens come closest.

Defined results: a source that can't reach its share gives all it may; a listed source without
documents gives nothing and is short if its share is above zero; documents of other or no source take
no part; missing token counts are UTF-8 bytes and one end mark, documents without text and count
are left out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.checkpoints import cut
from .packing import token_count

BLOCK_DOCS = 16384
EPS = 1e-9


def flight(p: np.ndarray, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after the flight: sums of ``p`` and ``p * x`` are kept, at most two stay undecided."""
    p = p.astype(float).copy()
    live = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    hand = live[:3]
    coming = iter(live[3:])
    turn = 0
    while len(hand) == 3:
        a, b, c = hand
        xa, xb, xc = x[a], x[b], x[c]
        u = (xb - xc, xc - xa, xa - xb)
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(hand, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(hand, u) if v)
        step = up if draws[turn % len(draws)] * (up + down) < down else -down
        turn += 1
        for i, v in zip(hand, u):
            q = p[i] + step * v
            p[i] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q
        hand = [i for i in hand if 0.0 < p[i] < 1.0]
        while len(hand) < 3:
            i = next(coming, None)
            if i is None:
                break
            hand.append(i)
    return p


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Decides the undecided (two at most) so that the sum of ``x`` is closest to what the probabilities promise."""
    open_ = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    goal = sum(p[i] * x[i] for i in open_)
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda take: (abs(sum(t * x[i] for t, i in zip(take, open_)) - goal), take))
    out = np.round(p)
    for i, t in zip(open_, best):
        out[i] = t
    return out


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """(copies: key, source, ``n_tokens``, ``copies`` >= 0; report per listed source).

    The total to share out is the tokens of all documents of listed sources, each counted once.
    ``targets`` (source, target_share, max_repeats) has a row per source and is small by its nature.
    """
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()}
    listed = documents.select(F.col(key).alias("k"), F.col(source).alias("source"), token_count().alias("t")).where(F.col("source").isin(list(goals)) & F.col("t").isNotNull())
    had = {r["source"]: (r["t"], r["n"]) for r in listed.groupBy("source").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    total = sum(t for t, _ in had.values())
    plan = []
    for name, (share, most) in sorted(goals.items()):
        tokens, n = had.get(name, (0, 0))
        ratio = min(float(most), share * total / tokens) if tokens else 0.0
        base = min(int(ratio + EPS), most)
        plan.append((name, share, most, tokens, n, base, 0.0 if base >= most else max(0.0, ratio - base), max(1, -(-n // block_docs))))
    spark = documents.sparkSession
    table = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, tokens bigint, n_docs bigint, base int, rest double, blocks bigint")

    start = listed.join(F.broadcast(table.select("source", "base", "rest", "blocks")), "source").select("k", "source", "t", "base", F.col("rest").alias("p"), F.xxhash64("k").alias("h"), "blocks")
    schema = f"k {documents.schema[key].dataType.simpleString()}, source string, t bigint, base int, p double, h bigint, level int"

    def fly(level: int, final: bool):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "k"], kind="stable").reset_index(drop=True)
            draws = np.random.default_rng(int(pdf["h"][0]) & 0x7FFFFFFF).random(max(1, len(pdf)))
            x = pdf["t"].to_numpy(float).tolist()
            p = flight(pdf["p"].to_numpy(float), x, draws)
            if final:
                p = landing(p, x)
            return pdf.assign(p=p, level=np.int32(level))[["k", "source", "t", "base", "p", "h", "level"]]

        return one

    rounds = max(row[-1] for row in plan) if plan else 1
    flown = start.groupBy("source", F.pmod("h", "blocks").alias("b")).applyInPandas(fly(0, rounds == 1), schema)
    decided = []
    level = 0
    while rounds > 1:
        # At most two undecided documents a block go on to the next round.
        flown = cut(flown)
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        decided.append(flown.where(~open_))
        rounds = -(-2 * rounds // block_docs)
        level += 1
        flown = flown.where(open_).groupBy("source", F.pmod("h", F.lit(rounds)).alias("b")).applyInPandas(fly(level, rounds == 1), schema)
    for part in decided:
        flown = flown.unionByName(part)
    copies = flown.select(F.col("k").alias(key), "source", F.col("t").alias("n_tokens"), (F.col("base") + F.round("p").cast("int")).alias("copies"))
    got = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("got_tokens"), F.sum("copies").alias("got_docs"), F.min("copies").alias("least"), F.max("copies").alias("most"))
    # Short is a source that gives all it may, every document as often as allowed, and still less than its share.
    short = F.coalesce(F.col("least") >= F.col("max_repeats"), F.lit(True)) & (F.coalesce(F.col("got_tokens"), F.lit(0)) < F.col("target_share") * F.lit(float(total)))
    whole = got.agg(F.sum("got_tokens").alias("all_tokens"))
    report = table.join(got, "source", "left").join(F.broadcast(whole), how="cross").select(
        "source", "target_share", "max_repeats", F.col("tokens").alias("source_tokens"), short.alias("short"),
        F.coalesce("got_tokens", F.lit(0)).alias("got_tokens"), F.coalesce("got_docs", F.lit(0)).alias("got_docs"),
        F.coalesce("most", F.lit(0)).alias("most_copies"),
        F.round(F.coalesce(F.col("got_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"),
        F.round(F.coalesce(F.col("got_tokens"), F.lit(0)) / F.lit(float(max(total, 1))), 6).alias("share_of_goal"),
    )
    return copies, report


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].where("short").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source: what it should give, gives, and the share reached."""
    return _mix(spark, d)[1].drop("most_copies")


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mix, per listed source: its tokens, whether it is short, what it gives if so, and whether repeats and shares keep their bounds.

    A source that isn't short may be off its share by the documents that the landing decides: two at most, each of no
    more tokens than the largest.
    """
    copies, report = _mix(spark, d)
    largest = copies.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    total = F.sum("source_tokens").over(Window.partitionBy(F.lit(1)))  # one row a source
    rows = report.select("*", total.alias("total")).join(largest, "source", "left")
    return rows.select("source", "source_tokens", "short", F.when(F.col("short"), F.col("got_tokens")).alias("short_tokens"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), (F.col("short") | (F.abs(F.col("got_tokens") - F.col("target_share") * F.col("total")) <= F.coalesce("largest", F.lit(0)) + 1)).alias("within_share"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the mix with their number of copies."""
    return _mix(spark, d)[0].where("copies > 0")
