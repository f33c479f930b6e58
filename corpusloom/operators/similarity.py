"""Exact set-similarity joins by prefix filtering.

Sets are written with their rarest members first, by counts of a sketch of fixed size. Two sets whose shared / total
is at least t share a member early in both, so only these beginnings are matched, by member and the partner's size in
geometric steps; places and the bits in which the sets differ thin the candidates, and the rest is checked exactly on
the members themselves. Rows with equal sets are one while searching. No pair is lost and none is dropped by a cap.

Defined results: a row without members is like none; rows without a group are each a group of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_terms, tokens
from .checkpoints import cut
from .joins import lookup_join

SKETCH_BITS = 18  # buckets of the member counts that order the members
WIDTH = math.log(1.25)  # partners' sizes are matched in geometric steps
HEAVY_SHARE = 1000  # members of more than one in so many rows are joined by broadcast
# The least similarity of rows of two families that counts as a leak, on all terms and on the terms that aren't common in a label, and how many families make a term common.
RAW_LIMIT, RESIDUAL_LIMIT, COMMON_FAMILIES = 0.30, 0.25, 3


def prefixes(sets: DataFrame, key: str, members: str, t: float) -> DataFrame:
    """key, ``member``, ``place`` (from 0), ``n``: the rarest members of each set that any partner must meet, by exact counts."""
    each = sets.select(key, F.size(members).alias("n"), F.explode(members).alias("member"))
    frequency = each.groupBy("member").agg(F.count(F.lit(1)).alias("df"))
    counted = lookup_join(each, frequency, "member", F.col("df") * HEAVY_SHARE > F.lit(sets.count()), F.xxhash64(key))
    ordered = counted.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("df", "member")) - 1)
    return ordered.where(F.col("place") < F.col("n") - F.ceil(F.lit(t) * F.col("n") - F.lit(1e-9)) + 1).select(key, "member", "place", "n")


def least_shared(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """The fewest shared members of sets of n and m members at similarity t; never too many."""
    return np.ceil(t * (n + m) / (1 + t) - 1e-6).astype(np.int64)


def candidates(sets: DataFrame, t: float, within: bool = True) -> DataFrame:
    """``a``, ``b``: pairs of sets that may have similarity t, from ``rep``, ``ids`` (hashes of the members), ``asks``, ``answers``.

    ``b`` asks and ``a`` answers. ``within``: all sets do both and a pair comes once, in one order or the other.
    Sets are read three times; give a written table.
    """
    mask = (1 << SKETCH_BITS) - 1
    sketch = (
        sets.select(F.explode("ids").alias("id"), F.col("answers").cast("int").alias("x"), F.col("asks").cast("int").alias("y"))
        .groupBy(F.col("id").bitwiseAND(F.lit(mask)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"), F.max("y").alias("y"))
    )
    counts, answered, asked = np.zeros(mask + 1, np.int64), np.zeros(mask + 1, bool), np.zeros(mask + 1, bool)
    got = sketch.toPandas()  # at most 2 ** SKETCH_BITS rows
    at = got["bucket"].to_numpy(np.int64)
    counts[at], answered[at], asked[at] = got["n"], got["x"] > 0, got["y"] > 0
    held = sets.sparkSession.sparkContext.broadcast((counts, answered, asked))
    kind = sets.schema["rep"].dataType.simpleString()
    names = ["id", "step", "rep", "n", "at", "s1", "s2"]

    def steps(x: np.ndarray) -> np.ndarray:
        return np.floor(np.log(x) / WIDTH + 1e-9).astype(np.int64)

    def beginnings(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
        counts, answered, asked = held.value
        met = answered if probe else asked
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(lists.offsets.to_numpy())
            if not len(flat):
                continue
            rec = np.repeat(np.arange(len(n)), n)
            flat = flat[np.lexsort((flat, counts[flat & mask], rec))]
            start = np.cumsum(n) - n
            place = np.arange(len(flat)) - start[rec]
            bit = (flat.astype(np.uint64) >> np.uint64(40)) & np.uint64(127)
            one, zero = np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)
            s1 = np.bitwise_or.reduceat(np.where(bit < 64, one, zero), start)
            s2 = np.bitwise_or.reduceat(np.where(bit >= 64, one, zero), start)
            size = n[rec]
            low = np.ceil(t * size - 1e-6).astype(np.int64)
            keep = (place <= size - least_shared(size, low, t)) & met[flat & mask]
            flat, rec, place, size, low = flat[keep], rec[keep], place[keep], size[keep], low[keep]
            if probe:
                # The largest partner for which this place can still hold the first shared member.
                high = np.floor((size - place) * (1 + t) / t - size + 1e-6).astype(np.int64)
                high = np.minimum(high, size if within else np.floor(size / t + 1e-6).astype(np.int64))
                first, last = steps(np.maximum(low, 1)), steps(np.maximum(high, 1))
                many = np.maximum(last - first + 1, 0)
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                flat, rec, place, size = (np.repeat(x, many) for x in (flat, rec, place, size))
            else:
                step = steps(size)
            numbers = [pa.array(flat), pa.array(step, pa.int32()), batch.column("rep").take(pa.array(rec)), pa.array(size, pa.int32()), pa.array(place, pa.int32()), pa.array(s1[rec].view(np.int64)), pa.array(s2[rec].view(np.int64))]
            yield pa.RecordBatch.from_arrays(numbers, names)

    ddl = f"id bigint, step int, rep {kind}, n int, at int, s1 bigint, s2 bigint"
    probe = sets.where("asks").select("rep", "ids").mapInArrow(lambda b: beginnings(b, True), ddl).toDF("id", "step", "b", "nb", "at_b", "b1", "b2")
    index = sets.where("answers").select("rep", "ids").mapInArrow(lambda b: beginnings(b, False), ddl).toDF("id", "step", "a", "na", "at_a", "a1", "a2")
    least = f"ceil({t!r}D * (na + nb) / {1 + t!r}D - 1e-6D)"
    once = "(na < nb OR na = nb AND a < b)" if within else "a <> b"
    met = probe.join(index, ["id", "step"]).where(f"{once} AND at_a <= na - {least} AND at_b <= nb - {least} AND bit_count(a1 ^ b1) + bit_count(a2 ^ b2) <= na + nb - 2 * {least}")
    return met.select("a", "b").distinct()


def similar_sets(sets: DataFrame, key: str, members: str, t: float) -> DataFrame:
    """``a``, ``b``, ``shared``, ``total`` of all pairs of distinct sets with shared / total >= t, each pair once."""
    hashed = cut(sets.select(F.col(key).alias("rep"), F.transform(members, lambda m: F.xxhash64(m)).alias("ids"), F.lit(True).alias("asks"), F.lit(True).alias("answers")).where(F.size("ids") > 0))
    pairs = cut(candidates(hashed, t))
    # Members are fetched for sets with a candidate only.
    some = pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key))).distinct()
    met = sets.join(some, key, "left_semi")
    x, y = met.select(F.col(key).alias("a"), F.col(members).alias("ma")), met.select(F.col(key).alias("b"), F.col(members).alias("mb"))
    both = pairs.join(x, "a").join(y, "b").withColumn("shared", F.size(F.array_intersect("ma", "mb")))
    return both.withColumn("total", F.size("ma") + F.size("mb") - F.col("shared")).where(F.col("shared") >= F.lit(t) * F.col("total") - F.lit(1e-12)).select("a", "b", "shared", "total")


def similar_row_links(rows: DataFrame, key: str, group: str, members: str, t: float) -> DataFrame:
    """key, ``links``: rows of other groups at similarity t or more, for every row that has some.

    Rows are first gathered by set and group; a set's links are counted between sets and groups, so
    copies are multiplied in numbers, not in rows.
    """
    known = rows.where(F.size(members) > 0).select(F.col(key).alias("k"), F.coalesce(F.col(group), F.concat(F.lit("\x1e"), F.col(key).cast("string"))).alias("g"), F.array_sort(members).alias("m"))
    keyed = cut(known.withColumn("s", F.unhex(F.sha2(F.array_join("m", "\x1f"), 256))))
    sets = cut(keyed.groupBy("s").agg(F.min("k").alias("rep"), F.first("m").alias("m")))
    pairs = similar_sets(sets, "rep", "m", t)
    directed = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(sets.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    counts = keyed.groupBy("s", "g").agg(F.count(F.lit(1)).alias("c")).join(sets.select("s", "rep"), "s").select("rep", "g", "c")
    near = directed.join(counts.withColumnRenamed("rep", "b"), "b").groupBy("a", "g").agg(F.sum("c").alias("c"))
    total = near.groupBy("a").agg(F.sum("c").alias("total"))
    own = near.select(F.col("a").alias("rep"), "g", F.col("c").alias("own"))
    per_set = counts.select("rep", "g").join(total.withColumnRenamed("a", "rep"), "rep").join(own, ["rep", "g"], "left").select("rep", "g", (F.col("total") - F.coalesce("own", F.lit(0))).alias("links")).where("links > 0")
    return keyed.join(sets.select("s", "rep"), "s").join(per_set, ["rep", "g"]).select(F.col("k").alias(key), "links")


def residual_members(rows: DataFrame, key: str, label: str, group: str, members: str, families: int = COMMON_FAMILIES) -> DataFrame:
    """``rows`` with ``members`` less those found in ``families`` or more groups of the same label.

    A row keeps an empty list if nothing is left. Rows without label or group keep all members.
    """
    told = F.col(label).isNotNull() & F.col(group).isNotNull()
    named = F.concat(F.col(label), F.lit("\x1f"), F.col("member"))
    each = rows.where(F.col(label).isNotNull()).select(key, label, group, F.explode(members).alias("member")).withColumn("lm", named)
    per_family = each.where(told).groupBy("lm", group).agg(F.count(F.lit(1)).alias("c"))
    stats = each.groupBy("lm").agg(F.count(F.lit(1)).alias("rows")).join(per_family.groupBy("lm").agg(F.count(F.lit(1)).alias("families")), "lm", "left")
    met = lookup_join(each.select(key, "member", "lm"), stats, "lm", F.col("rows") * HEAVY_SHARE > F.lit(rows.count()), F.xxhash64(key))
    left = met.where(F.coalesce(F.col("families"), F.lit(0)) < families).groupBy(key).agg(F.array_sort(F.collect_list("member")).alias("__m"))
    others = [c for c in rows.columns if c != members]
    kept = F.when(F.col(label).isNull(), F.array_sort(members)).otherwise(F.coalesce("__m", F.array().cast("array<string>")))
    return rows.join(left, key, "left").select(*others, kept.alias(members))


def family_leaks(rows: DataFrame, key: str = "id", group: str = "group_id", label: str = "label", text: str = "text", profile: str = "v1", word: tuple[int, int] = (1, 2), char: tuple[int, int] = (3, 5)) -> DataFrame:
    """key, ``kind``, ``links``: rows too near to rows of other families, by all their terms (raw), or in one label by the terms not common there (residual)."""
    sets = cut(rows.where(F.col(text).isNotNull()).select(key, group, label, F.array_distinct(extract_terms(tokens(text, profile), word, char)).alias("members")))
    raw = similar_row_links(sets, key, group, "members", RAW_LIMIT).withColumn("kind", F.lit("raw"))
    # A set belongs to its label: the same terms under another label are another set.
    rest = residual_members(sets, key, label, group, "members").where(F.col(label).isNotNull() & (F.size("members") > 0))
    own = rest.withColumn("members", F.transform("members", lambda m: F.concat(F.col(label), F.lit("\x1f"), m)))
    return raw.unionByName(similar_row_links(own, key, group, "members", RESIDUAL_LIMIT).withColumn("kind", F.lit("residual"))).select(key, "kind", "links")
