"""Splits of given proportions that never part rows sharing an entity.

1. Keys as written are nodes. A written key is linked to its plain form, and entities named together by a row are
   linked; the components come from hooking and shortcutting a parent table until no edge between different parents
   is left. What is said of an entity is counted over its component's nodes.
2. Components are counted by size. Every size is first shared out in proportion; the few components left over of each
   size go, largest first, to the splits whose missing rows they fill best, found with bitsets of reachable sums over
   the sizes. Sums are exact: a bitset takes as many components as its ``BITS`` rows hold, so the smallest ones, which
   settle the difference that is left, always meet the exact rest.
3. Components of one size are ranked by hash and take the splits of their size in that order.

Defined results: a row without any key stands alone; keys differing in case or blanks at the ends
are one; without rows there are no splits; null stored splits don't count as a way of being split.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.checkpoints import cut
from ..operators.joins import lookup_join

RANK_BUCKETS = 4096
HEAVY_SHARE = 1000  # keys with more than one in so many rows are joined by broadcast, components of that size placed one by one; there can be no more of either than this
BLOCK, BITS = 256, 1 << 22  # components and rows that one bitset takes
SEP, ALONE = "\x1f", "\x1e"  # between a table and a key; before a row without one


def entity_key(c: Column | str) -> Column:
    return F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" ")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for ``nodes`` (node) linked by ``edges`` (a, b).

    Each round hooks every node of an edge to its smallest neighbour, shortcuts parents twice, and
    keeps only edges between different parents. Rounds work on the remaining edges alone; the parent
    table of all nodes is updated once a round. Both are written to the shared checkpoint folder.
    """
    parent = nodes.select("node", F.col("node").alias("component")).distinct()
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not live.isEmpty():
        hook = both(live).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p"))
        for _ in range(2):
            up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("x", F.col("pp").alias("p"))
        hook = cut(hook)
        parent = cut(parent.join(hook, parent["component"] == hook["x"], "left").select("node", F.coalesce("p", "component").alias("component")))
        ha, hb = hook.select(F.col("x").alias("a"), F.col("p").alias("pa")), hook.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        live = cut(live.join(ha, "a").join(hb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return parent


def closest_subset(sizes: list[int], goal: int) -> list[int]:
    """Places of the sizes whose sum is closest to ``goal`` (the smaller sum on a tie), by reachable-sum bitsets."""
    if goal <= 0 or not sizes:
        return []
    reached, after = 1, [1]
    for s in sizes:
        reached |= reached << s
        after.append(reached)
    below = reached & ((1 << (goal + 1)) - 1)
    best = below.bit_length() - 1
    above = reached >> (goal + 1)
    if above:
        up = goal + 1 + (above & -above).bit_length() - 1
        if up - goal < goal - best:
            best = up
    chosen = []
    for i in range(len(sizes) - 1, -1, -1):
        if not after[i] >> best & 1:
            chosen.append(i)
            best -= sizes[i]
    return chosen


def blocks(sizes: list[int]) -> list[list[int]]:
    """Sizes in falling order, in blocks of ``BLOCK`` at most whose sum fits one exact bitset; one too large for that is alone."""
    out: list[list[int]] = []
    total = 0
    for s in sizes:
        if not out or len(out[-1]) == BLOCK or total + s > BITS:
            out.append([])
            total = 0
        out[-1].append(s)
        total += s
    return out


def share_out(counts: Mapping[int, int], shares: Mapping[str, float]) -> dict[int, list[tuple[str, int]]]:
    """For every size how many of its components each split takes.

    Components of a thousandth of all rows or more (a thousand at most) go one by one to the split that
    misses most. The others are shared out in proportion to what is then missing; the few left over of each
    size are placed with reachable-sum bitsets, the largest first.
    """
    total, norm = sum(s * n for s, n in counts.items()), sum(shares.values())
    names = sorted(shares, key=lambda k: (-shares[k], k))
    missing = {k: total * shares[k] / norm for k in names}
    taken = {s: dict.fromkeys(names, 0) for s in counts}

    def give(k: str, s: int, n: int = 1) -> None:
        taken[s][k] += n
        missing[k] -= s * n

    for s in sorted((s for s in counts if s * HEAVY_SHARE >= total), reverse=True):
        for _ in range(counts[s] - sum(taken[s].values())):
            give(max(names, key=lambda k: (missing[k], shares[k], k)), s)
    light = sorted(s for s in counts if s * HEAVY_SHARE < total)
    want = {k: max(0.0, missing[k]) for k in names}
    of = sum(want.values()) or 1.0
    left = []
    for s in reversed(light):
        for k in names:
            give(k, s, math.floor(counts[s] * want[k] / of + 1e-9))
        left += [s] * (counts[s] - sum(taken[s].values()))
    later = sum(left)
    for block in blocks(left):
        part = sum(block) / later
        later -= sum(block)
        for k in sorted(names, key=lambda k: (-missing[k], k))[:-1] if sum(block) <= BITS else []:
            for i in sorted(closest_subset(block, round(missing[k] * part)), reverse=True):
                give(k, block.pop(i))
        for s in block:
            give(max(names, key=lambda k: (missing[k], k)), s)
    return {s: [(k, t[k]) for k in names if t[k]] for s, t in taken.items()}


def keyed_rows(tables: Mapping[str, tuple[DataFrame, str, list[str], str]]) -> DataFrame:
    """``table_name``, ``row``, ``keys`` (nodes of its entities, as written), ``stored`` of all tables; each is (rows, id, key columns, stored split)."""
    out = None
    for name, (rows, row, keys, stored) in tables.items():
        entities = F.filter(F.array(*[F.concat(F.lit(name + SEP), F.col(k).cast("string")) for k in keys]), lambda e: e.isNotNull())
        one = rows.select(F.lit(name).alias("table_name"), F.col(row).alias("row"), entities.alias("keys"), F.col(stored).alias("stored"))
        out = one if out is None else out.unionByName(one)
    return out


def plain(node: Column) -> Column:
    """The node of a written key's plain form."""
    at = F.instr(node, SEP)
    return F.concat(F.substring(node, F.lit(1), at), entity_key(F.substr(node, at + 1)))


def entity_components(rows: DataFrame) -> DataFrame:
    """``node``, ``component`` of every written key: linked to its plain form, and to the keys of the rows that name it."""
    written = rows.select("keys").distinct()
    node = written.select(F.explode("keys").alias("node")).distinct()
    forms = node.select(F.col("node").alias("a"), plain(F.col("node")).alias("b"))
    together = F.transform(F.sequence(F.lit(2), F.size("keys")), lambda i: F.struct(F.get("keys", i - 2).alias("a"), F.get("keys", i - 1).alias("b")))
    pairs = written.where(F.size("keys") > 1).select(F.explode(together).alias("e")).select("e.*")
    nodes = node.unionByName(forms.select(F.col("b").alias("node"))).distinct()
    return components(nodes, forms.where("a <> b").unionByName(pairs))


def grouped_splits(tables: Mapping[str, tuple[DataFrame, str, list[str], str]], shares: Mapping[str, float]) -> tuple[DataFrame, DataFrame]:
    """(rows: ``table_name``, ``row``, ``split_name``; entities: ``table_name``, ``entity_key``, ``component``, ``n_rows``, ``stored_ways``, ``split_name``)."""
    rows = keyed_rows(tables)
    first = F.get("keys", F.lit(0))
    # One row per distinct set of keys and stored split first: a family with a third of all rows is a few rows here.
    counted = cut(rows.where(F.size("keys") > 0).groupBy("keys", "stored").agg(F.count(F.lit(1)).alias("n")))
    alone = rows.where(F.size("keys") == 0)
    member = entity_components(counted)
    component = counted.withColumn("node", first).join(member, "node").groupBy("component").agg(F.sum("n").alias("n_rows"))
    by_size = component.groupBy("n_rows").count()
    # Distinct sizes that add up to N rows: at most sqrt(2 N) of them.
    counts = {r["n_rows"]: r["count"] for r in by_size.collect()}
    singles = alone.count()
    if singles:
        counts[1] = counts.get(1, 0) + singles
    total = sum(s * n for s, n in counts.items())
    quota = share_out(counts, shares) if counts else {}
    spark = rows.sparkSession
    cuts = [(s, [k for k, _ in q], [sum(n for _, n in q[: i + 1]) for i in range(len(q))]) for s, q in quota.items()]
    table = spark.createDataFrame(cuts, "n_rows bigint, names array<string>, upto array<bigint>")

    by_itself = F.concat(F.lit(ALONE), "table_name", F.lit(SEP), F.col("row").cast("string"))
    every = component.select("component", "n_rows").unionByName(alone.select(by_itself.alias("component"), F.lit(1).cast("bigint").alias("n_rows")))
    bucketed = every.withColumn("h", F.xxhash64("component")).withColumn("bucket", F.pmod("h", F.lit(RANK_BUCKETS)))
    per_bucket = bucketed.groupBy("n_rows", "bucket").agg(F.count(F.lit(1)).alias("m"))
    offset = per_bucket.select("n_rows", "bucket", (F.sum("m").over(Window.partitionBy("n_rows").orderBy("bucket")) - F.col("m")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("n_rows", "bucket").orderBy("h", "component"))
    ranked = bucketed.join(offset, ["n_rows", "bucket"]).select("component", "n_rows", rank.alias("rank")).join(F.broadcast(table), "n_rows")
    assigned = ranked.select("component", "n_rows", F.get("names", F.array_position(F.transform("upto", lambda u: u >= F.col("rank")), F.lit(True)).cast("int") - 1).alias("split_name"))

    # An entity's written keys meet in its component.
    named = counted.select(F.explode("keys").alias("node"), "stored").distinct().join(member, "node")
    entity = named.groupBy("component", plain(F.col("node")).alias("node")).agg(F.count_distinct("stored").alias("stored_ways"))
    at = F.instr("node", SEP)
    entities = entity.join(assigned, "component").select(F.substring("node", F.lit(1), at - 1).alias("table_name"), F.substr("node", at + 1).alias("entity_key"), "component", "n_rows", "stored_ways", "split_name")

    by_row = rows.select("table_name", "row", F.coalesce(first, by_itself).alias("node"))
    found_by = counted.groupBy(first.alias("node")).agg(F.sum("n").alias("n"))
    lookup = found_by.join(member, "node").join(assigned, "component").select("node", "n", "split_name").unionByName(assigned.where(F.col("component").startswith(ALONE)).select(F.col("component").alias("node"), F.lit(1).cast("bigint").alias("n"), "split_name"))
    split_rows = lookup_join(by_row, lookup, "node", F.col("n") * HEAVY_SHARE > F.lit(max(total, 1)), F.xxhash64("row")).select("table_name", "row", "split_name")
    return split_rows, entities


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    shares = {r["split_name"]: r["target_share"] for r in read("split_targets").collect()}  # a fixed table of four rows
    return grouped_splits({t: (read(t), "row_no", [key], "split_name") for t, key in (("grouped_examples", "group_id"), ("ood_test_v3", "family_id"), ("contrast_test_v3", "pair_id"))}, shares)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Entities, as their components show, whose rows were stored in more than one split."""
    return _splits(spark, d)[1].where("stored_ways > 1").select("table_name", "entity_key")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its split."""
    return _splits(spark, d)[0].withColumnRenamed("row", "row_no")


def p3_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits, per table: rows, rows without a split, entities in more than one split; over all tables, whether every share is met within the largest entity."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    rows, entities = _splits(spark, d)
    rows = cut(rows)
    names = (("grouped_examples", "group_id"), ("ood_test_v3", "family_id"), ("contrast_test_v3", "pair_id"))
    keyed = None
    for t, key in names:
        one = read(t).select(F.lit(t).alias("table_name"), F.col("row_no").alias("row"), entity_key(key).alias("entity_key"))
        keyed = one if keyed is None else keyed.unionByName(one)
    parted = keyed.join(rows, ["table_name", "row"]).where("entity_key IS NOT NULL").groupBy("table_name", "entity_key").agg(F.count_distinct("split_name").alias("ways")).groupBy("table_name").agg(F.count_if(F.col("ways") > 1).alias("parted"))
    per_table = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split_name").isNull()).alias("unassigned"))
    largest = entities.agg(F.max("n_rows")).first()[0] or 0
    total, had = rows.count(), {r["split_name"]: r["count"] for r in rows.groupBy("split_name").count().collect()}
    shares = {r["split_name"]: r["target_share"] for r in read("split_targets").collect()}
    met = all(abs(had.get(k, 0) - v / sum(shares.values()) * total) <= largest for k, v in shares.items())
    return per_table.join(parted, "table_name").withColumn("shares_met", F.lit(met))
