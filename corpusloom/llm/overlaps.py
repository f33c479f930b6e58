"""Records of evaluation splits that also occur, the same or almost, in the training split.

Two questions need two orders of words.

*Which spans are shared*: :func:`shared_coverage` sorts the suffixes of all texts in their own order, the training
ones among the others. The longest prefix an evaluation suffix shares with training is the one it shares with the
nearest training suffix before or after it; prefixes of ``SPAN`` words or more are shared spans, and overlapping spans
are merged into the share of the record's words they cover.

*Which records are almost the same as sets of words*: the order of words says nothing here, so
:func:`near_pairs` writes every record as its distinct words, rarest first, and works on the suffixes of
that sequence. Two records whose sets have shared / total >= t must have a first shared word; the
suffixes that begin with it have a common prefix, and it can only stand at the first
``n - ceil(t (n + m) / (1 + t)) + 1`` places of either. Only these suffixes are made, matched by their
first word and the partner's length, thinned by the bits in which the word sets differ, and checked
exactly. No pair is lost and none is dropped by a cap.

Defined results: null texts and null splits are left out; a record without words is like none, and no word of it is
covered; a record of fewer than ``SPAN`` words is covered if all of it occurs in training; equal records are searched
once and expanded, or multiplied in numbers, afterwards; several training copies each count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.checkpoints import cut
from ..operators.layout import spread
from .suffixes import RUN, borders, placed

SKETCH_BITS = 18  # buckets of the word counts that order the words: a fixed size, whatever the input
WIDTH = math.log(1.25)  # partners' lengths are matched in geometric steps
SPAN = 5
WINDOW = 11  # words compared beyond a span


def distinct_words(text: str, profile: str) -> Column:
    return F.array_sort(F.array_distinct(tokens(text, profile)))


def set_keys(rows: DataFrame, row: str, text: str, split: str, train: str, profile: str, keep: tuple[Column, ...] = ()) -> DataFrame:
    """``row``, ``tr`` (in the training split), ``set_key`` (a digest of the distinct words) and the columns to keep."""
    known = rows.where(F.col(text).isNotNull() & F.col(split).isNotNull())
    words = F.array_join(distinct_words(text, profile), " ")
    keyed = known.select(F.col(row).alias("row"), (F.col(split) == train).alias("tr"), words.alias("w"), *keep).where("w <> ''")
    return keyed.withColumn("set_key", F.substring(F.unhex(F.sha2("w", 256)), 1, 16)).drop("w")


def _least_shared(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """The fewest shared words of sets of n and m words at similarity t; never too many."""
    return np.ceil(t * (n + m) / (1 + t) - 1e-6).astype(np.int64)


def near_pairs(keys: DataFrame, words: DataFrame, tenths: int, profile: str) -> DataFrame:
    """Pairs of word sets, one in training and one outside, as ``key_a`` (training), ``key_b``; a set in both is a pair.

    The search works on hashes of words, which can only add candidates: equal words have equal hashes, and the order of a
    record's words is by count, hash and word. The final check is made on the words themselves, fetched for the candidates
    from ``words`` (row, text). ``tenths``: the least similarity in tenths, so that this check is in whole numbers.
    """
    t = tenths / 10
    classes = cut(keys.groupBy("set_key").agg(F.min("row").alias("rep"), F.max("tr").alias("tr"), F.max(~F.col("tr")).alias("ev")))
    ids = F.transform(distinct_words("text", profile), lambda w: F.xxhash64(w))
    searched = cut(words.join(classes.select(F.col("rep").alias("row"), "tr", "ev"), "row").select(F.col("row").alias("rep"), ids.alias("ids"), "tr", "ev"))
    mask = (1 << SKETCH_BITS) - 1
    sketch = (
        searched.select(F.explode("ids").alias("id"), F.col("tr").cast("int").alias("tr"), F.col("ev").cast("int").alias("ev"))
        .groupBy(F.col("id").bitwiseAND(F.lit(mask)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("tr").alias("tr"), F.max("ev").alias("ev"))
    )
    counts, in_train, in_eval = np.zeros(mask + 1, np.int64), np.zeros(mask + 1, bool), np.zeros(mask + 1, bool)
    got = sketch.toPandas()  # at most 2 ** SKETCH_BITS rows
    at = got["bucket"].to_numpy(np.int64)
    counts[at], in_train[at], in_eval[at] = got["n"], got["tr"] > 0, got["ev"] > 0
    held = keys.sparkSession.sparkContext.broadcast((counts, in_train, in_eval))
    fields = [("id", pa.int64()), ("step", pa.int32()), ("rep", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())]
    ddl = "id bigint, step int, rep bigint, n int, at int, s1 bigint, s2 bigint"

    def ordered(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
        counts, in_train, in_eval = held.value
        met = in_train if probe else in_eval
        steps = lambda x: np.floor(np.log(x) / WIDTH + 1e-9).astype(np.int64)
        for batch in batches:
            words = batch.column("ids")
            flat = words.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(words.offsets.to_numpy())
            rec = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, counts[flat & mask], rec))
            flat = flat[order]
            start = np.cumsum(n) - n
            place = np.arange(len(flat)) - start[rec]
            bit = (flat.astype(np.uint64) >> np.uint64(40)) & np.uint64(127)
            one = np.uint64(1) << (bit & np.uint64(63))
            zero = np.uint64(0)
            if not len(n) or not len(flat):
                continue
            s1 = np.bitwise_or.reduceat(np.where(bit < 64, one, zero), start)
            s2 = np.bitwise_or.reduceat(np.where(bit >= 64, one, zero), start)
            size = n[rec]
            low = np.ceil(t * size - 1e-6).astype(np.int64)
            keep = (place <= size - _least_shared(size, low, t)) & met[flat & mask]
            flat, rec, place, size, low = flat[keep], rec[keep], place[keep], size[keep], low[keep]
            if probe:
                # The longest partner for which this place can still hold the first shared word.
                high = np.floor((size - place) * (1 + t) / t - size + 1e-6).astype(np.int64)
                high = np.minimum(high, np.floor(size / t + 1e-6).astype(np.int64))
                first, last = steps(np.maximum(low, 1)), steps(np.maximum(high, 1))
                many = np.maximum(last - first + 1, 0)
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                flat, rec, place, size = (np.repeat(x, many) for x in (flat, rec, place, size))
            else:
                step = steps(size)
            reps = batch.column("rep").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip((flat, step, reps[rec], size, place, s1[rec].view(np.int64), s2[rec].view(np.int64)), fields)], [f for f, _ in fields])

    probe = searched.where("ev").select("rep", "ids").mapInArrow(lambda b: ordered(b, True), ddl).toDF("id", "step", "rep_b", "nb", "at_b", "b1", "b2")
    index = searched.where("tr").select("rep", "ids").mapInArrow(lambda b: ordered(b, False), ddl).toDF("id", "step", "rep_a", "na", "at_a", "a1", "a2")
    least = f"ceil({tenths}D * (na + nb) / {10 + tenths}D - 1e-6D)"
    met = probe.join(index, ["id", "step"]).where(
        f"rep_a <> rep_b AND at_a <= na - {least} AND at_b <= nb - {least} AND bit_count(a1 ^ b1) + bit_count(a2 ^ b2) <= na + nb - 2 * {least}"
    )
    pairs = cut(met.select("rep_a", "rep_b").distinct())
    reps = pairs.select(F.col("rep_a").alias("row")).unionByName(pairs.select(F.col("rep_b").alias("row"))).distinct()
    spoken = words.join(reps, "row", "left_semi").select("row", distinct_words("text", profile).alias("w"))
    keyed = cut(spoken.join(classes.select(F.col("rep").alias("row"), "set_key"), "row"))
    a, b = keyed.toDF("rep_a", "wa", "key_a"), keyed.toDF("rep_b", "wb", "key_b")
    shared = F.size(F.array_intersect("wa", "wb"))
    exact = pairs.join(a, "rep_a").join(b, "rep_b").where(shared * 10 >= F.lit(tenths) * (F.size("wa") + F.size("wb") - shared))
    same = classes.where("tr AND ev").select(F.col("set_key").alias("key_a"), F.col("set_key").alias("key_b"))
    return exact.select("key_a", "key_b").unionByName(same)


def split_overlaps(rows: DataFrame, row: str = "row_no", text: str = "text", split: str = "split_name", train: str = "train", tenths: int = 7, profile: str = "v3") -> DataFrame:
    """``train_row``, ``other_row``: all pairs whose sets of distinct words have shared / total >= tenths / 10."""
    keys = cut(set_keys(rows, row, text, split, train, profile))
    pairs = cut(near_pairs(keys, rows.select(F.col(row).alias("row"), F.col(text).alias("text")), tenths, profile))
    left = keys.where("tr").select(F.col("set_key").alias("key_a"), F.col("row").alias("train_row"))
    right = keys.where("NOT tr").select(F.col("set_key").alias("key_b"), F.col("row").alias("other_row"))
    return pairs.join(left, "key_a").join(right, "key_b").select("train_row", "other_row")


def overlap_report(rows: DataFrame, by: dict[str, Column], row: str = "row_no", text: str = "text", split: str = "split_name", train: str = "train", tenths: int = 7, profile: str = "v3") -> DataFrame:
    """Per evaluation group ``by``: ``n_rows`` with an overlap in training and their ``links``. Copies are multiplied, not paired."""
    keys = cut(set_keys(rows, row, text, split, train, profile, tuple(c.alias(n) for n, c in by.items())))
    pairs = near_pairs(keys, rows.select(F.col(row).alias("row"), F.col(text).alias("text")), tenths, profile)
    copies = keys.where("tr").groupBy(F.col("set_key").alias("key_a")).agg(F.count(F.lit(1)).alias("copies"))
    links = pairs.join(copies, "key_a").groupBy(F.col("key_b").alias("set_key")).agg(F.sum("copies").alias("links"))
    met = keys.where("NOT tr").groupBy("set_key", *by).agg(F.count(F.lit(1)).alias("m")).join(links, "set_key")
    return met.groupBy(*by).agg(F.sum("m").alias("n_rows"), F.sum(F.col("m") * F.col("links")).alias("links"))


def shared_spans(known: DataFrame, record: str, span: int) -> DataFrame:
    """``record``, ``pos``, ``shared``: how many words from there also stand in training, if ``span`` or the whole record.

    ``known`` has the record, ``tr`` and ``words``. Of a suffix ``WINDOW`` words more than ``span`` are compared; longer
    spans come out by their later places, so merged spans are the same as those of whole prefixes. A place comes once
    for the training suffix before it and once for the one after it. The array is shuffled once; both passes sort it
    where it lies.
    """
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = borders(known, record, F.col("words"), parts)
    kind = known.schema[record].dataType.simpleString()
    block = span + WINDOW
    names = ["part", "s", "record", "pos", "need"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(records: pa.Array, trained: set[str], own: list[tuple[str, int, int, int]]) -> pa.RecordBatch:
            s = [*trained, *[x[0] for x in own]]
            rest = lambda j: [None] * len(trained) + [x[j] for x in own]
            return pa.RecordBatch.from_arrays([placed(s, edges), pa.array(s, pa.string()), records.take(pa.array(rest(1), pa.int64())), pa.array(rest(2), pa.int32()), pa.array(rest(3), pa.int32())], names)

        for batch in batches:
            trained: set[str] = set()
            own: list[tuple[str, int, int, int]] = []
            for i, (tr, words) in enumerate(zip(batch.column("tr").to_pylist(), batch.column("words").to_pylist())):
                need = min(span, len(words))
                for k in range(len(words) - (0 if tr else need - 1)):
                    x = " ".join(words[k : k + block])
                    trained.add(x) if tr else own.append((x, i, k, need))
                    if len(trained) + len(own) >= RUN:
                        yield rows(batch.column("record"), trained, own)
                        trained, own = set(), []
            yield rows(batch.column("record"), trained, own)

    some = known.select(F.col(record).alias("record"), "tr", "words").where(F.size("words") > 0)
    array = cut(some.mapInArrow(make, f"part int, s string, record {kind}, pos int, need int").repartitionById(len(edges) + 1, F.col("part")))
    # The nearest training suffixes before and after each partition: one row a partition.
    ends = sorted(tuple(r) for r in array.where("pos IS NULL").groupBy("part").agg(F.min("s"), F.max("s")).collect())
    before = {p: [e[2] for e in ends if e[0] < p][-1:] for p in range(len(edges) + 1)}
    after = {p: [e[1] for e in ends if e[0] > p][:1] for p in range(len(edges) + 1)}

    def measure(batches: Iterator[pa.RecordBatch], start: dict[int, list[str]]) -> Iterator[pa.RecordBatch]:
        last: list[str] | None = None
        for batch in batches:
            met: list[tuple[int, int]] = []
            for i, (p, s, need) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "s", "need")))):
                if last is None:
                    last = start[p][0].split(" ") if start[p] else []
                if need is None:
                    last = s.split(" ")
                elif last:
                    n = 0
                    for x, y in zip(s.split(" "), last):
                        if x != y:
                            break
                        n += 1
                    if n >= need:
                        met.append((i, n))
            if met:
                at = pa.array([i for i, _ in met], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("record").take(at), batch.column("pos").take(at), pa.array([n for _, n in met], pa.int32())], ["record", "pos", "shared"])

    ddl = f"record {kind}, pos int, shared int"
    # Of equal suffixes those of training come first in the first pass.
    up = array.sortWithinPartitions("s", F.col("pos").asc_nulls_first()).mapInArrow(lambda b: measure(b, before), ddl)
    down = array.sortWithinPartitions(F.desc("s"), F.col("pos").asc_nulls_first()).mapInArrow(lambda b: measure(b, after), ddl)
    return up.unionByName(down)


def shared_coverage(rows: DataFrame, row: str = "row_no", text: str = "text", split: str = "split_name", train: str = "train", span: int = SPAN, profile: str = "v3") -> DataFrame:
    """Per evaluation record: ``n_words``, ``covered`` (words in spans of ``span`` or more shared with training), ``spans`` after merging."""
    known = rows.where(F.col(text).isNotNull() & F.col(split).isNotNull()).select(row, (F.col(split) == train).alias("tr"), tokens(text, profile).alias("words"))
    reach = F.max(F.col("pos") + F.col("shared")).over(Window.partitionBy("record").orderBy("pos", "shared").rowsBetween(Window.unboundedPreceding, -1))
    fresh = shared_spans(known, row, span).withColumn("reach", F.coalesce(reach, F.lit(-1)))
    merged = fresh.groupBy("record").agg(
        F.sum(F.greatest(F.lit(0), F.col("pos") + F.col("shared") - F.greatest(F.col("pos"), F.col("reach")))).alias("covered"), F.sum((F.col("pos") > F.col("reach")).cast("bigint")).alias("spans")
    )
    sizes = known.where("NOT tr").select(F.col(row).alias("record"), F.size("words").cast("bigint").alias("n_words"))
    return sizes.join(merged, "record", "left").select(F.col("record").alias(row), "n_words", F.coalesce("covered", F.lit(0)).cast("bigint").alias("covered"), F.coalesce("spans", F.lit(0)).cast("bigint").alias("spans"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/grouped_examples.parquet").select("row_no", "group_id", "split_name", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = split_overlaps(_examples(spark, d))
    return found.select(F.least("train_row", "other_row").alias("row_a"), F.greatest("train_row", "other_row").alias("row_b"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows of evaluation splits with an overlap in training, and their links, per split and group."""
    by = {"split_name": F.col("split_name"), "group_id": F.lower(F.btrim("group_id", F.lit(" ")))}
    return overlap_report(_examples(spark, d), by).select("split_name", "group_id", "n_rows", "links")


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of every evaluation row lies in spans of five words or more shared with training, and how many such spans there are."""
    return shared_coverage(_examples(spark, d))
