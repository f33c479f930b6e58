"""Suffix arrays of word sequences, sorted across partitions.

A suffix runs to its record's end. It is written as its words joined by blanks (a blank sorts before every character
of a word, so suffixes that begin with one n-gram stay together), ``BLOCK`` words at a time: suffixes that share a
whole block go on to a further level, where a digest stands for the blocks before. So the array's size is that of the
words times the block, not the square of a text's length, and no suffix is cut short.

Suffixes are partitioned by the order of their text, with borders taken from a bounded sample (borders only even out
the work; they can't change the result), and sorted within. Equal suffixes are counted before they are shuffled, so
copies of a record are few rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checkpoints import cut

BLOCK = 64  # words compared at a level
SAMPLE, SAMPLE_PLACES, SAMPLE_CHARS = 4096, 16, 200  # records, places of each and characters that borders are chosen from
RUN = 50_000  # rows in an output batch


def own_order(words: list[str]) -> tuple[list[int], list[int]]:
    """The suffixes' places in their own order, and the words each shares with the one before it there."""
    n = len(words)
    if n <= BLOCK:
        if len(set(words)) == n:
            return list(range(n)), [0] * n
        order = sorted(range(n), key=lambda k: words[k:])
        shared = [0] * n
        for t in range(1, n):
            a, b, m = order[t - 1], order[t], 0
            while a + m < n and b + m < n and words[a + m] == words[b + m]:
                m += 1
            shared[t] = m
        return order, shared
    # Prefix doubling: ranks of the first 1, 2, 4, .. words.
    codes: dict[str, int] = {w: i for i, w in enumerate(sorted(set(words)))}
    ranks, k = [np.array([codes[w] for w in words], np.int64)], 1
    while k < n and ranks[-1].max() < n - 1:
        r = ranks[-1]
        then = np.full(n, -1, np.int64)
        then[: n - k] = r[k:]
        ranks.append(np.unique(r * (n + 1) + then + 1, return_inverse=True)[1])
        k *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        shared[1:] += same << level
        a, b = a + (same << level), b + (same << level)
    return order.tolist(), shared.tolist()


def borders(rows: DataFrame, record: str, toks: Column, parts: int) -> list[str]:
    """Suffixes that part the array into about ``parts`` pieces, from a sample of fixed size."""
    if parts < 2:
        return []
    few = F.pmod(F.xxhash64(record), F.lit(max(1, rows.count() // SAMPLE))) == 0

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words in batch.column(0).to_pylist():
                step = max(1, len(words) // SAMPLE_PLACES)
                out += [" ".join(words[k : k + BLOCK])[:SAMPLE_CHARS] for k in range(0, len(words), step)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["s"])

    got = sorted(r["s"] for r in rows.where(few).select(toks.alias("toks")).where(F.size("toks") > 0).mapInArrow(places, "s string").collect())
    return sorted({got[len(got) * p // parts] for p in range(1, parts)}) if got else []


def sorted_suffixes(rows: DataFrame, record: str, toks: Column, edges: list[str]) -> DataFrame:
    """The array's first level: ``s``, ``dup``, ``weight``; ``record``, ``pos`` of those of more than ``BLOCK`` words.

    ``dup`` is the longest common prefix with the suffix before it in the record's own order: n-grams of up to that
    many words occurred in this record already. Equal suffixes of a batch are one row with their number.
    """
    kind = rows.schema[record].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, int]] = Counter()
            fresh: Counter[str] = Counter()  # suffixes of records without repeated words, whose dup is 0
            long: list[tuple[str, int, int, int]] = []
            for i, words in enumerate(batch.column("toks").to_pylist()):
                n = len(words)
                if n <= BLOCK:
                    text = " ".join(words)
                    starts = [0, *accumulate([len(w) + 1 for w in words[:-1]])]
                    if len(set(words)) == n:
                        fresh.update([text[at:] for at in starts])
                    else:
                        order, shared = own_order(words)
                        counts.update(zip([text[starts[k] :] for k in order], shared))
                else:
                    for k, d in zip(*own_order(words)):
                        s = " ".join(words[k : k + BLOCK])
                        if n - k > BLOCK:
                            long.append((s, d, i, k))
                            if len(long) >= RUN:
                                yield _array_rows(batch.column("record"), Counter(), Counter(), long, edges)
                                long = []
                        else:
                            counts[s, d] += 1
            yield _array_rows(batch.column("record"), fresh, counts, long, edges)

    made = rows.select(F.col(record).alias("record"), toks.alias("toks")).where(F.size("toks") > 0).mapInArrow(make, f"part int, s string, dup int, weight bigint, record {kind}, pos int")
    return made.repartitionById(len(edges) + 1, F.col("part")).sortWithinPartitions("s").drop("part")


def placed(s: list[str], edges: list[str]) -> pa.Array:
    """The partition of each suffix."""
    return pa.array([bisect.bisect_right(edges, x) for x in s], pa.int32())


def _array_rows(records: pa.Array, fresh: Counter, counts: Counter, long: list, edges: list[str]) -> pa.RecordBatch:
    s = [*fresh, *[k for k, _ in counts], *[x[0] for x in long]]
    dup = [0] * len(fresh) + [d for _, d in counts] + [x[1] for x in long]
    none = [None] * (len(fresh) + len(counts))
    return pa.RecordBatch.from_arrays(
        [placed(s, edges), pa.array(s, pa.string()), pa.array(dup, pa.int32()), pa.array([*fresh.values(), *counts.values(), *[1] * len(long)], pa.int64()), records.take(pa.array(none + [x[2] for x in long], pa.int64())), pa.array(none + [x[3] for x in long], pa.int32())],
        ["part", "s", "dup", "weight", "record", "pos"],
    )


def prefix_intervals(ordered: DataFrame, level: int = 0, lone: int = 0, longest: int | None = None) -> DataFrame:
    """Intervals of common prefixes: ``n``, ``key``, ``occurrences``, ``records``, ``edge``, ``record``, ``pos``, ``dup``.

    An interval of suffixes that share n words is an n-gram. Records are occurrences less those whose ``dup`` reaches n.
    N-grams of one record are given only up to ``lone`` words, others up to ``longest`` words if it is given. One that
    touches the first or last row of an Arrow batch may go on in another and has ``edge``. Rows without ``n`` are
    suffixes that share all words of this level and go on to the next one. Beyond the first level ``key`` begins
    with a digest that counts as no word, and ``record`` and ``pos`` tell where the n-gram stands.
    """
    head, base = min(level, 1), level * BLOCK
    names = ["n", "key", "occurrences", "records", "edge", "record", "pos", "dup"]
    kind = ordered.schema["record"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            lists = pc.split_pattern(batch.column("s"), " ")
            flat, begin = lists.flatten(), lists.offsets.to_numpy()[:m].astype(np.int64)
            size = np.diff(lists.offsets.to_numpy())
            code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            dup = batch.column("dup").to_numpy(zero_copy_only=False)
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            goes_on = batch.column("pos").is_valid().to_numpy(zero_copy_only=False)
            alive, run = np.arange(m), np.zeros(m, np.int64)
            given: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            further = np.zeros(0, np.int64)
            d = 0
            while len(alive) and (longest is None or d - head + base < longest):
                d += 1
                n = d - head + base
                there = size[alive] >= d
                alive, run = alive[there], run[there]
                if not len(alive):
                    break
                word = code[begin[alive] + d - 1]
                new = np.ones(len(alive), bool)
                new[1:] = (run[1:] != run[:-1]) | (word[1:] != word[:-1])
                starts, run = np.flatnonzero(new), np.cumsum(new) - 1
                if d <= head:
                    continue
                occurrences = np.add.reduceat(weight[alive], starts)
                records = np.add.reduceat(np.where(dup[alive] < n, weight[alive], 0), starts)
                last = np.append(starts[1:], len(alive)) - 1
                edge = (alive[starts] == 0) | (alive[last] == m - 1)
                shown = (records >= 2) | edge | (n <= lone)
                given.append((n, alive[starts[shown]], occurrences[shown], records[shown], edge[shown]))
                kept = ((records >= 2) | edge | (n < lone))[run]
                if d == BLOCK + head:
                    further, cut_off = alive[kept & goes_on[alive]], edge[run][kept & goes_on[alive]]
                alive, run = alive[kept], run[kept]
            if given:
                n = np.concatenate([np.full(len(x[1]), x[0]) for x in given])
                first = np.concatenate([x[1] for x in given])
                long = n - base + head
                ends = np.cumsum(long)
                words = flat.take(pa.array(np.arange(ends[-1]) - np.repeat(ends - long, long) + np.repeat(begin[first], long)))
                keys = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), words), " ")
                at = pa.array(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n, pa.int32()), keys, *[pa.array(np.concatenate([x[i] for x in given]), t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.bool_()))], batch.column("record").take(at), batch.column("pos").take(at), batch.column("dup").take(at)], names
                )
            if len(further):
                at = pa.array(further)
                none = lambda t: pa.nulls(len(further), t)
                yield pa.RecordBatch.from_arrays([none(pa.int32()), batch.column("s").take(at), none(pa.int64()), none(pa.int64()), pa.array(cut_off), batch.column("record").take(at), batch.column("pos").take(at), batch.column("dup").take(at)], names)

    return ordered.select("s", "dup", "weight", "record", "pos").mapInArrow(scan, f"n int, key string, occurrences bigint, records bigint, edge boolean, record {kind}, pos int, dup int")


def next_level(onward: DataFrame, rows: DataFrame, record: str, toks: Column, level: int, parts: int) -> DataFrame:
    """Suffixes that share all words so far, by their next block. ``pos`` stays the suffix' own place."""
    kind = rows.schema[record].dataType.simpleString()
    # A record has at most as many of them as words.
    mine = onward.groupBy("record").agg(F.collect_list(F.struct("pos", "dup", "key")).alias("on"))
    met = mine.join(rows.select(F.col(record).alias("record"), toks.alias("toks")), "record")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (on, words) in enumerate(zip(batch.column("on").to_pylist(), batch.column("toks").to_pylist())):
                for x in on:
                    at = x["pos"] + BLOCK * level
                    head = hashlib.blake2b(x["key"].encode(), digest_size=16).hexdigest()
                    out.append((" ".join([head, *words[at : at + BLOCK]]), x["dup"], i, x["pos"]))
            s, dup, row, pos = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(dup, pa.int32()), pa.array([1] * len(out), pa.int64()), batch.column("record").take(pa.array(row, pa.int64())), pa.array(pos, pa.int32())], ["s", "dup", "weight", "record", "pos"])

    made = met.select("record", "on", "toks").mapInArrow(make, f"s string, dup int, weight bigint, record {kind}, pos int")
    return made.repartitionByRange(parts, "s", "record", "pos").sortWithinPartitions("s")


def ngrams(rows: DataFrame, record: str, toks: Column, lone: int = 0, longest: int | None = None) -> DataFrame:
    """``n``, ``ngram``, ``occurrences``, ``records`` of the n-grams of every length: those of two records or more, and of one up to ``lone`` words.

    ``longest`` leaves out longer ones of the result; suffixes are whole all the same. Records must have distinct keys.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level, out = 0, None
    ordered = sorted_suffixes(rows, record, toks, borders(rows, record, toks, parts))
    while True:
        found = prefix_intervals(ordered, level, lone, longest)
        ends_here = longest is not None and longest < BLOCK * (level + 1)
        if not ends_here:
            found = cut(found)
        grams = found.where("n IS NOT NULL")
        if ends_here:
            grams = cut(grams)
        # Only intervals at the edge of a batch can have further parts.
        parted = grams.where("edge").groupBy("n", "key").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), F.min(F.struct("pos", "record")).alias("at"))
        each = grams.where("NOT edge").select("n", "key", "occurrences", "records", F.struct("pos", "record").alias("at")).unionByName(parted).where(f"records >= 2 OR n <= {lone}")
        if level:
            words = rows.select(F.col(record).alias("record"), toks.alias("toks"))
            each = each.select("n", "occurrences", "records", "at.record", "at.pos").join(words, "record").select("n", F.array_join(F.slice("toks", F.col("pos") + 1, F.col("n")), " ").alias("key"), "occurrences", "records")
        each = each.select("n", F.col("key").alias("ngram"), "occurrences", "records")
        out = each if out is None else out.unionByName(each)
        if ends_here:
            return out
        # Suffixes of a cut interval go on if all its parts together have two records.
        level += 1
        shared = parted.where((F.col("n") == BLOCK * level) & (F.col("records") >= 2)).select("key")
        onward = cut(found.where("n IS NULL AND NOT edge").unionByName(found.where("n IS NULL AND edge").join(shared, "key", "left_semi").select(*found.columns)))
        if onward.isEmpty():
            return out
        ordered = next_level(onward, rows, record, toks, level, parts)
