import collections
import random

import numpy as np
import pytest
from corpusloom.llm import mixing as M
from corpusloom.llm import packing as K
from corpusloom.llm import splits as P
from pyspark.sql import functions as F

SHARES = {"train": 0.6, "development": 0.14, "calibration": 0.13, "id-test": 0.13}


def test_components_against_union_find(spark):
    rng = random.Random(2)
    nodes = [f"n{i:03}" for i in range(200)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(130)] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("n199", "n199")]
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in P.components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: root(n) for n in nodes}


def test_closest_subset_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        goal = rng.randint(0, 80)
        best = min(abs(sum(s for k, s in enumerate(sizes) if mask >> k & 1) - goal) for mask in range(1 << len(sizes)))
        assert abs(sum(sizes[i] for i in P.closest_subset(sizes, goal)) - goal) == best


def test_sums_are_exact_at_any_size():
    sizes = sorted((random.Random(3).randint(1, 3_000_000) for _ in range(40)), reverse=True)
    assert [s for b in P.blocks(sizes) for s in b] == sizes and all(sum(b) <= P.BITS or len(b) == 1 for b in P.blocks(sizes))
    counts = {5_000_003: 2, 1_000_001: 7, 77_777: 11, 13: 400, 1: 3000}
    quota = P.share_out(counts, SHARES)
    total = sum(s * n for s, n in counts.items())
    had = collections.Counter()
    for s, parts in quota.items():
        assert sum(k for _, k in parts) == counts[s]
        for name, k in parts:
            had[name] += s * k
    assert sum(had.values()) == total


@pytest.mark.parametrize("counts", [{1: 1000, 3: 500, 7: 300, 30: 20, 400: 1}, {33333: 1, 1: 60000, 2: 3000}, {7: 2000}, {1: 3}, {5: 1}, {i: 1 for i in range(1, 400)}, {}])
def test_shares_are_met(counts):
    quota = P.share_out(counts, SHARES)
    got = collections.Counter()
    for s, n in counts.items():
        assert sum(k for _, k in quota[s]) == n
        for name, k in quota[s]:
            got[name] += s * k
    total = sum(s * n for s, n in counts.items())
    if total > 1000:
        assert all(abs(got[k] - v * total) <= max(counts if len(counts) == 1 else [2]) + 1 for k, v in SHARES.items())


def test_rows_of_an_entity_never_part(spark):
    rng = random.Random(6)
    a = [(i, rng.choice(["F1", " f1 ", "f2", None, "hot", "hot", "hot"]) if i % 2 else f"k{i // 3}", rng.choice(["train", "id-test", None]), "clash") for i in range(900)]
    b = [(i, f"p{i % 40}", f"s{i % 7}" if i % 5 == 0 else None, "train") for i in range(200)]
    one = spark.createDataFrame(a, "row_no long, g string, split_name string, node string")
    two = spark.createDataFrame(b, "row_no long, p string, s string, split_name string")
    rows, entities = P.grouped_splits({"one": (one, "row_no", ["g"], "split_name"), "two": (two, "row_no", ["p", "s"], "split_name")}, SHARES)
    got = {(r["table_name"], r["row"]): r["split_name"] for r in rows.collect()}
    assert len(got) == 1100 and None not in got.values()
    by = collections.defaultdict(set)
    for i, g, _, _ in a:
        if g is not None:
            by["one", g.strip(" ").lower()].add(got["one", i])
    for i, p, s, _ in b:
        by["two", "p", p].add(got["two", i])
        if s:
            by["two", "s", s].add(got["two", i])
    assert all(len(v) == 1 for v in by.values())
    stored = collections.defaultdict(set)
    for _, g, s, _ in a:
        if g is not None and s is not None:
            stored[g.strip(" ").lower()].add(s)
    ways = {r["entity_key"]: r["stored_ways"] for r in entities.where("table_name = 'one'").collect()}
    assert {k for k, n in ways.items() if n > 1} == {k for k, v in stored.items() if len(v) > 1}
    rows, entities = P.grouped_splits({"one": (one.limit(0), "row_no", ["g"], "split_name")}, SHARES)
    assert rows.count() == 0 and entities.count() == 0


SPECS = {"small": 50, "large": 200}


def _docs(spark, n=600):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 60) if i % 23 else None, "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.choice([None, int(rng.paretovariate(1.2) * 5)]) if i % 23 else rng.choice([None, 7]), "clash") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens long, part string")


def test_packing_keeps_everything(spark):
    rows, df = _docs(spark)
    size = {i: n if n is not None else len(t) + 1 for i, t, _, n, _ in rows if n is not None or t is not None}
    for partition in (100, 10_000):
        packed = K.pack(df, SPECS, partition_docs=partition).collect()
        for kind, capacity in SPECS.items():
            mine = [r for r in packed if r["container_kind"] == kind]
            full = collections.Counter()
            pieces = collections.defaultdict(list)
            for r in mine:
                full[r["container"]] += r["n_tokens"]
                pieces[r["doc_id"]].append(r)
            assert max(full.values()) <= capacity and pieces.keys() == size.keys()
            for i, ps in pieces.items():
                ps.sort(key=lambda r: r["piece"])
                assert sum(r["n_tokens"] for r in ps) == size[i] and len(ps) == ps[0]["pieces"] == max(1, -(-size[i] // capacity))
                assert [r["first_token"] for r in ps] == [capacity * k for k in range(len(ps))]
            assert sum(full.values()) / (len(full) * capacity) > 0.9
    assert K.pack(df.limit(0), SPECS).count() == 0


def test_windows_follow_the_mixture():
    rng = np.random.default_rng(1)
    sizes, sources = rng.integers(1, 30, 3000), rng.choice(3, 3000, p=[0.6, 0.3, 0.1])
    shares = np.bincount(sources, weights=sizes) / sizes.sum()
    home, n, _ = K.fill(sizes, sources, shares, np.zeros(3), 400)
    had = np.zeros((n, 3))
    np.add.at(had, (home, sources), sizes)
    drift = np.abs(had.cumsum(0) - had.sum(1).cumsum()[:, None] * shares)
    assert drift.max() < 100 and had.sum(1).max() <= 400 and (had.sum(1)[:-2] >= 395).all()


def test_given_targets_are_followed(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(5, 60)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("text", F.lit(None).cast("string"))
    packed = K.pack(df, {"box": 500}, targets={"a": 6, "b": 2, K.NONE: 2}).collect()
    source = {i: s for i, s, _ in rows}
    by = collections.defaultdict(collections.Counter)
    for r in packed:
        by[r["container"]][source[r["doc_id"]]] += r["n_tokens"]
    first = [by[c] for c in sorted(by)[: len(by) // 3]]  # later windows hold what the targets leave over
    had = sum(first, collections.Counter())
    total = sum(had.values())
    assert abs(had["a"] / total - 0.6) < 0.01 and abs(had["b"] / total - 0.2) < 0.01 and len(packed) == 4000
    assert sum(sum(c.values()) for c in by.values()) / (500 * len(by)) > 0.98


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(2)
    for x in (rng.integers(1, 500, 400).astype(float), np.full(50, 7.0), np.array([3.0]), np.zeros(0)):
        p = np.full(len(x), 0.37)
        q = M.flight(p, x.tolist(), rng.random(max(1, len(x))))
        assert q.sum() == pytest.approx(p.sum()) and (q * x).sum() == pytest.approx((p * x).sum())
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
        assert set(M.landing(q, x)) <= {0.0, 1.0}


def test_mix_meets_shares_within_repeats(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "other", None]), rng.choice([None, rng.randint(1, 90)]), "y" * rng.randint(0, 50) if i % 31 else None, "clash") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, text string, base string")
    goals = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.28, 1), ("none", 0.02, 5)], "source string, target_share double, max_repeats int")
    size = {i: n if n is not None else len(t) + 1 for i, s, n, t, _ in rows if s in ("a", "b", "c") and (n is not None or t is not None)}
    total = sum(size.values())
    for block in (50, 100_000):
        copies, report = M.mix(df, goals, block_docs=block)
        got = {r["doc_id"]: r for r in copies.collect()}
        assert got.keys() == size.keys() and all(r["copies"] <= {"a": 1, "b": 3, "c": 1}[r["source"]] for r in got.values())
        rep = {r["source"]: r for r in report.collect()}
        had = collections.Counter()
        for i, s, *_ in rows:
            if i in size:
                had[s] += size[i]
        for s, share, most in (("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.28, 1), ("none", 0.02, 5)):
            short = had[s] * most < share * total
            assert rep[s]["short"] == short
            assert rep[s]["got_tokens"] == sum(r["copies"] * size[i] for i, r in got.items() if r["source"] == s)
            assert abs(rep[s]["got_tokens"] - (had[s] * most if short else share * total)) <= 90
    copies, report = M.mix(df.limit(0), goals)
    assert copies.count() == 0 and report.count() == 4
