import math

import pytest
from corpusloom.operators import baselines, calibrate, contracts, metrics, partitions, similarity, thresholds
from corpusloom.operators.ranking import ranked, running_sums
from pyspark.sql import functions as F


def test_ranking_quality_constants(spark):
    s = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "score double, positive boolean")
    r = metrics.ranking_quality(s).first()
    assert r["auroc"] == pytest.approx(0.875) and r["aupr"] == pytest.approx(5 / 6) and r["fpr95"] == pytest.approx(0.5)
    empty = metrics.ranking_quality(s.limit(0))
    assert [tuple(x) for x in empty.collect()] in ([], [(0.0, 0.0, 0.0)])


def test_risk_coverage_constants(spark):
    rows = [(0.9, "a", "a"), (0.5, "a", "a"), (0.5, "a", "b"), (0.1, "a", "b")]
    p = spark.createDataFrame(rows, "confidence double, actual string, predicted string")
    assert [r["covered"] for r in metrics.risk_coverage(p).orderBy("covered").collect()] == [1, 3, 4]
    assert metrics.area_under_risk(p).first()[0] == pytest.approx(7 / 24)


def test_nothing_accepted_has_null_accuracy(spark):
    p = spark.createDataFrame([("a", "a", False), (None, "a", True)], "actual string, predicted string, accepted boolean")
    r = metrics.selective(p).first()
    assert (r["n"], r["accepted"], r["coverage"], r["selective_accuracy"]) == (1, 0, 0.0, None)


def test_macro_f1_counts_labels_without_support(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b")], "actual string, predicted string")
    assert metrics.accuracy_macro_f1(p).first()["macro_f1"] == pytest.approx((2 / 3) / 2)


def test_percentiles(spark):
    s = spark.range(100).select(F.col("id").cast("double").alias("v"))
    r = metrics.percentile_interval(s, "v").first()
    assert (r["low"], r["high"]) == (2.0, 97.0)


def test_ranks_and_sums_across_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).alias("o"))
    df = df.unionByName(spark.createDataFrame([(None, 5), (None, 3)], "g long, o long"))
    got = ranked(df, ["g"], [F.col("o")]).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["o"], r["rank"]))
    for rows in by.values():
        assert [k for _, k in sorted(rows)] == list(range(1, len(rows) + 1))
    up = running_sums(df.where("g = 1"), [], [F.desc("o")], {"s": F.col("o")}).orderBy(F.desc("o")).collect()
    total = 0
    for r in up:
        total += r["o"]
        assert r["s"] == total
    assert ranked(df.limit(0), ["g"], [F.col("o")]).count() == 0


def test_quota(spark):
    df = spark.createDataFrame([(g,) for g in (4, 8, 15, 100, 20000)], "g int")
    assert [r[0] for r in df.select(partitions.group_quota(F.col("g"))).collect()] == [1, 1, 2, 10, 2000]


def test_group_split_counts(spark):
    rows = [(f"{x}-{g}-{i}", f"f{g}", x, f"t {x} {g} {i}") for x in "abcdefg" for g in range(15) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, group_id string, label string, text string")
    split = df.join(partitions.group_split(df, 7), ["label", "group_id"])
    assert {r["part"]: r["count"] for r in split.groupBy("part").count().collect()} == {"train": 315, "development": 70, "calibration": 70, "id-test": 70}
    plan = split.withColumn("split_name", F.col("part")).withColumn("row_no", F.col("id")).withColumn("group_id", F.concat("label", F.lit("-"), "group_id"))
    assert partitions.split_plan_violations(plan).count() == 0


def test_contracts_raise_with_the_smallest(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "a"), (4, None, "a"), (5, None, "b")], "r int, g string, l string")
    assert [r["g"] for r in contracts.label_conflicts(df, "g", "l").collect()] == ["x"]
    with pytest.raises(contracts.ContractError):
        contracts.require(contracts.label_conflicts(df, "g", "l"), "labels")
    contracts.require(contracts.label_conflicts(df.limit(0), "g", "l"), "labels")
    assert contracts.mismatch(df, df).count() == 0
    assert {r["problem"] for r in contracts.reconcile(df.where("r < 3"), df.where("r > 1").withColumn("g", F.lit("z")), "r", ["g"]).collect()} == {"missing-left", "missing-right", "differs"}


def test_similarity_is_exact(spark):
    import itertools
    import random

    rng = random.Random(5)
    sets = [sorted({f"w{rng.randint(0, 14)}" for _ in range(rng.randint(1, 12))}) for _ in range(60)] + [["w1", "w2"]] * 4 + [[]]
    rows = [(i, f"g{i % 5}" if i % 7 else None, m) for i, m in enumerate(sets)]
    df = spark.createDataFrame(rows, "k int, g string, m array<string>")
    for t in (0.5, 0.8, 1.0):
        want = {}
        for (i, g, a), (j, h, b) in itertools.permutations(rows, 2):
            if a and b and (g is None or h is None or g != h) and len({*a} & {*b}) >= t * len({*a} | {*b}) - 1e-12:
                want[i] = want.get(i, 0) + 1
        assert {r["k"]: r["links"] for r in similarity.similar_row_links(df, "k", "g", "m", t).collect()} == want


def test_family_leaks_against_brute_force(spark):
    import random

    from corpusloom.functions.text import extract_terms, tokens

    rng = random.Random(6)
    texts = [" ".join(rng.choice("tea ink pen cup leaf pot jug oak elm ash".split()) for _ in range(rng.randint(1, 7))) for _ in range(70)] + ["", None]
    df = spark.createDataFrame([(f"i{i}", f"g{i % 9}", "xy"[i % 2], t, "clash") for i, t in enumerate(texts)], "id string, group_id string, label string, text string, members string")
    got = {(r["id"], r["kind"]): r["links"] for r in similarity.family_leaks(df).collect()}
    rows = [(r["id"], r["group_id"], r["label"], {*r["m"]}) for r in df.where("text IS NOT NULL").select("*", extract_terms(tokens("text")).alias("m")).collect()]
    families = {}
    for _, g, y, m in rows:
        for x in m:
            families.setdefault((y, x), set()).add(g)
    rest = [(i, g, y, {x for x in m if len(families[y, x]) < 3}) for i, g, y, m in rows]
    want = {}
    for kind, of, limit in (("raw", rows, 0.3), ("residual", rest, 0.25)):
        for i, g, y, a in of:
            n = sum(g != h and (kind == "raw" or y == z) and bool(a and b) and len(a & b) >= limit * len(a | b) - 1e-12 for _, h, z, b in of)
            if n:
                want[i, kind] = n
    assert got == want and {k for _, k in got} == {"raw", "residual"}


def test_candidate_choice():
    c = lambda n, l2, f: calibrate.Candidate(n, l2, 0.9, f, 0.1, 0.1)
    big = c(2048, 0.0001, 0.900)
    assert calibrate.select_candidate([big, c(512, 0.002, 0.896)]) == 1
    assert calibrate.select_candidate([big, c(512, 0.002, 0.894)]) == 0


def test_temperature_finds_the_scale():
    import numpy as np

    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 3)) * 4
    p = np.exp(z / 2) / np.exp(z / 2).sum(1, keepdims=True)
    target = np.array([rng.choice(3, p=q) for q in p])
    assert 1.4 < calibrate.best_temperature(z, target) < 2.8

    def loss(t):
        e = np.exp(z / t)
        return -np.log(e[np.arange(400), target] / e.sum(1)).mean()

    best = calibrate.best_temperature(z, target)
    assert loss(best) <= min(loss(t) for t in np.linspace(best * 0.99, best * 1.01, 101)) + 1e-12
    assert calibrate.best_temperature(z, z.argmax(1)) == 0.05 and calibrate.best_temperature(z, z.argmin(1)) == 20.0


def test_temperature_over_all_rows(spark):
    import numpy as np
    from corpusloom.operators.model import Model, score

    m = Model(("ink", "tea"), ("w1:leaf", "w1:pen"), (1.0, 1.5), ((-2.0, 3.0), (2.5, -1.0)), (0.1, -0.1))
    rows = spark.createDataFrame([(i, "ink" if i % 3 else "tea", ["leaf", "pen", "leaf pen pen", ""][i % 4], "clash") for i in range(300)] + [(900, None, "leaf", "x"), (901, "ink", None, "x")], "id long, label string, text string, k string")
    got = calibrate.calibrate_temperature(rows.repartition(5), m).first()
    kept = score(rows.where("id < 900"), m).collect()
    want = calibrate.best_temperature(np.array([r["logits"] for r in kept]), np.array([("ink", "tea").index(r["label"]) for r in kept]))
    assert got["n"] == 300 and abs(got["temperature"] - want) < 1e-9
    with pytest.raises(ValueError, match="no label"):
        calibrate.calibrate_temperature(rows.selectExpr("id", "'cup' AS label", "text"), m)
    with pytest.raises(ValueError, match="rows"):
        calibrate.calibrate_temperature(rows.limit(0), m)


def test_majority_and_naive_bayes(spark):
    train = spark.createDataFrame([(1, "alpha", "red red"), (2, "alpha", "red blue"), (3, "beta", "green tea"), (4, "beta", "green leaf")], "row_no int, label string, text string")
    test = spark.createDataFrame([(1, "a red one"), (2, "green"), (3, ""), (4, None)], "row_no int, text string")
    assert baselines.majority(train).first()["label"] == "alpha"
    got = {r["row_no"]: (r["predicted"], r["score"]) for r in baselines.naive_bayes(train, test).collect()}
    assert got[1][0] == "alpha" and got[2][0] == "beta" and got[3][0] == "alpha" and 4 not in got
    assert got[3][1] == pytest.approx(math.log(3 / 6))


def test_naive_bayes_by_names_with_a_hot_word(spark):
    train = spark.createDataFrame([(f"t{i}", "alpha" if i % 2 else "beta", f"the {'red' if i % 2 else 'green'} w{i}") for i in range(600)], "id string, label string, text string")
    test = spark.createDataFrame([("x-1", "the red one"), ("x-2", "the green"), ("x-3", "")], "id string, text string")
    assert {r["id"]: r["predicted"] for r in baselines.naive_bayes(train, test, "id").collect()} == {"x-1": "alpha", "x-2": "beta", "x-3": "alpha"}
    assert baselines.naive_bayes(train.limit(0), test, "id").count() == 0


def test_threshold_grid_without_rows(spark):
    s = spark.createDataFrame([(0.9, 0.5, True)], "confidence double, margin double, hit boolean")
    assert thresholds.select_v3(s, s.limit(0)).first()["feasible"] > 0
    assert thresholds.select_v3(s.limit(0), s).count() == 0
