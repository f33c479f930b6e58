import json
import math
import os

import numpy as np
import pytest
from corpusloom.operators import bootstrap, bundle, features, model, robustness
from corpusloom.operators.features import Vectorizer
from corpusloom.sources import sinks
from pyspark.sql import functions as F

ROWS = [(f"r{i}", label, text) for i, (label, text) in enumerate([("tea", "green tea leaf"), ("tea", "tea pot"), ("tea", "a tea cup"), ("ink", "black ink pen"), ("ink", "ink well"), ("ink", "an ink blot"), (None, "lost"), ("ink", None)])]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, label string, text string")


@pytest.fixture(scope="module")
def small(rows):
    return model.train(rows, model.Training(epochs=30), Vectorizer(max_features=64))


def test_training_is_deterministic_and_learns(spark, rows, small):
    assert model.train(rows.repartition(3), model.Training(epochs=30), Vectorizer(max_features=64)) == small
    got = model.score(rows.where("label IS NOT NULL AND text IS NOT NULL"), small).collect()
    assert all(r["predicted"] == r["label"] for r in got)


def test_descent_matches_plain_loops():
    rng = np.random.default_rng(1)
    n, f, k = 9, 6, 3
    x = (rng.random((n, f)) < 0.6) * rng.random((n, f))
    y = rng.integers(0, k, n)
    row, position = np.nonzero(x)
    w, b = model.descend(row, position, x[row, position], y, k, f, model.Training(epochs=4))
    v, c = np.zeros((k, f)), np.zeros(k)
    for epoch in range(4):
        gw, gb = np.zeros((k, f)), np.zeros(k)
        for i in range(n):
            z = [c[q] + sum(v[q][j] * x[i][j] for j in range(f)) for q in range(k)]
            e = [math.exp(t - max(z)) for t in z]
            for q in range(k):
                err = e[q] / sum(e) - (q == y[i])
                gb[q] += err
                gw[q] += err * x[i]
        rate = 0.8 / math.sqrt(1 + epoch * 0.025)
        c = np.round(c - rate * gb / n, 12)
        v = np.round(v - rate * (gw / n + 0.0005 * v), 12)
    assert np.allclose(w, v, atol=2e-12) and np.allclose(b, c, atol=2e-12)


def test_scores_of_odd_texts(spark, small):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "🪐", 7), (4, "tea " * 5000, 8)], "i int, text string, confidence int")
    got = {r["i"]: r for r in model.score(df, small).collect()}
    for i in (1, 2, 3):
        assert not got[i]["accepted"] and not got[i]["has_features"] and got[i]["top_features"] == []
    assert got[4]["predicted"] == "tea" and sum(got[4]["probabilities"].values()) == pytest.approx(1)
    assert got[4]["reconstructed_margin"] == pytest.approx(got[4]["logit_margin"])
    assert model.score(df.limit(0), small).count() == 0


def test_v3_counts_long_texts_as_empty(spark, small):
    from dataclasses import replace

    df = spark.createDataFrame([(1, "tea " * 200)], "i int, text string")
    assert not model.score(df, replace(small, profile="v3")).first()["has_features"]


def test_vocabulary_ties_and_bounds(spark):
    df = spark.createDataFrame([(1, "b a"), (2, "a b"), (3, None), (4, "")], "i int, text string")
    v = features.fit(df, "i", vectorizer=Vectorizer(max_features=32)).orderBy("position").collect()
    assert [r["df"] for r in v] == sorted([r["df"] for r in v], reverse=True)
    same = [r["term"] for r in v if r["df"] == 2]
    assert same == sorted(same)
    with pytest.raises(ValueError):
        Vectorizer(max_features=8)
    assert features.fit(df.limit(0), "i").count() == 0


def test_damaged_models_are_rejected(small):
    from dataclasses import replace

    for bad in ({"idf": small.idf[1:]}, {"biases": (float("nan"), 0.0)}, {"labels": ("ink", "ink")}, {"temperature": 0.0}, {"weights": small.weights[:1]}):
        with pytest.raises(ValueError):
            replace(small, **bad)


def test_bundle_round_trip_and_tampering(spark, small, tmp_path):
    path = str(tmp_path / "bundle")
    bundle.write(path, small, {"accuracy": 1 / 3}, {"seed": 1})
    assert bundle.verify(path) == small and bundle.reproduced(path, small)
    assert json.load(open(f"{path}/metrics.json"))["accuracy"] == 0.333333333
    got = {r["name"]: r["digest"] for r in bundle.digests(spark, path).collect()}
    stated = json.load(open(f"{path}/manifest.json"))["files"]
    assert {k: got[k] for k in stated} == stated
    bundle.write(path, small.with_policy(min_margin=0.5), {}, {})
    with open(f"{path}/policy.json", "a") as f:
        f.write(" ")
    with pytest.raises(bundle.BundleError):
        bundle.verify(path)
    other = tmp_path / "other"
    other.mkdir()
    (other / "note.txt").write_text("mine")
    with pytest.raises(bundle.BundleError):
        bundle.write(str(other), small, {}, {})
    assert (other / "note.txt").read_text() == "mine"


def test_paired_files_roll_back(tmp_path):
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    sinks.write_all({a: "1", b: "2"})
    with pytest.raises(OSError):
        sinks.write_all({a: "3", b: "4"}, fail_after=1)
    assert (open(a).read(), open(b).read()) == ("1", "2") and sorted(os.listdir(tmp_path)) == ["a.json", "b.json"]
    os.symlink(a, tmp_path / "c.json")
    with pytest.raises(ValueError):
        sinks.write_all({a: "5", str(tmp_path / "c.json"): "6"})


def test_audit_of_stable_formats_and_gate(spark, small):
    from dataclasses import replace

    cases = spark.createDataFrame([("a", "green tea leaf"), ("b", "black ink pen"), ("c", "tea")], "id string, text string")
    robustness.validate_cases(cases)
    raw = robustness.audit(cases, replace(small, profile="v3"))
    by = {r["perturbation"]: r for r in robustness.report(raw, ["perturbation", "family"]).collect()}
    assert len(by) == 7
    for name in ("ascii-letter-case", "horizontal-whitespace", "unicode-compatibility-width", "terminal-punctuation"):
        assert by[name]["label_agreement"] == 1.0 and by[name]["maximum_normalized_js_divergence"] == 0.0
    assert by["single-character-deletion"]["skipped_applications"] == 1
    robustness.Gate().enforce(raw)
    with pytest.raises(robustness.GateError):
        robustness.Gate().enforce(raw.withColumn("js_max", F.lit(0.4e-9)))
    with pytest.raises(robustness.GateError):
        robustness.Gate().enforce(raw.limit(0))
    with pytest.raises(ValueError):
        robustness.Gate(formatting_js=2.0)
    fam = robustness.report(robustness.merged(raw, ["family"]), ["family"])
    rep = robustness.report(raw, ["perturbation", "family"])
    assert robustness.inconsistencies(rep, fam).count() == 0
    assert robustness.inconsistencies(rep, fam.withColumn("label_flips", F.col("label_flips") + 1)).count() == 2


def test_cases_are_checked_without_showing_text(spark):
    from corpusloom.operators.contracts import ContractError

    for bad in ([("a", "secret"), ("a", "x")], [("a b", "secret")], [("a", " ")], [("a", None)], []):
        with pytest.raises(ContractError) as e:
            robustness.validate_cases(spark.createDataFrame(bad, "id string, text string"))
        assert "secret" not in str(e.value)


def test_bootstrap_weights_follow_the_draws(spark):
    clusters = spark.createDataFrame([("0|a", "f1"), ("0|a", "f2"), ("0|b", "f3"), ("1|", "d1"), ("1|", "d2")], "stratum string, cluster string")
    w = bootstrap.weights(clusters, 100, 5).collect()
    per = {}
    for r in w:
        per[r["resample"], r["stratum"]] = per.get((r["resample"], r["stratum"]), 0) + r["times"]
    assert len(per) == 300 and all(n == {"0|a": 2, "0|b": 1, "1|": 2}[s] for (_, s), n in per.items())
    with pytest.raises(ValueError):
        bootstrap.cluster_bootstrap(spark.range(0), spark.range(0), 5)


def _close(a, b):
    return (a.labels, a.vocabulary, a.idf) == (b.labels, b.vocabulary, b.idf) and np.allclose(a.weights, b.weights, rtol=0, atol=1e-9) and np.allclose(a.biases, b.biases, rtol=0, atol=1e-9)


def test_training_takes_all_rows_beyond_max_rows(spark, monkeypatch):
    texts = [(f"r{i}", ("tea", "ink", "oak")[i % 3], f"{('green', 'black', 'tall')[i % 3]} w{i % 7} {'x' * (i % 5)} n{i}") for i in range(700)]
    df = spark.createDataFrame(texts, "id string, label string, text string")
    config, v = model.Training(epochs=6), Vectorizer(max_features=40)
    whole = model.train(df, config, v)
    # The descent over the features of all rows, in one process.
    terms = spark.createDataFrame(list(enumerate(whole.vocabulary)), "position int, term string").withColumn("idf", F.element_at(F.array(*map(F.lit, whole.idf)), F.col("position") + 1))
    made = sorted(features.transform(df, terms, "id", vectorizer=v).collect(), key=lambda r: r["id"])
    label = {i: whole.labels.index(y) for i, y, _ in texts}
    flat = [(n, f["position"], f["value"]) for n, r in enumerate(made) for f in r["features"]]
    row, position, value = (np.array(x) for x in zip(*flat))
    w, b = model.descend(row, position, value, np.array([label[r["id"]] for r in made]), 3, 40, config)
    assert np.allclose(whole.weights, w, rtol=0, atol=1e-9) and np.allclose(whole.biases, b, rtol=0, atol=1e-9)
    # Blocks of about 50 rows, one job per epoch: a bound on a block's rows leaves none out.
    small = model.Training(epochs=6, max_rows=50)
    spread = model.train(df, small, v)
    assert _close(spread, whole) and model.train(df.repartition(7), small, v) == spread
    grid = [(Vectorizer(max_features=n), model.Training(epochs=6, l2=l2)) for n in (32, 40) for l2 in (0.0001, 0.002)]
    here = model.train_candidates(df, grid, "v3", "id", "label", "text")
    monkeypatch.setattr(model, "LOCAL_WORK", 1)
    assert all(_close(x, y) for x, y in zip(model.train_candidates(df, grid, "v3", "id", "label", "text"), here))
    assert all(_close(x, model.train(df, c, n, "v3")) for x, (n, c) in zip(here, grid))


def test_rows_with_one_id_and_one_text_count_each(spark):
    rows = [("a", "tea", "green tea"), ("a", "ink", "black ink"), (None, "tea", "tea pot"), (None, "ink", "ink well"), ("b", "ink", "green tea"), ("c", "tea", "green tea")]
    df = spark.createDataFrame(rows, "id string, label string, text string")
    own = df.withColumn("id", F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string")))
    config, v = model.Training(epochs=5), Vectorizer(max_features=32)
    m = model.train(df, config, v)
    assert model.train(own, config, v) == m
    # Every word pair's frequency counts all rows, the repeated text three times.
    assert m.idf[m.vocabulary.index("w2:green_tea")] == pytest.approx(math.log(7 / 4) + 1)
