"""Contracts where data enters, plans, provenance, rejected predictions and plug-ins."""

import json

import pytest
from corpusloom.functions import hashing, perturb
from corpusloom.operators import bundle, contracts, experiment, model, partitions, robustness
from corpusloom.sources import jsonl, tsv
from corpusloom.streaming import sessions
from pyspark.sql import functions as F

SMALL = {"labels": ("ink", "tea"), "vocabulary": ("w1:leaf", "w1:pen"), "idf": (1.0, 1.5), "weights": ((-2.0, 3.0), (2.5, -1.0)), "biases": (0.1, -0.1), "profile": "v3"}


def _lines(spark, corpus, rows):
    text = ["\t".join(corpus.columns), *["\t".join(r) for r in rows]]
    return spark.createDataFrame(list(enumerate(text, 1)), "line_no int, line string")


def test_loads_keep_the_corpus_contracts(spark):
    pairs = [(f"c{i}{v}", f"p{i}", v, "goal" if (v == "a") == (i % 2 == 0) else "reason", f"text {i} {v}") for i in range(4) for v in "ab"]
    assert tsv.load(_lines(spark, tsv.CONTRAST, pairs), tsv.CONTRAST).count() == 8
    with pytest.raises(contracts.ContractError, match="pairs"):
        tsv.load(_lines(spark, tsv.CONTRAST, pairs[:-1]), tsv.CONTRAST)
    assert tsv.load(_lines(spark, tsv.CONTRAST, pairs[:-1]), tsv.CONTRAST, contracts=False).count() == 7
    with pytest.raises(contracts.ContractError, match="five rows"):
        tsv.load(_lines(spark, tsv.LABELED, [("a", "goal", "one")]), tsv.LABELED)
    with pytest.raises(contracts.ContractError, match="1..2 rows"):
        tsv.load(_lines(spark, tsv.OOD, [(f"a{i}", f"t {i}") for i in range(3)]), tsv.OOD, 2)
    assert tsv.load(_lines(spark, tsv.OOD, [(f"a{i}", f"t {i}") for i in range(3)]), tsv.OOD, None).count() == 3
    grouped = [(f"g{y}{i}{k}", f"{y}-{i}", y, f"{y} {i} {k} {'same words here again' if i < 2 else chr(97 + 2 * i + k) * 9}") for y in ("goal", "reason") for i in range(4) for k in range(3)]
    with pytest.raises(contracts.ContractError, match="too alike"):
        tsv.load(_lines(spark, tsv.GROUPED, grouped), tsv.GROUPED)


def test_one_bad_line_in_three_has_no_common_key(spark):
    rows = [(f"i{k}", f"t {k}") if k % 3 else ("bad id", f"t {k}") for k in range(300)]
    got = tsv.parse(_lines(spark, tsv.OOD, rows), tsv.OOD)
    assert {r["reason"]: r["count"] for r in got.groupBy("reason").count().collect()} == {None: 200, "id": 100}


def test_audit_input_limits(spark, monkeypatch):
    lines = spark.createDataFrame([(i, "{}") for i in range(5)], "line_no int, line string")
    jsonl.require_limits(lines)
    monkeypatch.setattr(jsonl, "MAX_ROWS", 4)
    with pytest.raises(contracts.ContractError, match="4 lines"):
        jsonl.require_limits(lines)


def _plan(spark):
    rows = [(f"s{y}{i}{k}", f"{y}-{i}", y, f"{y} {i} {k} words") for y in ("goal", "reason") for i in range(10) for k in range(3)]
    supervised = spark.createDataFrame(rows, "id string, group_id string, label string, text string")
    supervised = supervised.join(partitions.group_split(supervised, 5), ["label", "group_id"])
    kinds = "id string, family_id string, domain_group string, stratum string, text string"
    outside = lambda p: spark.createDataFrame([(f"{p}{s}{f}{k}", f"{p}-{s}-{f}", f"{p}-{s}", s, f"{p} {s} {f} {k}") for s in ("semantic", "capability", "noise") for f in range(2) for k in range(3)], kinds)
    contrast = spark.createDataFrame([(f"c{i}{v}", f"p{i}", v, "goal" if v == "a" else "reason", f"pair {i} {v}") for i in range(3) for v in "ab"], "id string, pair_id string, variant_ab string, label string, text string")
    return supervised, outside("d"), outside("t"), contrast


def test_plan_contract_and_digest(spark):
    plan = _plan(spark)
    assert partitions.plan_violations(*plan, 5).count() == 0
    digest = partitions.plan_digest(*plan)
    assert digest == partitions.plan_digest(plan[0].repartition(3), *plan[1:]) and len(digest) == 64
    moved = plan[0].withColumn("part", F.when(F.col("group_id") == "goal-0", F.lit("train")).otherwise(F.col("part")))
    swapped = plan[0].withColumn("part", F.when(F.col("part") == "id-test", F.lit("development")).when(F.col("part") == "development", F.lit("id-test")).otherwise(F.col("part")))
    assert {r["rule"] for r in partitions.plan_violations(swapped, *plan[1:], 5).collect()} == {"assignment"}
    assert partitions.plan_digest(swapped, *plan[1:]) != digest and moved.count() == 60
    shared = plan[2].withColumn("domain_group", F.regexp_replace("domain_group", "^t", "d"))
    assert "overlap-group" in {r["rule"] for r in partitions.plan_violations(plan[0], plan[1], shared, plan[3], 5).collect()}
    twice = plan[3].unionByName(plan[3].limit(1).withColumn("text", F.lit("goal 0 0 words")))
    rules = {r["rule"] for r in partitions.plan_violations(plan[0], plan[1], plan[2], twice, 5).collect()}
    assert {"overlap-text", "contrast-repeated-id", "contrast-pair"} <= rules
    strange = plan[3].withColumn("label", F.when(F.col("label") == "goal", "other").otherwise(F.col("label")))
    assert "contrast-label" in {r["rule"] for r in partitions.plan_violations(plan[0], plan[1], plan[2], strange, 5).collect()}


def test_grid_policy_and_notes():
    experiment.check_grid((512, 1024), (0.0, 0.5), 0.005)
    for bad in (((), (0.1,), 0), ((64, 64), (0.1,), 0), ((16,), (0.1,), 0), ((64,), (0.2, 0.1), 0), ((64,), (2.0,), 0), ((64,), (0.1,), 0.1), (tuple(range(32, 41)), (0.1,), 0)):
        with pytest.raises(ValueError):
            experiment.check_grid(*bad)
    m = model.Model(**SMALL, dataset="a" * 64, split_plan="b" * 64)
    full = {"calibration": 1, "development": 2, "outside-development": 3}
    experiment.check_policy(m, "a" * 64, "b" * 64, full)
    with pytest.raises(ValueError, match="match"):
        experiment.check_policy(m, "a" * 64, "c" * 64, full)
    with pytest.raises(ValueError, match="without rows"):
        experiment.check_policy(m, "a" * 64, "b" * 64, full | {"calibration": 0})
    with pytest.raises(ValueError, match="digests"):
        model.Model(**SMALL, dataset="zz")
    good, poor = {"accuracy": 0.9, "macro_f1": 0.9}, {"accuracy": 0.9, "macro_f1": 0.8}
    assert len(experiment.limitations(good, poor)) == 3 and len(experiment.limitations(good | {"accuracy": 0.95}, poor)) == 2


def test_digest_shapes(spark):
    df = spark.createDataFrame([("a" * 64,), ("A" * 64,), ("fnv1a64:" + "0" * 16,), ("fnv1a64:0",), (None,)], "x string")
    assert [tuple(r) for r in df.select(hashing.valid_sha256(F.col("x")), hashing.valid_fingerprint(F.col("x"))).collect()] == [(True, False), (False, False), (False, True), (False, False), (False, False)]


def test_an_invalid_model_rejects(spark):
    rows = spark.createDataFrame([(1, "leaf")], "k int, text string")
    assert model.score_or_reject(rows, SMALL).first()["predicted"] == "tea"
    for bad, label in (({"idf": (1.0,)}, "ink"), ({"labels": ("", "x")}, "invalid-model"), ({"labels": ()}, "invalid-model"), ({"weights": None}, "ink")):
        r = model.score_or_reject(rows, SMALL | bad).first()
        assert (r["predicted"], r["accepted"], r["confidence"], r["probabilities"], r["top_features"]) == (label, False, 0.0, {label: 0.0}, [])


def test_perturbations_can_be_added(spark):
    cases = spark.createDataFrame([("a", "leaf pen"), ("b", "tea")], "id string, text string")
    perturb.register("doubled", "formatting", lambda x: F.when(F.length(x) > 3, F.concat(x, F.lit(" "), x)))
    try:
        with pytest.raises(ValueError):
            perturb.register("doubled", "formatting", lambda x: x)
        with pytest.raises(ValueError):
            perturb.register("other", "odd", lambda x: x)
        got = {r["id"]: r["variant"] for r in robustness.variants(cases).where("perturbation = 'doubled'").collect()}
        assert got == {"a": "leaf pen leaf pen", "b": None}
    finally:
        perturb.unregister("doubled")
    assert robustness.variants(cases).count() == 14


def test_populations_of_audits(spark, tmp_path):
    m = model.Model(**SMALL)
    cases = spark.createDataFrame([("a", "leaf pen"), ("b", "tea")], "id string, text string")
    assert robustness.audit_cases(cases, m).population == "provided-cases"
    with pytest.raises(ValueError):
        robustness.audit_cases(cases, m, "bundle-id-test")
    rows = [{"id": r["id"], "text": r["text"], "part": "id-test"} for r in cases.collect()]
    bundle.write(str(tmp_path / "b"), m, {"inside": {"n": 2}}, {"seed": 1, "assignments": rows})
    done = robustness.audit_bundle(spark, str(tmp_path / "b"))
    assert (done.population, done.inputs) == ("bundle-id-test", 2) and done.raw.count() == 7
    bundle.write(str(tmp_path / "c"), m, {"inside": {"n": 3}}, {"seed": 1, "assignments": rows})
    with pytest.raises(bundle.BundleError):
        robustness.audit_bundle(spark, str(tmp_path / "c"))


def test_streamed_audit_equals_the_batch(spark, tmp_path):
    m = model.Model(**SMALL)
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(json.dumps({"id": f"r{i}{k}", "text": f"leaf pen {k} {i}"}) for k in range(4)) + "\nbroken\n")
    stream = sessions.audit_stream(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), m)
    q = stream.writeStream.format("memory").queryName("audited").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = sessions.audit_stream(spark.read.text(str(tmp_path / "in")), m)
    key = lambda rows: sorted((r["perturbation"], r["evaluated_variants"], r["label_agreements"], round(r["js_sum"], 9)) for r in rows)
    assert key(spark.table("audited").collect()) == key(batch.collect()) and spark.table("audited").count() == 7
