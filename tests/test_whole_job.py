"""Registered queries do the whole job: no cut rows, epochs, lengths, clusters or corpora."""

import hashlib
import inspect

import pytest
from corpusloom.functions import hashing
from corpusloom.operators import bootstrap, digests, experiment, model
from corpusloom.operators.features import Vectorizer
from corpusloom.operators.model import Training
from corpusloom.plans import model_queries
from pyspark.sql import functions as F

from test_queries import FOLDER, pytestmark  # noqa: F401


def test_experiment_runs_with_its_own_defaults(spark, monkeypatch):
    seen = {}
    signature = inspect.signature(experiment.run)

    def run(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise StopIteration

    monkeypatch.setattr(experiment, "run", run)
    with pytest.raises(StopIteration):
        model_queries.run_experiment(spark, FOLDER)
    assert seen["config"] == Training() and seen["config"].max_rows == 100_000 and seen["config"].epochs == 600
    assert seen["features"] == (512, 1024, 2048) and len(seen["penalties"]) == 3


def test_bootstrap_has_no_bound_on_draws(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "MAX_SAMPLED", 10, raising=False)
    clusters = spark.range(7).selectExpr("concat('0|', id % 2) AS stratum", "concat('f', id) AS cluster")
    got = bootstrap.weights(clusters, 100, 5).groupBy("stratum").agg({"times": "sum"}).collect()
    assert {r[0]: r[1] for r in got} == {"0|0": 400, "0|1": 300}


@pytest.mark.parametrize("name", ["train_softmax", "evaluate_v1", "evaluate_id", "calibrate_temperature", "select_candidate"])
def test_training_queries_use_the_defaults(spark, monkeypatch, name):
    seen = {}

    def captured(f):
        signature = inspect.signature(f)

        def call(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            seen.update(bound.arguments)
            raise StopIteration

        return call

    monkeypatch.setattr(model, "train", captured(model.train))
    monkeypatch.setattr(experiment, "select_model", captured(experiment.select_model))
    with pytest.raises(StopIteration):
        model_queries.QUERIES[name](spark, FOLDER)
    assert seen["config"] == Training()
    assert seen.get("vectorizer", Vectorizer()) == Vectorizer()
    assert seen.get("features", (512, 1024, 2048)) == (512, 1024, 2048) and seen.get("penalties", (0.0001, 0.0005, 0.002)) == (0.0001, 0.0005, 0.002)


def test_digests_of_whole_corpora(spark):
    n = 100_200  # more than the aggregates take
    lines = spark.range(n).selectExpr("concat('é', id * 7919 % 100003) AS x").repartition(7)
    joined = "\n".join(sorted(f"é{i * 7919 % 100_003}" for i in range(n))).encode()
    h = 0xCBF29CE484222325
    for byte in joined:
        h = (h ^ byte) * 0x100000001B3 % (1 << 64)
    assert digests.corpus_digest(lines, lines["x"], digests.sha256) == hashlib.sha256(joined).hexdigest()
    assert digests.corpus_digest(lines, lines["x"], digests.fnv1a64) == f"fnv1a64:{h:016x}"
    two = lines.withColumn("g", F.when(F.col("x") == "é0", "b").otherwise("a"))
    assert dict(digests.grouped_digests(two, "g", F.col("x"), digests.sha256, "h").collect()) == {
        "a": hashlib.sha256(joined.removeprefix("é0\né0\n".encode())).hexdigest(), "b": hashlib.sha256("é0\né0".encode()).hexdigest()
    }
    small = lines.limit(50)
    assert digests.corpus_digest(small, F.col("x"), digests.sha256) == small.agg(hashing.dataset_sha256(F.col("x"))).first()[0]
    assert digests.corpus_digest(small, F.col("x"), digests.fnv1a64) == small.agg(hashing.dataset_fingerprint(F.col("x"))).first()[0]
