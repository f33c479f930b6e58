"""Model bundles: a folder of JSON payloads under a manifest of their digests.

A bundle is valid if it holds exactly its files, all regular and of their stated digests, and a model and policy that
pass their own checks. Verification can also train again from the same rows and compare.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import canonical_json, digest, replace_folder, rounded, same_json
from .features import Vectorizer
from .model import Model

PAYLOADS = ("metrics.json", "model.json", "policy.json", "split-plan.json")
MANIFEST = "manifest.json"
MAX_BYTES = 64 << 20


class BundleError(ValueError):
    """A bundle isn't what its manifest says."""


def model_json(model: Model) -> dict:
    v = model.vectorizer
    return {
        "profile": model.profile, "labels": list(model.labels), "vocabulary": list(model.vocabulary), "idf": list(model.idf), "weights": [list(w) for w in model.weights], "biases": list(model.biases),
        "vectorizer": {"word": list(v.word), "char": list(v.char), "max_features": v.max_features, "min_df": v.min_df},
    }


def policy_json(model: Model) -> dict:
    return {"temperature": model.temperature, "min_confidence": model.min_confidence, "min_margin": model.min_margin, "dataset": model.dataset, "split_plan": model.split_plan}


def _strict(value: dict, keys: set[str], what: str) -> dict:
    if not isinstance(value, dict) or set(value) != keys:
        raise BundleError(f"{what} must have exactly the fields {sorted(keys)}")
    return value


def model_from(model: dict, policy: dict) -> Model:
    m = _strict(model, {"profile", "labels", "vocabulary", "idf", "weights", "biases", "vectorizer"}, "model")
    v = _strict(m["vectorizer"], {"word", "char", "max_features", "min_df"}, "vectorizer")
    p = _strict(policy, {"temperature", "min_confidence", "min_margin", "dataset", "split_plan"}, "policy")
    return Model(tuple(m["labels"]), tuple(m["vocabulary"]), tuple(m["idf"]), tuple(map(tuple, m["weights"])), tuple(m["biases"]), m["profile"], Vectorizer(tuple(v["word"]), tuple(v["char"]), v["max_features"], v["min_df"]), **p)


def write(path: str, model: Model, metrics: dict, split_plan: dict) -> None:
    """Writes a bundle: payloads first, then the manifest, verified and swapped in."""
    files = {"metrics.json": canonical_json(rounded(metrics)), "model.json": canonical_json(model_json(model)), "policy.json": canonical_json(policy_json(model)), "split-plan.json": canonical_json(split_plan)}
    files[MANIFEST] = canonical_json({"files": {name: digest(text.encode()) for name, text in sorted(files.items())}})
    replace_folder(path, files, verify)


def verify(path: str) -> Model:
    """The bundle's model, or :class:`BundleError`."""
    found = sorted(os.listdir(path))
    if found != sorted([*PAYLOADS, MANIFEST]):
        raise BundleError(f"a bundle holds exactly {sorted([*PAYLOADS, MANIFEST])}, not {found}")
    data = {}
    for name in found:
        full = os.path.join(path, name)
        if os.path.islink(full) or not os.path.isfile(full) or os.path.getsize(full) > MAX_BYTES:
            raise BundleError(f"{name} must be a regular file of {MAX_BYTES} bytes at most")
        with open(full, "rb") as f:
            data[name] = f.read()
    listed = _strict(json.loads(data[MANIFEST]), {"files"}, "manifest")["files"]
    if set(listed) != set(PAYLOADS):
        raise BundleError("the manifest lists other files")
    for name in PAYLOADS:
        if not re.fullmatch("[0-9a-f]{64}", str(listed[name])):
            raise BundleError(f"{name} has no digest in the manifest")
        if digest(data[name]) != listed[name]:
            raise BundleError(f"{name} has another digest than the manifest says")
    try:
        return model_from(json.loads(data["model.json"]), json.loads(data["policy.json"]))
    except (ValueError, TypeError, KeyError) as e:
        raise BundleError(str(e)) from e


def reproduced(path: str, again: Model) -> bool:
    """Whether a model trained again has the bundle's model, number by number within 2e-9."""
    return same_json(model_json(verify(path)), model_json(again))


def plan(path: str) -> dict:
    """The split plan of a verified bundle."""
    verify(path)
    with open(os.path.join(path, "split-plan.json"), encoding="utf-8") as f:
        return json.load(f)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``name``, ``digest``, ``bytes`` of all files in a folder, read in parallel."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))
