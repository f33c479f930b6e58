"""Command line: ``python -m corpusloom COMMAND``. Exit status 0 on success, 1 on a failed check, 2 on wrong usage."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize
from .operators import bundle, digests, experiment, metrics, model, partitions, robustness, router, thresholds
from .operators.features import Vectorizer
from .sources import jsonl, sinks, tsv

KINDS = {"labeled": tsv.LABELED, "ood": tsv.OOD, "grouped": tsv.GROUPED, "openset-ood": tsv.OPENSET_OOD, "contrast": tsv.CONTRAST}


def session() -> SparkSession:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return tsv.load(tsv.read_lines(spark, path), KINDS[kind])


def _say(value: object) -> None:
    print(json.dumps(sinks.rounded(value), ensure_ascii=False))


def _fingerprint(rows: DataFrame) -> str:
    """The v1 fingerprint of a labelled corpus."""
    return digests.corpus_digest(rows, F.concat_ws("\t", "id", "label", normalize("text")), digests.fnv1a64)


def _table(title: str, values: dict) -> None:
    """A console summary: one line a value, nested ones below their name."""
    print(title)
    for k, v in values.items():
        if isinstance(v, dict):
            _table(f"  {k}", {f"  {a}": b for a, b in v.items()})
        else:
            print(f"  {k:<28} {v:.6f}" if isinstance(v, float) else f"  {k:<28} {v}")


def dataset_check(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = tsv.load(tsv.read_lines(spark, a.dataset), KINDS[a.kind], None if a.any_size else tsv.MAX_ROWS)
    _say({"rows": rows.count(), "labels": {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} if "label" in rows.columns else {}})


def _measured(rows: DataFrame, m: model.Model) -> dict:
    p = model.score(rows, m).withColumn("actual", F.col("label"))
    return metrics.accuracy_macro_f1(p).first().asDict() | metrics.selective(p).first().asDict()


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.distinct_paths([x for x in (a.dataset, a.ood, a.output, a.report) if x])
    rows = _load(spark, a.dataset, "labeled")
    split = rows.join(partitions.stratified_split(rows, a.seed, a.holdout, "id").select("id", "part"), "id").cache()
    training, holdout = split.where("part = 'train'"), split.where("part = 'holdout'")
    m = model.train(training, model.Training(a.epochs, a.learning_rate, a.l2), Vectorizer(max_features=a.max_features))
    outside = _load(spark, a.ood, "ood")
    inside = model.score(training, m).withColumn("hit", F.col("predicted") == F.col("label"))
    best = thresholds.select_v1(inside, model.score(outside, m).withColumn("hit", F.lit(False))).first()
    if best is None:
        raise ValueError("no pair of thresholds meets the limits")
    m = m.with_policy(min_confidence=best["confidence"], min_margin=best["margin"], dataset=_fingerprint(rows))
    report = {"train": _measured(training, m), "holdout": _measured(holdout, m), "ood": metrics.ood_summary(model.score(outside, m)).first().asDict()}
    ids = {part: sorted(r["id"] for r in split.where(F.col("part") == part).select("id").collect()) for part in ("train", "holdout")}
    bundle.write(a.output, m, report, {"seed": a.seed, "holdout": a.holdout, "epochs": a.epochs, "learning_rate": a.learning_rate, "l2": a.l2, "ids": ids})
    if a.report:
        sinks.write_all({a.report: sinks.canonical_json(sinks.rounded(report))})
    _say(report)


def train_v3(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.distinct_paths([a.dataset, a.ood_development, a.ood_test, a.contrast_test, a.output])
    m, report, plan = _experiment(spark, a, {"seed": a.seed, "epochs": a.epochs, "learning_rate": a.learning_rate, "l2": a.l2, "max_features": a.max_features, "bootstrap_resamples": a.bootstrap_resamples})
    bundle.write(a.output, m, report, plan)
    _say(report)


def _experiment(spark: SparkSession, a: argparse.Namespace, config: dict) -> tuple[model.Model, dict, dict]:
    """Model, report and plan of the whole experiment over four corpora that keep their contracts."""
    loaded = [_load(spark, p, k) for p, k in ((a.dataset, "grouped"), (a.ood_development, "openset-ood"), (a.ood_test, "openset-ood"), (a.contrast_test, "contrast"))]
    loaded[3] = loaded[3].withColumnRenamed("variant", "variant_ab")
    grid = {"features": (config["max_features"],)} if config["max_features"] else {}
    grid |= {"penalties": (config["l2"],)} if config["l2"] is not None else {}
    m, report = experiment.run(*loaded, config["seed"], config["bootstrap_resamples"], model.Training(config["epochs"], config["learning_rate"]), checks=True, **grid)
    parts = loaded[0].join(partitions.group_split(loaded[0], config["seed"]), ["label", "group_id"])
    # A corpus that keeps its contract has 100,000 rows at most.
    rows = [r.asDict() for r in parts.select("id", "group_id", "label", "part", "text").orderBy("id").toLocalIterator()]
    return m, report, config | {"assignments": rows}


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    m = bundle.verify(a.bundle)
    rows = _load(spark, a.dataset, "labeled" if m.profile == "v1" else "grouped")
    if m.profile == "v1" and m.dataset and not a.any_corpus:
        found = _fingerprint(rows)
        if found != m.dataset:
            raise ValueError(f"the model was trained on {m.dataset}, not on {found}")
    out = {"fingerprint": m.dataset, "rows": _measured(rows, m)}
    if a.ood:
        out["ood"] = metrics.ood_summary(model.score(_load(spark, a.ood, "ood"), m)).first().asDict()
    if a.summary:
        _table(f"model {a.bundle}", out)
        metrics.confusion(model.score(rows, m).withColumn("actual", F.col("label"))).orderBy("actual", "predicted").show(65536, False)
    else:
        _say(out)


def _reply(spark: SparkSession, text: str, turn: int, m: model.Model) -> dict:
    """The reply to one text: boundaries and safety first, and only then what the model says."""
    rows = model.score(spark.createDataFrame([(text, turn)], "text string, turn long"), m)
    r = router.model_route(rows, label="predicted", turn=F.col("turn")).withColumn("trace", router.trace_features(F.col("contrast"))).first()
    asked = r["rule_id"].startswith("ml-")
    trace = {k: r[k] for k in ("predicted", "accepted", "confidence", "margin", "probabilities")} | {"top_features": [f.asDict() for f in (r["trace"] if m.profile == "v3" else r["top_features"])]}
    return {"response": r["reply"], "boundary": r["rule_id"], "turn": turn, "keyword": r["keyword"], **(trace if asked else {"predicted": None, "accepted": False})}


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    said = _reply(spark, a.text, 1, bundle.verify(a.bundle))
    if a.summary:
        _table(said["response"], {k: v for k, v in said.items() if k not in ("response", "top_features")})
    else:
        print(json.dumps(said, ensure_ascii=False))


def _json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Valid lines in input order; the lowest bad one is an error that doesn't show its text."""
    lines = tsv.read_lines(spark, path)
    jsonl.require_limits(lines)
    parsed = jsonl.parse(lines)
    bad = parsed.where("reason IS NOT NULL").orderBy("line_no").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0]['line_no']}: {bad[0]['reason']}")
    return parsed.drop("reason")


def infer_batch(spark: SparkSession, a: argparse.Namespace) -> None:
    p = model.score(_json_rows(spark, a.input), bundle.verify(a.bundle))
    lines = sinks.json_lines(p, "id", ["predicted", "accepted", "confidence", "margin", "probabilities"], ["line_no"])
    if a.output:
        lines.write.text(a.output)
    else:
        for r in lines.toLocalIterator():
            print(r["value"])


def bundle_verify(spark: SparkSession, a: argparse.Namespace) -> None:
    m = bundle.verify(a.bundle)
    _say({"valid": True, "labels": list(m.labels), "features": len(m.vocabulary)})


def bundle_reproduce(spark: SparkSession, a: argparse.Namespace) -> None:
    """Trains a bundle's model again from its corpora and compares every number; for a v3 bundle its policy and metrics too."""
    m, plan = bundle.verify(a.bundle), bundle.plan(a.bundle)
    if m.profile == "v1":
        rows = _load(spark, a.dataset, "labeled")
        if m.dataset and _fingerprint(rows) != m.dataset:
            raise ValueError("the corpus isn't the one that the bundle names")
        ids = spark.createDataFrame([(i,) for i in plan["ids"]["train"]], "id string")
        again = model.train(rows.join(ids, "id", "left_semi"), model.Training(plan["epochs"], plan["learning_rate"], plan["l2"]), m.vectorizer)
        same = bundle.reproduced(a.bundle, again)
    else:
        if not (a.ood_development and a.ood_test and a.contrast_test):
            raise ValueError("a v3 bundle is reproduced from four corpora")
        again, report, assigned = _experiment(spark, a, {k: v for k, v in plan.items() if k != "assignments"})
        with open(f"{a.bundle}/metrics.json", encoding="utf-8") as f:
            stored = json.load(f)
        same = bundle.reproduced(a.bundle, again) and sinks.same_json(bundle.policy_json(m), bundle.policy_json(again)) and sinks.same_json(stored, json.loads(json.dumps(sinks.rounded(report)))) and assigned == plan
    if not same:
        raise ValueError("training again gives another bundle")
    _say({"reproduced": True})


def robustness_audit(spark: SparkSession, a: argparse.Namespace) -> None:
    gate = robustness.Gate(a.formatting_label, a.formatting_decision, a.formatting_js, a.typographic_label, a.typographic_decision, a.typographic_js)
    if bool(a.input) == a.bundle_id_test:
        raise ValueError("an audit takes --input or --bundle-id-test")
    done = robustness.audit_bundle(spark, a.bundle) if a.bundle_id_test else robustness.audit_cases(_json_rows(spark, a.input), bundle.verify(a.bundle), "jsonl")
    raw = done.raw
    slices = [r.asDict() for r in robustness.report(raw, ["perturbation", "family"]).collect()]
    families = [r.asDict() for r in robustness.report(robustness.merged(raw, ["family"]), ["family"]).collect()]
    _say({"population": done.population, "inputs": done.inputs, "families": families, "perturbations": slices})  # the evidence comes before the gate
    gate.enforce(raw)


def chat(spark: SparkSession, a: argparse.Namespace) -> None:
    """Replies to one text, or to lines from standard input until ``/quit``."""
    turn, m = 0, bundle.verify(a.bundle) if a.bundle else None
    for line in [a.once] if a.once is not None else sys.stdin:
        text = line.rstrip("\r\n")
        if text == "/quit":
            return
        turn += 1
        text = text if len(text.encode()) <= 2048 else "x" * 513
        if m is not None:
            said = _reply(spark, text, turn, m)
            print(f"{said['response']}\n  rule {said['boundary']}, keyword {said['keyword']}, turn {turn}", flush=True)
            continue
        r = router.rule_route(spark.createDataFrame([(text, turn)], "text string, turn long"), "text", F.col("turn")).first()
        print(f"{r['reply']}\n  rule {r['rule_id']}, keyword {r['keyword']}, fragment {r['fragment']}, turn {turn}", flush=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(dest="command", required=False)
    p.set_defaults(run=chat, once=None, bundle=None)  # without a command: chat by the rules

    def command(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flags, more in options:
            c.add_argument(flags, **more)

    need = {"required": True}
    flag = {"action": "store_true"}
    number = lambda t, d: {"type": t, "default": d}
    command("dataset-check", dataset_check, ("--dataset", need), ("--kind", {"choices": sorted(KINDS), "default": "labeled"}), ("--any-size", flag))
    command("train", train, ("--dataset", need), ("--ood", need), ("--output", need), ("--report", {}), ("--seed", number(int, 20260722)), ("--epochs", number(int, 600)), ("--learning-rate", number(float, 0.8)), ("--l2", number(float, 0.0005)), ("--holdout", number(float, 0.2)), ("--max-features", number(int, 512)))
    command("train-v3", train_v3, ("--dataset", need), ("--ood-development", need), ("--ood-test", need), ("--contrast-test", need), ("--output", need), ("--seed", number(int, 4043100207104787)), ("--epochs", number(int, 600)), ("--learning-rate", number(float, 0.8)), ("--l2", number(float, None)), ("--max-features", number(int, None)), ("--bootstrap-resamples", number(int, 1000)))
    command("evaluate", evaluate, ("--bundle", need), ("--dataset", need), ("--ood", {}), ("--any-corpus", flag), ("--summary", flag))
    command("infer", infer, ("--bundle", need), ("--summary", flag), ("text", {}))
    command("infer-batch", infer_batch, ("--bundle", need), ("--input", need), ("--output", {}))
    command("bundle-verify", bundle_verify, ("--bundle", need))
    command("bundle-reproduce", bundle_reproduce, ("--bundle", need), ("--dataset", need), ("--ood-development", {}), ("--ood-test", {}), ("--contrast-test", {}))
    command("robustness-audit", robustness_audit, ("--bundle", need), ("--input", {}), ("--bundle-id-test", flag), *[(f"--{f}-{k}", number(float, d)) for f, k, d in (("formatting", "label", 1.0), ("formatting", "decision", 1.0), ("formatting", "js", 0.0), ("typographic", "label", None), ("typographic", "decision", None), ("typographic", "js", None))])
    command("chat", chat, ("--once", {}), ("--bundle", {}))
    return p


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        a.run(spark or session(), a)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
