import json
import random

import pytest
from corpusloom.__main__ import main

WORDS = {"tea": ["green tea leaf", "tea pot here", "a tea cup", "hot tea now", "tea for two", "iced tea jug"], "ink": ["black ink pen", "ink well", "an ink blot", "blue ink jar", "ink on paper", "dry ink pad"]}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    lines = ["id\tlabel\ttext"] + [f"{k}-{i}\t{k}\t{t}" for k, ts in WORDS.items() for i, t in enumerate(ts)]
    (d / "rows.tsv").write_text("\n".join(lines) + "\n")
    (d / "ood.tsv").write_text("id\ttext\no-1\tzebra quilt\no-2\tvolcano\n")
    (d / "cases.jsonl").write_text("\n".join(json.dumps({"id": f"c{i}", "text": t}) for i, t in enumerate(["green tea leaf", "black ink pen"])) + "\n")
    (d / "bad.jsonl").write_text('{"id":"a","text":"secret"}\n{"id":"a"}\n')
    return d


def run(spark, capsys, *arguments):
    code = main(list(map(str, arguments)), spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_train_verify_reproduce_infer_audit(spark, capsys, corpus):
    b = corpus / "bundle"
    assert run(spark, capsys, "dataset-check", "--dataset", corpus / "rows.tsv")[0] == 0
    code, out, _ = run(spark, capsys, "train", "--dataset", corpus / "rows.tsv", "--ood", corpus / "ood.tsv", "--output", b, "--epochs", 80, "--max-features", 64)
    assert code == 0 and json.loads(out)["train"]["n"] == 10
    first = (b / "model.json").read_bytes()
    assert run(spark, capsys, "train", "--dataset", corpus / "rows.tsv", "--ood", corpus / "ood.tsv", "--output", b, "--epochs", 80, "--max-features", 64)[0] == 0
    assert (b / "model.json").read_bytes() == first
    assert run(spark, capsys, "bundle-verify", "--bundle", b)[0] == 0
    assert run(spark, capsys, "bundle-reproduce", "--bundle", b, "--dataset", corpus / "rows.tsv")[0] == 0
    assert run(spark, capsys, "evaluate", "--bundle", b, "--dataset", corpus / "rows.tsv", "--ood", corpus / "ood.tsv")[0] == 0
    assert json.loads(run(spark, capsys, "infer", "--bundle", b, "green tea")[1])["predicted"] == "tea"
    said = json.loads(run(spark, capsys, "infer", "--bundle", b, "I want to kill myself")[1])
    assert said["boundary"] == "safety-boundary" and said["predicted"] is None
    assert json.loads(run(spark, capsys, "infer", "--bundle", b, "  ")[1])["boundary"] == "empty-input"
    assert "rule ml-abstain" in run(spark, capsys, "chat", "--bundle", b, "--once", "green tea")[1]  # no reply belongs to these labels
    assert "accuracy" in run(spark, capsys, "evaluate", "--bundle", b, "--dataset", corpus / "rows.tsv", "--summary")[1]
    other = corpus / "other.tsv"
    other.write_text((corpus / "rows.tsv").read_text().replace("tea-0", "tea-x"))
    assert "was trained on" in run(spark, capsys, "evaluate", "--bundle", b, "--dataset", other)[2]
    assert run(spark, capsys, "evaluate", "--bundle", b, "--dataset", other, "--any-corpus")[0] == 0
    assert run(spark, capsys, "bundle-reproduce", "--bundle", b, "--dataset", other)[0] == 1
    assert run(spark, capsys, "robustness-audit", "--bundle", b)[0] == 1
    assert run(spark, capsys, "robustness-audit", "--bundle", b, "--bundle-id-test")[0] == 1  # a v1 bundle has no test rows
    lines = run(spark, capsys, "infer-batch", "--bundle", b, "--input", corpus / "cases.jsonl")[1].splitlines()
    assert [json.loads(x)["id"] for x in lines] == ["c0", "c1"]
    code, out, err = run(spark, capsys, "infer-batch", "--bundle", b, "--input", corpus / "bad.jsonl")
    assert code == 1 and "line 2: shape" in err and "secret" not in out + err
    code, out, _ = run(spark, capsys, "robustness-audit", "--bundle", b, "--input", corpus / "cases.jsonl", "--formatting-label", 0, "--formatting-decision", 0, "--formatting-js", 1)
    assert code == 0 and json.loads(out)["inputs"] == 2 and json.loads(out)["population"] == "jsonl"
    code, out, err = run(spark, capsys, "robustness-audit", "--bundle", b, "--input", corpus / "cases.jsonl", "--typographic-label", 1, "--typographic-js", 0)
    assert code == 1 and json.loads(out)["inputs"] == 2 and "error" in err
    (b / "metrics.json").write_text("{}")
    assert run(spark, capsys, "bundle-verify", "--bundle", b)[0] == 1


def test_chat_and_usage(spark, capsys, corpus):
    assert "rule greeting" in run(spark, capsys, "chat", "--once", "hello there")[1]
    with pytest.raises(SystemExit) as e:
        run(spark, capsys, "nonsense")
    assert e.value.code == 2
    assert run(spark, capsys, "train", "--dataset", corpus / "rows.tsv", "--ood", corpus / "rows.tsv", "--output", corpus / "x")[0] == 1


def test_v3_bundles_are_trained_audited_and_reproduced(spark, capsys, tmp_path, request):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9))
    said = {"goal": "plan", "reason": "because"}

    def write(name, header, rows):
        (tmp_path / name).write_text("\n".join(["\t".join(header), *["\t".join(r) for r in rows]]) + "\n")
        return tmp_path / name

    outside = lambda p: [(f"{p}-{s}-{f}-{k}", f"{p}-{s}-{f}", f"{p}-{s}", s, f"{word()} {word()}") for s in ("semantic", "capability", "noise") for f in range(2) for k in range(3)]
    kinds = ("id", "family_id", "domain_group", "stratum", "text")
    files = [
        "--dataset", write("g.tsv", ("id", "group_id", "label", "text"), [(f"s-{y}-{i}-{k}", f"{y}-{i}", y, f"{said[y]} {word()} {word()}") for y in said for i in range(10) for k in range(3)]),
        "--ood-development", write("d.tsv", kinds, outside("d")), "--ood-test", write("t.tsv", kinds, outside("t")),
        "--contrast-test", write("c.tsv", ("id", "pair_id", "variant", "label", "text"), [(f"c-{i}-{v}", f"p-{i}", v, y, f"{said[y]} {word()}") for i in range(3) for v, y in zip("ab", said)]),
    ]
    b = tmp_path / "bundle"
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a tiny corpus
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", "4"))
    code, out, err = run(spark, capsys, "train-v3", *files, "--output", b, "--epochs", 60, "--max-features", 64, "--l2", 0.0005, "--bootstrap-resamples", 100)
    assert code == 0, err
    report = json.loads(out)
    assert len(report["split_plan_sha256"]) == 64 and report["populations"]["contrast"] == {"pairs": 3, "rows": 6} and len(report["limitations"]) >= 2
    code, out, err = run(spark, capsys, "robustness-audit", "--bundle", b, "--bundle-id-test", "--formatting-label", 0, "--formatting-decision", 0, "--formatting-js", 1)
    assert code == 0 and json.loads(out)["population"] == "bundle-id-test", err
    code, out, err = run(spark, capsys, "bundle-reproduce", "--bundle", b, *files)
    assert code == 0 and json.loads(out) == {"reproduced": True}, err
    assert run(spark, capsys, "bundle-reproduce", "--bundle", b, *files[:2])[0] == 1
