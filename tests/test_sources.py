import json

import pytest
from corpusloom.operators.contracts import ContractError
from corpusloom.sources import jsonl, sinks, tsv
from corpusloom.streaming import sessions
from pyspark.sql import functions as F


def _lines(spark, lines):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line_no long, line string")


def _reasons(spark, lines, corpus):
    return {r["line_no"]: r["reason"] for r in tsv.parse(_lines(spark, lines), corpus).collect()}


def test_labeled_lines(spark):
    got = _reasons(spark, ["id\tlabel\ttext\r", "a\tgoal\tHello there", "", "  # note", "a\tgoal\tother", "b\tgoal\thello   THERE", "c d\tgoal\tx", "e\tGoal\tx", "f\tgoal\t ", "g\tgoal", "h\tgoal\t" + "x" * 513, "i\tgoal\tok\r", None], tsv.LABELED)
    assert got == {2: None, 5: "duplicate-id", 6: "duplicate-text", 7: "id", 8: "label", 9: "text", 10: "columns", 11: "text", 12: None}


def test_header_and_load(spark):
    assert _reasons(spark, ["id\tname"], tsv.OOD) == {1: "header"}
    with pytest.raises(ContractError, match="line 3: columns"):
        tsv.load(_lines(spark, ["id\ttext", "a\tb", "c", "d"]), tsv.OOD)
    with pytest.raises(ContractError):
        tsv.load(_lines(spark, ["id\ttext"]), tsv.OOD)
    assert tsv.load(_lines(spark, ["id\ttext", "a\tb"]), tsv.OOD).count() == 1


def test_feature_equal_texts_are_repeats_in_v3(spark):
    head = "id\tgroup_id\tlabel\ttext"
    assert _reasons(spark, [head, "a\tg\tgoal\tHello there", "b\tg\tgoal\tＨello, there!", "c\tg\tgoal-1\tx"], tsv.GROUPED) == {2: None, 3: "duplicate-text", 4: "label"}
    assert _reasons(spark, ["id\tpair_id\tvariant\tlabel\ttext", "a\tp\tc\tgoal\tx"], tsv.CONTRAST) == {2: "variant"}


def test_file_lines(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("id\ttext\na\tone\nb\ttwo\n")
    assert tsv.load(tsv.read_lines(spark, str(p)), tsv.OOD).count() == 2


JSON = ['{"id":"a","text":"x"}', '{"text":"y","id":"b"}', "", "not json", '{"id":"a"}', '{"id":"a","text":"x","z":1}', '{"id":1,"text":"x"}', '{"id":"a b","text":"x"}', '{"id":"c","text":"  "}', '{"id":"d","text":"' + "x" * 513 + '"}', '{"id":"e","text":"' + "x" * 20000 + '"}', '{"id":"a","text":"again"}', None]
WANT = {1: None, 2: None, 4: "shape", 5: "shape", 6: "shape", 7: "shape", 8: "id", 9: "text", 10: "text", 11: "oversize", 12: None}


def test_json_lines(spark):
    df = _lines(spark, JSON)
    assert {r["line_no"]: r["reason"] for r in jsonl.parse(df).collect()} == WANT
    assert {r["line_no"]: r["reason"] for r in jsonl.parse_audit(df).collect()} == WANT | {12: "duplicate-id"}
    assert jsonl.limits(df).first()["within"] and jsonl.parse(df.limit(0)).count() == 0


def test_json_sink_keeps_order(spark):
    df = spark.createDataFrame([(2, "b", 0.5), (1, "a", 0.25)], "n int, id string, c double")
    got = [json.loads(r["value"]) for r in sinks.json_lines(df, "id", ["c"], ["n"]).collect()]
    assert got == [{"id": "a", "prediction": {"c": 0.25}}, {"id": "b", "prediction": {"c": 0.5}}]


def _run(spark, frame, sink, mode, tmp_path):
    q = frame.writeStream.format("memory").queryName(sink).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{sink}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {sink}").collect()


def test_streamed_scoring_and_duplicates(spark, tmp_path):
    from corpusloom.plans.model_queries import literal_model

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(x for x in JSON if x is not None))
    stream = spark.readStream.text(str(folder))
    got = _run(spark, sessions.score_stream(stream, literal_model()).select("id", "predicted"), "scored", "append", tmp_path)
    assert sorted(r["id"] for r in got) == ["a", "a", "b"]
    assert len(_run(spark, sessions.rejected_stream(stream), "rejected", "append", tmp_path)) == 8
    assert {r["id"]: r["n"] for r in _run(spark, sessions.duplicate_ids_stream(stream), "ids", "complete", tmp_path)} == {"a": 2, "b": 1}


def test_streamed_sessions_go_on(spark, tmp_path):
    folder = tmp_path / "talk"
    schema = "s string, o int, text string"
    spark.createDataFrame([("a", 1, "noon"), ("a", 2, ""), ("b", 1, "hello")], schema).write.json(str(folder))
    stream = spark.readStream.schema(schema).json(str(folder))

    def run():
        # A file sink: its query can be stopped and started again, and the state with it.
        q = sessions.route_stream(stream, "s", "o").select("s", "o", "turn", "rule_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).collect()

    assert {(r["s"], r["o"]): r["turn"] for r in run()} == {("a", 1): 1, ("a", 2): 2, ("b", 1): 1}
    spark.createDataFrame([("a", 3, "noon")], schema).write.mode("append").json(str(folder))
    assert [(r["o"], r["turn"]) for r in run() if r["o"] == 3] == [(3, 3)]
