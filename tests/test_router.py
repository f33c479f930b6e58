from corpusloom.operators import router as R
from pyspark.sql import functions as F


def _route(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [(r["rule_id"], r["keyword"], r["fragment"]) for r in R.rule_route(df).orderBy("i").collect()]


def test_priority(spark):
    got = _route(spark, ["", None, "\t ", "x" * 513, "hello, I want to die", "oh hi there", "hey", "hey you", "I feel uncertain about my next step.", "it is because my dog because you", "My dog hurts me", "is it?", "noon"])
    assert [g[0] for g in got] == ["empty-input"] * 3 + ["input-boundary", "safety-boundary", "greeting", "greeting", "fallback", "feeling-reflection", "because-probe", "ownership-reflection", "question-return", "fallback"]
    assert got[8][2] == "uncertain about your next step"
    assert got[9][2] == "your dog because I"


def test_sessions_count_every_turn(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(["noon", "", "noon", "noon", "noon", "noon"])] + [("b", 0, "noon"), (None, 1, "noon")], "s string, o int, text string")
    got = {(r["s"], r["o"]): (r["turn"], r["reply"]) for r in R.rule_route_session(df, "s", ["o"]).collect()}
    assert [got["a", i][0] for i in range(6)] == [1, 2, 3, 4, 5, 6]
    assert got["a", 0][1] == got["a", 4][1] == R.FALLBACKS[0] and got["a", 2][1] == R.FALLBACKS[2]
    assert got["b", 0][0] == 1 and got[None, 1][0] == 1


def test_model_route(spark):
    df = spark.createDataFrame([(0, "noon", "goal", True), (1, "noon", "other", True), (2, "noon", "goal", False), (3, "I want to die", "goal", True), (4, None, "goal", True)], "i int, text string, label string, accepted boolean")
    got = [r["rule_id"] for r in R.model_route(df).orderBy("i").collect()]
    assert got == ["ml-intent", "ml-abstain", "ml-abstain", "safety-boundary", "empty-input"]
