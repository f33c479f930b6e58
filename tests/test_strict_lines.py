import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.sources import strict_lines as X


def parse(line):
    out, i, n = [], 0, len(line)
    while True:
        if line[i : i + 1] == '"':
            i, b = i + 1, ""
            while True:
                if i >= n:
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] != '"':
                        i += 1
                        break
                    i += 1
                b += line[i]
                i += 1
            if i < n and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = n if j < 0 else j
            b, i = line[i:j], j
        out.append(b)
        if i >= n:
            return out
        i += 1


def reason(corpus, line):
    if line is None:
        return "skip"
    line = line.removesuffix("\r")
    if not line.strip(" \t") or line.lstrip(" ").startswith("#"):
        return "skip"
    f = parse(line)
    if f is None:
        return "quoting"
    layout = X.LAYOUTS.get(corpus)
    if layout is None or len(f) != len(layout.fields):
        return "columns"
    f = [x.strip(" ") for x in f]
    if "" in f:
        return "empty"
    v = dict(zip(layout.fields, f))
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", v["id"]):
        return "id"
    for name, allowed in layout.closed:
        if v[name] not in allowed:
            return name
    return "text" if len(v["text"]) > 512 or re.search("[�\x00-\x08\x0a-\x1f]", v["text"]) else None


def check(spark, lines):
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(lines)], "line_id long, corpus string, raw_line string")
    want = {i: reason(c, t) for i, (c, t) in enumerate(lines)}
    bad = {r["line_id"]: r["reason"] for r in X.rejected_lines(df).collect()}
    assert bad == {i: w for i, w in want.items() if w not in (None, "skip")}
    assert {r["line_id"] for r in X.strict_rows(df).collect()} == {i for i, w in want.items() if w is None}


def test_cases(spark):
    a, b = "intents-v1", "ood-test-v3"
    check(spark, [
        (a, "x-1\tgoal\tLet us go"), (a, 'x-1\tgoal\t"a\tb ""c"""'), (a, 'x\tgoal\t"open'), (a, 'x\tgoal\t"a"b'), (a, 'x\tgoal\tsay "hi"'), (a, ' "x"\tgoal\ty'), (a, "x\tgoal"), (a, "x\tgoal\t\ty"), (a, "x\tgoal\t  "),
        (a, "x y\tgoal\tz"), (a, "x\tGoal\tz"), (a, "x\tgoal\t" + "y" * 513), (a, "x\tgoal\tbad �"), (a, "x\tgoal\tbell\x07"), (a, "  # note"), (a, "\t# kept"), (a, "#"), (a, " \t "), (a, ""), (a, None), (a, "\r"), (a, "x\tgoal\ty\r"), (a, "x\tgoal\ty\r\r"),
        (b, "i\tf\td\tnoise\tt"), (b, "i\tf\td\tNoise\tt"), (b, "i\tgoal\tt"), (None, "x\tgoal\tz"), ("other", "x\tgoal\tz"), (a, '"x"\t"goal"\t" y "'), (a, '""\tgoal\ty'), (a, "x" * 129 + "\tgoal\ty"), (a, '"' + '""' * 20000 + '"\tgoal\ty'), (a, "x\tgoal\t" + '"' + "y\t" * 200000),
    ])


def test_typed_and_empty(spark):
    df = spark.createDataFrame([(1, "intents-v1", ' x \t"goal"\t"say ""hi""" ', "clash")], "line_id long, corpus string, raw_line string, fields string")
    assert X.rejected_lines(df).collect()[0]["reason"] == "quoting"
    df = spark.createDataFrame([(1, "intents-v1", ' x \t"goal"\t"say ""hi"""', "clash")], "line_id long, corpus string, raw_line string, fields string")
    assert [tuple(r) for r in X.typed_rows(X.strict_rows(df), "intents-v1").collect()] == [(1, "x", "goal", 'say "hi"')]
    none = df.limit(0)
    assert X.rejected_lines(none).count() == 0 and X.strict_rows(none).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["intents-v1", "ood-test-v3"]), st.text(alphabet='ab"\t #\rgoal-', max_size=24)), min_size=150, max_size=150))
def test_random_lines(spark, lines):
    check(spark, lines)
