import collections
import itertools
import math
import random
import re
import unicodedata

import pytest
import regex
from corpusloom.llm import distinctive as D
from corpusloom.llm import frequencies as Q
from corpusloom.llm import lookalikes as L
from corpusloom.llm import overlaps as O
from corpusloom.llm import suffixes as X
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SAME = [("ﬁnd", "find"), ("e​́", "é"), ("ё", "ë"), ("ｆ４０", "f40"), ("Kelvin", "Kelvin"), ("가", "가"), ("a\xa0b", "a b"), (" x　", "x"), ("сор", "cop"), ("Βeta", "Beta"), ("Ⅳ", "IV"), ("﻿a\xadb", "ab"), ("ﾊﾞ", "バ"), ("á̧", "á̧")]
DIFFERENT = [("①", "1"), ("2²", "22"), ("a", "A"), ("e", "é"), ("x.", "x"), ("l", "1"), ("O", "0"), ("a  b", "a b"), ("it's", "its")]


def test_forms():
    for a, b in SAME:
        assert L.consistent_form(a) == L.consistent_form(b), (a, b)
    for a, b in DIFFERENT:
        assert L.consistent_form(a) != L.consistent_form(b), (a, b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abȩ́́̈​　 ѕоﬁｆ①²각가한ёйΒKﾊﾞகொ"), st.characters(exclude_categories=["Cs"])), max_size=12))
def test_spliced_segments_equal_the_full_normalisation(t):
    form = L.consistent_form(t)
    assert form == L.form_of(t).strip(" ")
    assert L.consistent_form(form) == form and unicodedata.is_normalized("NFC", form)


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = ["café au lait", "find it", "", "Beta x", "a b"]
    change = [lambda t: t, lambda t: t.replace("é", "é"), lambda t: t.replace("fi", "ﬁ"), lambda t: t + " ", lambda t: t.replace("a", "а"), lambda t: "​" + t, lambda t: t.upper()]
    rows = [("t" if i % 3 else "u", i, rng.choice(change)(rng.choice(base)) if i % 11 else None, "clash", "r") for i in range(150)]
    df = spark.createDataFrame(rows, "table_name string, row_no long, text string, form string, ka string")
    got = [tuple(r) for r in L.lookalike_pairs(L.consistent_forms(df), ["table_name"], "row_no").collect()]
    want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] is not None and b[2] is not None and a[2] != b[2] and L.form_of(a[2]).strip(" ") == L.form_of(b[2]).strip(" ")}
    assert set(got) == want and len(got) == len(want)
    assert L.lookalike_pairs(L.consistent_forms(df.limit(0)), ["table_name"], "row_no").count() == 0


def _tokens(t, nfkc=False):
    t = unicodedata.normalize("NFKC", t) if nfkc else t
    return [w for w in (x.strip("'") for x in regex.findall(r"[\p{Alphabetic}\p{N}']+", t.lower())) if w]


@pytest.fixture(scope="module")
def prompts(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        n = rng.choice([0, 1, 3, 8, 20])
        t = " ".join("the" if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(n))
        rows.append((i, rng.choice(["goal", "reason", "feeling", "Goal ", None]), t if i % 17 else None, "clash"))
    rows.append((999, "goal", "the end " * 3000, "clash"))
    return rows, spark.createDataFrame(rows, "row_no long, label string, text string, n string")


@pytest.mark.parametrize("parts", [1, 13])
def test_ngram_counts_against_brute_force(spark, prompts, parts):
    rows, df = prompts
    long = " ".join(f"w{i * i % 37}" for i in range(90))
    rows = [r for r in rows if r[0] != 999] + [(1000 + i, "goal", t, "clash") for i, t in enumerate([long, "so " + long, long[:-4], " ".join(["a b"] * 70), "x " + " ".join(["a b"] * 50), "?!", ""])]
    df = spark.createDataFrame(rows, "row_no long, label string, text string, n string").repartition(5)
    occ, rec = collections.Counter(), collections.Counter()
    for _, _, t, _ in rows:
        w = _tokens(t or "")
        grams = [" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)]
        occ.update(grams)
        rec.update(set(grams))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for lone, longest in ((0, None), (1, 1), (3, 70)):
            got = [tuple(r) for r in Q.ngram_counts(df, "row_no", lone=lone, longest=longest).collect()]
            want = {(len(g.split()), g, occ[g], n) for g, n in rec.items() if (n >= 2 or len(g.split()) <= lone) and (longest is None or len(g.split()) <= longest)}
            assert len(got) == len(want) and set(got) == want
        assert max(n for n, *_ in want) > 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    marks = {r["term"]: r["mark"] for r in Q.marked_words(df, "row_no").collect()}
    total = sum(t is not None for _, _, t, _ in rows)
    assert marks == {g: "rare" if n == 1 else "common" if n > 0.05 * total else None for g, n in rec.items() if " " not in g}
    assert Q.ngram_counts(df.limit(0), "row_no").count() == 0


def test_a_very_long_text_stays_linear(spark):
    words = [f"w{i % 1000}" if i % 7 else "the" for i in range(60_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "the w1 w2")], "row_no int, text string")
    got = {r["ngram"]: (r["occurrences"], r["records"]) for r in Q.ngram_counts(df, "row_no").collect()}
    assert got == {g: (occ, 2) for g, occ in ((g, _count(words, g.split()) + 1) for g in ("the", "w1", "w2", "the w1", "w1 w2", "the w1 w2"))}


def _count(words, gram):
    return sum(words[i : i + len(gram)] == gram for i in range(len(words)))


def test_own_order_of_long_records():
    rng = random.Random(9)
    for n in (1, 64, 65, 300):
        words = [rng.choice("ab") for _ in range(n)]
        order, shared = X.own_order(words)
        assert [words[k:] for k in order] == sorted(words[k:] for k in range(n))
        for t in range(1, n):
            a, b = words[order[t - 1] :], words[order[t] :]
            assert shared[t] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_scores_against_the_formula(spark, prompts):
    rows, df = prompts
    counts = D.word_counts(df, ["row_no", "label"], "text", "v1")
    stats = D.word_statistics(counts, "label", D.LABELS)
    got = {(r["row_no"], r["term"]): r for r in D.record_scores(counts.drop("label"), stats, df, "row_no").collect()}
    toks = {i: _tokens(t) for i, _, t, _ in rows if t is not None}
    d = collections.Counter(w for t in toks.values() for w in set(t))
    f = collections.Counter(w for t in toks.values() for w in t)
    total, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    want = {(i, w): n for i, t in toks.items() for w, n in collections.Counter(t).items()}
    assert {k: r["n"] for k, r in got.items()} == want
    for (i, w), n in want.items():
        tfn, lam = n * math.log2(1 + mean / len(toks[i])), f[w] / total
        score = (math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (tfn + 1)
        assert got[i, w]["d"] == d[w] and got[i, w]["total"] == total and got[i, w]["score"] == pytest.approx(score)
    labels = {(r["label"], r["term"]): (r["d_label"], r["d_all"]) for r in D.label_scores(stats, D.LABELS).collect()}
    seven = {i: y for i, y, t, _ in rows if t is not None and y in D.LABELS}
    own = collections.Counter((seven[i], w) for i in seven for w in set(toks[i]))
    every = collections.Counter(w for i in seven for w in set(toks[i]))
    assert labels == {(y, w): (n, every[w]) for (y, w), n in own.items()}
    empty = D.word_counts(df.limit(0), ["row_no", "label"], "text", "v1")
    assert D.record_scores(empty.drop("label"), D.word_statistics(empty, "label", D.LABELS), df.limit(0), "row_no").count() == 0


def test_found_words_rest_on_counts_alone(spark, tmp_path, monkeypatch):
    # "alpha" and "beta" have the same n, f and so score in row 1, but not the same d: only one of them is a case there.
    rows = [(1, "question", "alpha beta " * 3), (2, None, "alpha " * 9), *[(i, "goal", f"beta c{i}") for i in range(3, 12)], (12, "other", "gamma"), (13, "goal", None), (14, "goal", " ... ")]
    spark.createDataFrame(rows, "row_no bigint, label string, text string").write.parquet(str(tmp_path / "intents_v1.parquet"))
    scores = {r["term"]: (r["n"], r["d"], r["score"]) for r in D.p4_record_scores(spark, str(tmp_path)).where("row_no = 1").collect()}
    assert scores["alpha"] == (3, 2, scores["beta"][2]) and scores["beta"][:2] == (3, 10)

    def unused(*_, **__):
        raise AssertionError("the score decides no row here")

    monkeypatch.setattr(D, "dfr_score", unused)
    toks = {i: _tokens(t) for i, _, t in rows if t is not None}
    total, d = len(toks), collections.Counter(w for t in toks.values() for w in set(t))
    want = {("record", str(i), w) for i, t in toks.items() for w in set(t) if t.count(w) * math.log(total / d[w]) >= 2.1 * math.log(total)}
    own = collections.Counter((y, w) for i, y, _ in rows if y in D.LABELS for w in set(toks.get(i, [])))
    every = collections.Counter(w for i, y, _ in rows if y in D.LABELS for w in set(toks.get(i, [])))
    want |= {("label", y, w) for (y, w), n in own.items() if n >= 4 and n * 10 >= every[w] * 9}
    assert ("record", "1", "alpha") in want and ("record", "1", "beta") not in want and ("label", "goal", "beta") in want
    got = D.p4_found(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(260):
        if rows and rng.random() < 0.5:
            w = _tokens(rng.choice(rows)[3] or "", True)
            for _ in range(rng.randint(0, 4)):
                if w and rng.random() < 0.5:
                    w.pop(rng.randrange(len(w)))
                else:
                    w.insert(rng.randint(0, len(w)), f"n{rng.randint(0, 30)}")
            rng.shuffle(w)
        else:
            w = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.choice([0, 1, 2, 5, 9, 14, 30]))]
        rows.append((i, "clash", rng.choice(["train", "train", "development", "id-test", None]), " ".join(w) if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "row_no long, rep string, split_name string, text string")
    sets = [(i, s, set(_tokens(t, True))) for i, _, s, t in rows if s is not None and t is not None]
    for tenths in (5, 7, 10):
        want = {(a[0], b[0]) for a in sets for b in sets if a[1] == "train" != b[1] and a[2] and 10 * len(a[2] & b[2]) >= tenths * len(a[2] | b[2])}
        got = [tuple(r) for r in O.split_overlaps(df, tenths=tenths).collect()]
        assert set(got) == want and len(got) == len(want)
    assert O.split_overlaps(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 40])
def test_coverage_against_brute_force(spark, parts):
    rng = random.Random(13)
    rows = [(i, rng.choice(["train", "id-test", None]), " ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.choice([0, 2, 4, 5, 9, 60])))) for i in range(160)]
    rows += [(500, "train", "a " * 3000), (501, "id-test", "a " * 3000), (502, "id-test", None), (503, "id-test", "zz"), (504, "train", "x zz y"), (505, "id-test", "zz q"), (506, "id-test", "n1 n2 n3 n4 n5 n6")]
    df = spark.createDataFrame(rows, "row_no long, split_name string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["row_no"]: (r["n_words"], r["covered"], r["spans"]) for r in O.shared_coverage(df).collect()}
        assert O.shared_coverage(df.limit(0)).count() == 0
        assert {r["covered"] for r in O.shared_coverage(df.where("split_name = 'id-test'")).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    seen = {tuple(w[i : i + n]) for _, s, t in rows if s == "train" and t for w in [t.split()] for n in range(1, 6) for i in range(len(w) - n + 1)}
    want = {}
    for r, s, t in rows:
        w = (t or "").split()
        if s == "id-test" and t is not None:
            need = min(5, len(w))
            hits = [i for i in range(len(w) - need + 1) if need and tuple(w[i : i + need]) in seen]
            covered = sorted({j for i in hits for j in range(i, i + need)})
            # Spans that touch are told apart by the place where no shared one goes across.
            want[r] = len(w), len(covered)
    assert {k: v[:2] for k, v in got.items()} == want
    assert got[501][2] == 1 and got[503][1:] == (1, 1) and got[505][1:] == (0, 0)


def test_report_multiplies_copies(spark):
    rows = [(i, "train", "g", "one two three") for i in range(40)] + [(100 + i, "id-test", " G" if i % 2 else "h", ["three two one", "one two three four", "other"][i % 3]) for i in range(60)] + [(900, None, "g", "one two three"), (901, "id-test", None, "one two three")]
    df = spark.createDataFrame(rows, "row_no long, split_name string, group_id string, text string")
    by = {"split_name": F.col("split_name"), "group_id": F.lower(F.btrim("group_id", F.lit(" ")))}
    got = {(r["split_name"], r["group_id"]): (r["n_rows"], r["links"]) for r in O.overlap_report(df, by).collect()}
    pairs = collections.Counter(r["other_row"] for r in O.split_overlaps(df).collect())
    want = {}
    for i, s, g, _ in rows:
        if i in pairs:
            k = s, g and g.strip(" ").lower()
            want[k] = want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + pairs[i]
    assert got == want and got["id-test", None] == (1, 40)


def test_the_reason_for_prefixes_holds():
    """Random sets at any similarity share a member early enough."""
    import numpy as np

    for n in range(1, 40):
        for m in range(max(1, math.ceil(0.7 * n)), int(n / 0.7) + 1):
            least = int(O._least_shared(np.array([n]), np.array([m]), 0.7)[0])
            for shared in range(1, min(n, m) + 1):
                if 10 * shared >= 7 * (n + m - shared):
                    assert shared >= least
    assert re and F


def test_unstable_letters_in_the_fast_range(spark):
    texts = [f"a{chr(c)}b" for c in (*range(0x20, 0x7F), *range(0xC0, 0x180))]
    got = L.consistent_forms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r["text"]: r["form"] for r in got} == {t: L.consistent_form(t) for t in texts}
