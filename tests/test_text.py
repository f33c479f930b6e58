import unicodedata

import regex
from pyspark.sql import functions as F

from corpusloom.functions import hashing as H
from corpusloom.functions import perturb as P
from corpusloom.functions import text as T

TEXTS = ["", "   ", None, "the a''b ended early", "'''Hello''' there", "I’m  fine\tnow", "ΟΔΟΣ ΣΑΣ", "Café ٣ naïve", "🪐🛰️", "ＦＵＬＬ width", "x" * 600, "a b", "it's 3.5 o'clock!", "ΣΑΣ", " pad　"]


def _one(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def _norm(t):
    return " ".join("".join(c.lower() for c in t).replace("’", "'").replace("‘", "'").split())


def _tokens(t):
    return [w for w in (x.strip("'") for x in regex.findall(r"[\p{Alphabetic}\p{N}']+", _norm(t))) if w]


def test_normalize_and_tokens_match_python(spark):
    assert _one(spark, TEXTS, T.normalize("text")) == [None if t is None else _norm(t) for t in TEXTS]
    assert _one(spark, TEXTS, T.tokens("text")) == [None if t is None else _tokens(t) for t in TEXTS]
    assert _one(spark, TEXTS, T.normalize_nfkc("text")) == [None if t is None else _norm(unicodedata.normalize("NFKC", t)) for t in TEXTS]


def test_inner_apostrophes_survive(spark):
    assert _one(spark, ["the a''b", "'''Hello''' there"], T.tokens("text")) == [["the", "a''b"], ["hello", "there"]]


def test_ngrams(spark):
    toks = T.tokens("text")
    assert _one(spark, ["a bc"], T.word_ngrams(toks, 1, 3)) == [["w1:a", "w1:bc", "w2:a_bc"]]
    assert _one(spark, ["a bc"], T.char_ngrams(toks, 3, 5)) == [["c3:^a ", "c3:a b", "c3: bc", "c3:bc$", "c4:^a b", "c4:a bc", "c4: bc$", "c5:^a bc", "c5:a bc$"]]
    assert _one(spark, ["!!", ""], T.extract_terms(toks)) == [[], []]


def test_feature_names(spark):
    names = ["w1:a", "w2:a_b", "w2:a", "c3:^a ", "c3:abcd", "c7:abcdefg", "w1:a:b", "w1:-", "x1:a", "", "w1:don't", "w1:'a"]
    assert _one(spark, names, T.valid_feature_name("text")) == [True, True, False, True, False, False, False, False, False, False, True, False]


def test_phrases_and_reflection(spark):
    assert _one(spark, ["I want to skill myself", "I don’t want to live"], T.contains_phrase(T.tokens("text"), "kill myself")) == [False, False]
    assert _one(spark, ["I don’t want to live"], T.contains_phrase(T.tokens("text"), "don't want to live")) == [True]
    assert _one(spark, ["You and my dog, I am"], T.reflect(T.tokens("text"))) == ["I and your dog you are"]


def test_fnv_and_sha(spark):
    def fnv(t, seed=0):
        h = 0xCBF29CE484222325 ^ seed
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    texts = ["", "abc", "héllo 🪐", "x" * 1000]
    assert _one(spark, texts, H.fnv1a64("text", 20260722)) == [fnv(t, 20260722) for t in texts]
    assert _one(spark, [None], H.fnv1a64("text")) == [None]


def test_splitmix(spark):
    def draws(seed, n):
        out = []
        for _ in range(n):
            seed = (seed + 0x9E3779B97F4A7C15) % (1 << 64)
            z = seed
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
            out.append(z ^ z >> 31)
        return out

    seed = 4043100207104787 ^ 0x6A09E667F3BCC909
    got = [r[0] for r in spark.range(50).orderBy("id").select(H.splitmix_index(F.col("id"), F.lit(7), seed)).collect()]
    assert got == [d % 7 for d in draws(seed, 50)]


def test_perturbations_against_python(spark):
    def run(t):
        best = None
        for m in regex.finditer(r"[\p{Alphabetic}\p{N}]+", t):
            if best is None or m.end() - m.start() > best[1]:
                best = (m.start(), m.end() - m.start())
        return best

    def delete(t):
        r = run(t)
        return t[: r[0] + r[1] // 2] + t[r[0] + r[1] // 2 + 1 :] if r and r[1] >= 5 else None

    def swap(t):
        r = run(t)
        if not r or r[1] < 4:
            return None
        c = [i for i in range(r[0], r[0] + r[1] - 1) if t[i] != t[i + 1]]
        if not c:
            return None
        i = min(c, key=lambda x: abs(x - (r[0] + r[1] // 2)))
        return t[:i] + t[i + 1] + t[i] + t[i + 2 :]

    def double(t):
        r = run(t)
        return t[: r[0] + r[1] // 2] + t[r[0] + r[1] // 2] + t[r[0] + r[1] // 2 :] if len(t) < 512 and r and r[1] >= 3 else None

    texts = ["Useful systems remain inspectable", "ab abc", "aaaa", "aaab", "", "!!!", "héllo wörld", "ab cd", "abcde fghij", "x" * 512, "y" * 511 + "!", "a1b2c3d4"]
    for name, f in (("delete", delete), ("swap", swap), ("double", double)):
        column = {"delete": P.delete_middle, "swap": P.swap_neighbours, "double": P.double_middle}[name](F.col("text"))
        assert _one(spark, texts, column) == [f(t) for t in texts], name
    assert _one(spark, ["aB1"], P.letter_case(F.col("text"))) == ["Ab1"]
    assert _one(spark, ["a b\tc", "ab"], P.horizontal_white(F.col("text"))) == ["a\tb c", " ab"]
    assert _one(spark, ["aZ9!"], P.full_width(F.col("text"))) == ["ａＺ９!"]
    assert _one(spark, ["hi", "x" * 511 + "!", "x" * 512], P.terminal_mark(F.col("text"))) == ["hi!", "x" * 511 + ".", None]
    for _, _, f in P.SUITE:
        got = _one(spark, ["Useful systems remain inspectable"], f(F.col("text")))[0]
        assert got not in (None, "Useful systems remain inspectable")
