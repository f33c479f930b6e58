import os
import random

import pytest
from corpusloom.llm import sentences as S
from hypothesis import given, settings
from hypothesis import strategies as st

CASES = [
    ("Dr. Fo met Mrs. Ba. They left at 6 p.m. Really?!", ["Dr. Fo met Mrs. Ba.", "They left at 6 p.m.", "Really?!"]),
    ("It took 3.5 h, i.e. too long, at 5 p.m. sharp. See Fig. 3 and Sec. 2.0 etc. Next one.", ["It took 3.5 h, i.e. too long, at 5 p.m. sharp.", "See Fig. 3 and Sec. 2.0 etc.", "Next one."]),
    ("He said “stop. Now!” and went. “Is it?” asked Bo. It ends with “keep it.” Then more.", ["He said “stop. Now!” and went.", "“Is it?” asked Bo.", "It ends with “keep it.”", "Then more."]),
    ("(It was so.) Next. (cf. No. 4 in a.md) rest", ["(It was so.)", "Next.", "(cf. No. 4 in a.md) rest"]),
    ("I paused ... then it went on. Row 50… Each waits… still.", ["I paused ... then it went on.", "Row 50…", "Each waits… still."]),
    ("A line\nbreak. New\n- one\n- two. Three\n2) four\n\nfive", ["A line\nbreak.", "New", "- one", "- two.", "Three", "2) four", "five"]),
    ("83. Results\n \n## Open points\n\n[17:30] User: All. Done.", ["83. Results", "## Open points", "[17:30] User: All.", "Done."]),
    ("Glued.The next run.Dr. Ba came.", ["Glued.", "The next run.", "Dr. Ba came."]),
    ("Der 3. Lauf am 2. März war gut, z. B. für Zeile 67. Warum? „Ja!“, rief Bo. Er schrieb: „Nein.“ Ende.", ["Der 3. Lauf am 2. März war gut, z. B. für Zeile 67.", "Warum?", "„Ja!“, rief Bo.", "Er schrieb: „Nein.“", "Ende."]),
    ("«\xa0Oui\xa0!\xa0» a crié Bo. M. Fa écrit\xa0: «\xa0Non.\xa0» Pourquoi\xa0? Fin", ["«\xa0Oui\xa0!\xa0» a crié Bo.", "M. Fa écrit\xa0: «\xa0Non.\xa0»", "Pourquoi\xa0?", "Fin"]),
    ("La Dra. Ba vio la pág. 3. ¿Sí? ¡No!", ["La Dra. Ba vio la pág. 3.", "¿Sí?", "¡No!"]),
    ("«Где?» — спросила Ба. Проф. Ба и др. ждали... и шли. В 9 г. было!", ["«Где?» — спросила Ба.", "Проф. Ба и др. ждали... и шли.", "В 9 г. было!"]),
    ("Γιατί; Ο κ. Ba ήρθε. Τι ωραία!", ["Γιατί;", "Ο κ. Ba ήρθε.", "Τι ωραία!"]),
    ("今日は。「だめだ。」と言った。待った……それでも行く！終わり｡", ["今日は。", "「だめだ。」と言った。", "待った……それでも行く！", "終わり｡"]),
    ("“完了吗？”Ba问。请看《词。第3版》里的v1.4。谁？！", ["“完了吗？”Ba问。", "请看《词。第3版》里的v1.4。", "谁？！"]),
    ("“है?” Ba ने पूछा। डॉ. Ba आए ॥ ठीक", ["“है?” Ba ने पूछा।", "डॉ. Ba आए ॥", "ठीक"]),
    ("«أين؟» سأل Ba هنا. قرأ د. Ba سطرا؛ نعم؟ لا.", ["«أين؟» سأل Ba هنا.", "قرأ د. Ba سطرا؛ نعم؟", "لا."]),
    ("User: ทำไมเงียบ Baบอกว่า“แคบ คงที่” ค่า0.6เป็น0.7 ไหม? The end.", ["User: ทำไมเงียบ", "Baบอกว่า“แคบ คงที่”", "ค่า0.6เป็น0.7", "ไหม?", "The end."]),
    ("Open “quote. Never\n\nClosed. Here.", ["Open “quote. Never", "Closed.", "Here."]),
    ("", []), (" \n\t", []), (".", ["."]), ("  a  ", ["a"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_boundaries(text, want):
    assert [text[a:b] for a, b in S.sentence_spans(text)] == want


def in_chunks(text, chunk):
    """Sentences by chunk functions and their composition, in plain Python."""
    step = S.compile_rules()[0]
    thai = any("\u0e00" <= c <= "\u0e7f" for c in text)
    parts = list(S.chunks_of(text, chunk))
    assert "".join(t for _, t in parts) == text
    spans, state, opened = [], 0, None
    for n, (base, t) in enumerate(parts):
        events = S.chunk_symbols(t, thai, base)
        found, left = S.chunk_spans(events, state, events[4] if n == 0 else None, base + len(t) == len(text))
        spans += [(opened if a is None else a, b) for a, b in found]
        opened = opened if left is None else left
        state = int(S.transition(events[0], step)[state])
    return spans


PIECES = [t for t, _ in CASES if t] + ["\n\n", "\n- ", " ", "  \n", "“", "”", ")" * 40, "(", " " * 300, "x" * 90, "Next one", "am 3. März", "foo-bar v2", "\n\n7. Plan", "ends. Then", "สวัสดี ครับ", "。", "你好。他们", "か", "etc."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14), st.sampled_from(["", " "]), st.integers(0, 60))
def test_chunks_equal_the_whole(pieces, between, chunk):
    text = between.join(pieces)
    assert in_chunks(text, chunk) == S.sentence_spans(text)


@pytest.mark.parametrize("text", ["สวัสดีครับ" + "x" * 8300 + " then more words. End here.", "It is (so." + ")" * 400 + " Then on we go. End", "He said “one. " + "two. Three " * 900 + "four.” And five six. “Seven", "End." + " " * 9000 + "Next word here. Last", "ab " * 5000 + "。" * 700 + "cd. Ef", "你好。他们来了。" * 2000])
def test_awkward_texts_at_every_chunk_size(text):
    want = S.sentence_spans(text)
    for chunk in (0, 1, 17, 64, 256, 4000, 8192):
        assert in_chunks(text, chunk) == want


def test_safe_places_are_found_in_every_script():
    for text, _ in CASES:
        if len(text) > 40:
            assert len(list(S.chunks_of(text * 30, 100))) > 3 or text.startswith(("今", "“完")), text


def test_scan_is_a_tree(spark):
    rng = random.Random(5)
    chunks = {"one": 1, "some": 40, "many": 700}
    fs = {(k, c): [rng.randrange(86) for _ in range(86)] for k, n in chunks.items() for c in range(n)}
    df = spark.createDataFrame([(k, c, f) for (k, c), f in fs.items()], "k string, c int, f array<int>")
    got = {(r["k"], r["c"]): r["state"] for r in S.scan(df).collect()}
    want = {}
    for k, n in chunks.items():
        state = 0
        for c in range(n):
            want[k, c] = state
            state = fs[k, c][state]
    assert got == want and S.scan(df.limit(0)).count() == 0


def test_frame_with_short_and_long_texts(spark):
    long = "\n".join(t for t, _ in CASES if t.strip()) * 40
    rows = [(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(100, None, "x"), (101, long, "x"), (102, "One “two. " + "three. " * 300 + "four” five. Six.", "x"), (103, "tea " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sent_no string")
    for chunk in (300, 1000, S.CHUNK):
        got = {}
        for r in S.sentences(df, chunk=chunk).collect():
            got.setdefault(r["doc_id"], []).append((r["sent_no"], r["sent_start"], r["sent_end"]))
        for i, t, _ in rows:
            want = [(n, a, b) for n, (a, b) in enumerate(S.sentence_spans(t), 1)] if t else []
            assert sorted(got.get(i, [])) == want, (chunk, i)
    assert S.sentences(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't here")
def test_chunks_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert S.sentences(docs, chunk=400).exceptAll(S.sentences(docs)).count() == 0
