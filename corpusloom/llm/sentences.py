"""Sentence boundaries as a finite transducer, run over chunks and composed by a parallel prefix scan.

The rules are two tables. The first reads the classes around a mark or a closing quotation (kind of mark, word
before it, script of the last letter, gap, what follows) and says whether a sentence may end there; it is compiled
from ordered rules. The second steps through open quotations, their depth and Thai letters, and says where
sentences do end. Python code only tells classes of characters and words.

A long text is cut where no rule can look across: between two letters parted by one blank, or by one full stop of a
script without letter case. Such chunks give the same symbols as the whole text, whatever their size; a stretch
without such a place stays in one chunk. A chunk is a function from the state before it to the state after it; a tree
of compositions over (text, chunk) gives every chunk its first state, after which the chunks' symbols, which are kept
instead of their texts, are turned into spans.

Defined results: a null text has no rows, a text of white space none; extra columns are ignored. A quotation left open
ends with its paragraph or list item; quotations of one kind nested deeper than ``DEPTH`` count as ``DEPTH`` deep.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.checkpoints import cut
from ..operators.layout import spread

CHUNK = 8192
FANOUT = 16  # functions composed by one row of the scan's tree

# Abbreviations after which a sentence always goes on.
HARD = set(
    """prof dr mr mrs ms st sen rev gen col capt mt vs e.g i.e cf fig figs sec ch vol ed eds no nos nr approx esp pp p al ref eq
    bzw ca ggf abb z d h b u s evtl vgl bspw tel str hr fr
    sr sra srta dra d dª pág págs aprox ej núm art cap
    m mm mme mlle fig ex env chap
    г-н г-жа проф напр рис табл стр т е см ср ул им акад доц
    δηλ κ κα σ π.χ βλ αρ εικ πιν
    د أ م डॉ श्री श्रीमती पं""".split()
)
# Abbreviations that may also close a sentence, when what follows looks like a new one.
SOFT = set("etc inc ltd co corp jr p.m a.m jan feb mar apr jun jul aug sep sept oct nov dec usw др г гг κ.λπ κ.ά".split())
# Words before a German ordinal number, and months after one.
ORDINAL_BEFORE = set("der die das dem den des am im zum zur beim vom ab seit bis jeder jede jedes dieser diese jener".split())
ORDINAL_AFTER = set("januar februar märz april mai juni juli august september oktober november dezember".split())

STRONG = "。！？｡．।॥"
DOTS = ".…"
ASKS = "!?؟‼⁇⁈⁉"
MARKS = STRONG + DOTS + ASKS
CLOSERS = "”\"’»)]}）］」』》〉】"
OPENERS = "“\"„‘«([{（［「『《〈【¿¡"
# Kinds of quotation; "”" closes both “ and „ quotations, “ closes a „ one.
PAIRS = {"“": "”", "„": "“”", "«": "»", "(": ")", "（": "）", "[": "]", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "‘": "’", '"': '"'}
KINDS = list(PAIRS)
QUOTE_CHARS = sorted({*PAIRS, *"".join(PAIRS.values())})
QUOTE_PLACE = {c: i for i, c in enumerate(QUOTE_CHARS)}
BRACKETS = ")]）］"
DEPTH = 3

# Classes that the rules tell apart.
MARK = ["strong", "wide", "dots", "ask", "arabic", "dot", "semicolon"]
WORD = ["plain", "soft", "abbreviation", "heading", "ordinal", "number"]
LAST = ["none", "cased", "caseless"]
NEXT = ["end", "separator", "closer", "mark", "upper", "month", "name", "caseless", "item", "digit", "quote", "opener", "sign", "other"]
BEFORE = ["none", "abbreviation", "ideographic", "strong", "other"]
BEGINS = "upper month name item digit quote opener sign"  # what a sentence may begin with
PARAGRAPH, ITEM, END, THAI, BLANK, QUOTE = range(6)  # symbols; each character of a quotation has four from QUOTE on

# (mark, word, glued to a lower-case letter or digit, last letter, gap, next) -> whether it may end; the first rule that fits holds.
MARK_RULES = [
    ("wide", "", "", "", "0", "item digit", 0),
    ("strong wide", "", "", "", "", "", 1),
    ("", "", "", "", "", "end", 1),
    ("semicolon", "", "", "", "1", BEGINS + " caseless", 1),
    ("semicolon", "", "", "", "", "", 0),
    ("", "", "", "", "", "separator closer", 0),
    ("", "", "", "", "0", "mark", 0),
    ("dots", "", "", "", "0", "", 0),
    ("dots", "", "", "cased", "", "caseless", 1),
    ("dots", "", "", "", "", BEGINS, 1),
    ("dots", "", "", "", "", "", 0),
    ("ask arabic", "", "", "", "0", "upper month quote opener", 1),
    ("arabic", "", "", "", "0", "caseless", 1),
    ("ask arabic", "", "", "", "1", BEGINS + " caseless", 1),
    ("ask arabic", "", "", "", "", "", 0),
    ("dot", "", "1", "", "0", "upper month quote", 1),
    ("dot", "", "", "", "0", "", 0),
    ("dot", "abbreviation heading", "", "", "", "", 0),
    ("dot", "ordinal", "", "", "", "upper month", 0),
    ("dot", "number", "", "", "", "month", 0),
    ("dot", "", "", "", "", BEGINS + " caseless", 1),
]
# (closes a bracket, mark before, last letter, gap, next) -> whether the sentence that holds the quotation may end with it.
CLOSE_RULES = [
    ("", "none abbreviation", "", "", "", 0),
    ("", "", "", "", "end", 1),
    ("", "", "", "", "separator", 0),
    ("", "", "", "0", "mark", 0),
    ("", "other", "none cased", "0", "upper month", 1),
    ("", "", "", "0", "", 0),
    ("1", "", "", "", BEGINS + " caseless", 1),
    ("1", "", "", "", "", 0),
    ("", "", "caseless", "", "quote opener", 1),
    ("", "ideographic", "caseless", "", "", 1),
    ("", "", "caseless", "", "", 0),
    ("", "", "", "", "digit", 0),
    ("", "", "", "", BEGINS + " caseless", 1),
]

EVENT = re.compile(
    r"\n[^\S\n]*\n\s*"  # a blank line
    r"|\n(?=[^\S\n]*(?:[-*•]|\d{1,3}\))[^\S\n])"  # a line break before a list item
    rf"|[{re.escape(MARKS)}](?:[\u00a0\u202f]?[{re.escape(MARKS)}])*"
    r"|[“”„‘’«»()（）\[\]［］「」『』《》〈〉【】\"]"
    r"|[;\u037e]"
    r"|[\u0e00-\u0e7f]+"
    r"|\u0020+"
)
EVENT_NO_BLANK = re.compile(EVENT.pattern.removesuffix(r"|\u0020+").replace(r"|[\u0e00-\u0e7f]+", ""))
THAI_LETTER = r"[\x{0E00}-\x{0E7F}]"
SPACE, CLOSING = re.compile(r"\s*"), re.compile(f"[{re.escape(CLOSERS)}]*")
HEADING = r"\s*(?:#+ +|[^\W\d_]\w{0,20}: +|\[[\d:.]+\] +)*\d{1,4}\Z"
FIRST_HEADING, LATER_HEADING = re.compile(HEADING), re.compile(r"\n[^\S\n]*\n" + HEADING)
NAME_LIKE = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+\s+v\d")
LIST_NUMBER = re.compile(r"\d{1,3}[).]\s")
WORD_BACK = re.compile(rf"[^\s(\[{{“„«‘\"¿¡”»){re.escape(STRONG)}]*")
JOINED = re.compile(r".*[^\W\d_A-ZА-ЯΑ-Ω][.!?…](?=[A-ZА-ЯΑ-Ω])")
INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
# A place that no rule looks across: after "letter, blank" or "letter, full stop" and before a letter (but v, which may name a version).
SAFE = re.compile(r"[^\W\d_](?:\u0020(?!v)|[。！？｡।॥])(?=[^\W\d_])")
MAX_WORD, MAX_BACK = 64, 256  # words before marks are told by so many last characters, last letters within so many


def _table(rules: list[tuple], *axes: list[str]) -> np.ndarray:
    """A table over the axes' classes; in a rule no class means any."""
    out = np.zeros([len(a) for a in axes], np.int8)
    for *classes, verdict in reversed(rules):
        out[np.ix_(*[[a.index(c) for c in named.split()] or list(range(len(a))) for named, a in zip(classes, axes)])] = verdict
    return out


@functools.cache
def compile_rules() -> tuple[np.ndarray, np.ndarray, list, list]:
    """The transducer: next state and output by state and symbol (state 0 is the first), and the two tables of what may end.

    Symbols: paragraph end, list item, mark that may end, Thai letters, blank, then for each character of a quotation
    four by whether the sentence may end with it and whether it can open.
    """
    states = [(None, 0, t) for t in (0, 1)] + [(k, n, t) for k in range(len(KINDS)) for n in range(1, DEPTH + 1) for t in (0, 1)]
    index = {s: i for i, s in enumerate(states)}
    symbols = QUOTE + 4 * len(QUOTE_CHARS)
    step, out = np.zeros((len(states), symbols), np.int16), np.zeros((len(states), symbols), np.int8)
    for (kind, depth, thai), i in index.items():
        step[i, PARAGRAPH], out[i, PARAGRAPH] = 0, 1
        step[i, ITEM], out[i, ITEM] = 0, 1
        step[i, END], out[i, END] = (index[None, 0, 0], 1) if kind is None else (i, 0)
        step[i, THAI] = index[kind, depth, 1]
        step[i, BLANK], out[i, BLANK] = (index[None, 0, 0], 1) if kind is None and thai else (i, 0)
        for c, mark in enumerate(QUOTE_CHARS):
            for ends in (0, 1):
                for can_open in (0, 1):
                    to, act = (kind, depth, thai), 0
                    if kind is not None and mark in PAIRS[KINDS[kind]]:
                        to = (kind, depth - 1, thai) if depth > 1 else (None, 0, thai)
                        if depth == 1 and ends:
                            to, act = (None, 0, 0), 1
                    elif mark in PAIRS and can_open:
                        if kind is None:
                            to = (KINDS.index(mark), 1, thai)
                        elif KINDS[kind] == mark and mark != '"':
                            to = (kind, min(depth + 1, DEPTH), thai)
                    s = QUOTE + 4 * c + 2 * ends + can_open
                    step[i, s], out[i, s] = index[to], act
    either = ["0", "1"]
    return step, out, _table(MARK_RULES, MARK, WORD, either, LAST, either, NEXT).tolist(), _table(CLOSE_RULES, either, BEFORE, LAST, either, NEXT).tolist()


@functools.cache
def _word_counts() -> list[set[int]]:
    """By gap, what may follow a full stop for the word before it to make a difference."""
    dot = np.array(compile_rules()[2])[MARK.index("dot")]
    return [{n for n in range(len(NEXT)) if len(np.unique(dot[:, :, :, gap, n])) > 1} for gap in (0, 1)]


# Classes of characters and words.

def _caseless(ch: str) -> bool:
    return ch.isalpha() and not (ch.isupper() or ch.islower())


_PLAIN_NEXT = {"": 0} | {c: NEXT.index("separator") for c in ",;:—–、，；："} | {c: NEXT.index("closer") for c in ")]}»”"} | {c: NEXT.index("mark") for c in MARKS} | {c: NEXT.index("quote") for c in "“„«¿¡"}
_UPPER, _MONTH, _NAME, _CASELESS, _LISTED, _DIGIT, _OPENER, _SIGN, _OTHER = map(NEXT.index, ["upper", "month", "name", "caseless", "item", "digit", "opener", "sign", "other"])
_seen: dict[str, int] = dict(_PLAIN_NEXT)


def _next_class(text: str, at: int) -> int:
    ch = text[at : at + 1]
    c = _seen.get(ch)
    if c is None:
        if ch.isupper():
            c = _UPPER
        elif ch.isdigit():
            c = _DIGIT
        elif ch in OPENERS:
            c = _OPENER
        elif ch.islower():
            c = _NAME
        elif ch.isalpha():
            c = _CASELESS
        else:
            c = _SIGN if unicodedata.category(ch)[0] in "SN" or ch in "-*#•" else _OTHER
        _seen[ch] = c
    if c == _NAME:
        return c if NAME_LIKE.match(text, at) else _OTHER
    if c == _DIGIT:
        return _LISTED if LIST_NUMBER.match(text, at) else c
    if c == _UPPER and ch in "JFMASOND":
        return _MONTH if re.match(r"\w+", text[at : at + 24]).group(0).lower() in ORDINAL_AFTER else c
    return c


def _last_class(text: str, end: int) -> tuple[int, str]:
    for i in range(end - 1, max(-1, end - MAX_BACK), -1):
        ch = text[i]
        if ch.isalpha():
            return (1 if ch.isupper() or ch.islower() else 2), ch
    return 0, ""


def _word_before(text: str, end: int) -> str:
    """The word that ends here; one glued to the sentence before it ("run.Dr") counts from its capital."""
    tail = text[max(0, end - MAX_WORD) : end][::-1]
    word = tail[: WORD_BACK.match(tail).end()][::-1]
    return JOINED.sub("", word) if not word.isalnum() else word


@functools.lru_cache(65536)
def _told_word(word: str) -> tuple[int, int]:
    """Class of a word by itself; numbers are told by their surroundings afterwards."""
    low = word.lower()
    glued = int(len(word) > 1 and (word[-1].islower() or word[-1].isdigit()) and low not in HARD and not ("/" in word or "@" in word or low.startswith("www.")))
    if low in SOFT:
        return 1, glued
    if low in HARD or (len(word) == 1 and word.isalpha()) or INITIALS.fullmatch(word):
        return 2, glued
    return (5 if word.isdigit() else 0), glued


def _word_class(text: str, end: int, first: bool) -> tuple[int, int]:
    word = _word_before(text, end)
    kind, glued = _told_word(word)
    if kind == 5:
        if (first and end <= 80 and FIRST_HEADING.match(text[:end])) or LATER_HEADING.search(text[max(0, end - 80) : end]):
            kind = 3
        elif len(word) > 2:
            kind = 0
        else:
            start = end - len(word)
            while start > 0 and text[start - 1].isspace():
                start -= 1
            kind = 4 if _word_before(text, start).lower() in ORDINAL_BEFORE else 5
    return kind, glued


def symbols(text: str, thai: bool, first: bool = True) -> Iterator[tuple[int, int]]:
    """Symbols of a text, or of a chunk that begins at a safe place, and the place after each. ``first``: the text begins here."""
    _, _, may_end, may_close = compile_rules()
    finder, skip, closing, counts = (EVENT if thai else EVENT_NO_BLANK), SPACE.match, CLOSING.match, _word_counts()
    for m in finder.finditer(text):
        i, j = m.span()
        ch = text[i]
        if ch in QUOTE_PLACE:
            after = text[j : j + 1]
            if ch == "’" and after.isalpha():
                continue
            can_open = 1
            if ch in "\"‘":
                before = text[i - 1 : i] if i else ""
                can_open = int(bool(after) and not after.isspace() and (not before or not before.isalnum() or _caseless(before)))
            elif ch == "(" and not after:
                can_open = 0
            k = i
            while k > 0 and (text[k - 1] in CLOSERS or text[k - 1].isspace()):
                k -= 1
            ends = 0
            mark = text[k - 1] if k else ""
            if mark and mark in MARKS:
                inside = 4 if mark not in STRONG else 2 if mark in "。！？｡" else 3
                if mark == "." and ch in BRACKETS and ((word := _word_before(text, k - 1).lower()) in SOFT or word in HARD):
                    inside = 1
                e = closing(text, j).end()
                at = skip(text, e).end()
                ends = may_close[ch in BRACKETS][inside][_last_class(text, k)[0]][at > e][_next_class(text, at)]
                if ends:
                    j = e
            yield QUOTE + 4 * QUOTE_PLACE[ch] + 2 * ends + can_open, j
        elif ch == "\n":
            yield (PARAGRAPH if text.find("\n", i + 1, j) >= 0 else ITEM), j
        elif ch == " ":
            yield BLANK, j
        elif "\u0e00" <= ch <= "\u0e7f":
            yield THAI, j
        else:
            run, word, glued, last, e = text[j - 1], 0, 0, 0, j
            if ch in ";\u037e":
                letter = _last_class(text, i)[1]
                if not (letter and ("\u0370" <= letter <= "\u03ff" or "\u1f00" <= letter <= "\u1fff")):
                    continue
                mark = 6
            elif run in STRONG:
                mark = 1 if run == "．" else 0
            else:
                e = closing(text, j).end()
                if run == "…" or text[max(i, j - 2) : j] == "..":
                    mark, last = 2, _last_class(text, i)[0]
                elif run in ASKS:
                    mark = 4 if run == "؟" else 3
                else:
                    mark = 5
            at = skip(text, e).end()
            gap, follows = at > e, _next_class(text, at)
            if mark == 5 and follows in counts[gap]:  # otherwise no rule asks for the word
                word, glued = _word_class(text, i, first)
            if may_end[mark][word][glued][last][gap][follows]:
                while text[j : j + 1] and text[j] in CLOSERS and text[j] != '"':
                    j += 1
                yield END, j


def sentence_spans(text: str, thai: bool | None = None) -> list[tuple[int, int]]:
    """The sentences of a whole text."""
    step, out = _lists()
    state, a, spans = 0, 0, []
    for s, j in symbols(text, bool(re.search("[\u0e00-\u0e7f]", text)) if thai is None else thai):
        if out[state][s] and j > a:
            _add(text, a, j, spans)
            a = j
        state = step[state][s]
    _add(text, a, len(text), spans)
    return spans


def _add(text: str, a: int, b: int, spans: list[tuple[int, int]]) -> None:
    start = SPACE.match(text, a, b).end()
    while b > start and text[b - 1].isspace():
        b -= 1
    if b > start:
        spans.append((start, b))


@functools.cache
def _lists() -> tuple[list, list]:
    step, out, _, _ = compile_rules()
    return step.tolist(), out.tolist()


def chunks_of(text: str, chunk: int) -> Iterator[tuple[int, str]]:
    """(place, text) of chunks of at least ``chunk`` characters that begin at safe places; in one pass."""
    a, n = 0, len(text)
    while a < n:
        m = SAFE.search(text, a + chunk)
        b = m.end() if m else n
        yield a, text[a:b]
        a = b


def transition(events: list[int], step: np.ndarray) -> np.ndarray:
    """The state after a chunk for every state before it."""
    f = np.arange(len(step), dtype=np.int16)
    for s in events:
        f = step[f, s]
    return f


def chunk_symbols(text: str, thai: bool, base: int) -> tuple[list[int], list[int], list[int], list[int], int, int]:
    """A chunk's symbols, the place after each, the end of what stands before that place, the start of what follows; its own first and last place.

    White space at either end is the same as in the whole text, as a chunk begins with a letter.
    """
    s, j, ends, starts = [], [], [], []
    for symbol, at in symbols(text, thai, base == 0):
        e = at
        while e > 0 and text[e - 1].isspace():
            e -= 1
        s.append(symbol), j.append(base + at), ends.append(base + e), starts.append(base + SPACE.match(text, at).end())
    return s, j, ends, starts, base + SPACE.match(text).end(), base + len(text.rstrip())


def chunk_spans(events: tuple, state: int, opened: int | None, final: bool) -> tuple[list[tuple[int | None, int]], int | None]:
    """Sentences that end in the chunk (the first with the start ``opened``), and the start of the one left open.

    ``opened`` is None where the start is in an earlier chunk; so is the result if no sentence ends here.
    """
    step, out = _lists()
    found, start, cut_at = [], opened, -1
    for s, j, e, nxt in zip(*events[:4]):
        if out[state][s] and j > cut_at:
            if start is None or e > start:
                found.append((start, e))
            start, cut_at = nxt, j
        state = step[state][s]
    if final and (start is None or events[5] > start):
        found.append((start, events[5]))
    return found, start


def scan(functions: DataFrame) -> DataFrame:
    """``k``, ``c``, ``state``: the state before every chunk, from ``k``, ``c`` (0, 1, ..), ``f`` (state after by state before).

    A tree: up, ``FANOUT`` neighbours are composed into one function until each text has one; down, every node hands
    its children their first states. No row ever holds more than ``FANOUT`` functions.
    """
    # A function's k-th child begins in the state that the children before it lead to.
    lead = F.aggregate("fs", F.array(F.col("state")), lambda acc, x: F.concat(acc, F.array(F.element_at(x["f"], F.element_at(acc, -1) + 1))))
    whole = F.aggregate("fs", F.transform(F.get("fs", F.lit(0))["f"], lambda x, i: i.cast("int")), lambda acc, x: F.transform(acc, lambda s: F.element_at(x["f"], s + 1)))
    parent = F.floor(F.col("c") / FANOUT).cast("int").alias("c")
    levels, top = [], functions.select("k", "c", "f")
    while (top.agg(F.max("c")).first()[0] or 0) > 0:
        gathered = cut(top.groupBy("k", parent).agg(F.array_sort(F.collect_list(F.struct("c", "f"))).alias("fs")))
        levels.append(gathered)
        top = gathered.select("k", "c", whole.alias("f"))
    first = top.select("k", "c", F.lit(0).alias("state"))
    for gathered in reversed(levels):
        given = gathered.join(first, ["k", "c"]).select("k", "c", F.posexplode(F.slice(lead, 1, F.size("fs"))).alias("i", "state"))
        first = given.select("k", (F.col("c") * FANOUT + F.col("i")).cast("int").alias("c"), "state")
    return first


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per sentence: key, ``sent_no`` from 1, ``sent_start``, ``sent_end`` (exclusive).

    Texts of one chunk need no exchange. Longer ones are cut, each in one pass, and their chunks spread over the
    cluster; from then on only symbols and functions move.
    """
    kind = documents.schema[key].dataType.simpleString()
    docs = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(text).rlike(THAI_LETTER).alias("thai"))
    columns = ["k", "sent_no", "sent_start", "sent_end"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, no, lo, hi = [], [], [], []
            for r, (t, thai) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = sentence_spans(t, thai)
                rows += [r] * len(found)
                no += range(1, len(found) + 1)
                lo += [a for a, _ in found]
                hi += [b for _, b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], columns)

    # Lengths are compared in bytes, so that the JVM needn't count characters.
    short = docs.where(F.octet_length("t") <= chunk).mapInArrow(whole, f"k {kind}, sent_no bigint, sent_start bigint, sent_end bigint")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (t, thai) in enumerate(zip(batch.column("t").to_pylist(), batch.column("thai").to_pylist())):
                k = batch.column("k").slice(r, 1)
                for c, (base, part) in enumerate(chunks_of(t, chunk)):
                    yield pa.RecordBatch.from_arrays([k, pa.array([c], pa.int32()), pa.array([base], pa.int64()), pa.array([part]), pa.array([thai]), pa.array([base + len(part) == len(t)])], ["k", "c", "base", "part", "thai", "final"])

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = compile_rules()[0]
        for batch in batches:
            d = batch.to_pydict()
            found = [chunk_symbols(t, thai, base) for t, thai, base in zip(d["part"], d["thai"], d["base"])]
            arrays = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in range(4)] + [pa.array([x[i] for x in found], pa.int64()) for i in (4, 5)]
            f = pa.array([transition(x[0], step).tolist() for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("c"), batch.column("final"), *arrays, f], ["k", "c", "final", "s", "j", "ends", "starts", "low", "high", "f"])

    lists = "s array<bigint>, j array<bigint>, ends array<bigint>, starts array<bigint>, low bigint, high bigint"
    cuts = docs.where(F.octet_length("t") > chunk).mapInArrow(cut_up, f"k {kind}, c int, base bigint, part string, thai boolean, final boolean")
    known = cut(cuts.repartition("k", "c").mapInArrow(functions, f"k {kind}, c int, final boolean, {lists}, f array<int>"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            rows, no, lo, hi, many, left = [], [], [], [], [], []
            for r, c in enumerate(d["c"]):
                events = tuple(d[x][r] for x in ("s", "j", "ends", "starts", "low", "high"))
                found, start = chunk_spans(events, d["state"][r], events[4] if c == 0 else None, d["final"][r])
                # The row with number 0 tells how many sentences end in the chunk and where the next one begins.
                for n, (a, b) in enumerate([(None, 0), *found]):
                    rows.append(r), no.append(n), lo.append(a), hi.append(b), many.append(len(found)), left.append(start)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k").take(at), batch.column("c").take(at), *[pa.array(x, pa.int64()) for x in (no, lo, hi, many, left)]], ["k", "c", "no", "a", "b", "many", "left"])

    spans = cut(known.join(scan(known), ["k", "c"]).select("k", "c", "final", "s", "j", "ends", "starts", "low", "high", "state").mapInArrow(finished, f"k {kind}, c int, no bigint, a bigint, b bigint, many bigint, left bigint"))
    earlier = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)  # chunks of one text
    carried = spans.where("no = 0").select("k", "c", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("before"), F.last("left", ignorenulls=True).over(earlier).alias("opened"))
    long = spans.where("no > 0").join(carried, ["k", "c"]).select("k", (F.col("before") + F.col("no")).alias("sent_no"), F.coalesce("a", "opened").alias("sent_start"), F.col("b").alias("sent_end"))
    return short.unionByName(long).withColumnRenamed("k", key)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))).select("doc_id", "sent_start", "sent_end")


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the sentences, per document that has any: they hold every character but white space, in order and without it at their ends."""
    documents = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    found = sentences(spread(documents)).join(documents, "doc_id")
    body = F.substr("text", F.col("sent_start").cast("int") + 1, (F.col("sent_end") - F.col("sent_start")).cast("int"))
    space = r"(?U)\s"
    each = found.select("doc_id", "sent_start", "sent_end", F.length(F.regexp_replace(body, space, "")).alias("n"), body.rlike(rf"\A{space[4:]}|{space[4:]}\z").alias("loose"))
    held = each.groupBy("doc_id").agg(F.sum("n").alias("held_chars"), F.min("sent_start").alias("first_start"), F.max("sent_end").alias("last_end"), F.count_if("loose").alias("loose_ends"), F.array_sort(F.collect_list(F.struct("sent_start", "sent_end"))).alias("all"))
    # A document's sentences are bounded by its own text.
    crossed = F.size(F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: (i > 1) & (F.get("all", i - 1)["sent_start"] < F.get("all", i - 2)["sent_end"])))
    return held.select("doc_id", "held_chars", "first_start", "last_end", "loose_ends", crossed.alias("crossed"))
