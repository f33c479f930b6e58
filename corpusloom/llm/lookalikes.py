"""One consistent form for texts that look the same.

The form folds width forms, ways of composing accents and letters, kinds of white space, invisible
characters, blanks at the ends and the script of look-alike letters. Letter case, accents,
punctuation, and raised or circled digits stay.

Most text is already in that form. A quick-check property per character (built from the Unicode data,
not listed) tells which ones can change or combine with what precedes. Texts without any stay inside
the JVM; in the others only the runs of such characters, with the one stable character before each
as context, are normalised and spliced into the unchanged rest.

Defined results: a null text has a null form; an empty text, or one of blanks or invisible
characters only, has the empty form; every stored row counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.checkpoints import cut
from ..operators.joins import lookup_join
from ..operators.layout import spread

HEAVY_SHARE = 1000  # forms with more than one in so many rows are joined by broadcast; there can be no more of them than this

# Letters drawn like a Latin one, by the Latin one they look like.
LOOKALIKES = {
    "a": "аɑ", "c": "сϲᴄ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօᴏ", "p": "рρ", "q": "ԛ", "s": "ѕꜱ", "u": "ս", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Ꮮ", "M": "МΜϺ", "N": "ΝՆ", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
}
# Kinds of compatibility mapping that don't show, and invisible characters besides category Cf.
UNSEEN_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x180B, 0x1810)}
LATIN = {ord(c): latin for latin, like in LOOKALIKES.items() for c in like}


def _fold_char(ch: str) -> str:
    """A character after decomposition, without what doesn't show."""
    code, kind = ord(ch), unicodedata.category(ch)
    if kind == "Zs" or ch in "\t\v\f":
        return " "
    if ch in "\r\x85  ":
        return "\n"
    if kind == "Cf" or code in INVISIBLE:
        return ""
    if code in LATIN:
        return LATIN[code]
    d = unicodedata.decomposition(ch)
    if d.startswith("<"):
        tag, *parts = d.split()
        to = "".join(chr(int(x, 16)) for x in parts)
        if tag in UNSEEN_KINDS or (tag == "<compat>" and all(unicodedata.category(c)[0] == "L" for c in to)):
            return "".join(_fold_char(c) for c in unicodedata.normalize("NFD", to))
    return ch


def form_of(segment: str) -> str:
    """The full normalisation, without the shortcut and without cutting blanks at the ends."""
    folded = "".join(map(_fold_char, unicodedata.normalize("NFD", segment)))
    return unicodedata.normalize("NFC", "".join(map(_fold_char, unicodedata.normalize("NFD", folded))))


def _ranges(codes: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


# Planes and parts of planes outside which no character changes or combines.
CHECKED = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)]


def unstable_codes() -> list[int]:
    """Characters whose quick check isn't a plain yes: they change by themselves or may combine."""
    seconds = set(range(0x1161, 0x1200))
    changed = []
    for code in CHECKED:
        ch = chr(code)
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<") and len(d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            seconds.add(int(d.split()[1], 16))
        if unicodedata.combining(ch) or form_of(ch) != ch:
            changed.append(code)
    return sorted({*changed, *seconds})


_classes: dict[str, str] = {}


def segment_class() -> str:
    """The inside of a character class for :func:`unstable_codes`."""
    if "inside" not in _classes:
        _classes["inside"] = "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _ranges(unstable_codes()))
    return _classes["inside"]


def splicer(inside: str) -> Callable[[str], str]:
    """Normalises only the unstable runs of a text, each with the stable character before it."""
    unstable = re.compile(f"(?:[^{inside}])?[{inside}]+")
    known: dict[str, str] = {}

    def fix(m: re.Match) -> str:
        s = m.group(0)
        if len(s) > 32:
            return form_of(s)
        if s not in known:
            if len(known) > 65536:
                known.clear()
            known[s] = form_of(s)
        return known[s]

    return lambda t: unstable.sub(fix, t)


def consistent_form(text: str) -> str:
    return splicer(segment_class())(text).strip(" ")


def may_change(text: Column) -> Column:
    """The quick check of a whole text in the JVM: whether it has more than ASCII and common accented letters that are stable.

    A class of all unstable characters costs the JVM more than the segments cost Python, which has them as a bitmap.
    """
    if "safe" not in _classes:
        unstable = set(unstable_codes())
        _classes["safe"] = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _ranges([c for c in (*range(0x20, 0x7F), *range(0xC0, 0x180)) if c not in unstable]))
    # One range is far quicker than many, and most texts pass it.
    return text.rlike("[^ -~]") & text.rlike(f"[^{_classes['safe']}]")


def consistent_forms(rows: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """``rows`` with the consistent form of ``text`` in a further column ``out``."""
    inside = segment_class()

    def splice(texts: pd.Series) -> pd.Series:
        one = splicer(inside)
        return texts.map(one, na_action="ignore")

    # Stable texts go to Python as nulls, so rows are read and checked once.
    spliced = F.pandas_udf(splice, StringType())(F.when(may_change(F.col(text)), F.col(text)))
    return rows.withColumn(out, F.btrim(F.coalesce(spliced, F.col(text)), F.lit(" ")))


def mixed_rows(forms: DataFrame, by: list[str], row: str, text: str = "text") -> DataFrame:
    """Rows whose form is written in more than one way: ``by``, ``r``, ``form_key``, ``text_key``.

    Digests stand for forms (with ``by``) and texts. A form's least and greatest text tell whether it is mixed, so copies
    of one text are one row before the exchange; a form that holds many rows doesn't gather them in one task.
    """
    form = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in by], "form")
    digest = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 16)
    keyed = cut(forms.select(*by, F.col(row).alias("r"), digest(form).alias("form_key"), digest(text).alias("text_key")))
    seen = keyed.groupBy("form_key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"), F.count(F.lit(1)).alias("rows"))
    total = keyed.count()
    mixed = seen.where("low <> high").select("form_key", "rows")
    return cut(lookup_join(keyed, mixed, "form_key", F.col("rows") * HEAVY_SHARE > F.lit(total), F.xxhash64("r")).drop("rows"))


def lookalike_pairs(forms: DataFrame, by: list[str], row: str, text: str = "text") -> DataFrame:
    """Pairs of rows, smaller first, whose forms are equal and whose texts differ.

    Pairs are made between distinct texts and then expanded to rows, so that equal copies are never
    compared with each other: the work is that of the pairs in the result.
    """
    members = mixed_rows(forms.where(F.col(text).isNotNull()), by, row, text)
    ways = members.select(*by, "form_key", "text_key").distinct()
    left = ways.withColumnRenamed("text_key", "ka")
    right = ways.withColumnRenamed("text_key", "kb")
    two = left.join(right, [*by, "form_key"]).where("ka < kb").select(*by, "ka", "kb")
    a = members.select(*by, F.col("text_key").alias("ka"), F.col("r").alias("ra"))
    b = members.select(*by, F.col("text_key").alias("kb"), F.col("r").alias("rb"))
    pairs = two.join(a, [*by, "ka"]).join(b, [*by, "kb"])
    return pairs.select(*by, F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b"))


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return (
        spread(spark.read.parquet(f"{d}/intents_v1.parquet").select("row_no", "text")).select(F.lit("intents_v1").alias("table_name"), "row_no", "text")
        .unionByName(spread(spark.read.parquet(f"{d}/ood_test_v3.parquet").select("row_no", "text")).select(F.lit("ood_test_v3").alias("table_name"), "row_no", "text"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(consistent_forms(_tables(spark, d)), ["table_name"], "row_no")


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its consistent form."""
    return consistent_forms(_tables(spark, d)).where(F.col("text").isNotNull()).select("table_name", "row_no", "form")
