"""Strict load of tab-separated lines; what doesn't conform comes back with the reason.

The load itself only admits conforming lines. Their offsets are then subtracted from all offsets (an
anti-join), and only the remainder is diagnosed, so bad lines cost nothing on the way of good ones.

Rules: one trailing CR is dropped; lines of only blanks and tabs, and those whose first non-blank
character is ``#``, are skipped. A field whose first character is a quote runs to its closing quote
(doubled quotes stand for one), and a tab or the end must follow at once; any other quote is literal.
Blanks (U+0020) at the ends of fields are dropped.

Defined results: a null line is left out everywhere; a line of a corpus without a layout has the wrong
columns; an empty table gives empty results; lines delivered twice are each judged. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A field, quoted or not; possessive throughout, so that long fields can't exhaust the stack.
FIELD = r'(?:"(?:[^"]++|"")*+"(?=\t|\z)|(?!")[^\t]*+)'
LINE = rf"\A{FIELD}(?:\t{FIELD})*+\z"
MAX_TEXT = 512
# The intents and the strata.
LABELS = ("greeting", "feeling", "reason", "ownership", "question", "goal", "observation")
STRATA = ("semantic", "capability", "noise")


@dataclass(frozen=True)
class Layout:
    """Field names of a corpus and the values its closed fields may take."""

    fields: tuple[str, ...]
    closed: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = {
    "intents-v1": Layout(("id", "label", "text"), (("label", LABELS),)),
    "ood-test-v3": Layout(("id", "family_id", "domain_group", "stratum", "text"), (("stratum", STRATA),)),
}
# Reasons in the order of their checks.
REASONS = ("quoting", "columns", "empty", "id", "label", "stratum", "text")


def candidates(raw: DataFrame, line: str = "raw_line") -> DataFrame:
    """Lines that should hold a record, without their trailing CR, as ``line``."""
    text = F.regexp_replace(line, r"\r\z", "")
    return raw.withColumn("line", text).where(F.col("line").isNotNull() & ~F.col("line").rlike(r"\A[ \t]*+\z") & ~F.col("line").rlike(r"\A *+#"))


def fields_of(line: Column) -> Column:
    """Fields of a line whose quoting is right, without quotes and blanks at the ends."""
    found = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(rf"\t({FIELD})"), F.lit(1))
    plain = F.transform(found, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    return F.transform(plain, lambda f: F.btrim(f, F.lit(" ")))


def checks(fields: Column, corpus: Column, layouts: Mapping[str, Layout]) -> list[tuple[str, Column]]:
    """Each check after quoting with the condition under which it fails."""
    value = lambda name: F.coalesce(*[F.when(corpus == c, F.get(fields, F.lit(x.fields.index(name)))) for c, x in layouts.items() if name in x.fields], F.lit(None))
    width = F.coalesce(*[F.when(corpus == c, F.lit(len(x.fields))) for c, x in layouts.items()], F.lit(-1))
    text = value("text")
    out = [
        ("columns", F.size(fields) != width),
        ("empty", F.exists(fields, lambda f: f == "")),
        ("id", ~value("id").rlike(r"\A[A-Za-z0-9_-]{1,128}\z")),
    ]
    for name in sorted({n for x in layouts.values() for n, _ in x.closed}):
        bad = [F.when(corpus == c, ~value(name).isin(*allowed)) for c, x in layouts.items() for n, allowed in x.closed if n == name]
        out.append((name, F.coalesce(*bad, F.lit(False))))
    out.append(("text", (F.length(text) > MAX_TEXT) | text.rlike(r"[\x{FFFD}\x00-\x08\x0A-\x1F]")))
    return out


def strict_rows(raw: DataFrame, offset: str = "line_id", corpus: str = "corpus", line: str = "raw_line", layouts: Mapping[str, Layout] = LAYOUTS) -> DataFrame:
    """The valid records of all corpora: offset, corpus, ``fields``."""
    well = candidates(raw, line).where(F.col("line").rlike(LINE)).select(offset, corpus, fields_of(F.col("line")).alias("fields"))
    for _, fails in checks(F.col("fields"), F.col(corpus), layouts):
        well = well.where(~F.coalesce(fails, F.lit(False)))
    return well


def typed_rows(strict: DataFrame, name: str, corpus: str = "corpus", layouts: Mapping[str, Layout] = LAYOUTS) -> DataFrame:
    """The records of one corpus with a column per field."""
    rest = [c for c in strict.columns if c not in ("fields", corpus)]
    return strict.where(F.col(corpus) == name).select(*rest, *[F.get("fields", F.lit(i)).alias(f) for i, f in enumerate(layouts[name].fields)])


def rejected_lines(raw: DataFrame, offset: str = "line_id", corpus: str = "corpus", line: str = "raw_line", layouts: Mapping[str, Layout] = LAYOUTS) -> DataFrame:
    """offset, ``raw_line``, ``reason`` of every line that isn't skipped and isn't a valid record."""
    loaded = strict_rows(raw, offset, corpus, line, layouts).select(offset)
    rest = candidates(raw, line).join(loaded, offset, "left_anti")
    fields = F.when(F.col("line").rlike(LINE), fields_of(F.col("line")))
    judged = rest.withColumn("fields", fields)
    reason = F.when(F.col("fields").isNull(), F.lit("quoting"))
    for name, fails in checks(F.col("fields"), F.col(corpus), layouts):
        reason = reason.when(F.coalesce(fails, F.lit(False)), F.lit(name))
    return judged.select(offset, F.col(line).alias("raw_line"), reason.alias("reason"))
