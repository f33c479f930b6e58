"""Strict readers of tab-separated corpora: every line comes back typed, with the reason if it breaks a rule.

Blank lines and lines whose first visible character is ``#`` are skipped; one trailing CR is dropped; the
header must match exactly; fields are trimmed. Repeats of an id or of a text's identity are flagged on every line but
the first. :func:`load` raises on the lowest bad line, as a strict reader would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MAX_CHARS, feature_identity, normalize, tokens
from ..operators.contracts import ContractError, class_support, contrast_contract, family_sizes, group_support, label_conflicts, label_support, ood_contract, require
from ..operators.similarity import family_leaks

MAX_FILE_BYTES = 64 << 20
MAX_ROWS = 100_000
# The shapes of ids and labels in the two profiles.
ID = {"v1": r"\A[A-Za-z0-9_-]+\z", "v3": r"\A[A-Za-z0-9_-]{1,128}\z"}
LABEL = {"v1": r"\A[a-z0-9-]+\z", "v3": r"\A[a-z-]{1,64}\z"}


@dataclass(frozen=True)
class Corpus:
    """Columns of a corpus in file order, and the values of its closed ones."""

    columns: tuple[str, ...]
    profile: str
    ids: tuple[str, ...]
    closed: tuple[tuple[str, tuple[str, ...]], ...] = ()


LABELED = Corpus(("id", "label", "text"), "v1", ("id",))
OOD = Corpus(("id", "text"), "v1", ("id",))
GROUPED = Corpus(("id", "group_id", "label", "text"), "v3", ("id", "group_id"))
OPENSET_OOD = Corpus(("id", "family_id", "domain_group", "stratum", "text"), "v3", ("id", "family_id", "domain_group"), (("stratum", ("semantic", "capability", "noise")),))
CONTRAST = Corpus(("id", "pair_id", "variant", "label", "text"), "v3", ("id", "pair_id"), (("variant", ("a", "b")),))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` from 1, ``line`` of one corpus file. It is read whole, so one of more than ``MAX_FILE_BYTES`` is an error."""
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    if size is not None and size > MAX_FILE_BYTES:
        raise ContractError(f"a corpus file has {MAX_FILE_BYTES} bytes at most, not {size}")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n", -1)).alias("i", "line")).select((F.col("i") + 1).alias("line_no"), "line")


def parse(lines: DataFrame, corpus: Corpus) -> DataFrame:
    """``line_no``, the corpus' columns, ``reason`` (null: valid). The header line has reason ``header`` if it is wrong, else no row."""
    text = F.regexp_replace("line", r"\r\z", "")
    kept = lines.select("line_no", text.alias("line")).where(F.col("line").isNotNull() & ~F.col("line").rlike(r"(?U)\A\s*\z") & ~F.col("line").rlike(r"(?U)\A\s*#") | (F.col("line_no") == 1))
    fields = F.split("line", "\t", -1)
    header = F.rtrim("line") == F.lit("\t".join(corpus.columns))
    body = kept.where(F.col("line_no") > 1).withColumn("f", F.transform(fields, lambda f: F.regexp_replace(f, r"(?U)\A\s+|\s+\z", "")))
    wide = F.size("f") == len(corpus.columns)
    typed = body.select("line_no", wide.alias("wide"), *[F.when(wide, F.get("f", F.lit(i))).alias(c) for i, c in enumerate(corpus.columns)])
    reason = F.when(~F.col("wide"), "columns")
    for c in corpus.ids:
        reason = reason.when(~F.col(c).rlike(ID[corpus.profile]), c)
    for c, values in corpus.closed:
        reason = reason.when(~F.col(c).isin(*values), c)
    if "label" in corpus.columns:
        reason = reason.when(~F.col("label").rlike(LABEL[corpus.profile]), "label")
    reason = reason.when((F.col("text") == "") | (F.length("text") > MAX_CHARS), "text")
    identity = normalize("text") if corpus.profile == "v1" else feature_identity(tokens("text", "v3"))
    judged = typed.withColumn("reason", reason).withColumn("identity", F.when(F.col("reason").isNull(), identity))
    well = judged.where("reason IS NULL")
    first_id = well.groupBy("id").agg(F.min("line_no").alias("id_first"))
    first_text = well.groupBy("identity").agg(F.min("line_no").alias("text_first"))
    # Lines that broke a rule already have no key to join by and would all meet in one task.
    repeated = well.join(first_id, "id", "left").join(first_text, "identity", "left")
    again = F.when(F.col("line_no") > F.col("id_first"), "duplicate-id").when(F.col("line_no") > F.col("text_first"), "duplicate-text")
    rows = repeated.select("line_no", *corpus.columns, again.alias("reason")).unionByName(judged.where("reason IS NOT NULL").select("line_no", *corpus.columns, "reason"))
    bad_header = kept.where((F.col("line_no") == 1) & ~header).select("line_no", *[F.lit(None).cast("string").alias(c) for c in corpus.columns], F.lit("header").alias("reason"))
    return rows.unionByName(bad_header)


def load(lines: DataFrame, corpus: Corpus, max_rows: int | None = MAX_ROWS, contracts: bool = True) -> DataFrame:
    """The corpus' rows; raises with the lowest bad line, on an empty corpus, and beyond ``max_rows`` (None: no bound).

    ``contracts``: the corpus' own rules on families, pairs, strata and support must hold too.
    """
    parsed = parse(lines, corpus)
    bad = parsed.where("reason IS NOT NULL").orderBy("line_no").limit(1).collect()
    if bad:
        raise ContractError(f"line {bad[0]['line_no']}: {bad[0]['reason']}")
    rows = parsed.drop("line_no", "reason")
    n = rows.count()
    if n < 1 or (max_rows is not None and n > max_rows):
        raise ContractError(f"a corpus has 1..{max_rows or 'any number of'} rows, not {n}")
    for what, violations in corpus_contracts(rows, corpus) if contracts else ():
        require(violations, what)
    return rows


def corpus_contracts(rows: DataFrame, corpus: Corpus) -> Iterator[tuple[str, DataFrame]]:
    """What a corpus of this kind must not have."""
    if corpus is LABELED:
        yield "labels need five rows", class_support(rows, "label")
    elif corpus is GROUPED:
        yield "a group has one label", label_conflicts(rows, "group_id", "label")
        yield "labels need four groups", group_support(rows, "label", "group_id")
        yield "groups have equal sizes of three or more", family_sizes(rows, "group_id")
        yield "groups are too alike", family_leaks(rows)
    elif corpus is OPENSET_OOD:
        yield "families, domains and strata", ood_contract(rows)
    elif corpus is CONTRAST:
        yield "pairs have two variants of two labels", contrast_contract(rows, variant="variant")
        yield "labels have equal support of two or more", label_support(rows)
