"""Queries over undecoded lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.strict_lines import LABELS, LAYOUTS, STRATA, rejected_lines, strict_rows, typed_rows


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/raw_lines.parquet").select("line_id", "corpus", "raw_line")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_lines(_lines(spark, d)).select("line_id", "reason")


def p5_intents(spark: SparkSession, d: str) -> DataFrame:
    return typed_rows(strict_rows(_lines(spark, d)), "intents-v1")


def p5_ood(spark: SparkSession, d: str) -> DataFrame:
    return typed_rows(strict_rows(_lines(spark, d)), "ood-test-v3")


QUERIES = {f.__name__: f for f in (p5_found, p5_intents, p5_ood)}

# The same rules as SQL: a field is quoted, or doesn't begin with a quote.
_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*)?'
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_JUDGED = rf"""WITH l AS (SELECT line_id, corpus, CASE WHEN ends_with(raw_line, chr(13)) THEN substring(raw_line, 1, length(raw_line) - 1) ELSE raw_line END AS line FROM raw_lines WHERE raw_line IS NOT NULL),
 c AS (SELECT *, regexp_full_match(line, '{_FIELD}(?:\t{_FIELD})*') AS ok, regexp_extract_all(concat(chr(9), line), '\t({_FIELD})', 1) AS raw FROM l WHERE NOT regexp_full_match(line, '[ \t]*') AND NOT starts_with(ltrim(line, ' '), '#')),
 f AS (SELECT line_id, corpus, ok, list_transform(raw, lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ')) AS s FROM c),
 j AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN len(s) <> CASE corpus WHEN 'intents-v1' THEN 3 WHEN 'ood-test-v3' THEN 5 ELSE -1 END THEN 'columns' WHEN list_contains(s, '') THEN 'empty' WHEN NOT regexp_full_match(s[1], '[A-Za-z0-9_-]{{1,128}}') THEN 'id'
 WHEN corpus = 'intents-v1' AND s[2] NOT IN {_IN(LABELS)} THEN 'label' WHEN corpus = 'ood-test-v3' AND s[4] NOT IN {_IN(STRATA)} THEN 'stratum' WHEN length(s[-1]) > 512 OR regexp_matches(s[-1], '[\x{{FFFD}}\x00-\x08\x0A-\x1F]') THEN 'text' END AS reason FROM f)"""


def _typed(corpus: str) -> str:
    columns = ", ".join(f"s[{i + 1}] AS {c}" for i, c in enumerate(LAYOUTS[corpus].fields))
    return f"{_JUDGED} SELECT line_id, {columns} FROM j WHERE reason IS NULL AND corpus = '{corpus}'"


ORACLE: dict[str, str] = {
    "p5_found": f"{_JUDGED} SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
    "p5_intents": _typed("intents-v1"),
    "p5_ood": _typed("ood-test-v3"),
}
