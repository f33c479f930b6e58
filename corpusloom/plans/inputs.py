"""Inputs derived from the given tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import spread

LABELS = ["feeling", "goal", "greeting", "observation", "ownership", "question", "reason"]

# SQL fragments. White space is spelled out because the SQL engine's \s is ASCII only.
WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NORM = rf"trim(regexp_replace(translate(lower({{0}}), '’‘', ''''''), '{WS}', ' ', 'g'), ' ')"


def norm_sql(text: str) -> str:
    return NORM.replace("{0}", text)


# NFKC for the characters of the test tables, since SQL has only NFC: width forms, kinds of space, raised and circled digits, a ligature.
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F) if c != 0x27)
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _PLAIN)
_SPACES = "      　"
_RAISED, _RINGED = "⁰¹²³⁴⁵⁶⁷⁸⁹", "⓪①②③④⑤⑥⑦⑧⑨"
_WIDE_QUOTE, _LIGATURE, _LUNATE, _SIGMA = "＇", "ﬁ", "ϲ", "ς"


def nfkc_sql(text: str) -> str:
    mapped = f"translate({text}, '{_WIDE}{_SPACES}{_RAISED}{_RINGED}{_LUNATE}', '{_PLAIN}{' ' * len(_SPACES)}{'0123456789' * 2}{_SIGMA}')"
    return f"nfc_normalize(replace(replace({mapped}, '{_WIDE_QUOTE}', ''''), '{_LIGATURE}', 'fi'))"


def tokens_sql(text: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({norm_sql(text)}, '[^\p{{L}}\p{{N}}'']+'), lambda w: trim(w, '''')), lambda w: w <> '')"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Labelled prompts: ``row_no``, ``id``, ``label``, ``text``."""
    return spread(table(spark, d, "intents_v1").select("row_no", "id", "label", "text")).where("text IS NOT NULL")


PROMPTS = "SELECT row_no, id, label, text FROM intents_v1 WHERE text IS NOT NULL"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Prompts whose label is one of the seven."""
    return prompts(spark, d).where(F.col("label").isin(LABELS))


LABELLED = f"{PROMPTS} AND label IN ({', '.join(repr(x) for x in LABELS)})"

# Utterances of event sessions: templates by event number over the event type.
UTTERANCE = """CASE event_id % 10
 WHEN 0 THEN concat('Hello ', event_type) WHEN 1 THEN 'hey' WHEN 2 THEN concat('I feel my ', event_type, ' is mine') WHEN 3 THEN concat('I''m ', event_type)
 WHEN 4 THEN concat('It stops because my ', event_type, ' because you are') WHEN 5 THEN concat('My ', event_type, ' hurts me') WHEN 6 THEN concat('Is it ', event_type, ' ?')
 WHEN 7 THEN ' ' WHEN 8 THEN repeat('x', 513) ELSE concat(event_type, ' at noon') END"""
UTTERANCES = f"SELECT event_id, user_id, ts, {UTTERANCE} AS text FROM events"


def utterances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id", "user_id", "ts", f"{UTTERANCE.replace('I' + chr(39) * 2 + 'm', 'I' + chr(92) + chr(39) + 'm')} AS text")


# A ledger of predictions: labels A, N, R; confidence and margin from few distinct values, so ties abound.
LEDGER_COLUMNS = """l_orderkey AS order_no, l_linenumber AS line_no, l_returnflag AS actual,
 CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS predicted,
 CAST(0.5 AS DOUBLE) + l_discount * 4 AS confidence, l_tax * 5 AS margin,
 (CAST(0.5 AS DOUBLE) + l_discount * 4 >= CAST(0.65 AS DOUBLE) AND l_tax * 5 >= CAST(0.1 AS DOUBLE)) AS accepted"""
LEDGER = f"SELECT {LEDGER_COLUMNS} FROM lineitem"


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*[x for x in _split_columns(LEDGER_COLUMNS)])


def _split_columns(sql: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in sql:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


# Scores outside the labelled domain, by event type as stratum.
OOD_SCORES = "SELECT event_id, event_type AS stratum, CAST(0.4 AS DOUBLE) + (event_id % 13) * CAST(0.04 AS DOUBLE) AS confidence, (event_id % 7) * CAST(0.05 AS DOUBLE) AS margin FROM events"


def ood_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id", "event_type AS stratum", "CAST(0.4 AS DOUBLE) + (event_id % 13) * CAST(0.04 AS DOUBLE) AS confidence", "(event_id % 7) * CAST(0.05 AS DOUBLE) AS margin")
