"""Strict JSON lines of exactly ``{"id": string, "text": string}``.

Other fields, other types, malformed text, oversize lines, bad ids and texts each give a reason; blank
lines are skipped. Works on batches and streams alike, but for repeated ids, which need the whole batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_CHARS
from ..operators.contracts import ContractError

MAX_LINE_BYTES = MAX_CHARS * 4 + 16_384
MAX_ROWS, MAX_BYTES = 100_000, 64 << 20
SHAPE = "OBJECT<id: STRING, text: STRING>"


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """The input's other columns, ``id``, ``text``, ``reason`` (null: valid)."""
    others = [c for c in lines.columns if c != line]
    raw = F.regexp_replace(line, r"\r\z", "")
    kept = lines.select(*others, raw.alias("__l")).where(F.col("__l").isNotNull() & ~F.col("__l").rlike(r"(?U)\A\s*\z"))
    value = F.when(F.octet_length("__l") <= MAX_LINE_BYTES, F.try_parse_json("__l"))
    shaped = kept.withColumn("__v", value)
    fits = F.schema_of_variant("__v") == SHAPE
    got = shaped.withColumns({"id": F.when(fits, F.try_variant_get("__v", "$.id", "string")), "text": F.when(fits, F.try_variant_get("__v", "$.text", "string"))})
    reason = (
        F.when(F.octet_length("__l") > MAX_LINE_BYTES, "oversize").when(~F.coalesce(fits, F.lit(False)), "shape")
        .when(~F.col("id").rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), "id").when(F.col("text").rlike(r"(?U)\A\s*\z") | (F.length("text") > MAX_CHARS), "text")
    )
    return got.select(*others, "id", "text", reason.alias("reason"))


def parse_audit(lines: DataFrame, number: str = "line_no", line: str = "line") -> DataFrame:
    """As :func:`parse` for a batch, with ``duplicate-id`` on every repeat but the first by ``number``."""
    parsed = parse(lines, line)
    first = parsed.where("reason IS NULL").groupBy("id").agg(F.min(number).alias("__first"))
    kept = [c for c in parsed.columns if c != "reason"]
    # Bad lines may have no id to join by and would all meet in one task.
    repeated = parsed.where("reason IS NULL").join(first, "id", "left").select(*kept, F.when(F.col(number) > F.col("__first"), "duplicate-id").alias("reason"))
    return repeated.unionByName(parsed.where("reason IS NOT NULL"))


def require_limits(lines: DataFrame, line: str = "line") -> None:
    """Raises if an audit's input has more lines or bytes than it may."""
    got = limits(lines, line).first()
    if not got["within"]:
        raise ContractError(f"an audit takes {MAX_ROWS} lines and {MAX_BYTES} bytes at most, not {got['lines']} and {got['bytes']}")


def limits(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row: ``lines``, ``bytes`` and whether they are within an audit's limits. Blank lines count."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).alias("bytes")).withColumn("within", (F.col("lines") <= MAX_ROWS) & (F.col("bytes") <= MAX_BYTES))
