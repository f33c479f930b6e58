"""Streaming forms: stateless scoring, session turns kept as state, running audits.

Session state is one counter per session, saturating, without any text. Within one micro-batch a session's
utterances are taken in the given order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import robustness
from ..operators.model import Model, score
from ..operators.router import rule_route
from ..sources.jsonl import parse

TOP_TURN = (1 << 63) - 1


def score_stream(lines: DataFrame, model: Model, line: str = "value") -> DataFrame:
    """Valid JSON lines with their prediction; lines that break a rule keep their reason and have none."""
    parsed = parse(lines.select(F.col(line).alias("line")))
    return score(parsed.where("reason IS NULL"), model)


def rejected_stream(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines' ids (where readable) and reasons; texts are left out."""
    return parse(lines.select(F.col(line).alias("line"))).where("reason IS NOT NULL").select("id", "reason")


def session_turn_stream(rows: DataFrame, session: str, order: str, text: str = "text") -> DataFrame:
    """``session``, ``order``, ``text``, ``turn``: the counter of each session goes on over micro-batches."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn = state.get[0] if state.exists else 0
        for pdf in [pd.concat(list(frames), ignore_index=True).sort_values("o", kind="stable")]:
            turns = [min(TOP_TURN, turn + i + 1) for i in range(len(pdf))]
            turn = turns[-1] if turns else turn
            state.update((turn,))
            yield pdf.assign(turn=turns)[["s", "o", "t", "turn"]]

    ready = rows.select(F.col(session).alias("s"), F.col(order).alias("o"), F.col(text).alias("t"))
    counted = ready.groupBy("s").applyInPandasWithState(count, f"s {types[session]}, o {types[order]}, t string, turn bigint", "turn bigint", "append", GroupStateTimeout.NoTimeout)
    return counted.toDF(session, order, text, "turn")


def route_stream(rows: DataFrame, session: str, order: str, text: str = "text") -> DataFrame:
    """Rule-routed replies of a stream of utterances."""
    return rule_route(session_turn_stream(rows, session, order, text), text, F.col("turn"))


def duplicate_ids_stream(lines: DataFrame, line: str = "value") -> DataFrame:
    """Running count per id for complete-mode output; an id with more than one is a failed audit, never dropped."""
    return parse(lines.select(F.col(line).alias("line"))).where("reason IS NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def audit_stream(lines: DataFrame, model: Model, line: str = "value") -> DataFrame:
    """Running audit totals per perturbation for complete-mode output, from which :func:`robustness.report` makes the reports."""
    return robustness.audit(parse(lines.select(F.col(line).alias("line"))).where("reason IS NULL"), model)
