"""Rule-priority routing of utterances and replies from a scored model.

Each rule is a branch of one conditional expression over precomputed columns; the first that holds
wins. The fallback needs the turn within the session, which a window gives for batches and state gives
for streams (see ``streaming.sessions``). A null utterance counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_CHARS, col, contains_phrase, normalize, reflect, words
from .ranking import ranked

# Phrases that stop the conversation; matching them is no assessment of anyone.
SAFETY_PHRASES = [
    "suicide", "suicidal", "kill myself", "end my life", "take my life", "hurt myself", "harm myself", "self harm", "want to die",
    "don't want to live", "do not want to live", "can't go on", "cannot go on", "immediate danger",
]
# Replies.
FALLBACKS = [
    "Tell me a little more about that.",
    "What part of that stands out most to you?",
    "How did you arrive at that thought?",
    "What would change if you looked at it another way?",
]
REPLIES = {
    "empty-input": "Take your time. What would you like to examine?",
    "input-boundary": "That is more text than this small teaching demo can inspect at once. Try one short thought.",
    "safety-boundary": "This demo cannot assess or support an emergency. If you might act on thoughts of suicide or self-harm, call your local emergency number now or reach a trusted person who can stay with you.",
    "greeting": "Hello. What is on your mind today?",
    "question-return": "What answer would feel most useful to explore?",
}
INTENT_REPLIES = {
    "greeting": "Hello. What would you like to examine today?",
    "feeling": "Which part of that feeling would be useful to examine?",
    "reason": "Which part of that explanation matters most here?",
    "ownership": "How does that situation affect what you can do next?",
    "question": "What answer would feel most useful to explore?",
    "goal": "What is the smallest concrete step you could test next?",
    "observation": "What part of that observation stands out most to you?",
}
FEELING_PREFIXES = ["i feel ", "i am ", "i'm "]
REASON_MARK, OWNER_PREFIX = " because ", "my "


def trim_white(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def safety_match(toks: Column) -> Column:
    hit = F.lit(False)
    for phrase in SAFETY_PHRASES:
        hit = hit | contains_phrase(toks, phrase)
    return hit


def boundary(trimmed: Column) -> Column:
    """``empty-input``, ``input-boundary`` or null."""
    return F.when(trimmed == "", "empty-input").when(F.length(trimmed) > MAX_CHARS, "input-boundary")


def _prepared(rows: DataFrame, text: str) -> DataFrame:
    trimmed = rows.withColumn("__t", trim_white(F.coalesce(col(text), F.lit(""))))
    normal = trimmed.withColumn("__n", normalize("__t"))
    return normal.withColumn("__w", words("__n"))


def _fallback(turn: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, FALLBACKS)), (F.pmod(turn - 1, F.lit(len(FALLBACKS))) + 1).cast("int"))


def rule_route(rows: DataFrame, text: str = "text", turn: Column | None = None) -> DataFrame:
    """``rows`` with ``rule_id``, ``keyword``, ``fragment`` and ``reply``; without ``turn`` every row begins a session."""
    p = _prepared(rows, text)
    n, w = F.col("__n"), F.col("__w")
    after = lambda prefix: F.substring(n, F.lit(len(prefix) + 1), F.length(n))
    feeling, prefix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for x in reversed(FEELING_PREFIXES):
        feeling = F.when(n.startswith(x), after(x)).otherwise(feeling)
        prefix = F.when(n.startswith(x), F.lit(x.strip())).otherwise(prefix)
    reason = F.substring(n, F.locate(REASON_MARK, n) + len(REASON_MARK), F.length(n))
    rule = (
        F.when(boundary(F.col("__t")).isNotNull(), boundary(F.col("__t")))
        .when(safety_match(w), "safety-boundary")
        .when(F.array_contains(w, "hello") | F.array_contains(w, "hi") | (n == "hey"), "greeting")
        .when(feeling.isNotNull(), "feeling-reflection")
        .when(n.contains(REASON_MARK), "because-probe")
        .when(n.startswith(OWNER_PREFIX), "ownership-reflection")
        .when(n.endswith("?"), "question-return")
        .otherwise("fallback")
    )
    routed = p.withColumn("rule_id", rule)
    r = F.col("rule_id")
    part = F.when(r == "feeling-reflection", feeling).when(r == "because-probe", reason).when(r == "ownership-reflection", after(OWNER_PREFIX))
    routed = routed.withColumn("fragment", F.when(part.isNotNull(), reflect(words(part))))
    keyword = (
        F.when(r == "safety-boundary", F.lit("matched safety phrase")).when(r == "greeting", F.lit("hello")).when(r == "feeling-reflection", prefix)
        .when(r == "because-probe", F.lit("because")).when(r == "ownership-reflection", F.lit("my")).when(r == "question-return", F.lit("question"))
    )
    reply = F.when(r == "feeling-reflection", F.concat(F.lit("What makes you feel "), "fragment", F.lit("?")))
    reply = reply.when(r == "because-probe", F.concat(F.lit("What makes "), "fragment", F.lit(" an important reason for you?")))
    reply = reply.when(r == "ownership-reflection", F.concat(F.lit("How does your "), "fragment", F.lit(" affect you?")))
    for name, said in REPLIES.items():
        reply = reply.when(r == name, F.lit(said))
    reply = reply.otherwise(_fallback(F.lit(1) if turn is None else turn))
    return routed.withColumn("keyword", keyword).withColumn("reply", reply).drop("__t", "__n", "__w")


def trace_features(contrast: Column) -> Column:
    """A reply's trace: every feature with its weight for the label less that for the runner-up."""
    return F.transform(contrast, lambda f: F.struct(f["feature"].alias("feature"), f["value"].alias("value"), (f["top_weight"] - f["runner_up_weight"]).alias("weight"), f["contribution"].alias("contribution")))


def session_turns(rows: DataFrame, session: str, order: list[str], out: str = "turn") -> DataFrame:
    """The number of each utterance within its session; every utterance counts, empty ones too."""
    return ranked(rows, [session], [F.col(c) for c in order], out)


def rule_route_session(rows: DataFrame, session: str, order: list[str], text: str = "text") -> DataFrame:
    return rule_route(session_turns(rows, session, order), text, F.col("turn"))


def model_route(rows: DataFrame, text: str = "text", label: str = "label", accepted: str = "accepted", turn: Column | None = None) -> DataFrame:
    """Replies by predicted label; boundaries and safety come first, a label without a reply is never accepted."""
    p = _prepared(rows, text)
    said = F.create_map(*[F.lit(x) for pair in INTENT_REPLIES.items() for x in pair])
    answer = F.try_element_at(said, col(label))
    taken = col(accepted) & answer.isNotNull()
    stop = F.coalesce(boundary(F.col("__t")), F.when(safety_match(F.col("__w")), F.lit("safety-boundary")))
    rule = F.coalesce(stop, F.when(F.coalesce(taken, F.lit(False)), F.lit("ml-intent")).otherwise(F.lit("ml-abstain")))
    routed = p.withColumn("rule_id", rule)
    r = F.col("rule_id")
    reply = F.when(r == "ml-intent", answer).when(r == "ml-abstain", _fallback(F.lit(1) if turn is None else turn))
    for name in ("empty-input", "input-boundary", "safety-boundary"):
        reply = reply.when(r == name, F.lit(REPLIES[name]))
    keyword = F.when(r == "safety-boundary", F.lit("matched safety phrase")).when(r.startswith("ml-"), col(label))
    return routed.withColumn("keyword", keyword).withColumn("reply", reply).drop("__t", "__n", "__w")
