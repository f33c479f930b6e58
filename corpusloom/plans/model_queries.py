"""Queries over scoring, training, bootstrap, audits, strict readers and bundles."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.perturb import SUITE
from ..operators import bootstrap, bundle, calibrate, experiment, metrics, model, partitions, robustness, router
from ..operators.features import Vectorizer
from ..sources import jsonl, tsv
from ..sources.sinks import json_lines
from .inputs import LABELLED, LABELS, PROMPTS, UTTERANCES, labelled, nfkc_sql, norm_sql, prompts, table, tokens_sql, utterances
from .text_queries import SAFETY, SEED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# A model with written-down weights over words, word pairs and character n-grams and all seven labels, so that SQL can repeat it.
FEATURES = [f"w1:{w}" for w in ("a", "and", "hello", "i", "in", "is", "my", "of", "the", "to", "was", "will")] + [
    "w2:i_feel", "w2:i_will", "w2:in_the", "w2:is_my", "w2:of_the", "w2:to_the", "c3:^i ", "c3:the", "c3:er ", "c3:'s ", "c4:ing ", "c4:and ", "c4:^my ", "c5: the ", "c5:tion ", "c5:^what"
]
NAMES = list(LABELS)
IDF = [1 + (i * 5 % 7) / 10 for i in range(len(FEATURES))]
WEIGHT = [[((i * 7 + k * 3 + 1) % 11 - 5) / 4 + k / 16 for i in range(len(FEATURES))] for k in range(len(NAMES))]
BIAS = [(k * 5 % 7 - 3) / 16 for k in range(len(NAMES))]
CONFIDENCE, MARGIN = 0.45, 0.1


def literal_model(profile: str = "v1", temperature: float = 1.0) -> model.Model:
    return model.Model(tuple(NAMES), tuple(FEATURES), tuple(IDF), tuple(map(tuple, WEIGHT)), tuple(BIAS), profile, Vectorizer(max_features=32), temperature, CONFIDENCE, MARGIN)


def scored_sql(source: str, key: str, temperature: float = 1.0, guard: bool = False) -> str:
    """CTEs ``v`` (key, pos, val), ``z`` (key, k, logit), ``p`` (key, k, p) and ``t`` (key, top, second, ...)."""
    voc = ", ".join("({}, '{}', {!r}::DOUBLE)".format(i, w.replace("'", "''"), IDF[i]) for i, w in enumerate(FEATURES))
    wts = ", ".join(f"({i}, {k}, {WEIGHT[k][i]!r}::DOUBLE)" for k in range(len(NAMES)) for i in range(len(FEATURES)))
    grams = " UNION ALL ".join(f"SELECT {key}, unnest(list_transform(range(1, length(b) - {n - 2}), lambda i: concat('c{n}:', substring(b, i, {n})))) AS w FROM tb" for n in (3, 4, 5))
    bs = ", ".join(f"({k}, '{n}', {BIAS[k]!r}::DOUBLE)" for k, n in enumerate(NAMES))
    text = nfkc_sql("CASE WHEN length(text) > 512 THEN '' ELSE text END") if guard else "text"
    return f"""WITH src AS ({source}), voc(pos, w, idf) AS (VALUES {voc}), wts(pos, k, wt) AS (VALUES {wts}), lab(k, label, bias) AS (VALUES {bs}),
 tt AS (SELECT {key}, {tokens_sql(text)} AS t FROM src), tb AS (SELECT {key}, t, concat('^', array_to_string(t, ' '), '$') AS b FROM tt WHERE len(t) > 0),
 tk AS (SELECT {key}, concat('w1:', unnest(t)) AS w FROM tb UNION ALL SELECT {key}, unnest(list_transform(range(1, len(t)), lambda i: concat('w2:', t[i], '_', t[i + 1]))) FROM tb UNION ALL {grams}), n AS (SELECT {key}, w, count(*) AS n FROM tk GROUP BY ALL), r AS (SELECT {key}, pos, (1 + ln(n)) * idf AS val FROM n JOIN voc USING (w)),
 v AS (SELECT {key}, pos, val / sqrt(sum(val * val) OVER (PARTITION BY {key})) AS val FROM r), s AS (SELECT {key}, k, sum(val * wt) AS s FROM v JOIN wts USING (pos) GROUP BY ALL),
 z AS (SELECT src.{key}, lab.k, label, bias + coalesce(s, 0) AS logit FROM src CROSS JOIN lab LEFT JOIN s ON s.{key} = src.{key} AND s.k = lab.k),
 e AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY {key})) / {temperature!r}::DOUBLE) AS e FROM z), p AS (SELECT {key}, k, label, logit, e / sum(e) OVER (PARTITION BY {key}) AS p FROM e),
 o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p DESC, k) AS place FROM p),
 t AS (SELECT a.{key}, a.k AS top, a.label AS label, b.k AS second, b.label AS runner_up, a.p AS confidence, a.p - b.p AS margin, a.logit - b.logit AS logit_margin, a.p >= {CONFIDENCE}::DOUBLE AND a.p - b.p >= {MARGIN}::DOUBLE AND EXISTS (SELECT 1 FROM v WHERE v.{key} = a.{key}) AS accepted FROM o a JOIN o b ON a.{key} = b.{key} WHERE a.place = 1 AND b.place = 2)"""


S = scored_sql(f"SELECT row_no, text FROM ({PROMPTS})", "row_no")
T_V3 = 0.5


def _scored(s: SparkSession, d: str, m: model.Model | None = None) -> DataFrame:
    return model.score(prompts(s, d).select("row_no", "text"), m or literal_model())


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"{S} SELECT row_no, label, round(logit, 6) AS logit FROM z")
def logits(s, d):
    names = F.array(*map(F.lit, NAMES))
    return rounded(_scored(s, d).select("row_no", F.posexplode("logits").alias("k", "logit")).select("row_no", F.get(names, F.col("k")).alias("label"), "logit"), "logit")


@query(f"{S} SELECT row_no, label, round(p, 6) AS probability FROM p")
def softmax(s, d):
    return rounded(_scored(s, d).select("row_no", F.explode("probabilities").alias("label", "probability")), "probability")


@query(f"{S} SELECT row_no, label, runner_up, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM t")
def top2_margin(s, d):
    return rounded(_scored(s, d).select("row_no", F.col("predicted").alias("label"), "runner_up", "confidence", "margin"), "confidence", "margin")


@query(f"{S}, c AS (SELECT v.row_no, w AS feature, val * wt AS c FROM v JOIN voc USING (pos) JOIN t USING (row_no) JOIN wts ON wts.pos = v.pos AND wts.k = t.top WHERE val * wt > 0), q AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY c DESC, feature) AS place FROM c) SELECT row_no, feature, round(c, 6) AS contribution FROM q WHERE place <= 8")
def top_features_v1(s, d):
    return rounded(_scored(s, d).select("row_no", F.explode("top_features").alias("f")).select("row_no", "f.feature", "f.contribution"), "contribution")


V3 = scored_sql(f"SELECT row_no, text FROM ({PROMPTS})", "row_no", T_V3, True)


def _scored_v3(s: SparkSession, d: str) -> DataFrame:
    return model.score(prompts(s, d).select("row_no", "text"), literal_model("v3", T_V3))


@query(f"{V3}, c AS (SELECT v.row_no, w AS feature, val * (a.wt - b.wt) AS c, logit_margin FROM v JOIN voc USING (pos) JOIN t USING (row_no) JOIN wts a ON a.pos = v.pos AND a.k = t.top JOIN wts b ON b.pos = v.pos AND b.k = t.second), q AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY abs(round(c, 9)) DESC, feature) AS place FROM c) SELECT row_no, feature, round(c, 6) AS contribution, round(logit_margin, 6) AS logit_margin, round(logit_margin, 6) AS reconstructed_margin FROM q WHERE place <= 8")
def contrastive_explanation(s, d):
    return rounded(_scored_v3(s, d).select("row_no", F.explode("contrast").alias("f"), "logit_margin", "reconstructed_margin").select("row_no", "f.feature", "f.contribution", "logit_margin", "reconstructed_margin"), "contribution", "logit_margin", "reconstructed_margin")


@query(f"{S} SELECT row_no, label, accepted, round(confidence, 6) AS confidence FROM t")
def predict_v1(s, d):
    return rounded(_scored(s, d).select("row_no", F.col("predicted").alias("label"), "accepted", "confidence"), "confidence")


@query(f"{V3} SELECT row_no, label, accepted, round(confidence, 6) AS confidence, runner_up FROM t")
def predict_v3(s, d):
    return rounded(_scored_v3(s, d).select("row_no", F.col("predicted").alias("label"), "accepted", "confidence", "runner_up"), "confidence")


@query(f"{S} SELECT row_no, concat('\"accepted\":', accepted, ',\"predicted\":\"', label, '\"') AS part FROM t")
def predict_jsonl(s, d):
    """Predictions as JSON lines; the fixed part of each line."""
    lines = json_lines(_scored(s, d), "row_no", ["accepted", "predicted"], ["row_no"])
    return lines.select(F.get_json_object("value", "$.row_no").cast("bigint").alias("row_no"), F.regexp_extract("value", r'"prediction":\{(.*)\}\}$', 1).alias("part"))


def route_model_sql(scored: str, source: str) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    said = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in router.INTENT_REPLIES.items())
    fixed = " ".join(f"WHEN {q(k)} THEN {q(router.REPLIES[k])}" for k in ("empty-input", "input-boundary", "safety-boundary"))
    safety = " OR ".join(f"contains(concat(' ', array_to_string({tokens_sql('text')}, ' '), ' '), ' {p} ')" for p in SAFETY)
    return f"{scored}, u AS (SELECT src.event_id, CASE WHEN trim(text) = '' THEN 'empty-input' WHEN length(trim(text)) > 512 THEN 'input-boundary' WHEN {safety} THEN 'safety-boundary' WHEN accepted THEN 'ml-intent' ELSE 'ml-abstain' END AS rule_id, label FROM src JOIN t USING (event_id)) SELECT event_id, rule_id, CASE WHEN rule_id = 'safety-boundary' THEN 'matched safety phrase' WHEN starts_with(rule_id, 'ml-') THEN label END AS keyword, CASE rule_id {fixed} WHEN 'ml-intent' THEN CASE label {said} END ELSE {q(router.FALLBACKS[0])} END AS reply FROM u"


@query(route_model_sql(scored_sql(f"SELECT event_id, text FROM ({UTTERANCES})", "event_id"), ""))
def model_route_v1(s, d):
    p = model.score(utterances(s, d), literal_model())
    return router.model_route(p, label="predicted").select("event_id", "rule_id", "keyword", "reply")


@query(route_model_sql(scored_sql(f"SELECT event_id, text FROM ({UTTERANCES})", "event_id", T_V3, True), ""))
def model_route_v3(s, d):
    p = model.score(utterances(s, d), literal_model("v3", T_V3))
    return router.model_route(p, label="predicted").select("event_id", "rule_id", "keyword", "reply")


# Training: on all labelled prompts, with the operators' default training, vectorizer and grid.

@query()
def train_softmax(s, d):
    """Weights of a model trained on all labelled prompts."""
    m = model.train(labelled(s, d))
    return s.createDataFrame([(label, term, float(w)) for label, row in zip(m.labels, m.weights) for term, w in zip(m.vocabulary, row)], "label string, term string, weight double")


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = labelled(s, d).join(partitions.stratified_split(labelled(s, d), SEED, 0.2).select("row_no", "part"), "row_no")
    return rows.where("part = 'train'"), rows.where("part = 'holdout'")


@query()
def evaluate_v1(s, d):
    """A model trained on the training part, measured on both parts."""
    train, holdout = _split(s, d)
    m = model.train(train)
    out = None
    for name, rows in (("train", train), ("holdout", holdout)):
        p = model.score(rows, m).withColumn("actual", F.col("label"))
        one = metrics.accuracy_macro_f1(p).join(metrics.selective(p).drop("n"), how="cross").select(F.lit(name).alias("part"), "n", "accuracy", "macro_f1", "coverage")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def select_candidate(s, d):
    """Candidates trained side by side and the one chosen."""
    train, holdout = _split(s, d)
    _, seen, chosen = experiment.select_model(experiment.TrainingRows(train), experiment.DevelopmentRows(holdout))
    return s.createDataFrame([(c.max_features, c.l2, c.macro_f1, i == chosen) for i, c in enumerate(seen)], "max_features int, l2 double, macro_f1 double, chosen boolean")


@query()
def calibrate_temperature(s, d):
    train, holdout = _split(s, d)
    return calibrate.calibrate_temperature(holdout, model.train(train))


@query()
def evaluate_id(s, d):
    """Confidence-aware measures of the holdout part."""
    train, holdout = _split(s, d)
    p = experiment.evaluated(holdout, model.train(train))
    return s.createDataFrame([(k, float(v)) for k, v in sorted(experiment.summary(p).items()) if v is not None], "metric string, value double")


def _boot(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predictions by a rule over the stored labels; families and domains as clusters."""
    inside = table(s, d, "grouped_examples").where("label IN ('feeling', 'goal', 'greeting', 'observation', 'ownership', 'question', 'reason') AND group_id IS NOT NULL").selectExpr(
        "label AS actual", "CASE WHEN row_no % 5 = 0 THEN 'reason' ELSE label END AS predicted", "0.5D + (row_no % 16) / 32D AS confidence", "-ln(CASE WHEN row_no % 5 = 0 THEN 0.1D ELSE 0.5D + (row_no % 16) / 32D END) AS nll", "(row_no % 8) / 8D AS brier", "group_id AS cluster"
    )
    return inside, table(s, d, "ood_test_v3").where("domain_group IS NOT NULL").selectExpr("0.25D + (row_no % 16) / 32D AS confidence", "domain_group AS cluster")


RESAMPLES = 100
_BOOT_SEED = SEED ^ bootstrap.SEED_MASK
_U64 = 18446744073709551616


def _mod(x: str) -> str:
    return f"(({x}) % {_U64}::UHUGEINT)::UBIGINT"


BOOT = f"""WITH i AS (SELECT label AS actual, CASE WHEN row_no % 5 = 0 THEN 'reason' ELSE label END AS predicted, 0.5::DOUBLE + (row_no % 16) / 32 AS confidence, -ln(CASE WHEN row_no % 5 = 0 THEN 0.1::DOUBLE ELSE 0.5::DOUBLE + (row_no % 16) / 32 END) AS nll, (row_no % 8) / 8 AS brier, group_id AS cluster, concat('0|', label) AS stratum FROM grouped_examples WHERE label IN ('feeling', 'goal', 'greeting', 'observation', 'ownership', 'question', 'reason') AND group_id IS NOT NULL),
 o AS (SELECT 0.25::DOUBLE + (row_no % 16) / 32 AS confidence, domain_group AS cluster, '1|' AS stratum FROM ood_test_v3 WHERE domain_group IS NOT NULL), cl AS (SELECT DISTINCT stratum, cluster FROM i UNION SELECT DISTINCT stratum, cluster FROM o),
 pl AS (SELECT *, row_number() OVER (ORDER BY stratum, cluster) - 1 AS slot, count(*) OVER (PARTITION BY stratum) AS sz FROM cl), pf AS (SELECT *, min(slot) OVER (PARTITION BY stratum) AS f, (SELECT count(*) FROM cl) AS d FROM pl),
 a AS (SELECT r.i AS resample, f, sz, {_mod(f'{_BOOT_SEED}::UHUGEINT + (((r.i * d + slot + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % {_U64}::UHUGEINT)')} AS z FROM pf, range({RESAMPLES}) r(i)), b AS (SELECT resample, f, sz, {_mod('(xor(z, z >> 30))::UHUGEINT * 13787848793156543929::UHUGEINT')} AS z FROM a),
 c AS (SELECT resample, f, sz, {_mod('(xor(z, z >> 27))::UHUGEINT * 10723151780598845931::UHUGEINT')} AS z FROM b), dr AS (SELECT resample, f + (xor(z, z >> 31) % sz::UBIGINT)::BIGINT AS slot FROM c), w AS (SELECT resample, slot, count(*) AS m FROM dr GROUP BY ALL),
 x AS (SELECT resample, actual, predicted, confidence, nll, brier, m FROM w JOIN pf USING (slot) JOIN i USING (stratum, cluster)), y AS (SELECT resample, confidence, sum(m) AS q FROM w JOIN pf USING (slot) JOIN o USING (stratum, cluster) GROUP BY ALL),
 ba AS (SELECT resample, sum(m) AS n, sum(m) FILTER (actual = predicted) / sum(m) AS accuracy, sum(nll * m) / sum(m) AS nll, sum(brier * m) / sum(m) AS brier FROM x GROUP BY resample),
 bi AS (SELECT resample, sum(g) AS g FROM (SELECT resample, abs(coalesce(sum(m) FILTER (actual = predicted), 0) - sum(confidence * m)) AS g FROM x GROUP BY resample, least(floor(confidence * 10), 9)) GROUP BY resample),
 lb AS (SELECT DISTINCT actual AS label FROM i), f1 AS (SELECT resample, label, 2 * coalesce(sum(m) FILTER (actual = label AND predicted = label), 0) / (coalesce(sum(m) FILTER (actual = label), 0) + coalesce(sum(m) FILTER (predicted = label), 0)) AS f1 FROM x, lb GROUP BY ALL), ma AS (SELECT resample, sum(coalesce(f1, 0)) / (SELECT count(*) FROM lb) AS macro FROM f1 GROUP BY resample),
 gp AS (SELECT coalesce(u.resample, y.resample) AS resample, coalesce(u.confidence, y.confidence) AS score, coalesce(p, 0)::DOUBLE AS p, coalesce(ok, 0)::DOUBLE AS ok, coalesce(q, 0)::DOUBLE AS q FROM (SELECT resample, confidence, sum(m) AS p, sum(m) FILTER (actual = predicted) AS ok FROM x GROUP BY ALL) u FULL JOIN y ON u.resample = y.resample AND u.confidence = y.confidence),
 cu AS (SELECT *, sum(p) OVER v AS tp, sum(q) OVER v AS fp, sum(ok) OVER v AS ct, sum(p) OVER (PARTITION BY resample) AS pp, sum(q) OVER (PARTITION BY resample) AS qq FROM gp WINDOW v AS (PARTITION BY resample ORDER BY score DESC)),
 q AS (SELECT resample, sum((1 - CASE WHEN tp > 0 THEN ct / tp ELSE 0 END) * p / pp) AS aurc, sum((p * (qq - fp) + p * q / 2) / (pp * qq)) AS auroc, sum(CASE WHEN p > 0 THEN p / pp * tp / (tp + fp) ELSE 0 END) AS aupr, min(fp / qq) FILTER (tp >= ceil(0.95::DOUBLE * pp) AND p > 0) AS fpr95 FROM cu GROUP BY resample),
 al AS (SELECT resample, unnest(['accuracy', 'macro_f1', 'nll', 'brier', 'ece', 'aurc', 'auroc', 'aupr', 'fpr95']) AS metric, unnest([accuracy, macro, nll, brier, g / n, aurc, auroc, aupr, fpr95]) AS value FROM ba JOIN bi USING (resample) JOIN ma USING (resample) JOIN q USING (resample)),
 rk AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY metric) AS n FROM al)
 SELECT metric, round(max(value) FILTER (k = floor((n - 1) * 0.025::DOUBLE)), 6) AS low, round(max(value) FILTER (k = ceil((n - 1) * 0.975::DOUBLE)), 6) AS high FROM rk GROUP BY metric"""


@query(BOOT)
def cluster_bootstrap(s, d):
    return rounded(bootstrap.cluster_bootstrap(*_boot(s, d), RESAMPLES, SEED), "low", "high")


def _first(rows: DataFrame) -> DataFrame:
    """Of rows delivered again under one id the first."""
    return rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), "row_no").alias("x")).select("id", "x.*")


@query()
def run_experiment(s, d):
    """The whole experiment on prompts whose ids, families and texts fit its contracts."""
    seven = "label IN ('feeling', 'goal', 'greeting', 'observation', 'ownership', 'question', 'reason')"
    grouped = table(s, d, "grouped_examples").where(f"{seven} AND group_id IS NOT NULL AND text IS NOT NULL").transform(_first).select(F.concat(F.lit("g-"), "id").alias("id"), F.concat(F.lit("g-"), F.lower(F.trim("group_id")), F.lit("-"), "label").alias("group_id"), "label", "text")
    ood = table(s, d, "ood_test_v3").where("family_id IS NOT NULL AND domain_group IS NOT NULL AND text IS NOT NULL").transform(_first)
    side = lambda k: ood.where(F.pmod(F.xxhash64("domain_group"), F.lit(2)) == k).select(F.concat(F.lit("o-"), "id").alias("id"), F.concat(F.lit("o-"), F.lower(F.trim("family_id"))).alias("family_id"), F.concat(F.lit("d-"), "domain_group").alias("domain_group"), "text")
    contrast = table(s, d, "contrast_test_v3").where(f"{seven} AND pair_id IS NOT NULL AND text IS NOT NULL").transform(_first).select(F.concat(F.lit("c-"), "id").alias("id"), F.concat(F.lit("c-"), F.lower(F.trim("pair_id"))).alias("pair_id"), "variant_ab", "label", "text")
    identity = lambda r: r.withColumn("identity", F.sha2(F.array_join(experiment_tokens("text"), " "), 256))
    dev, test, g, c = identity(side(0)), identity(side(1)), identity(grouped), identity(contrast)
    # A text belongs to the first population that has it.
    test = test.join(dev.select("identity").distinct(), "identity", "left_anti")
    g = g.join(dev.select("identity").unionByName(test.select("identity")).distinct(), "identity", "left_anti")
    c = c.join(g.select("identity").unionByName(dev.select("identity")).unionByName(test.select("identity")).distinct(), "identity", "left_anti")
    _, report = experiment.run(*[x.drop("identity") for x in (g, dev, test, c)], SEED)
    rows = [(f"{a}.{b}", float(v)) for a in ("inside", "outside", "quality", "contrast", "naive_bayes") for b, v in report[a].items() if v is not None]
    return s.createDataFrame([*rows, ("temperature", float(report["temperature"]))], "metric string, value double")


def experiment_tokens(text: str):
    from ..functions.text import tokens

    return tokens(text, "v3")


# Audits.
_RUN = "list_reduce(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END, '')"
_FULL = "".join(chr(c + 0xFEE0) for c in [*range(97, 123), *range(65, 91), *range(48, 58)])
_ALPHA, _SWAP = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_VARIANTS = {
    "ascii-letter-case": f"translate(text, '{_ALPHA}', '{_SWAP}')",
    "horizontal-whitespace": "CASE WHEN contains(text, ' ') OR contains(text, chr(9)) THEN translate(text, concat(' ', chr(9)), concat(chr(9), ' ')) WHEN length(text) < 512 THEN concat(' ', text) END",
    "unicode-compatibility-width": f"translate(text, '{_ALPHA}0123456789', '{_FULL}')",
    "terminal-punctuation": "CASE WHEN length(text) < 512 THEN concat(text, '!') WHEN regexp_full_match(right(text, 1), '[[:punct:]]') THEN concat(left(text, length(text) - 1), CASE WHEN right(text, 1) = '!' THEN '.' ELSE '!' END) END",
    "single-character-deletion": "CASE WHEN n >= 5 THEN concat(text[:st - 1 + n // 2], text[st + n // 2 + 1:]) END",
    "adjacent-character-transposition": "CASE WHEN n >= 4 AND i IS NOT NULL THEN concat(text[:st + i - 2], run[i + 1], run[i], text[st + i + 1:]) END",
    "single-character-duplication": "CASE WHEN n >= 3 AND length(text) < 512 THEN concat(text[:(st + n // 2)], text[st + n // 2:]) END",
}
PERTURBED = f"WITH b AS (SELECT row_no, text, {_RUN} AS run FROM ({PROMPTS})), r AS (SELECT *, coalesce(length(run), 0) AS n, strpos(text, run) AS st FROM b), r2 AS (SELECT *, list_reduce(list_filter(range(1, greatest(n, 1)), lambda i: run[i] <> run[i + 1]), lambda a, b: CASE WHEN abs(b - (n // 2 + 1)) < abs(a - (n // 2 + 1)) THEN b ELSE a END) AS i FROM r WHERE len(list_filter(range(1, greatest(n, 1)), lambda i: run[i] <> run[i + 1])) > 0 UNION ALL SELECT *, NULL FROM r WHERE len(list_filter(range(1, greatest(n, 1)), lambda i: run[i] <> run[i + 1])) = 0), u AS (" + " UNION ALL ".join(f"SELECT row_no, text, '{name}' AS perturbation, '{family}' AS family, {_VARIANTS[name]} AS v FROM r2" for name, family, _ in SUITE) + "), va AS (SELECT row_no, text, perturbation, family, CASE WHEN v <> text AND length(v) <= 512 THEN v END AS variant FROM u)"


@query(f"{PERTURBED} SELECT row_no, perturbation, variant FROM va")
def perturb_explode(s, d):
    return robustness.variants(prompts(s, d).select("row_no", "text")).select("row_no", "perturbation", "variant")


def _raw(s: SparkSession, d: str) -> DataFrame:
    return robustness.audit(prompts(s, d), literal_model("v3", T_V3))


_AUDITED = f"SELECT rid, text FROM ({PERTURBED} SELECT concat(row_no, '|', perturbation) AS rid, variant AS text FROM va WHERE variant IS NOT NULL UNION ALL SELECT concat(row_no, '|base'), text FROM ({PROMPTS}))"
_AUDIT = (
    scored_sql(_AUDITED, "rid", T_V3, True)
    + f", ov AS (SELECT concat(row_no, '|base') AS b, concat(row_no, '|', perturbation) AS v, perturbation, family FROM ({PERTURBED} SELECT * FROM va)), "
    + "js AS (SELECT x.rid AS v, greatest(0, least(1, sum((CASE WHEN x.p > 0 THEN x.p * ln(2 * x.p / (x.p + y.p)) ELSE 0 END + CASE WHEN y.p > 0 THEN y.p * ln(2 * y.p / (x.p + y.p)) ELSE 0 END) / 2) / ln(2))) AS js FROM p x JOIN p y ON y.k = x.k AND y.rid = concat(split_part(x.rid, '|', 1), '|base') GROUP BY x.rid), "
    + "ob AS (SELECT perturbation, family, w.rid IS NOT NULL AS e, w.label = a.label AS la, w.accepted = a.accepted AS ac, a.accepted AS was, js, abs(a.confidence - w.confidence) AS dc FROM ov JOIN t a ON a.rid = ov.b LEFT JOIN t w ON w.rid = ov.v LEFT JOIN js ON js.v = ov.v) "
)
_RATES = ["label_agreement", "acceptance_agreement", "decision_agreement", "mean_normalized_js_divergence", "maximum_normalized_js_divergence", "mean_absolute_confidence_delta", "maximum_absolute_confidence_delta"]


def _audit_sql(by: str) -> str:
    n = "greatest(count(*) FILTER (e), 1)"
    return (
        f"{_AUDIT}SELECT {by}, count(*) FILTER (e)::BIGINT AS evaluated_variants, count(*) FILTER (NOT e)::BIGINT AS skipped_applications, round(count(*) FILTER (la) / {n}, 6) AS label_agreement, round(count(*) FILTER (ac) / {n}, 6) AS acceptance_agreement, "
        f"round(count(*) FILTER (ac AND (la OR NOT was)) / {n}, 6) AS decision_agreement, count(*) FILTER (NOT la)::BIGINT AS label_flips, count(*) FILTER (NOT ac)::BIGINT AS acceptance_flips, count(*) FILTER (NOT ac AND was)::BIGINT AS accepted_to_abstained, count(*) FILTER (NOT ac AND NOT was)::BIGINT AS abstained_to_accepted, "
        f"round(coalesce(sum(js) FILTER (e), 0) / {n}, 6) AS mean_normalized_js_divergence, round(coalesce(max(js) FILTER (e), 0), 6) AS maximum_normalized_js_divergence, round(coalesce(sum(dc), 0) / {n}, 6) AS mean_absolute_confidence_delta, round(coalesce(max(dc), 0), 6) AS maximum_absolute_confidence_delta FROM ob GROUP BY {by}"
    )


@query(_audit_sql("perturbation, family"))
def robustness_by_perturbation(s, d):
    return rounded(robustness.report(_raw(s, d), ["perturbation", "family"]), *_RATES)


@query(_audit_sql("family"))
def robustness_by_family(s, d):
    return rounded(robustness.report(robustness.merged(_raw(s, d), ["family"]), ["family"]), *_RATES)


@query("SELECT * FROM (VALUES ('formatting', 'evaluated_variants'), ('formatting', 'label_flips'), ('typographic', 'maximum_normalized_js_divergence')) v(family, measure)")
def robustness_report_reconstruct(s, d):
    """Measures of a damaged family report that the perturbations' reports contradict; a sound one is contradicted nowhere."""
    raw = _raw(s, d)
    slices, families = robustness.report(raw, ["perturbation", "family"]), robustness.report(robustness.merged(raw, ["family"]), ["family"])
    formatting = F.col("family") == "formatting"
    damaged = families.withColumns({
        "evaluated_variants": F.col("evaluated_variants") + formatting.cast("int"), "label_flips": F.col("label_flips") - formatting.cast("int"),
        "maximum_normalized_js_divergence": F.when(formatting, F.col("maximum_normalized_js_divergence")).otherwise(F.col("maximum_normalized_js_divergence") / 2 + 0.6),
    })
    return robustness.inconsistencies(slices, families).unionByName(robustness.inconsistencies(slices, damaged))


# Strict readers over lines built from tables. Nulls drop a field, so such lines have too few.
def _lines(s: SparkSession, d: str, name: str, columns: list[str], header: str) -> DataFrame:
    body = table(s, d, name).select((F.col("row_no") + 1).alias("line_no"), F.concat_ws("\t", *columns).alias("line"))
    return body.unionByName(s.createDataFrame([(1, header)], "line_no bigint, line string"))


def scan_sql(name: str, columns: list[str], v3: bool, ids: list[str], closed: dict[str, str], label: bool) -> str:
    idp, lp = ("[A-Za-z0-9_-]{1,128}", "[a-z-]{1,64}") if v3 else ("[A-Za-z0-9_-]+", "[a-z0-9-]+")
    tr = lambda c: f"regexp_replace(regexp_replace({c}, '^{_ws()}', ''), '{_ws()}$', '')"
    checks = "".join(f" WHEN NOT regexp_full_match({c}, '{idp}') THEN '{c}'" for c in ids) + "".join(f" WHEN {c} NOT IN ({v}) THEN '{c}'" for c, v in closed.items()) + (f" WHEN NOT regexp_full_match(label, '{lp}') THEN 'label'" if label else "") + " WHEN text = '' OR length(text) > 512 THEN 'text'"
    identity = f"array_to_string({tokens_sql(nfkc_sql('text'))}, ' ')" if v3 else norm_sql("text")
    typed = ", ".join(f"{tr(f's[{i + 1}]')} AS {c}" for i, c in enumerate(columns))
    source = {"variant": "variant_ab"}
    return f"WITH l AS (SELECT row_no + 1 AS line_no, concat_ws(chr(9), {', '.join(source.get(c, c) for c in columns)}) AS line FROM {name}), s AS (SELECT line_no, string_split(line, chr(9)) AS s FROM l WHERE NOT regexp_full_match(line, '({_ws()})?') AND NOT regexp_matches(line, '^({_ws()})?#')), t AS (SELECT line_no, {typed}, NULL AS w FROM s WHERE len(s) = {len(columns)}), j AS (SELECT *, CASE WHEN false THEN '' {checks} END AS reason, {identity} AS identity FROM t), k AS (SELECT *, min(line_no) FILTER (reason IS NULL) OVER (PARTITION BY id) AS fi, min(line_no) FILTER (reason IS NULL) OVER (PARTITION BY CASE WHEN reason IS NULL THEN identity ELSE concat(chr(1), line_no) END) AS ft FROM j) SELECT line_no, coalesce(reason, CASE WHEN line_no > fi THEN 'duplicate-id' WHEN line_no > ft THEN 'duplicate-text' END) AS reason FROM k UNION ALL SELECT line_no, 'columns' FROM s WHERE len(s) <> {len(columns)}"


def _ws() -> str:
    from .inputs import WS

    return WS


def _scan(name: str, tbl: str, corpus: tsv.Corpus, rename: dict[str, str] | None = None) -> None:
    columns = [(rename or {}).get(c, c) for c in corpus.columns]
    QUERIES[name] = lambda s, d: tsv.parse(_lines(s, d, tbl, columns, "\t".join(corpus.columns)), corpus).select("line_no", "reason")
    closed = {c: ", ".join(f"'{v}'" for v in values) for c, values in corpus.closed}
    ORACLE[name] = scan_sql(tbl, list(corpus.columns), corpus.profile == "v3", list(corpus.ids), closed, "label" in corpus.columns)


_scan("scan_labeled_tsv", "intents_v1", tsv.LABELED)
_scan("scan_ood_tsv", "ood_test_v3", tsv.OOD)
_scan("scan_grouped_tsv", "grouped_examples", tsv.GROUPED)
_scan("scan_openset_ood", "ood_test_v3", tsv.OPENSET_OOD)
_scan("scan_contrast", "contrast_test_v3", tsv.CONTRAST, {"variant": "variant_ab"})

# JSON lines from prompts, some of them damaged by number.
_JSON = """CASE row_no % 9 WHEN 0 THEN concat('{"id":"', id, '"}') WHEN 1 THEN concat('{"id":"', id, '","text":"a b","more":1}') WHEN 2 THEN concat('{"id":5,"text":"a b"}') WHEN 3 THEN '  ' WHEN 4 THEN concat('{"id":"', id, '","text":') WHEN 5 THEN concat('{"text":"t ', row_no, '","id":"', id, '"}') WHEN 6 THEN concat('{"id":"no good","text":"x"}') WHEN 7 THEN concat('{"id":"', id, '","text":"  "}') ELSE concat('{"id":"', id, '","text":"u ', row_no, '"}') END"""
_JSON_REASON = "CASE row_no % 9 WHEN 0 THEN 'shape' WHEN 1 THEN 'shape' WHEN 2 THEN 'shape' WHEN 4 THEN 'shape' WHEN 6 THEN 'id' WHEN 7 THEN 'text' END"


def _json_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "intents_v1").where("id IS NOT NULL").selectExpr("row_no AS line_no", f"{_JSON} AS line")


_J = f"WITH j AS (SELECT row_no AS line_no, id, CASE row_no % 9 WHEN 5 THEN concat('t ', row_no) WHEN 8 THEN concat('u ', row_no) END AS text, {_JSON_REASON} AS reason FROM intents_v1 WHERE id IS NOT NULL AND row_no % 9 <> 3)"


@query(f"{_J} SELECT line_no, CASE WHEN reason IS NULL THEN id END AS id, text, reason FROM j")
def scan_jsonl(s, d):
    ok = F.col("reason").isNull()
    return jsonl.parse(_json_lines(s, d)).select("line_no", F.when(ok, F.col("id")).alias("id"), F.when(ok, F.col("text")).alias("text"), "reason")


@query(f"{_J}, f AS (SELECT id, min(line_no) AS f FROM j WHERE reason IS NULL GROUP BY id) SELECT line_no, coalesce(reason, CASE WHEN line_no > f THEN 'duplicate-id' END) AS reason FROM j LEFT JOIN f USING (id)")
def scan_audit_jsonl(s, d):
    return jsonl.parse_audit(_json_lines(s, d)).select("line_no", "reason")


@query()
def bundle_digest_check(s, d):
    """Files of a bundle written from the literal model, with the digests that its manifest must state."""
    folder = os.path.join(tempfile.mkdtemp(prefix="corpusloom-bundle-"), "bundle")
    bundle.write(folder, literal_model(), {"accuracy": 0.5}, {"seed": SEED})
    bundle.verify(folder)
    names = sorted(os.listdir(folder))
    rows = []
    for n in names:
        with open(os.path.join(folder, n), "rb") as f:
            data = f.read()
        rows.append((n, bundle.digest(data), len(data)))
    return s.createDataFrame(rows, "name string, digest string, bytes bigint")
