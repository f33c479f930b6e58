"""Queries over predictions: evaluation, curves, thresholds, baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baselines as B
from ..operators import contracts as C
from ..operators import metrics as M
from ..operators import thresholds as T
from .inputs import LABELLED, LEDGER, OOD_SCORES, labelled, ledger, ood_scores, table, tokens_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


L = f"WITH l AS ({LEDGER}), c AS (SELECT actual, predicted, count(*)::BIGINT AS n FROM l GROUP BY ALL), lab AS (SELECT DISTINCT unnest([actual, predicted]) AS label FROM l)"
PC = L + ", s AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM c WHERE actual = label AND predicted = label)::BIGINT AS hit, (SELECT coalesce(sum(n), 0) FROM c WHERE actual = label)::BIGINT AS support, (SELECT coalesce(sum(n), 0) FROM c WHERE predicted = label)::BIGINT AS said FROM lab), pr AS (SELECT label, support, CASE WHEN said = 0 THEN 0::DOUBLE ELSE hit / said END AS p, CASE WHEN support = 0 THEN 0::DOUBLE ELSE hit / support END AS r FROM s), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0::DOUBLE ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"


@query(f"{L} SELECT a.label AS actual, b.label AS predicted, coalesce(n, 0)::BIGINT AS n FROM lab a, lab b LEFT JOIN c ON actual = a.label AND predicted = b.label")
def confusion_matrix(s, d):
    return M.confusion(ledger(s, d))


@query(f"{PC} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def per_class_metrics(s, d):
    return rounded(M.per_class(ledger(s, d)), "precision", "recall", "f1")


@query(f"{PC} SELECT (SELECT count(*) FROM l)::BIGINT AS n, round((SELECT count(*) FROM l WHERE actual = predicted) / (SELECT count(*) FROM l), 6) AS accuracy, round((SELECT avg(f1) FROM f), 6) AS macro_f1")
def accuracy_macro_f1(s, d):
    return rounded(M.accuracy_macro_f1(ledger(s, d)), "accuracy", "macro_f1")


@query(f"{L}, a AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (accepted)::BIGINT AS acc, count(*) FILTER (accepted AND actual = predicted) AS hit FROM l) SELECT n, acc AS accepted, n - acc AS rejected, round(acc / n, 6) AS coverage, round(hit / acc, 6) AS selective_accuracy FROM a")
def selective_metrics(s, d):
    return rounded(M.selective(ledger(s, d)), "coverage", "selective_accuracy")


_PROB = "CASE WHEN predicted = actual THEN confidence ELSE (1 - confidence) / 2 END"


@query(f"{L} SELECT round(avg(-ln(greatest({_PROB}, 1e-15))), 6) AS nll FROM l")
def nll(s, d):
    return rounded(M.log_loss(ledger(s, d), F.expr(_PROB)), "nll")


@query(f"{L} SELECT round(avg(CASE WHEN predicted = actual THEN power(confidence - 1, 2) + 2 * power((1 - confidence) / 2, 2) ELSE power(confidence, 2) + power((1 - confidence) / 2 - 1, 2) + power((1 - confidence) / 2, 2) END), 6) AS brier FROM l")
def brier(s, d):
    rest = (F.lit(1.0) - F.col("confidence")) / 2
    p = ledger(s, d).withColumn("probabilities", F.map_from_arrays(F.array(*map(F.lit, "ANR")), F.array(*[F.when(F.col("predicted") == x, F.col("confidence")).otherwise(rest) for x in "ANR"])))
    return rounded(M.brier(p, "probabilities"), "brier")


BINS = f"{L}, e AS (SELECT i::INTEGER AS bin, i / 10 AS lo, (i + 1) / 10 AS hi FROM range(10) t(i)), b AS (SELECT bin, count(*)::BIGINT AS n, avg(confidence) AS mc, avg((actual = predicted)::INTEGER) AS acc FROM l JOIN e ON confidence >= lo AND (confidence < hi OR bin = 9) GROUP BY bin)"


@query(f"{BINS} SELECT bin, n, round(mc, 6) AS mean_confidence, round(acc, 6) AS accuracy FROM b")
def calibration_bins(s, d):
    return rounded(M.calibration_bins(ledger(s, d)), "mean_confidence", "accuracy")


@query(f"{BINS} SELECT round(sum(n * abs(acc - mc)) / sum(n), 6) AS ece FROM b")
def ece(s, d):
    return rounded(M.expected_calibration_error(ledger(s, d)), "ece")


RISK = f"{L}, g AS (SELECT confidence, count(*) AS n, count(*) FILTER (actual = predicted) AS h FROM l GROUP BY confidence), u AS (SELECT confidence, n::BIGINT AS n, (sum(n) OVER w)::BIGINT AS covered, 1 - sum(h) OVER w / sum(n) OVER w AS risk FROM g WINDOW w AS (ORDER BY confidence DESC))"


@query(f"{RISK} SELECT round(confidence, 6) AS confidence, n, covered, round(risk, 6) AS risk FROM u")
def risk_coverage(s, d):
    return rounded(M.risk_coverage(ledger(s, d)), "confidence", "risk")


@query(f"{RISK} SELECT round(sum(risk * n) / sum(n), 6) AS aurc FROM u")
def aurc(s, d):
    return rounded(M.area_under_risk(ledger(s, d)), "aurc")


def _scores(s: SparkSession, d: str) -> DataFrame:
    inside = ledger(s, d).select(F.col("confidence").alias("score"), F.lit(True).alias("positive"))
    return inside.unionByName(ood_scores(s, d).select(F.col("confidence").alias("score"), F.lit(False).alias("positive")))


def quality_sql(by: str, groups: str) -> str:
    b, on = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"{groups}, u AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER ({on}) AS pp, sum(q) OVER ({on}) AS qq FROM g WINDOW w AS ({on}ORDER BY score DESC)) SELECT {b}round(sum(p * (qq - fp) + p * q / 2) / max(pp * qq), 6) AS auroc, round(sum(p / pp * tp / (tp + fp)), 6) AS aupr, round(min(fp) FILTER (tp >= ceil(0.95::DOUBLE * pp) AND p > 0) / max(qq), 6) AS fpr95 FROM u" + (f" GROUP BY {by}" if by else "")


SCORES = f"WITH x AS (SELECT confidence AS score, 1 AS p, 0 AS q FROM ({LEDGER}) UNION ALL SELECT confidence, 0, 1 FROM ({OOD_SCORES})), g AS (SELECT score, sum(p)::DOUBLE AS p, sum(q)::DOUBLE AS q FROM x GROUP BY score)"
for _name in ("auroc", "aupr", "fpr95"):
    QUERIES[_name] = lambda s, d, _n=_name: rounded(M.ranking_quality(_scores(s, d)), _n).select(_n)
    ORACLE[_name] = f"SELECT {_name} FROM ({quality_sql('', SCORES)})"


@query(quality_sql("stratum", f"WITH st AS (SELECT DISTINCT event_type AS stratum FROM events), x AS (SELECT stratum, confidence AS score, 1 AS p, 0 AS q FROM ({LEDGER}), st UNION ALL SELECT stratum, confidence, 0, 1 FROM ({OOD_SCORES})), g AS (SELECT stratum, score, sum(p)::DOUBLE AS p, sum(q)::DOUBLE AS q FROM x GROUP BY ALL)"))
def ood_by_stratum(s, d):
    inside, outside = ledger(s, d).select(F.col("confidence").alias("score")), ood_scores(s, d).select("stratum", F.col("confidence").alias("score"))
    return rounded(M.by_stratum(inside, outside), "auroc", "aupr", "fpr95")


_ACC = "confidence >= 0.65::DOUBLE AND margin >= 0.1::DOUBLE"


@query(f"WITH o AS (SELECT *, {_ACC} AS accepted FROM ({OOD_SCORES})) SELECT count(*)::BIGINT AS n, count(*) FILTER (accepted)::BIGINT AS accepted, count(*) FILTER (NOT accepted)::BIGINT AS rejected, round(count(*) FILTER (accepted) / count(*), 6) AS coverage, round(count(*) FILTER (NOT accepted) / count(*), 6) AS abstention, round(avg(confidence), 6) AS mean_confidence, round(avg(margin), 6) AS mean_margin FROM o")
def ood_summary_v1(s, d):
    return rounded(M.ood_summary(ood_scores(s, d).withColumn("accepted", F.expr("confidence >= 0.65D AND margin >= 0.1D"))), "coverage", "abstention", "mean_confidence", "mean_margin")


# Contrast pairs: predictions by a rule over the stored label.
_PAIR_PREDICTED = "CASE WHEN row_no % 4 = 0 THEN 'reason' ELSE label END"
PAIRS = f"WITH p AS (SELECT pair_id, variant_ab, label AS actual, {_PAIR_PREDICTED} AS predicted FROM contrast_test_v3 WHERE label IS NOT NULL AND pair_id IS NOT NULL), w AS (SELECT pair_id, bool_and(actual = predicted) AS both_right, min(predicted) <> max(predicted) AS flipped FROM p GROUP BY pair_id HAVING count(*) = 2 AND count(*) FILTER (variant_ab = 'a') = 1 AND count(*) FILTER (variant_ab = 'b') = 1)"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return M.contrast_pairs(table(s, d, "contrast_test_v3").selectExpr("pair_id", "variant_ab", "label AS actual", f"{_PAIR_PREDICTED} AS predicted"))


@query(f"{PAIRS} SELECT * FROM w")
def contrast_pairs(s, d):
    return _pairs(s, d)


@query(f"{PAIRS} SELECT count(*)::BIGINT AS pairs, round(count(*) FILTER (both_right) / count(*), 6) AS pair_accuracy, round(count(*) FILTER (flipped) / count(*), 6) AS flip_rate FROM w")
def contrast_metrics(s, d):
    return rounded(M.contrast_metrics(_pairs(s, d)), "pair_accuracy", "flip_rate")


@query("WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, max(o_totalprice) FILTER (k = floor((n - 1) * 0.025::DOUBLE)) AS low, max(o_totalprice) FILTER (k = ceil((n - 1) * 0.975::DOUBLE)) AS high FROM r GROUP BY o_orderpriority")
def percentile_ci(s, d):
    return M.percentile_interval(table(s, d, "orders"), "o_totalprice", ["o_orderpriority"])


# Thresholds.
def _grid_sql(grid: str, inside: str, order: str, selective: float, ood: float) -> str:
    return f"""WITH i AS (SELECT confidence, margin, count(*) AS n, count(*) FILTER (actual = predicted) AS h FROM ({LEDGER}) GROUP BY ALL), o AS (SELECT confidence, margin, count(*) AS n FROM ({OOD_SCORES}) GROUP BY ALL), p AS ({grid}),
 a AS (SELECT c, m, sum(n) AS acc, sum(h) AS hit FROM p JOIN i ON confidence >= c AND margin >= m GROUP BY c, m), b AS (SELECT c, m, sum(n) AS oacc FROM p JOIN o ON confidence >= c AND margin >= m GROUP BY c, m),
 r AS (SELECT c, m, acc, hit / acc AS sel, acc / (SELECT sum(n) FROM i) AS cov, coalesce(oacc, 0) / (SELECT sum(n) FROM o) AS ood FROM a LEFT JOIN b USING (c, m)), f AS (SELECT * FROM r WHERE sel >= {selective}::DOUBLE AND ood <= {ood}::DOUBLE)
 SELECT c AS confidence, m AS margin, round(cov, 6) AS coverage, round(sel, 6) AS selective_accuracy, round(ood, 6) AS ood_coverage{inside} FROM f ORDER BY {order} LIMIT 1"""


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return ledger(s, d).withColumn("hit", F.col("actual") == F.col("predicted")), ood_scores(s, d).withColumn("hit", F.lit(False))


SELECTIVE, OOD = 0.25, 0.3  # reachable by these made-up predictions


@query(_grid_sql("SELECT i / 100 AS c, j / 100 AS m FROM range(15, 81) x(i), range(0, 81) y(j)", "", "cov DESC, ood, m DESC, c DESC", SELECTIVE, OOD))
def threshold_grid_v1(s, d):
    return rounded(T.select_v1(*_sides(s, d), SELECTIVE, OOD).select("confidence", "margin", "coverage", "selective_accuracy", "ood_coverage"), "coverage", "selective_accuracy", "ood_coverage")


@query(_grid_sql(f"SELECT c, m FROM (SELECT unnest({[float(x) for x in T.V3_CONFIDENCE]}::DOUBLE[]) AS c), (SELECT unnest({[float(x) for x in T.V3_MARGIN]}::DOUBLE[]) AS m)", ", (SELECT count(*) FROM f)::BIGINT AS feasible", "cov DESC, sel DESC, ood, m DESC, c DESC", SELECTIVE, OOD))
def threshold_grid_v3(s, d):
    return rounded(T.select_v3(*_sides(s, d), selective=SELECTIVE, ood=OOD).select("confidence", "margin", "coverage", "selective_accuracy", "ood_coverage", "feasible"), "coverage", "selective_accuracy", "ood_coverage")


@query(f"WITH a AS ({LEDGER}), k AS (SELECT order_no * 8 + line_no AS k, min(predicted) AS predicted, min(actual) AS actual FROM a GROUP BY 1), x AS (SELECT * FROM k WHERE k % 11 <> 0), y AS (SELECT k, CASE WHEN k % 13 = 0 THEN 'Z' ELSE predicted END AS predicted, actual FROM k WHERE k % 17 <> 0) SELECT coalesce(x.k, y.k) AS k, CASE WHEN x.k IS NULL THEN 'missing-left' WHEN y.k IS NULL THEN 'missing-right' ELSE 'differs' END AS problem FROM x FULL JOIN y ON x.k = y.k WHERE x.k IS NULL OR y.k IS NULL OR x.predicted IS DISTINCT FROM y.predicted OR x.actual IS DISTINCT FROM y.actual")
def ledger_reconcile(s, d):
    """A ledger against an edited copy: entries dropped on either side and changed ones."""
    k = ledger(s, d).groupBy((F.col("order_no") * 8 + F.col("line_no")).alias("k")).agg(F.min("predicted").alias("predicted"), F.min("actual").alias("actual"))
    left = k.where("k % 11 <> 0")
    right = k.where("k % 17 <> 0").withColumn("predicted", F.expr("CASE WHEN k % 13 = 0 THEN 'Z' ELSE predicted END"))
    return C.reconcile(left, right, "k", ["predicted", "actual"])


# Baselines: trained on all labelled prompts and applied to all.
@query(f"SELECT label, count(*)::BIGINT AS n FROM ({LABELLED}) GROUP BY label ORDER BY n DESC, label LIMIT 1")
def majority_baseline(s, d):
    return B.majority(labelled(s, d))


@query(
    f"WITH tr AS (SELECT row_no, label, {tokens_sql('text')} AS t FROM ({LABELLED})), te AS (SELECT row_no, {tokens_sql('text')} AS t FROM ({LABELLED})), w AS (SELECT label, unnest(t) AS w FROM tr), c AS (SELECT w, label, count(*) AS c FROM w GROUP BY ALL), "
    "l AS (SELECT label AS l, ln((count(*) + 1) / ((SELECT count(*) FROM tr) + (SELECT count(DISTINCT label) FROM tr))) AS prior, ln((SELECT count(*) FROM w WHERE w.label = tr.label) + (SELECT count(DISTINCT w) FROM w)) AS base FROM tr GROUP BY label), "
    "m AS (SELECT row_no, w, count(*) AS m FROM (SELECT row_no, unnest(t) AS w FROM te) GROUP BY ALL), j AS (SELECT row_no, l, sum(m * (ln(coalesce(c, 0) + 1) - base)) AS s FROM m JOIN (SELECT DISTINCT w FROM c) v USING (w), l LEFT JOIN c ON c.w = m.w AND c.label = l.l GROUP BY ALL), "
    "z AS (SELECT te.row_no, l.l, round(prior + coalesce(s, 0), 9) AS score FROM te, l LEFT JOIN j ON j.row_no = te.row_no AND j.l = l.l), b AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, l) AS k FROM z) SELECT row_no, l AS predicted, round(score, 6) AS score FROM b WHERE k = 1"
)
def naive_bayes(s, d):
    rows = labelled(s, d)
    return rounded(B.naive_bayes(rows, rows), "score")
