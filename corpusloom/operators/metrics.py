"""Evaluation of predictions as aggregates.

Predictions carry ``actual``, ``predicted``, ``confidence`` and ``accepted``; probabilities are a map by
label. Curves first gather rows by score, then run sums over the distinct scores, so ties are one point and
the order of rows plays no part. Ratios with an empty denominator are 0, except the selective accuracy of
nothing accepted, which is null. Rows without actual label, or without a score where one is needed, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_ratio
from .ranking import ranked, running_sums

FLOOR = 1e-15
BINS = 10


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


def known(p: DataFrame) -> DataFrame:
    return p.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())


def label_set(p: DataFrame) -> DataFrame:
    """All labels, actual or predicted: ``label``."""
    return known(p).select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()


def confusion(p: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``actual``, ``predicted``, ``n`` for every pair of labels (256 at most, so the pairs are few)."""
    labels = label_set(p) if labels is None else labels
    cells = known(p).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    grid = labels.select(F.col("label").alias("actual")).join(F.broadcast(labels.select(F.col("label").alias("predicted"))), how="cross")
    return grid.join(cells, ["actual", "predicted"], "left").na.fill(0, ["n"])


def per_class(p: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``label``, ``precision``, ``recall``, ``f1``, ``support``."""
    c = confusion(p, labels)
    both = c.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(True).alias("own")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("own")))).alias("e"), "n", (F.col("actual") == F.col("predicted")).alias("hit")).select("e.*", "n", "hit")
    own = F.col("own")
    sums = both.groupBy("label").agg(F.sum(F.when(own & F.col("hit"), F.col("n")).otherwise(0)).alias("hit"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~own, F.col("n")).otherwise(0)).alias("said"))
    pr = sums.withColumns({"precision": safe_ratio(F.col("hit"), F.col("said")), "recall": safe_ratio(F.col("hit"), F.col("support"))})
    return pr.select("label", "precision", "recall", safe_ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def accuracy_macro_f1(p: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: ``n``, ``accuracy``, ``macro_f1`` over all labels, those without support too."""
    hits = known(p).agg(F.count(F.lit(1)).alias("n"), _n(F.col("actual") == F.col("predicted")).alias("hits"))
    f1 = per_class(p, labels).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    return hits.join(f1, how="cross").select("n", safe_ratio(F.col("hits"), F.col("n")).alias("accuracy"), "macro_f1")


def selective(p: DataFrame) -> DataFrame:
    """One row: ``n``, ``accepted``, ``rejected``, ``coverage``, ``selective_accuracy``."""
    a = known(p).agg(F.count(F.lit(1)).alias("n"), _n(F.col("accepted")).alias("accepted"), _n(F.col("accepted") & (F.col("actual") == F.col("predicted"))).alias("hits"))
    return a.select("n", "accepted", (F.col("n") - F.col("accepted")).alias("rejected"), safe_ratio(F.col("accepted"), F.col("n")).alias("coverage"), F.try_divide(F.col("hits").cast("double"), F.col("accepted").cast("double")).alias("selective_accuracy"))


def log_loss(p: DataFrame, probability: Column) -> DataFrame:
    """One row: ``nll``, the mean of -ln of the actual label's probability."""
    return p.select(F.greatest(F.coalesce(probability, F.lit(0.0)), F.lit(FLOOR)).alias("q")).agg(F.avg(-F.log("q")).alias("nll"))


def brier(p: DataFrame, probabilities: str, actual: str = "actual") -> DataFrame:
    """One row: ``brier``, the mean over rows of the summed squared differences over labels."""
    entries = F.map_entries(probabilities)
    miss = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + F.pow(e["value"] - F.when(e["key"] == F.col(actual), 1.0).otherwise(0.0), F.lit(2.0)))
    return p.select(miss.alias("b")).agg(F.avg("b").alias("brier"))


def calibration_bins(p: DataFrame, bins: int = BINS) -> DataFrame:
    """``bin``, ``n``, ``mean_confidence``, ``accuracy`` of the bins that hold rows; [i/10, (i+1)/10), the last one closed.

    Borders are compared as they are, not by rounding a product.
    """
    c = F.col("confidence")
    place = F.lit(bins - 1)
    for i in reversed(range(bins - 1)):
        place = F.when(c < F.lit((i + 1) / bins), F.lit(i)).otherwise(place)
    return known(p).where(c.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))


def expected_calibration_error(p: DataFrame, bins: int = BINS) -> DataFrame:
    b = calibration_bins(p, bins)
    return b.agg(safe_ratio(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))), F.sum("n")).alias("ece"))


def risk_coverage(p: DataFrame) -> DataFrame:
    """``confidence``, ``n`` (rows of this confidence), ``covered`` (rows at least this sure), ``risk`` among them."""
    groups = known(p).where("confidence IS NOT NULL").groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), _n(F.col("actual") == F.col("predicted")).alias("hits"))
    up = running_sums(groups, [], [F.desc("confidence")], {"covered": F.col("n"), "right": F.col("hits")})
    return up.select("confidence", "n", "covered", (F.lit(1.0) - F.col("right") / F.col("covered")).alias("risk"))


def area_under_risk(p: DataFrame) -> DataFrame:
    return risk_coverage(p).agg(safe_ratio(F.sum(F.col("risk") * F.col("n")), F.sum("n")).alias("aurc"))


def _score_groups(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, ``score``, ``p``, ``q`` (positives and negatives of the score), ``tp``, ``fp`` (with this score or higher), ``P``, ``N``."""
    groups = scores.where("score IS NOT NULL").groupBy(*by, "score").agg(_n(F.col("positive")).alias("p"), _n(~F.col("positive")).alias("q"))
    up = running_sums(groups, by, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("q")})
    totals = groups.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    return up.join(F.broadcast(totals), by) if by else up.join(F.broadcast(totals), how="cross")


def ranking_quality(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``auroc``, ``aupr``, ``fpr95`` of ``score`` telling ``positive`` rows from others, per ``by``.

    fpr95: share of negatives at or above the ceil(0.95 n)-th highest positive score.
    """
    by = by or []
    return _quality(_score_groups(scores, by), by)


def by_stratum(inside: DataFrame, outside: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Ranking quality per stratum of the outside scores, each against all inside scores.

    The inside scores are gathered by score before they are repeated per stratum.
    """
    strata = outside.where(F.col(stratum).isNotNull()).select(stratum).distinct()
    ins = inside.where("score IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(strata), how="cross").select(stratum, "score", F.col("c").alias("p"), F.lit(0).cast("bigint").alias("q"))
    outs = outside.where(F.col(stratum).isNotNull() & F.col("score").isNotNull()).groupBy(stratum, "score").agg(F.count(F.lit(1)).alias("q")).select(stratum, "score", F.lit(0).cast("bigint").alias("p"), "q")
    groups = ins.unionByName(outs).groupBy(stratum, "score").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    up = running_sums(groups, [stratum], [F.desc("score")], {"tp": F.col("p"), "fp": F.col("q")})
    totals = groups.groupBy(stratum).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    return _quality(up.join(F.broadcast(totals), stratum), [stratum])


def _quality(g: DataFrame, by: list[str]) -> DataFrame:
    need = F.ceil(F.lit(0.95) * F.col("all_p"))
    p, q, tp, fp, P, Q = (F.col(c).cast("double") for c in ("p", "q", "tp", "fp", "all_p", "all_q"))
    at = F.min(F.when((F.col("tp") >= need) & (F.col("p") > 0), F.col("fp")))
    agg = g.groupBy(*by).agg(F.sum(p * (Q - fp) + p * q / 2).alias("a"), F.sum(p / P * tp / (tp + fp)).alias("aupr"), at.alias("at"), F.max(P).alias("all_pos"), F.max(Q).alias("all_neg"))
    return agg.select(*by, safe_ratio(F.col("a"), F.col("all_pos") * F.col("all_neg")).alias("auroc"), F.coalesce("aupr", F.lit(0.0)).alias("aupr"), safe_ratio(F.col("at"), F.col("all_neg")).alias("fpr95"))


def ood_summary(p: DataFrame) -> DataFrame:
    """One row over predictions of rows outside the domain: counts, coverage, abstention, mean confidence and margin."""
    a = p.agg(F.count(F.lit(1)).alias("n"), _n(F.col("accepted")).alias("accepted"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.avg("margin"), F.lit(0.0)).alias("mean_margin"))
    return a.select("n", "accepted", (F.col("n") - F.col("accepted")).alias("rejected"), safe_ratio(F.col("accepted"), F.col("n")).alias("coverage"), safe_ratio(F.col("n") - F.col("accepted"), F.col("n")).alias("abstention"), "mean_confidence", "mean_margin")


def contrast_pairs(p: DataFrame, pair: str = "pair_id", variant: str = "variant_ab") -> DataFrame:
    """pair, ``both_right``, ``flipped`` of the pairs that have exactly one a and one b."""
    whole = known(p).where(F.col(pair).isNotNull()).groupBy(pair).agg(
        _n(F.col(variant) == "a").alias("a"), _n(F.col(variant) == "b").alias("b"), F.count(F.lit(1)).alias("n"),
        F.min(F.col("actual") == F.col("predicted")).alias("both_right"), (F.min("predicted") != F.max("predicted")).alias("flipped"),
    )
    return whole.where("a = 1 AND b = 1 AND n = 2").select(pair, "both_right", "flipped")


def contrast_metrics(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), _n(F.col("both_right")).alias("r"), _n(F.col("flipped")).alias("f")).select("pairs", safe_ratio(F.col("r"), F.col("pairs")).alias("pair_accuracy"), safe_ratio(F.col("f"), F.col("pairs")).alias("flip_rate"))


def percentile_interval(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``low``, ``high``: the values at places floor(0.025 (n-1)) and ceil(0.975 (n-1)), without interpolation."""
    by = by or []
    n = samples.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(samples.where(F.col(value).isNotNull()).select(*by, value), by, [F.col(value)])
    joined = placed.join(F.broadcast(n), by) if by else placed.join(F.broadcast(n), how="cross")
    low, high = F.floor((F.col("n") - 1) * F.lit(0.025)) + 1, F.ceil((F.col("n") - 1) * F.lit(0.975)) + 1
    return joined.groupBy(*by).agg(F.max(F.when(F.col("rank") == low, F.col(value))).alias("low"), F.max(F.when(F.col("rank") == high, F.col(value))).alias("high"))
