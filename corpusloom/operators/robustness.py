"""Metamorphic audit: how predictions change under perturbations of the text.

A case is scored once, its variants are made in the same row and scored after exploding them, so the audit
is map-only up to one partial aggregation per perturbation. Cases need unique ids and 1 to 512
characters; :func:`audit` raises otherwise. Reports are rounded to 1e-9, gates look at unrounded values.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.perturb import suite
from ..functions.text import MAX_CHARS, safe_ratio
from . import bundle, contracts
from .checkpoints import cut
from .model import Model, score

SCALE = 1e9


class GateError(ValueError):
    """The audit's evidence misses the limits of a gate."""


def variants(cases: DataFrame, text: str = "text") -> DataFrame:
    """``cases`` times the suite: ``perturbation``, ``family``, ``variant`` (null where skipped)."""
    x = F.col(text)
    made = [F.struct(F.lit(name).alias("perturbation"), F.lit(family).alias("family"), f(x).alias("v")) for name, family, f in suite()]
    each = cases.select("*", F.explode(F.array(*made)).alias("e"))
    ok = F.col("e.v").isNotNull() & (F.col("e.v") != x) & (F.length("e.v") <= MAX_CHARS)
    return each.select(*cases.columns, "e.perturbation", "e.family", F.when(ok, F.col("e.v")).alias("variant"))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two arrays of probabilities in the same order, over ln 2, within [0, 1]."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / F.log(F.lit(2.0))))


def observations(variant_rows: DataFrame) -> DataFrame:
    """One row per variant with what changed. Expects base_/var_ columns label, accepted, confidence, probabilities."""
    c = F.col
    agree, same = c("base_label") == c("var_label"), c("base_accepted") == c("var_accepted")
    there = c("var_label").isNotNull()
    return variant_rows.select(
        "perturbation", "family", there.alias("evaluated"),
        (there & agree).alias("label_agrees"), (there & same).alias("acceptance_agrees"),
        (there & same & (agree | ~c("base_accepted"))).alias("decision_agrees"),
        (there & c("base_accepted") & ~c("var_accepted")).alias("to_abstained"), (there & ~c("base_accepted") & c("var_accepted")).alias("to_accepted"),
        F.when(there, divergence(F.map_values("base_probabilities"), F.map_values("var_probabilities"))).alias("js"),
        F.when(there, F.abs(c("base_confidence") - c("var_confidence"))).alias("delta"),
    )


def totals(seen: DataFrame, by: list[str]) -> DataFrame:
    """Raw sums and maxima, which can be merged."""
    n = lambda name: F.coalesce(F.sum(F.col(name).cast("bigint")), F.lit(0))
    return seen.groupBy(*by).agg(
        n("evaluated").alias("evaluated_variants"), F.coalesce(F.sum((~F.col("evaluated")).cast("bigint")), F.lit(0)).alias("skipped_applications"),
        n("label_agrees").alias("label_agreements"), n("acceptance_agrees").alias("acceptance_agreements"), n("decision_agrees").alias("decision_agreements"),
        n("to_abstained").alias("accepted_to_abstained"), n("to_accepted").alias("abstained_to_accepted"),
        F.coalesce(F.sum("js"), F.lit(0.0)).alias("js_sum"), F.coalesce(F.max("js"), F.lit(0.0)).alias("js_max"),
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("delta_sum"), F.coalesce(F.max("delta"), F.lit(0.0)).alias("delta_max"),
    )


def merged(raw: DataFrame, by: list[str]) -> DataFrame:
    """Sums of sums and maxima of maxima: from perturbations to families."""
    keep = [c for c in raw.columns if c not in ("perturbation", *by)]
    return raw.groupBy(*by).agg(*[(F.max(c) if c.endswith("_max") else F.sum(c)).alias(c) for c in keep if c != "family"])


def report(raw: DataFrame, by: list[str]) -> DataFrame:
    """The reported slice: ratios and means rounded to 1e-9, 0 without variants."""
    n = F.col("evaluated_variants")
    r = lambda c: F.round(c * SCALE) / SCALE
    return raw.select(
        *by, "evaluated_variants", "skipped_applications",
        r(safe_ratio(F.col("label_agreements"), n)).alias("label_agreement"), r(safe_ratio(F.col("acceptance_agreements"), n)).alias("acceptance_agreement"), r(safe_ratio(F.col("decision_agreements"), n)).alias("decision_agreement"),
        (n - F.col("label_agreements")).alias("label_flips"), (n - F.col("acceptance_agreements")).alias("acceptance_flips"), "accepted_to_abstained", "abstained_to_accepted",
        r(safe_ratio(F.col("js_sum"), n)).alias("mean_normalized_js_divergence"), r(F.col("js_max")).alias("maximum_normalized_js_divergence"),
        r(safe_ratio(F.col("delta_sum"), n)).alias("mean_absolute_confidence_delta"), r(F.col("delta_max")).alias("maximum_absolute_confidence_delta"),
    )


def validate_cases(cases: DataFrame, id_: str = "id", text: str = "text", max_rows: int = 100_000) -> None:
    """Raises on malformed or repeated ids, blank or oversize texts, no rows or too many. Texts stay out of the messages."""
    n = cases.count()
    if not 1 <= n <= max_rows:
        raise contracts.ContractError(f"an audit takes 1..{max_rows} cases, not {n}")
    bad = ~F.coalesce(F.col(id_).rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), F.lit(False)) | F.coalesce(F.length(text) > MAX_CHARS, F.lit(True)) | F.col(text).rlike(r"(?U)\A\s*\z")
    contracts.require(cases.where(bad).select(F.sha2(F.coalesce(F.col(id_), F.lit("")), 256).alias("id_digest")), "malformed case")
    contracts.require(cases.groupBy(id_).count().where("count > 1").select(F.sha2(id_, 256).alias("id_digest")), "repeated id")


def scored_variants(cases: DataFrame, model: Model, text: str = "text") -> DataFrame:
    base = score(cases.select(F.col(text).alias("text")), model).select("text", F.col("predicted").alias("base_label"), F.col("accepted").alias("base_accepted"), F.col("confidence").alias("base_confidence"), F.col("probabilities").alias("base_probabilities"))
    kept = [c for c in base.columns if c != "text"]
    var = score(variants(base), model, "variant")
    there = F.col("variant").isNotNull()
    pick = [F.when(there, F.col(a)).alias(f"var_{b}") for a, b in (("predicted", "label"), ("accepted", "accepted"), ("confidence", "confidence"), ("probabilities", "probabilities"))]
    return var.select("perturbation", "family", *kept, *pick)


def audit(cases: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Raw totals per perturbation; see :func:`report` and :func:`merged`."""
    return totals(observations(scored_variants(cases, model, text)), ["perturbation", "family"])


# Where the cases of an audit come from.
POPULATIONS = ("jsonl", "provided-cases", "bundle-id-test")


@dataclass(frozen=True)
class Audit:
    """Raw totals with where the cases came from. Only :func:`audit_bundle` says that they are a bundle's own test rows."""

    raw: DataFrame
    inputs: int
    population: str


def audit_cases(cases: DataFrame, model: Model, population: str = "provided-cases") -> Audit:
    if population not in POPULATIONS[:2]:
        raise ValueError(f"given cases are {' or '.join(POPULATIONS[:2])}")
    validate_cases(cases)
    return Audit(cut(audit(cases, model)), cases.count(), population)


def audit_bundle(spark: SparkSession, path: str) -> Audit:
    """The test rows that a verified bundle's plan names, under its own model."""
    model, rows = bundle.verify(path), [x for x in bundle.plan(path).get("assignments", []) if x["part"] == "id-test"]
    with open(f"{path}/metrics.json", encoding="utf-8") as f:
        counted = json.load(f).get("inside", {}).get("n")
    if not rows or counted != len(rows):
        raise bundle.BundleError("the plan's test rows aren't those that the metrics count")
    cases = spark.createDataFrame([(x["id"], x["text"]) for x in rows], "id string, text string")
    validate_cases(cases)
    return Audit(cut(audit(cases, model)), len(rows), POPULATIONS[2])


@dataclass(frozen=True)
class Gate:
    """Limits on the unrounded family totals. Typographic limits are off unless given."""

    formatting_label: float = 1.0
    formatting_decision: float = 1.0
    formatting_js: float = 0.0
    typographic_label: float | None = None
    typographic_decision: float | None = None
    typographic_js: float | None = None

    def __post_init__(self) -> None:
        if any(v is not None and not 0 <= v <= 1 for v in vars(self).values()):
            raise ValueError("limits must be within 0..1")

    def enforce(self, raw: DataFrame) -> None:
        """Raises with every missed limit. ``raw`` are totals by perturbation (7 rows), never a rounded report."""
        families = {r["family"]: r.asDict() for r in merged(raw, ["family"]).collect()}
        missed = []
        for family in ("formatting", "typographic"):
            limits = {k: getattr(self, f"{family}_{k}") for k in ("label", "decision", "js")}
            if all(v is None for v in limits.values()):
                continue
            t = families.get(family)
            n = t["evaluated_variants"] if t else 0
            if not n:
                missed.append(f"the {family} audit has no variants")
                continue
            for kind in ("label", "decision"):
                got = t[f"{kind}_agreements"] / n
                if limits[kind] is not None and got < limits[kind]:
                    missed.append(f"{family} {kind} agreement {got:.12f} is below {limits[kind]:.12f}")
            if limits["js"] is not None and t["js_max"] > limits["js"]:
                missed.append(f"{family} divergence {t['js_max']:.12f} is above {limits['js']:.12f}")
        if missed:
            raise GateError("; ".join(missed))


def inconsistencies(by_perturbation: DataFrame, by_family: DataFrame) -> DataFrame:
    """Counts of a family report that its perturbations' reports don't add up to: ``family``, ``measure``."""
    counts = ["evaluated_variants", "skipped_applications", "label_flips", "acceptance_flips", "accepted_to_abstained", "abstained_to_accepted"]
    peaks = ["maximum_normalized_js_divergence", "maximum_absolute_confidence_delta"]
    built = by_perturbation.groupBy("family").agg(*[F.sum(c).alias(f"b_{c}") for c in counts], *[F.max(c).alias(f"b_{c}") for c in peaks])
    both = by_family.join(built, "family", "full_outer")
    wrong = [F.struct(F.lit(c).alias("measure"), (~F.col(c).eqNullSafe(F.col(f"b_{c}")) if c in counts else F.coalesce(F.abs(F.col(c) - F.col(f"b_{c}")) > 2e-9, F.lit(True))).alias("off")) for c in counts + peaks]
    return both.select("family", F.explode(F.array(*wrong)).alias("e")).where("e.off").select("family", "e.measure")
