"""Request predicates and scores as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Penalty bounds of the accuracy drop and the reference probe mean.
DROP_FREE, DROP_HALF, DROP_ZERO = 0.005, 0.015, 0.02
BASELINE_MEAN = 0.831


def request_effective(ttft: Column, tbt: Column, n_out: Column, slo_ttft: Column, slo_tbt: Column) -> Column:
    """At least one output token and both latencies present and within their limits."""
    return (
        (n_out >= 1) & F.coalesce(ttft <= slo_ttft, F.lit(False)) & F.coalesce(tbt <= slo_tbt, F.lit(False))
    )


def slo_violation(value: Column, slo: Column) -> Column:
    """Strictly over the limit; a missing value is no violation."""
    return F.coalesce(value > slo, F.lit(False))


def accuracy_penalty(drop: Column) -> Column:
    return (
        F.when(drop >= DROP_ZERO, F.lit(0.0))
        .when(drop <= DROP_FREE, F.lit(1.0))
        .when(drop <= DROP_HALF, 1.0 - (drop - DROP_FREE) / 0.01 * 0.5)
        .otherwise(0.5 * (DROP_ZERO - drop) / 0.005)
    )


def accuracy_drop(mean: Column, baseline: Column) -> Column:
    return F.greatest(F.lit(0.0), baseline - mean)


def final_score(erc: Column, drop: Column) -> Column:
    return 100.0 * erc * accuracy_penalty(drop)


def score_reason(erc: Column, drop: Column, n_probes: Column) -> Column:
    """Why a score is below 100; runs without probes are named as such."""
    return (
        F.when(n_probes == 0, F.lit("n_probes = 0"))
        .when(drop >= DROP_ZERO, F.lit("accuracy_gate_fail"))
        .when(erc < 1.0, F.lit("erc_below_100%"))
        .otherwise(F.lit("pass"))
    )


@dataclass(frozen=True)
class ErsParams:
    """Floors, ceilings, exponent and weight of the smooth request score."""

    floor_ttft: float = 100.0
    ceil_ttft: float = 1500.0
    floor_tpot: float = 20.0
    ceil_tpot: float = 45.0
    gamma: float = 2.0
    weight: float = 0.5


def ers_component(x: Column, floor: Column, ceiling: Column, gamma: Column) -> Column:
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ceiling - x) / (ceiling - floor))), gamma)


def ers_score(error: Column, ttft: Column, tpot: Column, p: ErsParams | None = None) -> Column:
    """0 for failures; ``tpot`` is the mean gap, null (no gaps) counts as 0."""
    p = p or ErsParams()
    g = F.lit(p.gamma)
    s1 = ers_component(ttft, F.lit(p.floor_ttft), F.lit(p.ceil_ttft), g)
    s2 = ers_component(F.coalesce(tpot, F.lit(0.0)), F.lit(p.floor_tpot), F.lit(p.ceil_tpot), g)
    return F.when(error.isNotNull() | ttft.isNull(), F.lit(0.0)).otherwise(p.weight * s1 + (1 - p.weight) * s2)


def array_mean(c: Column) -> Column:
    """Mean of an array, null when empty."""
    return F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c))


def trimmed_median(gaps: Column) -> Column:
    """Median after dropping 5 % (at least one) per side; null below two, untrimmed if nothing is left."""
    n = F.size(gaps)
    trim = F.greatest(F.lit(1), F.floor(n * 0.05).cast("int"))
    s = F.array_sort(gaps)
    mid = F.when(n - 2 * trim > 0, F.slice(s, trim + 1, F.greatest(n - 2 * trim, F.lit(0)))).otherwise(gaps)
    half = F.floor(F.size(mid) / 2).cast("int")
    return F.when(
        n >= 2,
        F.when(F.size(mid) % 2 == 1, F.get(mid, half)).otherwise((F.get(mid, half - 1) + F.get(mid, half)) / 2),
    )


def composite_score(coverage: Column, judge: Column, w_coverage: float = 0.5, w_judge: float = 0.5) -> Column:
    """Weighted sum of coverage and a judge score clamped to 0..1."""
    return w_coverage * coverage + w_judge * F.greatest(F.lit(0.0), F.least(F.lit(1.0), judge))


def percent_delta(new: Column, old: Column) -> Column:
    """Relative change in percent; null when the old value is 0 or missing."""
    return F.when(old != 0, (new - old) / old * 100.0)


def register_sql_functions(spark: SparkSession) -> None:
    """SQL forms of the main expressions; Catalyst inlines their bodies."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION slo_effective(ttft DOUBLE, tbt DOUBLE, n BIGINT, s1 DOUBLE, s2 DOUBLE) "
        "RETURNS BOOLEAN RETURN n >= 1 AND coalesce(ttft <= s1, false) AND coalesce(tbt <= s2, false)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION token_est(chars BIGINT) RETURNS BIGINT "
        "RETURN CAST(greatest(1, bround(chars / 4.0D)) AS BIGINT)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION accuracy_penalty(d DOUBLE) RETURNS DOUBLE RETURN "
        "CASE WHEN d >= 0.02D THEN 0D WHEN d <= 0.005D THEN 1D "
        "WHEN d <= 0.015D THEN 1D - (d - 0.005D) / 0.01D * 0.5D ELSE 0.5D * (0.02D - d) / 0.005D END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION ers_score(failed BOOLEAN, ttft DOUBLE, tpot DOUBLE) RETURNS DOUBLE RETURN "
        "CASE WHEN failed OR ttft IS NULL THEN 0D ELSE "
        "0.5D * pow(greatest(0D, least(1D, (1500D - ttft) / 1400D)), 2) + "
        "0.5D * pow(greatest(0D, least(1D, (45D - coalesce(tpot, 0D)) / 25D)), 2) END"
    )
