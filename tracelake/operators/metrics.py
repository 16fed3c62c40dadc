"""Service-level, latency and score reports over request metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scoring
from tracelake.operators.ordered import null_safe_join
from tracelake.operators.quantiles import (
    Rank,
    floor_index,
    linear,
    order_statistics,
    rounded_index,
    upper_median,
)

OVERALL = "overall"


def scored(df: DataFrame) -> DataFrame:
    """Rows that count: warm-up requests removed."""
    return df.filter(~F.col("is_warmup"))


def with_overall(df: DataFrame, by: str, scope: str = "scope") -> DataFrame:
    """Each row once under its group and once under 'overall' (combined map-side by any aggregate)."""
    return df.withColumn(scope, F.explode(F.array(F.lit(OVERALL), F.coalesce(F.col(by), F.lit("unknown")))))


def melt(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """Long form (keys, metric, value) of several measures; null values dropped."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()])
    return df.select(*keys, F.inline(rows)).filter(F.col("value").isNotNull())


def effective_rate(df: DataFrame, by: str) -> DataFrame:
    """Rows, effective rows and their share, per group and overall."""
    return (
        scored(df)
        .groupingSets([[], [by]], by)
        .agg(
            F.when(F.grouping(by) == 1, F.lit(OVERALL)).otherwise(F.col(by)).alias("scope"),
            F.count(F.lit(1)).alias("n"),
            F.count_if("effective").alias("n_effective"),
        )
        .select("scope", "n", "n_effective", (F.col("n_effective") / F.greatest("n", F.lit(1))).alias("erc"))
    )


LATENCY_RANKS = (linear("p50", 50), linear("p90", 90), linear("p95", 95))


def value_summary(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Sequence[Rank] = LATENCY_RANKS, accuracy: int | None = None
) -> DataFrame:
    """count, min, max, mean and percentiles per key; ``accuracy`` switches to approximate ones."""
    if accuracy:
        points = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
        return df.groupBy(*keys).agg(
            F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.mean(value).alias("mean"),
            *[F.approx_percentile(value, points[r.name], accuracy).alias(r.name) for r in ranks],
        )
    stats = order_statistics(df, keys, value, ranks)
    if not keys:
        return stats
    # a group whose values are all null is reported with count 0
    every = null_safe_join(df.select(*keys).distinct(), stats, keys, "left")
    return every.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def latency_board(df: DataFrame, by: str, metrics: Mapping[str, Column]) -> DataFrame:
    """Latency summaries of several measures per group and overall, in one pair of passes."""
    long = melt(with_overall(scored(df), by), ["scope"], metrics)
    return value_summary(long, ["scope", "metric"], "value")


def debug_rollup(df: DataFrame, by: str, slo_ttft: float, slo_tbt: float) -> DataFrame:
    """All counters of a run per group and overall."""
    kept = ~F.col("is_warmup")
    return with_overall(df, by).groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("is_warmup").alias("n_warmup"),
        F.count_if(kept).alias("n_scored"),
        F.count_if(kept & F.col("effective")).alias("n_effective"),
        (100.0 * F.count_if(kept & F.col("effective")) / F.greatest(F.count_if(kept), F.lit(1))).alias("erc_percent"),
        F.count_if(kept & scoring.slo_violation(F.col("ttft_ms"), F.lit(slo_ttft))).alias("slo_fail_ttft"),
        F.count_if(kept & scoring.slo_violation(F.col("tbt_ms"), F.lit(slo_tbt))).alias("slo_fail_tbt"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"),
        F.count_if(kept & (F.col("output_tokens") < 1)).alias("zero_output"),
        F.mean(F.when(kept, F.col("output_tokens"))).alias("output_mean"),
        F.min("input_length").alias("input_min"),
        F.max("input_length").alias("input_max"),
        F.mean("input_length").alias("input_mean"),
    )


def debug_report(df: DataFrame, by: str, slo_ttft: float, slo_tbt: float) -> DataFrame:
    """``debug_rollup`` with percentiles of latencies and lengths, and their extremes, per group."""
    rollup = debug_rollup(df, by, slo_ttft, slo_tbt)
    live = ~F.col("is_warmup")
    long = melt(
        with_overall(df, by),
        ["scope"],
        {
            "ttft": F.when(live, F.col("ttft_ms")), "tbt": F.when(live, F.col("tbt_ms")),
            "input": F.col("input_length"), "output": F.when(live, F.col("output_tokens")),
        },
    )
    ranks = value_summary(long, ["scope", "metric"], "value")
    wide = ranks.groupBy("scope").agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}")
            for m in ("ttft", "tbt", "input", "output")
            for p in (*(r.name for r in LATENCY_RANKS), *(() if m == "input" else ("min", "max")))
        ]
    )
    return rollup.join(wide, "scope", "left")


def probe_summary(df: DataFrame, by: str) -> DataFrame:
    """Probe count and mean scores per group."""
    return df.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.mean(F.coalesce("f1", F.lit(0.0))).alias("f1_mean"),
        F.mean(F.coalesce("em", F.lit(0.0))).alias("em_mean"),
    )


def mean_probe_score(df: DataFrame, f1: str = "f1") -> DataFrame:
    """One row: number of probes and their mean score, 0 without probes."""
    return df.agg(F.count(F.lit(1)).alias("n_probes"), F.coalesce(F.mean(F.coalesce(f1, F.lit(0.0))), F.lit(0.0)).alias("mean_f1"))


def final_report(df: DataFrame, keys: Sequence[str] = (), baseline: float = scoring.BASELINE_MEAN) -> DataFrame:
    """Effective rate, accuracy gate, score and throughput, one row per key, in a single aggregate."""
    live = ~F.col("is_warmup")
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(live).alias("n_scored"),
        F.count_if(live & F.col("effective")).alias("n_effective"),
        F.count("probe_f1").alias("n_probes"),
        F.coalesce(F.mean("probe_f1"), F.lit(0.0)).alias("submission_mean"),
        ((F.max("at_ms") - F.min("at_ms")) / 1000.0).alias("wall_time_s"),
    )
    erc = F.col("n_effective") / F.greatest("n_scored", F.lit(1))
    drop = scoring.accuracy_drop(F.col("submission_mean"), F.lit(baseline))
    return agg.select(
        *keys, "n_total", "n_scored", "n_effective", "n_probes", "submission_mean", "wall_time_s",
        erc.alias("erc"), drop.alias("accuracy_drop"), scoring.accuracy_penalty(drop).alias("penalty"), (drop < scoring.DROP_ZERO).alias("pass_gate"),
        scoring.final_score(erc, drop).alias("score"), scoring.score_reason(erc, drop, F.col("n_probes")).alias("reason"),
        (F.col("n_total") / F.greatest("wall_time_s", F.lit(0.01))).alias("throughput_rps"),
    )


def reload_metrics(metrics: DataFrame, probe_details: DataFrame) -> DataFrame:
    """Stored metrics with probe scores taken from the details table, else from the row itself."""
    d = probe_details.select(
        "request_id", F.col("scores.f1").alias("d_f1"), F.col("scores.em").alias("d_em"), F.lit(True).alias("has_detail")
    )
    inline = F.col("probe_f1").isNotNull()
    return metrics.join(d, "request_id", "left").withColumns(
        {
            "probe_f1": F.when(F.col("has_detail"), F.col("d_f1")).otherwise(F.col("probe_f1")),
            "probe_em": F.when(F.col("has_detail"), F.col("d_em")).otherwise(
                F.when(inline, F.coalesce("probe_em", F.lit(0.0)))
            ),
        }
    ).drop("d_f1", "d_em", "has_detail")


def ers_by_tag(df: DataFrame, params: scoring.ErsParams | None = None, key: str = "tag") -> DataFrame:
    """Mean smooth score per tag; failures count 0."""
    score = scoring.ers_score(F.col("error"), F.col("ttft_ms"), scoring.array_mean(F.col("tbt_ms")), params)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.mean(score).alias("ers"))


def replay_summary(df: DataFrame, slo_ttft: float, slo_tbt: float, params: scoring.ErsParams | None = None) -> DataFrame:
    """Per tag: counts, smooth score, pass rate and rounded-index percentiles of three measures."""
    tpot = scoring.array_mean(F.col("tbt_ms"))
    ok = F.col("error").isNull() & F.col("ttft_ms").isNotNull()
    passed = ok & (F.col("ttft_ms") <= slo_ttft) & F.coalesce(tpot <= slo_tbt, F.lit(True))
    base = df.groupBy("tag").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count("error").alias("failed_count"),
        F.mean(scoring.ers_score(F.col("error"), F.col("ttft_ms"), tpot, params)).alias("ers"),
        F.count_if(passed).alias("passed_slo"),
        (F.count_if(passed) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("erc"),
        F.max(F.when(ok, F.col("ttft_ms"))).alias("ttft_max_ms"),
    )
    # One value per request for TTFT and the request mean, one per gap for the pooled gaps.
    measures = F.concat(
        F.array(
            F.struct(F.lit("ttft").alias("metric"), F.col("ttft_ms").alias("value")),
            F.struct(F.lit("mean").alias("metric"), tpot.alias("value")),
        ),
        F.transform("tbt_ms", lambda g: F.struct(F.lit("gap").alias("metric"), g.alias("value"))),
    )
    long = df.filter(ok).select("tag", F.inline(measures)).filter(F.col("value").isNotNull())
    ranks = order_statistics(long, ["tag", "metric"], "value", [rounded_index("p50", 0.5), rounded_index("p95", 0.95)])
    pick = lambda m, p: F.max(F.when(F.col("metric") == m, F.col(p)))
    wide = ranks.groupBy("tag").agg(
        pick("ttft", "p50").alias("ttft_p50_ms"), pick("ttft", "p95").alias("ttft_p95_ms"),
        pick("gap", "p50").alias("tbt_median_ms"), pick("gap", "p95").alias("tbt_p95_ms"),
        pick("mean", "p95").alias("tbt_req_mean_p95_ms"),
    )
    return base.join(wide, "tag", "left")


def batch_summary(df: DataFrame, key: str) -> DataFrame:
    """Success rate, token throughput over wall time and latency ranks per batch."""
    good = F.col("success")
    base = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.mean(good.cast("double")).alias("success_rate"),
        (
            F.coalesce(F.sum(F.when(good, F.col("output_tokens"))), F.lit(0))
            / F.nullif(F.max("wall_time_ms") / 1000.0, F.lit(0.0))
        ).alias("throughput_tok_s"),
    )
    long = melt(df.filter(good), [key], {"ttft": F.col("ttft_ms"), "tbt": F.col("tbt_ms")})
    ranks = order_statistics(long, [key, "metric"], "value", [upper_median("p50"), floor_index("p95", 95)])
    wide = ranks.groupBy(key).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}") for m in ("ttft", "tbt") for p in ("p50", "p95")]
    )
    return null_safe_join(base, wide, [key], "left")


def scenario_summary(df: DataFrame, keys: Sequence[str], wall_s: Column) -> DataFrame:
    """Success rate, throughput and latency statistics per scenario."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if("ok").alias("ok_count"),
        (F.count_if("ok") / F.count(F.lit(1))).alias("ok_rate"),
        wall_s.alias("wall_time_s"),
        F.mean("prompt_tokens").alias("prompt_mean"),
        F.max("prompt_tokens").alias("prompt_max"),
        F.mean("completion_tokens").alias("completion_mean"),
    )
    lat = order_statistics(df.filter("ok"), keys, "latency_s", [linear("latency_p50", 50)])
    lat = lat.select(*keys, F.col("mean").alias("latency_mean"), "latency_p50", F.col("max").alias("latency_max"))
    out = null_safe_join(base, lat, list(keys), "left")
    return out.withColumns(
        {
            "throughput": F.when(F.col("wall_time_s") > 0, F.col("n_requests") / F.col("wall_time_s")).otherwise(0.0),
            "amortized_s": F.col("wall_time_s") / F.col("n_requests"),
        }
    )


def latency_probe(df: DataFrame, key: str, value: str = "ttft_ms") -> DataFrame:
    """Ranks, mean, sample deviation and values over three times the mean, per probe."""
    spread = df.filter("ok").groupBy(key).agg(
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.mean(value).alias("__mean")
    )
    ranks = order_statistics(
        df.filter("ok"), [key], value, [upper_median("p50"), floor_index("p90", 90), floor_index("p99", 99)]
    )
    counts = df.groupBy(key).agg(F.count_if("ok").alias("ok_count"), F.count_if(~F.col("ok")).alias("error_count"))
    spikes = null_safe_join(df.filter("ok"), spread, [key]).groupBy(key).agg(
        F.first("stdev").alias("stdev"), F.count_if(F.col(value) > 3 * F.col("__mean")).alias("spikes")
    )
    out = null_safe_join(counts, ranks.drop("n"), [key], "left")
    return null_safe_join(out, spikes, [key], "left")


def warmup_outcome(df: DataFrame) -> DataFrame:
    """Totals of a warm-up run; ``warmup_problems`` lists the rows behind them."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"),
        F.count("warning").alias("warned"),
    )


def warmup_problems(df: DataFrame, key: str) -> DataFrame:
    """One row (kind, key, message) per request of a warm-up run that failed or warned."""
    kinds = F.array(
        F.struct(F.lit("failure").alias("kind"), F.when(~F.col("ok"), F.coalesce("error", F.lit(""))).alias("message")),
        F.struct(F.lit("warning").alias("kind"), F.col("warning").alias("message")),
    )
    return df.select(key, F.explode(kinds).alias("__p")).where("__p.message IS NOT NULL").select("__p.kind", key, "__p.message")


def worst_probes(df: DataFrame, k: int = 5) -> DataFrame:
    return df.orderBy("f1", "request_id").limit(k)
