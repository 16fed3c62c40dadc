"""Registered queries: request predicates, latency, score and replay reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import scoring
from tracelake.operators import metrics, quantiles, trace
from tracelake.plans.catalog import query, r6, rounded
from tracelake.plans.fixtures import (
    MEASURE, REPLAY, REQ, SLO_TBT, SLO_TTFT, measures, replay, requests, table,
)

@query("p01_scored_only", f"WITH {REQ} SELECT workload_type, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM requests WHERE NOT is_warmup GROUP BY 1")
def p01(spark, sf):
    return metrics.scored(requests(spark, sf)).groupBy("workload_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum")
    )


@query("p02_effective_predicate", f"WITH {REQ} SELECT request_id, effective FROM requests")
def p02(spark, sf):
    return requests(spark, sf).select("request_id", "effective")


@query(
    "p03_slo_violations",
    f"WITH {REQ} SELECT request_id, coalesce(ttft_ms > 1500, false) AS ttft_fail, coalesce(tbt_ms > 45, false) AS tbt_fail FROM requests",
)
def p03(spark, sf):
    return requests(spark, sf).select(
        "request_id",
        scoring.slo_violation(F.col("ttft_ms"), F.lit(SLO_TTFT)).alias("ttft_fail"),
        scoring.slo_violation(F.col("tbt_ms"), F.lit(SLO_TBT)).alias("tbt_fail"),
    )


@query(
    "a01_effective_rate",
    f"""WITH {REQ} SELECT CASE WHEN grouping(workload_type) = 1 THEN 'overall' ELSE workload_type END AS scope, count(*) AS n,
    count(*) FILTER (WHERE effective) AS n_effective,
    round(count(*) FILTER (WHERE effective) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS erc
    FROM requests WHERE NOT is_warmup GROUP BY GROUPING SETS ((), (workload_type))""",
)
def a01(spark, sf):
    return rounded(metrics.effective_rate(requests(spark, sf), "workload_type"), "erc")


_SCOPED = f"""{REQ}, scoped AS (SELECT *, workload_type AS scope FROM requests WHERE NOT is_warmup
  UNION ALL SELECT *, 'overall' FROM requests WHERE NOT is_warmup),
longm AS (SELECT scope, 'ttft_ms' AS metric, ttft_ms AS v FROM scoped UNION ALL SELECT scope, 'tbt_ms', tbt_ms FROM scoped)"""


@query(
    "a02_latency_summary",
    f"""WITH {_SCOPED} SELECT scope, metric, count(v) AS n, round(min(v), 6) AS min, round(quantile_cont(v, 0.5), 6) AS p50,
    round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS max
    FROM longm GROUP BY 1, 2""",
)
def a02(spark, sf):
    board = metrics.latency_board(
        requests(spark, sf), "workload_type", {"ttft_ms": F.col("ttft_ms"), "tbt_ms": F.col("tbt_ms")}
    )
    return rounded(board.drop("mean"), "min", "p50", "p90", "p95", "max")


@query(
    "a03_token_stats",
    f"""WITH {REQ} SELECT workload_type, count(*) AS n, CAST(min(output_tokens) AS DOUBLE) AS min, CAST(max(output_tokens) AS DOUBLE) AS max,
    round(avg(output_tokens), 6) AS mean, round(quantile_cont(output_tokens, 0.5), 6) AS p50,
    round(quantile_cont(output_tokens, 0.9), 6) AS p90, round(quantile_cont(output_tokens, 0.95), 6) AS p95
    FROM requests WHERE NOT is_warmup GROUP BY 1""",
)
def a03(spark, sf):
    out = metrics.value_summary(metrics.scored(requests(spark, sf)), ["workload_type"], "output_tokens")
    return rounded(out.na.fill(0.0, ["min", "max", "mean", "p50", "p90", "p95"]), "mean", "p50", "p90", "p95")


@query(
    "a04_input_length_summary",
    f"""WITH {REQ} SELECT workload_type, count(*) AS n, CAST(min(input_length) AS DOUBLE) AS min, round(quantile_cont(input_length, 0.5), 6) AS p50,
    round(quantile_cont(input_length, 0.95), 6) AS p95, CAST(max(input_length) AS DOUBLE) AS max, round(avg(input_length), 6) AS mean
    FROM requests GROUP BY 1""",
)
def a04(spark, sf):
    ranks = [quantiles.linear("p50", 50), quantiles.linear("p95", 95)]
    return rounded(metrics.value_summary(requests(spark, sf), ["workload_type"], "input_length", ranks), "mean", "p50", "p95")


@query(
    "a05_percentile_linear",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
    round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1""",
)
def a05(spark, sf):
    out = quantiles.order_statistics(
        table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice",
        [quantiles.linear("p50", 50), quantiles.linear("p90", 90), quantiles.linear("p99", 99)],
    )
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p50", "p90", "p99")])


def _ranked_sql(table_sql: str, key: str, value: str, picks: dict[str, str]) -> str:
    cols = ", ".join(f"max(CASE WHEN rn = {expr} THEN v END) AS {name}" for name, expr in picks.items())
    return f"""WITH src AS ({table_sql}), r AS (SELECT {key}, {value} AS v,
      row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM src WHERE {value} IS NOT NULL)
      SELECT {key}, {cols} FROM r GROUP BY {key}"""


@query(
    "a06_percentile_floor_index",
    _ranked_sql(
        "SELECT * FROM lineitem", "l_returnflag", "l_extendedprice",
        {"p50": "n // 2", "p90": "least(n * 90 // 100, n - 1)", "p99": "least(n * 99 // 100, n - 1)"},
    ),
)
def a06(spark, sf):
    return quantiles.order_statistics(
        table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice",
        [quantiles.upper_median("p50"), quantiles.floor_index("p90", 90), quantiles.floor_index("p99", 99)],
    ).select("l_returnflag", "p50", "p90", "p99")


@query(
    "a07_percentile_index_variants",
    _ranked_sql(
        f"WITH {REQ} SELECT * FROM requests", "workload_type", "ttft_ms",
        {
            "r50": "CAST(round_even(0.5::DOUBLE * (n - 1), 0) AS BIGINT)", "r95": "CAST(round_even(0.95::DOUBLE * (n - 1), 0) AS BIGINT)",
            "t50": "CAST(floor(0.5::DOUBLE * (n - 1)) AS BIGINT)", "t95": "CAST(floor(0.95::DOUBLE * (n - 1)) AS BIGINT)",
        },
    ),
)
def a07(spark, sf):
    return quantiles.order_statistics(
        requests(spark, sf), ["workload_type"], "ttft_ms",
        [
            quantiles.rounded_index("r50", 0.5), quantiles.rounded_index("r95", 0.95),
            quantiles.truncated_index("t50", 0.5), quantiles.truncated_index("t95", 0.95),
        ],
    ).select("workload_type", "r50", "r95", "t50", "t95")


_TRIM = """g AS (SELECT request_id, list_sort(tbt_ms) AS s, tbt_ms AS raw, len(tbt_ms) AS n FROM replay),
t AS (SELECT *, greatest(1, CAST(floor(n * 0.05) AS BIGINT)) AS tr FROM g),
m AS (SELECT request_id, n, CASE WHEN n - 2 * tr > 0 THEN s[tr + 1 : n - tr] ELSE raw END AS mid FROM t)"""


@query(
    "a08_trimmed_median_gap",
    f"""WITH {REPLAY}, {_TRIM} SELECT request_id, round(CASE WHEN n < 2 THEN NULL WHEN len(mid) % 2 = 1 THEN mid[len(mid) // 2 + 1]
    ELSE (mid[len(mid) // 2] + mid[len(mid) // 2 + 1]) / 2 END, 6) AS tbt_median FROM m""",
)
def a08(spark, sf):
    return replay(spark, sf).select("request_id", r6(scoring.trimmed_median(F.col("tbt_ms"))).alias("tbt_median"))


@query("a24_mean_probe_score", f"WITH {REQ} SELECT count(*) AS n_probes, round(coalesce(avg(coalesce(probe_f1, 0)), 0), 6) AS mean_f1 FROM requests WHERE is_probe_slot")
def a24(spark, sf):
    return rounded(metrics.mean_probe_score(requests(spark, sf).filter("is_probe_slot"), "probe_f1"), "mean_f1")


def _probes(spark, sf):
    return requests(spark, sf).filter("is_probe_slot").select(
        "request_id", "workload_type", F.col("probe_f1").alias("f1"), F.col("probe_em").alias("em")
    )


@query(
    "a25_probe_summary",
    f"WITH {REQ} SELECT workload_type, count(*) AS n, round(avg(probe_f1), 6) AS f1_mean, round(avg(probe_em), 6) AS em_mean FROM requests WHERE is_probe_slot GROUP BY 1",
)
def a25(spark, sf):
    return rounded(metrics.probe_summary(_probes(spark, sf), "workload_type"), "f1_mean", "em_mean")


_DEBUG = f"""WITH {REQ}, s AS (SELECT *, workload_type AS scope FROM requests UNION ALL SELECT *, 'overall' FROM requests)
SELECT scope, count(*) AS n_total, count(*) FILTER (WHERE is_warmup) AS n_warmup, count(*) FILTER (WHERE NOT is_warmup) AS n_scored,
 count(*) FILTER (WHERE NOT is_warmup AND effective) AS n_effective,
 round(100.0::DOUBLE * count(*) FILTER (WHERE NOT is_warmup AND effective) / greatest(count(*) FILTER (WHERE NOT is_warmup), 1), 6) AS erc_percent,
 count(*) FILTER (WHERE NOT is_warmup AND ttft_ms > 1500) AS slo_fail_ttft, count(*) FILTER (WHERE NOT is_warmup AND tbt_ms > 45) AS slo_fail_tbt,
 count(error) AS errors, count(*) FILTER (WHERE NOT is_warmup AND output_tokens < 1) AS zero_output,
 min(input_length) AS input_min, max(input_length) AS input_max, round(avg(input_length), 6) AS input_mean,
 round(avg(output_tokens) FILTER (WHERE NOT is_warmup), 6) AS output_mean, round(quantile_cont(input_length, 0.9), 6) AS input_p90,
 """ + ", ".join(
    f"round({f}, 6) AS {m}_{n}" for m, c in (("ttft", "ttft_ms"), ("tbt", "tbt_ms"), ("output", "output_tokens"))
    for n, f in (("p90", f"quantile_cont(CASE WHEN NOT is_warmup THEN {c} END, 0.9)"), ("min", f"CAST(min({c}) FILTER (WHERE NOT is_warmup) AS DOUBLE)"),
                 ("max", f"CAST(max({c}) FILTER (WHERE NOT is_warmup) AS DOUBLE)"))
) + """,
 round(quantile_cont(CASE WHEN NOT is_warmup THEN ttft_ms END, 0.5), 6) AS ttft_p50, round(quantile_cont(CASE WHEN NOT is_warmup THEN ttft_ms END, 0.95), 6) AS ttft_p95,
 round(quantile_cont(CASE WHEN NOT is_warmup THEN tbt_ms END, 0.5), 6) AS tbt_p50, round(quantile_cont(CASE WHEN NOT is_warmup THEN tbt_ms END, 0.95), 6) AS tbt_p95,
 round(quantile_cont(input_length, 0.5), 6) AS input_p50, round(quantile_cont(input_length, 0.95), 6) AS input_p95,
 round(quantile_cont(CASE WHEN NOT is_warmup THEN output_tokens END, 0.5), 6) AS output_p50, round(quantile_cont(CASE WHEN NOT is_warmup THEN output_tokens END, 0.95), 6) AS output_p95
FROM s GROUP BY scope"""


@query("a26_debug_rollup", _DEBUG)
def a26(spark, sf):
    out = metrics.debug_report(requests(spark, sf), "workload_type", SLO_TTFT, SLO_TBT)
    points = [f"{m}_{p}" for m in ("ttft", "tbt", "input", "output") for p in ("p50", "p90", "p95")]
    ends = [f"{m}_{p}" for m in ("ttft", "tbt", "output") for p in ("min", "max")]
    return rounded(out, "erc_percent", "input_mean", "output_mean", *points, *ends)


_PENALTY = """CASE WHEN drop_ >= 0.02 THEN 0 WHEN drop_ <= 0.005 THEN 1 WHEN drop_ <= 0.015 THEN 1 - (drop_ - 0.005) / 0.01 * 0.5
  ELSE 0.5 * (0.02 - drop_) / 0.005 END"""


@query(
    "a27_final_report",
    f"""WITH {REQ}, a AS (SELECT workload_type, count(*) AS n_total, count(*) FILTER (WHERE NOT is_warmup) AS n_scored,
      count(*) FILTER (WHERE NOT is_warmup AND effective) AS n_effective, count(probe_f1) AS n_probes, coalesce(avg(probe_f1), 0) AS sm,
      (max(at_ms) - min(at_ms)) / 1000.0::DOUBLE AS wall FROM requests GROUP BY 1),
    b AS (SELECT *, n_effective / CAST(greatest(n_scored, 1) AS DOUBLE) AS erc0, greatest(0, 0.45 - sm) AS drop_ FROM a)
    SELECT workload_type, n_total, n_scored, n_effective, n_probes, round(sm, 6) AS submission_mean, round(wall, 6) AS wall_time_s,
     round(erc0, 6) AS erc, round(drop_, 6) AS accuracy_drop, round({_PENALTY}, 6) AS penalty, drop_ < 0.02 AS pass_gate, round(100 * erc0 * ({_PENALTY}), 6) AS score,
     CASE WHEN n_probes = 0 THEN 'n_probes = 0' WHEN drop_ >= 0.02 THEN 'accuracy_gate_fail' WHEN erc0 < 1 THEN 'erc_below_100%' ELSE 'pass' END AS reason,
     round(n_total / greatest(wall, 0.01), 6) AS throughput_rps FROM b""",
)
def a27(spark, sf):
    out = metrics.final_report(requests(spark, sf), ["workload_type"], baseline=0.45)
    return rounded(out, "submission_mean", "wall_time_s", "erc", "accuracy_drop", "penalty", "score", "throughput_rps")


def _ers_sql(ft, ct, fp, cp):
    return f"""CASE WHEN error IS NOT NULL OR ttft_ms IS NULL THEN 0 ELSE
      0.5 * pow(greatest(0, least(1, ({ct}::DOUBLE - ttft_ms) / {ct - ft}::DOUBLE)), 2) +
      0.5 * pow(greatest(0, least(1, ({cp}::DOUBLE - coalesce(list_avg(tbt_ms), 0)) / {cp - fp}::DOUBLE)), 2) END"""


@query("a28_ers", f"WITH {REPLAY} SELECT tag, count(*) AS n, round(avg({_ers_sql(100, 1500, 20, 45)}), 6) AS ers FROM replay GROUP BY 1")
def a28(spark, sf):
    return rounded(metrics.ers_by_tag(replay(spark, sf)), "ers")


@query(
    "a29_replay_summary",
    f"""WITH {REPLAY}, okr AS (SELECT *, list_avg(tbt_ms) AS tp FROM replay WHERE error IS NULL AND ttft_ms IS NOT NULL),
    base AS (SELECT tag, count(*) AS total_count, count(error) AS failed_count, avg({_ers_sql(100, 1500, 20, 45)}) AS ers,
      count(*) FILTER (WHERE error IS NULL AND ttft_ms <= 1500 AND coalesce(list_avg(tbt_ms) <= 45, true)) AS passed_slo,
      max(CASE WHEN error IS NULL THEN ttft_ms END) AS ttft_max_ms FROM replay GROUP BY 1),
    v AS (SELECT tag, 'ttft' AS m, ttft_ms AS v FROM okr UNION ALL SELECT tag, 'mean', tp FROM okr WHERE tp IS NOT NULL
      UNION ALL SELECT tag, 'gap', unnest(tbt_ms) FROM okr),
    r AS (SELECT tag, m, v, row_number() OVER (PARTITION BY tag, m ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY tag, m) AS n FROM v),
    p AS (SELECT tag, max(v) FILTER (WHERE m = 'ttft' AND rn = round_even(0.5::DOUBLE * (n - 1), 0)) AS ttft_p50_ms,
      max(v) FILTER (WHERE m = 'ttft' AND rn = round_even(0.95::DOUBLE * (n - 1), 0)) AS ttft_p95_ms,
      max(v) FILTER (WHERE m = 'gap' AND rn = round_even(0.5::DOUBLE * (n - 1), 0)) AS tbt_median_ms,
      max(v) FILTER (WHERE m = 'gap' AND rn = round_even(0.95::DOUBLE * (n - 1), 0)) AS tbt_p95_ms,
      max(v) FILTER (WHERE m = 'mean' AND rn = round_even(0.95::DOUBLE * (n - 1), 0)) AS tbt_req_mean_p95_ms FROM r GROUP BY 1)
    SELECT tag, total_count, failed_count, round(ers, 6) AS ers, passed_slo, round(passed_slo / CAST(total_count AS DOUBLE), 6) AS erc,
     round(ttft_max_ms, 4) AS ttft_max_ms, round(ttft_p50_ms, 4) AS ttft_p50_ms, round(ttft_p95_ms, 4) AS ttft_p95_ms,
     round(tbt_median_ms, 4) AS tbt_median_ms, round(tbt_p95_ms, 4) AS tbt_p95_ms, round(tbt_req_mean_p95_ms, 4) AS tbt_req_mean_p95_ms
    FROM base JOIN p USING (tag)""",
)
def a29(spark, sf):
    out = metrics.replay_summary(replay(spark, sf), SLO_TTFT, SLO_TBT)
    out = rounded(out, "ers", "erc")
    cols = ["ttft_max_ms", "ttft_p50_ms", "ttft_p95_ms", "tbt_median_ms", "tbt_p95_ms", "tbt_req_mean_p95_ms"]
    return out.withColumns({c: F.round(c, 4) for c in cols})


@query(
    "a30_rescore",
    f"WITH {REPLAY} SELECT tag, count(*) AS n, round(avg({_ers_sql(10, 400, 1, 10)}), 6) AS ers FROM replay GROUP BY 1 ORDER BY ers DESC",
)
def a30(spark, sf):
    tight = scoring.ErsParams(10.0, 400.0, 1.0, 10.0)
    return rounded(metrics.ers_by_tag(replay(spark, sf), tight), "ers").orderBy(F.desc("ers"), F.desc("tag"))


@query(
    "a31_batch_summary",
    f"""WITH {REQ}, b AS (SELECT k % 8 AS batch_size, error IS NULL AND ttft_ms IS NOT NULL AS success, ttft_ms, tbt_ms, output_tokens,
       coalesce(ttft_ms, 0) + coalesce(tbt_ms, 0) * output_tokens AS wall FROM requests),
     g AS (SELECT batch_size, count(*) AS n, avg(CAST(success AS INT)) AS success_rate,
       sum(CASE WHEN success THEN output_tokens ELSE 0 END) / (max(wall) / 1000) AS thr FROM b GROUP BY 1),
     r AS (SELECT batch_size, ttft_ms AS v, row_number() OVER (PARTITION BY batch_size ORDER BY ttft_ms) - 1 AS rn,
       count(*) OVER (PARTITION BY batch_size) AS n FROM b WHERE success),
     p AS (SELECT batch_size, max(CASE WHEN rn = n // 2 THEN v END) AS ttft_p50, max(CASE WHEN rn = least(n * 95 // 100, n - 1) THEN v END) AS ttft_p95 FROM r GROUP BY 1),
     rt AS (SELECT batch_size, tbt_ms AS v, row_number() OVER (PARTITION BY batch_size ORDER BY tbt_ms) - 1 AS rn,
       count(*) OVER (PARTITION BY batch_size) AS n FROM b WHERE success AND tbt_ms IS NOT NULL),
     pt AS (SELECT batch_size, max(CASE WHEN rn = n // 2 THEN v END) AS tbt_p50, max(CASE WHEN rn = least(n * 95 // 100, n - 1) THEN v END) AS tbt_p95 FROM rt GROUP BY 1)
     SELECT batch_size, n, round(success_rate, 6) AS success_rate, round(thr, 6) AS throughput_tok_s, round(ttft_p50, 6) AS ttft_p50, round(ttft_p95, 6) AS ttft_p95,
       round(tbt_p50, 6) AS tbt_p50, round(tbt_p95, 6) AS tbt_p95
     FROM g JOIN p USING (batch_size) JOIN pt USING (batch_size)""",
)
def a31(spark, sf):
    b = requests(spark, sf).select(
        (F.col("k") % 8).alias("batch_size"), (F.col("error").isNull() & F.col("ttft_ms").isNotNull()).alias("success"),
        "ttft_ms", "tbt_ms", "output_tokens",
        (F.coalesce("ttft_ms", F.lit(0.0)) + F.coalesce("tbt_ms", F.lit(0.0)) * F.col("output_tokens")).alias("wall_time_ms"),
    )
    return rounded(metrics.batch_summary(b, "batch_size"), "success_rate", "throughput_tok_s", "ttft_p50", "ttft_p95", "tbt_p50", "tbt_p95")


@query(
    "a32_scenario_summary",
    f"""WITH {MEASURE}, g AS (SELECT round, scenario_id, count(*) AS n_requests, count(*) FILTER (WHERE ok) AS ok_count,
      sum(latency_s) / 8 AS wall, avg(latency_s) FILTER (WHERE ok) AS lm, quantile_cont(latency_s, 0.5) FILTER (WHERE ok) AS lp,
      max(latency_s) FILTER (WHERE ok) AS lx, avg(prompt_tokens) AS pm, max(prompt_tokens) AS px, avg(completion_tokens) AS cm FROM measure GROUP BY 1, 2)
    SELECT round, scenario_id, n_requests, ok_count, round(ok_count / CAST(n_requests AS DOUBLE), 6) AS ok_rate, round(wall, 4) AS wall_time_s,
     round(n_requests / wall, 6) AS throughput, round(wall / n_requests, 6) AS amortized_s, round(lm, 6) AS latency_mean, round(lp, 6) AS latency_p50,
     round(lx, 6) AS latency_max, round(pm, 6) AS prompt_mean, px AS prompt_max, round(cm, 6) AS completion_mean FROM g""",
)
def a32(spark, sf):
    out = metrics.scenario_summary(measures(spark, sf), ["round", "scenario_id"], F.sum("latency_s") / 8)
    out = out.withColumn("wall_time_s", F.round("wall_time_s", 4))
    return rounded(
        out, "ok_rate", "throughput", "amortized_s", "latency_mean", "latency_p50", "latency_max", "prompt_mean", "completion_mean"
    )


@query(
    "a33_latency_probe",
    f"""WITH {REQ}, b AS (SELECT workload_type, error IS NULL AND ttft_ms IS NOT NULL AS ok, ttft_ms FROM requests),
    s AS (SELECT workload_type, avg(ttft_ms) AS m, coalesce(stddev_samp(ttft_ms), 0) AS sd, min(ttft_ms) AS mn, max(ttft_ms) AS mx FROM b WHERE ok GROUP BY 1),
    r AS (SELECT workload_type, ttft_ms AS v, row_number() OVER (PARTITION BY workload_type ORDER BY ttft_ms) - 1 AS rn,
      count(*) OVER (PARTITION BY workload_type) AS n FROM b WHERE ok),
    p AS (SELECT r.workload_type, max(CASE WHEN rn = n // 2 THEN v END) AS p50, max(CASE WHEN rn = least(n * 90 // 100, n - 1) THEN v END) AS p90,
      max(CASE WHEN rn = least(n * 99 // 100, n - 1) THEN v END) AS p99, count(*) FILTER (WHERE v > 3 * m) AS spikes FROM r JOIN s ON r.workload_type = s.workload_type GROUP BY 1),
    c AS (SELECT workload_type, count(*) FILTER (WHERE ok) AS ok_count, count(*) FILTER (WHERE NOT ok) AS error_count FROM b GROUP BY 1)
    SELECT c.workload_type, ok_count, error_count, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p99, 6) AS p99, round(mn, 6) AS min, round(mx, 6) AS max,
     round(m, 6) AS mean, round(sd, 6) AS stdev, spikes FROM c JOIN s ON c.workload_type = s.workload_type JOIN p ON c.workload_type = p.workload_type""",
)
def a33(spark, sf):
    b = requests(spark, sf).select("workload_type", (F.col("error").isNull() & F.col("ttft_ms").isNotNull()).alias("ok"), "ttft_ms")
    return rounded(metrics.latency_probe(b, "workload_type"), "p50", "p90", "p99", "min", "max", "mean", "stdev")


@query(
    "a34_warmup_outcome",
    f"""WITH {REQ} SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS ok, count(error) AS failed,
    count(*) FILTER (WHERE ttft_ms > 3000) AS warned FROM requests WHERE k >= 90 OR is_warmup""",
)
def a34(spark, sf):
    rows = requests(spark, sf).filter("k >= 90 OR is_warmup").select(
        F.col("error").isNull().alias("ok"), F.when(F.col("ttft_ms") > 3000, F.lit("slow")).alias("warning")
    )
    return metrics.warmup_outcome(rows)


@query(
    "t01_worst_probes",
    f"WITH {REQ} SELECT request_id, workload_type, round(probe_f1, 6) AS f1, probe_em AS em FROM requests WHERE is_probe_slot ORDER BY probe_f1, request_id LIMIT 5",
)
def t01(spark, sf):
    return rounded(metrics.worst_probes(_probes(spark, sf)), "f1")


@query(
    "t03_trace_order",
    f"""WITH {REQ}, o AS (SELECT request_id, hash0 AS trace_pos FROM (SELECT request_id, row_number() OVER (ORDER BY session_id, pos) AS hash0 FROM requests WHERE k < 95))
    SELECT r.request_id, trace_pos FROM requests r LEFT JOIN o USING (request_id) ORDER BY trace_pos NULLS LAST""",
)
def t03(spark, sf):
    base = requests(spark, sf)
    order = trace.session_positions(base.filter("k < 95").select("request_id", "session_id", "pos"), "session_id", "pos", "trace_pos")
    return trace.restore_order(base.select("request_id"), order.select("request_id", "trace_pos"), "request_id", "trace_pos")


@query("t04_first_requests", f"WITH {REQ} SELECT request_id, pos FROM requests ORDER BY pos LIMIT 20")
def t04(spark, sf):
    from tracelake.operators.trace import first_rows

    return first_rows(requests(spark, sf), "pos", 20).select("request_id", "pos")


@query(
    "f05_accuracy_penalty",
    f"""WITH d AS (SELECT event_id, value / 1000 AS drop_ FROM events) SELECT event_id, round({_PENALTY}, 6) AS penalty FROM d""",
)
def f05(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(scoring.accuracy_penalty(F.col("value") / 1000)).alias("penalty"))


@query("f06_accuracy_drop", f"WITH {REQ} SELECT workload_type, round(greatest(0, 0.831 - avg(probe_f1)), 6) AS accuracy_drop FROM requests GROUP BY 1")
def f06(spark, sf):
    return requests(spark, sf).groupBy("workload_type").agg(
        r6(scoring.accuracy_drop(F.mean("probe_f1"), F.lit(scoring.BASELINE_MEAN))).alias("accuracy_drop")
    )


@query(
    "f07_score",
    f"WITH d AS (SELECT event_id, value / 1000 AS drop_, (event_id % 101) / 100.0::DOUBLE AS erc FROM events) SELECT event_id, round(100 * erc * ({_PENALTY}), 6) AS score FROM d",
)
def f07(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", r6(scoring.final_score((F.col("event_id") % 101) / F.lit(100.0), F.col("value") / 1000)).alias("score")
    )


@query("f08_ers_request_score", f"WITH {REPLAY} SELECT request_id, round({_ers_sql(100, 1500, 20, 45)}, 9) AS ers FROM replay")
def f08(spark, sf):
    r = replay(spark, sf)
    return r.select("request_id", F.round(scoring.ers_score(F.col("error"), F.col("ttft_ms"), scoring.array_mean(F.col("tbt_ms"))), 9).alias("ers"))


@query(
    "k08_sql_functions",
    f"""WITH {REQ} SELECT request_id, effective, CAST(greatest(1, round_even(input_length / 4.0, 0)) AS BIGINT) AS tokens,
     round({_PENALTY.replace('drop_', '(value / 1000)')}, 6) AS penalty,
     round(CASE WHEN error IS NOT NULL OR ttft_ms IS NULL THEN 0 ELSE 0.5 * pow(greatest(0, least(1, (1500 - ttft_ms) / 1400)), 2)
       + 0.5 * pow(greatest(0, least(1, (45 - coalesce(tbt_ms, 0)) / 25)), 2) END, 9) AS ers FROM requests""",
)
def k08(spark, sf):
    scoring.register_sql_functions(spark)
    return requests(spark, sf).selectExpr(
        "request_id", "slo_effective(ttft_ms, tbt_ms, output_tokens, 1500D, 45D) AS effective", "token_est(input_length) AS tokens",
        "round(accuracy_penalty(value / 1000), 6) AS penalty", "round(ers_score(error IS NOT NULL, ttft_ms, tbt_ms), 9) AS ers",
    )
