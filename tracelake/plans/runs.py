"""Registered queries: run comparison, tuning histories, run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import text as tx
from tracelake.functions import udfs
from tracelake.operators import compare, metrics, quantiles
from tracelake.plans.catalog import query, r6, rounded
from tracelake.plans.corpora import docs, sql_words
from tracelake.plans.fixtures import EVAL, MEASURE, QA, REQ, eval_runs, measures, qa, requests, table
from tracelake.session import scratch_dir


def _flags_sql(c):
    w = sql_words(c)
    return f"""concat_ws(',', CASE WHEN {c} = '' THEN 'empty' END, CASE WHEN length({c}) < 3 THEN 'too_short' END,
      CASE WHEN len({w}) >= 16 AND len(list_distinct({w}[-16:])) <= 3 THEN 'repeated_tail' END, CASE WHEN contains({c}, '�') THEN 'replacement_char' END)"""


_STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query("p15_bad_output_flags", f"WITH s AS (SELECT doc_id, {_STRIP.format(c='text')} AS t FROM documents) SELECT doc_id, {_flags_sql('t')} AS issues FROM s")
def p15(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(tx.bad_output_flags(F.col("text")), ",").alias("issues"))


@query(
    "j16_output_drift",
    f"""WITH {QA}, s AS (SELECT qa_id, question, answer, {_STRIP.format(c='question')} AS tq, {_STRIP.format(c='answer')} AS ta FROM qa)
    SELECT qa_id, question = answer AS exact_match, {_flags_sql('tq')} AS issues_a, {_flags_sql('ta')} AS issues_b, {_flags_sql('tq')} <> '' OR {_flags_sql('ta')} <> '' AS flagged FROM s""",
)
def j16(spark, sf):
    q = qa(spark, sf)
    out = compare.output_drift(q.select("qa_id", F.col("question").alias("t")), q.select("qa_id", F.col("answer").alias("t")), "qa_id", "t")
    return out.select("qa_id", "exact_match", F.array_join("issues_a", ",").alias("issues_a"), F.array_join("issues_b", ",").alias("issues_b"), "flagged")


@query("f09_text_ratio")
def f09(spark, sf):
    q = qa(spark, sf)
    out = compare.output_drift(q.select("qa_id", F.col("question").alias("t")), q.select("qa_id", F.col("answer").alias("t")), "qa_id", "t", 0.7)
    return rounded(out.select("qa_id", "similarity", "flagged"), "similarity")


_PLAIN = "regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g')"


@query(
    "f09_edit_similarity",
    f"""WITH {QA}, n AS (SELECT qa_id, {_PLAIN.format(c='question')} AS q, {_PLAIN.format(c='answer')} AS a FROM qa)
    SELECT qa_id, round(CASE WHEN greatest(length(q), length(a)) = 0 THEN 1 ELSE 1 - levenshtein(q, a) / CAST(greatest(length(q), length(a)) AS DOUBLE) END, 6) AS similarity FROM n""",
)
def f09_edit(spark, sf):
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")
    return qa(spark, sf).select("qa_id", r6(compare.edit_similarity(plain("question"), plain("answer"))).alias("similarity"))


@query("k02_text_ratio_udf")
def k02(spark, sf):
    udfs.register_udfs(spark)
    return qa(spark, sf).selectExpr("qa_id", "round(text_ratio(lower(question), lower(answer)), 6) AS similarity")


_AB = MEASURE + """, r AS (SELECT round, scenario_id, latency_s AS v, row_number() OVER (PARTITION BY round, scenario_id ORDER BY latency_s) - 1 AS rn, count(*) OVER (PARTITION BY round, scenario_id) AS n FROM measure WHERE ok),
 g AS (SELECT round, scenario_id, max(CASE WHEN rn = n // 2 THEN v END) AS p50, count(*) AS n FROM r GROUP BY 1, 2)"""


def _run_side(spark, sf, name):
    m = measures(spark, sf).filter((F.col("round") == name) & F.col("ok"))
    return quantiles.order_statistics(m, ["scenario_id"], "latency_s", [quantiles.upper_median("p50")])


@query(
    "j15_compare_runs",
    f"""WITH {_AB}, a AS (SELECT * FROM g WHERE round = 'round1' AND scenario_id <> 'A1'), b AS (SELECT * FROM g WHERE round = 'round2' AND scenario_id <> 'N2')
    SELECT coalesce(a.scenario_id, b.scenario_id) AS scenario_id, a.p50 AS p50_a, b.p50 AS p50_b, round((b.p50 - a.p50) / a.p50 * 100, 6) AS p50_delta,
    CASE WHEN a.p50 IS NOT NULL AND b.p50 IS NOT NULL THEN CASE WHEN b.p50 < a.p50 THEN 'B' ELSE 'A' END END AS p50_winner FROM a FULL JOIN b ON a.scenario_id = b.scenario_id""",
)
def j15(spark, sf):
    a = _run_side(spark, sf, "round1").filter("scenario_id <> 'A1'")
    b = _run_side(spark, sf, "round2").filter("scenario_id <> 'N2'")
    return rounded(compare.compare_runs(a, b, "scenario_id", {"p50": True}, "A", "B"), "p50_delta")


@query("u05_key_union", f"WITH {MEASURE} SELECT DISTINCT scenario_id FROM measure")
def u05(spark, sf):
    m = measures(spark, sf)
    return compare.key_union(m.filter("round = 'round1'"), m.filter("round = 'round2'"), "scenario_id")


_SCN = MEASURE + ", sm AS (SELECT round, scenario_id, count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE) AS ok_rate, sum(latency_s) / 8 AS wall_s, avg(latency_s) FILTER (WHERE ok) AS lat_mean FROM measure GROUP BY 1, 2)"


def _scenarios(spark, sf):
    out = metrics.scenario_summary(measures(spark, sf), ["round", "scenario_id"], F.sum("latency_s") / 8)
    return out.select("round", "scenario_id", "ok_rate", F.col("wall_time_s").alias("wall_s"), F.col("latency_mean").alias("lat_mean"))


@query("u02_union_rounds", f"WITH {_SCN} SELECT round, scenario_id, round(ok_rate, 6) AS ok_rate, CASE WHEN round = 'round2' THEN round(lat_mean, 6) END AS lat_mean FROM sm")
def u02(spark, sf):
    s = _scenarios(spark, sf)
    parts = {
        "round1": s.filter("round = 'round1'").select("scenario_id", "ok_rate"),
        "round2": s.filter("round = 'round2'").select("scenario_id", "ok_rate", "lat_mean"),
    }
    return rounded(compare.union_rounds(parts), "ok_rate", "lat_mean")


_PAIR = "SELECT scenario_id AS before_id, CASE WHEN left(scenario_id, 1) = 'A' THEN scenario_id ELSE 'N' || right(scenario_id, 1) END AS after_id FROM sm WHERE round = 'round1'"


@query(
    "j19_scenario_pairs",
    f"WITH {_SCN}, p AS ({_PAIR}) SELECT before_id, after_id, round(a.ok_rate, 6) AS ok_rate_before, round(b.ok_rate, 6) AS ok_rate_after FROM p JOIN sm a ON a.round = 'round1' AND a.scenario_id = before_id JOIN sm b ON b.round = 'round2' AND b.scenario_id = after_id",
)
def j19(spark, sf):
    return rounded(_improved(spark, sf).select("before_id", "after_id", "ok_rate_before", "ok_rate_after"), "ok_rate_before", "ok_rate_after")


def _improved(spark, sf):
    s = _scenarios(spark, sf)
    a, b = s.filter("round = 'round1'"), s.filter("round = 'round2'")
    pairs = a.select(
        F.col("scenario_id").alias("before_id"),
        F.when(F.left("scenario_id", F.lit(1)) == "A", F.col("scenario_id")).otherwise(F.concat(F.lit("N"), F.right("scenario_id", F.lit(1)))).alias("after_id"),
    )
    return compare.improvements(a, b, pairs, {"ok_rate": False, "lat_mean": True, "wall_s": True})


@query(
    "x14_improvements",
    f"""WITH {_SCN}, p AS ({_PAIR}), d AS (SELECT before_id, after_id, a.ok_rate AS o0, b.ok_rate AS o1, a.lat_mean AS l0, b.lat_mean AS l1, a.wall_s AS w0, b.wall_s AS w1
      FROM p JOIN sm a ON a.round = 'round1' AND a.scenario_id = before_id JOIN sm b ON b.round = 'round2' AND b.scenario_id = after_id)
    SELECT before_id, after_id, round(o0, 6) AS ok_rate_before, round(o1, 6) AS ok_rate_after, round(l0, 6) AS lat_mean_before, round(l1, 6) AS lat_mean_after,
     round((o1 - o0) / o0 * 100, 5) AS ok_rate_delta, o1 > o0 AS ok_rate_better, round((l1 - l0) / l0 * 100, 5) AS lat_mean_delta, l1 < l0 AS lat_mean_better,
     round((w1 - w0) / w0 * 100, 5) AS wall_s_delta, w1 < w0 AS wall_s_better FROM d""",
)
def x14(spark, sf):
    d = rounded(_improved(spark, sf).drop("wall_s_before", "wall_s_after"), "ok_rate_before", "ok_rate_after", "lat_mean_before", "lat_mean_after")
    return d.withColumns({c: F.round(c, 5) for c in ("ok_rate_delta", "lat_mean_delta", "wall_s_delta")})


# A return flag is a setup, the line number the level of concurrency.
_SWEEP = MEASURE + """, sw AS (SELECT round, left(scenario_id, 1) AS setup, CAST(right(scenario_id, 1) AS BIGINT) AS ccu, count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE) AS ok_rate,
  sum(latency_s) / CAST(right(scenario_id, 1) AS BIGINT) AS wall_s, avg(latency_s) FILTER (WHERE ok) AS lat_mean, count(*) FILTER (WHERE ok) AS n_ok FROM measure GROUP BY 1, 2, 3, scenario_id),
  levels AS (SELECT *, n_ok / wall_s AS docs_per_s FROM sw)"""


def _levels(spark, sf):
    m = measures(spark, sf).select(
        "*", F.left("scenario_id", F.lit(1)).alias("setup"), F.right("scenario_id", F.lit(1)).cast("long").alias("ccu")
    )
    out = metrics.scenario_summary(m, ["round", "setup", "ccu"], F.sum("latency_s") / F.col("ccu"))
    wall = F.col("wall_time_s")
    return out.select(
        "round", "setup", "ccu", "ok_rate", wall.alias("wall_s"), F.col("latency_mean").alias("lat_mean"), (F.col("ok_count") / wall).alias("docs_per_s")
    )


@query(
    "x14_concurrency_sweep",
    f"""WITH {_SWEEP} SELECT l.round, l.setup, l.ccu, round(l.ok_rate, 6) AS ok_rate, round(l.wall_s, 4) AS wall_s, round(l.lat_mean, 6) AS lat_mean, round(l.docs_per_s, 6) AS docs_per_s,
    round((l.wall_s - b.wall_s) / b.wall_s * 100, 5) AS wall_s_vs_serial, l.wall_s < b.wall_s AS wall_s_better,
    round((l.docs_per_s - b.docs_per_s) / b.docs_per_s * 100, 5) AS docs_per_s_vs_serial, l.docs_per_s > b.docs_per_s AS docs_per_s_better
    FROM levels l JOIN levels b ON b.round = l.round AND b.setup = l.setup AND b.ccu = 1 WHERE l.ccu > 1""",
)
def x14_sweep(spark, sf):
    out = compare.concurrency_sweep(_levels(spark, sf), ["round", "setup"], "ccu", {"wall_s": True, "docs_per_s": False})
    out = rounded(out, "ok_rate", "lat_mean", "docs_per_s").withColumn("wall_s", F.round("wall_s", 4))
    return out.withColumns({c: F.round(c, 5) for c in ("wall_s_vs_serial", "docs_per_s_vs_serial")})


@query(
    "x14_setting_sweep",
    f"""WITH {_SWEEP} SELECT a.ccu, round(a.lat_mean, 6) AS lat_mean_before, round(b.lat_mean, 6) AS lat_mean_after, round(a.wall_s, 4) AS wall_s_before, round(b.wall_s, 4) AS wall_s_after,
    round((b.lat_mean - a.lat_mean) / a.lat_mean * 100, 5) AS lat_mean_delta, b.lat_mean < a.lat_mean AS lat_mean_better,
    round((b.wall_s - a.wall_s) / a.wall_s * 100, 5) AS wall_s_delta, b.wall_s < a.wall_s AS wall_s_better
    FROM levels a JOIN levels b ON b.ccu = a.ccu AND a.round = 'round2' AND b.round = 'round2' AND a.setup = 'A' AND b.setup = 'R'""",
)
def x14_setting(spark, sf):
    levels = _levels(spark, sf).filter("round = 'round2'")
    out = compare.setting_sweep(levels.filter("setup = 'A'"), levels.filter("setup = 'R'"), "ccu", {"lat_mean": True, "wall_s": True})
    out = rounded(out, "lat_mean_before", "lat_mean_after")
    return out.withColumns({"wall_s_before": F.round("wall_s_before", 4), "wall_s_after": F.round("wall_s_after", 4), **{c: F.round(c, 5) for c in ("lat_mean_delta", "wall_s_delta")}})


@query(
    "w13_scenario_deltas",
    f"""WITH {_SCN}, b AS (SELECT round, lat_mean AS l0, ok_rate AS o0 FROM sm WHERE scenario_id = 'A1')
    SELECT sm.round, scenario_id, round((lat_mean - l0) / l0 * 100, 5) AS lat_mean_delta, lat_mean < l0 AS lat_mean_better, round((ok_rate - o0) / o0 * 100, 5) AS ok_rate_delta, ok_rate > o0 AS ok_rate_better
    FROM sm JOIN b ON b.round = sm.round""",
)
def w13(spark, sf):
    out = compare.scenario_deltas(_scenarios(spark, sf), ["round"], F.col("scenario_id") == "A1", {"lat_mean": True, "ok_rate": False})
    return out.select(
        "round", "scenario_id", F.round("lat_mean_delta", 5).alias("lat_mean_delta"), "lat_mean_better", F.round("ok_rate_delta", 5).alias("ok_rate_delta"), "ok_rate_better"
    )


@query(
    "w15_repeat_spikes",
    f"""WITH {REQ}, s AS (SELECT workload_type AS run, pos, 'shape_' || session_id AS shape_key, value AS v FROM requests),
    f AS (SELECT *, row_number() OVER w AS rn, first(v) OVER w AS fv FROM s WINDOW w AS (PARTITION BY run, shape_key ORDER BY pos))
    SELECT run, pos, shape_key, fv AS first_value, v AS repeat_value, round(fv / v, 5) AS ratio FROM f WHERE rn > 1 AND fv > 0 AND v > 0 AND fv > v * 2.5::DOUBLE""",
)
def w15(spark, sf):
    d = requests(spark, sf).select(
        F.col("workload_type").alias("run"), "pos", "value",
        F.concat(F.lit("shape_"), F.col("session_id").cast("string"), F.when(F.col("pos") % 2 == 0, "_repeat").otherwise("_single")).alias("shape"),
    )
    return compare.repeat_spikes(d, "run", "shape", "pos", "value").withColumn("ratio", F.round("ratio", 5))


# Tuning


@query("f22_composite_score", f"WITH {EVAL} SELECT run_id, iteration, round(composite, 6) AS composite FROM eval_run")
def f22(spark, sf):
    return rounded(eval_runs(spark, sf).select("run_id", "iteration", "composite"), "composite")


@query(
    "a44_best_iteration",
    f"WITH {EVAL} SELECT run_id, iteration AS best_iteration, round(composite, 6) AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY composite DESC, iteration) AS r FROM eval_run) WHERE r = 1",
)
def a44(spark, sf):
    return rounded(compare.best_iteration(eval_runs(spark, sf), "run_id"), "best_score")


_STOP = """st AS (SELECT *, composite >= 0.6 AND coverage >= 0.5 AS done FROM eval_run),
 fs AS (SELECT run_id, iteration AS stop_iteration, CASE WHEN done THEN 'threshold' ELSE 'max_iterations' END AS stop_reason FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iteration) AS r FROM st WHERE done OR iteration >= 5) WHERE r = 1)"""


@query("p18_first_stop", f"WITH {EVAL}, {_STOP} SELECT * FROM fs")
def p18(spark, sf):
    return compare.first_stop(eval_runs(spark, sf), "run_id", 0.6, 0.5, 5)


@query(
    "w14_running_best",
    f"WITH {EVAL} SELECT run_id, iteration, round(max(composite) OVER (PARTITION BY run_id ORDER BY iteration), 6) AS best_so_far FROM eval_run",
)
def w14(spark, sf):
    return rounded(compare.running_best(eval_runs(spark, sf), "run_id").select("run_id", "iteration", "best_so_far"), "best_so_far")


@query(
    "x13_tuning_report",
    f"""WITH {EVAL}, {_STOP}, b AS (SELECT run_id, iteration AS best_iteration, composite AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY composite DESC, iteration) AS r FROM eval_run) WHERE r = 1),
    g AS (SELECT run_id, count(*) AS iterations, arg_max(coverage, iteration) AS last_coverage, arg_max(composite, iteration) - arg_min(composite, iteration) AS trend FROM eval_run GROUP BY 1)
    SELECT g.run_id, iterations, round(last_coverage, 6) AS last_coverage, round(trend, 6) AS trend, best_iteration, round(best_score, 6) AS best_score, stop_iteration, stop_reason
    FROM g LEFT JOIN b ON b.run_id = g.run_id LEFT JOIN fs ON fs.run_id = g.run_id""",
)
def x13(spark, sf):
    return rounded(compare.tuning_report(eval_runs(spark, sf), "run_id", 0.6, 0.5, 5), "last_coverage", "trend", "best_score")


# Run logs

_RUN = """run AS (SELECT o_orderkey, 'swm/' || split_part(o_orderpriority, '-', 2) || '-v1' AS env_name, lower(split_part(o_orderpriority, '-', 2)) AS env, o_orderkey % 7 AS seed,
   CAST(o_custkey % 100 AS DOUBLE) AS success_rate, 8 AS num_eval, list_transform(range(0, 8), lambda i: (o_custkey // CAST(pow(2, i) AS BIGINT)) % 2 = 1) AS succ,
   25 + o_orderkey % 3 AS eval_budget, CAST(100 + o_orderkey % 400 AS DOUBLE) AS wall FROM orders)"""


def run_log(spark, sf):
    """Run logs written as text files and read back one block per record."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    flags = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(cust.bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0, "True").otherwise("False")), ",\n       ")
    lines = F.concat_ws(
        "\n",
        F.lit("\n==== CONFIG ===="),
        F.concat(F.lit("seed: "), (k % 7).cast("string")),
        F.lit("policy: base/model"),
        F.lit("world:"),
        F.concat(F.lit("  env_name: swm/"), F.substring_index("o_orderpriority", "-", -1), F.lit("-v1")),
        F.lit("  num_eval: 8"),
        F.concat(F.lit("  eval_budget: "), (25 + k % 3).cast("string")),
        F.lit("  horizon: 5\n\n==== RESULTS ===="),
        F.concat(F.lit("metrics: {'success_rate': "), (cust % 100).cast("string"), F.lit(".0, 'episode_successes': array(["), flags, F.lit("])}")),
        F.concat(F.lit("evaluation_time: "), (100 + k % 400).cast("string"), F.lit(".0 seconds")),
    )
    from tracelake.sources.readers import read_run_blocks

    path = scratch_dir(spark, "run-log")
    table(spark, sf, "orders").select(lines.alias("value")).write.text(path)
    return read_run_blocks(spark, path)


@query(
    "x16_parse_runs",
    f"WITH {_RUN} SELECT env, seed, success_rate, num_eval, len(list_filter(succ, lambda x: x)) AS num_successes, eval_budget, wall AS wall_clock_time_sec, round(wall / (num_eval * eval_budget), 6) AS planning_time_per_step FROM run",
)
def x16(spark, sf):
    out = compare.parse_runs(run_log(spark, sf), "value")
    return rounded(
        out.select("env", "seed", "success_rate", "num_eval", "num_successes", "eval_budget", "wall_clock_time_sec", "planning_time_per_step"), "planning_time_per_step"
    )


@query("s06_run_log_blocks", "SELECT count(*) AS blocks, count(DISTINCT o_orderpriority) AS envs FROM orders")
def s06(spark, sf):
    b = run_log(spark, sf)
    return b.agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct(F.regexp_extract("value", r"env_name: (\S+.*)", 1)).alias("envs"))


@query("f28_environment_slug", f"WITH {_RUN} SELECT o_orderkey, env FROM run")
def f28(spark, sf):
    name = F.concat(F.lit("swm/"), F.substring_index("o_orderpriority", "-", -1), F.lit("-v1"))
    return table(spark, sf, "orders").select("o_orderkey", tx.environment_slug(name).alias("env"))


@query(
    "a35_seed_rollup",
    f"""WITH {_RUN} SELECT env, count(*) AS n_runs, round(avg(success_rate), 6) AS mean_success_rate, min(success_rate) AS min_success_rate, max(success_rate) AS max_success_rate,
    string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds FROM run GROUP BY 1""",
)
def a35(spark, sf):
    out = compare.seed_rollup(compare.parse_runs(run_log(spark, sf), "value"), "env")
    return rounded(out.withColumn("seeds", F.array_join(F.col("seeds").cast("array<string>"), ",")), "mean_success_rate")
