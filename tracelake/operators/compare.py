"""Comparing runs, outputs and tuning iterations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scoring import percent_delta
from tracelake.functions.text import environment_slug, normalize_text, words
from tracelake.operators.ordered import null_safe_join, ordered_scan, position_chunk


def token_f1(df: DataFrame, key: str, prediction: str, reference: str) -> DataFrame:
    """Multiset token F1 and exact match per row, by counting tokens of both sides.

    Tokens are counted per (row, token) with map-side combining, so long texts never sit in one group.
    """
    p, r = normalize_text(F.col(prediction)), normalize_text(F.col(reference))
    side = lambda n, a, b: F.transform(words(n), lambda t: F.struct(t.alias("t"), F.lit(a).alias("p"), F.lit(b).alias("r")))
    tokens = df.select(key, F.inline(F.concat(side(p, 1, 0), side(r, 0, 1))))
    counts = tokens.groupBy(key, "t").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    hits = counts.groupBy(key).agg(
        F.sum(F.least("p", "r")).alias("hits"), F.sum("p").alias("np"), F.sum("r").alias("nr")
    )
    exact = df.select(key, (p == r).cast("double").alias("em"))
    f1 = (
        F.when((F.coalesce("np", F.lit(0)) == 0) & (F.coalesce("nr", F.lit(0)) == 0), F.lit(1.0))
        .when(F.coalesce("hits", F.lit(0)) == 0, F.lit(0.0))
        .otherwise(2.0 * F.col("hits") / (F.col("np") + F.col("nr")))
    )
    return exact.join(hits, key, "left").select(key, f1.alias("f1"), "em")


def output_drift(a: DataFrame, b: DataFrame, key: str, text: str, min_similarity: float | None = None) -> DataFrame:
    """Paired outputs of two runs: equality, issue flags and, when a threshold is given, similarity."""
    from tracelake.functions.text import bad_output_flags
    from tracelake.functions.udfs import text_ratio

    d = a.select(key, F.col(text).alias("__a")).join(b.select(key, F.col(text).alias("__b")), key)
    out = d.select(
        key, (F.col("__a") == F.col("__b")).alias("exact_match"),
        bad_output_flags(F.col("__a")).alias("issues_a"), bad_output_flags(F.col("__b")).alias("issues_b"),
        normalize_text(F.col("__a")).alias("__na"), normalize_text(F.col("__b")).alias("__nb"),
    )
    bad = (F.size("issues_a") > 0) | (F.size("issues_b") > 0)
    if min_similarity is None:
        return out.drop("__na", "__nb").withColumn("flagged", bad)
    out = out.withColumn("similarity", text_ratio("__na", "__nb")).drop("__na", "__nb")
    return out.withColumn("flagged", bad | (F.col("similarity") < min_similarity))


def edit_similarity(a: Column, b: Column) -> Column:
    """Similarity from the edit distance; stays in the JVM and differs from the matching-blocks ratio."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def compare_runs(a: DataFrame, b: DataFrame, key: str, metrics: dict[str, bool], label_a: str, label_b: str) -> DataFrame:
    """Full comparison of two aggregates by key: both values, change in percent and winner per metric.

    ``metrics`` maps a metric to whether lower is better; keys of either side are kept.
    """
    left = a.select(key, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(key, *[F.col(m).alias(f"{m}_b") for m in metrics])
    d = left.join(right, key, "full_outer")
    for m, lower in metrics.items():
        x, y = F.col(f"{m}_a"), F.col(f"{m}_b")
        better = (y < x) if lower else (y > x)
        d = d.withColumns(
            {
                f"{m}_delta": percent_delta(y, x),
                f"{m}_winner": F.when(x.isNotNull() & y.isNotNull(), F.when(better, label_b).otherwise(label_a)),
            }
        )
    return d


def scenario_deltas(df: DataFrame, keys: Sequence[str], is_baseline: Column, metrics: dict[str, bool]) -> DataFrame:
    """Change of every row against the baseline row of its group, with a better/worse flag."""
    base = df.filter(is_baseline).select(*keys, *[F.col(m).alias(f"__{m}") for m in metrics])
    d = df.join(base, list(keys), "left")
    for m, lower in metrics.items():
        delta = percent_delta(F.col(m), F.col(f"__{m}"))
        better = (delta < 0) if lower else (delta > 0)
        d = d.withColumns({f"{m}_delta": delta, f"{m}_better": better}).drop(f"__{m}")
    return d


def improvements(before: DataFrame, after: DataFrame, pairs: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """Deltas of comparable scenarios of two rounds; ``pairs`` maps before_id to after_id."""
    x = before.select(F.col("scenario_id").alias("before_id"), *[F.col(m).alias(f"{m}_before") for m in metrics])
    y = after.select(F.col("scenario_id").alias("after_id"), *[F.col(m).alias(f"{m}_after") for m in metrics])
    d = pairs.join(x, "before_id").join(y, "after_id")
    for m, lower in metrics.items():
        delta = percent_delta(F.col(f"{m}_after"), F.col(f"{m}_before"))
        d = d.withColumns({f"{m}_delta": delta, f"{m}_better": (delta < 0) if lower else (delta > 0)})
    return d


def concurrency_sweep(scenarios: DataFrame, keys: Sequence[str], level: str, metrics: dict[str, bool], serial: int = 1) -> DataFrame:
    """Every concurrency level above ``serial`` with its change against the serial run of its group; groups without one are left out."""
    base = scenarios.filter(F.col(level) == serial).select(*keys, *[F.col(m).alias(f"__{m}") for m in metrics])
    d = null_safe_join(scenarios.filter(F.col(level) > serial), base, keys)
    for m, lower in metrics.items():
        delta = percent_delta(F.col(m), F.col(f"__{m}"))
        d = d.withColumns({f"{m}_vs_serial": delta, f"{m}_better": (delta < 0) if lower else (delta > 0)}).drop(f"__{m}")
    return d


def setting_sweep(plain: DataFrame, changed: DataFrame, level: str, metrics: dict[str, bool]) -> DataFrame:
    """Two setups side by side at each concurrency level that both ran."""
    left = plain.select(level, *[F.col(m).alias(f"{m}_before") for m in metrics])
    d = left.join(changed.select(level, *[F.col(m).alias(f"{m}_after") for m in metrics]), level)
    for m, lower in metrics.items():
        delta = percent_delta(F.col(f"{m}_after"), F.col(f"{m}_before"))
        d = d.withColumns({f"{m}_delta": delta, f"{m}_better": (delta < 0) if lower else (delta > 0)})
    return d


def union_rounds(rounds: dict[str, DataFrame]) -> DataFrame:
    """All scenario tables with their round; columns missing in a round are null."""
    out = None
    for name, df in rounds.items():
        part = df.withColumn("round", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def repeat_spikes(df: DataFrame, run: str, shape: str, pos: str, value: str, factor: float = 2.5) -> DataFrame:
    """Repeats whose first occurrence of the same shape was over ``factor`` times slower."""
    base = F.replace(F.replace(F.col(shape), F.lit("_repeat"), F.lit("")), F.lit("_single"), F.lit(""))
    d = ordered_scan(
        df.withColumn("shape_key", base), [run, "shape_key"], [pos], position_chunk(F.col(pos)),
        rank="__r", firsts={"first_value": F.col(value)},
    )
    v = F.col(value)
    hit = (F.col("__r") > 1) & (F.col("first_value") > 0) & (v > 0) & (F.col("first_value") > v * factor)
    return d.filter(hit).select(run, pos, "shape_key", "first_value", v.alias("repeat_value"), (F.col("first_value") / v).alias("ratio"))


# Tuning runs


def best_iteration(df: DataFrame, run: str) -> DataFrame:
    """First iteration with the highest composite score."""
    at = F.struct(F.col("composite"), (-F.col("iteration")).alias("o"))
    return df.groupBy(run).agg(F.max_by("iteration", at).alias("best_iteration"), F.max("composite").alias("best_score"))


def stop_decision(df: DataFrame, threshold: float, coverage_min: float, max_iterations: int) -> DataFrame:
    done = (F.col("composite") >= threshold) & (F.col("coverage") >= coverage_min)
    return df.withColumns(
        {
            "stop": done | (F.col("iteration") >= max_iterations),
            "reason": F.when(done, "threshold").when(F.col("iteration") >= max_iterations, "max_iterations"),
        }
    )


def first_stop(df: DataFrame, run: str, threshold: float, coverage_min: float, max_iterations: int) -> DataFrame:
    """First stopping iteration of each run and why."""
    d = stop_decision(df, threshold, coverage_min, max_iterations).filter("stop")
    return d.groupBy(run).agg(F.min("iteration").alias("stop_iteration"), F.min_by("reason", "iteration").alias("stop_reason"))


def running_best(df: DataFrame, run: str) -> DataFrame:
    return ordered_scan(df, [run], ["iteration"], position_chunk(F.col("iteration")), maxes={"best_so_far": F.col("composite")})


def tuning_report(df: DataFrame, run: str, threshold: float, coverage_min: float, max_iterations: int) -> DataFrame:
    """One row per run: iterations, best, first stop, last coverage and change from first to last score."""
    base = df.groupBy(run).agg(
        F.count(F.lit(1)).alias("iterations"), F.max_by("coverage", "iteration").alias("last_coverage"),
        (F.max_by("composite", "iteration") - F.min_by("composite", "iteration")).alias("trend"),
    )
    out = base.join(best_iteration(df, run), run, "left")
    return out.join(first_stop(df, run, threshold, coverage_min, max_iterations), run, "left")


# Run logs

# Separators of a run log.
CONFIG_MARK, RESULTS_MARK = "\n==== CONFIG ====\n", "\n==== RESULTS ====\n"


def parse_runs(blocks: DataFrame, block: str) -> DataFrame:
    """One row per log block (text after a CONFIG mark) that reports a success rate."""
    text = F.col(block)
    config = F.substring_index(text, RESULTS_MARK, 1)
    results = F.when(F.contains(text, F.lit(RESULTS_MARK)), F.substring(text, F.length(config) + 1 + len(RESULTS_MARK), F.length(text)))

    def setting(name: str) -> Column:
        return F.element_at(F.nullif(F.regexp_extract_all(config, F.lit(rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$")), F.array().cast("array<string>")), -1)

    d = blocks.select("*", config.alias("__c"), results.alias("__r"))
    rate = F.regexp_extract("__r", r"'success_rate':\s*([0-9.]+)", 1)
    episodes = F.regexp_extract("__r", r"(?s)'episode_successes':\s*array\(\[(.*?)\]\)", 1)
    flags = F.transform(F.filter(F.split(episodes, ","), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" "))) != ""), lambda x: F.regexp_replace(x, r"\s", "") == "True")
    seconds = F.nullif(F.regexp_extract("__r", r"evaluation_time:\s*([0-9.]+)\s*seconds", 1), F.lit(""))
    out = d.select(
        setting("  env_name").alias("env_name"), setting("policy").alias("checkpoint"), setting("seed").cast("long").alias("seed"),
        setting("  num_eval").cast("long").alias("num_eval"), setting("  goal_offset_steps").cast("long").alias("goal_offset_steps"),
        setting("  eval_budget").cast("long").alias("eval_budget"), setting("  dataset_name").alias("dataset_name"),
        setting("  horizon").cast("long").alias("horizon"), setting("  num_samples").cast("long").alias("candidates"),
        setting("  n_steps").cast("long").alias("n_steps"), setting("  topk").cast("long").alias("topk"),
        F.nullif(rate, F.lit("")).cast("double").alias("success_rate"), flags.alias("episode_successes"),
        seconds.cast("double").alias("wall_clock_time_sec"),
    ).filter(F.col("success_rate").isNotNull())
    n = F.when(F.coalesce("num_eval", F.lit(0)) > 0, F.col("num_eval")).otherwise(F.size("episode_successes"))
    out = out.withColumns({"num_eval": n.cast("long"), "num_successes": F.size(F.filter("episode_successes", lambda x: x)).cast("long")})
    steps = F.col("num_eval") * F.col("eval_budget")
    return out.withColumns(
        {
            "planning_time_per_step": F.when((F.col("wall_clock_time_sec") > 0) & (steps > 0), F.col("wall_clock_time_sec") / steps),
            "env": environment_slug(F.col("env_name")),
        }
    )


def seed_rollup(runs: DataFrame, env: str) -> DataFrame:
    """Runs, success-rate statistics and the distinct seeds per environment."""
    per_seed = runs.groupBy(env, "seed").agg(
        F.count(F.lit(1)).alias("c"), F.sum("success_rate").alias("s"), F.min("success_rate").alias("lo"), F.max("success_rate").alias("hi")
    )
    return per_seed.groupBy(env).agg(
        F.sum("c").alias("n_runs"), (F.sum("s") / F.sum("c")).alias("mean_success_rate"), F.min("lo").alias("min_success_rate"),
        F.max("hi").alias("max_success_rate"), F.array_sort(F.collect_list("seed")).alias("seeds"),
    )
