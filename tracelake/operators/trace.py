"""Building, retiming and checking request traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as tx
from tracelake.operators.ordered import (
    digest_chunk,
    even_chunk,
    null_safe_join,
    ordered_scan,
    position_chunk,
    shuffle_key,
)
from tracelake.operators.quantiles import histogram, linear, order_statistics
from tracelake.session import stage

# Per-workload caps of input and output tokens, by length profile.
LENGTH_CAPS = {
    "compact": [("conversation", 1200, 850), ("tool_agent", 5500, 256), ("long_context", 6500, 512)],
    "realistic": [("conversation", 1200, 850), ("tool_agent", 18400, 220), ("long_context", 25000, 1800)],
}
MIN_TOKENS, LONG_CONTEXT_CHARS = 16, 80_000
LENGTH_EDGES = [500, 2000, 8000, 12000, 18000, 25000, 100000]
NEW_SESSION_MS, NO_SESSION_MS = 50, 30
SESSION_SIZE = 6


def restore_order(df: DataFrame, order: DataFrame, key: str, pos: str) -> DataFrame:
    """Sort rows into trace order; rows outside the trace come last."""
    return df.join(order.select(key, pos), key, "left").orderBy(F.col(pos).asc_nulls_last())


def session_positions(df: DataFrame, session: str, pos: str, name: str) -> DataFrame:
    """1-based position of each row when sessions (whole numbers) follow one another, each in its own order.

    Positions inside a session come from one scan, starts of sessions from a scan over their sizes, so neither a
    large session nor the number of sessions gathers in one task.
    """
    inside = ordered_scan(df, [session], [pos], position_chunk(F.col(pos)), rank="__r")
    sizes = df.groupBy(session).agg(F.count(F.lit(1)).alias("__n"))
    starts = ordered_scan(sizes, [], [session], even_chunk(sizes, F.col(session)), sums={"__end": F.col("__n")})
    starts = starts.select(session, (F.col("__end") - F.col("__n")).alias("__start"))
    placed = null_safe_join(inside, starts, [session])
    return placed.select(*df.columns, (F.col("__start") + F.col("__r")).alias(name))


def first_rows(df: DataFrame, pos: str, n: int) -> DataFrame:
    return df.orderBy(pos).limit(n)


def first_per_group(df: DataFrame, keys: Sequence[str], pos: str, n: int) -> DataFrame:
    """First ``n`` rows of each group; the rank limit is applied before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    return df.withColumn("__rn", rn).filter(F.col("__rn") <= n).drop("__rn")


# Prompts


def prompt_with_instruction(context: Column, instruction: Column) -> Column:
    return tx.strip(F.concat(F.coalesce(context, F.lit("")), F.lit("\n\n"), F.coalesce(instruction, F.lit(""))))


def prompt_with_question(context: Column, question: Column) -> Column:
    return tx.strip(
        F.concat(F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")))
    )


def context_task(context: Column) -> Column:
    return F.when(F.length(context) > LONG_CONTEXT_CHARS, "longdep_qa").otherwise("shortdep_qa")


def token_band(df: DataFrame, prompt: str, cap: int) -> DataFrame:
    """Rows whose prompt has 16 to ``cap`` estimated tokens."""
    return df.filter(tx.token_estimate(F.length(prompt)).between(MIN_TOKENS, cap))


def tag_union(parts: dict[str, DataFrame], tag: str = "task") -> DataFrame:
    """All rows of several pools with the pool's name."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


# Budgets


def length_caps(spark, profile: str) -> DataFrame:
    return spark.createDataFrame(LENGTH_CAPS[profile], "workload_type string, cap_in long, cap_out long")


def clamp_lengths(df: DataFrame, profile: str, max_context: int, safety: int) -> DataFrame:
    """Fit (input_length, output_length) under the workload caps and the context budget."""
    caps = LENGTH_CAPS[profile]
    pick = lambda i: F.coalesce(*[F.when(F.col("workload_type") == c[0], F.lit(c[i])) for c in caps])
    budget = F.lit(max_context - safety)
    n_in = F.least(F.col("input_length"), pick(1), budget - MIN_TOKENS)
    n_out = F.least(F.col("output_length"), pick(2), budget - n_in)
    n_in = F.least(n_in, budget - n_out)
    floor = F.lit(MIN_TOKENS)
    return df.withColumns(
        {"input_fit": F.greatest(floor, n_in).cast("long"), "output_fit": F.greatest(floor, n_out).cast("long")}
    )


def over_budget(df: DataFrame, max_context: int, safety: int) -> DataFrame:
    """Rows whose input plus output exceeds the context budget."""
    return df.filter(F.col("input_length") + F.col("output_length") > max_context - safety)


def require_budget(df: DataFrame, max_context: int, safety: int) -> DataFrame:
    """The same rows, failing the job at the first one over budget."""
    ok = F.col("input_length") + F.col("output_length") <= max_context - safety
    return df.filter(F.assert_true(ok, F.concat(F.lit("context budget exceeded by "), "request_id")).isNull())


def flag_warmup(df: DataFrame, keys: Sequence[str], pos: str, ratio: float) -> DataFrame:
    """Flag the first ``max(1, round(n*ratio))`` rows of each trace by position."""
    ranked = ordered_scan(df, keys, [pos], position_chunk(F.col(pos)), rank="__rank", total="__n")
    limit = F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(float(ratio))))
    return ranked.withColumn("is_warmup", F.col("__rank") <= limit).drop("__rank", "__n")


# Arrival times


def consecutive_gaps(df: DataFrame, keys: Sequence[str], pos: str, ts: str, chunk: Column | None = None) -> DataFrame:
    """``gap`` to the previous row of the trace, null on the first."""
    chunk = position_chunk(F.col(pos)) if chunk is None else chunk
    out = ordered_scan(df, keys, [pos], chunk, lags={"__prev": F.col(ts)})
    return out.withColumn("gap", F.col(ts) - F.col("__prev")).drop("__prev")


def arrival_statistics(df: DataFrame, key: str, pos: str, ts: str) -> DataFrame:
    """Span, gap statistics and simultaneous starts per trace."""
    gaps = consecutive_gaps(df.select(key, pos, ts), [key], pos, ts)
    stats = order_statistics(gaps, [key], "gap", [linear("gap_p50", 50), linear("gap_p95", 95)]).select(
        key, F.col("min").alias("gap_min"), F.col("mean").alias("gap_mean"), "gap_p50", "gap_p95"
    )
    starts = df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("c"), F.min(pos).alias("p0"), F.max(pos).alias("p1"))
    base = starts.groupBy(key).agg(
        F.sum("c").alias("n_requests"), (F.max_by(ts, "p1") - F.min_by(ts, "p0")).alias("span_ms"),
        F.max("c").alias("max_at_one_ts"), F.count(F.lit(1)).alias("unique_ts"),
    )
    base = base.withColumn("pct_batched", 100.0 * (F.col("n_requests") - F.col("unique_ts")) / F.col("n_requests"))
    return null_safe_join(base, stats, [key], "left")


def retime(df: DataFrame, keys: Sequence[str], pos: str, gap: str) -> DataFrame:
    """``new_ts``: running sum of the gap column, 0 on the first row."""
    out = ordered_scan(
        df, keys, [pos], position_chunk(F.col(pos)), sums={"__sum": F.col(gap)}, firsts={"__first": F.col(gap)}
    )
    return out.withColumn("new_ts", F.col("__sum") - F.coalesce("__first", F.lit(0))).drop("__sum", "__first")


def retime_clustered(
    df: DataFrame, keys: Sequence[str], pos: str, session: str, same: Column, other: Column, none: Column
) -> DataFrame:
    """Retime with a gap that depends on the previous row's session: same, different, or this row has none."""
    s = F.col(session)
    d = ordered_scan(df, keys, [pos], position_chunk(F.col(pos)), lags={"__prev": s})
    step = (
        F.when(F.col("__prev").isNull(), F.lit(0)).when(s.isNull(), none).when(s == F.col("__prev"), same).otherwise(other)
    )
    d = d.withColumn("__step", step)
    return ordered_scan(d, keys, [pos], position_chunk(F.col(pos)), sums={"new_ts": F.col("__step")}).drop("__prev", "__step")


def retime_same_session(df: DataFrame, keys: Sequence[str], pos: str, session: str) -> DataFrame:
    """Every request of a session starts with its first one; 50 ms per new session, 30 ms without one."""
    s = F.col(session)
    chunk = position_chunk(F.col(pos))
    d = ordered_scan(df, keys, [pos], chunk, lags={"__prev": s})
    step = F.when(s.isNull(), NO_SESSION_MS).when(s.eqNullSafe(F.col("__prev")), 0).otherwise(NEW_SESSION_MS)
    d = ordered_scan(d.withColumn("__step", step), keys, [pos], chunk, sums={"__ts": F.col("__step")})
    inside = ordered_scan(d.filter(s.isNotNull()), [*keys, session], [pos], chunk, firsts={"new_ts": F.col("__ts")})
    outside = d.filter(s.isNull()).withColumn("new_ts", F.col("__ts"))
    return inside.unionByName(outside).drop("__prev", "__step", "__ts")


# Sessions


def session_position(df: DataFrame, session: Sequence[str], pos: str) -> DataFrame:
    """0-based question index of each request within its session."""
    return ordered_scan(df, list(session), [pos], position_chunk(F.col(pos)), rank="__r").withColumn(
        "q_idx", F.col("__r") - 1
    ).drop("__r")


def fixed_sessions(df: DataFrame, keys: Sequence[str], pos: str, size: int) -> DataFrame:
    """Consecutive requests in sessions of ``size``."""
    d = ordered_scan(df, keys, [pos], position_chunk(F.col(pos)), rank="__r")
    no = F.floor((F.col("__r") - 1) / size)
    return d.withColumn("cache_session_id", F.format_string("sess-%04d", no)).drop("__r")


def sized_sessions(df: DataFrame, pos: str, sizes: DataFrame, number: str, size: str) -> DataFrame:
    """Consecutive requests in sessions whose sizes are given as data, in order of ``number``; surplus requests get none.

    Session starts are merged into the request sequence and carried forward, so no range join is made.
    """
    starts = ordered_scan(sizes, [], [number], position_chunk(F.col(number)), sums={"__end": F.col(size)})
    starts = starts.select(
        (F.col("__end") - F.col(size)).alias("__at"), F.lit(0).alias("__kind"), F.col(number).alias("__sess"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields],
    )
    ranked = ordered_scan(df, [], [pos], position_chunk(F.col(pos)), rank="__r")
    rows = ranked.select(
        (F.col("__r") - 1).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__sess"), *df.columns
    )
    merged = ordered_scan(
        starts.unionByName(rows), [], ["__at", "__kind", "__sess"], position_chunk(F.col("__at")), lasts={"__no": F.col("__sess")}
    )
    room = sizes.agg(F.coalesce(F.sum(size), F.lit(0))).scalar()
    name = F.when(F.col("__at") < room, F.format_string("sess-%04d", F.col("__no")))
    return merged.filter("__kind = 1").select(*df.columns, name.alias("cache_session_id"))


def cold_sessions(df: DataFrame, pos: str) -> DataFrame:
    """One session per request."""
    return df.withColumn("cache_session_id", F.format_string("cold-%05d", F.col(pos)))


def session_order(df: DataFrame, pos: str, session: str, seed: int) -> DataFrame:
    """Sort key (slot, kind, rn): sessions in shuffled order, one request without a session after each."""
    s = F.col(session)
    inside = session_position(df.filter(s.isNotNull()), [session], pos).withColumnRenamed("q_idx", "rn")
    slots = df.filter(s.isNotNull()).select(session).distinct().withColumn("__d", shuffle_key(s, seed))
    slots = ordered_scan(slots, [], ["__d", session], digest_chunk(F.col("__d")), rank="__slot")
    inside = inside.join(slots.select(session, (F.col("__slot") - 1).alias("slot")), session)
    outside = ordered_scan(df.filter(s.isNull()), [], [pos], position_chunk(F.col(pos)), rank="__slot")
    cols = df.columns
    return inside.select(*cols, "slot", F.lit(0).alias("kind"), "rn").unionByName(
        outside.select(*cols, (F.col("__slot") - 1).alias("slot"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("rn"))
    )


# Allocation and sampling


def allocate_mix(mix: DataFrame, name: str, share: str, total: int) -> DataFrame:
    """Counts per workload: rounded shares, the remainder handed out cyclically from the largest share.

    ``mix`` is the small table of shares, one row per workload.
    """
    base = mix.select(name, share, F.bround(F.col(share) * F.lit(total)).cast("long").alias("__b"))
    w = Window.orderBy(F.desc(share), name)
    everything = Window.partitionBy()
    d = base.withColumns(
        {
            "__rank": F.row_number().over(w) - 1, "__k": F.count(F.lit(1)).over(everything),
            "__delta": F.lit(total) - F.sum("__b").over(everything),
        }
    )
    extra = F.floor(F.abs("__delta") / F.col("__k")) + F.when(F.col("__rank") < F.abs("__delta") % F.col("__k"), 1).otherwise(0)
    return d.select(name, (F.col("__b") + F.signum(F.col("__delta")).cast("long") * extra).cast("long").alias("n"))


def assign_mix(df: DataFrame, pos: str, counts: DataFrame, name: str) -> DataFrame:
    """Give the first rows by position the first workload's count, and so on (counts is a small table)."""
    w = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = counts.select(name, F.sum("n").over(w).alias("upto"))
    spans = bounds.agg(F.array_sort(F.collect_list(F.struct("upto", name)))).scalar()
    ranked = ordered_scan(df, [], [pos], position_chunk(F.col(pos)), rank="__r").withColumn("__spans", spans)
    hit = F.get(F.filter("__spans", lambda s: s["upto"] >= F.col("__r")), 0)
    return ranked.withColumn(name, hit[name]).drop("__r", "__spans")


def pick_probes(df: DataFrame, keys: Sequence[str], key: str, ratio: float, eligible: Column, seed: int) -> DataFrame:
    """Rows chosen as probes: ``max(1, round(ratio*scored))`` eligible rows in digest order, per trace."""
    live = df.filter(~F.col("is_warmup"))
    n = live.groupBy(*keys).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(float(ratio)))).alias("__k"))
    pool = live.filter(eligible).select(*keys, key).withColumn("__d", shuffle_key(F.col(key), seed))
    ranked = ordered_scan(pool, keys, ["__d", key], digest_chunk(F.col("__d")), rank="__r")
    return null_safe_join(ranked, n, list(keys)).filter("__r <= __k").select(*keys, key)


def flag_members(df: DataFrame, ids: DataFrame, key: str | Sequence[str], flag: str) -> DataFrame:
    """Boolean column: is the row's id (one column or several) in the other table?"""
    keys = [key] if isinstance(key, str) else list(key)
    marks = ids.select(*keys).distinct().withColumn("__m", F.lit(True))
    return df.join(marks, keys, "left").withColumn(flag, F.col("__m").isNotNull()).drop("__m")


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Repeatable random order, as a position."""
    d = df.withColumn("__d", shuffle_key(F.col(key), seed))
    return ordered_scan(d, [], ["__d", key], digest_chunk(F.col("__d")), rank="shuffle_pos").drop("__d")


def even_split(df: DataFrame, pos: str, groups: int) -> DataFrame:
    """1-based group of an even split; the remainder goes to the first groups."""
    d = ordered_scan(df, [], [pos], position_chunk(F.col(pos)), rank="__r", total="__n")
    q, rem, i = F.floor(F.col("__n") / groups), F.col("__n") % groups, F.col("__r") - 1
    big = rem * (q + 1)
    group = F.when(i < big, F.floor(i / (q + 1))).otherwise(rem + F.floor((i - big) / F.greatest(q, F.lit(1))))
    return d.withColumn("bucket", (group + 1).cast("long")).drop("__r", "__n")


def cyclic_join(slots: DataFrame, slot: str, pool: DataFrame, pos: str) -> DataFrame:
    """Fill slot i with pool row ``i mod size``; small pools are broadcast by the planner, large ones spread well."""
    numbered = ordered_scan(pool, [], [pos], position_chunk(F.col(pos)), rank="__r", total="__n")
    size = pool.agg(F.count(F.lit(1))).scalar()
    keyed = slots.withColumn("__i", F.pmod(F.col(slot), F.greatest(size, F.lit(1))))
    return keyed.join(numbered.withColumn("__i", F.col("__r") - 1).drop("__r", "__n"), "__i").drop("__i")


def document_cycle(slots: DataFrame, slot: str, pool: DataFrame, doc: str, pos: str) -> DataFrame:
    """Slot i takes document ``i mod docs`` and, within it, row ``i mod rows``."""
    rows = ordered_scan(pool, [doc], [pos], position_chunk(F.col(pos)), rank="__q", total="__m").withColumn(
        "__q", F.col("__q") - 1
    )
    docs = pool.select(doc).distinct()
    docs = ordered_scan(docs, [], [doc], position_chunk(F.col(doc)), rank="__d").withColumn("__d", F.col("__d") - 1)
    size = docs.agg(F.count(F.lit(1))).scalar()
    sizes = docs.join(rows.groupBy(doc).agg(F.first("__m").alias("__m")), doc)
    i = F.col(slot)
    placed = slots.withColumn("__d", F.pmod(i, F.greatest(size, F.lit(1)))).join(sizes, "__d")
    placed = placed.withColumn("__q", F.pmod(i, F.col("__m"))).drop("__m", "__d")
    return placed.join(rows.drop("__m"), [doc, "__q"]).drop("__q")


# Lookups


def latest_by_key(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row per key, the last by position; combined map-side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("__s")).select(key, "__s.*")


def attach_probes(results: DataFrame, probes: DataFrame, key: str, target: str, pos: str) -> DataFrame:
    """Results with the probe that replaces them; the last probe wins on a duplicate target."""
    last = latest_by_key(probes, target, pos).withColumnRenamed(target, key).drop(pos)
    return results.join(last, key, "left")


# Whole traces


def analyze_suites(df: DataFrame, suite: str) -> DataFrame:
    """Totals, token statistics, arrivals and sessions of every suite in one pass each."""
    live = df.filter(~F.col("is_warmup"))
    totals = df.groupBy(suite).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("is_warmup")).alias("scored"), F.count_if("is_warmup").alias("warmup")
    )
    tokens = order_statistics(live, [suite], "input_length", [linear("p50", 50), linear("p95", 95)]).select(
        suite, F.col("mean").alias("tokens_mean"), F.col("p50").alias("tokens_p50"), F.col("p95").alias("tokens_p95")
    )
    bins = histogram(live, [suite], "input_length", LENGTH_EDGES).groupBy(suite).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin_pos", "n"))), lambda x: x["n"].cast("string")), "|").alias("histogram")
    )
    per = df.filter("session_id IS NOT NULL").groupBy(suite, "session_id").agg(F.count(F.lit(1)).alias("c"))
    sessions = per.groupBy(suite).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("c") >= 2).alias("sessions_2plus"))
    arrivals = arrival_statistics(df, suite, "pos", "timestamp").drop("n_requests")
    out = totals
    for part in (tokens, bins, sessions, arrivals):
        out = null_safe_join(out, part, [suite], "left")
    return out


def build_trace(corpus: DataFrame, profile: str, max_context: int, safety: int, warmup: float, probe_ratio: float, seed: int) -> DataFrame:
    """Trace rows from a corpus with columns suite, pos, workload_type, prompt, answer, output_length, gap.

    Prompts are cut at natural boundaries to the workload cap; lengths, hash ids, sessions, times,
    warm-up and probe flags follow. Target output lengths and gaps are columns of the corpus.
    """
    cap = F.coalesce(*[F.when(F.col("workload_type") == n, F.lit(c)) for n, c, _ in LENGTH_CAPS[profile]])
    d = corpus.withColumn("prompt", tx.natural_truncate(F.col("prompt"), cap))
    d = d.withColumn("input_length", tx.token_estimate(F.length("prompt")))
    d = clamp_lengths(d, profile, max_context, safety)
    d = d.withColumns(
        {
            "input_length": F.col("input_fit"), "output_length": F.col("output_fit"),
            "hash_ids": tx.char_block_hashes(F.col("prompt"), F.col("input_fit")),
            "request_id": F.format_string("r-%05d", F.col("pos") + 1),
            "prompt_b64": tx.encode_prompt(F.col("prompt")),
        }
    ).drop("prompt", "input_fit", "output_fit")
    # One ordered pass per suite gives session, warm-up flag and time.
    d = ordered_scan(
        d, ["suite"], ["pos"], position_chunk(F.col("pos")), rank="__r", total="__n",
        sums={"__sum": F.col("gap")}, firsts={"__first": F.col("gap")},
    )
    d = d.withColumns(
        {
            "cache_session_id": F.format_string("sess-%04d", F.floor((F.col("__r") - 1) / SESSION_SIZE)),
            "is_warmup": F.col("__r") <= F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(float(warmup)))),
            "timestamp": F.col("__sum") - F.coalesce("__first", F.lit(0)),
        }
    ).drop("__r", "__n", "__sum", "__first", "gap")
    # The trace is read several times below, so it is written once.
    d = stage(d, "trace")
    probes = pick_probes(
        d.select("suite", "request_id", "is_warmup", "workload_type"), ["suite"], "request_id", probe_ratio,
        F.col("workload_type").isin("tool_agent", "long_context"), seed,
    )
    # ids number the rows of a suite, so they repeat over suites
    return flag_members(d, probes, ["suite", "request_id"], "is_probe_slot")


def probe_table(trace: DataFrame) -> DataFrame:
    """One probe per flagged request, numbered within its workload."""
    p = trace.filter("is_probe_slot")
    long = F.col("workload_type") == "long_context"
    p = ordered_scan(p.withColumn("__lc", long), ["__lc"], ["pos"], position_chunk(F.col("pos")), rank="__r")
    return p.select(
        F.format_string("probe-%s-%04d", F.when(F.col("__lc"), "lc").otherwise("ta"), F.col("__r") - 1).alias("probe_id"),
        "workload_type", "prompt_b64", F.coalesce("answer", F.lit("")).alias("reference_answer"),
        F.when(F.col("__lc"), "f1_rouge_l").otherwise("f1_em").alias("evaluation_method"),
        F.col("request_id").alias("substitute_for_request_id"), "suite",
    )
