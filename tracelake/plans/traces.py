"""Registered queries: trace building and validation, routing, load."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import text as tx
from tracelake.operators import quantiles, routing, trace
from tracelake.operators.ordered import even_chunk, ordered_scan
from tracelake.plans.catalog import query, rounded
from tracelake.plans.corpora import CONTEXT, contexts, docs
from tracelake.plans.fixtures import REQ, WORKER, chats, requests, table, workers

# A trace: one suite per event type, sessions from users (users divisible by 5 have none), hourly timestamps.
TRACE = REQ + """,
trace AS (SELECT workload_type AS suite, request_id, pos, CASE WHEN session_id % 5 > 0 THEN session_id END AS session_id,
  at_ms // 3600000 * 3600000 AS timestamp, input_length, output_tokens * 20 AS output_length, is_warmup, k,
  CASE WHEN k < 31 THEN 'conversation' WHEN k < 90 THEN 'tool_agent' ELSE 'long_context' END AS workload_type FROM requests)
"""


def trace_rows(spark, sf):
    k = F.col("k")
    return requests(spark, sf).select(
        F.col("workload_type").alias("suite"), "request_id", "pos",
        F.when(F.col("session_id") % 5 > 0, F.col("session_id")).alias("session_id"),
        (F.floor(F.col("at_ms") / 3600000) * 3600000).alias("timestamp"), "input_length",
        (F.col("output_tokens") * 20).alias("output_length"), "is_warmup", "k",
        F.when(k < 31, "conversation").when(k < 90, "tool_agent").otherwise("long_context").alias("workload_type"),
    )


_PAYLOAD = "pay AS (SELECT request_id, md5(request_id) AS prompt_b64, k AS max_tokens FROM trace WHERE k % 3 > 0)"


def payloads(spark, sf):
    return trace_rows(spark, sf).filter("k % 3 > 0").select("request_id", F.md5("request_id").alias("prompt_b64"), F.col("k").alias("max_tokens"))


@query("j01_trace_payload", f"WITH {TRACE}, {_PAYLOAD} SELECT t.request_id, t.suite, p.prompt_b64, p.max_tokens FROM trace t JOIN pay p USING (request_id)")
def j01(spark, sf):
    return trace_rows(spark, sf).select("request_id", "suite").join(payloads(spark, sf), "request_id")


_PROBE = """pr AS (SELECT CAST(item_id * 3 % 4000 AS VARCHAR) AS target, item_id AS pos, text AS reference_answer FROM benchmark
  UNION ALL SELECT CAST(doc_id * 7 % 4000 AS VARCHAR), 100000 + doc_id, source FROM documents)"""


def _probe_rows(spark, sf):
    b = table(spark, sf, "benchmark").select(
        (F.col("item_id") * 3 % 4000).cast("string").alias("target"), F.col("item_id").alias("pos"), F.col("text").alias("reference_answer")
    )
    d = docs(spark, sf).select((F.col("doc_id") * 7 % 4000).cast("string"), 100000 + F.col("doc_id"), "source")
    return b.union(d)


@query(
    "j02_attach_probes",
    f"""WITH {REQ}, {_PROBE}, lastp AS (SELECT target, max_by(reference_answer, pos) AS reference_answer FROM pr GROUP BY 1)
    SELECT request_id, md5(reference_answer) AS reference FROM requests LEFT JOIN lastp ON target = request_id""",
)
def j02(spark, sf):
    out = trace.attach_probes(requests(spark, sf).select("request_id"), _probe_rows(spark, sf), "request_id", "target", "pos")
    return out.select("request_id", F.md5("reference_answer").alias("reference"))


@query("j04_members", f"WITH {TRACE}, {_PAYLOAD} SELECT request_id, suite FROM trace WHERE request_id IN (SELECT request_id FROM pay)")
def j04(spark, sf):
    return trace.members(trace_rows(spark, sf).select("request_id", "suite"), payloads(spark, sf), "request_id")


@query("j04_member_flag", f"WITH {TRACE}, {_PAYLOAD} SELECT request_id, request_id IN (SELECT request_id FROM pay) AS has_payload FROM trace")
def j04_flag(spark, sf):
    return trace.flag_members(trace_rows(spark, sf).select("request_id"), payloads(spark, sf), "request_id", "has_payload")


@query(
    "j18_cyclic_join",
    f"WITH {REQ}, p AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark) SELECT request_id, md5(text) AS prompt FROM requests JOIN p ON pos % n = i",
)
def j18(spark, sf):
    out = trace.cyclic_join(requests(spark, sf).select("request_id", "pos"), "pos", table(spark, sf, "benchmark"), "item_id")
    return out.select("request_id", F.md5("text").alias("prompt"))


@query("p04_token_band", "SELECT doc_id FROM documents WHERE greatest(1, round_even(length(text) / 4.0, 0)) BETWEEN 16 AND 1200")
def p04(spark, sf):
    return trace.token_band(docs(spark, sf), "text", 1200).select("doc_id")


@query("p05_over_budget", f"WITH {TRACE} SELECT request_id, input_length, output_length FROM trace WHERE input_length + output_length > 8192 - 256")
def p05(spark, sf):
    return trace.over_budget(trace_rows(spark, sf), 8192, 256).select("request_id", "input_length", "output_length")


@query(
    "p06_clamp_lengths",
    f"""WITH {TRACE}, caps AS (SELECT * FROM (VALUES ('conversation', 1200, 850), ('tool_agent', 5500, 256), ('long_context', 6500, 512)) v(w, ci, co)),
    a AS (SELECT request_id, least(input_length, ci, 6000 - 16) AS i, output_length, co FROM trace JOIN caps ON w = workload_type),
    b AS (SELECT request_id, i, least(output_length, co, 6000 - i) AS o FROM a)
    SELECT request_id, CAST(greatest(16, least(i, 6000 - o)) AS BIGINT) AS input_fit, CAST(greatest(16, o) AS BIGINT) AS output_fit FROM b""",
)
def p06(spark, sf):
    return trace.clamp_lengths(trace_rows(spark, sf), "compact", 6256, 256).select("request_id", "input_fit", "output_fit")


@query(
    "p07_warmup_flag",
    f"""WITH {TRACE}, r AS (SELECT request_id, row_number() OVER (PARTITION BY suite ORDER BY pos) AS rn, count(*) OVER (PARTITION BY suite) AS n FROM trace)
    SELECT request_id, rn <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS is_warmup FROM r""",
)
def p07(spark, sf):
    return trace.flag_warmup(trace_rows(spark, sf), ["suite"], "pos", 0.1).select("request_id", "is_warmup")


@query("p08_context_task", "SELECT doc_id, CASE WHEN length(text) > 80000 THEN 'longdep_qa' ELSE 'shortdep_qa' END AS task FROM documents")
def p08(spark, sf):
    return docs(spark, sf).select("doc_id", trace.context_task(F.col("text")).alias("task"))


@query(
    "p09_prompt_assembly",
    f"""WITH {CONTEXT} SELECT doc_id, pos, md5(trim(context || chr(10) || chr(10) || question)) AS with_instruction,
    md5(trim(context || chr(10) || chr(10) || 'Question: ' || question)) AS with_question, md5(trim(question)) AS bare FROM ctx""",
)
def p09(spark, sf):
    c, q = F.col("context"), F.col("question")
    return contexts(spark, sf).select(
        "doc_id", "pos", F.md5(trace.prompt_with_instruction(c, q)).alias("with_instruction"),
        F.md5(trace.prompt_with_question(c, q)).alias("with_question"), F.md5(tx.strip(q)).alias("bare"),
    )


# Arrivals


_BINS = [500, 2000, 8000, 12000, 18000, 25000, 100000]


@query(
    "a18_histogram",
    f"WITH {TRACE}, e AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{p}-{h}', {p}, {h})" for i, (p, h) in enumerate(zip([0, *_BINS[:-1]], _BINS))
    ) + f", (7, '>100000', 100000, 1000000000000)) v(bin_pos, bin, lo, hi)), w AS (SELECT DISTINCT suite FROM trace) "
    "SELECT w.suite, e.bin_pos, e.bin, count(t.input_length) AS n FROM w CROSS JOIN e LEFT JOIN trace t ON t.suite = w.suite AND t.input_length > lo AND t.input_length <= hi GROUP BY 1, 2, 3",
)
def a18(spark, sf):
    return quantiles.histogram(trace_rows(spark, sf), ["suite"], "input_length", trace.LENGTH_EDGES)


@query("a19_workload_counts", f"WITH {TRACE} SELECT suite, workload_type, count(*) AS n FROM trace GROUP BY 1, 2")
def a19(spark, sf):
    return trace_rows(spark, sf).groupBy("suite", "workload_type").agg(F.count(F.lit(1)).alias("n"))


_ARR = """g AS (SELECT suite, timestamp - lag(timestamp) OVER (PARTITION BY suite ORDER BY pos) AS gap FROM trace),
 gs AS (SELECT suite, min(gap) AS gap_min, avg(gap) AS gap_mean, quantile_cont(gap, 0.5) AS gap_p50, quantile_cont(gap, 0.95) AS gap_p95 FROM g GROUP BY 1),
 st AS (SELECT suite, timestamp, count(*) AS c FROM trace GROUP BY 1, 2),
 ss AS (SELECT suite, max(c) AS max_at_one_ts, count(*) AS unique_ts FROM st GROUP BY 1),
 sp AS (SELECT suite, count(*) AS n_requests, max_by(timestamp, pos) - min_by(timestamp, pos) AS span_ms FROM trace GROUP BY 1),
 arr AS (SELECT suite, n_requests, span_ms, max_at_one_ts, unique_ts, round(100.0::DOUBLE * (n_requests - unique_ts) / n_requests, 6) AS pct_batched,
   CAST(gap_min AS DOUBLE) AS gap_min, round(gap_mean, 4) AS gap_mean, round(gap_p50, 4) AS gap_p50, round(gap_p95, 4) AS gap_p95 FROM sp JOIN ss USING (suite) JOIN gs USING (suite))"""


def _round4(df):
    return df.withColumns({"gap_mean": F.round("gap_mean", 4), "gap_p50": F.round("gap_p50", 4), "gap_p95": F.round("gap_p95", 4)})


@query("a20_arrival_statistics", f"WITH {TRACE}, {_ARR} SELECT * FROM arr")
def a20(spark, sf):
    return _round4(rounded(trace.arrival_statistics(trace_rows(spark, sf), "suite", "pos", "timestamp"), "pct_batched"))


@query("w01_consecutive_gaps", f"WITH {TRACE} SELECT request_id, timestamp - lag(timestamp) OVER (PARTITION BY suite ORDER BY pos) AS gap FROM trace")
def w01(spark, sf):
    return trace.consecutive_gaps(trace_rows(spark, sf), ["suite"], "pos", "timestamp").select("request_id", "gap")


@query(
    "w02_inter_token_gaps",
    "SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events",
)
def w02(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = ordered_scan(e, ["user_id"], ["ts", "event_id"], even_chunk(e, F.col("us")), lags={"prev": F.col("us")})
    return out.select("event_id", (F.col("us") - F.col("prev")).alias("gap_us"))


@query("w03_session_position", f"WITH {REQ} SELECT request_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS q_idx FROM requests")
def w03(spark, sf):
    return trace.session_position(requests(spark, sf), ["session_id"], "pos").select("request_id", "q_idx")


@query(
    "w04_fixed_sessions",
    f"WITH {TRACE} SELECT request_id, format('sess-{{:04d}}', (row_number() OVER (PARTITION BY suite ORDER BY pos) - 1) // 6) AS cache_session_id FROM trace",
)
def w04(spark, sf):
    return trace.fixed_sessions(trace_rows(spark, sf), ["suite"], "pos", 6).select("request_id", "cache_session_id")


@query(
    "w04_sized_sessions",
    f"""WITH {TRACE}, sz AS (SELECT o_orderkey AS no, 4 + o_custkey % 5 AS size, sum(4 + o_custkey % 5) OVER (ORDER BY o_orderkey) AS upto FROM orders),
    r AS (SELECT request_id, row_number() OVER (ORDER BY pos) - 1 AS i FROM trace WHERE workload_type = 'tool_agent')
    SELECT request_id, format('sess-{{:04d}}', no) AS cache_session_id FROM r JOIN sz ON i >= upto - size AND i < upto""",
)
def w04_sized(spark, sf):
    t = trace_rows(spark, sf).filter("workload_type = 'tool_agent'").select("request_id", "pos")
    sizes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("no"), (4 + F.col("o_custkey") % 5).alias("size"))
    return trace.sized_sessions(t, "pos", sizes, "no", "size").select("request_id", "cache_session_id")


@query(
    "w05_retime",
    f"WITH {TRACE} SELECT request_id, CAST(sum(k) OVER (PARTITION BY suite ORDER BY pos) - first(k) OVER (PARTITION BY suite ORDER BY pos) AS BIGINT) AS new_ts FROM trace",
)
def w05(spark, sf):
    return trace.retime(trace_rows(spark, sf), ["suite"], "pos", "k").select("request_id", "new_ts")


@query(
    "w06_retime_clustered",
    f"""WITH {TRACE}, l AS (SELECT *, lag(session_id) OVER (PARTITION BY suite ORDER BY pos) AS prev FROM trace),
    s AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN session_id IS NULL THEN 20 + k % 60 WHEN session_id = prev THEN 5 + k % 35 ELSE 400 + k * 8 END AS step FROM l)
    SELECT request_id, CAST(sum(step) OVER (PARTITION BY suite ORDER BY pos) AS BIGINT) AS new_ts FROM s""",
)
def w06(spark, sf):
    k = F.col("k")
    out = trace.retime_clustered(trace_rows(spark, sf), ["suite"], "pos", "session_id", 5 + k % 35, 400 + k * 8, 20 + k % 60)
    return out.select("request_id", "new_ts")


@query(
    "w07_retime_same_session",
    f"""WITH {TRACE}, l AS (SELECT *, lag(session_id) OVER (PARTITION BY suite ORDER BY pos) AS prev FROM trace),
    s AS (SELECT *, sum(CASE WHEN session_id IS NULL THEN 30 WHEN session_id IS NOT DISTINCT FROM prev THEN 0 ELSE 50 END) OVER (PARTITION BY suite ORDER BY pos) AS t FROM l)
    SELECT request_id, CAST(CASE WHEN session_id IS NULL THEN t ELSE first(t) OVER (PARTITION BY suite, session_id ORDER BY pos) END AS BIGINT) AS new_ts FROM s""",
)
def w07(spark, sf):
    return trace.retime_same_session(trace_rows(spark, sf), ["suite"], "pos", "session_id").select("request_id", "new_ts")


@query(
    "w08_session_order",
    f"""WITH {TRACE}, sl AS (SELECT session_id, row_number() OVER (ORDER BY md5(CAST(session_id AS VARCHAR) || ':7'), session_id) - 1 AS slot FROM (SELECT DISTINCT session_id FROM trace WHERE session_id IS NOT NULL))
    SELECT request_id, slot, 0 AS kind, row_number() OVER (PARTITION BY t.session_id ORDER BY pos) - 1 AS rn FROM trace t JOIN sl ON sl.session_id = t.session_id
    UNION ALL SELECT request_id, row_number() OVER (ORDER BY pos) - 1, 1, 0 FROM trace WHERE session_id IS NULL""",
)
def w08(spark, sf):
    t = trace_rows(spark, sf).select("request_id", "pos", "session_id")
    return trace.session_order(t, "pos", "session_id", 7).select("request_id", "slot", "kind", "rn")


_CYCLE = """p AS (SELECT conv_id AS doc, turn AS pos, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS q, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
  d AS (SELECT doc, row_number() OVER (ORDER BY doc) - 1 AS di, count(*) OVER () AS nd FROM (SELECT DISTINCT doc FROM p))"""


@query(
    "w09_document_cycle",
    f"WITH {REQ}, {_CYCLE} SELECT request_id, p.doc, p.q AS question FROM requests r JOIN d ON r.pos % nd = di JOIN p ON p.doc = d.doc AND p.q = r.pos % p.m",
)
def w09(spark, sf):
    pool = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("tpos"))
    out = trace.document_cycle(requests(spark, sf).select("request_id", "pos"), "pos", pool, "doc", "tpos")
    return out.select("request_id", "doc", F.col("tpos").alias("question"))


@query(
    "t05_pick_probes",
    f"""WITH {TRACE}, n AS (SELECT suite, greatest(1, round_even(count(*) * 0.08::DOUBLE, 0)) AS k FROM trace WHERE NOT is_warmup GROUP BY 1),
    r AS (SELECT suite, request_id, row_number() OVER (PARTITION BY suite ORDER BY md5(request_id || ':11'), request_id) AS rn FROM trace WHERE NOT is_warmup AND workload_type IN ('tool_agent', 'long_context'))
    SELECT r.suite, request_id FROM r JOIN n ON n.suite = r.suite WHERE rn <= n.k""",
)
def t05(spark, sf):
    return trace.pick_probes(
        trace_rows(spark, sf), ["suite"], "request_id", 0.08, F.col("workload_type").isin("tool_agent", "long_context"), 11
    )


_MIX = """mix AS (SELECT workload_type, count(*) / CAST((SELECT count(*) FROM trace) AS DOUBLE) AS share FROM trace GROUP BY 1),
 b AS (SELECT *, CAST(round_even(share * (SELECT count(*) FROM orders), 0) AS BIGINT) AS b, row_number() OVER (ORDER BY share DESC, workload_type) - 1 AS rk, count(*) OVER () AS kk FROM mix),
 c AS (SELECT *, (SELECT count(*) FROM orders) - sum(b) OVER () AS delta FROM b),
 alloc AS (SELECT workload_type, CAST(b + sign(delta) * (abs(delta) // kk + CASE WHEN rk < abs(delta) % kk THEN 1 ELSE 0 END) AS BIGINT) AS n FROM c)"""


def _mix(spark, sf):
    t = trace_rows(spark, sf)
    total = t.agg(F.count(F.lit(1))).scalar()
    return t.groupBy("workload_type").agg(F.count(F.lit(1)).alias("c")).select("workload_type", (F.col("c") / total).alias("share"))


@query("t06_allocate_mix", f"WITH {TRACE}, {_MIX} SELECT workload_type, n FROM alloc")
def t06(spark, sf):
    return trace.allocate_mix(_mix(spark, sf), "workload_type", "share", table(spark, sf, "orders").count())


@query(
    "t06_assign_mix",
    f"""WITH {TRACE}, {_MIX}, bd AS (SELECT workload_type, sum(n) OVER (ORDER BY workload_type) AS upto, n FROM alloc),
    r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
    SELECT o_orderkey, workload_type FROM r JOIN bd ON rn > upto - n AND rn <= upto""",
)
def t06_assign(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    counts = trace.allocate_mix(_mix(spark, sf), "workload_type", "share", o.count())
    return trace.assign_mix(o, "o_orderkey", counts, "workload_type")


@query("t07_even_split", "SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS bucket FROM orders")
def t07(spark, sf):
    return trace.even_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("t08_shuffled", "SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':3'), doc_id) AS shuffle_pos FROM documents")
def t08(spark, sf):
    return trace.shuffled(docs(spark, sf).select("doc_id"), "doc_id", 3)


@query(
    "t10_first_per_group",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 3",
)
def t10(spark, sf):
    return trace.first_per_group(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 3)


@query(
    "u01_tagged_union",
    "SELECT doc_id AS id, length(text) AS chars, 'longdep_qa' AS task FROM documents UNION ALL SELECT item_id, length(text), 'shortdep_qa' FROM benchmark",
)
def u01(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), F.length("text").alias("chars"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("chars"))
    return trace.tag_union({"longdep_qa": d, "shortdep_qa": b})


def _corpus(spark, sf):
    c = contexts(spark, sf)
    return c.select(
        F.col("config").alias("suite"), (F.col("doc_id") * 100 + F.col("pos")).alias("pos"),
        F.when(F.col("pos") < 2, "tool_agent").when(F.col("pos") < 4, "long_context").otherwise("conversation").alias("workload_type"),
        trace.prompt_with_question(F.col("context"), F.col("question")).alias("prompt"), "answer",
        F.length("answer").cast("long").alias("output_length"), (F.col("doc_id") % 90).alias("gap"),
    )


_X12 = CONTEXT + """, cp AS (SELECT config AS suite, doc_id * 100 + pos AS pos, CASE WHEN pos < 2 THEN 'tool_agent' WHEN pos < 4 THEN 'long_context' ELSE 'conversation' END AS workload_type,
    trim(context || chr(10) || chr(10) || 'Question: ' || question) AS prompt, answer, length(answer) AS ol, doc_id % 90 AS gap FROM ctx),
  caps AS (SELECT * FROM (VALUES ('conversation', 1200, 850), ('tool_agent', 5500, 256), ('long_context', 6500, 512)) v(w, ci, co)),
  a AS (SELECT cp.*, co, least(CAST(greatest(1, round_even(length(prompt) / 4.0, 0)) AS BIGINT), ci, 7936 - 16) AS i FROM cp JOIN caps ON w = workload_type),
  b AS (SELECT *, least(ol, co, 7936 - i) AS o FROM a),
  tr AS (SELECT suite, pos, format('r-{:05d}', pos + 1) AS request_id, workload_type, prompt, answer, greatest(16, least(i, 7936 - o)) AS input_length, greatest(16, o) AS output_length,
    row_number() OVER w AS rn, count(*) OVER (PARTITION BY suite) AS n, CAST(sum(gap) OVER w - first(gap) OVER w AS BIGINT) AS timestamp FROM b WINDOW w AS (PARTITION BY suite ORDER BY pos)),
  wu AS (SELECT *, format('sess-{:04d}', (rn - 1) // 6) AS cache_session_id, rn <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS is_warmup FROM tr),
  pk AS (SELECT suite, greatest(1, round_even(count(*) * 0.08::DOUBLE, 0)) AS k FROM wu WHERE NOT is_warmup GROUP BY 1),
  ps AS (SELECT request_id FROM (SELECT suite, request_id, row_number() OVER (PARTITION BY suite ORDER BY md5(request_id || ':5'), request_id) AS r FROM wu WHERE NOT is_warmup AND workload_type <> 'conversation') z JOIN pk ON pk.suite = z.suite WHERE r <= k),
  built AS (SELECT *, request_id IN (SELECT request_id FROM ps) AS is_probe_slot FROM wu)"""


@query(
    "x12_build_trace",
    f"WITH {_X12} SELECT suite, pos, request_id, workload_type, timestamp, input_length, output_length, cache_session_id, is_warmup, is_probe_slot, greatest(1, ceil(input_length / 512.0)) AS n_blocks, md5(to_base64(encode(prompt))) AS prompt FROM built",
)
def x12(spark, sf):
    out = trace.build_trace(_corpus(spark, sf), "compact", 8192, 256, 0.1, 0.08, 5)
    return out.select(
        "suite", "pos", "request_id", "workload_type", "timestamp", "input_length", "output_length", "cache_session_id",
        "is_warmup", "is_probe_slot", F.size("hash_ids").alias("n_blocks"), F.md5("prompt_b64").alias("prompt"),
    )


@query(
    "x12_probe_table",
    f"""WITH {_X12} SELECT format('probe-{{}}-{{:04d}}', CASE WHEN workload_type = 'long_context' THEN 'lc' ELSE 'ta' END, row_number() OVER (PARTITION BY workload_type = 'long_context' ORDER BY pos) - 1) AS probe_id,
    workload_type, md5(to_base64(encode(prompt))) AS prompt, md5(coalesce(answer, '')) AS answer, CASE WHEN workload_type = 'long_context' THEN 'f1_rouge_l' ELSE 'f1_em' END AS evaluation_method, request_id AS substitute_for_request_id FROM built WHERE is_probe_slot""",
)
def x12_probes(spark, sf):
    p = trace.probe_table(trace.build_trace(_corpus(spark, sf), "compact", 8192, 256, 0.1, 0.08, 5))
    return p.select(
        "probe_id", "workload_type", F.md5("prompt_b64").alias("prompt"), F.md5("reference_answer").alias("answer"), "evaluation_method",
        "substitute_for_request_id",
    )


@query(
    "x15_analyze_suites",
    f"""WITH {TRACE}, {_ARR}, tk AS (SELECT suite, avg(input_length) AS m, quantile_cont(input_length, 0.5) AS p50, quantile_cont(input_length, 0.95) AS p95,
      concat_ws('|', """ + ", ".join(
        f"count(*) FILTER (WHERE input_length > {p} AND input_length <= {h})" for p, h in zip([0, *_BINS[:-1]], _BINS)
    ) + """, count(*) FILTER (WHERE input_length > 100000)) AS histogram FROM trace WHERE NOT is_warmup GROUP BY 1),
    se AS (SELECT suite, count(*) AS sessions, count(*) FILTER (WHERE c >= 2) AS sessions_2plus FROM (SELECT suite, session_id, count(*) AS c FROM trace WHERE session_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    tt AS (SELECT suite, count(*) AS requests, count(*) FILTER (WHERE NOT is_warmup) AS scored, count(*) FILTER (WHERE is_warmup) AS warmup FROM trace GROUP BY 1)
    SELECT tt.*, round(m, 6) AS tokens_mean, round(p50, 6) AS tokens_p50, round(p95, 6) AS tokens_p95, histogram, sessions, sessions_2plus,
      span_ms, max_at_one_ts, unique_ts, pct_batched, gap_min, gap_mean, gap_p50, gap_p95
    FROM tt JOIN tk USING (suite) JOIN se USING (suite) JOIN arr USING (suite)""",
)
def x15(spark, sf):
    out = trace.analyze_suites(trace_rows(spark, sf), "suite")
    return _round4(rounded(out, "tokens_mean", "tokens_p50", "tokens_p95", "pct_batched"))


# Routing

_PROMPT = """pm AS (SELECT doc_id, text, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END AS est,
  CASE WHEN text = '' THEN '' ELSE left(sha256(text), 16) END AS prefix_hash FROM documents)"""


def prompts(spark, sf):
    t = tx.prompt_from_chat(F.col("payload"))
    return chats(spark, sf).select("doc_id", t.alias("prompt")).select(
        "doc_id", tx.prompt_tokens(F.col("prompt")).alias("est"), tx.prefix_hash(F.col("prompt")).alias("prefix_hash")
    )


@query(
    "p10_choose_pool",
    f"WITH {_PROMPT} SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'long' WHEN est >= 400 THEN 'long' ELSE 'short' END AS pool FROM pm",
)
def p10(spark, sf):
    explicit = F.when(F.col("doc_id") % 7 == 1, F.lit("long"))
    return prompts(spark, sf).select("doc_id", F.coalesce(routing.choose_pool(F.col("est"), 400, explicit), routing.choose_pool(F.col("est"), 400)).alias("pool"))


_EXACT = "ex AS (SELECT doc_id, CAST(ceil(length(text) / 3.2::DOUBLE) AS BIGINT) AS n_tokens FROM documents WHERE doc_id % 2 = 0)"
_ROUTE = f"""{_PROMPT}, {_EXACT}, rt AS (SELECT pm.doc_id, est, prefix_hash,
   CASE WHEN est < 300 THEN est WHEN est > 600 THEN est ELSE coalesce(n_tokens, est) END AS tokens,
   CASE WHEN est < 300 THEN 'fast-short' WHEN est > 600 THEN 'fast-long' WHEN n_tokens IS NOT NULL THEN 'tokenize' ELSE 'estimate' END AS method FROM pm LEFT JOIN ex ON ex.doc_id = pm.doc_id)"""


def routed(spark, sf):
    exact = docs(spark, sf).filter("doc_id % 2 = 0").select("doc_id", F.ceil(F.length("text") / F.lit(3.2)).alias("n_tokens"))
    return routing.resolve_routing(prompts(spark, sf), "doc_id", "est", 400, exact)


@query(
    "p11_resolve_routing",
    f"WITH {_ROUTE} SELECT doc_id, tokens, method, CASE WHEN method = 'fast-short' THEN 'short' WHEN method = 'fast-long' THEN 'long' WHEN tokens >= 400 THEN 'long' ELSE 'short' END AS pool FROM rt",
)
def p11(spark, sf):
    return routed(spark, sf).select("doc_id", "tokens", "method", "pool")


@query(
    "p12_candidate_tiers",
    f"""WITH {_PROMPT}, t AS (SELECT doc_id, est, CASE WHEN est >= 12288 THEN ['long'] WHEN est >= 8000 THEN ['long', 'short'] WHEN est >= 6144 THEN ['short', 'long'] ELSE ['short'] END AS tiers FROM
      (SELECT doc_id, est * 4 AS est FROM pm))
    SELECT doc_id, unnest(tiers) AS tier, unnest(range(0, len(tiers))) AS priority FROM t""",
)
def p12(spark, sf):
    d = prompts(spark, sf).select("doc_id", (F.col("est") * 4).alias("tokens"))
    return routing.expand_tiers(d, "tokens", 8000).select("doc_id", "tier", "priority")


_SELECT = f"""{_ROUTE}, {WORKER}, {{recent}} cand AS (SELECT rt.doc_id, rt.method, prefix_hash, w.worker_id, w.pos,
   CASE WHEN tokens >= 12288 THEN CASE pool WHEN 'long' THEN 1 END WHEN tokens >= 400 THEN CASE pool WHEN 'long' THEN 1 ELSE 2 END
     WHEN tokens >= 6144 THEN CASE pool WHEN 'short' THEN 1 ELSE 2 END ELSE CASE pool WHEN 'short' THEN 1 END END AS tier,
   queue_prefill_tokens / prefill_tps + tokens / prefill_tps + (64 + rt.doc_id % 400) / decode_tps - {{bonus}} AS score,
   left(md5(prefix_hash || ':' || w.worker_id), 16) AS h FROM rt CROSS JOIN worker w {{join}}),
 cd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, tier, pos) AS br, row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, tier, pos) AS sr,
   min(score) OVER (PARTITION BY doc_id) AS ms, count(*) OVER (PARTITION BY doc_id) AS n FROM cand WHERE tier IS NOT NULL),
 st AS (SELECT doc_id, bool_or(sr = 1 AND prefix_hash <> '' AND n > 1 AND score <= 2 * ms) AS keep FROM cd GROUP BY 1)
 SELECT cd.doc_id, worker_id, round(score, 6) AS route_score, CASE WHEN keep THEN method || '+prefix' ELSE method END AS method
 FROM cd JOIN st ON st.doc_id = cd.doc_id WHERE CASE WHEN keep THEN sr = 1 ELSE br = 1 END"""


@query(
    "j17_select_worker",
    "WITH " + _SELECT.format(
        recent="recent AS (SELECT DISTINCT left(sha256(text), 16) AS ph, 'NATION_' || (doc_id % 25) AS rw FROM documents WHERE text <> ''),",
        bonus="CASE WHEN rw IS NOT NULL THEN 500 / prefill_tps ELSE 0 END",
        join="LEFT JOIN recent ON ph = prefix_hash AND rw = w.worker_id",
    ),
)
def j17(spark, sf):
    recent = docs(spark, sf).filter("text <> ''").select(
        tx.prefix_hash(F.col("text")).alias("prefix_hash"), F.concat(F.lit("NATION_"), (F.col("doc_id") % 25).cast("string")).alias("worker_id")
    ).distinct()
    d = routed(spark, sf).withColumn("max_tokens", 64 + F.col("doc_id") % 400)
    out = routing.select_worker(d, workers(spark, sf), 400, recent)
    return rounded(out.select("doc_id", "worker_id", "route_score", "method"), "route_score")


_CUSTOMERS = """
worker AS (
  SELECT c_name AS worker_id, CASE WHEN c_nationkey < 9 THEN 'long' ELSE 'short' END AS pool, CAST(c_custkey AS BIGINT) AS pos,
    CAST(c_custkey * 731 % 9000 AS BIGINT) AS queue_prefill_tokens,
    CAST(12000 + c_custkey % 97 * 130 AS DOUBLE) AS prefill_tps, CAST(900 + c_custkey % 41 * 30 AS DOUBLE) AS decode_tps
  FROM customer)
"""


@query("j17_select_from_large_fleet", "WITH " + _SELECT.replace(WORKER, _CUSTOMERS).format(recent="", bonus="0", join=""))
def j17_large(spark, sf):
    """The same choice with every customer as a worker."""
    key = F.col("c_custkey")
    fleet = table(spark, sf, "customer").select(
        F.col("c_name").alias("worker_id"), F.when(F.col("c_nationkey") < 9, "long").otherwise("short").alias("pool"), key.cast("long").alias("pos"),
        (key * 731 % 9000).cast("long").alias("queue_prefill_tokens"), (12000 + key % 97 * 130).cast("double").alias("prefill_tps"),
        (900 + key % 41 * 30).cast("double").alias("decode_tps"),
    )
    d = routed(spark, sf).withColumn("max_tokens", 64 + F.col("doc_id") % 400)
    out = routing.select_worker(d, fleet, 400)
    return rounded(out.select("doc_id", "worker_id", "route_score", "method"), "route_score")


@query(
    "j17_route_by_tier",
    f"""WITH {_ROUTE}, {WORKER}, cand AS (SELECT rt.doc_id, w.worker_id, w.pos, CASE WHEN tokens >= 12288 THEN CASE pool WHEN 'long' THEN 1 END WHEN tokens >= 400 THEN CASE pool WHEN 'long' THEN 1 ELSE 2 END
      ELSE CASE pool WHEN 'short' THEN 1 END END AS tier, queue_prefill_tokens / prefill_tps + tokens / prefill_tps + 256 / decode_tps AS score FROM rt CROSS JOIN worker w)
    SELECT doc_id, worker_id, round(score, 6) AS route_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, tier, pos) AS r FROM cand WHERE tier IS NOT NULL) WHERE r = 1""",
)
def j17_tier(spark, sf):
    d = routed(spark, sf).withColumn("max_tokens", F.lit(256))
    return rounded(routing.route_by_tier(d, "doc_id", workers(spark, sf), 400), "route_score")


@query(
    "f26_rendezvous",
    f"WITH {_PROMPT}, {WORKER} SELECT doc_id, arg_max(worker_id, left(md5(prefix_hash || ':' || worker_id), 16)) AS worker_id FROM pm CROSS JOIN worker GROUP BY 1",
)
def f26(spark, sf):
    return routing.rendezvous_worker(prompts(spark, sf), "prefix_hash", workers(spark, sf)).select("doc_id", "worker_id")


@query(
    "x17_batch_plan",
    "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16 AS batch_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 16 AS slot FROM documents",
)
def x17(spark, sf):
    return routing.batch_plan(docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 16).select("doc_id", "batch_id", "slot")


_LOAD = REQ + """, ev2 AS (SELECT session_id AS worker, request_id, epoch_us(ts) AS at_us, 0 AS kind, 1 AS d, input_length AS t FROM requests
  UNION ALL SELECT session_id, request_id, epoch_us(ts) + 3600000000 * (1 + k % 40), 1, -1, -input_length FROM requests
  UNION ALL SELECT session_id, request_id, epoch_us(ts) + 1, 2, -1, -input_length FROM requests WHERE k = 7),
 s AS (SELECT *, sum(d) OVER w AS n, sum(t) OVER w AS q FROM ev2 WINDOW w AS (PARTITION BY worker ORDER BY at_us, request_id, kind))"""


def load_events(spark, sf):
    """Start and end events per request (some requests end twice)."""
    r = requests(spark, sf)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    n = F.col("input_length")
    ev = lambda at, kind, sign: F.struct(at.alias("at_us"), F.lit(kind).alias("kind"), F.lit(sign).alias("d"), (n * sign).alias("t"))
    rows = F.array_compact(
        F.array(ev(us, 0, 1), ev(us + 3600000000 * (1 + F.col("k") % 40), 1, -1), F.when(F.col("k") == 7, ev(us + 1, 2, -1)))
    )
    return r.select(F.col("session_id").alias("worker"), "request_id", F.inline(rows))


@query(
    "r05_worker_load",
    f"""WITH {_LOAD} SELECT worker, request_id, kind, CAST(n - least(0, min(n) OVER w) AS BIGINT) AS inflight, CAST(q - least(0, min(q) OVER w) AS BIGINT) AS queued_tokens
    FROM s WINDOW w AS (PARTITION BY worker ORDER BY at_us, request_id, kind)""",
)
def r05(spark, sf):
    ev = load_events(spark, sf)
    out = routing.worker_load(ev, "worker", ["at_us", "request_id", "kind"], even_chunk(ev, F.col("at_us")), "d", "t")
    return out.select("worker", "request_id", "kind", "inflight", "queued_tokens")
