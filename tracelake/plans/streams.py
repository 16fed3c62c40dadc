"""Registered queries: streaming jobs run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import text as tx
from tracelake.operators.ordered import position_chunk
from tracelake.plans.catalog import query, rounded
from tracelake.plans.fixtures import REQ, SLO_TBT, SLO_TTFT, request_columns, table
from tracelake.session import scratch_dir
from tracelake.streaming import jobs


def stream_of(spark, sf, name):
    """A given table, one file or a folder of them, as a stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = table(spark, sf, name).schema
    # a pattern of this one name: a plain path would have to be a folder
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def finish(query):
    query.awaitTermination()
    return query


def token_events(events):
    """Start, token and end events of each request; some end in an error."""
    k, us = F.col("k"), F.unix_micros(F.col("ts").cast("timestamp"))
    first = us + 1000 * (1 + F.col("user_id"))
    n = (k % 9).cast("int")
    gap = lambda i: (i * 7 + k) % 5 * 6000 + 10000
    ev = lambda at, seq, kind: F.struct(F.timestamp_micros(at).alias("event_ts"), seq.cast("int").alias("seq"), F.lit(kind).alias("kind"))
    at = lambda i: first + F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("long"), lambda a, x: a + F.when(x > 0, gap(x)).otherwise(F.lit(0).cast("long")))
    tokens = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ev(at(i), i + 1, "token"))
    tokens = F.when(n > 0, tokens).otherwise(F.slice(tokens, 1, 0))
    last = F.when(k == 13, ev(us + 9_000_000, F.lit(99), "error")).otherwise(ev(us + 9_000_000, F.lit(99), "done"))
    rows = F.concat(F.array(ev(us, F.lit(0), "start")), tokens, F.array(last))
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("long")).select(
        F.col("event_id").cast("string").alias("request_id"), F.inline(rows)
    )


_LATENCY = """WITH r AS (SELECT CAST(event_id AS VARCHAR) AS request_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
 g AS (SELECT request_id, user_id, k, CASE WHEN k % 9 > 1 THEN list_transform(range(1, k % 9), lambda i: CAST((i * 7 + k) % 5 * 6 + 10 AS DOUBLE)) ELSE [] END AS gaps FROM r),
 t AS (SELECT *, len(gaps) AS n, greatest(1, CAST(floor(len(gaps) * 0.05) AS BIGINT)) AS tr, list_sort(gaps) AS s FROM g),
 m AS (SELECT *, CASE WHEN n - 2 * tr > 0 THEN s[tr + 1 : n - tr] ELSE gaps END AS mid FROM t)
 SELECT request_id, CASE WHEN k % 9 > 0 THEN CAST(1 + user_id AS DOUBLE) END AS ttft_ms, CASE WHEN n < 2 THEN NULL WHEN len(mid) % 2 = 1 THEN mid[len(mid) // 2 + 1] ELSE (mid[len(mid) // 2] + mid[len(mid) // 2 + 1]) / 2 END AS tbt_ms,
  k % 9 AS output_tokens, 9000.0::DOUBLE AS latency_ms, CASE WHEN k = 13 THEN 'error' END AS error FROM m"""


@query("r01_request_latency_stream", _LATENCY)
def r01(spark, sf):
    jobs.use_rocksdb(spark)
    out = jobs.request_latency_stream(token_events(stream_of(spark, sf, "events")), 600)
    path = scratch_dir(spark, "latency")
    finish(jobs.append_stream(out, path, scratch_dir(spark, "checkpoint")))
    return spark.read.parquet(path)


@query("r01_request_latency_batch", _LATENCY)
def r01_batch(spark, sf):
    return jobs.request_latency_batch(token_events(table(spark, sf, "events")))


@query(
    "r02_slo_board_stream",
    f"""WITH {REQ} SELECT (epoch_us(ts) // 86400000000) AS day, workload_type, count(*) AS n, count(*) FILTER (WHERE effective) AS n_effective, round(count(*) FILTER (WHERE effective) / CAST(count(*) AS DOUBLE), 6) AS erc,
    count(*) FILTER (WHERE ttft_ms > 1500) AS slo_fail_ttft, round(quantile_cont(ttft_ms, 0.5), 6) AS p50, round(quantile_cont(ttft_ms, 0.95), 6) AS p95 FROM requests WHERE NOT is_warmup GROUP BY 1, 2""",
)
def r02(spark, sf):
    src = request_columns(stream_of(spark, sf, "events")).withColumn("at", F.col("ts").cast("timestamp"))
    board = jobs.slo_board_stream(src, "at", "workload_type", "1 day", SLO_TTFT, SLO_TBT, accuracy=None)
    path = scratch_dir(spark, "board")
    finish(jobs.update_stream(board, path, scratch_dir(spark, "checkpoint")))
    out = jobs.latest_updates(spark, path, ["window_start", "workload_type"])
    out = out.withColumn("day", F.floor(F.unix_micros("window_start") / 86_400_000_000)).drop("window_start")
    return rounded(out, "erc", "p50", "p95")


@query("r03_concurrency_stream", "SELECT epoch_us(ts) // 3600000000 AS hour, count(*) AS starts FROM events GROUP BY 1")
def r03(spark, sf):
    src = stream_of(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    path = scratch_dir(spark, "starts")
    finish(jobs.update_stream(jobs.concurrency_stream(src, "at", "1 hour"), path, scratch_dir(spark, "checkpoint")))
    out = jobs.latest_updates(spark, path, ["bucket_start"])
    return out.select(F.floor(F.unix_micros("bucket_start") / 3_600_000_000).alias("hour"), "starts")


@query(
    "r04_prefix_hits_stream",
    """WITH d AS (SELECT lang AS worker_id, doc_id AS pos, CASE WHEN text = '' THEN '' ELSE left(sha256(text), 16) END AS p FROM documents),
    l AS (SELECT *, lag(pos) OVER (PARTITION BY worker_id, p ORDER BY pos) AS prev FROM d),
    h AS (SELECT l.worker_id, l.pos, count(DISTINCT d.p) AS between_ FROM l JOIN d ON d.worker_id = l.worker_id AND d.pos > l.prev AND d.pos < l.pos AND d.p <> '' GROUP BY 1, 2)
    SELECT l.worker_id, l.pos, l.prev IS NOT NULL AND l.p <> '' AND coalesce(between_, 0) < 64 AS hit FROM l LEFT JOIN h ON h.worker_id = l.worker_id AND h.pos = l.pos""",
)
def r04(spark, sf):
    jobs.use_rocksdb(spark)
    src = stream_of(spark, sf, "documents").select(
        F.col("lang").alias("worker_id"), F.col("doc_id").alias("pos"), tx.prefix_hash(F.col("text")).alias("prefix_hash")
    )
    path = scratch_dir(spark, "hits")
    finish(jobs.append_stream(jobs.prefix_hits_stream(src), path, scratch_dir(spark, "checkpoint")))
    return spark.read.parquet(path)


@query(
    "r05_load_stream",
    f"""WITH {REQ}, s AS (SELECT session_id, pos, sum(CASE WHEN k < 60 THEN 1 ELSE -1 END) OVER w AS n, sum(CASE WHEN k < 60 THEN input_length ELSE -input_length END) OVER w AS t
    FROM requests WINDOW w AS (PARTITION BY session_id ORDER BY pos))
    SELECT session_id AS worker, CAST(max_by(n, pos) - least(0, min(n)) AS BIGINT) AS inflight, CAST(max_by(t, pos) - least(0, min(t)) AS BIGINT) AS queued_tokens FROM s GROUP BY 1""",
)
def r05(spark, sf):
    sign = F.when(F.col("k") < 60, 1).otherwise(-1)
    src = request_columns(stream_of(spark, sf, "events")).select(
        F.col("session_id").alias("worker"), "pos", sign.alias("d"), (sign * F.col("input_length")).alias("t")
    )
    path = scratch_dir(spark, "load")
    finish(jobs.load_stream(src, path, scratch_dir(spark, "checkpoint"), "worker", ["pos"], position_chunk(F.col("pos")), "d", "t"))
    return jobs.latest_updates(spark, path, ["worker"])


@query(
    "r06_enrich_stream",
    f"""WITH {REQ} SELECT request_id, output_tokens >= 1 AND coalesce(ttft_ms <= 500 + n_nationkey * 50, false) AND coalesce(tbt_ms <= 20 + n_nationkey, false) AS effective, CASE WHEN event_type IS NULL THEN NULL ELSE CASE WHEN n_name = event_type THEN 1.0 ELSE 0.0 END END AS probe_f1
    FROM (SELECT r.*, CASE WHEN k % 2 = 0 THEN workload_type END AS event_type FROM requests r) q JOIN nation ON n_nationkey = session_id % 25""",
)
def r06(spark, sf):
    slo = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("site"), F.col("n_name").alias("completion"), (500.0 + F.col("n_nationkey") * 50).alias("slo_ttft_ms"),
        (20.0 + F.col("n_nationkey")).alias("slo_tbt_ms"),
    )
    src = request_columns(stream_of(spark, sf, "events")).withColumn("site", F.col("session_id") % 25)
    probes = request_columns(table(spark, sf, "events")).filter("k % 2 = 0").select("request_id", F.col("workload_type").alias("reference_answer"))
    out = jobs.enrich_stream(src, slo, "site", probes).select("request_id", "effective", "probe_f1")
    path = scratch_dir(spark, "enriched")
    finish(jobs.append_stream(out, path, scratch_dir(spark, "checkpoint")))
    return spark.read.parquet(path)


@query("r07_persist_stream", f"WITH {REQ} SELECT request_id, effective, ttft_ms FROM requests")
def r07(spark, sf):
    src = request_columns(stream_of(spark, sf, "events")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    src = src.withColumn("at", F.col("ts").cast("timestamp")).select("request_id", "effective", "ttft_ms", "at")
    path = scratch_dir(spark, "persisted")
    finish(jobs.persist_stream(src, path, scratch_dir(spark, "checkpoint"), "request_id", "at"))
    return spark.read.parquet(path).drop("at")
