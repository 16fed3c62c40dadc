"""Logical tables derived from the given tables, each with the same derivation in SQL.

SQL constants are common-table bodies: ``WITH {REQ} SELECT ... FROM req``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work one task per core when a tiny input is read by fewer (never at scale)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


SLO_TTFT, SLO_TBT = 1500.0, 45.0

REQ = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
req AS (
  SELECT CAST(event_id AS VARCHAR) AS request_id, event_id AS pos, event_type AS workload_type,
    user_id AS session_id, ts, k, value, k < 5 AS is_warmup, k >= 90 AS is_probe_slot,
    CAST(16 + floor(value * 200) AS BIGINT) AS input_length,
    CAST(greatest(k - 5, 0) AS BIGINT) AS output_tokens,
    CASE WHEN k <> 50 THEN value * 100 END AS ttft_ms,
    CASE WHEN k NOT IN (50, 51) THEN CAST(10 AS DOUBLE) + k * CAST(0.5 AS DOUBLE) + value / 8 END AS tbt_ms,
    CASE WHEN event_type = 'error' AND k >= 95 THEN 'HTTP 500' END AS error,
    epoch_us(ts) // 1000 - 1704067200000 AS at_ms,
    CASE WHEN k >= 90 THEN (k % 11) / CAST(10 AS DOUBLE) END AS probe_f1,
    CASE WHEN k >= 90 THEN CAST(k % 2 AS DOUBLE) END AS probe_em
  FROM raw),
requests AS (
  SELECT *, output_tokens >= 1 AND coalesce(ttft_ms <= 1500, false) AND coalesce(tbt_ms <= 45, false) AS effective
  FROM req)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request metrics: one row per event."""
    return request_columns(spread(table(spark, sf_dir, "events")))


def request_columns(events: DataFrame) -> DataFrame:
    """Request metrics of a table or stream of events."""
    from tracelake.functions.scoring import request_effective

    k, value = F.col("k"), F.col("value")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    raw = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    req = raw.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("workload_type"),
        F.col("user_id").alias("session_id"),
        "ts", "k", "value",
        (k < 5).alias("is_warmup"),
        (k >= 90).alias("is_probe_slot"),
        (16 + F.floor(value * 200)).cast("long").alias("input_length"),
        F.greatest(k - 5, F.lit(0)).cast("long").alias("output_tokens"),
        F.when(k != 50, value * 100).alias("ttft_ms"),
        F.when(~k.isin(50, 51), F.lit(10.0) + k * F.lit(0.5) + value / 8).alias("tbt_ms"),
        F.when((F.col("event_type") == "error") & (k >= 95), F.lit("HTTP 500")).alias("error"),
        (ms - F.lit(1704067200000)).alias("at_ms"),
        F.when(k >= 90, (k % 11) / F.lit(10.0)).alias("probe_f1"),
        F.when(k >= 90, (k % 2).cast("double")).alias("probe_em"),
    )
    return req.withColumn(
        "effective",
        request_effective(
            F.col("ttft_ms"), F.col("tbt_ms"), F.col("output_tokens"), F.lit(SLO_TTFT), F.lit(SLO_TBT)
        ),
    )


REPLAY = REQ + """,
replay AS (
  SELECT workload_type AS tag, request_id, pos, at_ms, error, CASE WHEN error IS NULL THEN ttft_ms END AS ttft_ms,
    CASE WHEN error IS NULL THEN list_transform(range(1, 1 + k % 9), lambda i: CAST(10 AS DOUBLE) + ((i * 7 + k) % 5) * 6 + value / 10)
      ELSE [] END AS tbt_ms
  FROM requests)
"""


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay records: one row per request with its list of token gaps."""
    k = F.col("k")
    gaps = F.transform(
        F.sequence(F.lit(1).cast("long"), k % 9),
        lambda i: F.lit(10.0) + ((i * 7 + k) % 5) * 6 + F.col("value") / 10,
    )
    empty = F.array().cast("array<double>")
    ok = F.col("error").isNull()
    return requests(spark, sf_dir).select(
        F.col("workload_type").alias("tag"), "request_id", "pos", "at_ms", "error",
        F.when(ok, F.col("ttft_ms")).alias("ttft_ms"),
        F.when(ok & (k % 9 > 0), gaps).otherwise(empty).alias("tbt_ms"),
    )


QA = """
qa AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, u.conv_id * 1000 + u.turn AS qa_id
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer pairs: a user turn and the assistant turn after it."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"]).withColumn("qa_id", F.col("conv_id") * 1000 + F.col("turn"))


# Layout fixtures: 20 blocks per page on a 600 x 800 pt page, 25 template sections on a 5 x 5 grid.
PAGE_W, PAGE_H = 600.0, 800.0
BLOCKS_PER_PAGE = 20

BLOCK = """
blk0 AS (
  SELECT p_partkey // 20 AS page_id, p_partkey % 20 AS pos, p_partkey AS pk,
    CASE p_size % 5 WHEN 1 THEN 'Table' WHEN 2 THEN 'Section-Header' WHEN 3 THEN 'Image' ELSE 'Text' END AS label,
    CAST(p_partkey * 37 % 800 AS DOUBLE) AS x0, CAST(p_partkey * 53 % 850 AS DOUBLE) AS y0, p_size, p_name, p_brand
  FROM part),
block AS (
  SELECT page_id, pos, pk, label, x0, y0, x0 + 40 + p_size * 3 AS x1, y0 + 30 + pk * 11 % 120 AS y1,
    CASE label WHEN 'Text' THEN 'NATION_' || (pk * 7 % 25) || ': ' || p_name
      WHEN 'Section-Header' THEN 'NATION_' || (pk * 3 % 25) WHEN 'Table' THEN p_name || ' ' || p_brand ELSE '' END AS text,
    CASE label WHEN 'Text' THEN 'NATION_' || (pk * 7 % 12) ELSE '' END AS schema
  FROM blk0)
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout blocks in 0-1000 page coordinates."""
    pk, size = F.col("p_partkey"), F.col("p_size")
    label = (
        F.when(size % 5 == 1, F.lit("Table")).when(size % 5 == 2, F.lit("Section-Header"))
        .when(size % 5 == 3, F.lit("Image")).otherwise(F.lit("Text"))
    )
    x0, y0 = (pk * 37 % 800).cast("double"), (pk * 53 % 850).cast("double")
    text = (
        F.when(label == "Text", F.concat(F.lit("NATION_"), (pk * 7 % 25).cast("string"), F.lit(": "), "p_name"))
        .when(label == "Section-Header", F.concat(F.lit("NATION_"), (pk * 3 % 25).cast("string")))
        .when(label == "Table", F.concat("p_name", F.lit(" "), "p_brand")).otherwise(F.lit(""))
    )
    schema = F.when(label == "Text", F.concat(F.lit("NATION_"), (pk * 7 % 12).cast("string"))).otherwise(F.lit(""))
    return spread(table(spark, sf_dir, "part")).select(
        F.floor(pk / BLOCKS_PER_PAGE).alias("page_id"), (pk % BLOCKS_PER_PAGE).alias("pos"), pk.alias("pk"),
        label.alias("label"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 40 + size * 3).alias("x1"), (y0 + 30 + pk * 11 % 120).alias("y1"),
        text.alias("text"), schema.alias("schema"),
    )


SECTION = """
section AS (
  SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS ord,
    CAST(n_nationkey % 5 * 120 AS DOUBLE) AS x_pt, CAST(n_nationkey // 5 * 160 AS DOUBLE) AS y_pt,
    CAST(110 AS DOUBLE) AS w_pt, CAST(150 AS DOUBLE) AS h_pt FROM nation),
sec AS (
  SELECT name, ord, x_pt, y_pt, w_pt, h_pt, x_pt / 600 * 1000 AS sx0, y_pt / 800 * 1000 AS sy0,
    (x_pt + w_pt) / 600 * 1000 AS sx1, (y_pt + h_pt) / 800 * 1000 AS sy1 FROM section)
"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template sections in points; the template has one row per nation (25 rows at every scale)."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), k.cast("long").alias("ord"),
        (k % 5 * 120).cast("double").alias("x_pt"), (F.floor(k / 5) * 160).cast("double").alias("y_pt"),
        F.lit(110.0).alias("w_pt"), F.lit(150.0).alias("h_pt"),
    )


# Page labels for cross-page merging: a conversation is a document, a turn is a page, a role is a field.
LABEL = """
label AS (
  SELECT conv_id AS sample_id, turn AS page_num, 0 AS field_pos, role AS field_name, text AS content,
    '64 ' || CASE WHEN turn % 2 = 0 THEN '92' ELSE '316' END || ' 1620 ' || (900 + turn * 20) AS bbox, 'Text' AS type
  FROM conversations
  UNION ALL
  SELECT conv_id, turn, 1, 'Footer', CASE WHEN turn % 3 = 2 THEN '  ' ELSE ' page ' || turn || ' ' END,
    '10 1100 50 1134', 'Text' FROM conversations
  UNION ALL
  SELECT conv_id, turn, 2, 'REMARK', 'note ' || turn, '', 'Text' FROM conversations WHERE turn < 2)
"""


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page label rows (sample_id, page_num, field_pos, field_name, content, bbox, type)."""
    turn = F.col("turn")
    c = table(spark, sf_dir, "conversations")
    head = [F.col("conv_id").alias("sample_id"), turn.alias("page_num")]
    text = c.select(
        *head, F.lit(0).alias("field_pos"), F.col("role").alias("field_name"), F.col("text").alias("content"),
        F.concat(
            F.lit("64 "), F.when(turn % 2 == 0, F.lit("92")).otherwise(F.lit("316")), F.lit(" 1620 "),
            (900 + turn * 20).cast("string"),
        ).alias("bbox"),
        F.lit("Text").alias("type"),
    )
    footer = c.select(
        *head, F.lit(1), F.lit("Footer"),
        F.when(turn % 3 == 2, F.lit("  ")).otherwise(F.concat(F.lit(" page "), turn.cast("string"), F.lit(" "))),
        F.lit("10 1100 50 1134"), F.lit("Text"),
    )
    remark = c.filter("turn < 2").select(
        *head, F.lit(2), F.lit("REMARK"), F.concat(F.lit("note "), turn.cast("string")), F.lit(""), F.lit("Text")
    )
    return text.union(footer).union(remark)


# Table parts: 12 orders form a document, 4 orders a page; every page repeats a two-row header.
def table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows in long form (sample_id, field_name, page_num, row_pos, row)."""
    k = F.col("o_orderkey")
    o = spread(table(spark, sf_dir, "orders"))
    td = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    data = F.concat(
        F.lit("<tr>"), td(k % 12 + 1), td(F.col("o_orderpriority")), td(F.col("o_totalprice").cast("long")), F.lit("</tr>")
    )
    head0 = F.lit("<tr><td colspan='3'>Orders</td></tr>")
    head1 = F.lit("<tr><td>No</td><td>Priority</td><td>Total</td></tr>")
    rows = F.when(
        k % 4 == 0,
        F.array(
            F.struct(F.lit(0).alias("row_pos"), head0.alias("row")),
            F.struct(F.lit(1).alias("row_pos"), head1.alias("row")),
            F.struct(F.lit(2).alias("row_pos"), data.alias("row")),
        ),
    ).otherwise(F.array(F.struct((k % 4 + 2).cast("int").alias("row_pos"), data.alias("row"))))
    return o.select(
        F.floor(k / 12).alias("sample_id"), F.lit("ORDERS").alias("field_name"), F.floor(k % 12 / 4).alias("page_num"),
        F.inline(rows),
    )


# Table labels: the same tables as page HTML. Of every three documents one closes its rows as ``</tr >``, one repeats a row numbered 0 on
# its further pages; in one of five the second page has no table.
TABLE_LABEL = """
tpage AS (SELECT o_orderkey // 12 AS sample_id, o_orderkey % 12 // 4 AS page_num, count(*) AS n, min(o_orderkey % 12 + 1) AS first_stt, max(o_orderkey % 12 + 1) AS last_stt
  FROM orders GROUP BY 1, 2),
tpart AS (SELECT *, sample_id % 3 AS kind, page_num = 1 AND sample_id % 5 = 4 AS gone, row_number() OVER w - 1 AS part, count(*) OVER (PARTITION BY sample_id) AS parts
  FROM tpage WINDOW w AS (PARTITION BY sample_id ORDER BY page_num)),
tseen AS (SELECT *, last_value(CASE WHEN gone THEN NULL ELSE last_stt END IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM tpart)
"""


def table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page label rows whose content is an HTML table."""
    rows = table_parts(spark, sf_dir)
    sample, page = F.col("sample_id"), F.col("page_num")
    g = rows.groupBy("sample_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("row_pos", "row"))).alias("r"))
    r = F.transform("r", lambda x: x["row"])
    carried = F.lit("<tr><td>0</td><td>Carried</td><td>7</td></tr>")
    r = F.when((sample % 3 == 2) & (page > 0), F.concat(F.slice(r, 1, 2), F.array(carried), F.slice(r, 3, 1000))).otherwise(r)
    html = F.array_join(r, "")
    html = F.when(sample % 3 == 1, F.replace(html, F.lit("</tr>"), F.lit("</tr >"))).otherwise(html)
    return g.select(
        "sample_id", page.cast("long").alias("page_num"), F.lit(0).alias("field_pos"), F.lit("ORDERS").alias("field_name"),
        F.when((page == 1) & (sample % 5 == 4), F.lit("no table")).otherwise(F.concat(F.lit("<table>"), html, F.lit("</table>"))).alias("content"),
        F.concat(F.lit("64 "), F.when(page % 2 == 1, "92").otherwise("316"), F.lit(" 1620 1000")).alias("bbox"), F.lit("Table").alias("type"),
    )


# Tuning runs: a customer is a run, its iterations come from the orders of that customer block.
EVAL = """
ev AS (
  SELECT o_orderkey // 8 AS run_id, o_orderkey % 8 AS iteration,
    least(1, o_custkey % 100 / CAST(80 AS DOUBLE)) AS coverage, o_totalprice % 1000 / 900 AS llm_judge
  FROM orders),
eval_run AS (
  SELECT *, CAST(0.5 AS DOUBLE) * coverage + CAST(0.5 AS DOUBLE) * greatest(0, least(1, llm_judge)) AS composite FROM ev)
"""


def eval_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuning evaluations: eight iterations per run."""
    from tracelake.functions.scoring import composite_score

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.floor(k / 8).alias("run_id"), (k % 8).alias("iteration"),
        F.least(F.lit(1.0), F.col("o_custkey") % 100 / F.lit(80.0)).alias("coverage"),
        (F.col("o_totalprice") % 1000 / 900).alias("llm_judge"),
    ).withColumn("composite", composite_score(F.col("coverage"), F.col("llm_judge")))


# Scenario measurements: a line item is one request of a scenario (return flag, line status).
MEASURE = """
measure AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'round1' ELSE 'round2' END AS round,
    l_returnflag || l_linenumber AS scenario_id, l_orderkey AS request_idx, l_discount < 0.1 AS ok,
    l_quantity / 4 + l_tax AS latency_s, CAST(l_partkey % 5000 AS BIGINT) AS prompt_tokens,
    CAST(l_suppkey % 700 AS BIGINT) AS completion_tokens
  FROM lineitem)
"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "round1").otherwise("round2").alias("round"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("scenario_id"),
        F.col("l_orderkey").alias("request_idx"), (F.col("l_discount") < 0.1).alias("ok"),
        (F.col("l_quantity") / 4 + F.col("l_tax")).alias("latency_s"),
        (F.col("l_partkey") % 5000).alias("prompt_tokens"), (F.col("l_suppkey") % 700).alias("completion_tokens"),
    )


# Workers: one per nation (25 rows at every scale).
WORKER = """
worker AS (
  SELECT n_name AS worker_id, CASE WHEN n_regionkey < 2 THEN 'long' ELSE 'short' END AS pool, CAST(n_nationkey AS BIGINT) AS pos,
    CAST(n_nationkey * 731 % 9000 AS BIGINT) AS queue_prefill_tokens,
    CAST(12000 + n_nationkey * 500 AS DOUBLE) AS prefill_tps, CAST(900 + n_nationkey * 40 AS DOUBLE) AS decode_tps
  FROM nation)
"""


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("worker_id"),
        F.when(F.col("n_regionkey") < 2, "long").otherwise("short").alias("pool"), k.cast("long").alias("pos"),
        (k * 731 % 9000).cast("long").alias("queue_prefill_tokens"),
        (12000 + k * 500).cast("double").alias("prefill_tps"), (900 + k * 40).cast("double").alias("decode_tps"),
    )


# Prompts to route: documents with a chat payload.
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat payload JSON per document: plain message, block list, or bare prompt."""
    t = F.col("text")
    kind = F.col("doc_id") % 3
    plain = F.to_json(F.struct(F.array(F.struct(t.alias("content"))).alias("messages")))
    listed = F.to_json(
        F.struct(F.array(F.struct(F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content"))).alias("messages"))
    )
    bare = F.to_json(F.struct(t.alias("prompt")))
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.when(kind == 0, plain).when(kind == 1, listed).otherwise(bare).alias("payload")
    )
