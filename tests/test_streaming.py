"""Streaming jobs on small bounded input."""

from pyspark.sql import functions as F

from tracelake.operators.ordered import position_chunk
from tracelake.session import scratch_dir
from tracelake.streaming import jobs

EVENTS = "request_id string, at_ms long, seq int, kind string"


def run_latency(spark, rounds, timeout_s, every=False):
    """Feed one file per round and collect what the stream emits, by request or every row."""
    jobs.use_rocksdb(spark)
    src, out, ckpt = (scratch_dir(spark, n) for n in ("in", "out", "ckpt"))
    for rows in rounds:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENTS).parquet(src).withColumn("event_ts", F.timestamp_millis("at_ms"))
        jobs.append_stream(jobs.request_latency_stream(stream, timeout_s, "1 second"), out, ckpt).awaitTermination()
    rows = spark.read.parquet(out).collect()
    return rows if every else {r["request_id"]: r for r in rows}


def test_latency_across_batches_and_timeout(spark):
    first = [("a", 1000, 0, "start"), ("a", 1100, 1, "token"), ("b", 1000, 0, "start"), ("b", 1500, 1, "token")]
    second = [("a", 1130, 3, "token"), ("a", 1110, 2, "token"), ("a", 1200, 4, "done")]
    later = [("c", 9_000_000, 0, "start"), ("c", 9_000_001, 1, "error")]
    got = run_latency(spark, [first, second, later], 60)
    a = got["a"]
    assert (a["ttft_ms"], a["tbt_ms"], a["output_tokens"], a["latency_ms"], a["error"]) == (100.0, 15.0, 3, 200.0, None)
    assert got["c"]["error"] == "error" and got["c"]["ttft_ms"] is None
    assert got["b"]["error"] == "timeout" and got["b"]["ttft_ms"] == 500.0


def test_one_row_per_request_however_events_are_dealt(spark):
    late = [("a", 1000, 0, "start"), ("a", 1300, 3, "done"), ("b", 1000, 0, "start")]
    after = [("a", 1100, 1, "token"), ("a", 1200, 2, "token"), ("b", 1050, 1, "token")]
    then = [("b", 1100, 2, "done"), ("a", 1250, 2, "token"), ("d", 1000, 0, "start")]
    far = [("z", 400_000, 0, "start"), ("z", 400_001, 1, "done")]
    again = [("d", 401_000, 1, "token"), ("y", 900_000, 0, "error")]
    jobs.use_rocksdb(spark)
    rows = run_latency(spark, [late, after, then, far, again, [("x", 2_000_000, 0, "error")]], 60, every=True)
    assert sorted((r["request_id"], r["error"], r["output_tokens"]) for r in rows) == [
        ("a", None, 0), ("b", None, 1), ("d", "timeout", 0), ("x", "error", 0), ("y", "error", 0), ("z", None, 0)
    ]


def test_load_reads_a_bounded_number_of_batches(spark, monkeypatch):
    monkeypatch.setattr(jobs, "SNAPSHOT_EVERY", 3)
    src, out, ckpt = (scratch_dir(spark, n) for n in ("in", "out", "ckpt"))
    schema, want = "w string, pos long, delta long, tokens long", {}
    for k in range(8):
        rows = [(f"w{(k * j) % 4}", 10 * k + j, 1 if (k + j) % 3 else -2, 5 * j - 10) for j in range(6)]
        for w, _, delta, tokens in rows:
            x, y = want.get(w, (0, 0))
            want[w] = max(0, x + delta), max(0, y + tokens)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.load_stream(stream, out, ckpt, "w", ["pos"], position_chunk(F.col("pos")), "delta", "tokens").awaitTermination()
    got = {r["w"]: (r["inflight"], r["queued_tokens"]) for r in jobs.latest_updates(spark, out, ["w"]).collect()}
    assert got == want
    assert len(jobs._rows_before(spark, out, 8).inputFiles()) < 8 * 3


def test_a_request_repeated_a_day_later_is_not_stored(spark):
    src, out, ckpt = (scratch_dir(spark, n) for n in ("in", "out", "ckpt"))
    for day in range(3):
        spark.createDataFrame([("r1", day * 86_400_000), (f"n{day}", day * 86_400_000)], "request_id string, at_ms long").write.mode("append").parquet(src)
        stream = spark.readStream.schema("request_id string, at_ms long").parquet(src).withColumn("at", F.timestamp_millis("at_ms"))
        jobs.persist_stream(stream, out, ckpt, "request_id", "at").awaitTermination()
    assert sorted(r["request_id"] for r in spark.read.parquet(out).collect()) == ["n0", "n1", "n2", "r1"]


def test_prefix_history_evicts(spark):
    jobs.use_rocksdb(spark)
    src, out, ckpt = (scratch_dir(spark, n) for n in ("in", "out", "ckpt"))
    seq = ["p0"] + [f"p{i}" for i in range(1, 65)] + ["p0", "p64", "", "p64"]
    schema = "worker_id string, pos long, prefix_hash string"
    spark.createDataFrame([("w", i, p) for i, p in enumerate(seq)], schema).coalesce(1).write.parquet(src)
    jobs.append_stream(jobs.prefix_hits_stream(spark.readStream.schema(schema).parquet(src)), out, ckpt).awaitTermination()
    hits = [r["hit"] for r in spark.read.parquet(out).orderBy("pos").collect()]
    assert hits == [False] * 65 + [False, True, False, True]


def test_persist_once_over_restart(spark):
    src, out, ckpt = (scratch_dir(spark, n) for n in ("in", "out", "ckpt"))
    for _ in range(2):
        spark.createDataFrame([("r1", 1000), ("r2", 2000), ("r1", 1000)], "request_id string, at_ms long").write.mode("append").parquet(src)
        stream = spark.readStream.schema("request_id string, at_ms long").parquet(src).withColumn("at", F.timestamp_millis("at_ms"))
        jobs.persist_stream(stream, out, ckpt, "request_id", "at").awaitTermination()
    assert sorted(r["request_id"] for r in spark.read.parquet(out).collect()) == ["r1", "r2"]


def test_a_table_is_streamed_as_one_file_or_as_a_folder(spark):
    from tracelake.plans import streams

    one = "/root/testdata/sf0.001"
    folder = scratch_dir(spark, "tables")
    spark.read.parquet(f"{one}/documents.parquet").repartition(3).write.parquet(f"{folder}/documents.parquet")
    a, b = (sorted(map(tuple, streams.r04(spark, sf).collect()), key=str) for sf in (one, folder))
    assert a and a == b


def test_requests_of_one_bucket_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jobs, "LATENCY_BUCKETS", 2)
    ids = [f"q{i}" for i in range(40)]
    first = [(r, 1000 + 10 * i, 0, "start") for i, r in enumerate(ids)]
    first += [(r, 1005 + 10 * i + k * k, k, "token") for i, r in enumerate(ids) for k in range(1, i % 5 + 1)]
    ends = [(r, 2000 + i, 9, "error" if i % 7 == 0 else "done") for i, r in enumerate(ids) if i % 4]
    far = [("z", 400_000, 0, "start"), ("z", 400_001, 1, "done")]
    got = run_latency(spark, [first[::-1], ends, far], 60, every=True)
    assert len(got) == 41
    for r in got:
        if r["request_id"] != "z":
            i = int(r["request_id"][1:])
            n = i % 5
            gaps = sorted(2 * k + 1 for k in range(1, n))
            gaps = gaps[1:-1] if len(gaps) > 2 else gaps
            tbt = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2 if gaps and n > 2 else None
            end = 2000 + i if i % 4 else 1005 + 10 * i + n * n if n else 1000 + 10 * i
            error = "timeout" if i % 4 == 0 else "error" if i % 7 == 0 else None
            assert (r["ttft_ms"], r["tbt_ms"], r["output_tokens"], r["latency_ms"], r["error"]) == (
                6.0 if n else None, tbt, n, float(end - 1000 - 10 * i), error
            )
