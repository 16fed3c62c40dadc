"""Trace building, retiming, sampling and routing on small rows."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators import routing, trace


def test_allocate_mix(spark):
    mix = spark.createDataFrame([("conversation", 0.31), ("tool_agent", 0.59), ("long_context", 0.10)], "w string, s double")
    got = {r["w"]: r["n"] for r in trace.allocate_mix(mix, "w", "s", 500).collect()}
    assert got == {"conversation": 155, "tool_agent": 295, "long_context": 50}
    thirds = spark.createDataFrame([("a", 1 / 3), ("b", 1 / 3), ("c", 1 / 3)], "w string, s double")
    assert {r["w"]: r["n"] for r in trace.allocate_mix(thirds, "w", "s", 11).collect()} == {"a": 3, "b": 4, "c": 4}


def test_even_split(spark):
    got = trace.even_split(spark.range(10).withColumnRenamed("id", "pos"), "pos", 3).groupBy("bucket").count().collect()
    assert {r["bucket"]: r["count"] for r in got} == {1: 4, 2: 3, 3: 3}


def test_sized_sessions(spark):
    req = spark.range(0, 20, 2).withColumnRenamed("id", "pos")
    sizes = spark.createDataFrame([(0, 4), (1, 5), (2, 8)], "no long, size long")
    got = [r["cache_session_id"] for r in trace.sized_sessions(req, "pos", sizes, "no", "size").orderBy("pos").collect()]
    assert got == ["sess-0000"] * 4 + ["sess-0001"] * 5 + ["sess-0002"]


def test_retime_same_session(spark):
    rows = [(0, "a"), (1, "a"), (2, None), (3, "b"), (4, "a"), (5, None)]
    df = spark.createDataFrame(rows, "pos long, s string").withColumn("suite", F.lit("x"))
    got = [r["new_ts"] for r in trace.retime_same_session(df, ["suite"], "pos", "s").orderBy("pos").collect()]
    assert got == [50, 50, 80, 130, 50, 210]


def test_cyclic_join(spark):
    pool = spark.createDataFrame([(10, "x"), (20, "y"), (30, "z")], "k long, v string")
    got = trace.cyclic_join(spark.range(7).withColumnRenamed("id", "slot"), "slot", pool, "k").orderBy("slot").collect()
    assert [r["v"] for r in got] == list("xyzxyzx")


def test_budget_guard(spark):
    df = spark.createDataFrame([("r1", 90, 5), ("r2", 90, 50)], "request_id string, input_length long, output_length long")
    assert trace.over_budget(df, 120, 10).select("request_id").first()[0] == "r2"
    with pytest.raises(Exception, match="context budget exceeded by r2"):
        trace.require_budget(df, 120, 10).collect()


def test_routing_bands(spark):
    df = spark.createDataFrame([(1, 5999), (2, 6000), (3, 12001), (4, 9000)], "id int, est long")
    got = {r["id"]: (r["pool"], r["method"]) for r in routing.resolve_routing(df, "id", "est", 8000).collect()}
    assert got == {1: ("short", "fast-short"), 2: ("short", "estimate"), 3: ("long", "fast-long"), 4: ("long", "estimate")}
    exact = spark.createDataFrame([(2, 8100), (1, 99999)], "id int, n_tokens long")
    got = {r["id"]: (r["pool"], r["tokens"], r["method"]) for r in routing.resolve_routing(df, "id", "est", 8000, exact).collect()}
    assert got[2] == ("long", 8100, "tokenize") and got[1] == ("short", 5999, "fast-short")


def test_any_fleet_gives_the_answer_of_one_array(spark, monkeypatch):
    rows = [(f"w{k}", "short" if k % 3 else "long", k, k * 37 % 11, 1.0 + k % 4, 2.0 + k % 5) for k in range(23)]
    fleet = spark.createDataFrame(rows, "worker_id string, pool string, pos long, queue_prefill_tokens long, prefill_tps double, decode_tps double")
    asks = [(k, 100 * k % 700, 10 + k, f"p{k % 7}" if k % 4 else "", "m") for k in range(40)]
    df = spark.createDataFrame(asks, "id int, tokens long, max_tokens long, prefix_hash string, method string")
    recent = spark.createDataFrame([("p1", "w4"), ("p2", "w5")], "prefix_hash string, worker_id string")

    def answers():
        best = routing.select_worker(df, fleet, 400, recent)
        return sorted(tuple(r) for r in best.collect()), sorted((r.id, r.worker_id) for r in routing.rendezvous_worker(df, "prefix_hash", fleet).collect())

    whole = answers()
    assert len(whole[0]) == 40
    monkeypatch.setattr(routing, "WORKERS_PER_BLOCK", 5)
    assert answers() == whole
    monkeypatch.setattr(routing, "SMALL_FLEET", 0)
    assert answers() == whole
    none = routing.select_worker(df, fleet.limit(0), 400)
    assert {r.worker_id for r in none.collect()} == {None}


def test_load_floor(spark):
    rows = [("w", 1, 1, 10), ("w", 2, -1, -10), ("w", 3, -1, -5), ("w", 4, 1, 7), ("w", 5, 1, 2), ("w", 6, -1, -3)]
    df = spark.createDataFrame(rows, "w string, t long, d long, tok long")
    got = routing.worker_load(df, "w", ["t"], F.floor(F.col("t") / 2), "d", "tok").orderBy("t").collect()
    n = q = 0
    for (_, _, d, tok), r in zip(rows, got):
        n, q = max(0, n + d), max(0, q + tok)
        assert (r["inflight"], r["queued_tokens"]) == (n, q)


def test_positions_of_sessions(spark):
    rows = [(s, p) for s, n in ((7, 3), (-2, 5), (40, 1)) for p in range(n)]
    df = spark.createDataFrame([(s, p * 10, "x") for s, p in rows], "session long, pos long, extra string")
    got = {(r.session, r.pos // 10): r.at for r in trace.session_positions(df, "session", "pos", "at").collect()}
    assert got == {key: k + 1 for k, key in enumerate(sorted(rows))}
