"""Chunked ordered scans against one plain pass, with chunks of three rows and a hot key."""

import random

from pyspark.sql import functions as F

from tracelake.operators.ordered import ordered_scan, position_chunk


def test_matches_single_pass(spark):
    rnd = random.Random(5)
    rows = []
    for key, n in (("hot", 50), ("b", 4), (None, 9), ("one", 1)):
        pos = sorted(rnd.sample(range(200), n))
        rows += [(key, p, rnd.choice([None, rnd.randint(-9, 9)])) for p in pos]
    df = spark.createDataFrame(rows, "k string, pos long, v int")
    out = ordered_scan(
        df, ["k"], ["pos"], position_chunk(F.col("pos"), 3), rank="r", total="n", sums={"s": F.col("v")}, maxes={"m": F.col("v")},
        lags={"l": F.col("v")}, lasts={"f": F.col("v")}, firsts={"b": F.col("v")},
        prevs={"p": F.col("v")}, wholes={"w": ("max", F.col("pos"))},
    )
    got = {(r["k"], r["pos"]): r for r in out.collect()}
    groups = {}
    for k, p, v in rows:
        groups.setdefault(k, []).append((p, v))
    assert len(got) == len(rows)
    for k, seq in groups.items():
        total, best, last, prev = 0, None, None, None
        for i, (p, v) in enumerate(sorted(seq)):
            r = got[(k, p)]
            total += v or 0
            best = v if best is None else (best if v is None else max(best, v))
            before, last = last, v if v is not None else last
            assert (r["p"], r["w"]) == (before, max(seq)[0])
            assert (r["r"], r["n"], r["s"], r["m"], r["l"], r["f"], r["b"]) == (i + 1, len(seq), total, best, prev, last, sorted(seq)[0][1])
            prev = v


def test_no_key(spark):
    df = spark.range(0, 20, 1, 4).withColumnRenamed("id", "pos")
    out = ordered_scan(df, [], ["pos"], position_chunk(F.col("pos"), 6), rank="r", sums={"s": F.col("pos")}).orderBy("pos").collect()
    assert [r["r"] for r in out] == list(range(1, 21))
    assert [r["s"] for r in out] == [sum(range(i + 1)) for i in range(20)]
