"""Order statistics against sorting in Python, on every code path."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import quantiles as q

RANKS = [
    q.linear("l50", 50), q.linear("l90", 90), q.floor_index("f90", 90), q.upper_median("um"), q.rounded_index("r50", 0.5),
    q.truncated_index("t50", 0.5),
]


def expected(values):
    s = sorted(values)
    n = len(s)

    def linear(p):
        k = (n - 1) * p / 100
        f = int(k)
        c = min(f + 1, n - 1)
        return s[f] + (s[c] - s[f]) * (k - f)

    return {
        "l50": linear(50), "l90": linear(90), "f90": s[min(int(n * 90 / 100), n - 1)], "um": s[n // 2],
        "r50": s[round(0.5 * (n - 1))], "t50": s[int(0.5 * (n - 1))],
    }


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(3)
    rows = []
    for key, n in (("hot", 3000), ("tiny", 1), ("pair", 2), (None, 40)):
        for _ in range(n):
            rows.append((key, rnd.choice([rnd.uniform(-50, 900), float(rnd.randint(0, 9)), -0.0, 1e-9])))
    return rows


def check(spark, data):
    df = spark.createDataFrame([*data, ("hot", None), ("only-null", None)], "k string, v double")
    got = {r["k"]: r.asDict() for r in q.order_statistics(df, ["k"], "v", RANKS).collect()}
    groups = {}
    for k, v in data:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        assert math.isclose(got[k]["mean"], sum(values) / len(values), abs_tol=1e-9)
        for name, want in expected(values).items():
            assert math.isclose(got[k][name], want, abs_tol=1e-12), (k, name)


def test_narrow_path(spark, data):
    check(spark, data)


def test_narrow_path_with_splits(spark, data, monkeypatch):
    monkeypatch.setattr(q, "RANK_ROWS", 3)
    monkeypatch.setattr(q, "SPLITS", 5)
    check(spark, data)


def test_shuffled_path(spark, data, monkeypatch):
    monkeypatch.setattr(q, "MAX_TARGETS", 1)
    check(spark, data)


def test_literal_cases(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    r = q.order_statistics(df, [], "v", [*RANKS, q.floor_index("f50", 50)]).first()
    assert (r["l50"], r["l90"], r["f50"], r["f90"], r["r50"], r["t50"]) == (2.5, 3.7, 3.0, 4.0, 3.0, 2.0)


def test_histogram_zero_falls_in_no_bin(spark):
    df = spark.createDataFrame([("a", 0), ("a", 500), ("a", 501)], "k string, v int")
    got = {r["bin"]: r["n"] for r in q.histogram(df, ["k"], "v", [500, 2000]).collect()}
    assert got == {"0-500": 1, "500-2000": 1, ">2000": 0}


def test_bucket_is_monotone(spark):
    vals = sorted([0.0, -1e9, 1e9, 3.5, -3.5, 1e-12, 7.0, 7.0000001])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(q._bucket(F.col("v"))).collect()]
    assert got == sorted(got)
