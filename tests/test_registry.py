"""A sample of registered queries against their DuckDB twins on the smallest tables."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a01_effective_rate", "a02_latency_summary", "a16_prefix_reuse", "a20_arrival_statistics", "a29_replay_summary", "f13_natural_truncate",
    "j12_assign_hybrid", "j17_select_worker", "p11_resolve_routing", "r05_worker_load", "t06_assign_mix", "w08_session_order",
    "x01_extract_blocks", "x08_merge_documents", "x16_parse_runs",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(check.norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert cols == sorted(names)
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert got == sorted(tuple(check.norm(r[i]) for i in order) for r in res.fetchall())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 1


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
