import json

import pytest
from pyspark.sql import functions as F

from tracelake.session import scratch_dir
from tracelake.sources import readers, sinks


def test_page_files(spark, tmp_path):
    for name, doc in {
        "sample_000014_page_0002.json": {"B": {"content": "b", "bbox": "1 2 3 4", "type": "Text"}, "A": {"content": "a2"}},
        "sample_000014_page_0001.json": {"A": {"content": "a1", "type": "Table"}},
        "notes.json": {"A": {"content": "no"}},
    }.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=2), encoding="utf-8")
    d = readers.read_page_files(spark, str(tmp_path)).orderBy("page_num", "field_pos")
    assert [(r["sample_id"], r["page_num"], r["field_pos"], r["field_name"]) for r in d.collect()] == [
        ("000014", 1, 0, "A"), ("000014", 2, 0, "B"), ("000014", 2, 1, "A"),
    ]
    assert readers.read_page_files(spark, str(tmp_path), "000014", 1).count() == 1


def test_page_packs_hold_the_same_pages_in_fewer_files(spark, tmp_path):
    page = F.col("id") % 50
    pages = spark.range(300).select(
        F.floor(F.col("id") / 50).alias("sample_id"), page.alias("page_num"),
        F.concat(F.lit('{"B": {"content": "line 1\\n'), "id", F.lit('"},\n "A": {"content": "", "bbox": "1 2 3 4"}}')).alias("value"),
    )
    pages = pages.unionByName(spark.range(1).selectExpr("123456789L AS sample_id", "12345L AS page_num", """'{"C": {}}' AS value"""))
    pages.coalesce(2).write.partitionBy("sample_id", "page_num").text(str(tmp_path / "loose"))
    packs = sinks.pack_page_files(pages.coalesce(2), str(tmp_path / "packs"))

    def rows(d):
        return sorted(tuple(r) for r in d.withColumn("sample_id", F.col("sample_id").cast("long")).fillna("-").collect())

    want = rows(readers.read_page_files(spark, str(tmp_path / "loose"), pattern=readers.PAGE_FOLDER))
    assert rows(readers.read_page_files(spark, packs, packed=True)) == want and len(want) == 601
    assert len(list((tmp_path / "packs").glob("*.parquet"))) == 2
    assert readers.read_page_files(spark, packs, "000003", 2, packed=True).count() == 4


def test_page_query_writes_no_file_per_page(spark, tmp_path, monkeypatch):
    from tracelake.plans import storage

    monkeypatch.setattr(storage, "scratch_dir", lambda spark, label: str(tmp_path / label))
    n = storage.s05(spark, "/root/testdata/sf0.001").select("sample_id", "page_num").distinct().count()
    assert n == 87 and len([f for f in tmp_path.rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]) < n / 2


def test_jsonl_blank_lines_and_missing(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(f), "a int").count() == 2
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    assert readers.read_jsonl(spark, str(f), "a int", limit=1).count() == 1


def test_corpus_keys(spark, tmp_path):
    (tmp_path / "Exam").mkdir()
    (tmp_path / "Exam" / "math.jsonl").write_text('{"a": 1}\n')
    r = readers.read_corpus(spark, str(tmp_path), "a int").first()
    assert (r["file"], r["config"], r["stem"]) == ("Exam/math.jsonl", "Exam", "math")


def test_run_blocks(spark, tmp_path):
    from tracelake.operators.compare import parse_runs

    block = (
        "head\n==== CONFIG ====\nseed: 3\npolicy: p\n  env_name: swm/PushT-v1\n  num_eval: 4\n  eval_budget: 50\n"
        "\n==== RESULTS ====\nx {'success_rate': 75.0, 'episode_successes': array([ True, False,\n        True,  True])}\nevaluation_time: 20.0 seconds\n"
    )
    (tmp_path / "a_results.txt").write_text(block + "\n==== CONFIG ====\nseed: 4\nno results")
    rows = parse_runs(readers.read_run_blocks(spark, str(tmp_path)), "value").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["seed"], r["env"], r["success_rate"], r["num_successes"], r["planning_time_per_step"]) == (3, "pusht", 75.0, 3, 0.1)


def test_export_formats_and_upsert(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    with pytest.raises(ValueError):
        sinks.export_dataset(df, "/nowhere", "xlsx")
    path = sinks.export_dataset(df, scratch_dir(spark, "export"), "csv", ["s"])
    assert spark.read.option("header", True).csv(path).agg(F.sum("n")).first()[0] == 3
    new = spark.createDataFrame([("b", 9)], "s string, n int")
    assert sorted(tuple(r) for r in sinks.upsert(df, new, "s").collect()) == [("a", 1), ("b", 9)]


def test_require_tables(spark):
    full, empty = spark.range(2), spark.range(0)
    sinks.require_tables({"x": full, "y": empty}, [["x"], ["y", "x"]])
    with pytest.raises(ValueError, match="missing source tables: y"):
        sinks.require_tables({"x": full, "y": empty}, [["y"]])
