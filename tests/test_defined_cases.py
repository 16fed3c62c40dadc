"""Small literal cases whose answers follow from the rules, without our own code."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import text as tx
from tracelake.functions import udfs
from tracelake.operators import layout, metrics, stitch, trace, vectors
from tracelake.operators.ordered import position_chunk
from tracelake.session import scratch_dir
from tracelake.sources import readers
from tracelake.streaming import jobs


def test_chat_messages_without_text(spark):
    block = lambda kind, text: {"type": kind, "text": text}
    payloads = [
        ({"messages": [{"content": "hello"}, {"content": None}, {"content": "bye"}]}, "hello\nbye"),
        ({"messages": [{"role": "tool"}, {"content": "x"}]}, "x"),
        ({"messages": [{"content": ["odd", block("text", "a"), {"type": "image"}, 5, block("text", None), block("text", "b")]}]}, "a\nb"),
        ({"messages": [{"content": 7}], "prompt": "p"}, "p"),
        ({"messages": [], "prompt": ["q", "r"]}, "q\nr"),
        ({}, ""),
    ]
    df = spark.createDataFrame([(json.dumps(p),) for p, _ in payloads], "p string")
    assert [r.t for r in df.select(tx.prompt_from_chat(F.col("p")).alias("t")).collect()] == [want for _, want in payloads]


def test_fold_of_many_languages(spark):
    names = {
        "Łódź Čech Şişli ﬁn": "odzcechsislifin", "Đặng Thị Hồng": "dangthihong", "Ærøskøbing": "rskbing", "Győr Ősz": "gyorosz", "Ķegums Ģirts": "kegumsgirts",
        "Ħamrun": "amrun", "Ĳssel": "ijssel", "Reykjavík": "reykjavik", "São João": "saojoao", "ＡＢ１２": "ab12", "Ǆep": "dzep", "été": "ete", "x²": "x2",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.f for r in df.select(tx.fold_latin(F.col("n")).alias("f")).collect()] == list(names.values())
    assert [udfs.fold(n) for n in names] == list(names.values())


def test_fold_over_all_latin_letters(spark):
    latin = [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)]
    codes = [c for c in latin if chr(c).lower() == chr(c)]
    df = spark.createDataFrame([(chr(c),) for c in codes], "n string")
    got = [r.f for r in df.select(tx.fold_latin(F.col("n")).alias("f")).collect()]
    assert got == [tx.fold_table().get(chr(c), "") for c in codes]


def test_page_with_members_of_other_kinds(spark):
    pages = [
        (1, '{"a": {"content": "x", "bbox": "1 2 3 4", "type": "Text"}, "n": 5, "s": "t", "l": [1]}'),
        (2, '{"fields": {"b": {"content": "y"}, "m": null}}'),
        (3, "[]"),
    ]
    df = spark.createDataFrame(pages, "page int, doc string")
    got = sorted((r.page, r.field_name, r.content, r.bbox) for r in stitch.normalize_pages(df, ["page"], "doc").collect())
    assert got == [(1, "a", "x", "1 2 3 4"), (2, "b", "y", "")]


def test_too_few_session_sizes(spark):
    rows = spark.createDataFrame([(k,) for k in range(6)], "pos long")
    sizes = spark.createDataFrame([(0, 2), (1, 2)], "no long, size long")
    got = {r.pos: r.cache_session_id for r in trace.sized_sessions(rows, "pos", sizes, "no", "size").collect()}
    assert got == {0: "sess-0000", 1: "sess-0000", 2: "sess-0001", 3: "sess-0001", 4: None, 5: None}


def test_values_attach_on_their_page(spark):
    names = spark.createDataFrame([(1, " a "), (1, "b"), (2, "a"), (2, "b")], "page int, name string")
    values = spark.createDataFrame([(1, "a", "one"), (2, "a", "two")], "page int, schema string, value string")
    got = sorted((r.page, r.name.strip(), r.value or "") for r in layout.attach_values(names, "name", values, "schema", "page").collect())
    assert got == [(1, "a", "one"), (1, "b", ""), (2, "a", "two"), (2, "b", "")]


def test_coverage_of_a_page_without_expected_fields(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b")], "page int, name string")
    found = spark.createDataFrame([(1, "a")], "page int, name string")
    pages = spark.createDataFrame([(1,), (2,)], "page int")
    assert {r.page: r.coverage for r in layout.coverage(expected, found, "page", "name", pages).collect()} == {1: 0.5, 2: 1.0}


def test_positions_that_repeat_over_suites(spark):
    rows = [(s, k, "tool_agent", f"prompt {k}", "answer", 20, 10) for s, n in (("a", 200), ("b", 40)) for k in range(n)]
    corpus = spark.createDataFrame(rows, "suite string, pos long, workload_type string, prompt string, answer string, output_length long, gap long")
    got = trace.build_trace(corpus, "compact", 8192, 256, 0.1, 0.08, 5)
    flags = {r.suite: r.n for r in got.groupBy("suite").agg(F.count_if("is_probe_slot").alias("n")).collect()}
    assert got.count() == 240
    assert flags == {"a": round(180 * 0.08), "b": round(36 * 0.08)}
    assert got.where("is_probe_slot AND is_warmup").count() == 0


def test_a_group_without_values_is_reported(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", None), (None, None)], "w string, v double")
    got = {r.w: (r.n, r.min, r.p50) for r in metrics.value_summary(df, ["w"], "v").collect()}
    assert got == {"x": (2, 1.0, 2.0), "y": (0, None, None), None: (0, None, None)}


def test_warmup_problems(spark):
    df = spark.createDataFrame([("r1", True, None, None), ("r2", False, "boom", "slow"), ("r3", False, None, None)], "id string, ok boolean, error string, warning string")
    got = sorted(tuple(r) for r in metrics.warmup_problems(df, "id").collect())
    assert got == [("failure", "r2", "boom"), ("failure", "r3", ""), ("warning", "r2", "slow")]


def test_vectors_with_nulls_and_labels_of_any_kind(spark):
    rows = [([1.0, 2.0], "a"), (None, "a"), ([3.0, None], "a"), ([3.0, 5.0], "a"), ([4.0, 4.0], None), ([6.0, 8.0], None)]
    df = spark.createDataFrame(rows, "x array<double>, label string")
    cov = {(r.grp, r.i, r.j): r["cov"] for r in vectors.covariance(df, "x", "label").collect()}
    for label, part in (("a", [[1, 2], [3, 5]]), (None, [[4, 4], [6, 8]])):
        want = np.cov(np.array(part, float).T)
        assert all(cov[label, i, j] == pytest.approx(want[i, j]) for i in range(2) for j in range(2))
    assert {r.grp: r.num_samples for r in vectors.diagnostics(df, "x", "x", "label").collect()} == {"a": 2, None: 2}


def test_covariance_of_large_numbers(spark):
    df = spark.createDataFrame([([1e9 + k],) for k in range(5)], "x array<double>")
    assert vectors.covariance(df, "x").first()["cov"] == pytest.approx(2.5)


def test_corpus_in_a_folder_with_odd_characters(spark, tmp_path):
    plain = tmp_path / "a b+c"
    (plain / "conf").mkdir(parents=True)
    (plain / "conf" / "x y+z.jsonl").write_text('{"t": "1"}\n')
    (plain / "conf" / "manifest.json").write_text('{"t": "no"}\n')
    got = readers.read_corpus(spark, str(plain), "t string", "*.jsonl").collect()
    assert [(r.t, r.file, r.config, r.stem) for r in got] == [("1", "conf/x y+z.jsonl", "conf", "x y+z")]


def test_load_floors_after_every_event(spark, tmp_path):
    src = tmp_path / "events"
    events = [("w", 1, -1, -10), ("w", 2, 1, 4), ("v", 1, 1, 3)]
    spark.createDataFrame(events, "worker string, pos long, d int, t long").coalesce(1).write.parquet(str(src))
    path, checkpoint = scratch_dir(spark, "load"), scratch_dir(spark, "checkpoint")

    def run():
        stream = spark.readStream.schema("worker string, pos long, d int, t long").parquet(str(src))
        jobs.load_stream(stream, path, checkpoint, "worker", ["pos"], position_chunk(F.col("pos")), "d", "t").awaitTermination()
        return {r.worker: (r.inflight, r.queued_tokens) for r in jobs.latest_updates(spark, path, ["worker"]).collect()}

    assert run() == {"w": (1, 4), "v": (1, 3)}
    more = [("w", 3, -1, -9), ("w", 4, -1, -1), ("w", 5, 1, 6), ("w", 6, 1, 1)]
    spark.createDataFrame(more, "worker string, pos long, d int, t long").coalesce(1).write.mode("append").parquet(str(src))
    assert run() == {"w": (2, 7), "v": (1, 3)}
