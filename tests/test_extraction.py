from pyspark.sql import functions as F

from tracelake.operators import compare, extraction, layout

BLOCK = "p long, pos long, schema string, text string, label string, x0 double, y0 double, x1 double, y1 double"


def test_payload_takes_the_last_value_and_fills_what_is_missing(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "Name", "old", "Text", 0.0, 0.0, 1.0, 1.0), (1, 2, "Name", "new", "Text", 1.0, 1.0, 2.0, 2.0), (1, 1, None, "plain", "Image", 0.0, 0.0, 1.0, 1.0), (None, 0, "Name", "lost", "Text", 0.0, 0.0, 1.0, 1.0)], BLOCK
    )
    tree = spark.createDataFrame([(1, 0, " Name "), (1, 1, "name"), (1, 2, None), (2, 0, "Name"), (None, 0, "Name")], "p long, ord long, n string")
    pages = spark.createDataFrame([(1,), (2,), (3,), (None,)], "p long")
    got = {r.p: r for r in extraction.layout_payload(pages, "p", blocks, tree, "n", "ord", {"model": F.lit("m")}).collect()}
    assert [(s.name, s.extracted and s.extracted.text) for s in got[1].layout_with_values] == [(" Name ", "new"), ("name", None), (None, None)]
    assert [b.text for b in got[1].blocks] == ["old", "plain", "new"]
    assert list(got[1].flat_by_schema) == ["Name"] and got[1].flat_by_schema["Name"].x0 == 1.0 and got[1].meta.model == "m"
    assert [s.extracted for s in got[2].layout_with_values] == [None] and got[2].flat_by_schema == {} and got[2].blocks == []
    assert got[3].layout_with_values == [] and got[None].layout_with_values[0].extracted.text == "lost"
    assert extraction.layout_payload(pages.limit(0), "p", blocks, tree, "n", "ord").count() == 0


def report(spark, expected, found):
    e = spark.createDataFrame(expected, "k string, n string, ord int")
    f = spark.createDataFrame(found, "k string, n string, pos int")
    return e, f, {r.k: r for r in extraction.field_report(e, f, ["k"], "n", "ord", "pos").collect()}


def test_field_report(spark):
    expected = [("a", "z", 0), ("a", "y", 1), ("a", "x", 2), ("a", "y", 3), (None, "q", 0)]
    found = [("a", " z ", 5), ("a", "z", 1), ("a", "other", 4), ("a", "other", 0), ("a", "", 2), ("a", None, 3), ("b", "w", 0)]
    e, f, got = report(spark, expected, found)
    r = got["a"]
    assert (r.coverage, r.extracted, r.total_fields) == (0.25, 2, 4)
    assert r.missing_fields == ["y", "x", "y"] and r.duplicate_schemas == ["other", "z"]
    assert (got["b"].coverage, got["b"].total_fields, got["b"].missing_fields) == (1.0, 0, [])
    assert (got[None].coverage, got[None].missing_fields) == (0.0, ["q"])
    scores = spark.createDataFrame([("a", 2.0, "fine"), ("c", 0.5, None), (None, None, "?")], "k string, judge double, feedback string")
    rec = {r.k: r for r in extraction.evaluation_records(scores, e, f, ["k"], "n", "ord", "pos", "judge").collect()}
    assert rec["a"].composite_score == 0.625 and rec["a"].feedback == "fine"
    assert (rec["c"].coverage, rec["c"].composite_score, rec["c"].missing_fields) == (1.0, 0.75, [])
    assert len(rec) == 3 and extraction.field_report(e.limit(0), f.limit(0), ["k"], "n", "ord", "pos").count() == 0


def test_prompt_summary(spark):
    e, f, _ = report(spark, [("a", "x", 0), ("b", "x", 0), ("b", "y", 1)], [("a", "x", 0)])
    d = extraction.field_report(e, f, ["k"], "n", "ord", "pos").withColumn("label", F.lit("A"))
    r = extraction.prompt_summary(d, "label").first()
    assert (r.n_pages, r.total_fields, r.missing, r.complete_pages) == (2, 3, 2, 1) and abs(r.coverage - 1 / 3) < 1e-12
    assert {(r.field, r.n_pages) for r in extraction.missing_by_prompt(d, "label").collect()} == {("x", 1), ("y", 1)}


def test_fewshots_leave_out_what_is_malformed(spark):
    rows = [("k", 2, None, "[1]", '{"a": 1}'), ("k", 0, "T", "[]", "{}"), ("k", 1, "bad", "{}", "{}"), ("k", 3, "bad", None, "{}"), ("k", 4, "bad", "[1", "{}"), ("e", 0, "bad", "[1]", "[1]")]
    shots = spark.createDataFrame(rows, "k string, pos int, title string, f string, a string")
    got = {r.k: r.text for r in extraction.render_fewshots(shots, ["k"], "pos", "title", [("In:", "f", "array"), ("Out:", "a", "object")]).collect()}
    assert got == {"k": '### T\nIn:\n[]\nOut:\n{}\n\n### Example 3\nIn:\n[1]\nOut:\n{"a": 1}\n', "e": ""}


def test_sweeps_need_their_serial_run(spark):
    rows = [("r", 1, 10.0), ("r", 2, 5.0), ("r", 4, None), ("s", 2, 1.0), (None, 1, 0.0), (None, 8, 3.0)]
    d = spark.createDataFrame(rows, "round string, ccu int, wall double")
    got = {(r["round"], r.ccu): (r.wall_vs_serial, r.wall_better) for r in compare.concurrency_sweep(d, ["round"], "ccu", {"wall": True}).collect()}
    assert got == {("r", 2): (-50.0, True), ("r", 4): (None, None), (None, 8): (None, None)}
    pair = compare.setting_sweep(d.filter("round = 'r'"), d.filter("round = 's'"), "ccu", {"wall": True}).collect()
    assert [(r.ccu, r.wall_before, r.wall_after, r.wall_delta) for r in pair] == [(2, 5.0, 1.0, -80.0)]


def test_labels_from_a_long_list_of_names(spark, monkeypatch):
    names = spark.createDataFrame([(f"Tên {i}", i) for i in range(9)] + [("ten 3", 20)], "n string, o int")
    rows = [
        (1, "ten 4", ["Tên 5: v"], "Text", "t"), (2, "none", ["x", "TEN 6: v", "Tên 7: v"], "Text", "t"), (3, None, ["Tên 3"], "Text", "t"),
        (4, None, ["a"], "Section-Header", "tên 8"), (5, None, ["nothing"], "Image", ""), (5, None, ["nothing"], "Image", ""), (6, "", [], "Text", None),
    ]
    blocks = spark.createDataFrame(rows, "id int, schema string, lines array<string>, label string, text string")
    small = sorted((r.id, r.assigned or "") for r in layout.label_blocks(blocks, names, "n", "o").collect())
    assert small == [(1, "Tên 4"), (2, "Tên 6"), (3, "Tên 3"), (4, "Tên 8"), (5, ""), (5, ""), (6, "")]
    monkeypatch.setattr(layout, "MAX_SECTIONS", 4)
    out = layout.label_blocks(blocks, names, "n", "o")
    assert out.columns == [*blocks.columns, "assigned"]
    assert sorted((r.id, r.assigned or "") for r in out.collect()) == small
