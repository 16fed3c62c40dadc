"""Notes of merged documents and rows read tag by tag: cases worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions.markup import html_rows, unescape
from tracelake.operators import provenance, stitch
from tracelake.operators.ordered import null_safe_join
from tests.test_stitch import HEAD, NAMES, labels, row


def notes(spark, rows):
    return {(r["sample_id"], r["field_name"]): r for r in provenance.merge_notes(labels(spark, rows)).collect()}


def table(*rows):
    return "<table>" + "".join(rows) + "</table>"


def test_text_and_picked_fields(spark):
    rows = [
        (1, 0, "F", "foo-"), (1, 1, "F", "bar"), (1, 2, "F", ""), (1, 3, "F", "Next."), (1, 0, "Once", "x"), (1, 1, "GHI CHÚ", "a"), (1, 2, "GHI CHÚ", "b"),
        (1, 0, "Thông tin chân trang", " p "), (2, 5, "GHI CHÚ", None),
    ]
    got = notes(spark, rows)
    assert got[1, "F"]["notes"] == [
        "page_part_0: base", "page_part_1: stitched (incomplete+continuation)", "page_part_2: concatenated with newline", "page_part_3: concatenated with newline"
    ]
    assert got[1, "F"]["source_pages"] == [0, 1, 2, 3]
    assert (got[1, "Once"]["notes"], got[1, "Once"]["source_pages"]) == (["single occurrence"], [0])
    assert (got[1, "GHI CHÚ"]["notes"], got[1, "GHI CHÚ"]["source_pages"]) == (["last page"], [2])
    assert got[1, "THÔNG TIN CHÂN TRANG"]["notes"] == ["per-page footer preserved"]
    assert got[2, "GHI CHÚ"]["notes"] == ["single occurrence"]


def test_table_fields(spark):
    top, low = "0 10 100 1000", "0 600 100 1000"
    rows = [
        (1, 0, "T", table(HEAD, NAMES, row(1, "x"), row(2, "y")), top, "Table"), (1, 1, "T", table(HEAD, NAMES, row(0, "c"), row(3, "z")), top, "Table"),
        (1, 2, "T", "gone", top, "Table"), (1, 3, "T", table(HEAD, NAMES, row(9, "q")), low, "Table"), (1, 4, "T", table(row(10, "long name")), low, "Table"),
        (2, 0, "T", "no rows here", "", "Table"), (2, 1, "T", table(row(1, "x")), "", "Table"),
    ]
    got = notes(spark, rows)
    assert got[1, "T"]["notes"] == [
        "page_part_0: kept 4 rows (incl. header)",
        "page_part_1: bbox page-cut continuation", "page_part_1: stt adjusted skip 2->3", "page_part_1: stt continuation confirmed",
        "page_part_1: skipped 3 repeated prefix rows, appended 1 rows",
        "page_part_2: no rows, skipped",
        "page_part_3: bbox weak page-cut signal", "page_part_3: skipped 2 repeated prefix rows, appended 1 rows",
        "page_part_4: bbox weak page-cut signal", "page_part_4: stt continuation confirmed", "page_part_4: appended 1 rows",
        "total_rows=7",
    ]
    assert got[2, "T"]["notes"] == ["no rows in first page"]


def test_two_tables_of_one_page_are_two_parts(spark):
    rows = [(1, 0, 0, "T", table(row(1, "x")), "", "Table"), (1, 0, 1, "T", table(row(2, "yy")), "", "Table")]
    df = spark.createDataFrame(rows, "sample_id long, page_num long, field_pos int, field_name string, content string, bbox string, type string")
    assert stitch.merge_documents(df).first()["content"] == table(row(1, "x"), row(2, "yy"))
    assert provenance.merge_notes(df).first()["notes"][-1] == "total_rows=2"


def odd_tables(spark):
    """Tables of many shapes: headers in several rows, numbers that go on or not, pages without rows, open rows, nulls."""
    rng = random.Random(5)
    out = []
    for sample in range(60):
        no, wide = 0, sample % 4 == 1
        for page in range(rng.randint(1, 9)):
            body = [HEAD, NAMES][: rng.choice([2, 2, 2, 1, 0])]
            body += ["<tr><td rowspan='2'>a</td></tr>"] * rng.choice([0, 0, 1, 2])
            for _ in range(rng.randint(0, 4)):
                no = rng.choice([no + 1, no + 1, no + 1, 0, 7])
                body.append("<tr>" + "".join(f"<td>{no + i}</td>" for i in range(9)) + "</tr>" if wide else row(no, rng.choice(["x", "y", "long name"])))
            html = rng.choice([table(*body)] * 8 + ["no table", None, table(*body).replace("</tr>", "</tr >")])
            bbox = rng.choice(["0 10 100 1000", "0 600 100 1000", ""])
            out.append((None if sample == 7 else sample, page // 2 if sample % 5 == 2 else page, page, None if sample == 9 else "T", html, bbox, "Table"))
    return spark.createDataFrame(out, "sample_id long, page_num long, field_pos int, field_name string, content string, bbox string, type string")


def test_rows_in_their_page_repeat_as_single_rows_do(spark):
    d = stitch.tag_strategies(odd_tables(spark)).withColumn("page_num", F.col("part"))
    got = stitch.part_skips(stitch.part_profiles(d)).filter("started AND n_rows > 0").select(*stitch.DOC, "page_num", "n_rows", "is_first", "skip")
    want = stitch.leading_repeats(stitch.table_rows(d)).select(*got.columns)
    started = got.filter("is_first").select(*stitch.DOC)
    want = null_safe_join(want, started, list(stitch.DOC), "left_semi")
    assert got.count() == want.count() > 100
    assert got.exceptAll(want).count() == 0


def test_tables_of_many_parts_say_the_same(spark, monkeypatch):
    def said():
        return sorted(map(str, provenance.merge_notes(odd_tables(spark)).collect()))

    few = said()
    monkeypatch.setattr(stitch, "SALT_PARTS", 2)
    assert said() == few


def test_labels_are_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    d = labels(spark, [(1, p, "T", table(HEAD, NAMES, row(p, "x")), "0 10 100 1000", "Table") for p in range(5)])
    assert len(provenance.merge_notes(d.mapInPandas(count, d.schema)).collect()) == 1
    assert seen.value == 5


def test_log_is_in_field_order(spark):
    rows = [(1, 2, "B", "b"), (1, 4, "A", "a"), (1, 4, "B", "c")]
    r = provenance.merge_log(labels(spark, rows)).first()
    assert (r["n_pages"], r["page_numbers"]) == (2, [2, 4])
    assert [(e["field"], e["strategy"], e["source_pages"]) for e in r["log"]] == [("B", stitch.TEXT, [2, 4]), ("A", stitch.AS_IS, [4])]


@pytest.mark.parametrize("html, rows", [
    ("<table><tr><td>a</td></tr><tr>b</tr></table>", ["<tr><td>a</td></tr>", "<tr>b</tr>"]),
    ("<TR CLASS=x hidden><td>a &amp; b<br/>c</td></TR ><tr>d</tr\n>", ["<tr class='x' hidden='None'>a & b<br/>c</tr>", "<tr>d</tr>"]),
    ("<tr><td>lost <tr title='1 > 0'>kept</tr >", ["<tr title='1 > 0'>kept</tr>"]),
    ("<tr><td>never closed", []),
    ("no table", []),
    ("<tr>x<!-- <tr> --><b>y</b> < z</tr >tail", ["<tr>xy < z</tr>"]),
    ("<track></track><tr>&#39;&#x1F642;&nope;</tr >", ["<tr>'🙂&nope;</tr>"]),
    (None, None),
])
def test_html_rows(spark, html, rows):
    assert spark.createDataFrame([(html,)], "h string").select(html_rows(F.col("h"))).first()[0] == rows


def test_rows_of_long_texts_take_linear_time(spark):
    df = spark.createDataFrame([("<tr>x</tr >" * 20000,), ("<tr>" * 50000,)], "h string")
    assert [r[0] for r in df.select(F.size(html_rows(F.col("h")))).collect()] == [20000, 0]


def test_unescape(spark):
    df = spark.createDataFrame([("&lt;a&gt; &amp;amp; &#65;&#x110000; & &unknown;",)], "t string")
    assert df.select(unescape(F.col("t"))).first()[0] == "<a> &amp; A&#x110000; & &unknown;"
