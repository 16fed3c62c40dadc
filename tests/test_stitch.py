"""Cross-page merging: cases worked out by hand, and what must hold for any input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracelake.operators import stitch

LABELS = "sample_id long, page_num long, field_pos int, field_name string, content string, bbox string, type string"


def labels(spark, rows):
    return spark.createDataFrame([(r[0], r[1], 0, r[2], r[3], r[4] if len(r) > 4 else "", r[5] if len(r) > 5 else "Text") for r in rows], LABELS)


STITCHED = [
    (["foo-", "bar"], "foobar"),
    (["one- ", " two-", "three"], "onetwothree"),
    (["bar baz", "  12 more"], "bar baz 12 more"),
    (["bar baz ", "(see"], "bar baz (see"),
    (["End here.", "next part"], "End here.\nnext part"),
    (["no stop", "Next part"], "no stop\nNext part"),
    (["list:", "more"], "list:\nmore"),
    (['done!"', "more"], 'done!"\nmore'),
    (["first. \n last line", "goes on"], "first. \n last line goes on"),
    (["tail - -", "ünder way"], "tail -ünder way"),
    (["only"], "only"),
    (["  kept as it is "], "  kept as it is "),
    (["a", "b", "c"], "a b c"),
    (["a", "", "b"], "a b"),
    (["a", "  ", "B."], "a\nB."),
]


def test_stitch_text(spark):
    rows = [(doc, p, "F", t) for doc, (texts, _) in enumerate(STITCHED) for p, t in enumerate(texts)]
    got = {r["sample_id"]: r["content"] for r in stitch.stitch_text(labels(spark, rows)).collect()}
    assert [got[k] for k in range(len(STITCHED))] == [want for _, want in STITCHED]


def test_stitching_keeps_every_word_in_order(spark):
    rnd = random.Random(4)
    rows, words = [], {}
    for doc in range(60):
        texts = [" ".join(f"w{rnd.randrange(99)}{rnd.choice(['', '.', ',', '!'])}" for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 8))]
        rows += [(doc, p, "F", t) for p, t in enumerate(texts)]
        words[doc] = " ".join(texts).split()
    got = {r["sample_id"]: r["content"].split() for r in stitch.stitch_text(labels(spark, rows)).collect()}
    assert got == words


def test_strategies(spark):
    rows = [(1, p, "T", "<table>", "", "Table") for p in range(3)] + [(1, 0, "One", "x"), (1, 0, "Two", "x"), (1, 1, "Two", "y"), (1, 0, "GHI CHÚ", "a"), (1, 1, "GHI CHÚ", "b")]
    got = {r["field_name"]: r["strategy"] for r in stitch.strategies(labels(spark, rows)).collect()}
    assert got == {"T": stitch.TABLE, "One": stitch.AS_IS, "Two": stitch.TEXT, "GHI CHÚ": stitch.LAST}


@pytest.mark.parametrize("prev, nxt, cut", [("50 300 900 1050", "50 80 900 400", True), ("50 80 400 200", "50 250 800 300", False), ("", "50 250 800 300", True)])
def test_page_cuts(spark, prev, nxt, cut):
    rows = [(1, 1, "F", "a", prev), (1, 2, "F", "b", nxt), (1, 1, "G", "", "0 0 1 1134"), (1, 2, "G", "", "0 0 1 1134")]
    got = stitch.page_cuts(labels(spark, rows)).filter("field_name = 'F' AND page_num = 2").first()
    assert got["page_cut"] is cut


def test_missing_pages(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", 2), ("b", 7)], "s string, p long")
    assert sorted(tuple(r) for r in stitch.missing_pages(df, "s", "p").collect()) == [("a", 3), ("a", 4)]


def row(no, *cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in (no, *cells)) + "</tr>"


HEAD = "<tr><td colspan='2'>Head</td></tr>"
NAMES = row("No", "Name")
MERGED = [
    # the head and the line of names repeat on every page
    ([[HEAD, NAMES, row(1, "x")], [HEAD, NAMES, row(2, "yy")], [HEAD, NAMES, row(3, "zzz")]], [HEAD, NAMES, row(1, "x"), row(2, "yy"), row(3, "zzz")]),
    # no head on later pages
    ([[HEAD, NAMES, row(1, "x")], [row(2, "long text")], [row(3, "zz")]], [HEAD, NAMES, row(1, "x"), row(2, "long text"), row(3, "zz")]),
    # two rows are repeated at a page break: the numbers say where to go on
    ([[HEAD, row(1, "a"), row(2, "bb"), row(3, "ccc")], [HEAD, row(2, "bbb b"), row(3, "cc cc"), row(4, "dddd d")]], [HEAD, row(1, "a"), row(2, "bb"), row(3, "ccc"), row(4, "dddd d")]),
    # numbers that do not follow move nothing
    ([[HEAD, row(1, "a")], [HEAD, row(7, "text")]], [HEAD, row(1, "a"), row(7, "text")]),
    # no numbers at all
    ([[row("n/a", "-")], [row("other", "cells")], [row("third", "part of it")]], [row("n/a", "-"), row("other", "cells"), row("third", "part of it")]),
    # a part without numbers between numbered ones
    ([[HEAD, row(1, "a")], [row("note", "text of a note")], [HEAD, row(1, "again a"), row(2, "bb")]], [HEAD, row(1, "a"), row("note", "text of a note"), row(2, "bb")]),
]


def table_frame(spark, tables):
    rows = [(doc, "T", p, i, r) for doc, parts in enumerate(tables) for p, part in enumerate(parts) for i, r in enumerate(part)]
    return spark.createDataFrame(rows, "sample_id long, field_name string, page_num long, row_pos int, row string")


def test_merge_tables(spark):
    got = {r["sample_id"]: r["content"] for r in stitch.merge_tables(table_frame(spark, [parts for parts, _ in MERGED])).collect()}
    assert [got[k] for k in range(len(MERGED))] == ["<table>" + "".join(want) + "</table>" for _, want in MERGED]


def test_merging_loses_no_numbered_row_and_can_be_repeated(spark):
    rnd = random.Random(8)
    tables = []
    for _ in range(40):
        parts, no = [], 1
        for _ in range(rnd.randint(1, 7)):
            part = [HEAD, NAMES]
            for _ in range(rnd.randint(1, 6)):
                part.append(row(no, "".join(rnd.choice("abc ") for _ in range(3 * no + 1)) + "."))
                no += 1
            parts.append(part)
        tables.append(parts)
    got = {r["sample_id"]: r["content"] for r in stitch.merge_tables(table_frame(spark, tables)).collect()}
    for doc, parts in enumerate(tables):
        numbered = [r for part in parts for r in part[2:]]
        assert got[doc] == "<table>" + "".join([HEAD, NAMES, *numbered]) + "</table>"
    once = [[re.findall("<tr>.*?</tr>", got[doc])] for doc in range(len(tables))]
    again = {r["sample_id"]: r["content"] for r in stitch.merge_tables(table_frame(spark, once)).collect()}
    assert again == got


def test_skip_moves_with_row_numbers(spark):
    rows = [(1, "T", 0, i, row(i + 1, "data" + "x" * i)) for i in range(4)] + [(1, "T", 1, 0, row(1, "old")), (1, "T", 1, 1, row(5, "new row"))]
    df = spark.createDataFrame(rows, "sample_id long, field_name string, page_num long, row_pos int, row string")
    got = {r["page_num"]: r["final_skip"] for r in stitch.table_skips(df).collect()}
    assert got == {0: 0, 1: 1}


def test_merge_document(spark):
    head = "<tr><td colspan='2'>H</td></tr><tr><td>No</td><td>Item</td></tr>"
    rows = []
    for p in (1, 2, 3):
        rows.append((7, p, "BANG KE DICH VU", f"<table>{head}{row(p, 'v' * p)}</table>", "0 0 1 900", "Table"))
        rows.append((7, p, "THÔNG TIN CHÂN TRANG", f" foot {p} "))
    rows.append((7, 2, "XÁC NHẬN", "first"))
    rows.append((7, 3, "XÁC NHẬN", "second"))
    got = {r["field_name"]: r for r in stitch.merge_documents(labels(spark, rows)).collect()}
    t = got["BẢNG KÊ DỊCH VỤ"]
    assert t["content"] == "<table>" + head + row(1, "v") + row(2, "vv") + row(3, "vvv") + "</table>"
    assert t["source_pages"] == [1, 2, 3] and t["type"] == "Table"
    assert got["THÔNG TIN CHÂN TRANG"]["content"] == "Trang 1: foot 1\nTrang 2: foot 2\nTrang 3: foot 3"
    assert got["XÁC NHẬN"]["content"] == "second" and got["XÁC NHẬN"]["source_pages"] == [3]
    assert stitch.nest_documents(stitch.merge_documents(labels(spark, rows))).select(F.size("fields")).first()[0] == 3
