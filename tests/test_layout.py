"""Template matching against plain Python, on random pages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import layout

W, H = 600.0, 800.0


def iou(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    i = w * h
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


@pytest.fixture(scope="module")
def page(spark):
    rnd = random.Random(9)
    secs = [(f"S{i}", i, rnd.uniform(0, 400), rnd.uniform(0, 600), rnd.uniform(40, 200), rnd.uniform(40, 200)) for i in range(6)]
    blocks = []
    for p in range(4):
        for pos in range(rnd.randint(3, 30)):
            x, y = rnd.uniform(0, 700), rnd.uniform(0, 700)
            blocks.append((p, pos, "Text", x, y, x + rnd.uniform(50, 300), y + rnd.uniform(50, 300)))
    return (
        secs, blocks,
        spark.createDataFrame(secs, "name string, ord long, x_pt double, y_pt double, w_pt double, h_pt double"),
        spark.createDataFrame(blocks, "page_id long, pos long, label string, x0 double, y0 double, x1 double, y1 double"),
    )


def test_assign_by_overlap(page):
    secs, blocks, sdf, bdf = page
    got = {(r["page_id"], r["name"]): r["block_pos"] for r in layout.assign_by_overlap(bdf, "page_id", sdf, W, H, 0.05).collect()}
    clip = lambda v: max(0.0, min(1.0, v))
    for p in {b[0] for b in blocks}:
        used = set()
        for name, _, x, y, w, h in secs:
            sb = tuple(map(clip, (x / W, y / H, (x + w) / W, (y + h) / H)))
            best, score = None, 0.0
            for b in blocks:
                if b[0] == p and b[1] not in used:
                    s = iou(sb, tuple(v / 1000 for v in b[3:]))
                    if s > score:
                        best, score = b[1], s
            want = best if best is not None and score >= 0.05 else None
            if want is not None:
                used.add(want)
            assert got[(p, name)] == want


def test_short_names_do_not_match(spark):
    secs = spark.createDataFrame([("Ngay", 0, 0.0, 0.0, 1.0, 1.0), ("Ngay mo", 1, 0.0, 0.0, 1.0, 1.0)], "name string, ord long, x_pt double, y_pt double, w_pt double, h_pt double")
    kv = layout.parse_key_values(spark.createDataFrame([(1, "# c\nNgay mo: 1 2 30 40 x\nbad line\nNgay mo: 5 5 9 9")], "page_id long, t string"), ["page_id"], "t")
    got = {r["name"]: (r["source"], r["score"]) for r in layout.assign_key_values(kv, "page_id", secs, W, H).collect()}
    assert got["Ngay"] == ("template", 0.0) and got["Ngay mo"] == ("block", 1.0)
    r = spark.range(1).select(layout.key_value_score(F.lit("ngay"), F.lit("ngaymo")).alias("s")).first()
    assert math.isclose(r["s"], 4 / 6 * 0.65)


def test_union_box(spark):
    df = spark.createDataFrame([(1, 0, "a", 1.0, 2.0, 3.0, 4.0, "x"), (1, 1, "a", 2.0, 1.0, 5.0, 3.0, "y")], "p int, pos int, s string, x0 double, y0 double, x1 double, y1 double, t string")
    r = layout.merge_duplicates(df, ["p"], "s", "t").first()
    assert (r["x0"], r["y0"], r["x1"], r["y1"], r["text"]) == (1, 1, 5, 4, "x<br/>y")


def offsets(spark, anchors):
    df = spark.createDataFrame([(1, anchors)], "page int, anchors array<struct<name: string, primary: boolean, dx: double, dy: double>>")
    r = layout.robust_offset(df, "page").first()
    return r["dx"], r["dy"], r["method"]


def test_robust_offset(spark):
    a = lambda p, x, y: ("n", p, float(x), float(y))
    assert offsets(spark, [a(True, 1, 1), a(True, 3, 5), a(False, 99, 99)]) == (2.0, 3.0, "primary")
    assert offsets(spark, [a(True, 0, -50), a(False, 1, 2), a(False, 3, 4), a(False, 9, 90)]) == (2.0, 3.0, "trimmed")
    assert offsets(spark, [a(True, 1, 7), a(False, 2, 8), a(False, 9, 9)]) == (2.0, 8.0, "all")
    assert offsets(spark, []) == (0.0, 0.0, "none")


def test_extract_blocks_dedup(spark):
    html = '<div data-bbox="1 2 3 4" data-label="Text">a<br>b</div><div data-bbox="1 2 3 4" data-label="Text">c</div><div data-label="Text">no box</div>'
    df = spark.createDataFrame([(1, html)], "p int, h string")
    assert layout.extract_blocks(df, ["p"], "h").count() == 2
    r = layout.extract_blocks(df, ["p"], "h", dedup=True).collect()
    assert len(r) == 1 and r[0]["lines"] == ["a", "b"] and r[0]["x1"] == 3.0


def test_large_templates_match_like_small_ones(spark, monkeypatch):
    rng = random.Random(21)
    secs = [(f"Sect {i % 37} n{i}", i, rng.uniform(-50, 580), rng.uniform(-20, 780), rng.uniform(0, 90), rng.uniform(0, 120), rng.choice(["header", "image", "field", "table", "free"]), i) for i in range(60)]
    sections = spark.createDataFrame(secs, "name string, ord long, x_pt double, y_pt double, w_pt double, h_pt double, kind string, table_rank long")
    rows = []
    for p in range(5):
        for pos in range(25):
            x, y = rng.uniform(-30, 1000), rng.uniform(0, 1010)
            name = rng.choice(secs)[0]
            rows.append((p, pos, rng.choice(["Text", "Section-Header", "Image", "Table", "Form"]), x, y, x + rng.choice([0, 1, 80, 400]), y + rng.choice([0, 5, 200]), [f"{name}: v"], name, name.lower().replace(" ", "")))
    blocks = spark.createDataFrame(rows, "page_id long, pos long, label string, x0 double, y0 double, x1 double, y1 double, lines array<string>, text string, folded string")
    plain = sections.drop("kind", "table_rank")

    def results():
        return [
            sorted(map(str, d.collect())) for d in (
                layout.match_by_overlap(blocks, plain, W, H, 0.02), layout.match_by_cover(blocks, plain, W, H, 0.2),
                layout.assign_by_overlap(blocks, "page_id", plain, W, H, 0.01), layout.assign_hybrid(blocks, "page_id", sections, W, H),
                layout.assign_key_values(blocks, "page_id", plain, W, H),
            )
        ]

    small = results()
    monkeypatch.setattr(layout, "MAX_SECTIONS", 7)
    monkeypatch.setattr(layout, "TILES", 5)
    for a, b in zip(small, results(), strict=True):
        assert a == b


def test_many_thousands_of_sections(spark):
    secs = spark.range(20_000).select(
        F.concat(F.lit("s"), "id").alias("name"), F.col("id").alias("ord"), (F.col("id") % 200 * 3.0).alias("x_pt"), (F.floor(F.col("id") / 200) * 8.0).alias("y_pt"),
        F.lit(3.0).alias("w_pt"), F.lit(8.0).alias("h_pt"),
    )
    blocks = spark.range(500).select(
        F.lit(1).alias("page_id"), (F.col("id") * 37 % 20_000).alias("pos"), F.lit("Text").alias("label"),
    ).select("page_id", "pos", "label", (F.col("pos") % 200 * 5.0 + 0.5).alias("x0"), (F.floor(F.col("pos") / 200) * 10.0 + 1).alias("y0")).withColumns(
        {"x1": F.col("x0") + 4, "y1": F.col("y0") + 8}
    )
    got = layout.match_by_overlap(blocks, secs, W, H, 0.1).collect()
    assert len(got) == 500 and all((r["section"], r["method"]) == (f"s{r['pos']}", "iou") for r in got)


ANCHORED = "page_id int, pos int, label string, x0 double, y0 double, x1 double, y1 double, text string"


def page_offsets(spark, rows, *rules):
    anchors = [{"name": n, "rule": r, "key": "k", "box": (0.0, lo, 0.0, hi), "primary": False} for n, r, lo, hi in rules]
    return layout.page_anchors(spark.createDataFrame([(1, *r) for r in rows], ANCHORED), "page_id", anchors, 600.0, 800.0)


def test_equal_offsets_of_anchors_are_equal_numbers(spark):
    rows = [(0, "Image", 0.0, 23.0, 10.0, 139.0, ""), (1, "Section-Header", 0.0, 325.0, 20.0, 987.0, "k")]
    got = page_offsets(spark, rows, ("a", "image", 60.0, 80.0), ("b", "header", 520.0, 540.0)).first()["anchors"]
    assert [a["dy"] for a in got] == [-5.2, -5.2]


def test_a_box_shifted_out_of_the_page_is_one_point_high(spark):
    found = page_offsets(spark, [(0, "Table", 0.0, 1.0, 10.0, 949.0, "")], ("a", "table_big", 520.0, 540.0))
    shift = layout.robust_offset(found, "page_id")
    sections = spark.createDataFrame([(1, "s", 0.0, 0.0, 110.0, 150.0)], "page_id int, name string, x_pt double, y_pt double, w_pt double, h_pt double")
    over = spark.createDataFrame([], "page_id int, name string, oy0 double, oy1 double")
    r = layout.section_boxes(sections, "page_id", shift, over, {}, 600.0, 800.0, 12.0).first()
    assert (r["y0"], r["y1"]) == (0.0, 1.0)


def test_tables_of_equal_area_go_by_position(spark):
    rows = [(0, "Table", 782.0, 64.0, 836.0, 229.0, ""), (1, "Table", 261.0, 120.0, 426.0, 174.0, "")]
    got = page_offsets(spark, rows, ("a", "table_big", 0.0, 0.0)).first()["anchors"]
    assert got[0]["dy"] == (64 + 229) * 800 / 2000
