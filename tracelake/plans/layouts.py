"""Registered queries: block extraction, template matching, offsets, coverage, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import geometry as geo
from tracelake.functions import text as tx
from tracelake.functions import udfs
from tracelake.operators import extraction, layout
from tracelake.plans.catalog import query, r6, rounded
from tracelake.plans.fixtures import BLOCK, PAGE_H, PAGE_W, SECTION, blocks, sections, table

BOX = ("x0", "y0", "x1", "y1")

SQL_IOU = """CASE WHEN least({a}x1, {b}x1) > greatest({a}x0, {b}x0) AND least({a}y1, {b}y1) > greatest({a}y0, {b}y0) THEN
  (least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * (least({a}y1, {b}y1) - greatest({a}y0, {b}y0)) /
  (({a}x1 - {a}x0) * ({a}y1 - {a}y0) + ({b}x1 - {b}x0) * ({b}y1 - {b}y0) - (least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * (least({a}y1, {b}y1) - greatest({a}y0, {b}y0))) ELSE 0 END"""

# Blocks and sections in the unit square, and their IoU
PAIRS = f"""{BLOCK}, {SECTION}, bu AS (SELECT *, x0 / 1000 AS x0u, y0 / 1000 AS y0u, x1 / 1000 AS x1u, y1 / 1000 AS y1u FROM block),
 su AS (SELECT *, greatest(0, least(1, x_pt / 600)) AS sx0u, greatest(0, least(1, y_pt / 800)) AS sy0u, greatest(0, least(1, (x_pt + w_pt) / 600)) AS sx1u, greatest(0, least(1, (y_pt + h_pt) / 800)) AS sy1u FROM section),
 ov AS (SELECT page_id, pos, label, name, ord, greatest(0, least(x1u, sx1u) - greatest(x0u, sx0u)) * greatest(0, least(y1u, sy1u) - greatest(y0u, sy0u)) AS inter,
   (x1u - x0u) * (y1u - y0u) AS ba, (sx1u - sx0u) * (sy1u - sy0u) AS sa, (x0u + x1u) / 2 BETWEEN sx0u AND sx1u AND (y0u + y1u) / 2 BETWEEN sy0u AND sy1u AS centred FROM bu CROSS JOIN su),
 pairs AS (SELECT *, CASE WHEN inter > 0 THEN inter / (ba + sa - inter) ELSE 0 END AS iou, inter / greatest(1e-6, ba) AS cover FROM ov)"""


# HTML of a page: its blocks as div elements, some with reversed or malformed boxes
_DIV = """'<div data-bbox="' || CASE WHEN pk % 17 = 0 THEN '12 a 3 4' WHEN pk % 5 = 0 THEN CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || ' ' || CAST(x0 AS BIGINT) || ' ' || CAST(y0 AS BIGINT)
  ELSE CAST(x0 AS BIGINT) || ' ' || CAST(y0 AS BIGINT) || ' ' || CAST(x1 AS BIGINT) || ' ' || CAST(y1 AS BIGINT) END || '" data-label="' || label || '" data-schema="' || schema || '"><b>' || text || '</b><br/>  ' || label || ' line </div>'"""
HTML = f"{BLOCK}, html AS (SELECT page_id, 'preamble <div>no box</div> ' || string_agg({_DIV}, chr(10) ORDER BY pos) AS html FROM block GROUP BY 1)"


def page_html(spark, sf):
    n = lambda c: F.col(c).cast("long").cast("string")
    sp = F.lit(" ")
    box = (
        F.when(F.col("pk") % 17 == 0, F.lit("12 a 3 4"))
        .when(F.col("pk") % 5 == 0, F.concat(n("x1"), F.lit(","), n("y1"), sp, n("x0"), sp, n("y0")))
        .otherwise(F.concat(n("x0"), sp, n("y0"), sp, n("x1"), sp, n("y1")))
    )
    div = F.concat(
        F.lit('<div data-bbox="'), box, F.lit('" data-label="'), "label", F.lit('" data-schema="'), "schema", F.lit('"><b>'), "text",
        F.lit("</b><br/>  "), "label", F.lit(" line </div>"),
    )
    return blocks(spark, sf).withColumn("div", div).groupBy("page_id").agg(
        F.concat(F.lit("preamble <div>no box</div> "), F.expr("listagg(div, '\n') WITHIN GROUP (ORDER BY pos)")).alias("html")
    )


def lined(spark, sf):
    """Blocks with their lines."""
    return blocks(spark, sf).withColumn("lines", F.filter(F.array("text", F.concat("label", F.lit(" line"))), lambda x: x != ""))


@query(
    "x01_extract_blocks",
    f"""WITH {BLOCK} SELECT page_id, pos + 1 AS pos, label, nullif(schema, '') AS schema, x0, y0, x1, y1, trim(text || ' ' || label || ' line') AS text
    FROM block WHERE pk % 17 <> 0""",
)
def x01(spark, sf):
    return layout.extract_blocks(page_html(spark, sf), ["page_id"], "html").select("page_id", "pos", "label", "schema", *BOX, "text")


@query(
    "x01_page_elements",
    r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:h1|li|title)\b[^>]*>.*?</(?:h1|li|title)>')) AS el FROM pages)
    SELECT page_id, count(*) AS n, CAST(sum(length(el)) AS BIGINT) AS chars FROM m GROUP BY 1""",
)
def x01_pages(spark, sf):
    d = layout.find_elements(table(spark, sf, "pages"), ["page_id"], "html", "h1|li|title")
    size = F.length("attrs") + F.length("inner") + 2 * F.length("tag") + 5
    return d.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"))


_FOLD = "regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


@query(
    "x02_label_blocks",
    f"""WITH {BLOCK}, nm AS (SELECT n_name AS name, {_FOLD.format(c='n_name')} AS f FROM nation WHERE n_nationkey < 20),
    k AS (SELECT page_id, pos, unnest([nullif(schema, ''), CASE WHEN instr(text, ':') > 1 THEN split_part(text, ':', 1) END, CASE WHEN label = 'Section-Header' THEN text END]) AS key, unnest([1, 2, 3]) AS pr FROM block),
    h AS (SELECT page_id, pos, min_by(nm.name, pr) AS assigned FROM k JOIN nm ON {_FOLD.format(c='key')} = f GROUP BY 1, 2)
    SELECT b.page_id, b.pos, assigned FROM block b LEFT JOIN h ON h.page_id = b.page_id AND h.pos = b.pos""",
)
def x02(spark, sf):
    names = table(spark, sf, "nation").filter("n_nationkey < 20").select("n_name", "n_nationkey")
    d = lined(spark, sf).withColumn("schema", F.nullif("schema", F.lit("")))
    return layout.label_blocks(d, names, "n_name", "n_nationkey").select("page_id", "pos", "assigned")


_KVTEXT = """'NATION ' || (pk * 7 % 25) || ' : ' || CAST(x1 AS BIGINT) || ' ' || CAST(y0 AS BIGINT) || ' ' || CAST(x0 AS BIGINT) || '.5 ' || CASE WHEN pk % 13 = 0 THEN 'x' ELSE CAST(CAST(y1 AS BIGINT) AS VARCHAR) END || CASE WHEN pk % 2 = 0 THEN ' extra' ELSE '' END"""


def kv_text(spark, sf):
    n = lambda c: F.col(c).cast("long").cast("string")
    sp = F.lit(" ")
    line = F.concat(
        F.lit("NATION "), (F.col("pk") * 7 % 25).cast("string"), F.lit(" : "), n("x1"), sp, n("y0"), sp, n("x0"), F.lit(".5 "),
        F.when(F.col("pk") % 13 == 0, F.lit("x")).otherwise(n("y1")), F.when(F.col("pk") % 2 == 0, F.lit(" extra")).otherwise(F.lit("")),
    )
    return blocks(spark, sf).withColumn("line", line).groupBy("page_id").agg(
        F.concat(F.lit("# boxes\n```\n"), F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY pos)")).alias("text")
    )


_KVROWS = f"""{BLOCK}, kv AS (SELECT page_id, pos, 'NATION ' || (pk * 7 % 25) AS name, least(x1, x0 + 0.5) AS x0, y0, greatest(x1, x0 + 0.5) AS x1, y1,
   row_number() OVER (PARTITION BY page_id, pk * 7 % 25 ORDER BY pos) AS rn FROM block WHERE pk % 13 <> 0)"""


@query("x03_parse_key_values", f"WITH {_KVROWS} SELECT page_id, name, x0, y0, x1, y1 FROM kv WHERE rn = 1")
def x03(spark, sf):
    return layout.parse_key_values(kv_text(spark, sf), ["page_id"], "text").select("page_id", "name", *BOX)


@query(
    "f15_containment_similarity",
    f"""WITH {BLOCK}, f AS (SELECT pk, {_FOLD.format(c='text')} AS a, {_FOLD.format(c='schema')} AS b FROM block)
    SELECT pk, round(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 WHEN starts_with(a, b) OR starts_with(b, a) THEN least(length(a), length(b)) / CAST(greatest(length(a), length(b)) AS DOUBLE)
      WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / CAST(greatest(length(a), length(b)) AS DOUBLE) * 0.9 ELSE 0 END, 6) AS sim FROM f""",
)
def f15(spark, sf):
    b = blocks(spark, sf)
    return b.select("pk", r6(tx.containment_similarity(tx.fold_latin(F.col("text")), tx.fold_latin(F.col("schema")))).alias("sim"))


@query("f14_fold_text", r"""SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g')) AS digest FROM documents""")
def f14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(udfs.fold_text("text")).alias("digest"))


@query("f14_fold_latin", r"""SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g')) AS digest FROM documents""")
def f14_native(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.fold_latin(F.col("text"))).alias("digest"))


@query("k01_fold_udf", f"WITH {BLOCK} SELECT pk, {_FOLD.format(c='text')} AS folded FROM block")
def k01(spark, sf):
    udfs.register_udfs(spark)
    return blocks(spark, sf).selectExpr("pk", "fold_text(text) AS folded")


def _box(a=""):
    return geo.box(*[F.col(f"{a}{c}") for c in BOX])


_NEXT = f"{BLOCK}, nx AS (SELECT *, x0 + 30 AS bx0, y0 - 20 AS by0, x1 + pk % 90 AS bx1, y1 + 10 AS by1 FROM block)"


def _two(spark, sf):
    b = blocks(spark, sf)
    return b.withColumns({"bx0": F.col("x0") + 30, "by0": F.col("y0") - 20, "bx1": F.col("x1") + F.col("pk") % 90, "by1": F.col("y1") + 10})


_I2 = "(greatest(0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0, least(y1, by1) - greatest(y0, by0)))"


@query(
    "f16_box_overlap",
    f"""WITH {_NEXT} SELECT pk, round({_I2} / ((x1 - x0) * (y1 - y0) + (bx1 - bx0) * (by1 - by0) - {_I2}), 6) AS iou, round({_I2} / ((x1 - x0) * (y1 - y0)), 6) AS cover,
    (x0 + x1) / 2 BETWEEN bx0 AND bx1 AND (y0 + y1) / 2 BETWEEN by0 AND by1 AS centred FROM nx""",
)
def f16(spark, sf):
    a, b = _box(), _box("b")
    return _two(spark, sf).select("pk", r6(geo.iou(a, b)).alias("iou"), r6(geo.cover_ratio(a, b)).alias("cover"), geo.center_inside(a, b).alias("centred"))


@query(
    "f17_coordinate_scaling",
    f"""WITH {SECTION} SELECT name, round(greatest(0, least(1000, x_pt / 600 * 1000)), 6) AS nx0, round(greatest(0, least(1000, (y_pt + h_pt) / 700 * 1000)), 6) AS ny1,
    round(x_pt / 600 * 1275, 6) AS px0, round((y_pt + h_pt) / 700 * 1650, 6) AS py1 FROM section""",
)
def f17(spark, sf):
    s = sections(spark, sf)
    pt = geo.box(F.col("x_pt"), F.col("y_pt"), F.col("x_pt") + F.col("w_pt"), F.col("y_pt") + F.col("h_pt"))
    n = geo.points_to_norm1000(pt, F.lit(600.0), F.lit(700.0))
    px = geo.scale(pt, F.lit(1275 / 600.0), F.lit(1650 / 700.0))
    return s.select("name", r6(n["x0"]).alias("nx0"), r6(n["y1"]).alias("ny1"), r6(px["x0"]).alias("px0"), r6(px["y1"]).alias("py1"))


@query(
    "f18_parse_box",
    """WITH b AS (SELECT p_partkey, p_size || ' 12.5  ' || CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE '40' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' 99' END AS s FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE CAST(split_part(s, ' ', 1) AS DOUBLE) END AS x0, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE 99.0::DOUBLE END AS y1 FROM b""",
)
def f18(spark, sf):
    k = F.col("p_partkey")
    s = F.concat(
        F.col("p_size").cast("string"), F.lit(" 12.5  "), F.when(k % 9 == 0, F.lit("x")).otherwise(F.lit("40")),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.lit(" 99")),
    )
    b = geo.parse_box(s)
    return table(spark, sf, "part").select("p_partkey", b["x0"].alias("x0"), b["y1"].alias("y1"))


@query("f19_field_label", f"WITH {BLOCK} SELECT pk, CASE WHEN label = 'Text' THEN split_part(text, ':', 1) END AS field FROM block")
def f19(spark, sf):
    return lined(spark, sf).select("pk", tx.first_label(F.col("lines")).alias("field"))


@query(
    "f20_sanitize_output",
    f"""WITH {HTML} SELECT page_id, md5(html) AS cut, md5(html) AS decoded, md5(html[instr(html, '<div'):]) AS body FROM html""",
)
def f20(spark, sf):
    h = page_html(spark, sf)
    noisy = F.concat(F.lit("  "), "html", F.lit("\nassistant\nagain <think>why</think>"))
    marked = F.concat("html", F.lit("<|im_end|> tail"))
    fenced = F.concat(F.lit("```html\n"), "html", F.lit("\n```\n"))
    return h.select(
        "page_id", F.md5(tx.cut_markers(noisy)).alias("cut"), F.md5(tx.cut_decoded(marked)).alias("decoded"),
        F.md5(tx.from_first_div(fenced)).alias("body"),
    )


def model_output(spark, sf):
    """Model output per page: prose around a fenced JSON object of name -> box."""
    b = blocks(spark, sf).filter("label = 'Text'")
    item = F.concat(
        F.lit('"nation '), (F.col("pk") * 7 % 12).cast("string"), F.lit('": ['), F.col("x1").cast("long").cast("string"), F.lit(", "),
        F.col("y0").cast("long").cast("string"), F.lit(", "), F.col("x0").cast("long").cast("string"), F.lit(", 1200]"),
    )
    first = layout.first_by_key(b.withColumn("nm", F.col("pk") * 7 % 12), ["page_id", "nm"], "pos")
    return first.withColumn("item", item).groupBy("page_id").agg(
        F.concat(F.lit("Sure, {here}:\n```json\n{"), F.expr("listagg(item, ', ') WITHIN GROUP (ORDER BY pos)"), F.lit("}\n```\ndone {}")).alias("output")
    )


_RECON = f"""{BLOCK}, fb AS (SELECT *, row_number() OVER (PARTITION BY page_id, pk * 7 % 12 ORDER BY pos) AS rn FROM block WHERE label = 'Text')"""


@query(
    "f21_first_json_rows",
    f"WITH {_RECON} SELECT page_id, 'nation ' || (pk * 7 % 12) AS key, '[' || CAST(x1 AS BIGINT) || ',' || CAST(y0 AS BIGINT) || ',' || CAST(x0 AS BIGINT) || ',1200]' AS value FROM fb WHERE rn = 1",
)
def f21(spark, sf):
    d = model_output(spark, sf).withColumn("v", F.try_parse_json(udfs.first_json("output")))
    d.createOrReplaceTempView("model_output_rows")
    return spark.sql("SELECT page_id, e.key, to_json(e.value) AS value FROM model_output_rows, LATERAL variant_explode(v) AS e")


@query(
    "k03_first_json_udf",
    f"""WITH {_RECON} SELECT page_id, '{{' || string_agg('"nation ' || (pk * 7 % 12) || '": [' || CAST(x1 AS BIGINT) || ', ' || CAST(y0 AS BIGINT) || ', ' || CAST(x0 AS BIGINT) || ', 1200]', ', ' ORDER BY pos) || '}}' AS doc FROM fb WHERE rn = 1 GROUP BY 1""",
)
def k03(spark, sf):
    udfs.register_udfs(spark)
    return model_output(spark, sf).selectExpr("page_id", "first_json(output) AS doc")


@query(
    "j08_reconcile_names",
    f"""WITH {_RECON} SELECT page_id, 'NATION_' || (pk * 7 % 12) AS canonical, greatest(0, x0) AS x0, least(1000, y0) AS y0, least(1000, x1) AS x1, 1000.0::DOUBLE AS y1 FROM fb WHERE rn = 1""",
)
def j08(spark, sf):
    rows = f21(spark, sf)
    arr = F.from_json("value", "array<double>")
    rows = rows.select("page_id", "key", *[F.get(arr, i).alias(c) for i, c in enumerate(BOX)])
    names = table(spark, sf, "nation").select("n_name", "n_nationkey")
    d = layout.reconcile_names(rows, "key", names, "n_name", "n_nationkey")
    return layout.repaired_boxes(d).select("page_id", "canonical", *BOX)


@query(
    "k04_schema_names",
    f"WITH {BLOCK} SELECT DISTINCT page_id, n AS name FROM (SELECT page_id, unnest([label, text]) AS n FROM block) WHERE n <> ''",
)
def k04(spark, sf):
    return _layout_tree(spark, sf).selectExpr("page_id", "name")


def _layout_docs(spark, sf):
    node = F.struct(F.col("label").alias("name"), F.array(F.struct(F.col("text").alias("name"))).alias("items"))
    return blocks(spark, sf).groupBy("page_id").agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", node.alias("n")))), lambda x: x["n"]).alias("sections"))).alias("doc")
    )


def _layout_tree(spark, sf):
    udfs.register_udfs(spark)
    _layout_docs(spark, sf).createOrReplaceTempView("layout_docs")
    return spark.sql("SELECT d.page_id, t.pos, t.name FROM layout_docs d, LATERAL schema_names(d.doc, false) t")


@query(
    "k04_json_paths",
    f"""WITH {BLOCK} SELECT page_id, unnest(['sections', 'sections[*].name', 'sections[*].items', 'sections[*].items[*].name']) AS path FROM (SELECT DISTINCT page_id FROM block)""",
)
def k04_paths(spark, sf):
    udfs.register_udfs(spark)
    _layout_docs(spark, sf).createOrReplaceTempView("layout_docs")
    return spark.sql("SELECT d.page_id, t.path FROM layout_docs d, LATERAL json_paths(d.doc) t")


@query(
    "j07_attach_values",
    f"""WITH {BLOCK}, tree AS (SELECT DISTINCT page_id, trim(n) AS name FROM (SELECT page_id, unnest([label, text]) AS n FROM block) WHERE n <> ''),
    v AS (SELECT page_id, schema, max_by(text, pos) AS value FROM block WHERE schema <> '' GROUP BY 1, 2)
    SELECT tree.page_id, name, value FROM tree LEFT JOIN v ON v.page_id = tree.page_id AND v.schema = split_part(name, ':', 1)""",
)
def j07(spark, sf):
    tree = _layout_tree(spark, sf)
    b = blocks(spark, sf).filter("schema <> ''").select("page_id", "schema", "pos", "text")
    values = layout.last_by_key(b, ["page_id", "schema"], "pos").select("page_id", "schema", F.col("text").alias("value"))
    keyed = tree.withColumn("key", F.substring_index("name", ":", 1))
    return layout.attach_values(keyed, "key", values, "schema", "page_id").select("page_id", "name", "value")


@query(
    "j09_match_by_overlap",
    f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, pos ORDER BY iou DESC, ord) AS rn, min(CASE WHEN centred THEN ord END) OVER (PARTITION BY page_id, pos) AS co FROM pairs)
    SELECT r.page_id, pos, round(iou, 6) AS score, CASE WHEN iou > 0 AND iou >= 0.3 THEN 'iou' WHEN co IS NOT NULL THEN 'center' ELSE 'none' END AS method,
    CASE WHEN iou > 0 AND iou >= 0.3 THEN r.name ELSE 'NATION_' || co END AS section FROM r WHERE rn = 1""",
)
def j09(spark, sf):
    out = layout.match_by_overlap(blocks(spark, sf), sections(spark, sf), PAGE_W, PAGE_H, 0.3)
    return rounded(out.select("page_id", "pos", "score", "method", "section"), "score")


@query(
    "j10_match_by_cover",
    f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, pos ORDER BY cover DESC, ord) AS rn FROM pairs)
    SELECT page_id, pos, CASE WHEN cover > 0 THEN round(cover, 6) END AS cover, CASE WHEN cover > 0 AND cover >= 0.5 THEN name ELSE '(' || label || ')' END AS section FROM r WHERE rn = 1""",
)
def j10(spark, sf):
    out = layout.match_by_cover(blocks(spark, sf), sections(spark, sf), PAGE_W, PAGE_H, 0.5)
    return rounded(out.select("page_id", "pos", "cover", "section"), "cover")


def hybrid_sections(spark, sf):
    k = F.col("ord")
    kind = F.when(k < 5, "header").when(k == 5, "image").when(k < 16, "field").when(k < 18, "table").otherwise("free")
    return sections(spark, sf).withColumns({"kind": kind, "table_rank": F.when(k == 17, 0).when(k == 16, 1).cast("long")})


def _greedy(cand: str) -> str:
    """Recursive SQL for the one-to-one assignment over CTE ``cand`` (page_id, step, ord, name, pos, score, floor, method)."""
    return f"""{cand}, sl AS (SELECT page_id, step, ord, name, any_value(floor) AS floor, any_value(method) AS method,
      list(struct_pack(pos := pos, score := score) ORDER BY score DESC, pos) AS cs, row_number() OVER (PARTITION BY page_id ORDER BY step, ord, name) AS k FROM cand GROUP BY 1, 2, 3, 4),
    g AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS method FROM block
      UNION ALL SELECT page_id, k, CASE WHEN ok THEN list_append(used, pick.pos) ELSE used END, CASE WHEN ok THEN list_append(done, name) ELSE done END, CASE WHEN ok THEN name END, CASE WHEN ok THEN pick.pos END, CASE WHEN ok THEN pick.score END, CASE WHEN ok THEN method END
      FROM (SELECT page_id, sl.k, used, done, sl.name, sl.method, pick, pick IS NOT NULL AND pick.score >= sl.floor AND NOT list_contains(done, sl.name) AS ok FROM
        (SELECT g.page_id, g.used, g.done, sl.k, sl.name, sl.floor, sl.method, list_filter(sl.cs, lambda c: NOT list_contains(g.used, c.pos))[1] AS pick FROM g JOIN sl ON sl.page_id = g.page_id AND sl.k = g.k + 1) sl)),
    matched AS (SELECT p.page_id, section.name, section.ord, CASE WHEN g.name IS NOT NULL THEN 'block' ELSE 'template' END AS source, g.pos AS block_pos, coalesce(g.method, 'none') AS match_method, round(coalesce(g.score, 0), 6) AS score
      FROM (SELECT DISTINCT page_id FROM block) p CROSS JOIN section LEFT JOIN g ON g.page_id = p.page_id AND g.name = section.name)"""


_IOU_CAND = "cand AS (SELECT page_id, 1 AS step, ord, name, CAST(pos AS BIGINT) AS pos, iou AS score, {floor}::DOUBLE AS floor, 'iou' AS method FROM pairs WHERE iou > 0)"


@query("j11_assign_by_overlap", f"WITH RECURSIVE {PAIRS}, {_greedy(_IOU_CAND.format(floor=0.05))} SELECT * FROM matched")
def j11(spark, sf):
    return rounded(layout.assign_by_overlap(blocks(spark, sf), "page_id", sections(spark, sf), PAGE_W, PAGE_H, 0.05), "score")


def _sim(b: str) -> str:
    return f"""CASE WHEN a = '' OR {b} = '' THEN 0 WHEN a = {b} THEN 1 WHEN starts_with(a, {b}) OR starts_with({b}, a) THEN least(length(a), length({b})) / CAST(greatest(length(a), length({b})) AS DOUBLE)
  WHEN contains(a, {b}) OR contains({b}, a) THEN least(length(a), length({b})) / CAST(greatest(length(a), length({b})) AS DOUBLE) * 0.9 ELSE 0 END"""


_HYBRID = f"""{PAIRS}, sx AS (SELECT name, ord, {_FOLD.format(c='name')} AS a FROM section), bx AS (SELECT *, {_FOLD.format(c='text')} AS tf, {_FOLD.format(c="split_part(text, ':', 1)")} AS ff FROM block),
  cand AS (SELECT * FROM (
    SELECT page_id, 1 AS step, ord, name, CAST(pos AS BIGINT) AS pos, CAST({_sim('tf')} AS DOUBLE) AS score, CAST(0.6 AS DOUBLE) AS floor, 'header-text' AS method FROM bx CROSS JOIN sx WHERE label = 'Section-Header' AND ord < 5
    UNION ALL SELECT page_id, 2, ord, name, pos, 1, 0, 'image-label' FROM bx CROSS JOIN sx WHERE label = 'Image' AND ord = 5
    UNION ALL SELECT page_id, 3, ord, name, pos, {_sim('ff')}, 0.6, 'field-text' FROM bx CROSS JOIN sx WHERE label = 'Text' AND ord BETWEEN 6 AND 15
    UNION ALL SELECT page_id, 4, 17 - ord, name, pos, (x1 - x0) * (y1 - y0), 0, 'table-size' FROM bx CROSS JOIN sx WHERE label = 'Table' AND ord IN (16, 17)
    UNION ALL SELECT page_id, 5, ord, name, pos, iou, 0.05, 'iou' FROM pairs) WHERE score > 0)"""


@query("k05_assign_greedy", f"WITH RECURSIVE {PAIRS}, {_greedy(_IOU_CAND.format(floor=0.3))} SELECT page_id, name, block_pos AS pos, match_method AS method, score FROM matched WHERE source = 'block'")
def k05(spark, sf):
    d = layout.with_template(blocks(spark, sf), sections(spark, sf), PAGE_W, PAGE_H).withColumn("__u", layout.unit_box())
    rows = layout._candidates(lambda s: F.lit(True), lambda s: geo.iou(F.col("__u"), s["unit"]), 1, 0.3, "iou")
    return rounded(layout.assign_greedy(d.select("page_id", "pos", F.inline(rows)), "page_id", sections(spark, sf)), "score")


@query("j12_assign_hybrid", f"WITH RECURSIVE {_greedy(_HYBRID)} SELECT * FROM matched")
def j12(spark, sf):
    return rounded(layout.assign_hybrid(lined(spark, sf), "page_id", hybrid_sections(spark, sf), PAGE_W, PAGE_H), "score")


_KVSIM = """CASE WHEN a = b THEN 1.0 WHEN starts_with(a, b) OR starts_with(b, a) THEN least(length(a), length(b)) / CAST(greatest(length(a), length(b)) AS DOUBLE) * CASE WHEN least(length(a), length(b)) < 5 THEN 0.65 ELSE 0.95 END
  WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / CAST(greatest(length(a), length(b)) AS DOUBLE) * 0.8 ELSE 0 END"""
_KVCAND = f"""{_KVROWS}, {SECTION}, cand AS (SELECT * FROM (SELECT page_id, 1 AS step, ord, name, CAST(pos AS BIGINT) AS pos, CAST({_KVSIM} AS DOUBLE) AS score, CAST(0.6 AS DOUBLE) AS floor, 'kv-text' AS method FROM
  (SELECT page_id, pos + 2 AS pos, {_FOLD.format(c='kv.name')} AS b FROM kv WHERE rn = 1) CROSS JOIN (SELECT name, ord, {_FOLD.format(c='name')} AS a FROM section)) WHERE score > 0)"""


@query("j13_assign_key_values", f"WITH RECURSIVE {_greedy(_KVCAND)} SELECT * FROM matched")
def j13(spark, sf):
    kv = layout.parse_key_values(kv_text(spark, sf), ["page_id"], "text")
    return rounded(layout.assign_key_values(kv, "page_id", sections(spark, sf), PAGE_W, PAGE_H), "score")


_MA = """ma AS (SELECT page_id, pk * 7 % 12 AS name, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY page_id, pk * 7 % 12 ORDER BY pos) AS rn FROM block WHERE label = 'Text') WHERE rn = 1),
 mb AS (SELECT page_id, pk * 7 % 12 AS name, x0 + 5 AS x0, y0, x1 + 9 AS x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY page_id, pk * 7 % 12 ORDER BY pos) AS rn FROM block WHERE label = 'Text' OR label = 'Table') WHERE rn = 1)"""


@query(
    "j14_compare_matches",
    f"""WITH {BLOCK}, {_MA} SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'template' ELSE 'kv' END AS source_a,
    CASE WHEN b.name IS NULL THEN 'template' ELSE 'html' END AS source_b, round(CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN {SQL_IOU.format(a='a.', b='b.')} ELSE 0 END, 6) AS iou
    FROM ma a FULL JOIN mb b ON a.page_id = b.page_id AND a.name = b.name""",
)
def j14(spark, sf):
    b = blocks(spark, sf).withColumn("name", F.col("pk") * 7 % 12)
    first = lambda d: layout.first_by_key(d, ["page_id", "name"], "pos")
    a = first(b.filter("label = 'Text'")).select("page_id", "name", F.lit("kv").alias("source"), _box().alias("bbox"))
    h = first(b.filter("label IN ('Text', 'Table')")).select(
        "page_id", "name", F.lit("html").alias("source"), geo.box(F.col("x0") + 5, F.col("y0"), F.col("x1") + 9, F.col("y1")).alias("bbox")
    )
    return rounded(layout.compare_matches(a, h, ["page_id", "name"]), "iou")


# Coverage

_EXP = """ex AS (SELECT page_id, n_name AS name FROM (SELECT DISTINCT page_id FROM block) CROSS JOIN nation WHERE n_nationkey < 12)"""


def expected_fields(spark, sf):
    names = table(spark, sf, "nation").filter("n_nationkey < 12").agg(F.array_sort(F.collect_list("n_name"))).scalar()
    return blocks(spark, sf).select("page_id").distinct().withColumn("n", names).select("page_id", F.explode("n").alias("name"))


def found_fields(spark, sf):
    return blocks(spark, sf).filter("schema <> ''").select("page_id", F.col("schema").alias("name"))


@query("j05_missing_fields", f"WITH {BLOCK}, {_EXP} SELECT page_id, name FROM ex EXCEPT SELECT page_id, schema FROM block")
def j05(spark, sf):
    return layout.missing_fields(expected_fields(spark, sf), found_fields(spark, sf), ["page_id", "name"])


@query("u04_except_fields", f"WITH {BLOCK}, {_EXP} SELECT page_id, name FROM ex EXCEPT SELECT page_id, schema FROM block WHERE label = 'Text'")
def u04(spark, sf):
    return expected_fields(spark, sf).exceptAll(found_fields(spark, sf).distinct())


@query(
    "a37_coverage",
    f"""WITH {BLOCK}, {_EXP}, fd AS (SELECT DISTINCT page_id, schema FROM block WHERE schema <> '')
    SELECT ex.page_id, count(*) AS total, count(*) FILTER (WHERE schema IS NULL) AS missing, round(1 - count(*) FILTER (WHERE schema IS NULL) / CAST(count(*) AS DOUBLE), 6) AS coverage
    FROM ex LEFT JOIN fd ON fd.page_id = ex.page_id AND fd.schema = ex.name GROUP BY 1""",
)
def a37(spark, sf):
    return rounded(layout.coverage(expected_fields(spark, sf), found_fields(spark, sf), "page_id", "name"), "coverage")


@query("a38_duplicate_schemas", f"WITH {BLOCK} SELECT page_id, schema, count(*) AS n FROM block WHERE schema <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def a38(spark, sf):
    return layout.schema_duplicates(page_html(spark, sf), ["page_id"], "html")


@query(
    "a39_merge_duplicates",
    f"""WITH {BLOCK} SELECT page_id, schema, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, '<br/>' ORDER BY pos) AS text, min(pos) AS pos, count(*) AS n
    FROM block WHERE schema <> '' GROUP BY 1, 2""",
)
def a39(spark, sf):
    return layout.merge_duplicates(blocks(spark, sf), ["page_id"], "schema", "text")


@query("a40_last_by_schema", f"WITH {BLOCK} SELECT page_id, schema, max_by(text, pos) AS text FROM block WHERE schema <> '' GROUP BY 1, 2")
def a40(spark, sf):
    b = blocks(spark, sf).filter("schema <> ''").select("page_id", "schema", "pos", "text")
    return layout.last_by_key(b, ["page_id", "schema"], "pos").drop("pos")


@query(
    "a41_first_by_key",
    f"WITH {BLOCK} SELECT page_id, label, pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id, label, schema ORDER BY pos) AS rn FROM block) WHERE rn = 1",
)
def a41(spark, sf):
    return layout.first_by_key(blocks(spark, sf), ["page_id", "label", "schema"], "pos").select("page_id", "label", "pos")


@query(
    "a36_method_histogram",
    f"""WITH RECURSIVE {_greedy(_HYBRID)}, c AS (SELECT page_id, match_method, count(*) AS n FROM matched GROUP BY 1, 2)
    SELECT page_id, CAST(sum(CASE WHEN match_method <> 'none' THEN n ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN match_method = 'none' THEN n ELSE 0 END) AS BIGINT) AS template,
      string_agg(match_method || '=' || n, ',' ORDER BY match_method || '=' || n) AS methods FROM c GROUP BY 1""",
)
def a36(spark, sf):
    return layout.method_histogram(layout.assign_hybrid(lined(spark, sf), "page_id", hybrid_sections(spark, sf), PAGE_W, PAGE_H), "page_id")


@query(
    "p13_template_fallback",
    f"""WITH RECURSIVE {PAIRS}, {_greedy(_IOU_CAND.format(floor=0.2))} SELECT m.page_id, m.name, match_method, m.score, round(coalesce(b.x0 / 1000 * 600, x_pt), 6) AS x, round(coalesce(b.y0 / 1000 * 800, y_pt), 6) AS y,
      round(coalesce(b.x1 / 1000 * 600 - b.x0 / 1000 * 600, w_pt), 6) AS width, round(coalesce(b.y1 / 1000 * 800 - b.y0 / 1000 * 800, h_pt), 6) AS height, CASE WHEN b.pos IS NULL THEN 'template' ELSE 'block' END AS bbox_source
    FROM matched m JOIN section s ON s.name = m.name LEFT JOIN block b ON b.page_id = m.page_id AND b.pos = m.block_pos""",
)
def p13(spark, sf):
    m = layout.assign_by_overlap(blocks(spark, sf), "page_id", sections(spark, sf), PAGE_W, PAGE_H, 0.2)
    out = layout.template_fallback(m, blocks(spark, sf), "page_id", sections(spark, sf), PAGE_W, PAGE_H)
    return rounded(out, "x", "y", "width", "height", "score")


@query(
    "p14_repaired_boxes",
    """WITH b AS (SELECT p_partkey, CAST(p_partkey * 7 % 1300 - 100 AS DOUBLE) AS a0, CAST(p_partkey * 11 % 1200 AS DOUBLE) AS b0, CAST(p_partkey * 13 % 1100 AS DOUBLE) AS a1, CAST(p_partkey * 17 % 900 AS DOUBLE) AS b1 FROM part),
    r AS (SELECT p_partkey, greatest(0, least(a0, a1)) AS x0, greatest(0, least(b0, b1)) AS y0, least(1000, greatest(a0, a1)) AS x1, least(1000, greatest(b0, b1)) AS y1 FROM b)
    SELECT * FROM r WHERE x0 < x1 AND y0 < y1""",
)
def p14(spark, sf):
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select(
        "p_partkey", (k * 7 % 1300 - 100).cast("double").alias("x0"), (k * 11 % 1200).cast("double").alias("y0"),
        (k * 13 % 1100).cast("double").alias("x1"), (k * 17 % 900).cast("double").alias("y1"),
    )
    return layout.repaired_boxes(d)


@query(
    "p20_compact_blocks",
    r"""SELECT page_id, md5(CASE WHEN length(t) > 320 THEN left(t, 317) || '...' ELSE t END) AS text FROM (SELECT page_id, replace(trim(html), chr(10), ' ') AS t FROM pages)""",
)
def p20(spark, sf):
    d = layout.compact_blocks(table(spark, sf, "pages"), "html", 320)
    return d.select("page_id", F.md5("html").alias("text"))


@query(
    "t09_tables_by_area",
    f"WITH {BLOCK}, t AS (SELECT page_id, pos, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY page_id ORDER BY (x1 - x0) * (y1 - y0) DESC, pos) AS rank FROM block WHERE label = 'Table') SELECT * FROM t WHERE rank <= 2",
)
def t09(spark, sf):
    return layout.tables_by_area(blocks(spark, sf), "page_id", 2).select("page_id", "pos", "area", "rank")


# Offsets

ANCHORS = [
    {"name": "Logo", "rule": "image", "box": (40.0, 50.0, 140.0, 90.0), "primary": True},
    {"name": "Title", "rule": "header", "key": "nation1", "box": (200.0, 60.0, 420.0, 80.0), "primary": True},
    {"name": "Footer", "rule": "header_lowest", "key": "nation2", "box": (40.0, 520.0, 210.0, 540.0), "primary": False},
    {"name": "Ledger", "rule": "table_big", "box": (40.0, 610.0, 570.0, 690.0), "primary": False},
    {"name": "Cash", "rule": "table_small", "box": (40.0, 350.0, 310.0, 430.0), "primary": False},
]


def _hdr(key):
    f = _FOLD.format(c="text")
    return f"label = 'Section-Header' AND (contains({f}, '{key}') OR contains('{key}', {f}))"


_ANCHOR = f"""{BLOCK}, pt AS (SELECT *, (x0 + x1) * 600 AS cx2, (y0 + y1) * 800 AS cy2, (x1 - x0) * (y1 - y0) AS area FROM block),
 c AS (SELECT 'Logo' AS name, true AS prim, 180.0 AS bx, 140.0 AS by_, page_id, cx2, cy2, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, pos) AS rn FROM pt WHERE label = 'Image'
  UNION ALL SELECT 'Title', true, 620.0, 140.0, page_id, cx2, cy2, row_number() OVER (PARTITION BY page_id ORDER BY pos) FROM pt WHERE {_hdr('nation1')}
  UNION ALL SELECT 'Footer', false, 250.0, 1060.0, page_id, cx2, cy2, row_number() OVER (PARTITION BY page_id ORDER BY cy2 DESC, pos) FROM pt WHERE {_hdr('nation2')}
  UNION ALL SELECT 'Ledger', false, 610.0, 1300.0, page_id, cx2, cy2, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, pos) FROM pt WHERE label = 'Table'
  UNION ALL SELECT 'Cash', false, 350.0, 780.0, page_id, cx2, cy2, CASE WHEN row_number() OVER (PARTITION BY page_id ORDER BY area DESC, pos) = 1 THEN 9 ELSE row_number() OVER (PARTITION BY page_id ORDER BY area, pos) END FROM pt WHERE label = 'Table'),
 anc AS (SELECT page_id, name, prim, (cx2 - bx * 1000) / 2000 AS dx, (cy2 - by_ * 1000) / 2000 AS dy FROM c WHERE rn = 1)"""


@query("x09_page_anchors", f"WITH {_ANCHOR} SELECT page_id, name, round(dx, 5) AS dx, round(dy, 5) AS dy FROM anc")
def x09(spark, sf):
    a = layout.page_anchors(blocks(spark, sf), "page_id", ANCHORS, PAGE_W, PAGE_H)
    return a.select("page_id", F.inline("anchors")).select("page_id", "name", F.round("dx", 5).alias("dx"), F.round("dy", 5).alias("dy"))


_OFF = f"""{_ANCHOR}, cnt AS (SELECT *, count(*) OVER p AS n, count(*) FILTER (WHERE prim) OVER p AS np, row_number() OVER (PARTITION BY page_id ORDER BY dy, dx) AS r1 FROM anc WINDOW p AS (PARTITION BY page_id)),
 used AS (SELECT * FROM cnt WHERE CASE WHEN np >= 2 THEN prim WHEN n >= 4 THEN r1 > 1 AND r1 < n ELSE true END),
 offs AS (SELECT page_id, (list_sort(list(dx))[(count(*) + 1) // 2] + list_sort(list(dx))[count(*) // 2 + 1]) / 2 AS dx,
  (list_sort(list(dy))[(count(*) + 1) // 2] + list_sort(list(dy))[count(*) // 2 + 1]) / 2 AS dy, CASE WHEN max(np) >= 2 THEN 'primary' WHEN max(n) >= 4 THEN 'trimmed' ELSE 'all' END AS method FROM used GROUP BY 1)"""


def offsets(spark, sf):
    return layout.robust_offset(layout.page_anchors(blocks(spark, sf), "page_id", ANCHORS, PAGE_W, PAGE_H), "page_id")


@query(
    "a43_robust_offset",
    f"WITH {_OFF} SELECT p.page_id, round(coalesce(dx, 0), 5) AS dx, round(coalesce(dy, 0), 5) AS dy, coalesce(method, 'none') AS method FROM (SELECT DISTINCT page_id FROM block) p LEFT JOIN offs ON offs.page_id = p.page_id",
)
def a43(spark, sf):
    return offsets(spark, sf).select("page_id", F.round("dx", 5).alias("dx"), F.round("dy", 5).alias("dy"), "method")


_OVER = "ov2 AS (SELECT page_id, 'NATION_' || (pk * 7 % 25) AS name, min_by(y0, pos) / 1000 * 800 AS oy0, min_by(y1, pos) / 1000 * 800 AS oy1 FROM block WHERE label = 'Text' GROUP BY 1, 2)"


@query(
    "x10_section_boxes",
    f"""WITH {_OFF}, {SECTION}, {_OVER}, s AS (SELECT p.page_id, section.name, x_pt + coalesce(dx, 0) AS a0, y_pt + coalesce(dy, 0) AS b0, x_pt + coalesce(dx, 0) + w_pt AS a1, y_pt + coalesce(dy, 0) + h_pt AS b1, oy0, oy1
      FROM (SELECT DISTINCT page_id FROM block) p CROSS JOIN section LEFT JOIN offs ON offs.page_id = p.page_id LEFT JOIN ov2 ON ov2.page_id = p.page_id AND ov2.name = section.name),
    t AS (SELECT page_id, name, greatest(0, CASE WHEN oy0 IS NOT NULL AND a0 >= 280 THEN greatest(285, a0) ELSE a0 END) AS x0, greatest(0, coalesce(oy0, b0)) AS y0,
      least(600, CASE WHEN oy0 IS NULL THEN a1 WHEN a0 < 280 THEN least(280, a1 + 60) ELSE least(594, a1 + 30) END) AS x1,
      least(800, CASE WHEN oy0 IS NOT NULL THEN oy1 WHEN name = 'NATION_24' THEN greatest(b1, 788) WHEN name = 'NATION_19' THEN greatest(b1, 640) ELSE b1 END) AS y1 FROM s)
    SELECT page_id, name, round(x0, 5) AS x0, round(y0, 5) AS y0, round(CASE WHEN x1 <= x0 THEN x0 + 1 ELSE x1 END, 5) AS x1, round(CASE WHEN y1 <= y0 THEN y0 + 1 ELSE y1 END, 5) AS y1 FROM t""",
)
def x10(spark, sf):
    b = blocks(spark, sf)
    per_page = layout.all_sections(b, "page_id", sections(spark, sf))
    over = b.filter("label = 'Text'").groupBy("page_id", F.concat(F.lit("NATION_"), (F.col("pk") * 7 % 25).cast("string")).alias("name")).agg(
        (F.min_by("y0", "pos") / 1000 * PAGE_H).alias("oy0"), (F.min_by("y1", "pos") / 1000 * PAGE_H).alias("oy1")
    )
    out = layout.section_boxes(per_page, "page_id", offsets(spark, sf), over, {"NATION_24": 900.0, "NATION_19": 640.0}, PAGE_W, PAGE_H, 12.0)
    return out.select("page_id", "name", *[F.round(c, 5).alias(c) for c in BOX])


@query(
    "f29_split_lines",
    f"""WITH {BLOCK}, l AS (SELECT page_id, pos, x0, y0, x1, y1, list_filter([text, label || ' line'], lambda t: t <> '') AS ls FROM block),
    u AS (SELECT page_id, pos, x0, x1, y0, (y1 - y0) / len(ls) AS h, unnest(ls) AS text, unnest(range(0, len(ls))) AS line FROM l)
    SELECT page_id, pos, line, text, x0, round(y0 + line * h, 6) AS y0, x1, round(y0 + (line + 1) * h, 6) AS y1 FROM u""",
)
def f29(spark, sf):
    return rounded(layout.split_lines(lined(spark, sf), ["page_id", "pos"], "lines"), "y0", "y1")


@query(
    "f30_render_targets",
    f"""WITH {BLOCK} SELECT page_id, string_agg('<div data-bbox="' || printf('%.2f %.2f %.2f %.2f', x0, y0, x1, y1) || '" data-label="' || label || '"><p>' || text || ' &amp; &lt;x&gt;</p></div>', chr(10) ORDER BY pos) AS html FROM block GROUP BY 1""",
)
def f30(spark, sf):
    d = blocks(spark, sf).withColumn("name", F.concat("text", F.lit(" & <x>")))
    return layout.render_targets(d, ["page_id"], "pos")


@query(
    "f31_render_prompt",
    f"""WITH {BLOCK} SELECT pk, concat_ws(chr(10) || chr(10), 'Extract ' || label, 'Schema:' || chr(10) || '["' || schema || '"]', CASE WHEN text <> '' THEN 'Input:' || chr(10) || text END) AS prompt FROM block""",
)
def f31(spark, sf):
    p = layout.render_prompt(
        [("", F.concat(F.lit("Extract "), "label")), ("Schema:", F.to_json(F.array("schema"))), ("Input:", F.col("text"))]
    )
    return blocks(spark, sf).select("pk", p.alias("prompt"))


# Layout of a page: one name per block and one that no block fills
_TREE = """tree AS (SELECT page_id, pos AS ord, ' NATION_' || (pk * 5 % 25) || ' ' AS name FROM block UNION ALL SELECT DISTINCT page_id, 99, 'Nowhere' FROM block),
  val AS (SELECT page_id, schema, max_by(text || '@' || label || '@' || CAST(x0 AS BIGINT), pos) AS v FROM block WHERE schema <> '' GROUP BY 1, 2)"""


def _payload(spark, sf):
    b = blocks(spark, sf)
    names = b.select("page_id", F.col("pos").alias("ord"), F.concat(F.lit(" NATION_"), (F.col("pk") * 5 % 25).cast("string"), F.lit(" ")).alias("name"))
    none = b.select("page_id").distinct().select("page_id", F.lit(99).alias("ord"), F.lit("Nowhere").alias("name"))
    return extraction.layout_payload(b.select("page_id").distinct(), "page_id", b, names.unionByName(none), "name", "ord", {"label": F.concat(F.lit("page "), "page_id")})


@query(
    "x10_layout_payload",
    f"""WITH {BLOCK}, {_TREE}, l AS (SELECT t.page_id, string_agg(t.name || '=' || coalesce(v, '-'), '|' ORDER BY ord, name) AS sections FROM tree t LEFT JOIN val ON val.page_id = t.page_id AND val.schema = trim(t.name) GROUP BY 1),
    f AS (SELECT page_id, string_agg(schema || '=' || v, '|' ORDER BY schema) AS flat FROM val GROUP BY 1)
    SELECT 'page ' || l.page_id AS label, l.page_id, sections, coalesce(flat, '') AS flat, n_blocks, shown FROM l LEFT JOIN f ON f.page_id = l.page_id
    JOIN (SELECT page_id, count(*) AS n_blocks, string_agg(label || ':' || schema, '|' ORDER BY pos) AS shown FROM block GROUP BY 1) c ON c.page_id = l.page_id""",
)
def x10_payload(spark, sf):
    shown = lambda v: F.concat(v["text"], F.lit("@"), v["label"], F.lit("@"), v["x0"].cast("long").cast("string"))
    line = F.transform("layout_with_values", lambda s: F.concat(s["name"], F.lit("="), F.coalesce(shown(s["extracted"]), F.lit("-"))))
    flat = F.transform(F.map_entries("flat_by_schema"), lambda e: F.concat(e["key"], F.lit("="), shown(e["value"])))
    return _payload(spark, sf).select(
        "page_id", F.col("meta.label").alias("label"), F.array_join(line, "|").alias("sections"), F.array_join(flat, "|").alias("flat"),
        F.size("blocks").cast("long").alias("n_blocks"), F.array_join(F.transform("blocks", lambda x: F.concat(x["label"], F.lit(":"), x["schema"])), "|").alias("shown"),
    )


# Two prompts: the second sees every third block only
_REPORT = f"""{BLOCK}, pr AS (SELECT page_id, pos, schema, unnest(CASE WHEN pk % 3 = 0 THEN ['A', 'B'] ELSE ['A'] END) AS prompt FROM block),
  want AS (SELECT page_id, prompt, n_name AS name, n_nationkey AS ord FROM (SELECT DISTINCT page_id FROM block) CROSS JOIN (SELECT unnest(['A', 'B']) AS prompt) CROSS JOIN nation WHERE n_nationkey < 12),
  got AS (SELECT page_id, prompt, schema AS name, count(*) AS n, min(pos) AS p FROM pr WHERE schema <> '' GROUP BY 1, 2, 3),
  w AS (SELECT want.*, got.n FROM want LEFT JOIN got USING (page_id, prompt, name)),
  m AS (SELECT page_id, prompt, count(*) AS total_fields, count(*) FILTER (WHERE n IS NULL) AS lost, coalesce(string_agg(name, ',' ORDER BY ord) FILTER (WHERE n IS NULL), '') AS missing FROM w GROUP BY 1, 2),
  g AS (SELECT page_id, prompt, count(*) AS extracted, coalesce(string_agg(name, ',' ORDER BY p) FILTER (WHERE n > 1), '') AS duplicates FROM got GROUP BY 1, 2),
  report AS (SELECT m.*, coalesce(extracted, 0) AS extracted, coalesce(duplicates, '') AS duplicates, (total_fields - lost) / CAST(total_fields AS DOUBLE) AS coverage FROM m LEFT JOIN g USING (page_id, prompt))"""


def _prompts(spark, sf):
    prompts = F.when(F.col("pk") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    found = blocks(spark, sf).select("page_id", F.explode(prompts).alias("prompt"), F.col("schema").alias("name"), "pos")
    fields = table(spark, sf, "nation").filter("n_nationkey < 12").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord")))).scalar()
    pages = blocks(spark, sf).select("page_id").distinct().withColumn("prompt", F.explode(F.array(F.lit("A"), F.lit("B"))))
    return pages, pages.withColumn("f", fields).select("page_id", "prompt", F.inline("f")), found


def _reports(spark, sf):
    _, expected, found = _prompts(spark, sf)
    return extraction.field_report(expected, found, ["page_id", "prompt"], "name", "ord", "pos")


@query(
    "x13_evaluation_records",
    f"""WITH {_REPORT} SELECT page_id, prompt, round(coverage, 6) AS coverage, extracted, total_fields, missing, duplicates, 'page ' || page_id AS feedback,
    round(0.5 * coverage + 0.5 * least(1, page_id % 7 / CAST(5 AS DOUBLE)), 6) AS composite_score FROM report""",
)
def x13_records(spark, sf):
    pages, expected, found = _prompts(spark, sf)
    scores = pages.select("page_id", "prompt", (F.col("page_id") % 7 / 5.0).alias("judge"), F.concat(F.lit("page "), "page_id").alias("feedback"))
    out = extraction.evaluation_records(scores, expected, found, ["page_id", "prompt"], "name", "ord", "pos", "judge")
    return rounded(out, "coverage", "composite_score").select(
        "page_id", "prompt", "coverage", "extracted", "total_fields", F.array_join("missing_fields", ",").alias("missing"),
        F.array_join("duplicate_schemas", ",").alias("duplicates"), "feedback", "composite_score",
    )


@query(
    "a37_prompt_summary",
    f"""WITH {_REPORT} SELECT prompt, count(*) AS n_pages, CAST(sum(extracted) AS BIGINT) AS extracted, CAST(sum(total_fields) AS BIGINT) AS total_fields, CAST(sum(lost) AS BIGINT) AS missing,
    round((sum(total_fields) - sum(lost)) / CAST(sum(total_fields) AS DOUBLE), 6) AS coverage, count(*) FILTER (WHERE lost = 0) AS complete_pages FROM report GROUP BY 1""",
)
def a37_prompts(spark, sf):
    return rounded(extraction.prompt_summary(_reports(spark, sf), "prompt"), "coverage")


@query("j05_missing_by_prompt", f"WITH {_REPORT} SELECT prompt, name AS field, count(*) AS n_pages FROM w WHERE n IS NULL GROUP BY 1, 2")
def j05_prompts(spark, sf):
    return extraction.missing_by_prompt(_reports(spark, sf), "prompt")


@query(
    "f31_render_fewshots",
    f"""WITH {BLOCK}, s AS (SELECT page_id, pos, '### ' || CASE WHEN label = 'Text' THEN label ELSE 'Example ' || (pos + 1) END || chr(10) || 'Fields:' || chr(10) || '["' || schema || '"]' || chr(10) || 'Answer:' || chr(10)
      || '{{"' || schema || '": ' || CAST(x0 AS BIGINT) || '}}' || chr(10) AS shot FROM block WHERE label <> 'Image' AND label <> 'Table')
    SELECT p.page_id, coalesce(string_agg(shot, chr(10) ORDER BY pos), '') AS text FROM (SELECT DISTINCT page_id FROM block) p LEFT JOIN s ON s.page_id = p.page_id GROUP BY 1""",
)
def f31_fewshots(spark, sf):
    fields = F.when(F.col("label") != "Image", F.concat(F.lit('["'), "schema", F.lit('"]'))).otherwise(F.lit("[broken"))
    answer = F.when(F.col("label") != "Table", F.concat(F.lit('{"'), "schema", F.lit('": '), F.col("x0").cast("long").cast("string"), F.lit("}")))
    d = blocks(spark, sf).select("page_id", "pos", F.when(F.col("label") == "Text", F.col("label")).alias("title"), fields.alias("fields"), answer.alias("answer"))
    return extraction.render_fewshots(d, ["page_id"], "pos", "title", [("Fields:", "fields", "array"), ("Answer:", "answer", "object")])
