"""Registered queries: cross-page merging of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import provenance, stitch
from tracelake.plans.catalog import query
from tracelake.plans.fixtures import BLOCK, LABEL, TABLE_LABEL, blocks, page_labels, table, table_labels, table_parts

ALIASES = {"REMARK": "GHI CHÚ", "Footer": "THÔNG TIN CHÂN TRANG"}
_OCC = LABEL + """, occ AS (SELECT * REPLACE (CASE field_name WHEN 'REMARK' THEN 'GHI CHÚ' WHEN 'Footer' THEN 'THÔNG TIN CHÂN TRANG' ELSE field_name END AS field_name) FROM label)"""


def occurrences(spark, sf):
    return stitch.field_occurrences(page_labels(spark, sf), ALIASES)


@query("x04_field_occurrences", f"WITH {_OCC} SELECT sample_id, page_num, field_pos, field_name FROM occ")
def x04(spark, sf):
    return occurrences(spark, sf).select("sample_id", "page_num", "field_pos", "field_name")


@query("p16_canonical_field", f"WITH {_OCC} SELECT field_name, count(*) AS n FROM occ GROUP BY 1")
def p16(spark, sf):
    return occurrences(spark, sf).groupBy("field_name").agg(F.count(F.lit(1)).alias("n"))


_STRAT = """g AS (SELECT sample_id, field_name, count(*) AS occurrences, min_by(type, page_num * 10 + field_pos) AS t FROM occ GROUP BY 1, 2),
 strat AS (SELECT sample_id, field_name, occurrences, CASE WHEN field_name = 'THÔNG TIN CHÂN TRANG' THEN 'footer_per_page' WHEN field_name = 'GHI CHÚ' THEN 'last_page' WHEN occurrences = 1 THEN 'as_is'
   WHEN lower(t) = 'table' THEN 'table_concat_drop_repeated_headers' ELSE 'text_stitch' END AS strategy FROM g)"""


@query("p17_strategies", f"WITH {_OCC}, {_STRAT} SELECT * FROM strat")
def p17(spark, sf):
    return stitch.strategies(occurrences(spark, sf)).drop("first_type")


@query(
    "w12_field_order",
    f"WITH {_OCC} SELECT sample_id, field_name, row_number() OVER (PARTITION BY sample_id ORDER BY seen) - 1 AS field_rank FROM (SELECT sample_id, field_name, min(page_num * 10 + field_pos) AS seen FROM occ GROUP BY 1, 2)",
)
def w12(spark, sf):
    return stitch.field_order(occurrences(spark, sf))


_HEIGHT = "ht AS (SELECT sample_id, page_num, coalesce(nullif(max(CASE WHEN bbox <> '' THEN CAST(split_part(bbox, ' ', 4) AS DOUBLE) END), 0), 1200) AS page_height FROM occ GROUP BY 1, 2)"


@query("a42_page_height", f"WITH {_OCC}, {_HEIGHT} SELECT * FROM ht")
def a42(spark, sf):
    return stitch.page_heights(occurrences(spark, sf))


@query(
    "w10_page_cuts",
    f"""WITH {_OCC}, {_HEIGHT}, l AS (SELECT occ.*, page_height, lag(bbox) OVER w AS pb, lag(page_height) OVER w AS ph, row_number() OVER w AS rn FROM occ JOIN ht USING (sample_id, page_num) WINDOW w AS (PARTITION BY sample_id, field_name ORDER BY page_num, field_pos))
    SELECT sample_id, field_name, page_num, CASE WHEN rn > 1 THEN CASE WHEN pb = '' OR bbox = '' THEN true ELSE CAST(split_part(pb, ' ', 4) AS DOUBLE) >= ph * 0.85 AND CAST(split_part(bbox, ' ', 2) AS DOUBLE) <= page_height * 0.15 END END AS page_cut FROM l""",
)
def w10(spark, sf):
    return stitch.page_cuts(occurrences(spark, sf)).select("sample_id", "field_name", "page_num", "page_cut")


@query(
    "j06_missing_pages",
    "WITH r AS (SELECT source, unnest(range(min(doc_id), max(doc_id) + 1)) AS doc_id FROM documents GROUP BY 1) SELECT source, doc_id FROM r EXCEPT SELECT source, doc_id FROM documents",
)
def j06(spark, sf):
    return stitch.missing_pages(table(spark, sf, "documents"), "source", "doc_id")


_STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_LAST = "regexp_replace(regexp_extract({c}, '[^\\n]*$'), '^[\\s\\p{{Z}}]+', '')"
_TXT = f"""tp AS (SELECT occ.*, row_number() OVER w AS i, count(*) OVER (PARTITION BY sample_id, field_name) AS n, {_STRIP.format(c='content')} AS st FROM occ JOIN strat USING (sample_id, field_name) WHERE strategy = 'text_stitch' WINDOW w AS (PARTITION BY sample_id, field_name ORDER BY page_num, field_pos)),
 tq AS (SELECT *, lag(st) OVER (PARTITION BY sample_id, field_name ORDER BY page_num, field_pos) AS pv, regexp_extract(st, '^[^\\n]*') AS fl FROM tp WHERE st <> ''),
 tr AS (SELECT *, CASE WHEN i = 1 THEN 'base' WHEN pv IS NULL THEN 'newline' WHEN regexp_matches(pv, '-$') THEN 'hyphen'
   WHEN NOT regexp_matches(pv, '[.!?…]['')\\]\\x22]?$') AND NOT regexp_matches(pv, '[.!?:;]$') AND regexp_matches(fl, '^[\\p{{Ll}}\\p{{Nd}}\\x22''(\\[]')
     AND NOT regexp_matches(fl, '(?i)^(Chẩn bệnh|Họ tên|Ngày sinh|Giường|Buồng|Ngày vào|Mã số|Bộ Y tế|Ghi chú|Người lập)') THEN 'stitched' ELSE 'newline' END AS action FROM tq),
 tall AS (SELECT sample_id, field_name, page_num, field_pos, i, n, content, action FROM tr UNION ALL SELECT sample_id, field_name, page_num, field_pos, i, n, content, CASE WHEN i = 1 THEN 'base' ELSE 'blank' END FROM tp WHERE st = '')""".replace("{{", "{").replace("}}", "}")


@query("x05_text_parts", f"WITH {_OCC}, {_STRAT}, {_TXT} SELECT sample_id, field_name, page_num, action FROM tall")
def x05_parts(spark, sf):
    return stitch.text_parts(_text_labels(spark, sf)).select("sample_id", "field_name", "page_num", "action")


def _text_labels(spark, sf):
    occ = occurrences(spark, sf)
    plan = stitch.strategies(occ).filter(F.col("strategy") == stitch.TEXT)
    return occ.join(plan.select(*stitch.DOC), list(stitch.DOC), "left_semi")


_TEXTS = """pc AS (SELECT *, CASE WHEN i = 1 THEN content ELSE regexp_replace(content, '^[\\s\\p{Z}]+', '') END AS b0 FROM tall),
 pd AS (SELECT *, CASE WHEN i = n THEN b0 ELSE regexp_replace(b0, '[\\s\\p{Z}]+$', '') END AS b FROM pc),
 texts AS (SELECT sample_id, field_name, regexp_replace(string_agg(CASE WHEN action = 'blank' AND i < n THEN '' ELSE CASE action WHEN 'base' THEN '' WHEN 'hyphen' THEN chr(1) WHEN 'stitched' THEN ' ' ELSE chr(10) END || b END, '' ORDER BY page_num, field_pos), '[\\s\\p{Z}]*-+[\\s\\p{Z}]*\\x01', '', 'g') AS content FROM pd GROUP BY 1, 2)"""


@query("x05_stitch_text", f"WITH {_OCC}, {_STRAT}, {_TXT}, {_TEXTS} SELECT sample_id, field_name, md5(content) AS content FROM texts")
def x05(spark, sf):
    return stitch.stitch_text(_text_labels(spark, sf)).select("sample_id", "field_name", F.md5("content").alias("content"))


@query(
    "f23_text_predicates",
    f"""WITH {LABEL}, a AS (SELECT *, {_STRIP.format(c='content')} AS st FROM label), b AS (SELECT *, regexp_extract(st, '^[^\\n]*') AS fl FROM a)
    SELECT sample_id, page_num, field_name, st = '' OR regexp_matches(st, '-$') OR NOT (regexp_matches(st, '[.!?…]['')\\]\\x22]?$') OR regexp_matches(st, '[.!?:;]$')) AS incomplete,
     fl = '' OR (regexp_matches(fl, '^[\\p{{Ll}}\\p{{Nd}}\\x22''(\\[]') AND NOT regexp_matches(fl, '(?i)^(Chẩn bệnh|Họ tên|Ngày sinh|Giường|Buồng|Ngày vào|Mã số|Bộ Y tế|Ghi chú|Người lập)')) AS continuation FROM b""",
)
def f23(spark, sf):
    from tracelake.functions import text as tx

    c = F.col("content")
    return page_labels(spark, sf).select(
        "sample_id", "page_num", "field_name", tx.looks_incomplete(c).alias("incomplete"), tx.looks_continuation(c).alias("continuation")
    )


# Tables

_ROWS = """tb AS (SELECT o_orderkey // 12 AS sample_id, o_orderkey % 12 // 4 AS page_num, o_orderkey % 4 + 2 AS row_pos, o_orderkey % 12 + 1 AS stt,
   '<tr><td>' || (o_orderkey % 12 + 1) || '</td><td>' || o_orderpriority || '</td><td>' || CAST(trunc(o_totalprice) AS BIGINT) || '</td></tr>' AS row FROM orders)"""


@query(
    "f27_row_fingerprint",
    f"WITH {_ROWS} SELECT sample_id, page_num, row_pos, 3 AS n_cells, 0 AS n_spans, length(split_part(split_part(row, '<td>', 3), '<', 1)) AS len2, 2 AS n_numeric, false AS header FROM tb",
)
def f27(spark, sf):
    from tracelake.functions import text as tx

    fp = tx.row_fingerprint(F.col("row"))
    d = table_parts(spark, sf).filter("row_pos > 1").withColumn("f", fp)
    return d.select(
        "sample_id", "page_num", "row_pos", "f.n_cells", "f.n_spans", F.get("f.cell_lens", 1).alias("len2"), "f.n_numeric",
        tx.is_header_like(F.col("f")).alias("header"),
    )


@query("x06_leading_repeats", f"WITH {_ROWS} SELECT sample_id, page_num, count(*) + 2 AS n_rows, CASE WHEN page_num = 0 THEN 0 ELSE 2 END AS skip FROM tb GROUP BY 1, 2")
def x06_skip(spark, sf):
    return stitch.leading_repeats(table_parts(spark, sf)).select("sample_id", "page_num", "n_rows", "skip")


@query(
    "w11_sequence_continues",
    f"""WITH {_ROWS}, e AS (SELECT sample_id, page_num, min(stt) AS first_stt, max(stt) AS last_stt FROM tb GROUP BY 1, 2)
    SELECT sample_id, page_num, first_stt, last_stt, coalesce(first_stt = lag(last_stt) OVER (PARTITION BY sample_id ORDER BY page_num) + 1, false) AS continues FROM e""",
)
def w11(spark, sf):
    return stitch.sequence_continues(table_parts(spark, sf)).select("sample_id", "page_num", "first_stt", "last_stt", "continues")


@query(
    "x06_merge_tables",
    f"""WITH {_ROWS} SELECT sample_id, '<table><tr><td colspan=''3''>Orders</td></tr><tr><td>No</td><td>Priority</td><td>Total</td></tr>' || string_agg(row, '' ORDER BY page_num, row_pos) || '</table>' AS content, count(*) + 2 AS total_rows FROM tb GROUP BY 1""",
)
def x06(spark, sf):
    return stitch.merge_tables(table_parts(spark, sf)).drop("field_name")


@query("k06_merged_rows", f"WITH {_ROWS} SELECT sample_id, page_num, row_pos, md5(row) AS row FROM tb UNION ALL SELECT DISTINCT sample_id, 0, 0, md5('<tr><td colspan=''3''>Orders</td></tr>') FROM tb UNION ALL SELECT DISTINCT sample_id, 0, 1, md5('<tr><td>No</td><td>Priority</td><td>Total</td></tr>') FROM tb")
def k06(spark, sf):
    return stitch.merged_rows(table_parts(spark, sf)).select("sample_id", "page_num", "row_pos", F.md5("row").alias("row"))


# Documents

_FOOT = """foot AS (SELECT sample_id, field_name, coalesce(string_agg(CASE WHEN trim(content) <> '' THEN 'Trang ' || page_num || ': ' || trim(content) END, chr(10) ORDER BY page_num), '') AS content FROM occ WHERE field_name = 'THÔNG TIN CHÂN TRANG' GROUP BY 1, 2)"""


@query("x07_footer_lines", f"WITH {_OCC}, {_FOOT} SELECT * FROM foot")
def x07(spark, sf):
    return stitch.footer_lines(occurrences(spark, sf).filter("field_name = 'THÔNG TIN CHÂN TRANG'"))


@query(
    "x07_pick_page",
    f"WITH {_OCC} SELECT sample_id, field_name, md5(min_by(content, page_num)) AS first_content, min(page_num) AS first_page, md5(max_by(content, page_num)) AS last_content, max(page_num) AS last_page FROM occ GROUP BY 1, 2",
)
def x07_pick(spark, sf):
    occ = occurrences(spark, sf)
    a = stitch.pick_page(occ, last=False).select(*stitch.DOC, F.md5("content").alias("first_content"), F.col("page_num").alias("first_page"))
    b = stitch.pick_page(occ, last=True).select(*stitch.DOC, F.md5("content").alias("last_content"), F.col("page_num").alias("last_page"))
    return a.join(b, list(stitch.DOC))


_MERGED = f"""{_OCC}, {_STRAT}, {_TXT}, {_TEXTS}, {_FOOT}, fo AS (SELECT sample_id, field_name, row_number() OVER (PARTITION BY sample_id ORDER BY seen) - 1 AS field_rank FROM (SELECT sample_id, field_name, min(page_num * 10 + field_pos) AS seen FROM occ GROUP BY 1, 2)),
 pg AS (SELECT sample_id, field_name, string_agg(page_num, ',' ORDER BY page_num) AS pages, min_by(content, page_num) AS fc, max_by(content, page_num) AS lc, min(page_num) AS fp, max(page_num) AS lp, min_by(bbox, page_num) AS fb, max_by(bbox, page_num) AS lb FROM occ GROUP BY 1, 2),
 mg AS (SELECT s.sample_id, s.field_name, strategy, CASE strategy WHEN 'text_stitch' THEN t.content WHEN 'footer_per_page' THEN f.content WHEN 'last_page' THEN lc ELSE fc END AS content,
   CASE strategy WHEN 'last_page' THEN lb ELSE fb END AS bbox, CASE strategy WHEN 'last_page' THEN CAST(lp AS VARCHAR) WHEN 'as_is' THEN CAST(fp AS VARCHAR) ELSE pages END AS source_pages, field_rank
   FROM strat s JOIN pg USING (sample_id, field_name) JOIN fo USING (sample_id, field_name) LEFT JOIN texts t ON t.sample_id = s.sample_id AND t.field_name = s.field_name LEFT JOIN foot f ON f.sample_id = s.sample_id AND f.field_name = s.field_name)"""


@query("x08_merge_documents", f"WITH {_MERGED} SELECT sample_id, field_name, strategy, md5(content) AS content, bbox, source_pages, field_rank FROM mg")
def x08(spark, sf):
    out = stitch.merge_documents(page_labels(spark, sf), ALIASES)
    return out.select(
        "sample_id", "field_name", "strategy", F.md5("content").alias("content"), "bbox",
        F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("source_pages"), "field_rank",
    )


@query("x08_nested_documents", f"WITH {_MERGED} SELECT sample_id, string_agg(field_name || ':' || strategy, '|' ORDER BY field_rank) AS fields FROM mg GROUP BY 1")
def x08_nested(spark, sf):
    out = stitch.nest_documents(stitch.merge_documents(page_labels(spark, sf), ALIASES))
    return out.select("sample_id", F.array_join(F.transform("fields", lambda f: F.concat(f["field_name"], F.lit(":"), f["strategy"])), "|").alias("fields"))


_NOTES = f"""{_MERGED}, tnote AS (SELECT sample_id, field_name, string_agg(CASE WHEN n = 1 THEN 'single occurrence' ELSE 'page_part_' || (i - 1) || ': ' || CASE action WHEN 'base' THEN 'base' WHEN 'hyphen' THEN 'stitched (incomplete+continuation)' WHEN 'stitched' THEN 'stitched (incomplete+continuation)' ELSE 'concatenated with newline' END END, '|' ORDER BY i) AS notes FROM tall GROUP BY 1, 2),
 mn AS (SELECT m.sample_id, m.field_name, m.strategy, source_pages, field_rank, CASE m.strategy WHEN 'footer_per_page' THEN 'per-page footer preserved' WHEN 'text_stitch' THEN t.notes
   WHEN 'last_page' THEN CASE WHEN occurrences = 1 THEN 'single occurrence' ELSE 'last page' END ELSE 'single occurrence' END AS notes
   FROM mg m JOIN strat USING (sample_id, field_name) LEFT JOIN tnote t ON t.sample_id = m.sample_id AND t.field_name = m.field_name)"""


def _joined(c, sep):
    return F.array_join(F.col(c).cast("array<string>"), sep)


@query("x08_merge_notes", f"WITH {_NOTES} SELECT * FROM mn")
def x08_notes(spark, sf):
    d = provenance.merge_notes(page_labels(spark, sf), ALIASES)
    return d.select("sample_id", "field_name", "strategy", _joined("source_pages", ",").alias("source_pages"), "field_rank", _joined("notes", "|").alias("notes"))


@query(
    "x08_merge_log",
    f"""WITH {_NOTES}, pn AS (SELECT sample_id, count(DISTINCT page_num) AS n_pages, string_agg(DISTINCT CAST(page_num AS VARCHAR), ',' ORDER BY CAST(page_num AS VARCHAR)) AS page_numbers FROM occ GROUP BY 1)
    SELECT sample_id, any_value(n_pages) AS n_pages, any_value(page_numbers) AS page_numbers, string_agg(field_name || ':' || strategy || ':' || source_pages || ':' || notes, ';' ORDER BY field_rank) AS log FROM mn JOIN pn USING (sample_id) GROUP BY 1""",
)
def x08_log(spark, sf):
    d = provenance.merge_log(page_labels(spark, sf), ALIASES)
    entry = lambda e: F.concat_ws(":", e["field"], e["strategy"], F.array_join(e["source_pages"].cast("array<string>"), ","), F.array_join(e["notes"], "|"))
    pages = F.array_join(F.array_sort(F.col("page_numbers").cast("array<string>")), ",")
    return d.select("sample_id", "n_pages", pages.alias("page_numbers"), F.array_join(F.transform("log", entry), ";").alias("log"))


_TABLE_NOTES = f"""{TABLE_LABEL}, tdec AS (SELECT *, kind <> 1 AND coalesce(first_stt = prev + 1, false) AS cont, n + 2 + CASE WHEN kind = 2 AND part > 0 THEN 1 ELSE 0 END AS n_rows FROM tseen),
 tkept AS (SELECT *, CASE WHEN part = 0 THEN 0 WHEN kind = 2 AND cont THEN 3 ELSE 2 END AS skip FROM tdec),
 tline AS (SELECT sample_id, part, CASE WHEN parts = 1 THEN 'single occurrence' WHEN part = 0 THEN 'page_part_0: kept ' || n_rows || ' rows (incl. header)'
   WHEN gone THEN 'page_part_' || part || ': no rows, skipped'
   ELSE 'page_part_' || part || ': bbox ' || CASE WHEN page_num % 2 = 1 THEN 'page-cut continuation' ELSE 'weak page-cut signal' END
     || CASE WHEN skip = 3 THEN '|page_part_' || part || ': stt adjusted skip 2->3' ELSE '' END
     || CASE WHEN cont THEN '|page_part_' || part || ': stt continuation confirmed' ELSE '' END
     || '|page_part_' || part || ': skipped ' || skip || ' repeated prefix rows, appended ' || (n_rows - skip) || ' rows' END AS note,
   parts, CASE WHEN gone THEN 0 ELSE n_rows - skip END AS kept FROM tkept)"""


@query(
    "x06_table_notes",
    f"WITH {_TABLE_NOTES} SELECT sample_id, string_agg(note, '|' ORDER BY part) || CASE WHEN any_value(parts) = 1 THEN '' ELSE '|total_rows=' || sum(kept) END AS notes FROM tline GROUP BY 1",
)
def x06_notes(spark, sf):
    d = provenance.merge_notes(table_labels(spark, sf))
    return d.select("sample_id", _joined("notes", "|").alias("notes"))


@query(
    "x06_unclosed_rows",
    f"""WITH {_ROWS}, u AS (SELECT sample_id, page_num, row_pos, '<tr>' || stt || string_split(string_split(row, '<td>')[3], '<')[1] || string_split(string_split(row, '<td>')[4], '<')[1] || '</tr>' AS row FROM tb
      UNION ALL SELECT DISTINCT sample_id, page_num, 0, '<tr>Orders</tr>' FROM tb UNION ALL SELECT DISTINCT sample_id, page_num, 1, '<tr>NoPriorityTotal</tr>' FROM tb)
    SELECT * FROM u WHERE sample_id % 3 = 1 AND NOT (page_num = 1 AND sample_id % 5 = 4)""",
)
def x06_unclosed(spark, sf):
    return stitch.table_rows(table_labels(spark, sf).filter("sample_id % 3 = 1")).drop("field_name")


@query(
    "p19_normalize_pages",
    f"""WITH {BLOCK}, s AS (SELECT page_id, 'f' || pos AS field_name, text AS content, label AS type FROM block WHERE page_id % 3 > 0),
    t AS (SELECT page_id, 'BẢNG KÊ DỊCH VỤ' AS field_name, text AS content, 'Table' AS type FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(text) DESC, pos) AS rn FROM block WHERE page_id % 3 = 0 AND label = 'Table') WHERE rn = 1),
    f AS (SELECT page_id, 'THÔNG TIN CHÂN TRANG', text, 'Page-Footer' FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) AS rn FROM block WHERE page_id % 3 = 0 AND label = 'Section-Header') WHERE rn = 1)
    SELECT * FROM s UNION ALL SELECT * FROM t UNION ALL SELECT * FROM f""",
)
def p19(spark, sf):
    b = blocks(spark, sf)
    field = F.struct(
        F.concat(F.lit("f"), F.col("pos").cast("string")).alias("k"),
        F.struct(F.col("text").alias("content"), F.lit("1 2 3 4").alias("bbox"), F.col("label").alias("type")).alias("v"),
    )
    block = F.struct(
        F.when(F.col("label") == "Section-Header", "Page-Footer").otherwise(F.col("label")).alias("label"), F.col("text").alias("text"),
        F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("bbox"),
    )
    g = b.groupBy("page_id").agg(
        F.map_from_entries(F.collect_list(field)).alias("m"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]).alias("bs"),
    )
    doc = (
        F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct(F.col("bs").alias("blocks"))))
        .when(F.col("page_id") % 3 == 1, F.to_json(F.struct(F.col("m").alias("fields")))).otherwise(F.to_json("m"))
    )
    return stitch.normalize_pages(g.select("page_id", doc.alias("doc")), ["page_id"], "doc").drop("bbox")
