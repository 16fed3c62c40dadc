"""Merging fields that are split across the pages of a document.

Rows are page labels (sample_id, page_num, field_pos, field_name, content, bbox, type). Decisions
between consecutive pages use ordered scans in long form; only the last step, which by definition
produces one text per field, brings the parts of a field together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import geometry as geo
from tracelake.functions import text as tx
from tracelake.functions.markup import html_rows, once
from tracelake.operators.ordered import null_safe_join, ordered_scan, position_chunk
from tracelake.session import stage

# Field names with aliases or a strategy of their own, labels of raw blocks.
FIELD_ALIASES = {
    "BANG KE DICH VU": "BẢNG KÊ DỊCH VỤ",
    "Bảng kê dịch vụ": "BẢNG KÊ DỊCH VỤ",
    "THONG TIN CHAN TRANG": "THÔNG TIN CHÂN TRANG",
    "Thông tin chân trang": "THÔNG TIN CHÂN TRANG",
}
AS_IS, FIRST, LAST = "as_is", "first_page", "last_page"
FOOTER, TABLE, TEXT = "footer_per_page", "table_concat_drop_repeated_headers", "text_stitch"
FIELD_STRATEGIES = {
    "THÔNG TIN CHÂN TRANG": FOOTER,
    "XÁC NHẬN": LAST,
    "GHI CHÚ": LAST,
    "BÁC SỸ ĐIỀU TRỊ": LAST,
}
BLOCK_FIELDS = {"Page-Footer": "THÔNG TIN CHÂN TRANG", "Table": "BẢNG KÊ DỊCH VỤ"}
# Default page height, cut zones, header rows always comparable, extra rows tried.
PAGE_HEIGHT, BOTTOM_ZONE, TOP_ZONE = 1200.0, 0.85, 0.15
FREE_HEADER_ROWS, MAX_EXTRA = 2, 5
# Parts of one table compared with one copy of its first part.
SALT_PARTS = 1000

DOC = ("sample_id", "field_name")
ORDER = ("page_num", "field_pos")


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """Value of a small constant table, null when absent."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def canonical_field(c: Column, aliases: Mapping[str, str] = FIELD_ALIASES) -> Column:
    return F.coalesce(lookup(c, aliases), c)


def field_occurrences(labels: DataFrame, aliases: Mapping[str, str] = FIELD_ALIASES) -> DataFrame:
    """Label rows under their canonical field name."""
    return labels.withColumn("field_name", canonical_field(F.col("field_name"), aliases))


def field_order(labels: DataFrame) -> DataFrame:
    """Position of each field by first appearance across the pages of its sample."""
    first = labels.groupBy(*DOC).agg(F.min(F.struct(*ORDER)).alias("__at"))
    # one row per field of a sample, so the window is bounded by the fields of a form
    w = Window.partitionBy("sample_id").orderBy("__at")
    return first.select(*DOC, (F.row_number().over(w) - 1).alias("field_rank"))


def tag_strategies(labels: DataFrame, by_name: Mapping[str, str] = FIELD_STRATEGIES) -> DataFrame:
    """Every label row with its part number (from 1) and the merge strategy of its field: by name, else by number of pages, else by
    the type on the first page."""
    d = ordered_scan(
        labels, list(DOC), list(ORDER), position_chunk(F.col("page_num")), rank="part", total="occurrences", firsts={"first_type": F.col("type")}
    )
    return d.withColumn("strategy", _strategy(by_name))


def _strategy(by_name: Mapping[str, str]) -> Column:
    return F.coalesce(
        lookup(F.col("field_name"), by_name),
        F.when(F.col("occurrences") == 1, AS_IS).when(F.lower("first_type") == "table", TABLE).otherwise(TEXT),
    )


def strategies(labels: DataFrame, by_name: Mapping[str, str] = FIELD_STRATEGIES) -> DataFrame:
    """Occurrences, type and merge strategy per field."""
    d = tag_strategies(labels, by_name)
    return d.groupBy(*DOC).agg(*[F.first(c).alias(c) for c in ("occurrences", "first_type", "strategy")])


def page_heights(labels: DataFrame) -> DataFrame:
    """Lowest box edge per page, 1200 where there is none."""
    low = F.max(geo.parse_box(F.col("bbox"))["y1"])
    return labels.groupBy("sample_id", "page_num").agg(F.when(low > 0, low).otherwise(F.lit(PAGE_HEIGHT)).alias("page_height"))


def page_cuts(labels: DataFrame) -> DataFrame:
    """Is each part a continuation of the previous one by position (bottom of a page, top of the next)?"""
    d = labels.join(page_heights(labels), ["sample_id", "page_num"])
    d = ordered_scan(
        d, list(DOC), list(ORDER), position_chunk(F.col("page_num")),
        rank="__r", lags={"__pb": F.col("bbox"), "__ph": F.col("page_height")},
    )
    return d.withColumn("page_cut", _cut("__r")).drop("__r", "__pb", "__ph")


def _cut(rank: str) -> Column:
    prev, cur = geo.parse_box(F.col("__pb")), geo.parse_box(F.col("bbox"))
    missing = (F.coalesce("__pb", F.lit("")) == "") | (F.coalesce("bbox", F.lit("")) == "")
    cut = F.coalesce(
        (prev["y1"] >= F.col("__ph") * BOTTOM_ZONE) & (cur["y0"] <= F.col("page_height") * TOP_ZONE), F.lit(False)
    )
    return F.when(F.col(rank) > 1, missing | cut)


def tag_parts(labels: DataFrame, by_name: Mapping[str, str] = FIELD_STRATEGIES) -> DataFrame:
    """``tag_strategies`` and ``page_cuts`` in one scan."""
    d = labels.join(page_heights(labels), ["sample_id", "page_num"])
    d = ordered_scan(
        d, list(DOC), list(ORDER), position_chunk(F.col("page_num")), rank="part", total="occurrences",
        firsts={"first_type": F.col("type")}, lags={"__pb": F.col("bbox"), "__ph": F.col("page_height")},
    )
    return d.withColumns({"page_cut": _cut("part"), "strategy": _strategy(by_name)}).drop("__pb", "__ph")


def missing_pages(pages: DataFrame, sample: str, page: str) -> DataFrame:
    """Page numbers absent between the first and last page of each sample, read off the gaps."""
    d = pages.select(sample, page).distinct()
    d = ordered_scan(d, [sample], [page], position_chunk(F.col(page)), lags={"__prev": F.col(page)})
    gap = d.filter(F.col(page) > F.col("__prev") + 1)
    return gap.select(sample, F.explode(F.sequence(F.col("__prev") + 1, F.col(page) - 1)).alias(page))


# Text


def text_parts(labels: DataFrame) -> DataFrame:
    """Parts of text fields with what happens to each: base, stitched, hyphen, newline or blank.

    A part is compared with the last non-blank part before it, whose end is the end of the text so far.
    """
    cur = F.col("content")
    solid = tx.strip(cur) != ""
    # The last characters of a part decide whether it is complete, so only they are carried forward.
    tail = F.when(solid, F.right(tx.rstrip(cur), F.lit(3)))
    d = ordered_scan(
        labels, list(DOC), list(ORDER), position_chunk(F.col("page_num")), rank="__i", total="__n", prevs={"__prev": tail}
    )
    prev = F.col("__prev")
    joined = F.when(F.rlike(prev, F.lit("-$")), "hyphen").otherwise("stitched")
    action = (
        F.when(F.col("__i") == 1, "base").when(~solid, "blank")
        .when(F.coalesce(tx.should_stitch(prev, cur), F.lit(False)), joined).otherwise("newline")
    )
    return d.withColumn("action", action).drop("__prev")


# Stands between a hyphenated end and its continuation until the text is put together.
JOINT = "\x00"


def stitch_text(labels: DataFrame) -> DataFrame:
    """One text per field from its parts."""
    d = text_parts(labels)
    last = F.col("__i") == F.col("__n")
    body = F.when(F.col("__i") == 1, F.col("content")).otherwise(tx.lstrip(F.col("content")))
    body = F.when(last, body).otherwise(tx.rstrip(body))
    lead = F.when(F.col("action") == "base", "").when(F.col("action") == "hyphen", JOINT).when(
        F.col("action") == "stitched", " "
    ).otherwise("\n")
    piece = F.when((F.col("action") == "blank") & ~last, F.lit("")).otherwise(F.concat(lead, body))
    d = d.withColumn("__p", piece)
    g = d.groupBy(*DOC).agg(F.expr("listagg(__p, '') WITHIN GROUP (ORDER BY page_num, field_pos)").alias("content"))
    return g.withColumn("content", F.regexp_replace("content", r"(?U)\s*-+\s*\x00", ""))


# Tables


def table_rows(parts: DataFrame) -> DataFrame:
    """Rows of the table parts (content is HTML) as (sample_id, field_name, page_num, row_pos, row)."""
    return parts.select(*DOC, "page_num", F.posexplode(html_rows(F.col("content"))).alias("row_pos", "row"))


def profile_rows(rows: DataFrame) -> DataFrame:
    """Rows with what the comparisons need, computed once: normal form, structure, header flag, row number."""
    d = rows.withColumn("__cells", tx.row_cells(F.col("row")))
    d = d.withColumns(
        {
            "__norm": F.xxhash64(tx.normalize_text(F.col("row"))),
            "__fp": tx.row_fingerprint(F.col("row"), F.col("__cells")),
            "__no": tx.row_number_cell(F.col("__cells")),
        }
    )
    d = d.withColumn("__head", tx.is_header_like(F.col("__fp")))
    shape = F.xxhash64("__fp.n_cells", "__fp.n_spans", "__fp.cell_lens")
    return d.select(
        *DOC, "page_num", "row_pos", "__norm", shape.alias("__shape"), "__head",
        F.when(~F.col("__head"), F.col("__no")).alias("__s"),
    )


def leading_repeats(rows: DataFrame) -> DataFrame:
    """Per part: rows and how many leading rows repeat the first part's (same text or same structure).

    Beyond two rows only header-like ones count as repeats.
    """
    return _repeats(profile_rows(rows)).drop("n_parts")


def _repeats(profiled: DataFrame) -> DataFrame:
    key = [*DOC]
    parts = profiled.groupBy(*key, "page_num").agg(F.count(F.lit(1)).alias("n_rows"))
    page = F.col("page_num")
    parts = ordered_scan(parts, key, ["page_num"], position_chunk(page), total="n_parts", firsts={"first_page": page})
    # Documents with very many parts compare all of them with the same rows: those rows are repeated
    # for every SALT_PARTS parts, so that no join key holds more.
    salts = F.ceil(F.col("n_parts") / SALT_PARTS).cast("int")
    d = null_safe_join(profiled, parts, [*key, "page_num"]).withColumn("__salt", F.pmod(F.hash("page_num"), salts))
    ref = d.filter("page_num = first_page").select(
        *key, "row_pos", F.col("__norm").alias("__rn"), F.col("__shape").alias("__rs"),
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"),
    )
    d = null_safe_join(d, ref, [*key, "row_pos", "__salt"], "left")
    same = (F.col("__norm") == F.col("__rn")) | (F.col("__shape") == F.col("__rs"))
    stop = ~F.coalesce(same, F.lit(False)) | ((F.col("row_pos") >= FREE_HEADER_ROWS) & ~F.col("__head"))
    g = d.groupBy(*key, "page_num").agg(
        F.first("n_rows").alias("n_rows"), F.min(F.when(stop, F.col("row_pos"))).alias("__stop"),
        F.first(F.col("page_num") == F.col("first_page")).alias("is_first"), F.first("n_parts").alias("n_parts"),
    )
    skip = F.when(F.col("is_first"), 0).otherwise(F.coalesce("__stop", "n_rows"))
    return g.select(*key, "page_num", "n_rows", "is_first", skip.cast("long").alias("skip"), "n_parts")


def part_profiles(parts: DataFrame) -> DataFrame:
    """Table parts (content is HTML) with the rows of each as an array of what ``profile_rows`` says.

    A page is one text, so its rows stay in its row and none is shuffled.
    """
    def profile(row: Column, cells: Column) -> Column:
        return once(tx.row_fingerprint(row, cells), lambda fp: F.struct(
            F.xxhash64(tx.normalize_text(row)).alias("norm"), F.xxhash64(fp["n_cells"], fp["n_spans"], fp["cell_lens"]).alias("shape"),
            tx.is_header_like(fp).alias("head"), F.when(~tx.is_header_like(fp), tx.row_number_cell(cells)).alias("s"),
        ))

    rows = html_rows(F.coalesce("content", F.lit("")))
    return parts.withColumn("rows", rows).withColumn("rows", F.transform("rows", lambda r: once(tx.row_cells(r), lambda c: profile(r, c))))


def part_skips(profiled: DataFrame) -> DataFrame:
    """``leading_repeats`` and kept row numbers of ``part_profiles`` (with ``part`` and ``occurrences``), and whether the first part of the
    table has rows (``started``)."""
    salts = F.ceil(F.col("occurrences") / SALT_PARTS).cast("int")
    ref = profiled.filter("part = 1").select(*DOC, F.col("rows").alias("__ref"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"))
    d = profiled.withColumn("__salt", F.pmod(F.hash("part"), salts))
    d = null_safe_join(d, ref, [*DOC, "__salt"])

    def stop(x: Column, i: Column) -> Column:
        first = F.get("__ref", i)
        same = (x["norm"] == first["norm"]) | (x["shape"] == first["shape"])
        return F.when(~F.coalesce(same, F.lit(False)) | ((i >= FREE_HEADER_ROWS) & ~x["head"]), i)

    stops = F.filter(F.transform("rows", stop), lambda i: i.isNotNull())
    d = d.withColumns({"n_rows": F.size("rows").cast("long"), "started": F.size("__ref") > 0, "is_first": F.col("part") == 1})
    d = d.withColumn("skip", F.when(F.col("is_first"), 0).otherwise(F.coalesce(F.get(stops, 0), "n_rows")).cast("long"))
    d = d.withColumn("__no", F.filter(
        F.transform("rows", lambda x, i: F.struct(i.alias("at"), x["s"].alias("s"))), lambda x: x["s"].isNotNull() & (x["at"] >= F.col("skip"))
    ))
    end = F.get("__no", F.size("__no") - 1)

    def first_from(e: int) -> Column:
        return F.get(F.filter("__no", lambda x: x["at"] >= F.col("skip") + e), 0)["s"]

    return d.withColumns({
        "first": F.array(*[first_from(e) for e in range(MAX_EXTRA)]),
        "last": F.array(*[F.when(end["at"] >= F.col("skip") + e, end["s"]) for e in range(MAX_EXTRA)]),
    }).drop("rows", "__ref", "__salt", "__no")


def sequence_ends(rows: DataFrame) -> DataFrame:
    """First and last row number (first cell) of each part, header-like rows ignored."""
    d = profile_rows(rows).withColumn("__at", F.when(F.col("__s").isNotNull(), F.col("row_pos")))
    return d.groupBy(*DOC, "page_num").agg(F.min_by("__s", "__at").alias("first_stt"), F.max_by("__s", "__at").alias("last_stt"))


def sequence_continues(rows: DataFrame) -> DataFrame:
    """Does the first row number of a part follow the last one seen before it?"""
    d = ordered_scan(
        sequence_ends(rows), list(DOC), ["page_num"], position_chunk(F.col("page_num")), prevs={"prev_stt": F.col("last_stt")}
    )
    return d.withColumn("continues", F.coalesce(F.col("first_stt") == F.col("prev_stt") + 1, F.lit(False)))


def table_skips(rows: DataFrame) -> DataFrame:
    """Rows to drop at the start of each part."""
    return table_decisions(rows).select(*DOC, "page_num", "final_skip")


def table_decisions(rows: DataFrame) -> DataFrame:
    """Rows to drop at the start of each part (``final_skip``), moved on from ``skip`` by up to four when the row numbers say so, with the
    rows of the part and the first and last row number that it keeps.

    Whether a part's skip moves depends on the last row number kept before it. For almost every part
    that number is the same whatever the part skips, so the parts of a document are cut into runs that
    end at such a part, and only within a run are the choices made one after another.
    """
    key = [*DOC]
    profiled = stage(profile_rows(rows), "table-rows")
    d = null_safe_join(profiled, _repeats(profiled), [*key, "page_num"])

    def when_from(e: int) -> Column:
        return F.when(F.col("__s").isNotNull() & (F.col("row_pos") >= F.col("skip") + e), F.col("row_pos"))

    parts = d.groupBy(*key, "page_num", "skip", "n_rows", "is_first", "n_parts").agg(
        F.array(*[F.min_by("__s", when_from(e)) for e in range(MAX_EXTRA)]).alias("first"),
        F.array(*[F.max_by("__s", when_from(e)) for e in range(MAX_EXTRA)]).alias("last"),
    )
    # One small row per part, read several times below: written once.
    return choose_skips(stage(parts, "table-parts"))


def choose_skips(parts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The decisions of ``table_decisions`` from a row per part (skip, n_rows, is_first, n_parts and, for every skip tried, the first and
    last row number kept), with the last row number kept before the part and further columns to ``keep``."""
    key = [*DOC]
    tries = F.when(F.col("is_first"), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(MAX_EXTRA), F.col("n_rows") - F.col("skip"))))
    parts = parts.withColumn("tries", tries.cast("int"))
    # A part without row numbers cannot move and tells the next one nothing: it takes no part in the runs.
    numbered = F.get("first", 0).isNotNull()
    kept = [(c, parts.schema[c].dataType.simpleString()) for c in keep]
    fields = [(c, "bigint") for c in ("page_num", "final_skip", "skip", "n_rows", "first_stt", "last_stt", "prev_stt")] + kept
    out = f"array<struct<{', '.join(f'{c}: {t}' for c, t in fields)}>>"
    none = F.lit(None).cast("long")
    still = parts.where(~numbered).select(
        *key, F.col("page_num").cast("long").alias("page_num"), F.col("skip").cast("long").alias("final_skip"), "skip", "n_rows",
        none.alias("first_stt"), none.alias("last_stt"), none.alias("prev_stt"), *keep,
    )
    parts = parts.where(numbered)
    in_order = F.array_sort(F.collect_list(F.struct("page_num", "skip", "tries", "n_rows", "first", "last", *keep))).alias("p")
    # The parts of a table of few are one run.
    short = parts.where(F.col("n_parts") <= SALT_PARTS).groupBy(*key).agg(in_order).select(*key, "p", none.alias("__open"))
    parts = parts.where(F.col("n_parts") > SALT_PARTS)
    reach = F.slice("last", 1, F.col("tries"))
    fixed = F.get(reach, 0).isNotNull() & F.forall(reach, lambda x: x.eqNullSafe(F.get(F.col("last"), 0)))
    chunk = position_chunk(F.col("page_num"))
    parts = ordered_scan(
        parts.withColumn("__end", fixed.cast("int")), key, ["page_num"], chunk, sums={"__upto": F.col("__end")}
    ).withColumn("__run", F.col("__upto") - F.col("__end"))
    runs = parts.groupBy(*key, "__run").agg(in_order)
    runs = runs.withColumn("__close", F.get(F.element_at("p", -1)["last"], 0))
    runs = ordered_scan(runs, key, ["__run"], position_chunk(F.col("__run")), lags={"__open": F.col("__close")})
    start = F.struct(
        F.col("__open").alias("state"), F.array().cast(out).alias("out")
    )

    def choose(acc: Column, p: Column) -> Column:
        hit = F.filter(F.sequence(F.lit(0), p["tries"] - 1), lambda e: F.get(p["first"], e) == acc["state"] + 1)
        e = F.coalesce(F.get(hit, 0), F.lit(0))
        return F.struct(
            F.coalesce(F.get(p["last"], e), acc["state"]).alias("state"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        p["page_num"].cast("long").alias("page_num"), (p["skip"] + e).cast("long").alias("final_skip"), p["skip"].alias("skip"),
                        p["n_rows"].alias("n_rows"), F.get(p["first"], e).alias("first_stt"), F.get(p["last"], e).alias("last_stt"),
                        acc["state"].alias("prev_stt"), *[p[c].alias(c) for c in keep],
                    )
                ),
            ).alias("out"),
        )

    runs = short.unionByName(runs.select(*key, "p", "__open"))
    return runs.select(*key, F.inline(F.aggregate("p", start, choose, lambda acc: acc["out"]))).unionByName(still)


def merged_rows(rows: DataFrame) -> DataFrame:
    """Rows that stay when the parts of each table are put one after another."""
    d = null_safe_join(rows, table_skips(rows), [*DOC, "page_num"])
    return d.filter(F.col("row_pos") >= F.col("final_skip")).select(*DOC, "page_num", "row_pos", "row")


def merge_tables(rows: DataFrame) -> DataFrame:
    """One HTML table per field."""
    g = merged_rows(rows).groupBy(*DOC).agg(
        F.expr("listagg(row, '') WITHIN GROUP (ORDER BY page_num, row_pos)").alias("content"), F.count(F.lit(1)).alias("total_rows")
    )
    return g.withColumn("content", F.concat(F.lit("<table>"), "content", F.lit("</table>")))


# Documents


def footer_lines(labels: DataFrame) -> DataFrame:
    """All non-blank footers of a field, one line per page."""
    t = tx.strip(F.col("content"))
    line = F.when(t != "", F.concat(F.lit("Trang "), F.col("page_num").cast("string"), F.lit(": "), t))
    g = labels.withColumn("__l", line).groupBy(*DOC)
    return g.agg(F.coalesce(F.expr("listagg(__l, '\n') WITHIN GROUP (ORDER BY page_num, field_pos)"), F.lit("")).alias("content"))


def pick_page(labels: DataFrame, last: bool) -> DataFrame:
    """Content, type, box and page of the first or last occurrence."""
    pick = F.max_by if last else F.min_by
    row = pick(F.struct("content", "type", "bbox", "page_num"), F.struct(*ORDER))
    return labels.groupBy(*DOC).agg(row.alias("__s")).select(*DOC, "__s.*")


def merge_documents(labels: DataFrame, aliases=FIELD_ALIASES, by_name=FIELD_STRATEGIES) -> DataFrame:
    """One row per document and field: strategy, merged content, type, box, source pages, field order."""
    # Every branch below reads the tagged labels, so they are written once.
    occ = tagged = stage(tag_strategies(field_occurrences(labels, aliases), by_name), "labels")
    plan = tagged.select(*DOC, "strategy").distinct()
    head = pick_page(occ, last=False).select(*DOC, "type", "bbox")
    pages = occ.groupBy(*DOC).agg(F.array_sort(F.collect_list("page_num")).alias("source_pages"))
    whole = null_safe_join(head, pages, list(DOC))

    def with_head(content: DataFrame) -> DataFrame:
        return null_safe_join(content.select(*DOC, "content"), whole, list(DOC))

    def of(strategy: str) -> DataFrame:
        return tagged.filter(F.col("strategy") == strategy).drop("strategy", "occurrences", "first_type")

    # two tables of one page under one name are parts of their own
    table_parts = of(TABLE).withColumn("page_num", F.col("part"))

    texts = with_head(stitch_text(of(TEXT)))
    tables = with_head(_table_contents(table_parts))
    footers = with_head(footer_lines(of(FOOTER)))
    single = pick_page(tagged.filter(F.col("strategy").isin(AS_IS, FIRST)), last=False)
    single = single.unionByName(pick_page(of(LAST), last=True))
    single = single.select(*DOC, "content", "type", "bbox", F.array("page_num").alias("source_pages"))
    merged = texts.unionByName(tables).unionByName(footers).unionByName(single)
    out = null_safe_join(merged, plan, list(DOC))
    return null_safe_join(out, field_order(occ), list(DOC))


def _table_contents(parts: DataFrame) -> DataFrame:
    """Merged tables; a field whose first part has no rows is empty, parts without rows are skipped."""
    n = F.size(html_rows(F.coalesce("content", F.lit(""))))
    first = parts.groupBy(*DOC).agg((F.min_by(n, F.struct(*ORDER)) > 0).alias("__ok"))
    merged = merge_tables(table_rows(parts))
    d = null_safe_join(first, merged, list(DOC), "left")
    return d.select(*DOC, F.when(F.col("__ok"), F.col("content")).otherwise(F.lit("")).alias("content"))


def nest_documents(merged: DataFrame) -> DataFrame:
    """One row per document with its fields in order (bounded by the fields of a form)."""
    field = F.struct("field_rank", "field_name", "strategy", "content", "type", "bbox", "source_pages")
    return merged.groupBy("sample_id").agg(F.array_sort(F.collect_list(field)).alias("fields"))


def normalize_pages(df: DataFrame, keys: Sequence[str], doc: str, aliases=FIELD_ALIASES, block_fields=BLOCK_FIELDS) -> DataFrame:
    """Field rows of page JSON in any of three shapes: fields, fields under ``fields``, or ``blocks``.

    Of several tables the longest is kept, of several footers the last.
    """
    keys = list(keys)
    block = "struct<label: string, text: variant, lines: array<string>, bbox: variant>"
    # members of another kind (numbers, texts, lists) are skipped and do not spoil the page
    members = F.from_json(F.col(doc), "map<string, variant>")
    inner = F.coalesce(F.try_variant_get(members["fields"], "$", "map<string, variant>"), members)
    objects = F.filter(F.map_entries(inner), lambda e: F.schema_of_variant(e["value"]).startswith("OBJECT"))
    field = lambda e, name: F.try_variant_get(e["value"], f"$.{name}", "string").alias(name)
    entries = F.transform(
        objects, lambda e: F.struct(e["key"].alias("key"), F.struct(field(e, "content"), field(e, "bbox"), field(e, "type")).alias("value"))
    )
    shape = F.from_json(F.col(doc), f"struct<blocks: array<{block}>>")
    d = df.withColumns({"__s": shape, "__e": entries})
    flat = d.filter("__s.blocks IS NULL").select(*keys, F.posexplode("__e").alias("pos", "e"))
    flat = flat.filter("e.value IS NOT NULL").select(
        *keys, "pos", canonical_field(F.col("e.key"), aliases).alias("field_name"), F.coalesce("e.value.content", F.lit("")).alias("content"),
        F.coalesce("e.value.bbox", F.lit("")).alias("bbox"), F.coalesce("e.value.type", F.lit("Text")).alias("type"),
    )
    b = d.filter("__s.blocks IS NOT NULL").select(*keys, F.posexplode("__s.blocks").alias("pos", "b"))
    joined = lambda v: F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), " "), F.try_variant_get(v, "$", "string"), F.lit(""))
    raw = joined(F.col("b.text"))
    shown = F.coalesce(F.array_join("b.lines", " "), raw)
    b = b.select(*keys, "pos", F.col("b.label").alias("type"), raw.alias("raw"), shown.alias("shown"), joined(F.col("b.bbox")).alias("bbox"))
    b = b.withColumn("field_name", lookup(F.col("type"), block_fields)).filter("field_name IS NOT NULL")
    is_table = F.col("type") == "Table"
    # later rows win below, so the longest table must rank last and the earlier of equals must win
    weight = F.when(is_table, F.length("shown")).otherwise(F.lit(0))
    b = b.select(
        *keys, "field_name", F.when(is_table, F.col("raw")).otherwise(F.col("shown")).alias("content"), "bbox", "type",
        F.struct(weight.alias("w"), F.when(is_table, -F.col("pos")).otherwise(F.col("pos")).alias("o")).alias("at"),
    )
    flat = flat.select(*keys, "field_name", "content", "bbox", "type", F.struct(F.lit(0).alias("w"), F.col("pos").alias("o")).alias("at"))
    every = flat.unionByName(b)
    g = every.groupBy(*keys, "field_name").agg(F.max_by(F.struct("content", "bbox", "type"), "at").alias("__s"))
    return g.select(*keys, "field_name", "__s.*")
