"""Page-layout analytics: block extraction, matching to a template, offsets, coverage.

A template that is small (its sections are counted first) is carried as an array, so a block is compared with every section
inside its own row and no block x section pairs are shuffled. A larger one meets blocks by the tiles of the page that both touch where
boxes are compared, and in several arrays where names are. One-to-one
assignments run per page on candidates that were first cut to the best ``n_sections`` per section: at
most ``n_sections - 1`` blocks can be taken before a section chooses, so the cut never changes a result
and a page's group has at most ``n_sections ** 2`` rows per pass, however many blocks it has.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import geometry as geo
from tracelake.functions import text as tx
from tracelake.operators.ordered import null_safe_join
from tracelake.session import stage

MAX_SECTIONS = 2000
# Tiles along each side of a page.
TILES = 32
SECTION_COLUMNS = ("name", "ord", "x_pt", "y_pt", "w_pt", "h_pt")

# Extraction


def find_elements(df: DataFrame, keys: Sequence[str], html: str, tags: str = "div") -> DataFrame:
    """One row per element of the given tags (a regex alternation): pos, tag, attrs, inner."""
    whole = rf"(?is)<({tags})\b([^>]*)>(.*?)</\1>"
    d = df.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(whole), F.lit(0))).alias("pos", "__el"))
    part = lambda i: F.regexp_extract("__el", whole, i)
    return d.select(*keys, "pos", F.lower(part(1)).alias("tag"), part(2).alias("attrs"), part(3).alias("inner"))


def text_lines(inner: Column) -> Column:
    """Lines between ``<br>`` tags, tags removed, whitespace collapsed, empty ones dropped."""
    lines = F.transform(
        F.split(inner, r"(?i)<br\s*/?>"),
        lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), tx.SPACE, " ")),
    )
    return F.filter(lines, lambda x: x != "")


def attribute(attrs: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(attrs, rf'(?i)\b{name}\s*=\s*"([^"]*)"', 1))


def extract_blocks(df: DataFrame, keys: Sequence[str], html: str, dedup: bool = False) -> DataFrame:
    """Layout blocks of an HTML column; elements without a valid box are dropped, reversed boxes repaired.

    With ``dedup`` the first block of each (box text, label) is kept.
    """
    keys = list(keys)
    d = find_elements(df, keys, html)
    raw = F.trim(F.regexp_extract("attrs", r'(?i)\bdata(?:-bbox)?\s*=\s*"([^"]+)"', 1))
    d = d.select(
        *keys, "pos", "inner", raw.alias("__raw"), attribute(F.col("attrs"), "data-label").alias("label"),
        F.nullif(attribute(F.col("attrs"), "data-schema"), F.lit("")).alias("schema"),
    )
    if dedup:
        first = F.row_number().over(Window.partitionBy(*keys, "__raw", "label").orderBy("pos"))
        d = d.withColumn("__rn", first).filter("__rn = 1")
    d = d.withColumns({"__b": geo.parse_box(F.col("__raw"), exact=True), "lines": text_lines(F.col("inner"))})
    x = [F.col(f"__b.{c}") for c in ("x0", "y0", "x1", "y1")]
    return d.filter(F.col("__b").isNotNull()).select(
        *keys, "pos", "label", "schema", F.least(x[0], x[2]).alias("x0"), F.least(x[1], x[3]).alias("y0"),
        F.greatest(x[0], x[2]).alias("x1"), F.greatest(x[1], x[3]).alias("y1"), "lines",
        F.array_join("lines", " ").alias("text"), "inner",
    )


NUMBER = r"(\d+(?:\.\d+)?)"
# Fixed value: form of a "Name: x0 y0 x1 y1" line.
KEY_VALUE = rf"^(.+?)\s*:\s*{NUMBER}\s+{NUMBER}\s+{NUMBER}\s+{NUMBER}(?:\s.*)?$"


def parse_key_values(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Lines ``Name: x0 y0 x1 y1`` as rows; comments, fences and degenerate boxes are skipped, the first of a name wins."""
    keys = list(keys)
    d = df.select(*keys, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "__l"))
    line = tx.strip(F.col("__l"))
    d = d.withColumn("__l", line).filter(
        ~F.startswith("__l", F.lit("#")) & ~F.startswith("__l", F.lit("```")) & F.rlike("__l", F.lit(KEY_VALUE))
    )
    part = lambda i: F.regexp_extract("__l", KEY_VALUE, i)
    n = [part(i).cast("double") for i in range(2, 6)]
    d = d.select(
        *keys, "pos", tx.strip(part(1)).alias("name"), F.least(n[0], n[2]).alias("x0"), F.least(n[1], n[3]).alias("y0"),
        F.greatest(n[0], n[2]).alias("x1"), F.greatest(n[1], n[3]).alias("y1"),
    ).filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    d = d.withColumn("folded", tx.fold_latin(F.col("name")))
    return first_by_key(d, [*keys, "folded"], "pos")


def first_by_key(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """First row of each key by position."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    return df.withColumn("__rn", rn).filter("__rn = 1").drop("__rn")


def last_by_key(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Last row of each key by position, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("__s")).select(*keys, "__s.*")


def repaired_boxes(df: DataFrame) -> DataFrame:
    """Boxes with edges swapped into order and clamped to 0..1000; degenerate ones dropped."""
    b = geo.repair(geo.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    d = df.withColumn("__b", b)
    d = d.withColumns({c: F.col(f"__b.{c}") for c in ("x0", "y0", "x1", "y1")}).drop("__b")
    return d.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))


def compact_blocks(df: DataFrame, text: str, limit: int) -> DataFrame:
    return df.withColumn(text, tx.compact_text(F.col(text), limit))


def split_lines(df: DataFrame, keys: Sequence[str], lines: str) -> DataFrame:
    """Equal-height line boxes of multi-line blocks."""
    n = F.size(lines)
    h = (F.col("y1") - F.col("y0")) / n
    d = df.select(*keys, "x0", "y0", "x1", h.alias("__h"), F.posexplode(lines).alias("line", "text"))
    return d.select(
        *keys, "line", "text", "x0", (F.col("y0") + F.col("line") * F.col("__h")).alias("y0"), "x1",
        (F.col("y0") + (F.col("line") + 1) * F.col("__h")).alias("y1"),
    )


# Template


def require_small(df: DataFrame, limit: int = MAX_SECTIONS) -> DataFrame:
    """The table itself, refused when it has more rows than may be carried in one array."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"at most {limit} rows can be carried as a template")
    return df


def _section_rows(sections: DataFrame, width: float, height: float) -> DataFrame:
    """Sections with boxes in points, 0..1 and folded names, one struct ``s`` each."""
    x, y, w, h = (F.col(c) for c in ("x_pt", "y_pt", "w_pt", "h_pt"))
    pt = geo.box(x, y, x + w, y + h)
    unit = geo.clamp(geo.box(x / width, y / height, (x + w) / width, (y + h) / height), 0.0, 1.0)
    extra = [F.col(c) for c in sections.columns if c not in SECTION_COLUMNS]
    return sections.select(F.struct("ord", "name", tx.fold_latin(F.col("name")).alias("fold"), pt.alias("pt"), unit.alias("unit"), *extra).alias("s"))


def section_array(sections: DataFrame, width: float, height: float) -> Column:
    """Template sections in ``ord`` order with boxes in points, 0..1 and folded names; refuses large templates."""
    return _section_rows(require_small(sections), width, height).agg(F.array_sort(F.collect_list("s"))).scalar()


def is_small(sections: DataFrame) -> bool:
    """May the template be carried in one array?"""
    return sections.limit(MAX_SECTIONS + 1).count() <= MAX_SECTIONS


def _chunks(rows: DataFrame, column: str) -> DataFrame:
    """Arrays of at most about ``MAX_SECTIONS`` structs, in order of their first field within each."""
    n = -(-rows.count() // MAX_SECTIONS)
    return rows.groupBy(F.pmod(F.xxhash64(column), F.lit(n)).alias("__chunk")).agg(F.array_sort(F.collect_list(column)).alias(column)).drop("__chunk")


def with_template(df: DataFrame, sections: DataFrame, width: float, height: float) -> DataFrame:
    """Rows with the sections in ``__sec``; a large template meets each row in several arrays, one row each."""
    if is_small(sections):
        return df.withColumn("__sec", section_array(sections, width, height))
    return df.crossJoin(_chunks(_section_rows(sections, width, height), "s").withColumnRenamed("s", "__sec"))


def _tile(x: Column, y: Column) -> Column:
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(TILES - 1), F.floor(v * TILES))).cast("int")
    return at(y) * TILES + at(x)


def _tiles(box: Column) -> Column:
    """Numbers of all tiles of the unit square that a box touches."""
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(TILES - 1), F.floor(v * TILES))).cast("int")
    across = lambda p, q: F.sequence(at(F.least(box[p], box[q])), at(F.greatest(box[p], box[q])))
    return F.flatten(F.transform(across("y0", "y1"), lambda y: F.transform(across("x0", "x1"), lambda x: y * TILES + x)))


def meeting_sections(blocks: DataFrame, sections: DataFrame, width: float, height: float) -> DataFrame:
    """Pairs of a block row and a section ``s`` whose boxes touch, by a join on tiles of the page.

    A pair that shares several tiles is kept in the one that holds the upper left corner of what both cover.
    """
    parts = _section_rows(sections, width, height).select("s", F.explode(_tiles(F.col("s.unit"))).alias("__tile"))
    d = blocks.withColumn("__u", unit_box()).withColumn("__tile", F.explode(_tiles(F.col("__u")))).join(parts, "__tile")
    low = lambda p, q: F.greatest(F.least(F.col(f"__u.{p}"), F.col(f"__u.{q}")), F.col(f"s.unit.{p}"))
    return d.where(F.col("__tile") == _tile(low("x0", "x1"), low("y0", "y1"))).drop("__tile")


def _best_meeting(blocks: DataFrame, sections: DataFrame, width: float, height: float, score) -> DataFrame:
    """Block rows with ``__best`` (score, -ord, name) and ``__in``, the first section that holds the centre."""
    rows = stage(blocks.withColumn("__id", F.monotonically_increasing_id()), "layout-blocks")
    pairs = meeting_sections(rows, sections, width, height)
    best = F.struct(score(F.col("__u"), F.col("s.unit")).alias("score"), (-F.col("s.ord")).alias("o"), F.col("s.name").alias("name"))
    inside = F.when(geo.center_inside(F.col("__u"), F.col("s.unit")), F.struct("s.ord", "s.name"))
    found = pairs.groupBy("__id").agg(F.max(best).alias("__best"), F.min(inside).alias("__in"))
    return rows.join(found, "__id", "left").drop("__id")


def unit_box() -> Column:
    """Box of the current block (0-1000 columns) in 0..1."""
    return geo.box(*[F.col(c) / 1000.0 for c in ("x0", "y0", "x1", "y1")])


def match_by_overlap(blocks: DataFrame, sections: DataFrame, width: float, height: float, iou_min: float) -> DataFrame:
    """Best section per block by IoU, else the first section that holds the block's centre."""
    if is_small(sections):
        d = with_template(blocks, sections, width, height).withColumn("__u", unit_box())
        scored = F.transform(
            "__sec", lambda s: F.struct(geo.iou(F.col("__u"), s["unit"]).alias("score"), (-s["ord"]).alias("o"), s["name"].alias("name"))
        )
        d = d.withColumns(
            {
                "__best": F.array_max(scored),
                "__in": F.get(F.filter("__sec", lambda s: geo.center_inside(F.col("__u"), s["unit"])), 0),
            }
        )
    else:
        d = _best_meeting(blocks, sections, width, height, geo.iou)
        d = d.withColumn("__best", F.coalesce("__best", F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("o"), F.lit(None).cast("string").alias("name"))))
    by_iou = (F.col("__best.score") > 0) & (F.col("__best.score") >= iou_min)
    return d.withColumns(
        {
            "section": F.when(by_iou, F.col("__best.name")).otherwise(F.col("__in.name")),
            "score": F.col("__best.score"),
            "method": F.when(by_iou, "iou").when(F.col("__in").isNotNull(), "center").otherwise("none"),
        }
    ).drop("__sec", "__u", "__best", "__in")


def match_by_cover(blocks: DataFrame, sections: DataFrame, width: float, height: float, min_cover: float) -> DataFrame:
    """Section that covers most of each block; below ``min_cover`` the label is the block type in brackets."""
    if is_small(sections):
        d = with_template(blocks, sections, width, height).withColumn("__u", unit_box())
        scored = F.transform(
            "__sec",
            lambda s: F.struct(geo.cover_ratio(F.col("__u"), s["unit"]).alias("score"), (-s["ord"]).alias("o"), s["name"].alias("name")),
        )
        d = d.withColumn("__best", F.array_max(scored))
    else:
        d = _best_meeting(blocks, sections, width, height, geo.cover_ratio).drop("__in")
    ok = (F.col("__best.score") > 0) & (F.col("__best.score") >= min_cover)
    return d.withColumns(
        {
            "section": F.when(ok, F.col("__best.name")).otherwise(F.concat(F.lit("("), "label", F.lit(")"))),
            "cover": F.when(F.col("__best.score") > 0, F.col("__best.score")),
        }
    ).drop("__sec", "__u", "__best")


# One-to-one assignment

ASSIGN_SCHEMA = "name string, source string, block_pos long, match_method string, score double"


def strongest(candidates: DataFrame, keys: Sequence[str], n_sections: int) -> DataFrame:
    """Best ``n_sections`` candidates of each (page, pass, section); see the module text for why this is exact."""
    w = Window.partitionBy(*keys, "step", "name").orderBy(F.desc("score"), "pos")
    return candidates.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n_sections).drop("__rn")


def greedy_choice(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each section in (step, ord) order takes its best free block; ``floor`` is the least accepted score."""
    used, done, out = set(), set(), []
    pdf = pdf.sort_values(["step", "ord", "name", "score", "pos"], ascending=[True, True, True, False, True])
    columns = [pdf[c].tolist() for c in ("step", "name", "pos", "score", "floor", "method")]
    settled = None
    for step, name, pos, score, floor, method in zip(*columns):
        if (step, name) == settled or name in done or pos in used:
            continue
        settled = (step, name)
        if score >= floor:
            used.add(pos)
            done.add(name)
            out.append((name, pos, method, score))
    return pd.DataFrame(out, columns=["name", "pos", "method", "score"])


def assign_greedy(candidates: DataFrame, page: str, sections: DataFrame) -> DataFrame:
    """One-to-one matches per page from rows (page, step, ord, name, pos, score, floor, method)."""
    n = sections.count()
    # A fixed number of partitions: the pages are small but each costs Python time, so they must not
    # be merged into few tasks by size.
    width = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = strongest(candidates, [page], n).repartition(width, page)
    page_type = candidates.schema[page].dataType.simpleString()

    def per_page(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = greedy_choice(pdf)
        out.insert(0, page, key[0])
        return out

    return kept.groupBy(page).applyInPandas(
        per_page, f"{page} {page_type}, name string, pos long, method string, score double"
    )


def all_sections(pages: DataFrame, page: str, sections: DataFrame) -> DataFrame:
    """Every (page, section) pair; the template is a bounded array exploded per page."""
    rows = sections.select(F.struct("ord", *[c for c in SECTION_COLUMNS if c != "ord"]).alias("__s"))
    each = pages.select(page).distinct()
    if is_small(sections):
        return each.withColumn("__s", rows.agg(F.array_sort(F.collect_list("__s"))).scalar()).select(page, F.inline("__s"))
    return each.crossJoin(_chunks(rows, "__s")).select(page, F.inline("__s"))


def complete_matches(matches: DataFrame, pages: DataFrame, page: str, sections: DataFrame) -> DataFrame:
    """Matches plus a template row for every section a page left open."""
    every = all_sections(pages, page, sections).select(page, "name", "ord")
    d = every.join(matches, [page, "name"], "left")
    found = F.col("pos").isNotNull()
    return d.select(
        page, "name", "ord", F.when(found, "block").otherwise("template").alias("source"), F.col("pos").alias("block_pos"),
        F.when(found, F.col("method")).otherwise("none").alias("match_method"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _candidates(keep, score, step: int, floor: float, method: str, ord_field: str = "ord") -> Column:
    """Candidate structs of one pass for the current block: kept sections with a positive score."""
    rows = F.transform(
        F.filter("__sec", keep),
        lambda s: F.struct(
            F.lit(step).alias("step"), s[ord_field].cast("long").alias("ord"), s["name"].alias("name"),
            score(s).cast("double").alias("score"), F.lit(floor).alias("floor"), F.lit(method).alias("method"),
        ),
    )
    return F.filter(rows, lambda r: r["score"] > 0)


def assign_by_overlap(blocks: DataFrame, page: str, sections: DataFrame, width: float, height: float, iou_min: float) -> DataFrame:
    """Sections in ``ord`` order take the free block with the largest IoU."""
    if is_small(sections):
        d = with_template(blocks, sections, width, height).withColumn("__u", unit_box())
    else:
        d = meeting_sections(blocks, sections, width, height).withColumn("__sec", F.array("s"))
    rows = _candidates(lambda s: F.lit(True), lambda s: geo.iou(F.col("__u"), s["unit"]), 1, iou_min, "iou")
    cand = d.select(page, "pos", F.inline(rows))
    return complete_matches(assign_greedy(cand, page, sections), blocks, page, sections)


def assign_hybrid(
    blocks: DataFrame, page: str, sections: DataFrame, width: float, height: float, iou_min: float = 0.05, text_min: float = 0.6
) -> DataFrame:
    """Five passes: header text, image, field label, table area, IoU for what is left.

    ``sections`` carries ``kind`` (header, image, field, table, free) and ``table_rank`` (order in
    which tables are handed out, largest first). ``blocks`` needs label, lines and text. The
    candidates of all passes come from one scan of the blocks.
    """
    d = with_template(blocks, sections, width, height)
    label = F.lower("label")
    d = d.withColumns(
        {
            "__u": unit_box(), "__text": tx.fold_latin(F.col("text")),
            "__field": tx.fold_latin(tx.first_label(F.col("lines"))),
        }
    )
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))

    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    header = _candidates(
        of_kind("header"), lambda s: tx.containment_similarity(s["fold"], F.col("__text")), 1, text_min, "header-text"
    )
    image = _candidates(of_kind("image"), lambda s: F.lit(1.0), 2, 0.0, "image-label")
    field = _candidates(
        of_kind("field"), lambda s: tx.containment_similarity(s["fold"], F.col("__field")), 3, text_min, "field-text"
    )
    table = _candidates(of_kind("table"), lambda s: area, 4, 0.0, "table-size", "table_rank")
    rest = _candidates(lambda s: F.lit(True), lambda s: geo.iou(F.col("__u"), s["unit"]), 5, iou_min, "iou")
    by_label = (
        F.when(label == "section-header", header).when(label == "image", image).when(label == "table", table)
        .when(label.isin("text", "form", "complex-block") & F.col("__field").isNotNull(), field)
    )
    cand = d.select(page, "pos", F.inline(F.concat(F.coalesce(by_label, F.slice(rest, 1, 0)), rest)))
    return complete_matches(assign_greedy(cand, page, sections), blocks, page, sections)


def key_value_score(section: Column, key: Column) -> Column:
    """Exact 1; prefix ratio x 0.95 (x 0.65 under five characters); containment ratio x 0.8; else 0."""
    a, b = F.length(section), F.length(key)
    ratio = F.least(a, b) / F.greatest(a, b)
    return (
        F.when(section == key, F.lit(1.0))
        .when(F.startswith(section, key) | F.startswith(key, section), ratio * F.when(F.least(a, b) < 5, 0.65).otherwise(0.95))
        .when(F.contains(section, key) | F.contains(key, section), ratio * 0.8)
        .otherwise(F.lit(0.0))
    )


def assign_key_values(entries: DataFrame, page: str, sections: DataFrame, width: float, height: float, floor: float = 0.6) -> DataFrame:
    """Sections in ``ord`` order take the free key-value entry with the most similar name."""
    d = with_template(entries, sections, width, height)
    rows = _candidates(lambda s: F.lit(True), lambda s: key_value_score(s["fold"], F.col("folded")), 1, floor, "kv-text")
    cand = d.select(page, "pos", F.inline(rows))
    return complete_matches(assign_greedy(cand, page, sections), entries, page, sections)


# Names


def fold_index(names: DataFrame, name: str, pos: str) -> DataFrame:
    """Folded key -> first canonical name."""
    return names.groupBy(tx.fold_latin(F.col(name)).alias("folded")).agg(F.min_by(name, pos).alias("canonical"))


def reconcile_names(df: DataFrame, key: str, names: DataFrame, name: str, pos: str) -> DataFrame:
    """Rows whose key folds to a known name, with that name."""
    return df.withColumn("folded", tx.fold_latin(F.col(key))).join(fold_index(names, name, pos), "folded").drop("folded")


def label_blocks(blocks: DataFrame, names: DataFrame, name: str, pos: str) -> DataFrame:
    """Deterministic name per block: its attribute, a ``key:`` line, header text, or a one-line title.

    A small list of names is a map in each row; a larger one is joined on the folded keys and the block's first hit is kept.
    """
    folded = fold_index(names, name, pos)
    lines, label = F.col("lines"), F.lower("label")
    first = F.get(lines, 0)
    heads = F.transform(lines, lambda x: F.when(F.locate(":", x) > 1, F.trim(F.substring_index(x, ":", 1))))
    titles = F.when(label == "section-header", F.array(F.col("text"), first)).when(
        (label == "text") & ~F.contains(first, F.lit(":")), F.array(first)
    ).otherwise(F.array().cast("array<string>"))
    keys = F.filter(F.concat(F.array("schema"), heads, F.coalesce(titles, F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
    if not is_small(names):
        rows = stage(blocks.withColumns({"__id": F.monotonically_increasing_id(), "__k": keys}), "layout-labels")
        at = rows.select("__id", F.posexplode("__k").alias("__p", "__key")).withColumn("folded", tx.fold_latin(F.col("__key")))
        found = at.join(folded, "folded").groupBy("__id").agg(F.min_by("canonical", "__p").alias("assigned"))
        return rows.join(found, "__id", "left").drop("__id", "__k")
    index = folded.agg(F.map_from_entries(F.collect_list(F.struct("folded", "canonical")))).scalar()
    d = blocks.withColumns({"__ix": index, "__k": keys})
    hits = F.filter(F.transform("__k", lambda x: F.try_element_at(F.col("__ix"), tx.fold_latin(x))), lambda x: x.isNotNull())
    return d.withColumn("assigned", F.get(hits, 0)).drop("__ix", "__k")


def attach_values(layout_names: DataFrame, name: str, values: DataFrame, schema: str, page: str) -> DataFrame:
    """Layout names with the extracted values of the same page whose schema equals the trimmed name."""
    v = values.withColumnsRenamed({schema: "__n", page: "__p"})
    return layout_names.join(v, F.col(page).eqNullSafe(F.col("__p")) & (F.trim(name) == F.col("__n")), "left").drop("__n", "__p")


# Coverage


def schema_duplicates(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Schema names that occur more than once in an HTML column."""
    names = F.regexp_extract_all(html, F.lit(r'(?i)data-schema\s*=\s*"([^"]*)"'), F.lit(1))
    d = df.select(*keys, F.explode(names).alias("schema")).withColumn("schema", F.trim("schema")).filter("schema <> ''")
    return d.groupBy(*keys, "schema").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_fields(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected (page, field) rows that were not found."""
    return expected.join(found.select(*keys).distinct(), list(keys), "left_anti")


def coverage(expected: DataFrame, found: DataFrame, page: str, name: str, pages: DataFrame | None = None) -> DataFrame:
    """Share of expected fields found per page; 1 for a page of ``pages`` from which no field is expected."""
    missing = missing_fields(expected, found, [page, name]).groupBy(page).agg(F.count(F.lit(1)).alias("missing"))
    total = expected.groupBy(page).agg(F.count(name).alias("total"))
    if pages is not None:
        total = null_safe_join(pages.select(page).distinct(), total, [page], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    d = total.join(missing, page, "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    return d.withColumn("coverage", F.when(F.col("total") == 0, 1.0).otherwise(1 - F.col("missing") / F.col("total")))


def merge_duplicates(blocks: DataFrame, keys: Sequence[str], schema: str, text: str) -> DataFrame:
    """Blocks of one schema name as one: union box, texts joined with ``<br/>``, position of the first."""
    t = F.nullif(F.trim(text), F.lit(""))
    d = blocks.filter(F.coalesce(schema, F.lit("")) != "").withColumn("__t", t)
    return d.groupBy(*keys, schema).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.coalesce(F.expr("listagg(__t, '<br/>') WITHIN GROUP (ORDER BY pos)"), F.lit("")).alias("text"),
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"),
    )


def method_histogram(matches: DataFrame, page: str) -> DataFrame:
    """Matched and template sections per page with a count per match method."""
    per = matches.groupBy(page, "match_method").agg(F.count(F.lit(1)).alias("n"))
    pair = F.concat("match_method", F.lit("="), F.col("n").cast("string"))
    return per.groupBy(page).agg(
        F.sum(F.when(F.col("match_method") != "none", F.col("n")).otherwise(0)).alias("matched"),
        F.sum(F.when(F.col("match_method") == "none", F.col("n")).otherwise(0)).alias("template"),
        F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("methods"),
    )


def page_height(boxes: DataFrame, keys: Sequence[str], bottom: str, default: float = 1200.0) -> DataFrame:
    """Lowest box edge per page, else the default."""
    low = F.max(bottom)
    return boxes.groupBy(*keys).agg(F.when(low > 0, low).otherwise(F.lit(default)).alias("page_height"))


def compare_matches(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Section-by-section comparison of two pipelines with the IoU of their boxes."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, F.col("source").alias(f"source_{tag}"), F.col("bbox").alias(f"bbox_{tag}"))

    d = side(a, "a").join(side(b, "b"), list(keys), "full_outer")
    iou = F.coalesce(F.when(F.col("bbox_a").isNotNull() & F.col("bbox_b").isNotNull(), geo.iou(F.col("bbox_a"), F.col("bbox_b"))), F.lit(0.0))
    return d.select(*keys, F.coalesce("source_a", F.lit("template")).alias("source_a"), F.coalesce("source_b", F.lit("template")).alias("source_b"), iou.alias("iou"))


# Offsets and final boxes


def page_anchors(blocks: DataFrame, page: str, anchors: Sequence[dict], width: float, height: float) -> DataFrame:
    """Offset (dx, dy) in points of every anchor found on a page, in one aggregate.

    An anchor has name, rule (image, header, header_lowest, table_big, table_small), box (points),
    primary flag and, for headers, key. Result: array of (name, primary, dx, dy) per page. Blocks are compared as they are given
    and offsets come from one division, so that equal areas, heights and offsets are equal numbers and the position decides.
    """
    label = F.lower("label")
    b = geo.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    text = tx.fold_latin(F.col("text"))
    d = blocks.select(page, "pos", label.alias("l"), b.alias("b"), text.alias("t"), F.col("x0").alias("nx"), F.col("y0").alias("ny"))
    size = geo.area(F.col("b"))
    at = F.struct("b", "pos")
    aggs = []
    for i, a in enumerate(anchors):
        rule = a["rule"]
        if rule == "image":
            pick = F.min_by(at, F.when(F.col("l") == "image", F.struct("ny", "nx", "pos")))
        elif rule in ("header", "header_lowest"):
            key = F.lit(a["key"])
            ok = (F.col("l") == "section-header") & (F.col("t") != "") & (F.contains("t", key) | F.contains(key, F.col("t")))
            if rule == "header":
                pick = F.min_by(at, F.when(ok, F.col("pos")))
            else:
                pick = F.max_by(at, F.when(ok, F.struct((F.col("b.y0") + F.col("b.y1")).alias("c"), (-F.col("pos")).alias("o"))))
        elif rule == "table_big":
            pick = F.max_by(at, F.when(F.col("l") == "table", F.struct(size.alias("s"), (-F.col("pos")).alias("o"))))
        else:
            pick = F.min_by(at, F.when(F.col("l") == "table", F.struct(size.alias("s"), "pos")))
        aggs.append(pick.alias(f"a{i}"))
    big = next((i for i, a in enumerate(anchors) if a["rule"] == "table_big"), None)
    g = d.groupBy(page).agg(*aggs)
    rows = []
    for i, a in enumerate(anchors):
        found = F.col(f"a{i}").isNotNull()
        if a["rule"] == "table_small" and big is not None:
            found = found & (F.col(f"a{i}.pos") != F.col(f"a{big}.pos"))
        x0, y0, x1, y1 = a["box"]
        c = F.col(f"a{i}.b")
        dx = ((c["x0"] + c["x1"]) * width - (x0 + x1) * 1000.0) / 2000.0
        dy = ((c["y0"] + c["y1"]) * height - (y0 + y1) * 1000.0) / 2000.0
        rows.append(
            F.when(
                found,
                F.struct(F.lit(a["name"]).alias("name"), F.lit(bool(a["primary"])).alias("primary"), dx.alias("dx"), dy.alias("dy")),
            )
        )
    return g.select(page, F.array_compact(F.array(*rows)).alias("anchors"))


def array_median(c: Column) -> Column:
    s = F.array_sort(c)
    n, half = F.size(s), F.floor(F.size(s) / 2).cast("int")
    return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, F.get(s, half)).otherwise(0.5 * (F.get(s, half - 1) + F.get(s, half)))


def robust_offset(df: DataFrame, page: str, anchors: str = "anchors") -> DataFrame:
    """Median offset per page: primary anchors if two or more, else without the extreme dy's, else all.

    Arrays are bounded by the number of anchors.
    """
    a = F.col(anchors)
    primary = F.filter(a, lambda x: x["primary"])
    by_dy = F.array_sort(F.transform(a, lambda x: F.struct(x["dy"].alias("dy"), x["dx"].alias("dx"))))
    as_pair = lambda arr: F.transform(arr, lambda x: F.struct(x["dy"].alias("dy"), x["dx"].alias("dx")))
    used = (
        F.when(F.size(primary) >= 2, as_pair(primary))
        .when(F.size(a) >= 4, F.slice(by_dy, 2, F.greatest(F.size(a) - 2, F.lit(0))))
        .otherwise(as_pair(a))
    )
    method = (
        F.when(F.size(a) == 0, "none").when(F.size(primary) >= 2, "primary").when(F.size(a) >= 4, "trimmed").otherwise("all")
    )
    d = df.select(page, used.alias("__u"), method.alias("method"))
    return d.select(
        page, array_median(F.transform("__u", lambda x: x["dx"])).alias("dx"),
        array_median(F.transform("__u", lambda x: x["dy"])).alias("dy"), "method",
    )


# Column limits and paddings of the final boxes, in points.
LEFT_COLUMN_MAX, RIGHT_COLUMN_MIN, LEFT_PAD, RIGHT_PAD, RIGHT_EDGE = 280.0, 285.0, 60.0, 30.0, 6.0


def section_boxes(
    sections: DataFrame, page: str, offsets: DataFrame, overrides: DataFrame, bottoms: dict[str, float], width: float, height: float,
    margin: float,
) -> DataFrame:
    """Final section boxes: shifted template, line overrides (y from the line, x by column), clipped.

    ``sections`` has one row per page and section; ``overrides`` has (page, name, oy0, oy1).
    """
    d = sections.join(offsets.select(page, "dx", "dy"), page, "left").join(overrides.select(page, "name", "oy0", "oy1"), [page, "name"], "left")
    sx0 = F.col("x_pt") + F.coalesce("dx", F.lit(0.0))
    sy0 = F.col("y_pt") + F.coalesce("dy", F.lit(0.0))
    d = d.withColumns({"sx0": sx0, "sy0": sy0, "sx1": sx0 + F.col("w_pt"), "sy1": sy0 + F.col("h_pt")})
    over = F.col("oy0").isNotNull()
    left = F.col("sx0") < LEFT_COLUMN_MAX
    x0 = F.when(over & ~left, F.greatest(F.lit(RIGHT_COLUMN_MIN), "sx0")).otherwise(F.col("sx0"))
    x1 = (
        F.when(over & left, F.least(F.lit(LEFT_COLUMN_MAX), F.col("sx1") + LEFT_PAD))
        .when(over, F.least(F.lit(width - RIGHT_EDGE), F.col("sx1") + RIGHT_PAD)).otherwise(F.col("sx1"))
    )
    target = F.coalesce(*[F.when(F.col("name") == n, F.lit(min(float(v), height - margin))) for n, v in bottoms.items()], F.lit(None))
    y0 = F.coalesce("oy0", "sy0")
    y1 = F.when(over, F.col("oy1")).otherwise(F.greatest("sy1", F.coalesce(target, F.col("sy1"))))
    d = d.withColumns(
        {
            "x0": F.greatest(F.lit(0.0), x0), "y0": F.greatest(F.lit(0.0), y0),
            "x1": F.least(F.lit(width), x1), "y1": F.least(F.lit(height), y1),
        }
    )
    return d.withColumns(
        {
            "x1": F.when(F.col("x1") <= F.col("x0"), F.col("x0") + 1.0).otherwise(F.col("x1")),
            "y1": F.when(F.col("y1") <= F.col("y0"), F.col("y0") + 1.0).otherwise(F.col("y1")),
        }
    ).drop("dx", "dy", "oy0", "oy1", "sx0", "sy0", "sx1", "sy1")


def template_fallback(matches: DataFrame, blocks: DataFrame, page: str, sections: DataFrame, width: float, height: float) -> DataFrame:
    """Final section box in points: the matched block's, else the template's, with its origin."""
    b = geo.norm1000_to_points(geo.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]), F.lit(width), F.lit(height))
    found = blocks.select(page, F.col("pos").alias("block_pos"), b.alias("__b"))
    tmpl = sections.select("name", *[F.col(c).alias(f"__{c}") for c in ("x_pt", "y_pt", "w_pt", "h_pt")])
    d = matches.join(found, [page, "block_pos"], "left").join(tmpl, "name", "left")
    c = F.col("__b")
    return d.select(
        page, "name", "match_method", "score",
        F.coalesce(c["x0"], "__x_pt").alias("x"), F.coalesce(c["y0"], "__y_pt").alias("y"),
        F.coalesce(c["x1"] - c["x0"], "__w_pt").alias("width"), F.coalesce(c["y1"] - c["y0"], "__h_pt").alias("height"),
        F.when(c.isNotNull(), "block").otherwise("template").alias("bbox_source"),
    )


def tables_by_area(blocks: DataFrame, page: str, k: int) -> DataFrame:
    """The ``k`` largest tables of each page with their rank."""
    w = Window.partitionBy(page).orderBy(F.desc("area"), "pos")
    d = blocks.filter(F.lower("label") == "table").withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# Rendering


def section_label(kind: Column) -> Column:
    """Block label of a section kind."""
    return (
        F.when(kind == "image", "Image").when(kind == "header", "Section-Header").when(kind == "table", "Table").otherwise("Text")
    )


def render_targets(sections: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """One HTML text per key: a ``div`` per section in order (columns name, label, x0..y1)."""
    box = F.format_string("%.2f %.2f %.2f %.2f", "x0", "y0", "x1", "y1")
    div = F.concat(
        F.lit('<div data-bbox="'), box, F.lit('" data-label="'), tx.escape_html(F.col("label")), F.lit('"><p>'),
        tx.escape_html(F.col("name")), F.lit("</p></div>"),
    )
    return sections.withColumn("__div", div).groupBy(*keys).agg(
        F.expr(f"listagg(__div, '\n') WITHIN GROUP (ORDER BY {pos})").alias("html")
    )


def render_prompt(parts: Sequence[tuple[str, Column]]) -> Column:
    """A prompt from (heading, column) parts; parts whose column is null or blank are left out."""
    pieces = [
        F.when(F.trim(c) != "", F.concat(F.lit(f"{heading}\n" if heading else ""), c)) for heading, c in parts
    ]
    return F.concat_ws("\n\n", *pieces)
