"""What a field extraction gave: payload per page, coverage reports, evaluation records, worked examples.

Results are one row per page, run or prompt whose lists are as long as its schema or its blocks. Reports meet expected and found
names in one grouping on (keys, name), so a hot page or label is spread over its names and only counted names reach its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scoring import composite_score
from tracelake.operators.ordered import null_safe_join

VALUE = ("text", "label", "x0", "y0", "x1", "y1")


def layout_payload(
    pages: DataFrame, page: str, blocks: DataFrame, tree: DataFrame, name: str, ord: str, meta: dict[str, Column] | None = None
) -> DataFrame:
    """Per page its layout tree with extracted values, the values by schema name, all blocks, and a ``meta`` struct.

    ``blocks`` has the page, pos, schema and ``VALUE``; of several blocks of a schema name the last by pos counts. ``tree`` is the
    page's layout, a row per name with its place ``ord``; a name takes the value whose schema equals it once trimmed, else null.
    ``meta`` gives columns of ``pages``. A page without blocks or layout has empty lists.
    """
    value = F.struct(*VALUE)
    per_page = blocks.groupBy(page).agg(
        F.array_sort(F.collect_list(F.struct("pos", "schema", *VALUE))).alias("blocks")
    )
    named = blocks.filter(F.coalesce("schema", F.lit("")) != "").groupBy(page, "schema").agg(F.max_by(value, "pos").alias("extracted"))
    flat = named.groupBy(page).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("schema", "extracted")))).alias("flat_by_schema"))
    values = named.withColumnRenamed("schema", "__name")
    places = tree.select(page, F.col(ord).alias("ord"), F.col(name).alias("name"), F.trim(name).alias("__name"))
    layout = null_safe_join(places, values, [page, "__name"], "left").groupBy(page).agg(
        F.array_sort(F.collect_list(F.struct("ord", "name", "extracted"))).alias("layout_with_values")
    )
    out = pages.select(page, F.struct(*[c.alias(k) for k, c in (meta or {"page": F.col(page)}).items()]).alias("meta"))
    for part in (layout, flat, per_page):
        out = null_safe_join(out, part, [page], "left")
    blank = {c: F.from_json(F.lit("{}" if c == "flat_by_schema" else "[]"), out.schema[c].dataType) for c in ("layout_with_values", "flat_by_schema", "blocks")}
    return out.withColumns({c: F.coalesce(c, e) for c, e in blank.items()})


def field_report(expected: DataFrame, found: DataFrame, keys: Sequence[str], name: str, ord: str, pos: str) -> DataFrame:
    """Per key: coverage, extracted and total_fields, missing_fields in schema order, duplicate_schemas in page order.

    Blank found names are ignored; a name that the schema lists twice counts twice; with nothing expected the coverage is 1.
    """
    keys = list(keys)
    wanted = expected.select(*keys, name, F.col(ord).cast("long").alias("__ord"), F.lit(None).cast("long").alias("__pos"))
    seen = found.select(*keys, F.trim(name).alias(name), F.lit(None).cast("long").alias("__ord"), F.col(pos).cast("long").alias("__pos"))
    names = wanted.unionByName(seen.filter(F.col(name) != "")).groupBy(*keys, name).agg(
        F.collect_list("__ord").alias("__ords"), F.count("__pos").alias("__n"), F.min("__pos").alias("__first")
    )
    lost = F.when(F.col("__n") == 0, F.transform("__ords", lambda o: F.struct(o.alias("o"), F.col(name).alias("name"))))
    twice = F.when(F.col("__n") > 1, F.struct(F.col("__first").alias("o"), F.col(name).alias("name")))
    in_order = lambda c: F.transform(F.array_sort(c), lambda s: s["name"])
    total = F.sum(F.size("__ords"))
    missing = F.sum(F.when(F.col("__n") == 0, F.size("__ords")).otherwise(0))
    return names.groupBy(*keys).agg(
        F.when(total == 0, F.lit(1.0)).otherwise((total - missing) / total).alias("coverage"),
        F.count(F.when(F.col("__n") > 0, True)).alias("extracted"), total.alias("total_fields"),
        in_order(F.flatten(F.collect_list(lost))).alias("missing_fields"),
        in_order(F.collect_list(twice)).alias("duplicate_schemas"),
    )


def evaluation_records(
    scores: DataFrame, expected: DataFrame, found: DataFrame, keys: Sequence[str], name: str, ord: str, pos: str, judge: str,
    w_coverage: float = 0.5, w_judge: float = 0.5,
) -> DataFrame:
    """``scores`` (keys, a judge score, further columns such as feedback) with the field report and the composite score.

    A row for which nothing is expected or found has coverage 1 and empty lists.
    """
    none = F.array().cast("array<string>")
    d = null_safe_join(scores, field_report(expected, found, keys, name, ord, pos), list(keys), "left")
    d = d.withColumns(
        {
            "coverage": F.coalesce("coverage", F.lit(1.0)),
            **{c: F.coalesce(c, F.lit(0).cast("long")) for c in ("extracted", "total_fields")},
            **{c: F.coalesce(c, none) for c in ("missing_fields", "duplicate_schemas")},
        }
    )
    return d.withColumn("composite_score", composite_score(F.col("coverage"), F.col(judge), w_coverage, w_judge))


def prompt_summary(reports: DataFrame, label: str) -> DataFrame:
    """Field reports of many pages by prompt label: pages, fields, coverage over all fields and complete pages."""
    total, missing = F.sum("total_fields"), F.sum(F.size("missing_fields"))
    return reports.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("extracted").alias("extracted"), total.alias("total_fields"), missing.alias("missing"),
        F.when(total == 0, F.lit(1.0)).otherwise((total - missing) / total).alias("coverage"),
        F.count(F.when(F.size("missing_fields") == 0, True)).alias("complete_pages"),
    )


def missing_by_prompt(reports: DataFrame, label: str) -> DataFrame:
    """How many pages each prompt left each field open on."""
    return reports.select(label, F.explode("missing_fields").alias("field")).groupBy(label, "field").agg(F.count(F.lit(1)).alias("n_pages"))


def render_fewshots(
    shots: DataFrame, keys: Sequence[str], pos: str, title: str, parts: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """One text per key from worked examples in order of ``pos``: a heading and (heading, JSON column, kind) parts.

    ``kind`` is ``array`` or ``object``; an example with a part of another kind (null, malformed) is left out. A blank title reads
    ``Example n``, n counted from 1 over all examples. Keys without a valid example give an empty text.
    """
    fits = F.lit(True)
    for _, column, kind in parts:
        test = F.json_array_length(column) if kind == "array" else F.json_object_keys(column)
        fits &= test.isNotNull()
    head = F.coalesce(F.nullif(F.col(title), F.lit("")), F.concat(F.lit("Example "), (F.col(pos) + 1).cast("string")))
    lines = [F.concat(F.lit("### "), head)]
    for heading, column, _ in parts:
        lines += [F.lit(heading), F.col(column)]
    d = shots.withColumn("__shot", F.when(fits, F.concat(F.concat_ws("\n", *lines), F.lit("\n"))))
    text = F.expr(f"listagg(__shot, '\n') WITHIN GROUP (ORDER BY `{pos}`)")
    return d.groupBy(*keys).agg(F.coalesce(text, F.lit("")).alias("text"))
