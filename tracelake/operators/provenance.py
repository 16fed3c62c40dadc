"""What was done to each part when the pages of a document were merged: notes per field, and a log per document.

The decisions are those of ``stitch``: they leave the ordered scans as one row per part, become note rows (part, step, note), and
come together once per field. A field's notes are as many as its parts, like the text that they describe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import stitch
from tracelake.operators.ordered import null_safe_join
from tracelake.operators.stitch import AS_IS, DOC, FIRST, FOOTER, LAST, TABLE, TEXT
from tracelake.session import stage

NOTES = "array<struct<step: int, note: string>>"


def _named(part: Column, note: Column | str) -> Column:
    """A note about a part, numbered from 0."""
    return F.concat(F.lit("page_part_"), (part - 1).cast("string"), F.lit(": "), note if isinstance(note, Column) else F.lit(note))


def _long(parts: DataFrame, notes: list[Column]) -> DataFrame:
    """Note rows of parts; null notes are left out."""
    steps = F.array(*[F.struct(F.lit(k).alias("step"), n.alias("note")) for k, n in enumerate(notes)]).cast(NOTES)
    return parts.select(*DOC, F.col("part").cast("long").alias("part"), F.inline(F.filter(steps, lambda s: s["note"].isNotNull())))


def _field_notes(tagged: DataFrame) -> DataFrame:
    """One note for fields that are picked or listed, not joined."""
    once = F.col("occurrences") == 1
    note = (
        F.when(F.col("strategy") == FOOTER, "per-page footer preserved").when(once & (F.col("strategy") != TABLE), "single occurrence")
        .when(F.col("strategy") == LAST, "last page").when(F.col("strategy").isin(AS_IS, FIRST), "first page")
    )
    return _long(tagged.filter("part = 1"), [note])


def _text_notes(texts: DataFrame) -> DataFrame:
    d = stitch.text_parts(texts)
    part = F.col("__i")
    note = F.when(F.col("action") == "base", _named(part, "base")).when(
        F.col("action").isin("hyphen", "stitched"), _named(part, "stitched (incomplete+continuation)")
    ).otherwise(_named(part, "concatenated with newline"))
    return _long(d.filter("__n > 1").withColumn("part", part), [note])


def _table_notes(tables: DataFrame) -> DataFrame:
    """Notes of table parts: rows kept, skipped or missing, page cuts and row numbers."""
    profiled = stage(stitch.part_profiles(tables.select(*DOC, "part", "occurrences", "content", "page_cut")).drop("content"), "table-rows")
    parts = stage(stitch.part_skips(profiled).withColumn("part", F.col("part").cast("long")), "table-parts")
    # without rows in its first part a table is empty, so what the others would have done is not said
    have = F.col("started") & (F.col("n_rows") > 0)
    decided = parts.filter(have).withColumn("page_num", F.col("part")).withColumn("n_parts", F.col("occurrences"))
    decided = stitch.choose_skips(decided, keep=["page_cut"]).withColumnRenamed("page_num", "part").withColumn("started", F.lit(True))
    missing = parts.filter(~have).select(*DOC, "part", "page_cut", "started")
    d = decided.unionByName(missing, allowMissingColumns=True)
    part, skip, final, n = F.col("part"), F.col("skip"), F.col("final_skip"), F.col("n_rows")
    text = lambda c: c.cast("string")
    first, have = part == 1, F.col("started") & n.isNotNull()
    later = have & ~first
    kept = n - final
    follows = (kept > 0) & (F.col("first_stt") == F.col("prev_stt") + 1)
    notes = [
        F.when(~F.col("started") & first, F.lit("no rows in first page")),
        F.when(have & first, _named(part, F.concat(F.lit("kept "), text(n), F.lit(" rows (incl. header)")))),
        F.when(F.col("started") & ~first & n.isNull(), _named(part, "no rows, skipped")),
        F.when(later, _named(part, F.when(F.col("page_cut"), "bbox page-cut continuation").otherwise("bbox weak page-cut signal"))),
        F.when(later & (final != skip), _named(part, F.concat(F.lit("stt adjusted skip "), text(skip), F.lit("->"), text(final)))),
        F.when(later & F.coalesce(follows, F.lit(False)), _named(part, "stt continuation confirmed")),
        F.when(
            later,
            _named(
                part,
                F.when(final > 0, F.concat(F.lit("skipped "), text(final), F.lit(" repeated prefix rows, appended "), text(kept), F.lit(" rows")))
                .otherwise(F.concat(F.lit("appended "), text(kept), F.lit(" rows"))),
            ),
        ),
    ]
    total = d.filter(have).groupBy(*DOC).agg(F.sum(kept).alias("total"))
    total = total.select(*DOC, F.lit(1 << 62).cast("long").alias("part"), F.lit(0).alias("step"), F.concat(F.lit("total_rows="), text(F.col("total"))).alias("note"))
    return _long(d, notes).unionByName(total)


def merge_notes(labels: DataFrame, aliases=stitch.FIELD_ALIASES, by_name=stitch.FIELD_STRATEGIES) -> DataFrame:
    """Per document and field: strategy, source pages, notes in order, and the field's place in the document."""
    occurrences = stage(stitch.field_occurrences(labels, aliases), "labels")
    tagged = stage(stitch.tag_parts(occurrences, by_name), "tagged-labels")

    def of(strategy: str) -> DataFrame:
        return tagged.filter(F.col("strategy") == strategy)

    rows = _field_notes(tagged).unionByName(_text_notes(of(TEXT).drop("part"))).unionByName(_table_notes(of(TABLE)))
    in_order = F.array_sort(F.collect_list(F.struct("part", "step", "note")))
    notes = rows.groupBy(*DOC).agg(F.transform(in_order, lambda n: n["note"]).alias("notes"))
    pages = tagged.groupBy(*DOC).agg(
        F.first("strategy").alias("strategy"), F.transform(F.array_sort(F.collect_list(F.struct(*stitch.ORDER))), lambda p: p["page_num"]).alias("pages")
    )
    source = F.when(F.col("strategy").isin(AS_IS, FIRST), F.slice("pages", 1, 1)).when(F.col("strategy") == LAST, F.slice("pages", -1, 1)).otherwise(F.col("pages"))
    d = null_safe_join(pages.select(*DOC, "strategy", source.alias("source_pages")), notes, list(DOC))
    return null_safe_join(d, stitch.field_order(occurrences), list(DOC))


def merge_log(labels: DataFrame, aliases=stitch.FIELD_ALIASES, by_name=stitch.FIELD_STRATEGIES) -> DataFrame:
    """Per document: its page numbers and one entry per field, in order (bounded by the fields of a form)."""
    entry = F.struct("field_rank", F.col("field_name").alias("field"), "strategy", "source_pages", "notes")
    log = merge_notes(labels, aliases, by_name).groupBy("sample_id").agg(F.array_sort(F.collect_list(entry)).alias("log"))
    log = log.withColumn("log", F.transform("log", lambda e: e.dropFields("field_rank")))
    pages = labels.groupBy("sample_id").agg(F.array_sort(F.collect_set("page_num")).alias("page_numbers"))
    return null_safe_join(pages, log, ["sample_id"]).select("sample_id", F.size("page_numbers").alias("n_pages"), "page_numbers", "log")
