"""Box arithmetic as Column expressions; a box is a struct (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
    )


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def cover_ratio(block: Column, section: Column) -> Column:
    """Share of the block's area inside the section."""
    return intersection(block, section) / F.greatest(F.lit(1e-6), area(block))


def center_inside(block: Column, section: Column) -> Column:
    cx, cy = (block["x0"] + block["x1"]) / 2, (block["y0"] + block["y1"]) / 2
    return cx.between(section["x0"], section["x1"]) & cy.between(section["y0"], section["y1"])


def scale(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def clamp(b: Column, lo: float, hi: float) -> Column:
    def one(v: Column) -> Column:
        return F.greatest(F.lit(lo), F.least(F.lit(hi), v))

    return box(one(b["x0"]), one(b["y0"]), one(b["x1"]), one(b["y1"]))


def points_to_norm1000(b: Column, width: Column, height: Column) -> Column:
    return clamp(scale(b, F.lit(1000.0) / width, F.lit(1000.0) / height), 0.0, 1000.0)


def norm1000_to_points(b: Column, width: Column, height: Column) -> Column:
    return box(
        b["x0"] / 1000.0 * width, b["y0"] / 1000.0 * height, b["x1"] / 1000.0 * width, b["y1"] / 1000.0 * height
    )


def repair(b: Column) -> Column:
    """Swap reversed edges and clamp to 0..1000; null when any coordinate is missing."""
    ordered = box(
        F.least(b["x0"], b["x1"]), F.least(b["y0"], b["y1"]), F.greatest(b["x0"], b["x1"]), F.greatest(b["y0"], b["y1"])
    )
    missing = b["x0"].isNull() | b["y0"].isNull() | b["x1"].isNull() | b["y1"].isNull()
    return F.when(~missing, box(
        F.greatest(ordered["x0"], F.lit(0.0)), F.greatest(ordered["y0"], F.lit(0.0)),
        F.least(ordered["x1"], F.lit(1000.0)), F.least(ordered["y1"], F.lit(1000.0)),
    ))


def parse_box(c: Column, exact: bool = False) -> Column:
    """Box of a "x0 y0 x1 y1" string; null when a number is missing or malformed."""
    parts = F.split(F.trim(F.regexp_replace(c, r"[\s,]+" if exact else r"\s+", " ")), " ")
    nums = [F.get(parts, i).try_cast("double") for i in range(4)]
    ok = (F.size(parts) == 4) if exact else (F.size(parts) >= 4)
    for v in nums:
        ok = ok & v.isNotNull()
    return F.when(ok, box(*nums))
