"""Exact order statistics by narrowing intervals instead of sorting or buffering a group.

``percentile`` keeps every distinct value of a group in one task. Here a first pass counts values in
monotone log-scale buckets (map-side combined, so a few thousand rows per group are shuffled), the
bucket holding each wanted rank is picked, and a second pass keeps only the rows inside those
buckets. Buckets that are still large are split again. No step shuffles the raw values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tracelake.operators.ordered import null_safe_join, ordered_scan

# Buckets per e-fold of |value|; bucket width is about 0.05 % of the value.
LOG_BUCKETS = 2048
# Sub-buckets per narrowing step.
SPLITS = 4096
# Rows one task may rank at the end; larger intervals are split again.
RANK_ROWS = 4_000_000
# Largest table of wanted ranks that is broadcast; beyond it the shuffled path is used.
MAX_TARGETS = 50_000


@dataclass(frozen=True)
class Rank:
    """A rank as 0-based lower index, optional upper index and weight, all functions of n."""

    name: str
    low: Callable[[Column], Column]
    high: Callable[[Column], Column] | None = None
    weight: Callable[[Column], Column] | None = None


def linear(name: str, p: float) -> Rank:
    """Linear interpolation at ``(n-1)*p/100``."""

    def at(n: Column) -> Column:
        return (n - 1) * F.lit(float(p)) / F.lit(100.0)

    return Rank(
        name,
        lambda n: F.floor(at(n)),
        lambda n: F.least(F.floor(at(n)) + 1, n - 1),
        lambda n: at(n) - F.floor(at(n)),
    )


def floor_index(name: str, p: float) -> Rank:
    """Index ``min(int(n*p/100), n-1)``."""
    return Rank(name, lambda n: F.least(F.floor(n * F.lit(float(p)) / F.lit(100.0)), n - 1))


def upper_median(name: str) -> Rank:
    """Index ``n // 2``."""
    return Rank(name, lambda n: F.floor(n / F.lit(2)))


def rounded_index(name: str, q: float) -> Rank:
    """Index ``round(q*(n-1))``, ties to even."""
    return Rank(name, lambda n: F.bround(F.lit(float(q)) * (n - 1)).cast("long"))


def truncated_index(name: str, q: float) -> Rank:
    """Index ``int(q*(n-1))``."""
    return Rank(name, lambda n: F.floor(F.lit(float(q)) * (n - 1)))


def _bucket(v: Column) -> Column:
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(LOG_BUCKETS))


def _ends(ranks: Sequence[Rank], n: Column) -> Column:
    """Array of the wanted (rank, end, 0-based index) of a group of n values."""
    out = []
    for r in ranks:
        for end, index in ((0, r.low), (1, r.high)):
            if index is not None:
                out.append(
                    F.struct(F.lit(r.name).alias("rank"), F.lit(end).alias("end"), index(n).cast("long").alias("idx"))
                )
    return F.array(*out)


def _locate(buckets: DataFrame, keys: Sequence[str], ranks: Sequence[Rank]) -> DataFrame:
    """Buckets that hold a wanted index: value range, rows before, wanted entries, totals of the key."""
    by_key = Window.partitionBy(*keys)
    cum = buckets.withColumns(
        {
            "after": F.sum("c").over(
                by_key.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
            "n": F.sum("c").over(by_key),
            "min": F.min("lo").over(by_key),
            "max": F.max("hi").over(by_key),
            "s": F.sum("s").over(by_key),
        }
    ).withColumn("before", F.col("after") - F.col("c"))
    inside = F.filter(
        _ends(ranks, F.col("n")), lambda e: (e["idx"] >= F.col("before")) & (e["idx"] < F.col("after"))
    )
    hit = cum.select(*keys, "lo", "hi", "c", "before", inside.alias("wanted"), "n", "min", "max", "s")
    return hit.filter(F.size("wanted") > 0)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: Sequence[Rank]) -> DataFrame:
    """Per key: ``n, min, max, mean`` and one exact column per rank. Nulls are ignored."""
    keys = list(keys)
    src = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    gk = keys
    if not keys:
        gk = ["__all"]
        src = src.withColumn("__all", F.lit(1))
    buckets = src.groupBy(*gk, _bucket(F.col("__v")).alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.sum("__v").alias("s")
    )
    located = _locate(buckets, gk, ranks)
    # Bounded read: one row per (key, wanted bucket); over the limit the shuffled path is taken.
    # (The repartition makes it one job; a bare limit is collected in growing rounds.)
    targets = located.limit(MAX_TARGETS + 1).repartition(1).collect()
    if len(targets) > MAX_TARGETS:
        picked = _shuffled_pick(src, gk, ranks)
    else:
        picked = _narrow_pick(df.sparkSession, src, gk, targets, located.schema)
    wide = picked.groupBy(*gk).agg(
        *[F.first(c).alias(c) for c in ("n", "min", "max", "s")],
        *[
            F.max(F.when((F.col("rank") == r.name) & (F.col("end") == end), F.col("v"))).alias(f"__{r.name}_{end}")
            for r in ranks
            for end in ((0, 1) if r.high is not None else (0,))
        ],
    )
    cols = []
    for r in ranks:
        low = F.col(f"__{r.name}_0")
        if r.high is None:
            cols.append(low.alias(r.name))
        else:
            cols.append((low + (F.col(f"__{r.name}_1") - low) * r.weight(F.col("n"))).alias(r.name))
    return wide.select(*keys, "n", "min", "max", (F.col("s") / F.col("n")).alias("mean"), *cols)


def _narrow_pick(spark, src: DataFrame, keys: list[str], targets: list, schema) -> DataFrame:
    """Second pass: keep rows inside the wanted intervals and rank only those."""

    def largest(rows: list) -> int:
        return max((r["c"] for r in rows if r["lo"] < r["hi"]), default=0)

    size = largest(targets)
    while size > RANK_ROWS:
        targets = _split_once(spark, src, keys, targets, schema)
        smaller = largest(targets)
        if smaller >= size:
            break
        size = smaller
    counts = (
        _inside(spark, src, keys, targets, schema)
        .groupBy(*keys, "lo", "before", "n", "min", "max", "s", "__v")
        .agg(F.count(F.lit(1)).alias("c"), F.first("wanted").alias("wanted"))
    )
    run = Window.partitionBy(*keys, "lo").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.col("before") + F.sum("c").over(run))
    hit = F.filter("wanted", lambda e: (e["idx"] >= F.col("upto") - F.col("c")) & (e["idx"] < F.col("upto")))
    return ranked.select(*keys, "n", "min", "max", "s", F.col("__v").alias("v"), F.inline(hit))


def _inside(spark, src: DataFrame, keys: list[str], targets: list, schema) -> DataFrame:
    """Rows inside a wanted interval. The broadcast table has at most MAX_TARGETS rows (checked by the caller)."""
    table = pa.Table.from_pylist([r.asDict(recursive=True) for r in targets], schema=to_arrow_schema(schema))
    spans = F.broadcast(spark.createDataFrame(table))
    return null_safe_join(src, spans, keys).filter(F.col("__v").between(F.col("lo"), F.col("hi")))


def _split_once(spark, src: DataFrame, keys: list[str], targets: list, schema) -> list:
    """Cut every wanted interval into equal parts and keep the parts that hold a wanted index."""
    width = F.col("hi") - F.col("lo")
    part = F.when(width > 0, F.floor((F.col("__v") - F.col("lo")) / width * F.lit(SPLITS))).otherwise(F.lit(0))
    parts = (
        _inside(spark, src, keys, targets, schema)
        .groupBy(*keys, "n", "min", "max", "s", F.col("lo").alias("olo"), F.col("before").alias("base"), part.alias("b"))
        .agg(
            F.count(F.lit(1)).alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.first("wanted").alias("wanted")
        )
    )
    run = Window.partitionBy(*keys, "olo").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("upto", F.col("base") + F.sum("c").over(run)).withColumn(
        "before", F.col("upto") - F.col("c")
    )
    hit = F.filter("wanted", lambda e: (e["idx"] >= F.col("before")) & (e["idx"] < F.col("upto")))
    parts = parts.withColumn("wanted", hit).filter(F.size("wanted") > 0)
    return parts.select(*schema.fieldNames()).collect()


def _shuffled_pick(src: DataFrame, keys: list[str], ranks: Sequence[Rank]) -> DataFrame:
    """Many groups: rank value counts in (key, bucket) chunks and keep the wanted indexes."""
    counts = src.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("c"))
    v, c = F.col("__v"), F.col("c")
    d = ordered_scan(
        counts, keys, ["__v"], _bucket(v), sums={"upto": c},
        wholes={"n": ("sum", c), "min": ("min", v), "max": ("max", v), "s": ("sum", v * c)},
    )
    hit = F.filter(
        _ends(ranks, F.col("n")), lambda e: (e["idx"] >= F.col("upto") - F.col("c")) & (e["idx"] < F.col("upto"))
    )
    return d.select(*keys, "n", "min", "max", "s", F.col("__v").alias("v"), F.inline(hit))


def histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Counts per labelled bin ``(previous, edge]`` plus an overflow bin; empty bins are kept."""
    keys, edges = list(keys), list(edges)
    v = F.col(value)
    bins, prev = [], 0
    for pos, hi in enumerate(edges):
        bins.append((pos, f"{prev}-{hi}", (v > prev) & (v <= hi)))
        prev = hi
    bins.append((len(edges), f">{edges[-1]}", v > edges[-1]))
    agg = df.groupBy(*keys).agg(*[F.count_if(cond).alias(f"__b{pos}") for pos, _, cond in bins])
    rows = F.array(
        *[
            F.struct(F.lit(pos).alias("bin_pos"), F.lit(label).alias("bin"), F.col(f"__b{pos}").alias("n"))
            for pos, label, _ in bins
        ]
    )
    return agg.select(*keys, F.inline(rows))
