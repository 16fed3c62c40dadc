"""Mixing sources to target weights by Pareto order sampling.

A document's size is its number of words. Sources, ordered by code point with null last, take the weights in
turn and share the whole size; a target above ``CAP`` times the source's own size stops there, and the excess is
shared again by weight until no target is above (``targets``). A source's target over its size gives whole copies
for every document; the rest, a fraction ``f`` of the source, is a fixed-size sample with unequal probabilities:
document ``i`` should be in with ``f * (1 + (1 - f) * (q_i - mean q))``, where ``q`` grows from 0 to 1 with its
size and the mean is weighted by size, so the probabilities lie in [0, 1] and add up, in words, to the rest
exactly. Pareto order: a document's own random odds over its inclusion odds; the smallest are taken until their
words come nearest to the rest.

Random numbers come from a digest of seed, doc_id and text, so reruns agree on any cluster and texts under one doc_id (or
none) have odds of their own. Rows that repeat both are numbered: in ``mix`` they are counted first, so they are one row until
they are numbered block by block; in ``remix`` each partition numbers its own after those of the partitions before. A source is never sorted in
one task: its ranks are cut into ``CHUNKS`` equal intervals, words are summed per interval, and only the interval
in which the sample ends is ordered. What decides is then one row per source (``plan``), so documents are never
shuffled to be marked or copied.

Defined cases: a null or empty text has size 0 and is kept once, or as often as the source's whole copies, in
``remix``; null sources are a source; repeated rows have odds of their own; very long texts are read whole; an empty table gives an empty result; further columns are ignored (``remix`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.catalog import documents, query
from tracelake.session import stage

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 7
CHUNKS = 4096
HALF_SIZE = 500
#: A table of sources up to this many rows is sent to every task; a larger one is joined by (source, salt).
SMALL = 10_000
SALTS = 32
#: Rows with equal doc_id, source and text are numbered in blocks of this many.
BLOCK = 100_000
ORDER = ("rank", "doc_id", "size", "digest", "nth")


def n_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _preference(size: str) -> Column:
    """q in thousandths, a whole number, so that sums over documents do not depend on their order."""
    return F.expr(f"{size} * 1000 div ({size} + {HALF_SIZE})")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size): sources fill up in order of cap over weight until the common level fits."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    up = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # any other choice of sources at their limit would give more than min(limit, level * weight), so the right level is the largest
    final = F.max("level").over(everything)
    return weighed.withColumn("level", level).select(
        *sources.columns,
        F.least(F.col("limit").cast("double"), F.coalesce(final, F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def _with(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """Rows with their source's plan; a source of any share of the rows is spread over salts."""
    plan = plan.withColumnRenamed("source", "__source")
    if small:
        return rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    on = F.col("source").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__salt"))
    return rows.join(salted, on).drop("__source", "__part", "__salt")


def _rank(seed: int) -> Column:
    """Random odds over inclusion odds, from doc_id, text, number among repeats, size and the source's plan."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), doc, "digest", F.col("nth").cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    chance = F.col("rest") * (1 + (1 - F.col("rest")) * (_preference("size") - F.col("mean_q")) / F.lit(1000.0))
    return F.when(F.col("rest") > 0, u / (1 - u) / (chance / (1 - chance)))


def _interval(rank: str) -> Column:
    return F.floor(F.col(rank) / (1 + F.col(rank)) * CHUNKS).cast("int")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per source of (doc_id, source, size, digest, nth): target, whole copies, and up to which rank documents get one more."""
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * _preference("size")).alias("q")
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    first = stage(
        targets(sources, weights, cap).withColumn("ratio", ratio).select(
            "source", "source_size", "target", F.floor("ratio").alias("whole"),
            (F.col("ratio") - F.floor("ratio")).alias("rest"),
            (F.col("target") - F.floor("ratio") * F.col("source_size")).alias("rest_words"),
            F.when(F.col("source_size") > 0, F.col("q") / F.col("source_size")).otherwise(F.lit(0.0)).alias("mean_q"),
        ),
        "sources",
    )
    small = first.limit(SMALL + 1).count() <= SMALL
    ranked = _with(sizes, first, small).where("rest > 0").withColumn("rank", _rank(seed)).withColumn("interval", _interval("rank"))
    sums = ranked.groupBy("source", "interval").agg(F.sum("size").alias("words"), F.first("rest_words").alias("rest_words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("interval"))
    ends = (
        sums.withColumn("upto", upto).where("upto > rest_words").groupBy("source")
        .agg(F.min(F.struct("interval", (F.col("upto") - F.col("words")).alias("before"))).alias("m"))
        .select("source", F.col("m.interval").alias("last"), F.col("m.before").alias("before"))
    )
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (
        _with(ranked, ends, small).where("interval = last").withColumn("ahead", F.col("before") + ahead)
        .where("ahead + size / 2 <= rest_words").groupBy("source").agg(F.max(F.struct(*ORDER)).alias("cut"))
    )
    out = first
    for table in (ends, cut):
        table = table.withColumnRenamed("source", "__source")
        out = out.join(table, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    return stage(out.drop("before", "rest_words"), "mix")


def copies(sizes: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``sizes`` with source_size, target and ``copies``, the times that each row is in the mix."""
    rows = _with(sizes, plan, plan.limit(SMALL + 1).count() <= SMALL).withColumn("rank", _rank(seed))
    earlier = F.col("last").isNull() | (_interval("rank") < F.col("last"))
    at_end = F.coalesce((_interval("rank") == F.col("last")) & (F.struct(*ORDER) <= F.col("cut")), F.lit(False))
    more = F.when(F.col("rest") > 0, (earlier | at_end).cast("int")).otherwise(0)
    return rows.withColumn("copies", (F.col("whole") + more).cast("int")).drop("rank", "whole", "rest", "mean_q", "last", "cut")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), "source", n_words("text").alias("size"), digest.alias("digest"))


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows with their count and a ``key`` without nulls."""
    return stage(rows.groupBy(*rows.columns).count().withColumn("key", _key()), "sizes")


def _key() -> Column:
    return F.md5(F.to_json(F.struct("doc_id", "source", "digest")))


def numbered(classes: DataFrame) -> DataFrame:
    """One row with its number ``nth`` for each counted; any count is dealt over tasks in blocks."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {BLOCK}")))
    many = classes.where(F.col("count") > BLOCK).withColumn("block", blocks).repartition("key", "block")
    few = classes.where(F.col("count") <= BLOCK).withColumn("block", F.lit(0).cast("long"))
    first = F.col("block") * BLOCK
    last = F.least(F.col("count"), first + BLOCK) - 1
    rest = [c for c in classes.columns if c not in ("count", "key")]
    return few.unionByName(many).select(*rest, F.explode(F.sequence(first, last)).alias("nth"))


def number_repeats(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` themselves with ``nth``; only those that repeat move."""
    keys = classes.where(F.col("count") > 1).select("key")
    none = F.lit(0).cast("long")
    n = keys.limit(SMALL + 1).count()
    if n == 0:
        return rows.withColumn("nth", none)
    keys = F.broadcast(keys) if n <= SMALL else keys
    keyed = rows.withColumn("key", _key())
    once = keyed.join(keys, "key", "left_anti").withColumn("nth", none)
    place = {"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}
    more = stage(keyed.join(keys, "key", "left_semi").withColumns(place), "repeats")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = more.groupBy("key", "part").count().select("key", "part", F.coalesce(F.sum("count").over(before), none).alias("start"))
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("place")) - 1
    more = more.withColumn("within", within).join(starts, ["key", "part"]).withColumn("nth", F.col("start") + F.col("within"))
    return once.unionByName(more.select(once.columns)).drop("key")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    rows = numbered(counted(_sized(docs)))
    return copies(rows, plan(rows, weights, cap, seed), seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def remix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` repeated or left out, with all their columns."""
    classes = counted(_sized(docs))
    how = plan(numbered(classes), weights, cap, seed)
    rows = number_repeats(_sized(docs, F.struct(*docs.columns).alias("__row")), classes)
    taken = copies(rows, how, seed).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("__row.*")


_SQL = """
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS nth,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
pref AS (SELECT *, size * 1000 // (size + 500) AS q FROM sizes),
src AS (
  SELECT source, sum(size)::BIGINT AS s, sum(size * q)::BIGINT AS sq,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM pref GROUP BY source),
steps AS (
  SELECT *, ((sum(s) OVER () - coalesce(sum(3 * s) OVER up, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER up, 0))::DOUBLE) AS level
  FROM src WINDOW up AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT source, s, sq, least((3 * s)::DOUBLE, coalesce((SELECT max(level) FROM steps), 0.0) * w) AS target FROM steps),
shares AS (
  SELECT source, s, target, floor(r) AS whole, r - floor(r) AS f, target - floor(r) * s AS rest, CASE WHEN s > 0 THEN sq / s ELSE 0.0 END AS mq
  FROM (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0.0 END AS r FROM filled)),
odds AS (
  SELECT *, f * (1 + (1 - f) * (q - mq) / 1000.0::DOUBLE) AS p,
         (('0x' || substr(md5(concat('7:', doc_id, ':', digest, ':', nth)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM pref JOIN shares ON pref.source IS NOT DISTINCT FROM shares.source),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY pref_source ORDER BY rank, doc_id, size, digest, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM (SELECT doc_id, size, digest, nth, s, target, whole, f, rest, source AS pref_source, u / (1 - u) / (p / (1 - p)) AS rank FROM odds))
SELECT doc_id, size, s AS source_size, target, (copies * size)::BIGINT AS taken, copies
FROM (SELECT *, (whole + CASE WHEN f > 0 AND ahead + size / 2 <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM ranked)
"""


@query("op7_mixing", _SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
