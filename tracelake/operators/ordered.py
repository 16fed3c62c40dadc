"""Running values over long ordered sequences without putting one key in one task.

A plain window over ``partitionBy(key)`` sorts a whole key in a single task, which fails once a key
holds a large share of the rows. Here every key is cut into *chunks* by a monotone function of the
order, the window runs per (key, chunk), and the chunk totals, a table smaller by the chunk size,
are accumulated per key and added back. Rows are shuffled once; the totals are read off the same shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one sequence handled by one task when the order column is a row position.
CHUNK_ROWS = 262_144


def position_chunk(pos: Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a row position (positions must be dense; see ``even_chunk`` for sparse ones)."""
    return F.floor(pos / F.lit(rows))


def even_chunk(df: DataFrame, order: Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a sparse or time-like integer order: equal spans holding ``rows`` rows on average.

    Reads the smallest and largest value and the row count first (one aggregate over one column).
    """
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    if not n:
        return F.lit(0)
    span = max(1, int((hi - lo + 1) * rows // n))
    return F.floor((order - F.lit(lo)) / F.lit(span))


def time_chunk(ts: Column, seconds: int = 86_400) -> Column:
    """Chunk number of a timestamp."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where nulls match nulls; key columns are kept once, from the left."""
    if not keys:
        raise ValueError("a join needs at least one key")
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    rank: str | None = None,
    total: str | None = None,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    firsts: Mapping[str, Column] | None = None,
    wholes: Mapping[str, tuple[str, Column]] | None = None,
    prevs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns per key.

    rank   1-based row number per key          total  rows per key
    sums   running sums (nulls count 0)        maxes  running maxima
    lags   value of the previous row           lasts  latest non-null value up to this row
    prevs  latest non-null value before this row
    firsts value of the first row of the key   wholes ("sum" | "min" | "max", column) over the whole key
    ``chunk`` must not decrease along ``order``, and ``order`` must be total within a key.
    """
    sums, maxes, lags, lasts = (dict(m or {}) for m in (sums, maxes, lags, lasts))
    firsts, wholes, prevs = (dict(m or {}) for m in (firsts, wholes, prevs))
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    keys, order = list(keys), list(order)
    # One key that is never null, so that the window, the totals and the join agree on one partitioning and rows are shuffled once.
    base = df.withColumn("__cut", F.struct(F.struct(*keys).alias("key") if keys else F.lit(0).alias("key"), chunk.alias("chunk")))
    local = Window.partitionBy("__cut").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    rows = {"__rn": F.row_number().over(local), "__chunk_end": F.lead(F.lit(1)).over(local).isNull()}
    rows |= {f"__s_{o}": F.sum(F.coalesce(c, F.lit(0))).over(upto) for o, c in sums.items()}
    rows |= {f"__m_{o}": F.max(c).over(upto) for o, c in maxes.items()}
    rows |= {f"__l_{o}": F.lag(F.struct(c.alias("v"))).over(local) for o, c in lags.items()}
    rows |= {f"__c_{o}": F.struct(c.alias("v")) for o, c in lags.items()}
    rows |= {f"__f_{o}": F.last(c, ignorenulls=True).over(upto) for o, c in (lasts | prevs).items()}
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    rows |= {f"__v_{o}": F.last(c, ignorenulls=True).over(earlier) for o, c in prevs.items()}
    rows |= {f"__b_{o}": F.first(F.struct(c.alias("v"))).over(upto) for o, c in firsts.items()}
    rows |= {f"__w_{o}": fold[kind](c).over(upto) for o, (kind, c) in wholes.items()}
    detail = base.withColumns(rows)

    # The last row of a chunk holds its totals: they come from the rows already shuffled, not from another pass over the input.
    whole = Window.partitionBy("__cut.key")
    by_chunk = whole.orderBy("__cut.chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    offsets = detail.filter("__chunk_end").select(
        "__cut",
        F.coalesce(F.sum("__rn").over(before), F.lit(0)).alias("__o_n"),
        F.sum("__rn").over(whole).alias("__o_total"),
        *[F.coalesce(F.sum(f"__s_{o}").over(before), F.lit(0)).alias(f"__o_s_{o}") for o in sums],
        *[F.max(f"__m_{o}").over(before).alias(f"__o_m_{o}") for o in maxes],
        *[F.lag(f"__c_{o}").over(by_chunk).alias(f"__o_l_{o}") for o in lags],
        *[F.last(f"__f_{o}", ignorenulls=True).over(before).alias(f"__o_f_{o}") for o in lasts | prevs],
        *[F.first(f"__b_{o}").over(by_chunk).alias(f"__o_b_{o}") for o in firsts],
        *[fold[kind](f"__w_{o}").over(whole).alias(f"__o_w_{o}") for o, (kind, _) in wholes.items()],
    )
    joined = detail.join(offsets, "__cut")
    out = [F.col(c) for c in df.columns]
    if rank:
        out.append((F.col("__rn") + F.col("__o_n")).alias(rank))
    if total:
        out.append(F.col("__o_total").alias(total))
    out += [(F.col(f"__s_{o}") + F.col(f"__o_s_{o}")).alias(o) for o in sums]
    out += [F.greatest(f"__m_{o}", f"__o_m_{o}").alias(o) for o in maxes]
    out += [
        F.when(F.col("__rn") > 1, F.col(f"__l_{o}.v")).otherwise(F.col(f"__o_l_{o}.v")).alias(o) for o in lags
    ]
    out += [F.coalesce(f"__f_{o}", f"__o_f_{o}").alias(o) for o in lasts]
    out += [F.coalesce(f"__v_{o}", f"__o_f_{o}").alias(o) for o in prevs]
    out += [F.col(f"__o_b_{o}.v").alias(o) for o in firsts]
    out += [F.col(f"__o_w_{o}").alias(o) for o in wholes]
    return joined.select(*out)


def digest_chunk(digest: Column) -> Column:
    """Chunk number of a hexadecimal digest (its first four digits, which keep its order)."""
    return F.conv(F.left(digest, F.lit(4)), 16, 10).cast("long")


def shuffle_key(key: Column, seed: int) -> Column:
    """Digest that gives rows a repeatable random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
