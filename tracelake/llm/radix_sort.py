"""A stable least-significant-digit radix sort over a table too large for one task.

Every row has a place: a block of at most ``block_rows`` rows and a slot in it. A pass looks at one digit of the composite key.
It counts the rows of each (block, digit), turns the counts into the first destination of each such cell by prefix sums (all
smaller digits first, then earlier blocks), and lets each block deal out its rows by a counting sort, in slot order. So rows of
one digit keep their order, and after the pass of the last digit a row's destination is its rank.

Only (block, digit) cells are counted, never rows of a key in one task: equal keys fill as many blocks as they need. Prefix
sums run over chunks of ``_CHUNK`` blocks and over chunks. Each pass is written once to the shared folder, so a task that
runs again meets the places that its first run met.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import stage

_CHUNK = 4096
_LONG_BITS = 64


def _digits(rows: DataFrame, keys: list[tuple[str, bool]], digit_bits: int) -> list[tuple[Column, int]]:
    """(digit, number of values) of every pass, least significant first. Nulls come last; a key whose values agree needs no pass."""
    bounds = rows.agg(*[f(k).alias(f"{k}_{n}") for k, _ in keys for n, f in (("least", F.min), ("most", F.max), ("some", F.count))], F.count("*").alias("all")).first()
    out: list[tuple[Column, int]] = []
    for name, descending in reversed(keys):
        if not bounds[f"{name}_some"]:
            continue
        least, most = bounds[f"{name}_least"], bounds[f"{name}_most"]
        bits = (most - least).bit_length()
        if bits < _LONG_BITS:
            value = F.lit(most) - F.col(name) if descending else F.col(name) - F.lit(least)
        else:  # the difference may not fit a long: the value's own bits, sign turned over
            value = F.col(name).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
            value = F.bitwise_not(value) if descending else value
        passes = -(-bits // digit_bits)
        at = 0
        for n in range(passes):
            width = (bits - at) // (passes - n)
            out.append((F.coalesce(F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")), F.lit(0)).cast("int"), 1 << width))
            at += width
        if bounds[f"{name}_some"] < bounds["all"]:
            out.append((F.isnull(name).cast("int"), 2))
    return out


def _starts(cells: DataFrame) -> DataFrame:
    """block, digit, start: the first destination of each cell."""
    totals = {r["digit"]: r["n"] for r in cells.groupBy("digit").agg(F.sum("n").alias("n")).collect()}  # one row per digit value
    base, below = {}, 0
    for digit in sorted(totals):
        base[digit], below = below, below + totals[digit]
    spark = cells.sparkSession
    bases = spark.createDataFrame(sorted(base.items()), "digit int, base long")
    chunked = cells.withColumn("chunk", F.floor(F.col("block") / _CHUNK))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n").over(before.partitionBy("digit", "chunk").orderBy("block")), F.lit(0))
    chunks = chunked.groupBy("digit", "chunk").agg(F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(before.partitionBy("digit").orderBy("chunk")), F.lit(0))
    chunks = chunks.join(F.broadcast(bases), "digit").select("digit", "chunk", (F.col("base") + earlier).alias("first"))
    return chunked.select("block", "digit", "chunk", inside.alias("inside")).join(chunks, ["digit", "chunk"]).select(
        "block", "digit", (F.col("first") + F.col("inside")).alias("start")
    )


def _dealer(digit_values: int, block_rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Counting sort of one block: destinations of its rows, in slot order within each digit."""

    def deal(rows: pa.Table, cells: pa.Table) -> pa.Table:
        slot = rows.column("slot").to_numpy()
        order = np.argsort(slot)
        digit = rows.column("digit").to_numpy()[order]
        by_digit = np.argsort(digit.astype(np.uint16 if digit_values <= 1 << 16 else np.uint32), kind="stable")
        counts = np.bincount(digit, minlength=digit_values)
        start = np.zeros(digit_values, np.int64)
        start[cells.column("of_digit").to_numpy()] = cells.column("of_start").to_numpy()
        place = np.empty(len(digit), np.int64)
        dealt = digit[by_digit]
        place[order[by_digit]] = start[dealt] + np.arange(len(digit)) - (np.cumsum(counts) - counts)[dealt]
        for name, values in (("block", place // block_rows), ("slot", (place % block_rows).astype(np.int32))):
            rows = rows.set_column(rows.column_names.index(name), name, pa.array(values))
        return rows.drop_columns(["digit"])

    return deal


def positions(rows: DataFrame, keys: list[tuple[str, bool]], digit_bits: int = 10, block_rows: int = 1 << 12) -> DataFrame:
    """``rows`` with ``position`` (from 0) by ``keys``, (long column, descending) pairs, the most significant first.

    Nulls of a key come last. Rows equal in all keys come in the order in which they were first written. The columns ``block``,
    ``slot``, ``digit`` and ``position`` are this function's own.
    """
    number = F.monotonically_increasing_id()
    placed = stage(rows.select("*", F.floor(number / block_rows).alias("block"), (number % block_rows).cast("int").alias("slot")), "radix")
    for digit, values in _digits(placed, keys, digit_bits) or [(F.lit(0), 1)]:
        with_digit = placed.withColumn("digit", digit)
        starts = _starts(with_digit.groupBy("block", "digit").agg(F.count("*").alias("n")))
        starts = starts.select(*[F.col(c).alias(f"of_{c}") for c in starts.columns])
        dealt = with_digit.groupBy("block").cogroup(starts.groupBy("of_block")).applyInArrow(_dealer(values, block_rows), placed.schema)
        placed = stage(dealt, "radix")
    return placed.select(*[c for c in placed.columns if c not in ("block", "slot")], (F.col("block") * block_rows + F.col("slot")).alias("position"))
