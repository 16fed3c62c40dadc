"""Connected components of a graph held in DataFrames: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.session import stage


def _stars(links: DataFrame) -> DataFrame:
    """Link the neighbours of each vertex ``u`` to the smallest vertex among them and ``u``.

    The smallest neighbour is combined before the shuffle; the join back is one that adaptive execution
    can split, so a vertex with very many neighbours stays spread.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def connected(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) of every vertex with an edge; the component is its smallest vertex.

    Nulls and loops are left out. Each round is written to the shared folder, which also cuts lineage; the
    links shrink to one star per component, and a round that changes nothing ends the loop.
    """
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stage(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(large)
        now = stage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct(),
            "links",
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
