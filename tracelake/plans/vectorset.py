"""Registered queries: vector diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import vectors
from tracelake.plans.catalog import query, r6, rounded
from tracelake.plans.fixtures import table


def embeddings(spark, sf):
    """Vectors with a second vector: each entry less half of the entry seven places on."""
    e = F.col("embedding").cast("array<double>")
    dz = F.transform(e, lambda x, i: x - F.get(e, (i + 7) % F.size(e)) * 0.5)
    return table(spark, sf, "embeddings").select("vec_id", "label", e.alias("x"), dz.alias("z"))


_PAIR = """p AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


@query(
    "a46_covariance",
    f"WITH {_PAIR} SELECT '0' AS grp, a.i, b.i AS j, round(covar_samp(a.v, b.v), 8) AS cov FROM p a JOIN p b ON a.vec_id = b.vec_id GROUP BY 2, 3",
)
def a46(spark, sf):
    return vectors.covariance(embeddings(spark, sf), "x").withColumn("cov", F.round("cov", 8))


@query(
    "k07_group_moments",
    f"WITH {_PAIR} SELECT CAST(a.label AS VARCHAR) AS grp, a.i, b.i AS j, round(sum(a.v * b.v), 8) AS sij, CAST(count(*) AS DOUBLE) AS n FROM p a JOIN p b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3",
)
def k07(spark, sf):
    return vectors.moments(embeddings(spark, sf), "x", group="label").select("grp", "i", "j", F.round("sij", 8).alias("sij"), "n")


@query("v01_effective_rank")
def v01(spark, sf):
    return rounded(vectors.effective_rank(embeddings(spark, sf), "x", "label").select("grp", "effective_rank"), "effective_rank")


@query("v02_subspace_alignment")
def v02(spark, sf):
    return rounded(vectors.subspace_alignment(embeddings(spark, sf), "x", "z", 16), "alignment")


@query("v03_direction_scores")
def v03(spark, sf):
    return rounded(vectors.direction_scores(embeddings(spark, sf), "x", "z"), "var_score", "ctrl_score")


@query("v04_diagnostics")
def v04(spark, sf):
    return rounded(vectors.diagnostics(embeddings(spark, sf), "x", "z", "label"), "effective_rank", "align_top16", "align_top32")


@query(
    "u03_top_overlap",
    """WITH e AS (SELECT vec_id, list_transform(range(1, 65), lambda i: struct_pack(x := -CAST(embedding[i] AS DOUBLE), i := i)) AS a,
      list_transform(range(1, 65), lambda i: struct_pack(x := -(CAST(embedding[i] AS DOUBLE) - CAST(embedding[(i + 6) % 64 + 1] AS DOUBLE) * 0.5), i := i)) AS b FROM embeddings)
    SELECT vec_id, round(len(list_intersect(list_transform(list_sort(a)[1:16], lambda s: s.i), list_transform(list_sort(b)[1:16], lambda s: s.i))) / 16.0::DOUBLE, 6) AS overlap FROM e""",
)
def u03(spark, sf):
    return embeddings(spark, sf).select("vec_id", r6(vectors.top_overlap(F.col("x"), F.col("z"))).alias("overlap"))
