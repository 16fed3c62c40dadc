"""Diagnostics of embedding tables: covariance, effective rank, alignment with a second vector.

The rows are reduced to D x D moment matrices inside the tasks; everything after that works on those
cells, so neither the vectors nor the eigenvectors travel to the driver or are broadcast. The energy
of ``dz`` along direction u is u' M u with M the second moment of ``dz``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
TOP_K, WIDE_K = 16, 32
# Groups up to which tasks keep moments of all of them and vectors stay where they are; with more, vectors go to their group.
HELD_GROUPS = 256
# Parts over which the rows of one group are spread where vectors are shuffled.
SPREAD = 8
# Partial moments that one task puts together.
MERGED_PARTS = 256

PARTIAL = "grp string, part int, n double, mean array<double>, xx array<double>, zz array<double>"
MOMENTS = "grp string, i int, j int, n double, si double, sj double, sij double, mij double"


class CoMoments:
    """Rows, mean, centred products of x and products of z; two of them add up to those of all their rows.

    Products stay centred on the way (pairwise update), so that differences of large numbers do not cancel.
    """

    def __init__(self, n: float, mean: np.ndarray, xx: np.ndarray, zz: np.ndarray):
        self.n, self.mean, self.xx, self.zz = n, mean, xx, zz

    @classmethod
    def of(cls, x: np.ndarray, z: np.ndarray) -> CoMoments:
        mean = x.mean(axis=0)
        return cls(float(len(x)), mean, (x - mean).T @ (x - mean), z.T @ z)

    def __add__(self, other: CoMoments) -> CoMoments:
        n, gap = self.n + other.n, other.mean - self.mean
        shift = np.outer(gap, gap) * (self.n * other.n / n)
        return CoMoments(n, self.mean + gap * (other.n / n), self.xx + other.xx + shift, self.zz + other.zz)


def _partials(groups: list[str | None], moments: list[CoMoments], part: int) -> pa.RecordBatch:
    doubles = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(groups, pa.string()), pa.array([part] * len(groups), pa.int32()), pa.array([m.n for m in moments], pa.float64()),
            *[pa.array([getattr(m, c).ravel() for m in moments], doubles) for c in ("mean", "xx", "zz")],
        ],
        names=["grp", "part", "n", "mean", "xx", "zz"],
    )


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Co-moments of the groups of a task; those held are handed on whenever they are more than ``HELD_GROUPS``."""
    held: dict[str | None, CoMoments] = {}
    part = TaskContext.get().partitionId() // MERGED_PARTS
    for batch in batches:
        codes = batch.column("grp").dictionary_encode(null_encoding="encode")
        number, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
        x, z = (_matrix(batch.column(c), len(batch)) for c in ("x", "z"))
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(len(names) + 1))
        for k, name in enumerate(names):
            rows = order[bounds[k] : bounds[k + 1]]
            new = CoMoments.of(x[rows], z[rows])
            held[name] = held[name] + new if name in held else new
        if len(held) > HELD_GROUPS:
            yield _partials(list(held), list(held.values()), part)
            held.clear()
    if held:
        yield _partials(list(held), list(held.values()), part)


def _sum_of(table: pa.Table) -> CoMoments:
    total = None
    for batch in table.to_batches():
        n = batch.column("n").to_numpy()
        mean, xx, zz = (_matrix(batch.column(c), len(batch)) for c in ("mean", "xx", "zz"))
        d = mean.shape[1]
        for k in range(len(n)):
            new = CoMoments(float(n[k]), mean[k], xx[k].reshape(d, d), zz[k].reshape(d, d))
            total = new if total is None else total + new
    return total


def _merge_parts(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_partials([table.column("grp")[0].as_py()], [_sum_of(table)], 0)])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows, -1)


def _vectors(df: DataFrame, x: str, z: str | None, group: str | None) -> DataFrame:
    """(grp, x, z) of rows whose vectors are whole: null vectors and vectors with a null entry are left out."""
    src = df.select(
        (F.col(group).cast("string") if group else F.lit("0")).alias("grp"),
        F.col(x).cast("array<double>").alias("x"), F.col(z or x).cast("array<double>").alias("z"),
    )
    for c in ("x", "z"):
        src = src.where(F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull()))
    return src


def moments(df: DataFrame, x: str, z: str | None = None, group: str | None = None, centred: bool = False) -> DataFrame:
    """Sums and products per (group, i, j), added up across tasks. Vectors must have one length.

    ``grp`` is the group's value as text, null for null. ``centred`` takes x less its group's mean. One pass: tasks reduce their rows to
    co-moments per group, which are merged in two steps; vectors are shuffled only where there are many groups.
    """
    src = _vectors(df, x, z, group)
    if group and src.select(F.approx_count_distinct("grp")).first()[0] > HELD_GROUPS:
        spread = F.pmod(F.xxhash64("x"), F.lit(SPREAD))
        src = src.withColumn("__p", spread).repartition("grp", "__p").sortWithinPartitions("grp").drop("__p")
    parts = src.mapInArrow(_partial_moments, PARTIAL)
    merged = parts.groupBy("grp", "part").applyInArrow(_merge_parts, PARTIAL)

    def cells(table: pa.Table) -> pa.Table:
        total = _sum_of(table)
        d = len(total.mean)
        i, j = (c.ravel() for c in np.meshgrid(np.arange(d), np.arange(d), indexing="ij"))
        s = np.zeros(d) if centred else total.n * total.mean
        xx = total.xx if centred else total.xx + total.n * np.outer(total.mean, total.mean)
        values = [i.astype(np.int32), j.astype(np.int32), np.full(d * d, total.n), s[i], s[j], xx.ravel(), total.zz.ravel()]
        names = [c.split()[0] for c in MOMENTS.split(", ")]
        return pa.table([pa.array([table.column("grp")[0].as_py()] * (d * d), pa.string()), *[pa.array(v) for v in values]], names=names)

    return merged.groupBy("grp").applyInArrow(cells, MOMENTS)


def covariance(df: DataFrame, x: str, group: str | None = None) -> DataFrame:
    """Sample covariance cells (grp, i, j, cov)."""
    m = moments(df, x, group=group, centred=True)
    n = F.col("n")
    cov = (F.col("sij") - F.col("si") * F.col("sj") / n) / F.greatest(n - 1, F.lit(1.0))
    return m.select("grp", "i", "j", cov.alias("cov"))


def _spectrum(pdf: pd.DataFrame):
    """Covariance eigenvalues and vectors (descending), second moment of dz, sample count."""
    d = int(pdf["i"].max()) + 1
    cells = pdf.sort_values(["i", "j"])
    n = float(cells["n"].iloc[0])
    si, sj = cells["si"].to_numpy(), cells["sj"].to_numpy()
    cov = ((cells["sij"].to_numpy() - si * sj / n) / max(n - 1.0, 1.0)).reshape(d, d)
    values, vectors = np.linalg.eigh(cov)
    moment = cells["mij"].to_numpy().reshape(d, d) / n
    return np.clip(values[::-1], 0, None), vectors[:, ::-1], moment, int(n)


def _shares(v: np.ndarray) -> np.ndarray:
    return v / (v.sum() + EPS)


def _diagnose(pdf: pd.DataFrame) -> dict:
    values, vectors, moment, n = _spectrum(pdf)
    p = _shares(values)
    energy = np.einsum("ik,ij,jk->k", vectors, moment, vectors)
    total = float(np.trace(moment)) + EPS
    d = len(values)
    var, ctrl = p, _shares(energy)
    top = lambda a: set(np.argsort(-a, kind="stable")[:TOP_K].tolist())
    return {
        "effective_rank": float(np.exp(-(p * np.log(p + EPS)).sum())),
        "align_top16": float(energy[:TOP_K].sum()) / total,
        "align_top32": float(energy[: min(WIDE_K, d)].sum()) / total,
        "overlap_top16": len(top(var) & top(ctrl)) / float(TOP_K),
        "embed_dim": d,
        "num_samples": n,
        "values": values, "var": var, "ctrl": ctrl,
    }


RECORD = (
    "grp string, effective_rank double, align_top16 double, align_top32 double, overlap_top16 double, embed_dim int, num_samples long"
)


def diagnostics(df: DataFrame, x: str, z: str, group: str | None = None) -> DataFrame:
    """One record per group: effective rank, alignments, overlap, sizes (group input is D x D cells)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = _diagnose(pdf)
        return pd.DataFrame([[key[0], *[r[c] for c in ("effective_rank", "align_top16", "align_top32", "overlap_top16", "embed_dim", "num_samples")]]],
                            columns=["grp", "effective_rank", "align_top16", "align_top32", "overlap_top16", "embed_dim", "num_samples"])

    return moments(df, x, z, group, centred=True).groupBy("grp").applyInPandas(run, RECORD)


def effective_rank(df: DataFrame, x: str, group: str | None = None) -> DataFrame:
    """Effective rank and spectrum per group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = _diagnose(pdf)
        return pd.DataFrame({"grp": [key[0]], "effective_rank": [r["effective_rank"]], "eigenvalues": [r["values"].tolist()]})

    return moments(df, x, group=group, centred=True).groupBy("grp").applyInPandas(run, "grp string, effective_rank double, eigenvalues array<double>")


def direction_scores(df: DataFrame, x: str, z: str, group: str | None = None) -> DataFrame:
    """Share of variance and of dz energy per principal direction."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = _diagnose(pdf)
        return pd.DataFrame({"grp": key[0], "direction": range(len(r["var"])), "var_score": r["var"], "ctrl_score": r["ctrl"]})

    return moments(df, x, z, group, centred=True).groupBy("grp").applyInPandas(run, "grp string, direction int, var_score double, ctrl_score double")


def subspace_alignment(df: DataFrame, x: str, z: str, top_k: int, group: str | None = None) -> DataFrame:
    """Share of dz energy inside the top-k principal directions of x."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, vectors, moment, _ = _spectrum(pdf)
        u = vectors[:, :top_k]
        return pd.DataFrame({"grp": [key[0]], "alignment": [float(np.trace(u.T @ moment @ u)) / (float(np.trace(moment)) + EPS)]})

    return moments(df, x, z, group, centred=True).groupBy("grp").applyInPandas(run, "grp string, alignment double")


def top_indexes(scores: Column, k: int = TOP_K) -> Column:
    """Indexes of the k largest entries of an array, the lower index first among equals."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def top_overlap(a: Column, b: Column, k: int = TOP_K) -> Column:
    return F.size(F.array_intersect(top_indexes(a, k), top_indexes(b, k))) / F.lit(float(k))
