"""Sinks: JSON lines, split exports with a manifest, packed page files, comparison CSV, table audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("jsonl", "parquet", "csv")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).json(path)
    return path


def export_dataset(df: DataFrame, path: str, fmt: str, by: Sequence[str] = (), mode: str = "errorifexists") -> str:
    """Write a dataset as jsonl, parquet or csv, one folder per split."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format: {fmt}")
    writer = df.write.mode(mode).format("json" if fmt == "jsonl" else fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)
    return path


def pack_page_files(pages: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Page label files (sample_id, page_num, value) with their names in a few large files.

    A file per page costs the file system several calls each and the driver an entry each, whatever it holds.
    """
    key = lambda c, n: F.lpad(F.col(c).cast("string"), F.greatest(F.length(F.col(c).cast("string")), F.lit(n)), F.lit("0"))
    name = F.concat(F.lit("sample_"), key("sample_id", 6), F.lit("_page_"), key("page_num", 4), F.lit(".json"))
    pages.select(name.alias("path"), "value").write.mode(mode).parquet(path)
    return path


def split_manifest(df: DataFrame, by: Sequence[str], path: str, fmt: str) -> DataFrame:
    """Rows, columns and format of every exported split."""
    columns = [c for c in df.columns if c not in by]
    folder = F.concat_ws("/", F.lit(path), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in by])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("num_rows")).select(
        *by, "num_rows", F.array(*[F.lit(c) for c in columns]).alias("columns"), F.lit(fmt).alias("export_format"), folder.alias("output_path")
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not replaced, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def comparison_csv(runs: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> str:
    """All runs in one CSV with a ``run`` column."""
    out = None
    for name, df in runs.items():
        part = df.withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part)
    out.write.mode(mode).option("header", True).csv(path)
    return path


def audit_tables(tables: Mapping[str, DataFrame], any_of: Sequence[Sequence[str]]) -> DataFrame:
    """Row count of each source, and one ``ok`` row: every listed group has a non-empty member."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n")
        out = part if out is None else out.unionByName(part)
    have = [F.max(F.when(F.col("source").isin(list(group)), F.col("n") > 0).otherwise(F.lit(False))) for group in any_of]
    ok = have[0]
    for cond in have[1:]:
        ok = ok & cond
    return out.withColumn("ok", out.agg(ok.alias("ok")).scalar())


def require_tables(tables: Mapping[str, DataFrame], any_of: Sequence[Sequence[str]]) -> None:
    """Fail unless every group has a non-empty source."""
    counts = {r["source"]: r["n"] for r in audit_tables(tables, any_of).collect()}
    empty = [" or ".join(g) for g in any_of if not any(counts.get(s, 0) > 0 for s in g)]
    if empty:
        raise ValueError("missing source tables: " + ", ".join(empty))
