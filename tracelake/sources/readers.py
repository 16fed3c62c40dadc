"""Readers: JSON lines, JSON documents, page files, run logs, stored reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.operators.compare import CONFIG_MARK


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist on the file system it names?"""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped and a missing path reads as no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).json(path)
    return df if limit is None else df.limit(limit)


def read_json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one pretty-printed JSON document each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_corpus(spark: SparkSession, base: str, schema: StructType | str, files: str = "*.json*") -> DataFrame:
    """All JSON-lines files below a folder with ``file``, ``config`` (first folder) and ``stem`` columns.

    ``files`` is the glob of file names; pass ``*.jsonl`` where other JSON files lie beside them.
    """
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", files).json(base)
    # both are URIs, encoded alike, whatever characters the folder has
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString().rstrip("/")
    root = re.sub("^file:/+", "file:/", root)
    rest = F.substring(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/"), len(root) + 2, 1 << 20)
    rel = F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    return df.select("*", rel.alias("file")).withColumns(
        {
            "config": F.substring_index("file", "/", 1),
            "stem": F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", ""),
        }
    )


# Fixed value: name of a page label file.
PAGE_FILE = r"sample_(\d+)_page_(\d+)\.json$"
# The same keys as partition folders.
PAGE_FOLDER = r"sample_id=(\d+)/page_num=(\d+)/[^/]*$"
# Page files in packs: name and text of each.
PACK_SCHEMA = "path string, value string"
PAGE_SCHEMA = "map<string, struct<content: string, bbox: string, type: string>>"


def read_page_files(
    spark: SparkSession, path: str, sample_id: str | None = None, limit: int | None = None, pattern: str = PAGE_FILE, packed: bool = False
) -> DataFrame:
    """Page label files (sample_id, page_num, field_pos, field_name, content, bbox, type).

    ``pattern`` finds sample and page in the file path; other files are skipped. ``limit`` keeps the
    first pages of each sample. Field order is the order in the file. ``packed`` reads what ``sinks.pack_page_files`` wrote, where
    the driver lists a file per task that wrote and not one per page.
    """
    if packed:
        raw = spark.read.schema(PACK_SCHEMA).parquet(path)
        name = F.col("path")
    else:
        raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        name = F.col("_metadata.file_path")
    d = raw.select(
        F.regexp_extract(name, pattern, 1).alias("sample_id"),
        F.regexp_extract(name, pattern, 2).try_cast("int").alias("page_num"), "value",
    ).filter("page_num IS NOT NULL")
    if sample_id is not None:
        d = d.filter(F.col("sample_id") == sample_id)
    if limit is not None:
        rn = F.row_number().over(Window.partitionBy("sample_id").orderBy("page_num"))
        d = d.withColumn("__rn", rn).filter(F.col("__rn") <= limit).drop("__rn")
    fields = F.map_entries(F.from_json("value", PAGE_SCHEMA))
    return d.select("sample_id", "page_num", F.posexplode(fields).alias("field_pos", "f")).select(
        "sample_id", "page_num", "field_pos", F.col("f.key").alias("field_name"), "f.value.*"
    )


def read_run_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One record per CONFIG block; the separator splits large logs across tasks."""
    return spark.read.option("lineSep", CONFIG_MARK).text(path).filter(F.trim("value") != "")
