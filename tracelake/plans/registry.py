"""All registered queries."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import metrics
from tracelake.plans.catalog import QUERIES, SQL
from tracelake.plans.fixtures import SLO_TBT, SLO_TTFT, requests

for _family in ("serving", "corpora", "traces", "runs", "layouts", "documents", "vectorset", "storage", "streams"):
    importlib.import_module(f"tracelake.plans.{_family}")

__all__ = ["QUERIES", "SQL", "slo_board"]


def slo_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, violations and latency percentiles per workload and overall."""
    return metrics.debug_report(requests(spark, sf_dir), "workload_type", SLO_TTFT, SLO_TBT).orderBy(F.col("scope"))
