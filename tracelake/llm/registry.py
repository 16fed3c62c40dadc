"""Imports every operator module, so that its query is registered."""

from __future__ import annotations

import importlib

from tracelake.llm.catalog import QUERIES, SQL

for _module in ("jaccard_forest", "toxicity", "decontaminate", "mixing", "token_shards", "quality_rules", "license_join", "blob_secrets", "chat_format", "token_counts", "importance", "vector_codes", "suffix_dedup"):
    importlib.import_module(f"tracelake.llm.{_module}")

__all__ = ["QUERIES", "SQL"]
