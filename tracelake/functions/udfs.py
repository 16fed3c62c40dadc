"""Arrow UDFs and UDTFs for the few functions without a built-in form."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tracelake.functions.jsontext import first_object, load
from tracelake.functions.text import fold_table

@cache
def _folds() -> dict[int, str]:
    return str.maketrans(fold_table())


def fold(text: str | None) -> str | None:
    """The same folding as ``text.fold_latin``, from the same table, for use inside Python code."""
    return None if text is None else "".join(c for c in text.lower().translate(_folds()) if "a" <= c <= "z" or c.isdigit())


@F.pandas_udf(StringType())
def fold_text(s: pd.Series) -> pd.Series:
    return s.map(fold)


@F.pandas_udf(DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two (already normalised) texts."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def find_json(text: str | None) -> str | None:
    """First JSON object in free text: inside a code fence if there is one, else anywhere."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.IGNORECASE | re.DOTALL)
    return first_object(fenced.group(1) if fenced else text)


@F.pandas_udf(StringType())
def first_json(s: pd.Series) -> pd.Series:
    return s.map(find_json)


@F.udtf(returnType="pos: int, name: string")
class SchemaNames:
    """Distinct ``name`` values of a nested JSON in depth-first order; none of a text that is no JSON."""

    def eval(self, doc: str, folded: bool):
        seen = set()
        stack = [load(doc)]
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                name = node.get("name")
                if isinstance(name, str) and name.strip():
                    key = fold(name) if folded else name.strip()
                    if key not in seen:
                        seen.add(key)
                        yield len(seen) - 1, name.strip()
                stack.extend(reversed(list(node.values())))
            elif isinstance(node, list):
                stack.extend(reversed(node))


@F.udtf(returnType="pos: int, path: string")
class JsonPaths:
    """Key paths of a nested JSON; lists are sampled by their first element as ``[*]``. No paths of a text that is no JSON."""

    def eval(self, doc: str):
        pos = 0
        stack = [("", load(doc))]
        while stack:
            path, node = stack.pop()
            if path and not path.endswith("[*]"):
                yield pos, path
                pos += 1
            if isinstance(node, dict):
                stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(node.items()))
            elif isinstance(node, list) and node and isinstance(node[0], (dict, list)):
                stack.append((f"{path}[*]", node[0]))


def register_udfs(spark: SparkSession) -> None:
    spark.udf.register("fold_text", fold_text)
    spark.udf.register("text_ratio", text_ratio)
    spark.udf.register("first_json", first_json)
    spark.udtf.register("schema_names", SchemaNames)
    spark.udtf.register("json_paths", JsonPaths)
