"""JSON inside free text against the standard decoder, and texts that nest deeply or not at all."""

import json
import random
import time

from pyspark.sql import functions as F

from tracelake.functions import udfs
from tracelake.functions.jsontext import first_object, load


def by_decoder(text):
    decoder = json.JSONDecoder()
    for at, c in enumerate(text):
        if c == "{":
            try:
                return text[at : decoder.raw_decode(text, at)[1]]
            except json.JSONDecodeError:
                continue
    return None


def test_matches_the_standard_decoder():
    rng = random.Random(7)
    pieces = ['{', '}', '[', ']', '"', '"a"', ':', ',', ' ', '1', '-0.5e3', '01', 'true', 'nul', 'NaN', '-Infinity', '\\', '\\n', '\\u00e9', '\n', '{"k": 1}', '"x":', '{}', 'é']
    for _ in range(30000):
        text = "".join(rng.choices(pieces, k=rng.randrange(14)))
        assert first_object(text) == by_decoder(text), text


def test_objects_round_trip():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        return [None, rng.random() * 1e9, "q\"\\{}" * rng.randrange(3), -rng.randrange(99)][kind] if kind < 4 else (
            [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 4 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))})

    for _ in range(300):
        v = {"v": value(4)}
        assert json.loads(first_object("note { " + json.dumps(v, indent=rng.choice([None, 1])) + " } tail")) == v


def test_time_is_linear_in_any_text():
    n = 100_000
    began = time.perf_counter()
    for text in ("{" * n, '{"a":' * n, '{"{' * n, '[{"a":[' * n, '{"a":{}' * n, "{'" * n, '{"a":1,' * n, '{"' + "\\" * n):
        first_object(text)
    assert time.perf_counter() - began < 20
    deep = '{"a":' * n + "1" + "}" * n
    assert first_object("x" + deep) == deep


def test_documents_of_any_depth_or_none():
    n = 50_000
    got, depth = load('{"a":' * n + "[1, {}]" + "}" * n), 0
    while isinstance(got, dict):
        got, depth = got["a"], depth + 1
    assert (got, depth) == ([1, {}], n)
    assert [load(x) for x in (None, "", "{", "[1", "nonsense", "[" * n)] == [None] * 6
    assert load('[{"a": [1, "b"]}, 2]') == [{"a": [1, "b"]}, 2]


def test_in_a_query(spark):
    udfs.register_udfs(spark)
    rows = [("{" * 20000,), ("{bad",), (None,), ('{"name": "A", "x": [{"name": "B"}]}',)]
    df = spark.createDataFrame(rows, "doc string")
    df.createOrReplaceTempView("json_texts")
    assert [r[0] for r in df.select(udfs.first_json("doc")).collect()] == [None, None, None, rows[3][0]]
    assert [r["name"] for r in spark.sql("SELECT t.name FROM json_texts d, LATERAL schema_names(d.doc, false) t ORDER BY t.pos").collect()] == ["A", "B"]
    assert spark.sql("SELECT t.path FROM json_texts d, LATERAL json_paths(d.doc) t").where(F.col("path") == "x[*].name").count() == 1
