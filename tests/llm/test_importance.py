import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelake.llm import importance, radix_sort

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, target, percent=10, least_words=20, most_words=1, buckets=10_000):
    def bag(text):
        words = WORDS.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(1, most_words + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    bags = [bag(t) for _, t in rows]
    s, t = Counter(b for _, f in bags for b in f), Counter(b for x in target for b in bag(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    scored = []
    for (d, _), (n_words, f) in zip(rows, bags, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        scored.append([n_words, d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    pool = sorted((r for r in scored if r[0] >= least_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    drawn = percent * len(pool) // 100
    for k, r in enumerate(pool):
        r.append(k + 1 if k < drawn else None)
    return sorted((tuple(r[1:]) if len(r) == 6 else (*r[1:], None) for r in scored), key=str)


def run(spark, rows, target, **kw):
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, score int").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted((tuple(r) for r in importance.resample(docs, goal, **kw).collect()), key=str)


def test_matches_brute_force_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("text").collect()]
    assert run(spark, rows, target, block_rows=64, digit_bits=9) == brute(rows, target)


def test_runs_of_words_and_defined_cases(spark):
    rng = random.Random(4)
    odd = [None, "", " . ", "É日本 ÀB ab AB a_b " * 9, "x" * 300 + " " + "long" * 40 + " tail " * 30, "a b c " * 20000]
    rows = [(i % 70 if i % 9 else None, rng.choice(odd) if i % 5 == 0 else " ".join(rng.choices(["The", "the", "cat", "7", "日"], k=rng.randrange(40)))) for i in range(300)]
    rows += rows[:40]
    for target in (["the cat sat. THE CAT", None, ""], []):
        for n in (1, 3):
            got = run(spark, rows, target, percent=37, most_words=n, buckets=97, block_rows=32, digit_bits=8)
            assert got == brute(rows, target, 37, most_words=n, buckets=97)
    assert run(spark, [], ["a"]) == []
    assert run(spark, [(1, "a")], ["a"]) == brute([(1, "a")], ["a"])


@pytest.mark.parametrize("low,high,n,descending", [(-(1 << 63), (1 << 63) - 1, 500, True), (5, 5, 100, False), (-70000, 70000, 1500, False)])
def test_radix_order(spark, low, high, n, descending):
    rng = random.Random(n)
    rows = [(None if rng.random() < 0.1 else rng.randint(low, high), rng.randint(0, 5), i) for i in range(n)] + [(low, 0, n), (high, 5, n + 1)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(7)
    got = radix_sort.positions(df, [("a", descending), ("b", not descending), ("c", False)], digit_bits=16, block_rows=200).orderBy("position").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, (r[0] or 0) * (-1 if descending else 1), r[1] * (1 if descending else -1), r[2]))
    assert [tuple(r) for r in got] == [(*r, k) for k, r in enumerate(want)]


def test_equal_keys_fill_many_blocks(spark):
    df = spark.range(5000).select((F.col("id") * 0).alias("a"))
    got = radix_sort.positions(df, [("a", False)], block_rows=64)
    assert sorted(r["position"] for r in got.collect()) == list(range(5000))
