import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracelake.llm import suffix_dedup as sd


def brute(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        spans = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n int").repartition(4)
    return sorted((tuple(r) for r in sd.dedup(df, **kw).collect()), key=str)


def test_matches_brute_force_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(0 < r[2] < r[1] for r in got)


@pytest.mark.parametrize("length,bucket_bytes", [(24, 300), (7, 100), (1, 50)])
def test_short_strings_over_few_letters(spark, length, bucket_bytes):
    rng = random.Random(length)
    passages = ["".join(rng.choices("abcdé", k=rng.randrange(10, 60))) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("abcd日", k=rng.randrange(1, 40))) for _ in range(rng.randrange(5))]
        rows.append((i % 90 if i % 11 else None, "".join(parts)))
    rows += [(500, "a" * 300), (501, "a" * 24), (502, "ab" * 80), (503, None), (504, ""), (505, "abc\x00" * 9), (505, "abc\x00" * 9)] + rows[:20]
    assert run(spark, rows, length=length, bucket_bytes=bucket_bytes) == brute(rows, length)


def test_a_passage_common_to_many_buckets(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    passage = word(60)
    rows = [(i, word(rng.randrange(20, 90)) + passage + word(rng.randrange(20, 90))) for i in range(200)]
    rows += [(1000 + i, word(5) + passage[i : i + 39] + word(5)) for i in range(20)]
    assert run(spark, rows, length=40, bucket_bytes=500) == brute(rows, 40)


def test_long_texts_are_searched_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefgh", k=6000))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = sd.Anchors(data, np.array([0, len(data)]), 50)
    monkeypatch.setattr(sd, "PIECE_BYTES", 700)
    pieces = sd.Anchors(data, np.array([0, len(data)]), 50)
    starts = lambda a: [(s, p) for p, lo, hi in zip(a.at, a.first, a.last, strict=True) for s in range(lo, hi + 1)]
    assert starts(whole) == starts(pieces)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "short")]) == brute([(1, "short")])


def test_merged_intervals():
    group, low, high = sd.merged(np.array([1, 0, 1, 1, 0]), np.array([5, 0, 0, 20, 4]), np.array([9, 4, 5, 21, 6]))
    assert (group.tolist(), low.tolist(), high.tolist()) == ([0, 1, 1], [0, 0, 20], [6, 9, 21])
