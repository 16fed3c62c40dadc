import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tracelake.llm import vector_codes as vc


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = defaultdict(int)
    for _, q, _ in kept:
        lengths[len(q)] += 1
    if not kept:
        return []
    size = max(lengths, key=lambda n: (lengths[n], n))
    kept = sorted((r for r in kept if len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ranges = vc.cut(size, parts)
    books = [[r[1][at] for r in kept[:entries]] for at in ranges]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for book, at in zip(books, ranges, strict=True):
            own = defaultdict(list)
            for _, q, _ in kept:
                own[near(q[at], book)[1]].append(q[at])
            for e, some in own.items():
                book[e] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    out, totals = [], defaultdict(int)
    for i, q, lab in kept:
        found = [near(q[at], book) for book, at in zip(books, ranges, strict=True)]
        error = min(sum(d for d, _ in found), (1 << 63) - 1)
        totals[lab] += error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, lab))
    return sorted(((i, c, e, min(totals[lab], (1 << 63) - 1), digest) for i, c, e, lab in out), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    return sorted((tuple(r) for r in vc.compress(df, **kw).collect()), key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(9, 12))
    rows = [(int(i), (centers[rng.integers(9)] + rng.normal(size=12) * 0.05).round(2).tolist(), int(rng.integers(4)) if i % 7 else None) for i in rng.permutation(700)]
    rows += rows[:60]
    assert run(spark, rows, entries=20) == brute(rows, entries=20)


def test_defined_cases(spark):
    rng = random.Random(3)
    whole = [(i, [rng.choice([-1.5, 0.0, 0.0004, 2.0]) for _ in range(6)], None) for i in range(40)]
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 6, 1), (103, [float("inf")] + [0.0] * 5, 2), (104, [1.0], 1), (105, [], 1),
           (None, [0.5] * 6, 3), (7, [0.25] * 6, 3), (7, [0.25] * 6, 3)]
    assert run(spark, whole + odd, rounds=2) == brute(whole + odd, rounds=2)
    assert run(spark, whole, entries=3) == brute(whole, entries=3)
    assert run(spark, [(1, None, 1)]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, [], 1), (2, [], None)]) == brute([(1, [], 1), (2, [], None)])


def test_components_beyond_double_precision(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e7, 1e7 + 1 / 1024, -3e30, 2.5]) for _ in range(4)], i % 2) for i in range(60)]
    assert run(spark, rows, entries=6, rounds=2) == brute(rows, entries=6, rounds=2)


@pytest.mark.parametrize("spread", [0.0, 3.0, 300.0])
def test_a_tree_covers_and_parts_its_points(spread):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(500, 3)) * spread + rng.integers(0, 5, size=(500, 1)) * 1000)
    tree = vc.build_tree(x, leaf_rows=4)
    assert sorted(tree["order"].tolist()) == list(range(500))
    for k in range(len(tree["center"])):
        own = x[tree["order"][tree["low"][k] : tree["high"][k]]]
        assert np.sqrt(((own - x[tree["center"][k]]) ** 2).sum(1)).max() <= tree["radius"][k] + 1e-9
        centers = x[tree["center"][tree["child"][k] : tree["child"][k] + tree["children"][k]]]
        for a in range(len(centers)):
            assert all(np.sqrt(((centers[a] - b) ** 2).sum()) > tree["radius"][k] / 2 for b in centers[:a])
