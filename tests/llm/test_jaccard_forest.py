import random
import re
from collections import defaultdict

import pytest

from tracelake.llm import jaccard_forest as forest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORDS.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """doc_id, class_id, n_links of every row by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = defaultdict(int)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x]}:
            common = len(s & sets[j])
            if common >= threshold * (len(s) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.class_id, r.n_links) for r in forest.join(docs).collect())


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_matches_all_pairs_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert run(spark, rows) == brute(rows)


def test_a_large_group_of_near_copies_is_compared_in_blocks(spark):
    rng = random.Random(5)
    base = [f"b{rng.randrange(500)}" for _ in range(150)]
    rows = [(k, edited(rng, base, rng.randrange(6))) for k in range(400)]
    rows += [(k, " ".join(f"r{rng.randrange(10**6)}" for _ in range(30))) for k in range(400, 450)]
    assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    long = " ".join(f"x{k}" for k in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "a  b"), (6, "a b c"), (7, long), (8, long + " tail"), (9, "p q r s t u"),
        (9, "p q r s t u"), (10, "A b"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_other_columns_do_not_matter_and_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f", 1, "x", None), (3, "a b c d e f", 2, "y", None), (9, "", 3, "z", 1), (8, None, 4, "z", 1), (4, "k l m n o", 0, "q", 2),
            (4, "k l m n o", 0, "q", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int, cell string, links int")
    kept = forest.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted([rows[1], rows[2], rows[3], rows[4]], key=lambda r: r[0])


def test_rows_without_a_doc_id_are_linked_and_one_of_each_group_stays(spark):
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(6)]
    near = lambda k: " ".join([*texts[k][:-1], "other"])
    a, b, c, d, e, _ = (" ".join(t) for t in texts)
    rows = [(None, a), (None, a), (None, near(0)), (None, b), (7, near(1)), (None, c), (None, d), (3, e), (None, e), (None, None), (None, " "), (1, None)]
    got = forest.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == sorted(
        [(None, None, 2), (None, None, 2), (None, None, 2), (None, 7, 1), (7, 7, 1), (None, None, 0), (None, None, 0), (3, 3, 1), (None, 3, 1),
         (None, None, 0), (None, None, 0), (1, 1, 0)], key=str)
    kept = [tuple(r) for r in forest.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [r for r in kept if r[1] in (a, near(0))] in ([(None, a)], [(None, near(0))])
    rest = [(7, near(1)), (None, c), (None, d), (3, e), (None, None), (None, " "), (1, None)]
    assert sorted((r for r in kept if r[1] not in (a, near(0))), key=str) == sorted(rest, key=str)


@pytest.mark.parametrize(("trees", "recall"), [(8, 0.9), (24, 0.9999), (64, 0.999)])
def test_the_prefix_is_the_longest_that_reaches_the_recall(trees, recall):
    k = forest.prefix_length(0.8, trees, 8, recall)
    assert k == 1 or 1 - (1 - 0.8**k) ** trees >= recall
    assert k == 8 or 1 - (1 - 0.8 ** (k + 1)) ** trees < recall
