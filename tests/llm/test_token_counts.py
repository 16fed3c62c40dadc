import math
import random
import re

import public_tokenizers
import pytest

from tracelake.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, scores, per_byte, longest):
    """Best segmentation of one word by the usual table, without sharing."""
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        options = [] if text[i - 1] in scores else [(best[i - 1][0] + len(text[i - 1].encode()) * per_byte, best[i - 1][1] - len(text[i - 1].encode()))]
        options += [(best[j][0] + scores[text[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if text[j:i] in scores]
        best.append(max(options))
    return -best[-1][1]


def brute(rows, scores):
    per_byte, longest, cache = -math.log(2 * len(scores)), max(map(len, scores)), {}
    out = []
    for d, t in rows:
        words = WORDS.findall(t or "")
        for w in words:
            if w not in cache:
                cache[w] = plain(tc.MARK + w, scores, per_byte, longest)
        out.append((d, len(words), sum(cache[w] for w in words)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    return sorted((tuple(r) for r in tc.count(docs, PATH, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def scores():
    return tc.piece_scores(PATH)


def test_matches_a_table_per_word_on_the_tables(spark, scores):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, scores)
    assert run(spark, rows) == want
    assert run(spark, rows, max_nodes=100) == want


def test_defined_cases(spark, scores):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "hello world"), (4, "日本語 🙂🙂 é é  x \xa0"), (5, "a" * 3000), (6, "the " * 50000), (6, "the"), (6, "the"), (7, tc.MARK)]
    assert run(spark, rows) == brute(rows, scores)
    assert run(spark, []) == []


def test_a_small_vocabulary_by_all_segmentations():
    rng = random.Random(8)
    pieces = {tc.MARK, "a", "b", "ab", "ba", "aab", tc.MARK + "a", "bb", "abab"}
    scores = {p: -rng.random() * 5 for p in sorted(pieces)}
    trie = tc.Trie(scores)

    def best(text):
        if not text:
            return 0.0, 0
        tries = []
        for n in range(1, len(text) + 1):
            if text[:n] in scores:
                s, c = best(text[n:])
                tries.append((s + scores[text[:n]], c - 1))
            elif n == 1:
                s, c = best(text[1:])
                tries.append((s + trie.per_byte * len(text[0].encode()), c - len(text[0].encode())))
        return max(tries)

    for _ in range(200):
        word = "".join(rng.choice("abü") for _ in range(rng.randrange(9)))
        assert trie.count_word(word) == -best(tc.MARK + word)[1]
