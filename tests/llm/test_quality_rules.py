import math
import random
import re
from collections import Counter

import pytest

from tracelake.llm import quality_rules as rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_counts_of_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "x y z x y z", "a\nb\na\n\n\n a\nb", "#*$%&|<> ö\x0b ü\x0c€\r\n🙂 🙂 🙂 🙂", "| a | b |\n" * 30,
             "no\x1fbreak\xa0here now", "w " * 30000, " ".join(str(rng.randrange(40)) for _ in range(20000))]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in range(3, 40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in rules.count_text(docs, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {k: counts(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize(("n", "k"), [(1, 0), (10, 0), (300, 2), (1000, 30), (50000, 2300), (10**6, 49000)])
def test_binomial_tail(spark, n, k):
    p = 0.05
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
    got = spark.range(1).select(rules.binomial_below(str(n), str(k), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-6, abs=1e-300)


def frames(spark, rows):
    text = lambda bad: ("## " if bad else "") * 60 + " ".join(f"word{k}" for k in range(100))
    docs = spark.createDataFrame([(d, text(bad), lang, 1, "x") for d, bad, lang, _ in rows], "doc_id long, text string, lang string, kept int, failed string")
    labels = spark.createDataFrame([(d, q, 0) for d, _, _, q in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_junk_goes_and_at_most_the_risk_of_good_texts(spark):
    # 3 of 3000 good texts look like junk: the cutoff may reject them; the other language has too few labels to say
    rows = [(k, k < 3, "en", 1) for k in range(3000)] + [(5000 + k, True, "en", 0) for k in range(200)] + [(9000 + k, k < 50, None, 1 - (k < 50)) for k in range(90)]
    got = {r.doc_id: r for r in rules.judge(*frames(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(not got[5000 + k].kept and "symbols" in got[5000 + k].failed for k in range(200))
    assert sum(not got[k].kept for k in range(3000)) == 3
    assert all(got[9000 + k].failed == "" for k in range(90))


def test_too_many_good_texts_above_keeps_the_rule_off(spark):
    rows = [(k, k < 60, "en", 1) for k in range(3000)]
    assert all(r.kept or r.base_failed for r in rules.judge(*frames(spark, rows)).collect())


def test_empty_tables_and_odd_labels(spark):
    docs, labels = frames(spark, [(1, False, "en", 1), (1, False, "en", 1), (2, True, None, 1)])
    odd = spark.createDataFrame([(None, 1, 1), (1, None, 0), (7, 1, 0), (1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert rules.judge(docs, odd).count() == 3
    assert rules.judge(docs, labels.limit(0)).where("failed != ''").count() == 0
    assert rules.judge(docs.limit(0), labels).count() == 0
