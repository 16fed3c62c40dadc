import random
import re

from tracelake.llm import decontaminate as decon

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def runs(w, width):
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items, threshold=0.8):
    """(doc_id, item_id, similarity) by sliding every item along every text."""
    parsed = [(i, words(t)) for i, t in items]
    sets = {k: runs(w, min(5, len(w))) for k, (_, w) in enumerate(parsed) if w}
    holders = {}
    for s in sets.values():
        for x in s:
            holders[x] = holders.get(x, 0) + 1
    out = []
    for d, t in docs:
        w = words(t)
        for k, s in sets.items():
            n = len(parsed[k][1])
            if not runs(w, min(5, n)) & s:
                continue
            total = sum(1 / holders[x] for x in s)
            best = 0.0
            for start in range(-n, len(w) + 1):
                part = runs(w[max(0, start - n // 4) : max(0, start + n + n // 4)], min(5, n))
                best = max(best, sum(1 / holders[x] for x in s & part) / total)
            if best >= threshold:
                out.append((d, parsed[k][0], round(best, 6)))
    return sorted(out, key=str)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.item_id, round(r.similarity, 6)) for r in decon.find(d, b, **kw).collect()), key=str)


def test_matches_a_sliding_comparison_on_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert want and found(spark, docs, items) == want
    assert found(spark, docs, items, item_block=7) == want


def test_edited_and_shifted_items_are_found(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(3, 90)))) for k in range(40)]
    docs = []
    for d in range(160):
        w = words(items[d % 40][1])
        if d % 3 == 1 and len(w) >= 29:
            w[rng.randrange(len(w))] = "changed"
        if d % 3 == 2 and len(w) >= 29:
            w.insert(rng.randrange(len(w)), "added")
        text = " ".join([word() for _ in range(rng.randrange(200))] + w + [word() for _ in range(rng.randrange(60))])
        docs.append((d, text.upper() if d % 2 else text.replace(" ", ", ")))
    docs += [(1000 + d, " ".join(word() for _ in range(300))) for d in range(40)]
    assert found(spark, docs, items) == brute(docs, items)


def test_defined_cases(spark):
    items = [(1, None), (2, ""), (3, "?!"), (4, "one two"), (5, "a b c d e f g h i j k l m n o p"), (5, "a b c d e f g h i j k l m n o p"), (None, "x1 x2 x3 x4 x5 x6 x7")]
    docs = [(1, None), (2, ""), (3, "say one, TWO now"), (None, "a b c d e f g h i j k l m n o p"), (7, "q " * 50000 + "x1 x2 x3 x4 x5 x6 x7"), (7, "one two")]
    got = found(spark, docs, items)
    assert got == sorted([(3, 4, 1.0), (None, 5, 1.0), (None, 5, 1.0), (7, None, 1.0), (7, 4, 1.0)], key=str)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    wide = spark.createDataFrame([(3, "one two", "x", 1)], "doc_id long, text string, item_id string, similarity int")
    bench = spark.createDataFrame([(4, "one two", 1)], "item_id long, text string, doc_id int")
    kept = decon.drop_contaminated(wide, bench)
    assert kept.columns == wide.columns and kept.count() == 0
    assert decon.drop_contaminated(wide, bench.limit(0)).count() == 1


def test_short_items_with_edits_and_cuts_at_the_ends_are_found(spark):
    rng = random.Random(29)
    fresh = lambda: f"w{rng.randrange(10**6)}"
    items = [(n, " ".join(fresh() for _ in range(n))) for n in range(9, 40)]
    docs = []
    for n, text in items:
        for k in range(1, 5):
            w = text.split()
            inner = w[: n // 2] + ["added"] + w[n // 2 :]
            for edited in (w[k:], w[:-k], [*w[: k - 1], "changed", *w[k:]], [*w[: n - k], "changed", *w[n - k + 1 :]], ["x", *w[1:-1], "y"], inner):
                docs.append((len(docs), " ".join([fresh() for _ in range(rng.randrange(20, 60))] + edited + [fresh() for _ in range(30)])))
    want = brute(docs, items)
    assert len({i for _, i, _ in want}) == len(items) and found(spark, docs, items) == want


def test_items_whose_common_part_is_missing_are_found(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = fresh(30)
    items = [(k, " ".join(common + fresh(12))) for k in range(30)]
    docs = [(k, " ".join(fresh(15) + t.split()[26:] + fresh(15))) for k, t in items]
    want = brute(docs, items)
    assert len(want) == len(items) and found(spark, docs, items) == want


def test_weights_do_not_depend_on_the_blocks_of_the_benchmark(spark):
    rng = random.Random(17)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = fresh(12)
    items = [(k, " ".join(common + fresh(12))) for k in range(12)]
    docs = [(k, " ".join(fresh(15) + t.split()[9:] + fresh(15))) for k, t in items]
    want = brute(docs, items)
    assert len(want) == len(items) and found(spark, docs, items) == want and found(spark, docs, items, item_block=1) == want
