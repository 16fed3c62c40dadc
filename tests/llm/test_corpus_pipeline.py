import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import test_decontaminate
import test_jaccard_forest
from tracelake.llm import mixing, toxicity

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = {}
    now = docs
    for name, step in corpus_pipeline.STAGES:
        now = corpus_pipeline.stage(step(spark, now, SF), name)
        out[name] = now
        assert name == "token_ids" or now.columns == columns
    rejected = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    clean = [r for r in rows(docs) if r[0] not in rejected]
    assert rows(out["toxicity"]) == clean
    least = {d: c for d, c, _ in test_jaccard_forest.brute([r[:2] for r in clean])}
    single = [r for r in clean if least[r[0]] == r[0]]
    assert rows(out["ngram_jaccard_join"]) == single
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, _, _ in test_decontaminate.brute([r[:2] for r in single], items)}
    apart = [r for r in single if r[0] not in leaked]
    assert leaked and rows(out["benchmark_decontamination"]) == apart
    kept = out["benchmark_decontamination"]
    copies = {r.doc_id: r.copies for r in mixing.mix(kept).collect()}
    mixed = sorted((r for r in apart for _ in range(copies[r[0]])), key=str)
    assert rows(out["source_mix"]) == mixed
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for d, text in sorted((r[0], r[1]) for r in mixed):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(out["token_ids"]) == sorted(want, key=str)
    # the whole run gives the same
    assert rows(corpus_pipeline.run(spark, SF)) == sorted(want, key=str)


def test_a_mix_comes_near_its_targets(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    got["source"] = got.source_size.astype(str) + "/" + got.target.astype(str)
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.largest / 2 + 1).all()
    assert abs(per.target.sum() - got["size"].sum()) < 1


def test_targets_by_sharing_the_excess_again_and_again(spark):
    rng = np.random.default_rng(9)
    sizes = {f"s{k:02d}": int(v) for k, v in enumerate(np.exp(rng.normal(6, 3, 40)))} | {None: 900, "s99": 0}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
        rest = sum(sizes.values()) - sum(target.values())
    target |= share
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    assert got.keys() == target.keys()
    assert all(abs(got[s] - target[s]) < 1e-6 * (1 + target[s]) for s in target)


def test_mixing_defined_cases(spark):
    docs = [(k, "w " * (k % 7), s, "x", 1) for k, s in enumerate([None, "a", "b", "é", "z"] * 40)] + [(5, None, "a", "x", 1), (None, "p q", None, "x", 1), (7, "r s", "a", "x", 1), (7, "r s", "a", "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, target string, copies int")
    got = mixing.mix(df).collect()
    assert len(got) == len(docs)
    assert rows(mixing.mix(df)) == rows(mixing.mix(df.repartition(3)))
    n = Counter()
    for r in got:
        n[r.doc_id] += r.copies
    again = mixing.remix(df)
    assert again.columns == df.columns
    assert Counter(r.doc_id for r in again.collect()) == +n
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.remix(df.limit(0)).count() == 0


@pytest.mark.parametrize("key", [1, None])
def test_rows_under_one_doc_id_come_near_the_target(spark, monkeypatch, key):
    monkeypatch.setattr(mixing, "BLOCK", 30)
    rng = np.random.default_rng(4)
    own = [(key, "v " * int(n), "a") for n in rng.integers(1, 30, 300)]
    same = [(key, "w w w", "b")] * 400
    rest = [(k, "x " * 5, "c") for k in range(100)]
    df = spark.createDataFrame(own + same + rest, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == 800
    per = got.groupby("target").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert len(per) == 3 and ((per.taken - per.target).abs() <= per.largest / 2 + 1).all()
    again = Counter(len(r.text.split()) for r in mixing.remix(df.repartition(5)).collect())
    want = Counter()
    for r in got.itertuples():
        want[r.size] += r.copies
    assert again == +want


def test_a_large_table_of_sources_gives_the_same(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    few = rows(mixing.mix(df))
    monkeypatch.setattr(mixing, "SMALL", 3)
    assert rows(mixing.mix(df)) == few
