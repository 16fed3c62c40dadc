import zlib

import numpy as np
import pytest

from tracelake.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    rows = toxicity.op5_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    return rows, rows.merge(labels, on="doc_id")


def test_every_document_has_a_score_and_the_held_out_ones_are_marked(scored):
    rows, _ = scored
    assert len(rows) == 10000 and rows.doc_id.is_unique
    assert rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(rows.doc_id, rows.held_out))


def test_held_out_accuracy(scored):
    held = scored[1][scored[1].held_out]
    toxic, clean = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() > 0.95
    assert (toxic >= 0.3).mean() > 0.8 and (clean >= 0.3).mean() < 0.05


def test_an_unseen_misspelling_scores_like_the_word():
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts, labels = [], []
    for k in range(400):
        words = list(rng.choice(plain, 60))
        if k % 4 == 0:
            words[rng.integers(60)] = "scoundrel"
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    model = toxicity.fit(texts, np.array(labels))
    score = lambda t: model.score(*toxicity.wordbytes.flat(toxicity.pa.array([t])))[0]
    rest = " ".join(plain[:200])
    assert score(f"{rest} scoundrell {rest}") > 0.5 > 0.3 > score(rest)


def test_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (None, "some words", "c"), (3, "x " * 40000, "d"), (3, "x " * 40000, "d")], "doc_id long, text string, score string"
    )
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == pytest.approx([0.0] * 5)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, odd)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).count() == 0
    kept = toxicity.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == 5
