import math

import numpy as np
import pytest

from tracelake.operators import vectors


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 20)) * np.linspace(2, 0.1, 20)
    z = x[:, ::-1] + rng.normal(size=(300, 20)) * 0.2
    df = spark.createDataFrame([(int(i % 3), x[i].tolist(), z[i].tolist()) for i in range(300)], "label int, x array<double>, z array<double>")
    return x, z, df.repartition(5)


def test_covariance(data):
    x, _, df = data
    want = np.cov(x.T)
    for r in vectors.covariance(df, "x").collect():
        assert math.isclose(r["cov"], want[r["i"], r["j"]], abs_tol=1e-9)


def test_diagnostics(data):
    x, z, df = data
    rec = vectors.diagnostics(df, "x", "z").first()
    val, u = np.linalg.eigh(np.cov(x.T))
    val, u = np.clip(val[::-1], 0, None), u[:, ::-1]
    p = val / (val.sum() + 1e-8)
    assert math.isclose(rec["effective_rank"], float(np.exp(-(p * np.log(p + 1e-8)).sum())), rel_tol=1e-9)
    align = np.square(z @ u[:, :16]).sum(1).mean() / (np.square(z).sum(1).mean() + 1e-8)
    assert math.isclose(rec["align_top16"], align, rel_tol=1e-9)
    assert math.isclose(vectors.subspace_alignment(df, "x", "z", 16).first()["alignment"], align, rel_tol=1e-9)
    ctrl = np.square(z @ u).mean(0)
    ctrl = ctrl / (ctrl.sum() + 1e-8)
    rows = vectors.direction_scores(df, "x", "z").orderBy("direction").collect()
    assert np.allclose([r["ctrl_score"] for r in rows], ctrl) and np.allclose([r["var_score"] for r in rows], p)
    assert rec["overlap_top16"] == len(set(np.argsort(-p)[:16]) & set(np.argsort(-ctrl)[:16])) / 16
    assert (rec["embed_dim"], rec["num_samples"]) == (20, 300)


@pytest.mark.parametrize("held, merged", [(256, 256), (1, 2)])
def test_large_offsets_and_many_groups(spark, monkeypatch, held, merged):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * 0.01 + 1e6
    label = rng.integers(0, 7, 400)
    monkeypatch.setattr(vectors, "HELD_GROUPS", held)
    monkeypatch.setattr(vectors, "MERGED_PARTS", merged)
    rows = [(int(k) if k else None, v.tolist()) for k, v in zip(label, x, strict=True)]
    df = spark.createDataFrame([*rows, (3, None), (3, [1.0, None, 0.0, 0.0, 0.0])], "label int, x array<double>").repartition(6)
    got = {(r["grp"], r["i"], r["j"]): r["cov"] for r in vectors.covariance(df, "x", "label").collect()}
    for k in range(7):
        want = np.cov(x[label == k].T)
        for i in range(5):
            for j in range(5):
                assert math.isclose(got[str(k) if k else None, i, j], want[i, j], rel_tol=1e-6, abs_tol=1e-9)
    whole = {(r["i"], r["j"]): r for r in vectors.moments(df, "x").collect()}
    assert math.isclose(whole[1, 2]["sij"], float(x[:, 1] @ x[:, 2]), rel_tol=1e-12) and math.isclose(whole[1, 2]["si"], x[:, 1].sum(), rel_tol=1e-12)
    assert vectors.moments(df.limit(0), "x").collect() == []


def test_identity_rank_and_groups(spark, data, monkeypatch):
    pts = [[s if j == i else 0.0 for j in range(4)] for i in range(4) for s in (1.0, -1.0)]
    df = spark.createDataFrame([(p,) for p in pts], "x array<double>")
    assert math.isclose(vectors.effective_rank(df, "x").first()["effective_rank"], 4.0, rel_tol=1e-6)
    _, _, grouped = data
    for parts in (1, 50):
        monkeypatch.setattr(vectors, "SPREAD", parts)
        monkeypatch.setattr(vectors, "HELD_GROUPS", 2)
        assert [r["num_samples"] for r in vectors.diagnostics(grouped, "x", "z", "label").collect()] == [100] * 3
