"""Fits that take in every row given for them."""

import numpy as np
import pytest

from ticktide.llm import quality_rank


def labelled(n: int, seed: int = 5):
    rng, size = np.random.default_rng(seed), len(quality_rank.FEATURES)
    y = (rng.random(n) < 0.6).astype(int)
    return rng.normal(size=(n, size)) + y[:, None] * np.linspace(0, 0.6, size), y


def test_ranking_counts_all_pairs():
    """Against ascent over every pair, and the cut against all sorted scores."""
    x, y = labelled(160)
    model = quality_rank.BradleyTerry(x, y)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -6, 6)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    w, part = np.zeros(x.shape[1]), quality_rank.FIT_PAIRS / len(d)
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve(part * (d * (p * (1 - p))[:, None]).T @ d + 5 * np.eye(len(w)), part * d.T @ (1 - p) - 5 * w)
    assert np.allclose(model.w, w, atol=2e-3)
    s, bad = np.sort(z @ model.w), int((y == 0).sum())
    assert model.cut == pytest.approx((s[bad - 1] + s[bad]) / 2) and model.scale == pytest.approx(s.std() / 2)


def test_quantile_by_steps(monkeypatch):
    x, y = labelled(3000)
    x[:1500] = x[0]  # ties
    whole = quality_rank.BradleyTerry(x, y)
    monkeypatch.setattr(quality_rank, "FEW", 3)
    monkeypatch.setattr(quality_rank, "STEPS", 5)
    assert quality_rank.BradleyTerry(x, y).cut == whole.cut


def test_every_labelled_row_is_fitted(spark):
    """25,000 labelled rows, of which the sample of 20,000 would leave out a fifth: the fit equals the one in memory over all of them."""
    x, y = labelled(25_000, 9)
    described = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    labels = spark.createDataFrame(list(enumerate(y.tolist())), "doc_id long, quality int")
    got, want = quality_rank.fit(described, labels), quality_rank.BradleyTerry(x, y)
    assert np.allclose(got.mean, x.mean(0)) and np.allclose(got.spread, x.std(0)) and got.share == y.mean()
    assert np.allclose(got.w, want.w, atol=1e-6) and got.cut == pytest.approx(want.cut, abs=1e-6)
