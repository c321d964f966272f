"""Mining and losses over more rows than a tile has, held against plain NumPy."""

import numpy as np
import pytest

from pathline.operators import losses as M


@pytest.fixture(scope="module", params=[3, 400])  # persons: tiles of one, and of many
def rows(spark, request):
    r = np.random.default_rng(request.param)
    n = 1200
    v, pid = r.normal(size=(n, 6)), r.integers(request.param, size=n).astype(float)
    pid[::50] = np.nan
    df = spark.createDataFrame([(i, None if np.isnan(p) else int(p), x.tolist()) for i, (p, x) in enumerate(zip(pid, v, strict=True))], "vec_id long, person_id int, embedding array<double>")
    return df, v, pid


def parts(v, pid):
    d = np.sqrt(np.maximum(((v[:, None] - v[None]) ** 2).sum(-1), 1e-12))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return d, u @ u.T, pid[:, None] == pid[None]


def values(df, *names):
    return np.array([[r[n] for n in names] for r in df.orderBy("q_id").collect()])


def test_hard_mining(rows):
    df, v, pid = rows
    d, _, pos = parts(v, pid)
    there = np.stack([np.where(pos, d, 0).max(1), np.where(pos, 1e9, d).min(1)], axis=1)
    assert values(M.hard_mining(df), "ap", "an") == pytest.approx(there, abs=1e-5)


def test_weighted_mining(rows):
    df, v, pid = rows
    d, _, pos = parts(v, pid)
    m = np.where(pos, d, 0).max(1, keepdims=True)
    mean = lambda w: (w * d).sum(1) / (w.sum(1) + 1e-6)
    there = np.stack([mean(np.where(pos, np.exp(d - m), 0)), mean(np.where(pos, 0, np.exp(-d)))], axis=1)
    assert values(M.weighted_mining(df), "ap", "an") == pytest.approx(there, abs=1e-6)


@pytest.mark.parametrize("name", ["circle", "cosface"])
def test_pair_losses(rows, name):
    df, v, pid = rows
    _, s, pos = parts(v, pid)
    p, n = (-32 * s, 32 * (s + 0.25)) if name == "cosface" else (-128 * np.maximum(1.25 - s, 0) * (s - 0.75), 128 * np.maximum(s + 0.25, 0) * (s - 0.25))
    there = []
    for i in range(len(v)):
        a, b = p[i][pos[i] & (np.arange(len(v)) != i)], n[i][~pos[i]]
        there.append(np.logaddexp(0, np.logaddexp.reduce(a) + np.logaddexp.reduce(b)) if len(a) and len(b) else 0.0)
    assert values(getattr(M, name)(df), "loss")[:, 0] == pytest.approx(np.array(there), abs=1e-8)


def test_tiles_are_small():
    """A tile's matrices are a few MB: eight of 2048 rows a side took some 270 MB of each worker."""
    from pathline.operators import distance

    assert all(len(range(10**6)[t]) ** 2 * 8 <= 4 << 20 for t in distance.tiles(10**6))
