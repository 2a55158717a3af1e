import itertools

import numpy as np
import pytest

from cloudweave.functions import catch22, kernels, loops


def rips(points, collapsed):
    """Distances on both clouds, those inside the second set to 0."""
    both = np.concatenate([points, collapsed])
    d = kernels.distances(both, both)
    d[len(points) :, len(points) :] = 0
    return d


def brute_bars(d, dim):
    """Bars of a Rips filtration by full reduction modulo 2; zero-length and endless ones are left out."""
    n = len(d)
    simplices = [(s, max((d[a, b] for a, b in itertools.combinations(s, 2)), default=0.0)) for k in range(1, dim + 3) for s in itertools.combinations(range(n), k)]
    simplices.sort(key=lambda x: (x[1], len(x[0])))
    place = {s: i for i, (s, _) in enumerate(simplices)}
    low, bars = {}, []
    for i, (s, v) in enumerate(simplices):
        column = {place[f] for f in itertools.combinations(s, len(s) - 1)} if len(s) > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            j = max(column)
            low[j] = column
            if len(simplices[j][0]) == dim + 1 and v > simplices[j][1] + 1e-12:
                bars.append((simplices[j][1], v))
    return sorted(bars)


@pytest.mark.parametrize("seed", range(6))
def test_cross_barcodes_equal_full_reduction(seed):
    rng = np.random.default_rng(seed)
    p, q = rng.normal(size=(rng.integers(4, 8), 2 + seed % 2)), rng.normal(size=(rng.integers(2, 6), 2 + seed % 2))
    d = rips(p, q)
    h0 = kernels.cross_h0(kernels.kept_tree(p), p, q)
    assert np.allclose(sorted(h0), [b for _, b in brute_bars(d, 0)])
    h1 = sorted(map(tuple, loops.cross_h1(loops.Kept(p), q)))
    want = brute_bars(d, 1)
    assert len(h1) == len(want) and np.allclose(h1, want)


def test_h0_properties():
    rng = np.random.default_rng(1)
    p, q = rng.normal(size=(20, 3)), rng.normal(size=(30, 3))
    bars = kernels.cross_h0(kernels.kept_tree(p), p, q)
    assert len(bars) <= 20
    assert len(kernels.cross_h0(kernels.kept_tree(p), p, np.concatenate([p, q]))) == 0
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    moved = kernels.cross_h0(kernels.kept_tree(p @ turn + 5), p @ turn + 5, q @ turn + 5)
    assert np.allclose(sorted(moved), sorted(bars))
    assert np.allclose(sorted(kernels.cross_h0(kernels.kept_tree(3 * p), 3 * p, 3 * q)), sorted(3 * bars))
    assert len(kernels.cross_h0(kernels.kept_tree(p), p, q[:0])) == 0


def test_farthest_points_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(40, 3))
    chosen = [7]
    while len(chosen) < 12:
        chosen.append(int(np.argmax([min(((p[i] - p[c]) ** 2).sum() for c in chosen) for i in range(40)])))
    assert kernels.farthest_points(p, 12, 7).tolist() == chosen
    assert kernels.farthest_points(p, 50, 7).tolist() == list(range(40))


def test_kde_tail():
    sample = np.random.default_rng(3).gamma(2, 1, 200)
    tail = kernels.kde_tail(sample, np.array([0.1, 1, 2, 5, 30, -1, np.nan, np.inf]))
    assert (np.diff(tail[:5]) <= 0).all() and (tail >= 0).all() and (tail <= 1).all()
    assert tail[5] == tail[6] == tail[7] == 1
    assert kernels.kde_tail(np.array([2.0, 2.0]), np.array([1.0, 2.0, 3.0])).tolist() == [1.0, 1.0, 0.0]


def test_embedding_parameters_of_a_sine():
    x = np.sin(np.arange(400) * 2 * np.pi / 40)
    tau, m = kernels.embedding_parameters(x, 15, 6)
    assert 5 <= tau <= 15 and 1 <= m <= 4


def test_canonical_features_are_finite():
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=120), np.sin(np.arange(200) / 5), np.ones(50), np.arange(30.0)):
        got = catch22.catch22(x)
        assert got.shape == (22,) and np.isfinite(got).all()
    assert len(catch22.NAMES) == 22
    assert catch22.catch22(np.sin(np.arange(400) * 2 * np.pi / 40))[9] in range(38, 43)  # its period
