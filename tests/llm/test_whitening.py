import math

import numpy as np
import pytest

from cloudweave.llm import whitening


def plain(rows, count=4):
    """{(id, x): (deviation, whitened up to sign)}, n, shares, of rows (id, vector)."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + (0,) * (dims - len(x))) for i, x in kept]
    fit = sorted({x for _, x in kept})
    n, S = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array(fit, float) - np.array(S) / max(n, 1)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, S, strict=True)), (np.array(x) - np.array(S) / n) @ u / np.sqrt(np.maximum(e, 1e-300))) for i, x in kept]
    return out, n, e / np.trace(c.T @ c / n)


def compared(spark, rows, count=4):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, x string").repartition(3)).collect()
    want, n, shares = plain([r[:2] for r in rows])
    assert len(got) == count * len(want)
    assert {r.n for r in got} == {n} and all(r.identity_error <= 1e-9 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, count + 1))
    for k, mine in by.items():
        assert abs(mine[0].explained / shares[k - 1] - 1) < 1e-9
        a = sorted((str(r.vec_id), r.deviation, abs(r.whitened)) for r in mine)
        b = sorted((str(i), d, abs(z[k - 1])) for i, d, z in want)
        assert [x[:2] for x in a] == [x[:2] for x in b]
        np.testing.assert_allclose([x[2] for x in a], [x[2] for x in b], atol=1e-7)


def test_whitening_of_the_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, 1, "a") for r in table.collect()]
    compared(spark, rows)


def test_whitening_takes_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5]).tolist(), None, "a") for i in range(60)]
    rows += [(0, rows[0][1], 1, "a")] * 40  # copies: in the fit list once
    rows += [(None, rows[1][1], 1, None), (100, None, 1, "a"), (101, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1, "a"), (102, [float("nan")] * 6, 1, "a"), (103, [float("inf")] + [0.0] * 5, 1, "a")]
    rows += [(104, [1.5, 2.0], 1, "a"), (105, [], 1, "a"), (106, [-0.0] * 6, 1, "a")]  # as if they ended in zeros
    compared(spark, rows)


def test_whitening_without_variance(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).count() == 0
    assert make([(1, None)]).count() == 0
    assert make([(1, [])]).count() == 0
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    got = make([(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0])]).collect()  # rank one
    assert {r.component for r in got} == {1} and sorted(round(r.whitened, 9) for r in got) == [-1, 1]
    far = make([(1, [1e18, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 0.0])]).collect()
    assert any(r.deviation is None for r in far)


@pytest.mark.parametrize("spectrum", ["clustered", "equal", "falling", "low"])
def test_eigenpairs_equal_a_dense_solver(spectrum):
    rng = np.random.default_rng(5)
    dims = 90
    e = {"clustered": np.r_[3.0, 2.0, 1.0001, 1.0, np.full(dims - 4, 0.9999)], "equal": np.ones(dims), "falling": 0.8 ** np.arange(dims), "low": np.r_[5.0, 4.0, np.zeros(dims - 2)]}[spectrum]
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    v = q * e @ q.T
    passes = []
    values, axes = whitening.eigenpairs(lambda u: passes.append(1) or v @ u, dims, 4, space=24, kept=10)
    np.testing.assert_allclose(values, np.sort(e)[::-1][:4], atol=1e-12)
    assert np.linalg.norm(v @ axes - axes * values) < 1e-12 * e.max() and np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12
    assert len(passes) < 400


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    v = a @ a.T
    ritz = np.linalg.qr(rng.standard_normal((30, 3)))[0]
    theta = np.array([50.0, 40.0])
    r = rng.standard_normal((30, 2))
    t = whitening.corrections(lambda u: v @ u, np.zeros((30, 0)), ritz, theta, r, steps=60, enough=1e-12)
    p = np.eye(30) - ritz @ ritz.T
    for k in range(2):
        np.testing.assert_allclose(p @ (v - theta[k] * np.eye(30)) @ p @ t[:, k], -p @ r[:, k], atol=1e-6)
