"""Autoregression against solved Toeplitz systems and the dense Gaussian likelihood."""

import numpy as np
import pytest

from spindrift.operators import autoregression as ag


def simulated(n, ar, ma, seed, sigma=1.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 200) * sigma
    y = np.zeros(n + 200)
    for t in range(len(y)):
        y[t] = e[t] + sum(a * y[t - i - 1] for i, a in enumerate(ar) if t > i) + sum(m * e[t - i - 1] for i, m in enumerate(ma) if t > i)
    return y[200:]


def frame(spark, traces):
    return spark.createDataFrame([(r, t, None if v is None else float(v)) for r, y in traces.items() for t, v in enumerate(y)], "roi int, frame int, value double")


@pytest.mark.parametrize("adjusted", [True, False])
@pytest.mark.parametrize("order", [1, 3, 10])
def test_any_order_equals_the_toeplitz_system(spark, order, adjusted):
    traces = {r: simulated(300, [0.6, -0.3, 0.2], [], r) for r in range(3)} | {8: np.full(40, 2.0), 9: [1.0]}
    got = {r["roi"]: r for r in ag.ar(frame(spark, traces), ["roi"], order, adjusted=adjusted).collect()}
    for r in range(3):
        x = traces[r] - traces[r].mean()
        c = np.array([(x[k:] * x[: len(x) - k]).sum() / (len(x) - (k if adjusted else 0)) for k in range(order + 1)])
        rho = np.linalg.solve(c[np.abs(np.subtract.outer(range(order), range(order)))], c[1:])
        np.testing.assert_allclose([got[r][f"ar{i + 1}"] for i in range(order)], rho, rtol=1e-8)
        np.testing.assert_allclose(got[r]["sigma"] ** 2, c[0] - c[1:] @ rho, rtol=1e-8)
    assert got[8]["ar1"] is None and got[9]["ar1"] is None
    with pytest.raises(ValueError):
        ag.ar(frame(spark, {1: [1.0]}), ["roi"], 0)


def dense(y, ar, ma):
    """Log likelihood from the covariance of the observed samples, with the variance of shocks that suits it best."""
    n = len(y)
    psi = np.zeros(n + 3000)
    psi[0] = 1
    for i in range(1, len(psi)):
        psi[i] = (ma[i - 1] if i <= len(ma) else 0) + sum(a * psi[i - j - 1] for j, a in enumerate(ar) if i > j)
    cov = np.array([(psi[k:] * psi[: len(psi) - k]).sum() for k in range(n)])
    seen = np.flatnonzero(np.isfinite(y))
    v = cov[np.abs(np.subtract.outer(seen, seen))]
    x = y[seen]
    s2 = x @ np.linalg.solve(v, x) / len(x)
    return -0.5 * (len(x) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1])


@pytest.mark.parametrize(("ar", "ma"), [([0.7], []), ([], [0.5, -0.2]), ([0.5, -0.4], [0.3])])
def test_filter_equals_the_dense_likelihood(ar, ma):
    y = simulated(60, ar, ma, 4)
    gaps = y.copy()
    gaps[[5, 6, 30]] = np.nan
    got, _ = ag.likelihood(np.stack([y, gaps]), np.array([ar, ar]), np.array([ma, ma]))
    np.testing.assert_allclose(got, [dense(y, ar, ma), dense(gaps, ar, ma)], rtol=1e-8)


def test_free_parameters_come_back():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(5, 4))
    np.testing.assert_allclose(ag.free(ag.stationary(u)), u, rtol=1e-6)


def test_arma_recovers_models_and_stands_at_a_top(spark):
    traces = {r: simulated(1500, [0.75], [-0.4], r, 2.0) for r in range(4)}
    traces |= {10: np.zeros(30), 11: [None, None], 12: [3.0]}
    got = {r["roi"]: r for r in ag.arma(frame(spark, traces), ["roi"], 1, 1).collect()}
    for r in range(4):
        assert abs(got[r]["ar1"] - 0.75) < 0.12 and abs(got[r]["ma1"] + 0.4) < 0.15 and abs(got[r]["sigma2"] - 4) < 0.5 and got[r]["n"] == 1500
        here = np.array([got[r]["ar1"], got[r]["ma1"]])
        for d in ([0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01]):
            a, m = here + d
            assert ag.likelihood(traces[r][None], np.array([[a]]), np.array([[m]]))[0][0] < got[r]["log_likelihood"]
    assert got[10]["ar1"] is None and got[11]["ar1"] is None and got[11]["n"] == 0 and got[12]["n"] == 1
    once = ag.arma(frame(spark, {0: np.cumsum(traces[0])}), ["roi"], 1, 1, d=1).first()
    assert abs(once["ar1"] - got[0]["ar1"]) < 0.01
    with pytest.raises(ValueError):
        ag.arma(frame(spark, traces), ["roi"], 0, 0)
