"""Hidden states and linear dynamics against plain NumPy over the same data."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.operators import dynamics, hidden_states as hs
from spindrift.operators.sequences import sequences


def long_rows(spark, data):
    """data: {trial: frames x regions}."""
    rows = [(1, t, i, f"r{j}", None if np.isnan(v) else float(v)) for t, x in data.items() for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "mouse int, trial int, frame int, roi string, value double")


def chained(kind, seed=0, trials=6, frames=120):
    rng = np.random.default_rng(seed)
    level = np.array([[0.5, 4.0, 1.0], [5.0, 0.6, 2.0]]) if kind == "poisson" else np.array([[0.1, 0.8, 0.3], [0.85, 0.2, 0.6]])
    data, states = {}, {}
    for t in range(trials):
        n = frames + 7 * t
        s = np.cumsum(rng.random(n) < 0.05) % 2
        data[t] = rng.poisson(level[s]).astype(float) if kind == "poisson" else (rng.random((n, 3)) < level[s]).astype(float)
        states[t] = s
    return data, states, level


def enumerated(model, x):
    """Posteriors and log likelihood by going through all paths."""
    k = len(model["start"])
    e = hs._log_emission(model["kind"], x, model["level"])
    total, post = 0.0, np.zeros((len(x), k))
    for path in itertools.product(range(k), repeat=len(x)):
        p = model["start"][path[0]] * np.exp(e[0, path[0]])
        for t in range(1, len(x)):
            p *= model["move"][path[t - 1], path[t]] * np.exp(e[t, path[t]])
        total += p
        for t, s in enumerate(path):
            post[t, s] += p
    return post / total, np.log(total)


@pytest.mark.parametrize("kind", ["poisson", "bernoulli"])
def test_smoothing_equals_all_paths(kind):
    rng = np.random.default_rng(3)
    model = {"kind": kind, "start": np.array([0.3, 0.7]), "move": np.array([[0.8, 0.2], [0.4, 0.6]]), "level": rng.random((2, 3)) * 0.8 + 0.1}
    xs = [rng.integers(0, 2, (n, 3)).astype(float) for n in (1, 4, 7)]
    xs[2][3, 1] = np.nan
    post, _, ll = hs.smoothed([hs._log_emission(kind, x, model["level"]) for x in xs], model["start"], model["move"])
    want = [enumerated(model, x) for x in xs]
    for p, (w, _) in zip(post, want):
        np.testing.assert_allclose(p, w, rtol=1e-9)
    np.testing.assert_allclose(ll, sum(w for _, w in want))


@pytest.mark.parametrize("kind", ["poisson", "bernoulli"])
def test_fit_recovers_states_of_many_regions(spark, kind):
    data, states, level = chained(kind)
    data[0][5] = np.nan
    seqs, names = sequences(long_rows(spark, data), ["mouse", "trial"])
    assert names == ["r0", "r1", "r2"]
    model = hs.fit(seqs, 3, 2, kind, rounds=15)
    assert (np.diff(model["log_likelihood"]) > -1e-6).all() and model["frames"] == sum(map(len, data.values()))
    by = np.argsort(level.mean(axis=1))
    assert np.abs(model["level"] - level[by]).max() < 0.15 * level.max()
    got = {(r["trial"], r["frame"]): r["state"] for r in hs.paths(seqs, ["mouse", "trial"], model).collect()}
    truth = {(t, i): list(by).index(s) for t, x in states.items() for i, s in enumerate(x)}
    assert np.mean([got[k] == v for k, v in truth.items()]) > 0.9
    post = hs.posteriors(seqs, ["mouse", "trial"], model).collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in post) and len(post) == len(truth)
    for method in ("empirical", "analytical"):
        rates = {(r["trial"], r["state"], r["roi"]): r["rate"] for r in hs.emissions(seqs, ["mouse", "trial"], names, model, 0.5, method).collect()}
        g = {t: np.eye(2)[[got[t, i] for i in range(len(x))]] if method == "empirical" else np.array([r["p"] for r in sorted(post, key=lambda r: r["frame"]) if r["trial"] == t]) for t, x in data.items()}
        for (t, s, r), rate in rates.items():
            j, ok = names.index(r), np.isfinite(data[t][:, names.index(r)])
            w = g[t][ok, s]
            p = (w @ data[t][ok, j]) / w.sum() if w.sum() > 1e-12 else 0.0
            want = -np.log1p(-p) if (kind, method) == ("bernoulli", "analytical") else p
            np.testing.assert_allclose(rate, want / 0.5, atol=1e-9)


def test_priors_and_errors(spark):
    data, _, _ = chained("poisson", trials=2, frames=40)
    seqs, _ = sequences(long_rows(spark, data), ["mouse", "trial"])
    held = hs.fit(seqs, 3, 2, rounds=6, move_prior=500.0)
    assert np.abs(held["move"] - 0.5).max() < 0.1
    with pytest.raises(ValueError):
        hs.fit(seqs, 3, 2, kind="gamma")
    empty, names = sequences(long_rows(spark, data).limit(0), ["mouse", "trial"])
    assert names == [] and empty.count() == 0


def test_limits_of_shuffled_posteriors_equal_brute_force(spark):
    data, _, _ = chained("poisson", trials=5, frames=20)
    seqs, _ = sequences(long_rows(spark, data), ["mouse", "trial"])
    model = hs.fit(seqs, 3, 2, rounds=4)
    got = {r["state"]: r["limit"] for r in hs.posterior_limits(seqs, ["mouse"], "trial", model, 90, shuffles=3, seed=5).collect()}

    def h(*parts):
        x = 42
        for p in parts:
            x = xxhash.xxh64(p.to_bytes(8, "little", signed=True), seed=x % 2**64).intdigest()
        return x - 2**64 if x >= 2**63 else x

    of = {t: r for t, r in ((r["trial"], r["h"]) for r in seqs.select("trial", F.xxhash64("trial").alias("h")).collect())}
    places = sorted(data, key=lambda t: of[t])
    values = [[], []]
    for s in range(3):
        made = {t: np.full(data[t].shape, np.nan) for t in data}
        for j in range(3):
            drawn = sorted(data, key=lambda t: (h(5, s, j, of[t]), of[t]))
            for to, source in zip(places, drawn):
                n = min(len(data[to]), len(data[source]))
                made[to][:n, j] = data[source][:n, j]
        for x in made.values():
            p = hs._posteriors(model, [x])[0]
            for k in range(2):
                values[k] += list(np.round(p[:, k], 6))
    for k in range(2):
        np.testing.assert_allclose(got[k], np.percentile(values[k], 90), atol=2e-6)


# ---------------------------------------------------------------- linear dynamics


def system(seed=1, sessions=5, frames=150):
    rng = np.random.default_rng(seed)
    turn = 0.97 * np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    load, offset = rng.normal(size=(8, 2)), rng.normal(size=8)
    data = {}
    for s in range(sessions):
        x, out = rng.normal(size=2), []
        for _ in range(frames + s):
            x = turn @ x + 0.3 * rng.normal(size=2)
            out.append(load @ x + offset + 0.4 * rng.normal(size=8))
        data[s] = np.array(out)
    return turn, load, offset, data


def test_filter_equals_the_dense_gaussian():
    rng = np.random.default_rng(0)
    model = {"move": np.array([[0.8, 0.1], [0, 0.7]]), "noise": np.diag([0.3, 0.2]), "load": rng.normal(size=(3, 2)), "offset": rng.normal(size=3), "spread": np.array([0.5, 0.2, 0.3]), "mean": np.array([0.1, -0.2]), "cov": np.diag([1.0, 0.5])}
    n = 6
    mean, cov = [model["mean"]], np.zeros((n, n, 2, 2))
    cov[0, 0] = model["cov"]
    for t in range(1, n):
        mean.append(model["move"] @ mean[-1])
        for s in range(t):
            cov[t, s] = model["move"] @ cov[t - 1, s]
            cov[s, t] = cov[t, s].T
        cov[t, t] = model["move"] @ cov[t - 1, t - 1] @ model["move"].T + model["noise"]
    latent = cov.transpose(0, 2, 1, 3).reshape(2 * n, 2 * n)
    c = np.kron(np.eye(n), model["load"])
    mu = c @ np.concatenate(mean) + np.tile(model["offset"], n)
    s = c @ latent @ c.T + np.kron(np.eye(n), np.diag(model["spread"]))
    y = rng.normal(size=3 * n)
    m, v, cross, ll = dynamics.smooth(model, y.reshape(n, 3))
    e = y - mu
    np.testing.assert_allclose(ll, -0.5 * (len(y) * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e)))
    k = latent @ c.T @ np.linalg.inv(s)
    np.testing.assert_allclose(m.ravel(), np.concatenate(mean) + k @ e)
    post = (latent - k @ c @ latent).reshape(n, 2, n, 2)
    for t in range(n):
        np.testing.assert_allclose(v[t], post[t, :, t], atol=1e-10)
        if t:
            np.testing.assert_allclose(cross[t], post[t, :, t - 1], atol=1e-10)


def test_fit_recovers_the_system_and_never_falls(spark):
    turn, load, offset, data = system()
    data[0][10, 3] = np.nan
    seqs, names = sequences(long_rows(spark, data), ["mouse", "trial"])
    model = dynamics.fit(seqs, 8, 2, rounds=25)
    ll = np.array(model["log_likelihood"])
    assert (np.diff(ll) > -1e-6 * np.abs(ll[:-1])).all()
    got, want = np.sort_complex(np.linalg.eigvals(model["move"])), np.sort_complex(np.linalg.eigvals(turn))
    assert np.abs(got - want).max() < 0.06
    q = np.linalg.qr(load)[0]
    assert np.linalg.norm(model["load"] - q @ (q.T @ model["load"])) < 0.1 * np.linalg.norm(model["load"])
    assert np.abs(model["spread"] - 0.16).max() < 0.06
    lat = dynamics.latents(seqs, ["mouse", "trial"], model).collect()
    assert len(lat) == 2 * sum(map(len, data.values()))
    with pytest.raises(ValueError):
        dynamics.fit(seqs.limit(0), 8, 2)
