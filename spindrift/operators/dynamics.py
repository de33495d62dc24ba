"""Linear dynamical systems: a few latent courses behind many regions, fitted over all sessions."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import per_frame, sampled, summed


def smooth(model: dict, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(means, covariances, covariances with the frame before, log likelihood) of the latent state, by filter and smoother.

    A frame in which a region is missing is not observed. The update works in the few latent dimensions, whatever the number of regions.
    """
    a, q, c, d, r = (model[k] for k in ("move", "noise", "load", "offset", "spread"))
    n, k = len(y), len(a)
    seen = np.isfinite(y).all(axis=1)
    e = np.where(seen[:, None], y - d, 0.0)
    weighted = c / r[:, None]
    j, h, squares = c.T @ weighted, e @ weighted, (e * e / r).sum(axis=1)
    fixed = len(d) * np.log(2 * np.pi) + np.log(r).sum()
    mp, vp, mf, vf, ll = np.empty((n, k)), np.empty((n, k, k)), np.empty((n, k)), np.empty((n, k, k)), 0.0
    for t in range(n):
        mp[t], vp[t] = (model["mean"], model["cov"]) if t == 0 else (a @ mf[t - 1], a @ vf[t - 1] @ a.T + q)
        if not seen[t]:
            mf[t], vf[t] = mp[t], vp[t]
            continue
        gain = np.eye(k) + vp[t] @ j
        v = np.linalg.solve(gain, vp[t])
        vf[t] = (v + v.T) / 2
        g = h[t] - j @ mp[t]
        mf[t] = mp[t] + vf[t] @ g
        ll -= 0.5 * (fixed + np.linalg.slogdet(gain)[1] + squares[t] - 2 * mp[t] @ h[t] + mp[t] @ j @ mp[t] - g @ vf[t] @ g)
    ms, vs, cross = mf.copy(), vf.copy(), np.zeros((n, k, k))
    for t in range(n - 2, -1, -1):
        back = np.linalg.solve(vp[t + 1], a @ vf[t]).T
        ms[t] = mf[t] + back @ (ms[t + 1] - mp[t + 1])
        vs[t] = vf[t] + back @ (vs[t + 1] - vp[t + 1]) @ back.T
        cross[t + 1] = vs[t + 1] @ back.T
    return ms, vs, cross, float(ll)


def _expected(model: dict, ys: list[np.ndarray]) -> np.ndarray:
    """The sums that the next model needs, of some sessions, end to end."""
    k, dims = len(model["move"]), len(model["offset"])
    before, after, across, first, firsts = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k), np.zeros((k, k))
    zz, yz, yy, count = np.zeros((k + 1, k + 1)), np.zeros((dims, k + 1)), np.zeros(dims), np.zeros(4)
    for y in ys:
        if not len(y):
            continue
        m, v, cross, ll = smooth(model, y)
        both = v + m[:, :, None] * m[:, None, :]
        before, after = before + both[:-1].sum(axis=0), after + both[1:].sum(axis=0)
        across = across + cross[1:].sum(axis=0) + m[1:].T @ m[:-1]
        first, firsts = first + m[0], firsts + both[0]
        seen = np.isfinite(y).all(axis=1)
        z, x = np.hstack([m[seen], np.ones((seen.sum(), 1))]), y[seen]
        zz[:k, :k] += v[seen].sum(axis=0)
        zz, yz, yy = zz + z.T @ z, yz + x.T @ z, yy + (x * x).sum(axis=0)
        count += [ll, len(y) - 1, seen.sum(), 1]
    return np.concatenate([count, first, *(x.ravel() for x in (firsts, before, after, across, zz, yz)), yy])


def fit(seqs: DataFrame, regions: int, components: int = 1, rounds: int = 50, tolerance: float = 1e-6) -> dict:
    """Model of all ``sequences`` by expectation maximisation; ``log_likelihood`` has one entry for each round and never falls.

    Latent states move by ``move`` with noise of covariance ``noise``; regions are ``load`` times the state plus ``offset``, with independent
    noise of variance ``spread``. Loads start from the leading directions of a bounded sample of frames. Sessions are smoothed in
    tasks; the sums that come back have regions x components numbers.
    """
    frames = sampled(seqs, regions)
    if len(frames) < 2:
        raise ValueError("too few complete frames to start from")
    offset = frames.mean(axis=0)
    _, s, v = np.linalg.svd(frames - offset, full_matrices=False)
    k = components
    load = np.zeros((regions, k))
    load[:, : len(s[:k])] = (v[:k] * (s[:k, None] / np.sqrt(len(frames)))).T
    left = np.maximum(frames.var(axis=0) - (load**2).sum(axis=1), 0.1 * frames.var(axis=0) + 1e-6)
    model = {"move": 0.9 * np.eye(k), "noise": 0.19 * np.eye(k), "load": load, "offset": offset, "spread": left, "mean": np.zeros(k), "cov": np.eye(k)}
    history: list[float] = []
    for _ in range(rounds):
        got = summed(seqs, partial(_expected, model), regions)
        cut = np.cumsum([4, k, k * k, k * k, k * k, k * k, (k + 1) ** 2, regions * (k + 1)])
        count, first, firsts, before, after, across, zz, yz, yy = np.split(got, cut)
        firsts, before, after, across = (x.reshape(k, k) for x in (firsts, before, after, across))
        zz, yz = zz.reshape(k + 1, k + 1), yz.reshape(regions, k + 1)
        history.append(float(count[0]))
        if len(history) > 1 and history[-1] - history[-2] <= tolerance * abs(history[-2]):
            break
        move = np.linalg.solve(before + 1e-12 * np.eye(k), across.T).T if count[1] else model["move"]
        noise = (after - move @ across.T) / max(count[1], 1) if count[1] else model["noise"]
        both = np.linalg.solve(zz + 1e-12 * np.eye(k + 1), yz.T).T
        mean = first / count[3]
        start = firsts / count[3] - np.outer(mean, mean)
        model = {
            "move": move, "noise": (noise + noise.T) / 2 + 1e-9 * np.eye(k), "load": both[:, :k], "offset": both[:, k], "spread": np.maximum((yy - (both * yz).sum(axis=1)) / max(count[2], 1), 1e-9),
            "mean": mean, "cov": (start + start.T) / 2 + 1e-6 * np.eye(k),
        }
    return model | {"log_likelihood": history}


def latents(seqs: DataFrame, keys: list[str], model: dict, order: str = "frame") -> DataFrame:
    """(keys, frame, component, value): the smoothed mean of each latent course."""
    found = per_frame(seqs, keys, lambda ys: [smooth(model, y)[0] for y in ys], len(model["offset"]), "m", order)
    return found.select(*keys, order, F.posexplode("m").alias("component", "value"))
