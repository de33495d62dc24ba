"""Autoregressive models of traces: Yule-Walker of any order as column expressions, ARMA by exact maximum likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def autocovariances(df: DataFrame, keys: list[str], lags: int, value: str = "value", order: str = "frame", adjusted: bool = True) -> DataFrame:
    """(keys, n, c): autocovariances at lags 0 to ``lags`` of the centred trace, as an array.

    Products at lag k are divided by n - k (``adjusted``) or by n. Missing values take no part in sums or in n. A
    trace of ``lags`` samples or fewer has null at the lags that it doesn't reach.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.select(*keys, order, (F.col(value) - F.avg(value).over(Window.partitionBy(*keys))).alias("_x"))
    x = x.select(*keys, "_x", *(F.lag("_x", k).over(w).alias(f"_{k}") for k in range(1, lags + 1)))
    sums = x.groupBy(*keys).agg(F.count("_x").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("_s0"), *(F.sum(F.col("_x") * F.col(f"_{k}")).alias(f"_s{k}") for k in range(1, lags + 1)))
    left = lambda k: F.greatest(F.col("n") - k, F.lit(0)) if adjusted else F.col("n")
    return sums.select(*keys, "n", F.array(*(F.col(f"_s{k}") / F.nullif(left(k), F.lit(0)) for k in range(lags + 1))).alias("c"))


def levinson(c: str, order: int) -> Column:
    """struct(a, e): coefficients of the order from autocovariances ``c`` and the variance left, by the Levinson-Durbin recursion.

    Each step finds the next partial correlation from what the last order leaves and folds it into the coefficients; null
    where the variance is 0 or a covariance is missing.
    """
    k = f"(({c}[i] - aggregate(zip_with(s.a, reverse(slice({c}, 2, i - 1)), (x, y) -> x * y), 0D, (t, z) -> t + z)) / nullif(s.e, 0D))"
    step = f"transform(array({k}), k -> named_struct('a', concat(zip_with(s.a, reverse(s.a), (x, y) -> x - k * y), array(k)), 'e', s.e * (1 - k * k)))[0]"
    return F.expr(f"aggregate(sequence(1, {order}), named_struct('a', cast(array() as array<double>), 'e', {c}[0]), (s, i) -> {step})")


def ar(df: DataFrame, keys: list[str], order: int, value: str = "value", time: str = "frame", adjusted: bool = True) -> DataFrame:
    """(keys, ar1 .. arp, sigma): Yule-Walker coefficients and the standard deviation of what they leave."""
    if order < 1:
        raise ValueError("the order must be 1 or more")
    found = autocovariances(df, keys, order, value, time, adjusted).select(*keys, levinson("c", order).alias("m"))
    return found.select(*keys, *(F.col("m.a")[i].alias(f"ar{i + 1}") for i in range(order)), F.when(F.col("m.e") >= 0, F.sqrt("m.e")).alias("sigma"))


# ---------------------------------------------------------------- ARMA


def stationary(u: np.ndarray) -> np.ndarray:
    """Rows of free parameters as coefficients of a stationary model: partial correlations in (-1, 1), folded order by order."""
    r = u / np.sqrt(1 + u**2)
    a = np.zeros_like(r)
    for i in range(r.shape[1]):
        a[:, :i] = a[:, :i] - r[:, i : i + 1] * a[:, :i][:, ::-1]
        a[:, i] = r[:, i]
    return a


def free(a: np.ndarray) -> np.ndarray:
    """The inverse of ``stationary``; models outside are drawn in."""
    a, out = a.copy(), np.zeros_like(a)
    for i in range(a.shape[1] - 1, -1, -1):
        k = np.clip(a[:, i], -0.97, 0.97)
        out[:, i] = k / np.sqrt(1 - k**2)
        b = a[:, :i]
        a[:, :i] = (b + k[:, None] * b[:, ::-1]) / (1 - k[:, None] ** 2)
    return out


def likelihood(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact Gaussian log likelihood and variance of the shocks, for each row of ``y`` with its row of ``ar`` and ``ma``.

    A Kalman filter over the model in state form, started from its stationary covariance; all rows move in step. NaN is a missing sample.
    """
    n, p, q = len(y), ar.shape[1], ma.shape[1]
    r = max(p, q + 1)
    move, shock = np.zeros((n, r, r)), np.zeros((n, r))
    move[:, :p, 0] = ar
    move[:, np.arange(r - 1), np.arange(1, r)] = 1
    shock[:, 0], shock[:, 1 : q + 1] = 1, ma
    noise = shock[:, :, None] * shock[:, None, :]
    both = np.einsum("nij,nkl->nikjl", move, move).reshape(n, r * r, r * r)
    cov = np.linalg.solve(np.eye(r * r) - both, noise.reshape(n, r * r, 1)).reshape(n, r, r)
    # rows last, so that each step is a few sums over all of them
    first = np.ascontiguousarray(move[:, :, 0].T)
    cov, noise, samples = np.ascontiguousarray(cov.transpose(1, 2, 0)), np.ascontiguousarray(noise.transpose(1, 2, 0)), np.ascontiguousarray(y.T)
    state, squares, logs, seen = np.zeros((r, n)), np.zeros(n), np.zeros(n), np.zeros(n)

    def moved(m: np.ndarray) -> np.ndarray:
        """The model's step on the first axis: its first column times the first entry, and the next entry."""
        out = first.reshape(r, *(1,) * (m.ndim - 2), n) * m[:1]
        out[:-1] += m[1:]
        return out

    for t in range(y.shape[1]):
        there = np.isfinite(samples[t])
        f = np.where(there, np.maximum(cov[0, 0], 1e-300), 1.0)
        v = np.where(there, samples[t] - state[0], 0.0)
        squares += v * v / f
        logs += np.log(f)
        seen += there
        gain = np.where(there, cov[:, 0], 0.0)
        state = moved(state + gain * (v / f))
        cov = moved(moved(cov - gain[:, None] * gain[None] / f).transpose(1, 0, 2)).transpose(1, 0, 2) + noise
    sigma2 = np.maximum(squares / np.maximum(seen, 1), 1e-300)
    return -0.5 * (seen * (np.log(2 * np.pi * sigma2) + 1) + logs), sigma2


def fit_arma(y: np.ndarray, p: int, q: int, rounds: int = 60, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ar, ma, sigma2, log likelihood) of each row, by quasi-Newton steps on free parameters; all rows at once, at most ``rounds`` steps."""
    n, k = len(y), p + q
    seen = np.maximum(np.isfinite(y).sum(axis=1), 1)

    def loss(x: np.ndarray) -> np.ndarray:
        """-log likelihood per sample for x of shape (n, m, k)."""
        m = x.shape[1]
        flat = x.reshape(n * m, k)
        got = likelihood(np.repeat(y, m, axis=0), stationary(flat[:, :p]), -stationary(flat[:, p:]))[0]
        return -(got.reshape(n, m) / seen[:, None])

    filled = np.where(np.isfinite(y), y, 0.0)
    x = np.zeros((n, k))
    if p:  # start from the Yule-Walker model
        c = np.stack([(filled[:, j:] * filled[:, : filled.shape[1] - j]).sum(axis=1) for j in range(p + 1)], axis=1)
        at = np.abs(np.subtract.outer(np.arange(p), np.arange(p)))
        x[:, :p] = free(np.linalg.solve(c[:, at] + 1e-9 * np.eye(p) * (1 + c[:, :1, None]), c[:, 1:, None])[:, :, 0])
    steps = np.concatenate([np.eye(k), -np.eye(k)]) * 1e-5
    sizes = 0.5 ** np.arange(8)

    def slope(x: np.ndarray) -> np.ndarray:
        f = loss(x[:, None, :] + steps[None])
        return (f[:, :k] - f[:, k:]) / 2e-5

    if k:
        now, g = loss(x[:, None, :])[:, 0], slope(x)
        inverse = np.tile(np.eye(k), (n, 1, 1))
        for _ in range(rounds):
            d = -np.einsum("nij,nj->ni", inverse, g)
            uphill = (d * g).sum(axis=1) >= 0
            d[uphill], inverse[uphill] = -g[uphill], np.eye(k)
            d *= np.minimum(1, 2 / np.maximum(np.abs(d).max(axis=1, keepdims=True), 1e-12))
            tried = loss(x[:, None, :] + sizes[None, :, None] * d[:, None, :])
            best = tried.argmin(axis=1)
            gain = now - tried[np.arange(n), best]
            ok = gain > 0
            s = np.where(ok[:, None], sizes[best][:, None] * d, 0.0)
            x, now = x + s, np.where(ok, tried[np.arange(n), best], now)
            new = slope(x)
            z = new - g
            g = new
            sz = (s * z).sum(axis=1)
            use = sz > 1e-14
            rho = np.where(use, 1 / np.where(use, sz, 1), 0.0)[:, None, None]
            turn = np.eye(k) - rho * s[:, :, None] * z[:, None, :]
            inverse = turn @ inverse @ turn.transpose(0, 2, 1) + rho * s[:, :, None] * s[:, None, :]
            if (np.abs(g).max(axis=1) < tolerance).all() or not (gain > 1e-12).any():
                break
    ar, ma = stationary(x[:, :p]), -stationary(x[:, p:])
    found, sigma2 = likelihood(y, ar, ma)
    return ar, ma, sigma2, found


def arma(df: DataFrame, keys: list[str], p: int, q: int, d: int = 0, value: str = "value", order: str = "frame", rounds: int = 60) -> DataFrame:
    """(keys, ar1 .., ma1 .., sigma2, log_likelihood, n): ARMA coefficients of each trace by exact maximum likelihood, without a mean.

    Traces are differenced ``d`` times first; missing samples stay missing. Models are stationary and invertible. Traces are
    sorted arrays, one row each, and many are fitted side by side; a trace of no finite sample, or all 0, has null coefficients.
    """
    if p < 0 or q < 0 or p + q < 1 or d < 0:
        raise ValueError("p or q must be positive, d not negative")
    wide = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("_y"))
    names = [*(f"ar{i + 1}" for i in range(p)), *(f"ma{i + 1}" for i in range(q)), "sigma2", "log_likelihood"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            traces = [np.diff(np.array(y, float), n=d) if len(y) > d else np.zeros(0) for y in pdf["_y"]]
            out = np.full((len(traces), p + q + 2), np.nan)
            count = np.array([int(np.isfinite(t).sum()) for t in traces], int)
            live = np.array([i for i, t in enumerate(traces) if np.nansum(np.abs(t)) > 0], int)
            live = live[np.argsort([len(traces[i]) for i in live], kind="stable")]
            for at in range(0, len(live), 64):  # like lengths together
                some = live[at : at + 64]
                y = np.full((len(some), max(len(traces[i]) for i in some)), np.nan)
                for j, i in enumerate(some):
                    y[j, : len(traces[i])] = traces[i]
                a, m, s, f = fit_arma(y, p, q, rounds)
                out[some] = np.hstack([a, m, s[:, None], f[:, None]])
            made = pdf[keys].copy()
            for j, name in enumerate(names):
                made[name] = out[:, j]
            made["n"] = count
            yield made

    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), *(f"{c} double" for c in names), "n long"])
    found = wide.mapInPandas(run, kinds)
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in names})
