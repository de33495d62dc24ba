"""Hidden Markov models of many regions at once, with independent Poisson or Bernoulli emissions."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import per_frame, sampled, summed


def _log_emission(kind: str, x: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Log likelihood of each frame in each state; a missing value says nothing. Without the factorials, which no state changes."""
    known = np.isfinite(x)
    y = np.where(known, x, 0.0)
    if kind == "poisson":
        return y @ np.log(level).T - known @ level.T
    up = y > 0
    return up.astype(float) @ np.log(level).T + (known & ~up).astype(float) @ np.log1p(-level).T


def smoothed(log_e: list[np.ndarray], start: np.ndarray, move: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Posteriors of the states in each sequence, the summed posteriors of steps, and the log likelihood; sequences move in step."""
    lengths = np.array([len(e) for e in log_e])
    n, longest, k = len(log_e), max(lengths, default=0), len(start)
    if not longest:
        return [np.zeros((0, k)) for _ in log_e], np.zeros((k, k)), 0.0
    e = np.zeros((n, longest, k))
    for i, x in enumerate(log_e):
        e[i, : len(x)] = x
    top = e.max(axis=2, keepdims=True)
    e = np.exp(e - top)
    live = np.arange(longest)[None, :] < lengths[:, None]
    alpha, beta, scale = np.zeros((n, longest, k)), np.ones((n, longest, k)), np.ones((n, longest))
    for t in range(longest):
        a = (start[None] if t == 0 else alpha[:, t - 1] @ move) * e[:, t]
        scale[:, t] = np.where(live[:, t], a.sum(axis=1), 1.0)
        alpha[:, t] = np.where(live[:, t, None], a / scale[:, t, None], 0.0)
    for t in range(longest - 2, -1, -1):
        b = (e[:, t + 1] * beta[:, t + 1]) @ move.T / scale[:, t + 1, None]
        beta[:, t] = np.where(live[:, t + 1, None], b, 1.0)
    ahead = np.where(live[:, 1:, None], e[:, 1:] * beta[:, 1:] / scale[:, 1:, None], 0.0)
    steps = move * np.einsum("ntk,ntl->kl", alpha[:, :-1], ahead)
    gamma = alpha * beta
    return [gamma[i, :m] for i, m in enumerate(lengths)], steps, float(np.log(scale).sum() + (top[:, :, 0] * live).sum())


def _expected(model: dict, xs: list[np.ndarray]) -> np.ndarray:
    """first, steps, weights, sums and log likelihood of some sequences, end to end."""
    k, d = model["level"].shape
    first, weight, known, sums, steps, ll = np.zeros(k), np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), np.zeros((k, k)), 0.0
    by = sorted(range(len(xs)), key=lambda i: len(xs[i]))
    for at in range(0, len(by), 32):
        some = [xs[i] for i in by[at : at + 32]]
        gammas, s, one = smoothed([_log_emission(model["kind"], x, model["level"]) for x in some], model["start"], model["move"])
        steps, ll = steps + s, ll + one
        for x, g in zip(some, gammas, strict=True):
            if len(x):
                there = np.isfinite(x)
                y = np.where(there, x, 0.0) if model["kind"] == "poisson" else (there & (x > 0)).astype(float)
                first, weight, known, sums = first + g[0], weight + g.sum(axis=0), known + g.T @ there, sums + g.T @ y
    return np.concatenate([first, steps.ravel(), weight, known.ravel(), sums.ravel(), [ll, sum(len(x) for x in xs)]])


def _clusters(frames: np.ndarray, states: int, rounds: int = 20) -> np.ndarray:
    """Centres of the sampled frames by Lloyd's rounds, started from frames spread over their total."""
    order = np.argsort(frames.sum(axis=1), kind="stable")
    centres = frames[order[((np.arange(states) + 0.5) / states * len(frames)).astype(int)]].astype(float)
    for _ in range(rounds):
        to = ((frames[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(states):
            if (to == c).any():
                centres[c] = frames[to == c].mean(axis=0)
    return centres


def fit(seqs: DataFrame, regions: int, states: int, kind: str = "poisson", rounds: int = 100, tolerance: float = 1e-5, start_prior: float = 1.0, move_prior: float = 1.0, floor: float = 1e-4) -> dict:
    """Model of all ``sequences`` by expectation maximisation: start, move, level (states by regions), log_likelihood by round.

    Levels start from clusters of a bounded sample of frames. Priors are Dirichlet, as counts from 1 on; levels stay over
    ``floor`` (and under 1 - floor for Bernoulli). Rounds end when the gain falls below ``tolerance`` of the first log
    likelihood. States are numbered by their mean level. The E step runs in tasks, many sequences side by side; only sums come back.
    """
    if kind not in ("poisson", "bernoulli"):
        raise ValueError("kind must be poisson or bernoulli")
    high = np.inf if kind == "poisson" else 1 - floor
    frames = sampled(seqs, regions)
    if not len(frames):
        raise ValueError("no complete frame to start from")
    level = np.clip(_clusters(frames if kind == "poisson" else (frames > 0).astype(float), states) + 0.01 * np.arange(states)[:, None], floor, high)
    stay = 0.9 if states > 1 else 1.0
    move = np.full((states, states), (1 - stay) / max(1, states - 1)) + np.eye(states) * (stay - (1 - stay) / max(1, states - 1))
    model = {"start": np.full(states, 1 / states), "move": move, "level": level, "kind": kind}
    history: list[float] = []
    for _ in range(rounds):
        got = summed(seqs, partial(_expected, model), regions)
        cut = np.cumsum([states, states**2, states, states * regions, states * regions, 1])
        first, steps, _, known, sums, ll, n = np.split(got, cut)
        history.append(float(ll[0]))
        if len(history) > 1 and abs(history[-1] - history[-2]) <= tolerance * abs(history[0]):
            break
        first = np.maximum(first + start_prior - 1, 0)
        steps = np.maximum(steps.reshape(states, states) + move_prior - 1, 0)
        rows = steps.sum(axis=1, keepdims=True)
        move = np.where(rows > 0, steps / np.maximum(rows, 1e-300), model["move"])
        known, sums = known.reshape(states, regions), sums.reshape(states, regions)
        model |= {"start": first / first.sum(), "move": move, "level": np.clip(sums / np.maximum(known, 1e-12), floor, high)}
    by = np.argsort(model["level"].mean(axis=1), kind="stable")
    return model | {"start": model["start"][by], "move": model["move"][np.ix_(by, by)], "level": model["level"][by], "log_likelihood": history, "frames": int(n[0])}


def _posteriors(model: dict, xs: list[np.ndarray]) -> list[np.ndarray]:
    return [smoothed([_log_emission(model["kind"], x, model["level"])], model["start"], model["move"])[0][0] for x in xs]


def posteriors(seqs: DataFrame, keys: list[str], model: dict, order: str = "frame") -> DataFrame:
    """(keys, frame, p): the probability of each state in each frame, given the whole sequence."""
    return per_frame(seqs, keys, partial(_posteriors, model), model["level"].shape[1], "p", order)


def _path(model: dict, x: np.ndarray) -> np.ndarray:
    e, step = _log_emission(model["kind"], x, model["level"]), np.log(model["move"] + 1e-300)
    if not len(e):
        return np.zeros(0, int)
    score, back = np.log(model["start"] + 1e-300) + e[0], np.zeros(e.shape, int)
    for t in range(1, len(e)):
        moved = score[:, None] + step
        back[t] = moved.argmax(axis=0)
        score = moved.max(axis=0) + e[t]
    states = np.empty(len(e), int)
    states[-1] = score.argmax()
    for t in range(len(e) - 1, 0, -1):
        states[t - 1] = back[t][states[t]]
    return states


def paths(seqs: DataFrame, keys: list[str], model: dict, order: str = "frame") -> DataFrame:
    """(keys, frame, state): the likeliest path (Viterbi)."""
    found = per_frame(seqs, keys, lambda xs: [_path(model, x)[:, None].astype(float) for x in xs], model["level"].shape[1], "s", order)
    return found.select(*keys, order, F.col("s")[0].cast("int").alias("state"))


def emissions(seqs: DataFrame, keys: list[str], names: list, model: dict, dt: float = 0.125, method: str = "empirical") -> DataFrame:
    """(keys, state, roi, rate): events per second of each region in each state, by sequence.

    ``empirical``: the mean over frames of the likeliest path in that state. ``analytical``: the mean weighted by posteriors; for a
    Bernoulli model -log(1 - p), the rate at which that share of frames has an event. A state that a sequence never visits has rate 0.
    """
    if method not in ("empirical", "analytical"):
        raise ValueError("method must be empirical or analytical")
    states, regions = model["level"].shape

    def make(xs: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for x in xs:
            g = np.eye(states)[_path(model, x)] if method == "empirical" else _posteriors(model, [x])[0]
            there = np.isfinite(x)
            y = np.where(there, x, 0.0) if model["kind"] == "poisson" else (there & (x > 0)).astype(float)
            seen = g.T @ there
            p = np.where(seen > 1e-12, (g.T @ y) / np.maximum(seen, 1e-12), 0.0)
            if method == "analytical" and model["kind"] == "bernoulli":
                p = -np.log1p(-np.minimum(p, 1 - 1e-12))
            out.append(p.ravel()[None, :] / dt)
        return out

    rates = per_frame(seqs.withColumn("frames", F.slice("frames", 1, 1)), keys, make, regions, "rates", "_f").select(*keys, F.posexplode("rates").alias("_i", "rate"))
    roi = F.lit(names)[F.col("_i") % regions]
    return rates.select(*keys, F.floor(F.col("_i") / regions).cast("int").alias("state"), roi.alias("roi"), "rate")


def shuffled(seqs: DataFrame, group: list[str], trial: str, regions: int, shuffles: int, seed: int = 0) -> DataFrame:
    """(shuffle, group, trial, frames, x): each region's trials dealt anew, apart from the others', so that regions no longer go together.

    A region's trials of a group are put in order of a hash of (seed, shuffle, region, trial) and take the places of the trials in their own order. Sequences
    keep their own length: a region's values are cut, or filled up with missing ones.
    """
    rows = seqs.select(*group, F.xxhash64(trial).alias("_t"), trial, "frames", F.size("frames").alias("_n"), "x")
    parts = rows.select(*group, "_t", "x", "_n", F.explode(F.sequence(F.lit(0), F.lit(regions - 1))).alias("_r"))
    own = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.col("x")[(i * regions + F.col("_r")).cast("int")])
    parts = parts.where("_n > 0").select(*group, "_t", "_r", own.alias("v")).withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    w = Window.partitionBy(*group, "shuffle", "_r")
    drawn = F.xxhash64(F.lit(seed).cast("long"), F.col("shuffle").cast("long"), F.col("_r").cast("long"), "_t")
    dealt = parts.withColumn("_to", F.row_number().over(w.orderBy(drawn, "_t"))).select(*group, "shuffle", "_r", "_to", "v")
    whole = dealt.groupBy(*group, "shuffle", "_to").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "v"))), lambda s: s["v"]).alias("vs"))
    places = rows.where("_n > 0").withColumn("_to", F.row_number().over(Window.partitionBy(*group).orderBy("_t"))).select(*group, trial, "frames", "_n", "_to")
    met = places.join(whole, [*group, "_to"])
    x = F.flatten(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.transform("vs", lambda v: F.coalesce(F.get(v, i), F.lit(float("nan"))))))
    return met.select("shuffle", *group, trial, "frames", x.alias("x"))


def posterior_limits(seqs: DataFrame, group: list[str], trial: str, model: dict, percentile: float = 95, shuffles: int = 10, seed: int = 0) -> DataFrame:
    """(state, limit): the percentile of each state's posterior over all frames of shuffled trials; all shuffles are one plan.

    Probabilities are rounded to six places and counted first, so a state's percentile is taken over a million values at most.
    """
    dealt = shuffled(seqs, group, trial, model["level"].shape[1], shuffles, seed)
    found = posteriors(dealt, ["shuffle", *group, trial], model).select(F.posexplode("p").alias("state", "p"))
    counted = found.groupBy("state", F.round("p", 6).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("state").agg(F.percentile("p", F.lit(percentile / 100), F.col("n")).alias("limit"))
