"""Blocks of low rank and filled pixels against plain NumPy."""

import math

import numpy as np
import pytest

from spindrift.operators import movies


def frame(spark, data):
    """data: {movie: frames x height x width}."""
    rows = [(m, t, y, x, None if np.isnan(v) else float(v)) for m, a in data.items() for t, f in enumerate(a) for y, row in enumerate(f) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "movie int, frame int, y int, x int, value double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["frame"], r["y"], r["x"]] = r["value"]
    return out


def synthetic(seed, frames, height, width, rank, noise):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    out = np.zeros((frames, height, width))
    for _ in range(rank):
        cy, cx = rng.uniform(0, height), rng.uniform(0, width)
        out += rng.normal(size=frames)[:, None, None] * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 30)
    return out + noise * rng.normal(size=out.shape)


def test_weights_add_up(spark):
    for height, width, block, overlap in ((23, 17, 8, 3), (8, 8, 8, 4), (5, 30, 8, 2), (9, 16, 8, 0)):
        df = frame(spark, {0: np.ones((1, height, width))})
        got = movies.blocks(df, ["movie"], height, width, block, overlap).groupBy("y", "x").agg({"weight": "sum"}).collect()
        assert len(got) == height * width and all(abs(r[2] - 1) < 1e-12 for r in got)
        size = movies.blocks(df, ["movie"], height, width, block, overlap).groupBy("by", "bx").count().collect()
        assert max(r["count"] for r in size) <= block * block
    with pytest.raises(ValueError):
        movies.blocks(df, ["movie"], 9, 9, 8, 5)


def test_movies_of_low_rank_come_back(spark):
    data = {0: synthetic(1, 40, 20, 26, 3, 0.0), 1: synthetic(2, 40, 20, 26, 2, 0.0)}
    u, v, errors = movies.low_rank(frame(spark, data), ["movie"], 20, 26, 10, 3, chunk=7)
    for m, a in data.items():
        got = dense(movies.recomposed(u.where(f"movie = {m}"), v.where(f"movie = {m}"), ["movie"]), a.shape)
        np.testing.assert_allclose(got, a, atol=1e-6)
    assert max(r["rank"] for r in errors.collect()) <= 3
    few = movies.recomposed(u, v, ["movie"], (5, 8))
    assert {r["frame"] for r in few.select("frame").distinct().collect()} == {5, 6, 7}


def test_noise_goes_and_the_bound_on_the_error_holds(spark):
    clean, noisy = synthetic(3, 120, 16, 16, 2, 0.0), None
    rng = np.random.default_rng(5)
    noisy = clean + 0.1 * rng.normal(size=clean.shape)
    u, v, errors = movies.low_rank(frame(spark, {0: noisy}), ["movie"], 16, 16, 8, 2, noise=0.1)
    got = dense(movies.recomposed(u, v, ["movie"]), clean.shape)
    assert np.sqrt(np.mean((got - clean) ** 2)) < 0.5 * 0.1
    for r in errors.collect():
        ys, xs = r["by"] * 6, r["bx"] * 6
        m = noisy[:, ys : ys + 8, xs : xs + 8].reshape(120, -1)
        s = np.linalg.svd(m, compute_uv=False)
        np.testing.assert_allclose(r["error"], (s[r["rank"] :] ** 2).sum(), rtol=1e-6)
        assert r["rank"] == (s > 0.1 * (np.sqrt(m.shape[0]) + np.sqrt(m.shape[1]))).sum()
    part = movies.low_rank(frame(spark, {0: noisy}), ["movie"], 16, 16, 8, 2, part=0.9)[2].collect()
    assert all(r["error"] <= 0.1 * r["total"] * (1 + 1e-9) for r in part)
    u, v, errors = movies.low_rank(frame(spark, {0: np.full((3, 4, 4), np.nan)}), ["movie"], 4, 4, 4, 0)
    assert u.count() == 0 and [r["rank"] for r in errors.collect()] == [0]
    assert movies.low_rank(frame(spark, {}), ["movie"], 4, 4, 4, 0)[2].count() == 0


def filled(a, sigma, r, most=1 / 3, masked=None):
    out = a.copy()
    for t, f in enumerate(a):
        gone = np.isnan(f) if masked is None else np.isnan(f) | masked[t]
        if gone.mean() > most:
            continue
        for y, x in zip(*np.where(np.isnan(f))):
            top = bottom = 0.0
            for dy in range(-r, r + 1):
                for dx in range(-r, r + 1):
                    if 0 <= y + dy < f.shape[0] and 0 <= x + dx < f.shape[1] and np.isfinite(f[y + dy, x + dx]):
                        w = math.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))
                        top, bottom = top + w * f[y + dy, x + dx], bottom + w
            if bottom:
                out[t, y, x] = top / bottom
        if masked is not None:
            out[t][masked[t]] = np.nan
    return out


def test_missing_pixels_are_filled_from_near_ones(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4, 9, 11))
    a[0][rng.random((9, 11)) < 0.2] = np.nan
    a[1][rng.random((9, 11)) < 0.6] = np.nan  # too many
    a[2][:4, :6] = np.nan  # some of these have none near
    df = frame(spark, {0: a})
    got = {(r["frame"], r["y"], r["x"]): r["value"] for r in movies.filled_in_space(df, ["movie"], 0.6, radius=2).collect()}
    want = filled(a, 0.6, 2)
    assert len(got) == a.size and np.isnan(want[2]).any()
    for k, v in got.items():
        assert (v is None and np.isnan(want[k])) or abs(v - want[k]) < 1e-9
    mask = rng.random(a.shape) < 0.1
    rows = [(0, t, y, x, None if np.isnan(a[t, y, x]) else float(a[t, y, x]), bool(mask[t, y, x])) for t in range(4) for y in range(9) for x in range(11)]
    df = spark.createDataFrame(rows, "movie int, frame int, y int, x int, value double, hidden boolean")
    want = filled(a, 0.6, 2, masked=mask)
    for r in movies.filled_in_space(df, ["movie"], 0.6, radius=2, masked="hidden").collect():
        v, w = r["value"], want[r["frame"], r["y"], r["x"]]
        assert (v is None and np.isnan(w)) or abs(v - w) < 1e-9
