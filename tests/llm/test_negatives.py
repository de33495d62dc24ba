"""Hard negatives against brute force over all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.llm import hard_negatives as hn

KIND = "vec_id long, embedding array<float>, label int, uid long, cell int, score double"


def brute(data, positives=5, negatives=10):
    rows = [(v, tuple(math.floor(256 * x) for x in e), label) for v, e, label in data if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    last = lambda v: (v is None, v or 0)

    def ranked(a, same):
        found = [(-sum(x * y for x, y in zip(rows[a][1], q)), last(v), v) for i, (v, q, label) in enumerate(rows) if (label == rows[a][2]) == same and i != a]
        return [(-s, v) for s, _, v in sorted(found)]

    for a, (v, _, _) in enumerate(rows):
        if v is None or v % 100:
            continue
        others = ranked(a, False)
        for p, pid in ranked(a, True)[:positives]:
            picked = [(s, n) for s, n in others if 30 * p <= 100 * s <= 90 * p][:negatives]
            out += [(v, pid, k + 1, n, p, s) for k, (s, n) in enumerate(picked)]
    return sorted(out, key=repr)


def mined(spark, data, **more):
    df = spark.createDataFrame([(*r, 1, 2, 0.5) for r in data], KIND)
    got = hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **more)
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()), key=repr)


def vectors(n, dims, seed, labels=4, spread=0.15):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(6)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        x = [float(F32(v + rng.gauss(0, spread))) for v in c]
        out.append((i, x, rng.randrange(labels)))
    return out


def F32(x):
    import numpy as np

    return np.float32(x)


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_equals_brute_force_with_many_cells_and_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "CELL_ROWS", 8)
    monkeypatch.setattr(hn, "ASKS", 2)
    data = vectors(600, 5, 1, spread=spread)
    hot = data[7][1]  # one vector in a third of the rows, over all labels
    data += [(600 + i, hot, i % 4) for i in range(300)]
    want = brute(data)
    assert want and mined(spark, data) == want


def test_odd_rows(spark):
    data = vectors(220, 3, 2)
    data += [(None, data[0][1], 1), (None, data[3][1], 2), (300, None, 1), (400, [0.1, None, 0.2], 1), (500, [float("nan"), 0.0, 0.1], 1), (600, [float("inf"), 0.0, 0.1], 1), (700, [0.2, 0.1, 0.3], None)]
    data += [(100, data[100][1], data[100][2]), (100, data[100][1], data[100][2]), (800, [0.3], 1), (900, [], 2), (1000, [0.0, 0.0, 0.0], 3)]
    assert mined(spark, data) == brute(data)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1)]) == []
    assert mined(spark, [(100, [0.5], 1)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(100, [1e9], 1)])


def test_visits_fall_and_are_whole():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = list(hn.visits(a, b))
    assert [g[0] for g in got] == sorted((x + y for x in a for y in b), reverse=True)
    assert sorted(g[1:] for g in got) == [(i, j) for i in range(7) for j in range(5)]


def test_nothing_but_the_list_of_cells_is_broadcast(spark, monkeypatch):
    """Asks grow with anchors times blocks: however small they look to Spark, they don't go through the driver."""
    plans = {}
    for name in ("staged", "kept"):

        def seen(df, tag, write=getattr(hn, name)):
            plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, tag)

        monkeypatch.setattr(hn, name, seen)
    data = vectors(220, 4, 3)
    assert mined(spark, data) == brute(data)
    assert "BroadcastHashJoin" in plans.pop("negatives-blocks")[0]
    assert {"negatives-best", "negatives-anchors", "negatives"} <= plans.keys()
    assert not [tag for tag, some in plans.items() if any("Broadcast" in plan for plan in some)]
