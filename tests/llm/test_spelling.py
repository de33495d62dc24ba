"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from spindrift.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p + 1 :]


def brute(docs, least=7, factor=10):
    n = Counter()
    for d, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= factor * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(60)]
    docs = []
    for d in range(400):
        picked = rng.choices(base, [1 / (i + 1) ** 2 for i in range(60)], k=20)
        docs.append((d, " ".join(w.upper() if rng.random() < 0.1 else w[: len(w) - 1] + rng.choice(["", "x", "b"]) if rng.random() < 0.05 else w for w in picked)))
    want = brute(docs)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] for r in want if r[1])
    assert rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_long_runs_and_the_border_to_them(spark):
    rng = random.Random(5)
    docs = []
    for n in (62, 63, 64, 65, 66, 500):
        w = "".join(rng.choice("ab") for _ in range(n))
        for v, k in ((w, 40), (w[:9] + "x" + w[10:], 3), (w + "y", 4), (w[1:], 2), (w[: n // 2] + "zz" + w[n // 2 :], 2), ("q" + w, 2)):
            docs += [(len(docs), f"{v}. {v}")] * k
    docs += [(i, "é" * k) for k in (63, 64, 65, 66) for i in range(k % 5 * 12 + 2)]
    assert rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_odd_rows_and_none(spark, odd, none):
    assert rows(spelling.variants(odd)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert spelling.variants(none).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(none, factor=1)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert rows(spelling.variants(docs)) == brute([tuple(r) for r in docs.collect()])
