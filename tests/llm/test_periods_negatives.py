"""Periodic runs and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmotif.llm import negatives, periods, queries


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - a >= max(6, 4 * q):
                found.setdefault((a, i + q - a), q)
            i += 1
    return sorted((a, n, q) for (a, n), q in found.items())


def plain_op11(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = None
    for a, m, q in found:
        if best is None or m * best[2] > best[1] * q:
            best = (a, m, q)
    said = "".join(f"{a},{m},{q}\n" for a, m, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_equal_all_periods():
    r = random.Random(3)
    for _ in range(1500):
        n, k = r.randint(0, 120), r.choice([1, 2, 3, 8])
        w = [r.randrange(k) for _ in range(n)]
        if n > 10 and r.random() < 0.7:
            a = r.randrange(n)
            p = 1 + r.randrange((n - a) // 3 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(n)] = r.randrange(k + 1)
        assert periods.runs(np.array(w, np.int64)) == plain_runs(w), w


def test_runs_of_long_texts():
    assert periods.runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert periods.runs(np.arange(50_000) % 777) == [(0, 50_000, 777)]
    with pytest.raises(ValueError):
        periods.runs(np.zeros(9, np.int64), repeats=2)


def test_op11_query_equals_plain_version(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(r.choices("ab c d eé f ß".split(" "), k=r.randint(0, 90))) for _ in range(60)]
    texts += [None, "", "  \n\t", "one", "na " * 7, "x y " * 40 + "z", "　a \x1ca 　a \x1ca " * 9, "tie a a a a a a b b b b b b"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "la la la la la la", "x", 1), (3, texts[3], "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, `runs` string, `n words` int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted((tuple(g)[:8] for g in got), key=repr) == sorted((plain_op11(d, t) for d, t, _, _ in rows), key=repr)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 and t for d, t, _, _ in rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periods.periodic_runs(none).count() == 0


def plain_mine(rows, asked, positives=5, negatives_=10, low=30, high=90):
    own = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for i, lab, v in own:
        if asked(i):
            met = sorted((-score(v, u), j, other == lab) for j, other, u in own if j != i)
            for s, j, _ in [x for x in met if x[2]][:positives]:
                fits = [x for x in met if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives_]
                out += [(i, j, k + 1, m, -s, -t) for k, (t, m, _) in enumerate(fits)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(2)
    rows = []
    for i in range(700):
        v = r.normal(size=12) * r.choice([0.05, 0.3, 1, 4])
        if i % 3 == 0:
            v = np.ones(12) * 0.5  # a third of all are the same
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(0, 4))))
    rows += [(800, None, 1), (900, [1.0] * 12, None), (None, [1.0] * 12, 1), (1000, [1.0, None] * 6, 1), (1001, [float("nan")] * 12, 1), (1002, [float("inf")] * 12, 1), (1100, [], 2), (1200, [2.0, 1.0], 2)]
    return rows


@pytest.mark.parametrize("block", [3, 1000])
def test_mine_equals_all_pairs(spark, vectors, block):
    df = spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<float>, label int, norm int")
    got = negatives.mine(df, F.col("vec_id") % 50 == 0, bucket=64, block_anchors=block)
    assert sorted(tuple(g) for g in got.collect()) == plain_mine(vectors, lambda i: i % 50 == 0)


def test_mine_odd_tables(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    assert negatives.mine(spark.createDataFrame([], kinds), F.col("vec_id") % 2 == 0).count() == 0
    twice = [(0, [1.0], 1), (0, [1.0], 1), (1, [0.5], 1), (1, [0.5], 1), (2, [0.25], 2)]
    got = negatives.mine(spark.createDataFrame(twice, kinds), F.col("vec_id") == 0).collect()
    assert [tuple(g) for g in got] == [(0, 1, 1, 2, 256 * 128, 256 * 64)]  # copies count once


def test_buckets_are_pruned_and_great_numbers_exact():
    r = np.random.default_rng(4)
    v = np.floor(r.normal(size=(4096, 8)) * np.exp(r.normal(size=(4096, 1)) * 2) * 100)
    order = np.argsort(-negatives.norms(v))
    v = v[order]
    ids, labels = np.arange(4096), np.zeros(4096, np.int64)
    wide = np.full((4, 1), np.iinfo(np.int64).max)
    search = negatives.Search(v[:400:100], ids[:400:100], labels[:4], -wide, wide, 5, True)
    for at in range(0, 4096, 128):
        search.bucket(v[at : at + 128], ids[at : at + 128], labels[at : at + 128])
    whole = v[:400:100] @ v.T
    whole[np.arange(4), [0, 100, 200, 300]] = -np.inf
    assert sorted(search.best.score.tolist()) == sorted(np.sort(whole, axis=1)[:, -5:].ravel().astype(int).tolist())
    assert search.compared < 4 * 4096 / 2
    far = np.array([[2.0**31, 1.0]])
    assert negatives.scores(far, far)[0, 0] == 2**62 + 1
