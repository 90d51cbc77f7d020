"""Interval joins over all sizes of intervals, counts without pairs, and running numbers without one task for all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clipmotif.operators import intervals
from clipmotif.sources import readers


def nested(r, n):
    """Intervals of all sizes, many of them within others."""
    out = []
    for i in range(n):
        size = int(2 ** r.uniform(0, 31))
        start = r.choice([r.randrange(1 << 31), r.randrange(1 << 12), (1 << r.randrange(10, 31)) - r.randrange(3)])
        out.append((i, r.choice("xy"), start, start + size))
    return [*out, (n, "x", 7, 7), (n + 1, "z", 0, 1 << 31), (n + 2, "x", 0, 1 << 62)]


def test_join_of_nested_intervals(spark):
    r = random.Random(6)
    own, theirs = nested(r, 150), nested(r, 120)
    a = spark.createDataFrame(own, "p long, chrom string, st long, en long")
    b = spark.createDataFrame(theirs, "rank long, chrom string, rs long, re long")
    want = sorted((p, k) for p, c, s, e in own for k, d, u, v in theirs if c == d and max(s, u) < min(e, v))
    assert sorted(tuple(x) for x in intervals.overlap_join(a, b).select("p", "rank").collect()) == want
    points = [(i, r.choice("xy"), r.randrange(1 << 31)) for i in range(200)]
    got = intervals.stab(spark.createDataFrame(points, "p long, chrom string, pos long"), b).select("p", "rank").collect()
    assert sorted(map(tuple, got)) == sorted((p, k) for p, c, s in points for k, d, u, v in theirs if c == d and u <= s <= v)


def test_a_long_interval_gives_few_rows(spark):
    long = spark.createDataFrame([("x", 5, 1 << 40)], "chrom string, lo long, hi long")
    levels = F.sequence(F.lit(0), F.lit(intervals.TOP))
    assert intervals._noded(long, "lo", "hi", levels).where("home").count() <= intervals.NODES + 2
    assert intervals._noded(long, "lo", "hi", levels).count() <= intervals.NODES + 2 + 3 * intervals.TOP


def test_bucket_counts_of_any_bins(spark):
    r = random.Random(8)
    events, bins = nested(r, 300), nested(r, 200)
    bins += [(900, None, 1, 2), (901, "nowhere", 1, 2), (902, "x", None, 2), (903, "x", 5, 9), (904, "x", 5, 9)]
    found = intervals.bucket_counts(spark.createDataFrame(events, "e long, chrom string, st long, en long"), spark.createDataFrame(bins, "rank long, chrom string, rs long, re long"))
    want = {k: sum(c == d and u is not None and max(s, u) < min(e, v) for _, c, s, e in events) for k, d, u, v in bins}
    assert dict(map(tuple, found.collect())) == want


def test_a_bin_that_meets_a_million_events(spark):
    n = 1_000_000
    events = spark.range(n).select(F.lit("x").alias("chrom"), (F.col("id") % 1000).alias("st"), (F.col("id") % 1000 + 1).alias("en"))
    bins = spark.createDataFrame([(1, "x", 0, 1000), (2, "x", 10, 11), (3, "y", 0, 5)], "rank long, chrom string, rs long, re long")
    found = intervals.bucket_counts(events, bins)
    assert dict(map(tuple, found.collect())) == {1: n, 2: n // 1000, 3: 0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("tasks", ["1", "5"])
def test_running_sums_over_ranges(spark, tasks):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        r = random.Random(9)
        rows = [(f"f{i % 7}", i, r.randint(0, 9)) for i in range(300)]
        got = readers.running(spark.createDataFrame(rows, "file string, at long, n long"), ["file", "at"], "n", "start").collect()
        at, want = 0, {}
        for f, i, n in sorted(rows):
            want[f, i] = at
            at += n
        assert {(x["file"], x["at"]): x["start"] for x in got} == want
        assert readers.running(spark.createDataFrame([], "file string, at long, n long"), ["file", "at"], "n", "start").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbers_need_no_window_over_all(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"part{k}.txt").write_text("".join(f"{k}:{i}\n" for i in range(50 + k)))
    own = readers.numbered(readers.text_lines(spark, str(tmp_path)))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "SinglePartition" not in plan
    want = [f"{k}:{i}" for k in range(5) for i in range(50 + k)]
    assert [x["line"] for x in own.orderBy("rank").collect()] == want


def plain_suppress(peaks, gap):
    want, last = {}, {}
    for c, s, k in sorted((c, s, k) for k, c, s in peaks):
        if c not in last or s - last[c] > gap:
            want[c, s] = k
            last[c] = s
    return want


@pytest.mark.parametrize(("gap", "span", "step"), [(120, 4096, 100), (120, 300, 60), (50, 16, 7), (0, 64, 3), (3, 5, 2000)])
def test_suppression_of_one_long_chain(spark, gap, span, step):
    r = random.Random(gap + span)
    at, peaks = -3000, []
    for i in range(3000):
        at += r.randrange(step)
        peaks.append((i, r.choice("xxxy"), at))
    found = intervals.suppress_neighbours(spark.createDataFrame(peaks, "rank long, chrom string, rs long").repartition(5), gap, span)
    assert {(x["chrom"], x["rs"]): x["rank"] for x in found.collect()} == plain_suppress(peaks, gap)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_suppression_of_odd_tables(spark):
    kinds = "rank long, chrom string, rs int"
    assert intervals.suppress_neighbours(spark.createDataFrame([], kinds)).count() == 0
    got = intervals.suppress_neighbours(spark.createDataFrame([(2, "x", 5), (1, "x", 5), (3, None, 5), (4, "x", None)], kinds))
    assert got.dtypes == [("chrom", "string"), ("rs", "int"), ("rank", "bigint")] and [tuple(x) for x in got.collect()] == [("x", 5, 1)]
