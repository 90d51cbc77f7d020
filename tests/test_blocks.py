"""Blocks of sequences against rows of sites, and k-mer counts kept up under masking against counts made anew."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from clipmotif.operators import blocks, de, em, kmers
from clipmotif.plans import programs


def frame(spark, n, length, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = "".join(r.choices("ACGTN", [6, 5, 5, 6, 0.3], k=r.randint(6, length)))
        rows.append((i, s, [r.random() for _ in s], [r.randrange(4) for _ in s]))
    rows += [(1000, "NNNNNNNNNN", [0.5] * 10, [0] * 10), (1001, "ACGTTGCATC" * 30, [0.25] * 300, [1] * 300)]
    return spark.createDataFrame(rows, "seq_id long, seq string, ss array<double>, counts array<int>")


@pytest.mark.parametrize("size", [5, 50, 1 << 16])
@pytest.mark.parametrize("parts", [(), ("ss",), ("d",), ("ss", "d")])
def test_round_sums_equal_those_of_rows(spark, size, parts):
    df = frame(spark, 25, 60, 3).withColumn("d", de.normalise(F.col("counts"))).select("seq_id", "seq", *parts)
    models = [em.seed_model(k, s, 27, 9, "ss" in parts, delta=k) for k, s in enumerate(["TTGCA", "ACGTT"])]
    if "ss" in parts:
        models = [em.replace(m, paired=(0.2, 0.3, 0.5, 0.7, 0.9)) for m in models]
    want = {r["start"]: r.asDict() for r in em.expected_counts(em.e_step(em.site_facts(df, 5), models), em.base_counts(df), 5, em.sequence_occupancy(em.site_facts(df, 5), models)).collect()}
    logs = de.with_logs(df) if "d" in parts else df
    own = blocks.site_blocks(logs, 5, size)
    got = {r["start"]: r.asDict() for r in blocks.round_sums(own, [em.term(m) for m in models], size).collect()}
    whole = em.totals(em.base_counts(df))
    for k in (0, 1):
        for name, value in want[k].items():
            assert got[k][name] == pytest.approx(value, rel=1e-9, abs=1e-9), name
        assert {c: got[k][c] for c in whole} == pytest.approx(whole)
    best = {r["seq_id"]: (r["site"], r["z"], r["q"]) for r in blocks.best_sites(own, em.term(models[0]), size).collect()}
    at = {(r["seq_id"], r["pos"]): r["z"] for r in em.e_step(em.site_rows(df, 5), models[:1]).collect()}
    for r in em.best_sites(df, models[0]).collect():
        site, z, q = best[r["seq_id"]]
        assert z is None or at[r["seq_id"], site] == pytest.approx(z, rel=1e-9)  # sums of equal terms may differ in the last digit
        assert (z is None) == (r["z"] is None) and (z is None or z == pytest.approx(r["z"], rel=1e-9) and q == pytest.approx(r["q"], rel=1e-9))


def test_fit_of_blocks_equals_fit_of_rows(spark):
    df = frame(spark, 30, 40, 5).select("seq_id", "seq")
    models = [em.seed_model(k, s, 32, 9) for k, s in enumerate(["TTGCA", "ACGTT", "GGGGG"])]
    rows = em.fit(em.site_facts(df, 5), em.base_counts(df), models, rounds=4)
    for size in (9, 1 << 16):
        for a, b in zip(rows, em.fit(blocks.site_blocks(df, 5, size), None, models, rounds=4, block_size=size), strict=True):
            assert a.start == b.start and a.ll == pytest.approx(b.ll) and a.gamma == pytest.approx(b.gamma) and len(a.trace) == len(b.trace)


def test_discovery_is_the_same_with_short_blocks(spark):
    df = frame(spark, 20, 40, 7)
    args = (df.select("seq_id", "seq"), 5)
    named = {"motifs": 2, "starts": 2, "rounds": 2, "structure": df.select("seq_id", "ss"), "counts": df.select("seq_id", "counts")}
    one, many = programs.discover_motifs(*args, **named), programs.discover_motifs(*args, **named, block_size=7)
    one, many = sorted(one, key=lambda m: m.number), sorted(many, key=lambda m: m.number)  # equally likely ones may change places
    assert [m.model.kmer for m in one] == [m.model.kmer for m in many]
    for a, b in zip(one, many, strict=True):
        assert a.model.ll == pytest.approx(b.model.ll)
        q = [{r["seq_id"]: r["q"] for r in m.sites.collect()} for m in (a, b)]
        assert q[0] == pytest.approx(q[1])


def test_counts_kept_up_under_masking(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choices("ACG", k=r.randint(6, 25)))) for i in range(40)]
    before = spark.createDataFrame(rows, "seq_id long, seq string")
    sites = spark.createDataFrame([(i, r.randint(0, len(s) - 4), 1.0) for i, s in rows[::2]], "seq_id long, site int, q double")
    after = em.mask_sites(before, sites, 4)
    gone = kmers.observed(before, 4).join(kmers.lost(before, after, sites, 4), "kmer", "left").select("kmer", (F.col("observed") - F.coalesce("lost", F.lit(0))).alias("n")).where("n > 0")
    assert sorted(map(tuple, gone.collect())) == sorted(map(tuple, kmers.observed(after, 4).collect()))


def test_expected_counts_by_composition(spark):
    r = random.Random(2)
    for k in (4, 12):
        seqs = ["".join(r.choices("ACGT", [4, 3, 2, 1], k=r.randint(0, 60))) for _ in range(30)] + ["ACGTN" * 5]
        df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
        n = sum(map(len, seqs))
        share = {b: sum(s.count(b) for s in seqs) / n for b in "ACGT"}
        scored = kmers.enrichment(df, k)
        assert "collect_list" not in scored._jdf.queryExecution().toString()
        found = {x["kmer"]: (x["observed"], x["expected"]) for x in scored.collect()}
        want = {s[j : j + k] for s in seqs for j in range(len(s) - k + 1) if "N" not in s[j : j + k]}
        assert set(found) == want
        for m in want:
            p = math.prod(share[b] for b in m)
            assert found[m][0] == sum(m in s for s in seqs)
            assert found[m][1] == pytest.approx(sum(1 - math.exp(-len(s) * p) for s in seqs), rel=1e-9)
