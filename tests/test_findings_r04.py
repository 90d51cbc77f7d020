"""What the findings of round 4 asked for."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmotif.functions.seq import i2mer
from clipmotif.operators import blocks, em, intervals, kmers
from clipmotif.plans import programs


@pytest.mark.parametrize("held, rows", [(1 << 14, 1 << 16), (300, 5), (1, 5)])
def test_rows_of_one_interval_meet_others_as_a_list(spark, monkeypatch, held, rows):
    monkeypatch.setattr(intervals, "HELD", held)
    monkeypatch.setattr(intervals, "LIST", rows)
    r = random.Random(8)
    own = [(i, r.choice([None, "u", "v"]), r.choice(["x", "y", None]), s, s + w) for i in range(300) for s, w in [r.choice([(5, 1), (40, 1), (r.randrange(90), 0), (3, 5000)])]]
    theirs = [(i, r.choice("xy"), s, s + r.randrange(70)) for i in range(60) for s in [r.randrange(60)]]
    a = spark.createDataFrame(own, "p long, note string, chrom string, st long, en long")
    b = spark.createDataFrame(theirs, "rank long, chrom string, rs long, re long")
    found = intervals.overlap_join(a, b)
    want = [(c, p, note, s, e, k, u, v) for p, note, c, s, e in own for k, d, u, v in theirs if c == d and e > s and v > u and v > s and u < e]
    assert found.columns == ["chrom", "p", "note", "st", "en", "rank", "rs", "re"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and want
    stabbed = intervals.stab(a.withColumnRenamed("st", "pos").drop("en"), b)
    want = [(c, p, note, s, k, u, v) for p, note, c, s, _ in own for k, d, u, v in theirs if c == d and u <= s <= v]
    assert sorted(map(str, map(tuple, stabbed.select("chrom", "p", "note", "pos", "rank", "rs", "re").collect()))) == sorted(map(str, want))
    one = intervals.overlap_join(a.drop("note"), b)
    assert sorted(map(tuple, one.select("p", "rank").collect())) == sorted(map(tuple, found.select("p", "rank").collect()))
    for frame, name in ((found, "inline(__rows"), (stabbed, "inline(__rows"), (one, "explode(__rows")):
        assert (name in frame._jdf.queryExecution().executedPlan().toString()) == (held > 1)


def _texts(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choices("ACGTNa", [6, 5, 5, 6, 0.3, 0.1], k=r.randint(6, 60)))) for i in range(40)]
    return spark.createDataFrame([*rows, (1000, "NNNNNNNNNN"), (1001, "ACGTTGCATC" * 30), (1002, "TTTTTT")], "seq_id long, seq string")


@pytest.mark.parametrize("width", [4, 6, 7])
def test_stretches_stand_for_all_their_sites(spark, width):
    own = blocks.site_blocks(_texts(spark), width)
    batch = own.select("seq", "first", "last").toArrow().combine_chunks().to_batches()[0]
    pieces = blocks.Pieces(batch, blocks.SIZE, width)
    numbers, n = pieces.stretches(width)
    assert len(n) == batch.num_rows and n.min() >= 1 and len(numbers) < 0.6 * pieces.valid.sum()
    table = np.random.default_rng(1).random(4**width)
    sums = np.add.reduceat(blocks._stretched(table)[numbers], np.cumsum(n) - n)
    assert np.allclose(sums, np.add.reduceat(np.append(table, 0.0)[pieces.codes(width)], pieces.starts))
    met = np.bincount(numbers, minlength=blocks._offsets(width)[-1] + 1).astype(float)
    assert np.array_equal(blocks._by_kmer(met[None], width)[0], np.bincount(pieces.codes(width), minlength=4**width + 1)[:-1])


def test_masked_sequences_tell_what_they_lose(spark):
    df, term = _texts(spark), em.term(em.seed_model(0, "TTGCA", 27, 20))
    own = blocks.site_blocks(df, 5)
    named = lambda frame, n: {r["kmer"]: r[n] for r in frame.select(i2mer(5, F.col("number")).alias("kmer"), n).collect()}
    assert named(blocks.observed(own, 5), "observed") == {r["kmer"]: r["observed"] for r in kmers.observed(df, 5).collect()}
    rows = blocks.masked(own, term, em.OCCURS).persist()
    best = blocks.best_sites(own, term)
    plain = lambda frame: sorted(map(str, frame.select("seq_id", "site", F.round("z", 9), F.round("q", 9)).collect()))
    assert plain(rows) == plain(best)
    after = em.mask_sites(df, best, 5)
    assert dict(map(tuple, rows.select("seq_id", "seq").collect())) == dict(map(tuple, after.where(F.length("seq") >= 5).collect()))
    lost = rows.select(F.explode("lost").alias("number")).groupBy("number").agg(F.count("*").alias("lost"))
    want = {r["kmer"]: r["lost"] for r in kmers.lost(df, after, best.where(F.col("q") >= em.OCCURS), 5).collect()}
    assert named(lost, "lost") == want and want
    was, now = (em.totals(em.base_counts(x.where(F.length("seq") >= 5))) for x in (df, after))
    assert programs._without(was, rows.where("under IS NOT NULL"), 5) == now != was


def test_discovery_cuts_no_sequence_twice(spark, monkeypatch):
    df = _texts(spark)
    find = lambda size: [(m.number, m.model.kmer, round(m.model.ll, 6), sorted(map(str, m.sites.select("seq_id", "site", F.round("q", 9)).collect()))) for m in programs.discover_motifs(df, 5, motifs=2, starts=2, rounds=3, block_size=size)]
    one, some = find(blocks.SIZE), find(50)
    monkeypatch.setattr(blocks, "CODED", 0)
    assert one == some == find(blocks.SIZE)
