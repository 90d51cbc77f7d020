"""What the findings of round 3 asked for."""

from __future__ import annotations

import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipmotif.catalog import discovery, planted
from clipmotif.functions import seq
from clipmotif.operators import blocks, de, em, intervals, reads, simulate
from clipmotif.plans import programs
from clipmotif.streaming import events as stream

SF = "/root/testdata/sf0.1"
TIES = (180, 1381, 2971, 3617, 3923, 5396, 5515, 5697, 8195, 8285, 8398)


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """A folder with documents that have sites whose odds differ in the last digit alone."""
    folder = str(tmp_path_factory.mktemp("tied"))
    spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(*TIES)).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_best_sites_are_those_of_sql(spark, tied):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tied}/documents.parquet/*.parquet'")
    for name, key in (("best_sites", "site"), ("masked_sequences", "seq"), ("motif_site_lines", "line")):
        want = dict(con.execute(f"SELECT seq_id, {key} FROM ({discovery.SQL[name]})").fetchall())
        assert {r["seq_id"]: r[key] for r in discovery.QUERIES[name](spark, tied).collect()} == want


def _frame(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choices("ACGTN", [6, 5, 5, 6, 0.3], k=r.randint(6, 60)))) for i in range(25)] + [(1000, "NNNNNNNNNN"), (1001, "ACGTTGCATC" * 30)]
    return spark.createDataFrame(rows, "seq_id long, seq string")


@pytest.mark.parametrize("size", [20, 1 << 16])
def test_sums_of_coded_blocks(spark, size):
    own = blocks.site_blocks(_frame(spark), 5, size)
    terms = [em.term(em.seed_model(k, s, 27, 9)) for k, s in enumerate(["TTGCA", "ACGTT"])]
    want = {r["start"]: r.asDict() for r in blocks.round_sums(own, terms, size).collect()}
    found = {r["start"]: r.asDict() for r in blocks.coded_sums(blocks.coded(own, 5), own.where("NOT whole"), terms, size).collect()}
    assert set(found) == set(want) == {0, 1}
    for k in want:
        assert found[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("size", [20, 1 << 16])
def test_occupancy_and_sites_of_blocks(spark, size):
    df = _frame(spark)
    own, models = blocks.site_blocks(df, 5, size), [em.seed_model(k, s, 27, 9) for k, s in enumerate(["TTGCA", "ACGTT"])]
    want = {(r["start"], r["seq_id"]): r["q"] for r in em.sequence_occupancy(em.site_facts(df, 5), models).collect()}
    assert {(r["start"], r["seq_id"]): r["q"] for r in blocks.occupancy(own, [em.term(m) for m in models], size).collect()} == pytest.approx(want, rel=1e-9)
    want = {(r["seq_id"], r["pos"]): r["z"] for r in em.e_step(em.site_rows(df, 5), models[:1]).collect() if r["z"] >= 0.01}
    assert {(r["seq_id"], r["pos"]): r["z"] for r in blocks.sites(own, em.term(models[0]), 0.01, size).collect()} == pytest.approx(want, rel=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["estep_occupancy", "estep_sites", "estep_events", "indicator_text"])
def test_no_rows_of_sites_are_shuffled(spark, tied, name):
    plan = discovery.QUERIES[name](spark, tied)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_profiles_go_by_in_parts():
    lists = [[0.5] * n for n in (de.VALUES, 5, de.VALUES // 2, de.VALUES, 3)] + [None, []]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.float64()))], names=["d"])
    parts = list(de._parts(batch, 0))
    assert [x for p in parts for x in p.column(0).to_pylist()] == lists
    assert len(parts) >= 2
    found = [de._listed(p.column(0), de.GEO_P, de.WEIGHT).to_pylist() for p in parts]
    assert [None if x is None else len(x) for p in found for x in p] == [None if x is None else len(x) + 16 if x else 0 for x in lists]


def test_draws_stand_in_plans_once(spark):
    df = spark.createDataFrame([(i, f"s{i}", "ACGTTGCATC" * 8) for i in range(5)], "seq_id long, name string, seq string")
    made, counts, truth = simulate.simulate(df, [planted.FIRST, planted.SECOND], 12)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("md5") < 100
    lines = simulate.truth_lines(truth[0], planted.FIRST, "M")
    assert "md5" not in simulate.truth_lines(simulate.place(df, planted.FIRST, 12), planted.FIRST, "M")._jdf.queryExecution().optimizedPlan().toString()
    assert lines.where("part = 1").count() == truth[0].where("site IS NOT NULL").count()


def test_other_letters_go_in_runs(spark):
    df = spark.createDataFrame([("a  b--c\nUg!!!",), ("",), ("xyz",)], "t string").select(seq.normalise(F.col("t")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["ACTG", "", ""]
    assert "[^ACGTUacgtu]+" in df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_share_a_node_overlap(spark):
    r = random.Random(7)
    a = spark.createDataFrame([(i, "x", s, s + 1) for i in range(400) for s in [r.randrange(3000)]], "p long, chrom string, st long, en long")
    b = spark.createDataFrame([(i, "x", s, s + 21 + i % 60) for i in range(400) for s in [r.randrange(3000)]], "rank long, chrom string, rs long, re long")
    levels = F.sequence(F.lit(0), F.lit(intervals.TOP))
    met = intervals._noded(a, "st", "en", levels).join(intervals._noded(b, "rs", "re", levels).where("home").select("rank", "level", "node"), ["level", "node"])
    found = intervals.overlap_join(a, b)
    assert found.count() <= met.count() <= 2 * found.count()
    # a small side is not sent whole to every task of the other
    for own in (found, intervals.stab(a.withColumnRenamed("st", "pos"), b)):
        assert "Broadcast" not in own._jdf.queryExecution().executedPlan().toString()


def test_streams_keep_a_row_per_place(spark, tmp_path):
    lines = [f"c\t{10 + i % 4}\t{40 + i % 4}\tr{i}\t0\t+" for i in range(24)] + ["c\tx\t9\tbad\t0\t+"]
    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines[k::2]) + "\n")
    # many regions over the same places; one stands there twice, one is empty, one is turned round, one has no chrom
    kinds = "rank long, chrom string, rs long, re long, strand string"
    rows = [(i, "c", 5 + i % 3, 30, "+-"[i % 2]) for i in range(40)]
    regions = spark.createDataFrame([*rows, rows[7], (50, "c", 11, 11, "+"), (51, "c", 20, 9, "+"), (52, None, 5, 30, "+")], kinds)
    reading = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    state: dict = {}
    sink = lambda df, _: state.update({(x.rank, x.pos): x.n for x in df.collect()})
    query = stream.write_counts(stream.stream_counts(reading, regions), sink, str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    found = reads.events(reads.parse_reads(spark.createDataFrame([(x,) for x in lines], "line string"), "rmap"), "iCLIP", "rmap")
    want: dict = {}
    for e in found.where("st IS NOT NULL").collect():
        for rank, chrom, rs, re, _ in [tuple(x) for x in regions.collect()]:
            if chrom == e.chrom and rs <= e.st < re:
                want[rank, e.st - rs] = want.get((rank, e.st - rs), 0) + 1
    assert state == want and want
    batch = intervals.pile_up(found, regions, mirror=False)
    assert {(x.rank, x.pos): x.n for x in batch.collect()} == want


def test_regions_are_not_sent_whole(spark):
    lines = spark.createDataFrame([("r1\tS\tACGT\tIIII\tU\t9\t1\t>c\t10\tF\t.\t.\t.\t2T>C",)], "line string")
    regions = spark.createDataFrame([(1, "c", 5, 30, "+"), (2, "c", 40, 45, "-")], "rank long, chrom string, rs long, re long, strand string")
    found = programs.extract_events(lines, regions, "novoalign", "pCLIP")
    assert {r["rank"]: (len(r["counts"]), sum(r["counts"])) for r in found.collect()} == {1: (25, 1), 2: (5, 0)}
    assert "Broadcast" not in intervals.pile_up(reads.events(reads.parse_reads(lines, "novoalign"), "pCLIP"), regions)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_what_follows_from_best_sites_is_that_of_sql(spark, tied):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tied}/documents.parquet/*.parquet'")
    for name in ("motif_counts", "motif_record"):
        cursor = con.execute(discovery.SQL[name])
        columns = [d[0] for d in cursor.description]
        plain = lambda rows: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
        assert plain(map(tuple, discovery.QUERIES[name](spark, tied).select(*columns).collect())) == plain(cursor.fetchall())


def test_regions_climb_to_no_level_without_events(spark):
    events = spark.createDataFrame([(1, "x", 10, 11)], "p long, chrom string, st long, en long")
    levels = intervals._levels(events, "st", "en")
    regions = spark.createDataFrame([(1, "x", 0, 48)], "rank long, chrom string, rs long, re long")
    assert intervals._noded(regions, "rs", "re", levels).count() == 3
    # and find events of all sizes on the way
    own = spark.createDataFrame([(1, "x", 10, 11), (2, "x", 0, 5000), (3, "x", 0, 1 << 40), (4, "x", 48, 60)], "p long, chrom string, st long, en long")
    assert sorted(r["p"] for r in intervals.overlap_join(own, regions).collect()) == [1, 2, 3]


def _counted(events, row, mirror):
    _, chrom, rs, re, strand = row
    found = [0] * max(0, re - rs)
    for c, st, en in events:
        if c == chrom and en > st and rs <= st < re:
            found[re - 1 - st if mirror and strand == "-" else st - rs] += 1
    return found


@pytest.mark.parametrize("mirror", [True, False])
def test_counts_of_regions_of_all_widths(spark, mirror):
    r = random.Random(21)
    places = [("xy"[i % 2], r.randrange(-700, 3000)) for i in range(900)]
    own = [(c, st, st + i % 3) for i, (c, st) in enumerate(places * 2)]
    rows = [(i, "xyz"[i % 3], s, s + w, "+-"[i % 2]) for i, w in enumerate([1, 16, 127, 128, 129, 255, 256, 257, 512, 513, 1024, 2500, 3000, 0, -5] * 6) for s in [r.randrange(-600, 1500)]]
    rows += [(200 + k, "x", 128 * k - 1, 128 * k - 1 + w, "-") for k, w in enumerate([128, 129, 256, 257])]
    events = spark.createDataFrame(own, "chrom string, st long, en long")
    regions = spark.createDataFrame([*rows, (300, None, 5, 9, "+")], "rank long, chrom string, rs long, re long, strand string")
    found = {x["rank"]: x["counts"] for x in intervals.dense_pile_up(events, regions, mirror).collect()}
    want = {row[0]: _counted(own, row, mirror) for row in rows} | {300: [0] * 4}
    assert found == want and len(found) == len(rows) + 1
    sparse = {(x["rank"], x["pos"]): x["n"] for x in intervals.pile_up(events, regions, mirror).collect()}
    assert sparse == {(k, pos): n for k, v in want.items() for pos, n in enumerate(v) if n}
    none = intervals.dense_pile_up(events.where("false"), regions.where("rank < 9"), mirror)
    assert {x["rank"]: x["counts"] for x in none.collect()} == {k: [0] * len(v) for k, v in want.items() if k < 9}
    assert intervals.dense_pile_up(events, regions.where("re <= rs"), mirror).agg(F.sum(F.size("counts"))).first()[0] == 0


def test_nothing_is_gathered_by_region(spark):
    lines = spark.createDataFrame([("r1\tS\tACGT\tIIII\tU\t9\t1\t>c\t10\tF\t.\t.\t.\t2T>C",)], "line string")
    kinds = "rank long, chrom string, rs long, re long, strand string"
    regions = spark.createDataFrame([(1, "c", 5, 30, "+"), (2, "c", 40, 45, "-")], kinds)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    gathers = lambda df: [x for x in plan(df).splitlines() if ("Aggregate" in x or "Exchange" in x) and "rank#" in x]
    events = reads.events(reads.parse_reads(lines, "novoalign"), "pCLIP")
    assert not gathers(programs.extract_events(lines, regions, "novoalign", "pCLIP"))
    assert "Broadcast" not in plan(programs.extract_events(lines, regions, "novoalign", "pCLIP"))
    # counts of pairs are added up only where a rank stands at several regions
    assert not gathers(intervals.pile_up(events, regions))
    twice = intervals.pile_up(events, regions.unionByName(regions))
    assert gathers(twice) and [tuple(x) for x in twice.collect()] == [(1, 5, 2)]
