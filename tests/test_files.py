"""Reading parts of chromosome files, and sinks whose files are listed in order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clipmotif.sources import readers, writers


def chromosome(path, name, n, seed, end="\n"):
    letters = "".join(random.Random(seed).choices("ACGT", k=n))
    path.mkdir(exist_ok=True)
    (path / f"{name}.fa").write_bytes((f">{name} some words{end}" + end.join(letters[i : i + 50] for i in range(0, n, 50)) + end).encode())
    return letters


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blocks_equal_whole_files(spark, tmp_path, end):
    seqs = {name: chromosome(tmp_path / "c", name, n, n, end) for name, n in (("a", 12_345), ("b", 50), ("c", 7))}
    r = random.Random(1)
    rows = [(i, c := r.choice("abc"), s := r.randrange(len(seqs[c])), min(len(seqs[c]), s + r.randint(1, 900)), r.choice("+-")) for i in range(60)]
    regions = spark.createDataFrame(rows, "rank long, chrom string, rs long, re long, strand string")
    own = readers.chromosome_blocks(spark, str(tmp_path / "c"), regions, lines=4)
    got = {x["rank"]: x["seq"] for x in readers.extract_regions(regions, own).collect()}
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got == {i: seqs[c][a:b] if d == "+" else turn(seqs[c][a:b]) for i, c, a, b, d in rows}
    whole = readers.read_chromosomes(spark, str(tmp_path / "c")) if end == "\n" else None
    if whole is not None:
        assert got == {x["rank"]: x["seq"] for x in readers.extract_regions(regions, whole).collect()}


def test_only_the_blocks_that_regions_touch_are_read(spark, tmp_path):
    letters = chromosome(tmp_path / "c", "a", 5000, 3)
    with open(tmp_path / "c" / "a.fa", "r+b") as f:
        f.truncate(4 << 30)  # what follows are zeros, which no reader of lines takes
    regions = spark.createDataFrame([(0, "a", 120, 180, "+")], "rank long, chrom string, rs long, re long, strand string")
    own = readers.chromosome_blocks(spark, str(tmp_path / "c"), regions, lines=10)
    assert own.count() == 10
    assert readers.extract_regions(regions, own).first()["seq"] == letters[120:180]


def test_faults_of_chromosome_files(spark, tmp_path):
    chromosome(tmp_path / "c", "a", 500, 3)
    (tmp_path / "c" / "short.fa").write_text(">short\nACGT\nACGT\nACGT\n")
    (tmp_path / "c" / "bare.fa").write_text("ACGT\n")
    region = lambda c: spark.createDataFrame([(0, c, 1, 60, "+")], "rank long, chrom string, rs long, re long, strand string")
    for name, said in (("short", "other than 50"), ("bare", "no header")):
        with pytest.raises(Exception, match=said):
            readers.chromosome_blocks(spark, str(tmp_path / "c"), region(name)).collect()
    with pytest.raises(Exception, match="nowhere"):
        readers.extract_regions(region("nowhere"), readers.chromosome_blocks(spark, str(tmp_path / "c"), region("nowhere"))).collect()
    assert readers._ranged("viewfs://store/x") is None


def test_listed_files_joined_in_order_are_one_file(spark, tmp_path):
    lines = spark.range(2000).select(((F.col("id") * 7919) % 2000).alias("rank")).select("rank", F.concat(F.lit("line "), F.col("rank").cast("string")).alias("line")).repartition(7)
    out = f"{tmp_path}/out"
    writers.write_ordered(lines, out, ["rank"])
    parts = writers.listed_parts(spark, out).collect()
    data = [(tmp_path / "out" / p["file"]).read_text() for p in parts]
    assert "".join(data) == "".join(f"line {i}\n" for i in range(2000))
    assert [p["bytes"] for p in parts] == [len(d) for d in data] and [p["lines"] for p in parts] == [d.count("\n") for d in data]
    assert [p["first"] for p in parts] == [sum(d.count("\n") for d in data[:k]) for k in range(len(data))]
    with open(tmp_path / "out" / parts[-1]["file"], "a") as f:
        f.write("more\n")
    with pytest.raises(Exception, match="not as it was written"):
        writers.listed_parts(spark, out).collect()


def test_a_failed_write_lists_nothing(spark, tmp_path):
    lines = spark.range(100).select(F.col("id").alias("rank"), F.when(F.col("id") == 70, F.raise_error(F.lit("lost"))).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="lost"):
        writers.write_ordered(lines, f"{tmp_path}/out", ["rank"])
    assert not (tmp_path / "out.parts").exists() and not list((tmp_path / "out").glob("part-*"))
