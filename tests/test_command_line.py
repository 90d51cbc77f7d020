"""The four commands on small files."""

from __future__ import annotations

import random

from clipmotif.__main__ import main


def lines(spark, path):
    return [x.value for x in spark.read.text(str(path)).collect()]


def test_commands(spark, tmp_path):
    r = random.Random(1)
    fasta = tmp_path / "in.fa"
    fasta.write_text("".join(f">s{i}\n{''.join(r.choices('ACGT', k=50))}\n" for i in range(40)))
    main(["simulate", str(fasta), "-o", str(tmp_path / "sim"), "-d", "3", "-i", "1.7", "--seed", "5"])
    assert len(lines(spark, tmp_path / "sim_de.dat")) == 40 and lines(spark, tmp_path / "sim_0.mat")[0] == "AC\tMOTIF0"
    made = [x for x in lines(spark, tmp_path / "sim.fa") if x]
    (tmp_path / "sim_in.fa").write_text("\n".join(made) + "\n")
    (tmp_path / "de.txt").write_text("\n".join(lines(spark, tmp_path / "sim_de.dat")) + "\n")
    main(["structure", str(tmp_path / "sim_in.fa"), "-o", str(tmp_path / "str")])
    structure = lines(spark, tmp_path / "str")
    assert len(structure) == 40 and all(x.count(",") == 50 for x in structure)
    (tmp_path / "str.txt").write_text("\n".join(structure) + "\n")
    main(["motifs", str(tmp_path / "sim_in.fa"), "-o", str(tmp_path / "out"), "-n", "1", "-s", "2", "-t", str(tmp_path / "str.txt"), "-d", str(tmp_path / "de.txt"), "-a", str(tmp_path / "ind")])
    out = lines(spark, tmp_path / "out")
    assert out[0] == "AC\tMOTIF0" and out[-1] == "//" and any(x.startswith("AT\tGEO_DELTA=") for x in out) and any(x.startswith("AT\tSEC_STR=") for x in out)
    assert len(lines(spark, tmp_path / "ind")) == 40
    (tmp_path / "r.bed").write_text("c\t10\t14\ta\t0\t+\nc\t90\t92\tb\t0\t-\n")
    (tmp_path / "reads.txt").write_text("c\t11\t30\tr\t0\t+\nc\t11\t31\tr\t0\t+\n")
    main(["events", str(tmp_path / "reads.txt"), "-r", str(tmp_path / "r.bed"), "-o", str(tmp_path / "ev")])
    assert lines(spark, tmp_path / "ev") == ["0, 2, 0, 0", "0, 0"]
