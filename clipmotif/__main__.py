"""Command line: python -m clipmotif motifs | structure | events | simulate; outputs are folders of text files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clipmotif.operators import de, fold, simulate
from clipmotif.plans import programs
from clipmotif.sources import readers, writers


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="clipmotif")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("motifs", help="discover motifs in FASTA or BED input")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-w", "--width", type=int, default=6)
    p.add_argument("-n", "--motifs", type=int, default=10)
    p.add_argument("-c", "--chromosomes")
    p.add_argument("-t", "--structure", help="file of pairing probabilities")
    p.add_argument("-d", "--events", help="file of event counts")
    p.add_argument("-l", "--delta", type=int, help="offset of the events from the motif, held fixed")
    p.add_argument("-g", "--geometry", action="store_true", help="fit how events spread")
    p.add_argument("-k", "--weight", type=float, default=de.WEIGHT)
    p.add_argument("-a", "--indicators", help="where to write the probability of each sequence to have each motif")
    p.add_argument("-s", "--starts", type=int, default=10)
    p = commands.add_parser("structure", help="pairing probabilities of FASTA or BED input")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-c", "--chromosomes")
    p = commands.add_parser("events", help="cross-link events of mapped reads by region")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-r", "--regions", required=True)
    p.add_argument("-m", "--mapper", default="rmap")
    p.add_argument("-t", "--protocol", default="iCLIP")
    p = commands.add_parser("simulate", help="plant motifs and events in FASTA input")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-s", "--share", type=float, default=1.0, help="sequences that have the motif")
    p.add_argument("-c", "--structured", type=float, default=1.0)
    p.add_argument("-t", "--type", default="unstructured", choices=simulate.STRUCTURES)
    p.add_argument("-w", "--width", type=int, default=6)
    p.add_argument("-i", "--information", type=float, default=1.7)
    p.add_argument("-d", "--events", type=int, default=0, help="events per sequence")
    p.add_argument("-n", "--noise", type=float, default=0.0)
    p.add_argument("-p", "--geometric", type=float, default=0.2)
    p.add_argument("-f", "--delta", type=int, default=0)
    p.add_argument("-m", "--motifs", type=int, default=1)
    p.add_argument("--seed", type=int, default=1)
    return parser


def _motifs(spark: SparkSession, a: argparse.Namespace) -> None:
    seqs = readers.load_sequences(spark, a.input, a.chromosomes)
    structure = readers.read_structure(spark, a.structure) if a.structure else None
    counts = readers.read_counts(spark, a.events) if a.events else None
    found = programs.discover_motifs(seqs.select("seq_id", "seq"), a.width, a.motifs, a.starts, structure, counts, a.delta, a.geometry, a.weight)
    strand = ["strand"] if "strand" in seqs.columns else []
    records, indicators = None, None
    for rank, m in enumerate(found):
        sites = m.sites.join(seqs.select("seq_id", "name", "seq", *strand), "seq_id")
        own = writers.motif_record(sites, m.model, f"MOTIF{m.number}", counts is not None).withColumn("rank", F.lit(rank))
        q = m.sites.select(F.lit(rank).alias("motif_rank"), "seq_id", "q")
        records, indicators = (own, q) if records is None else (records.unionByName(own), indicators.unionByName(q))
    if records is not None:
        writers.write_ordered(records, a.output, ["rank", "part", "seq_id"])
        if a.indicators:
            writers.write_ordered(writers.indicator_lines(indicators), a.indicators, ["motif_rank", "seq_id"])


def _structure(spark: SparkSession, a: argparse.Namespace) -> None:
    seqs = readers.load_sequences(spark, a.input, a.chromosomes, fold.PADDING)
    writers.write_ordered(writers.structure_lines(fold.structure_of(seqs.select("seq_id", "seq"))), a.output, ["seq_id"])


def _events(spark: SparkSession, a: argparse.Namespace) -> None:
    found = programs.extract_events(readers.text_lines(spark, a.input), readers.read_bed(spark, a.regions), a.mapper, a.protocol)
    writers.write_ordered(writers.count_lines(found), a.output, ["rank"])


def _simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    seqs = readers.read_fasta(spark, a.input).drop("len")
    plants = [simulate.Plant(simulate.draw_pwm(spark, a.width, a.information, a.seed + k), a.share, a.type, a.structured, a.events, a.noise, a.geometric, a.delta) for k in range(a.motifs)]
    made, counts, truth = simulate.simulate(seqs, plants, a.seed)
    writers.write_ordered(writers.fasta_lines(made), f"{a.output}.fa", ["seq_id"])
    writers.write_ordered(writers.count_lines(counts.withColumnRenamed("seq_id", "rank")), f"{a.output}_de.dat", ["rank"])
    for k, (own, plant) in enumerate(zip(truth, plants, strict=True)):
        writers.write_ordered(simulate.truth_lines(own, plant, f"MOTIF{k}"), f"{a.output}_{k}.mat", ["part", "seq_id"])


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("clipmotif").getOrCreate()
    {"motifs": _motifs, "structure": _structure, "events": _events, "simulate": _simulate}[a.command](spark, a)


if __name__ == "__main__":
    main()
