"""The four programs: events per region, structure, motif discovery, and simulated data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmotif.functions.seq import i2mer, mer2i
from clipmotif.functions.seq import kmers as kmers_of
from clipmotif.operators import checks, em, intervals, kmers, lineage, reads
from clipmotif.operators import blocks as block_ops
from clipmotif.operators import de as de_ops


def extract_events(lines: DataFrame, regions: DataFrame, mapper: str = "rmap", protocol: str = "iCLIP") -> DataFrame:
    """Rows (rank, counts): cross-link events of mapped reads by region and position, regions without events included."""
    found = reads.events(reads.parse_reads(lines, mapper), protocol, mapper)
    return intervals.dense_pile_up(found, regions, mirror=protocol != "iCLIP")


@dataclass
class Motif:
    """A fitted motif: its number, model, and per sequence the best site and the probability to have one."""

    number: int
    model: em.Model
    sites: DataFrame


def _observed(seqs: DataFrame, width: int, block_size: int, is_long: Column | None) -> DataFrame:
    """``kmers.observed`` by blocks; sequences that have several, if any, are told by ``is_long``."""
    found = block_ops.observed(block_ops.site_blocks(seqs, width, block_size), width)
    found = found.select(i2mer(width, F.col("number")).alias("kmer"), "observed")
    if is_long is None:
        return found
    return found.unionByName(kmers.observed(seqs.where(is_long), width)).groupBy("kmer").agg(F.sum("observed").alias("observed"))


def _masked_long(seqs: DataFrame, blocks: DataFrame, model: em.Model, block_size: int) -> DataFrame:
    """``blocks.masked`` of sequences of several blocks."""
    best = block_ops.best_sites(blocks.where("NOT whole"), em.term(model), block_size)
    own = seqs.withColumn("was", F.col("seq"))
    own = em.mask_sites(own, best, model.width).join(best, "seq_id", "left")
    names = lambda c: F.array_distinct(F.transform(kmers_of(F.col(c), model.width), lambda w: w["kmer"]))
    gone = F.filter(F.array_except(names("was"), names("seq")), lambda w: ~w.rlike("[^ACGT]"))
    under = F.when(F.col("q") >= em.OCCURS, mer2i(F.upper(F.substring("was", F.col("site") + 1, F.lit(model.width))), model.width))
    return own.select("seq_id", "seq", "site", "z", "q", under.cast("int").alias("under"), F.transform(gone, lambda w: mer2i(w, model.width).cast("int")).alias("lost"))


def _without(whole: dict[str, float], rows: DataFrame, width: int) -> dict[str, float]:
    """Base counts less the letters of the k-mers ``under`` the masked sites."""
    own = rows.groupBy("under").agg(F.count("*").alias("n")).select("n", i2mer(width, F.col("under")).alias("kmer"))
    gone = own.agg(*[F.sum(F.col("n") * (width - F.length(F.replace("kmer", F.lit(b), F.lit(""))))).alias(b) for b in "ACGT"]).first()
    return whole | {b: whole[b] - float(gone[b] or 0) for b in "ACGT"}


def discover_motifs(
    seqs: DataFrame, width: int = 6, motifs: int = 10, starts: int = 10, structure: DataFrame | None = None, counts: DataFrame | None = None,
    delta: int | None = None, fit_geometry: bool = False, weight: float = de_ops.WEIGHT, epsilon: float = 0.0, rounds: int = em.MAX_ROUNDS,
    block_size: int = block_ops.SIZE,
) -> list[Motif]:
    """Motifs of ``seqs(seq_id, seq)``, the likeliest first; optionally with structure (seq_id, ss) and events (seq_id, counts).

    For each motif the most enriched k-mers of the masked sequences are fitted together; the one with the
    greatest likelihood on the unmasked sequences (first of equal ones) is the motif, and its occurrences are
    masked for the next.  Sequences shorter than the width are left out.  A given ``delta`` is held.  With
    ``fit_geometry`` how events spread is fitted in every round.

    Nothing is counted anew for a motif: the k-mers' counts lose those of windows that a masked site touches, base
    counts lose the masked letters, and the histogram of lengths stays.  A round of all starts is one pass over the
    blocks of the masked sequences.  Masked sequences, counts and sites are checkpointed, so that a lost executor costs
    one motif's work at most.
    """
    checks.require_parameters(width, epsilon, delta)
    own = seqs.where(F.length("seq") >= width)
    if structure is not None:
        own = checks.require_shapes(own, structure.join(own.select("seq_id"), "seq_id", "left_semi"), "ss", "structure")
    if counts is not None:
        own = checks.require_shapes(own, counts.join(own.select("seq_id"), "seq_id", "left_semi"), "counts", "events")
        own = own.withColumn("d", de_ops.normalise(F.col("counts"), epsilon)).drop("counts")
    columns = ["seq_id", "seq", *[c for c in ("ss", "d") if c in own.columns]]
    p = 0.5 if fit_geometry else de_ops.GEO_P
    live = fit_geometry and counts is not None
    tabled = len(columns) == 2 and width <= block_ops.CODED
    own = own.select(*columns).repartition("seq_id")
    if len(columns) == 2:  # filters go down to where sequences are made, which would be made twice then
        masked = lineage.cut(seqs.select(*columns).repartition("seq_id")).where(F.length("seq") >= width)
    else:
        masked = lineage.cut(de_ops.with_logs(own, p, weight) if counts is not None and not live else own)
    original = em.totals(em.base_counts(masked))
    letters = masked.agg(F.sum(F.length("seq"))).first()[0] or 0
    lengths = lineage.cut(kmers.lengths_of(masked))
    is_long = F.length("seq") > block_size + width - 1
    several = tabled and masked.where(is_long).limit(1).count() > 0
    counted = lineage.cut(_observed(masked, width, block_size, is_long if several else None) if tabled else kmers.observed(masked, width))
    whole, found = original, []
    for number in range(motifs):
        shares = {b: whole[b] / letters if letters else 0.0 for b in "ACGT"}
        seeds = kmers.best(kmers.scored(counted, lengths, shares, width), starts).collect()
        if not seeds:
            break
        models = [em.seed_model(i, r["kmer"], int(original["n"]), r["observed"], structure is not None, p, delta or 0) for i, r in enumerate(seeds)]
        if live:
            blocks, dealt = None, masked.repartition("seq_id").persist(StorageLevel.MEMORY_AND_DISK)
            fitted = em.fit(None, em.base_counts(dealt), models, rounds, opt_delta=delta is None, live=dealt, weight=weight)
        else:
            blocks = dealt = block_ops.site_blocks(masked, width, block_size).persist(StorageLevel.MEMORY_AND_DISK)
            fitted = em.fit(blocks, None, models, rounds, opt_delta=delta is None, block_size=block_size)
        # likelihoods on the unmasked sequences, by the sites of the last round; the first of equal ones counts
        scored = [(em.log_likelihood(m, m.sums, original), -m.start, m) for m in fitted if m.sums]
        if scored:
            ll, _, model = max(scored, key=lambda x: x[:2])
            if tabled:
                rows = block_ops.masked(blocks, em.term(model.prior), em.OCCURS)
                if several:
                    rows = rows.unionByName(_masked_long(masked.where(is_long), blocks, model.prior, block_size))
                rows = lineage.cut(rows)
                sites = rows.select("seq_id", "site", "z", "q")
            else:
                best = em.best_sites(dealt, model.prior, p=model.prior.p, weight=weight) if live else block_ops.best_sites(blocks, em.term(model.prior), block_size)
                sites = lineage.cut(best)
            found.append(Motif(number, em.replace(model, ll=ll), sites))
            if number < motifs - 1:
                if tabled:
                    masked = rows.select("seq_id", "seq")
                    gone = rows.select(F.explode("lost").alias("number")).groupBy("number").agg(F.count("*").alias("lost"))
                    gone = gone.select(i2mer(width, F.col("number")).alias("kmer"), "lost")
                    whole = _without(whole, rows.where("under IS NOT NULL"), width)
                else:
                    before, masked = masked, lineage.cut(em.mask_sites(masked, sites, width))
                    gone = kmers.lost(before, masked, sites.where(F.col("q") >= em.OCCURS), width)
                left = F.col("observed") - F.coalesce("lost", F.lit(0))
                counted = lineage.cut(counted.join(gone, "kmer", "left").select("kmer", left.alias("observed")).where("observed > 0"))
                if not tabled:
                    whole = em.totals(em.base_counts(masked))
        dealt.unpersist()
        if not scored:
            break
    return sorted(found, key=lambda x: (-x.model.ll, x.number))
