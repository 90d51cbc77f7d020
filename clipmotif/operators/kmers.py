"""Composition, k-mer counts and enrichment of a set of sequences ``(seq_id, seq)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmotif.functions import prob
from clipmotif.functions.seq import kmers as kmers_of


def base_composition(seqs: DataFrame) -> DataFrame:
    """Rows (base, n, share) for A, C, G, T; the shares are of all letters, N's included."""
    letters = F.length("seq")
    count = lambda b: F.sum(letters - F.length(F.replace(F.upper("seq"), F.lit(b), F.lit(""))))
    totals = seqs.agg(F.sum(letters).alias("letters"), *[F.coalesce(count(b), F.lit(0)).alias(b) for b in "ACGT"])
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).cast("long").alias("n")) for b in "ACGT"]))
    return totals.select("letters", each.alias("b")).select("b.base", "b.n", (F.col("b.n") / F.col("letters")).alias("share"))


def windows(seqs: DataFrame, k: int, *more: str) -> DataFrame:
    """Rows (seq_id, pos, kmer, and the columns ``more``) of every window over A, C, G, T; those with other letters are left out.

    Windows are cut out of the sequence's bytes, so that a sequence takes time in proportion to its length.
    """
    last = F.length("seq") - k
    own = seqs.select("seq_id", *more, F.col("seq").cast("binary").alias("bytes"), F.when(last >= 0, last).alias("last")).where("last IS NOT NULL")
    own = own.select("seq_id", *more, "bytes", F.explode(F.sequence(F.lit(0), "last")).alias("pos"))
    own = own.select("seq_id", "pos", F.substring("bytes", F.col("pos") + 1, F.lit(k)).cast("string").alias("kmer"), *more)
    return own.where(~F.col("kmer").rlike("[^ACGT]"))


def observed(seqs: DataFrame, k: int) -> DataFrame:
    """Rows (kmer, observed): in how many sequences each k-mer occurs.  Each sequence sends each k-mer on once."""
    once = F.array_distinct(F.transform(kmers_of(F.col("seq"), k), lambda w: w["kmer"]))
    own = seqs.where(F.length("seq") >= k).select(F.explode(once).alias("kmer"))
    return own.where(~F.col("kmer").rlike("[^ACGT]")).groupBy("kmer").agg(F.count("*").alias("observed"))


def lost(before: DataFrame, after: DataFrame, masked: DataFrame, k: int) -> DataFrame:
    """Rows (kmer, lost): in how many sequences each k-mer of ``before`` no longer occurs ``after`` the sites (seq_id, site) were masked.

    Only the windows that touch a masked site are looked at, and only in the sequences that have one.
    """
    cut_ = F.substring("seq", F.greatest(F.col("site") - (k - 1), F.lit(0)) + 1, F.least(F.col("site"), F.lit(k - 1)) + 2 * k - 1)
    own = before.join(masked.select("seq_id", "site"), "seq_id").select("seq_id", cut_.alias("piece"))
    own = own.join(after.select("seq_id", F.col("seq").alias("now")), "seq_id")
    names = lambda c: F.transform(kmers_of(F.col(c), k), lambda w: w["kmer"])
    own = own.select(F.explode(F.array_except(names("piece"), names("now"))).alias("kmer"))
    return own.where(~F.col("kmer").rlike("[^ACGT]")).groupBy("kmer").agg(F.count("*").alias("lost"))


def lengths_of(seqs: DataFrame) -> DataFrame:
    """Rows (len, n): how many sequences have each length."""
    return seqs.where(F.length("seq") >= 0).groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("n"))


def composition(kmer: Column) -> Column:
    """A number for how many A, C and G a k-mer of A, C, G and T has."""
    count = lambda b: F.length(kmer) - F.length(F.replace(kmer, F.lit(b), F.lit("")))
    return count("A") * 10_000 + count("C") * 100 + count("G")


def expected(lengths: DataFrame, shares: dict[str, float], k: int) -> DataFrame:
    """Rows (composition, expected): in how many sequences a k-mer of a composition is expected.

    A k-mer's probability p depends on its letter counts alone, of which there are (k + 1)(k + 2)(k + 3) / 6 (455 for
    k = 12); each adds up n (1 - exp(-length p)) over the rows of the lengths' histogram where they lie.
    """
    each = [(a, c, g) for a in range(k + 1) for c in range(k + 1 - a) for g in range(k + 1 - a - c)]
    p = lambda a, c, g: shares["A"] ** a * shares["C"] ** c * shares["G"] ** g * shares["T"] ** (k - a - c - g)
    number, chance = F.lit([a * 10_000 + c * 100 + g for a, c, g in each]), F.lit([p(*x) for x in each])
    own = lengths.select("len", "n", F.posexplode(chance).alias("at", "p"))
    own = own.groupBy("at").agg(F.sum(F.col("n") * (1 - prob.poisson_zero(F.col("len") * F.col("p")))).alias("expected"))
    return own.select(F.get(number, F.col("at")).alias("composition"), "expected")


def scored(counted: DataFrame, lengths: DataFrame, shares: dict[str, float], k: int) -> DataFrame:
    """Rows (kmer, observed, expected, score) of the k-mers ``counted`` (kmer, observed)."""
    own = counted.select("kmer", "observed", composition(F.col("kmer")).alias("composition")).join(expected(lengths, shares, k), "composition")
    return own.select("kmer", "observed", "expected", (F.col("observed") / F.col("expected")).alias("score"))


def shares_of(seqs: DataFrame) -> dict[str, float]:
    """The share of each base of all letters; four numbers."""
    return {r["base"]: float(r["share"] or 0) for r in base_composition(seqs).collect()}


def enrichment(seqs: DataFrame, k: int) -> DataFrame:
    """Rows (kmer, observed, expected, score) of the k-mers that occur.

    expected sums, over the sequences, the chance 1 - exp(-length p) that a k-mer of probability p occurs.
    """
    return scored(observed(seqs, k), lengths_of(seqs), shares_of(seqs), k)


def best(scores: DataFrame, n: int) -> DataFrame:
    """The n greatest scores; ties go to the alphabetically first k-mer."""
    return scores.orderBy(F.desc("score"), "kmer").limit(n)


def top_kmers(seqs: DataFrame, k: int, n: int) -> DataFrame:
    """The n most enriched k-mers; ties go to the alphabetically first."""
    return best(enrichment(seqs, k), n)
