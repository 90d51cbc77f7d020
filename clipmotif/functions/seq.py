"""Scalar functions on nucleotide sequences, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipmotif.functions.prob import let

BASES = "ACGT"


def normalise(text: Column) -> Column:
    """The nucleotides of a text: only A, C, G, T, U in either case, in upper case and with T for U."""
    return F.replace(F.upper(F.regexp_replace(text, "[^ACGTUacgtu]+", "")), F.lit("U"), F.lit("T"))


def base2int(base: Column) -> Column:
    """A, C, G, T (or U) as 0 to 3 in either case, anything else 4."""
    own = F.upper(base)
    return F.when(own == "A", 0).when(own == "C", 1).when(own == "G", 2).when(own.isin("T", "U"), 3).otherwise(4)


def i2mer(k: int, number: Column) -> Column:
    """The k-mer with the given number, base 4, first base most significant."""
    return F.concat(*[F.substring(F.lit(BASES), ((number / 4 ** (k - 1 - i)).cast("long") % 4 + 1).cast("int"), F.lit(1)) for i in range(k)])


def mer2i(kmer: Column, k: int) -> Column:
    """The number of a k-mer over A, C, G, T; null if it has another letter or length."""
    digits = F.translate(kmer, BASES, "0123")
    number = F.conv(digits, 4, 10).cast("long")
    return F.when((F.length(kmer) == k) & ~kmer.rlike("[^ACGT]"), number)


def reverse_complement(seq: Column) -> Column:
    """The complement read backwards; letters other than A, C, G, T stay."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def pad(seq: Column, n: int) -> Column:
    """The sequence with n N's on either side."""
    return F.concat(F.lit("N" * n), seq, F.lit("N" * n))


def mask(seq: Column, site: Column, width: int) -> Column:
    """The sequence with N's over ``width`` bases from the zero-based site."""
    return F.overlay(seq, F.lit("N" * width), (site + 1).cast("int"), F.lit(width))


def replace_n(seq: Column, key: Column, seed: int = 0) -> Column:
    """The sequence with a uniform random base for every N, the same for every run.

    The base at a position depends on seed, key and position alone, so that partitioning cannot change it.
    """
    letters = F.split(seq, "")
    drawn = lambda c, i: F.when(F.upper(c) == "N", F.substring(F.lit(BASES), (F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(4)) + 1).cast("int"), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(letters, drawn), "")


def kmers(seq: Column, k: int) -> Column:
    """Array of structs (pos, kmer) of all windows of k letters, positions from zero; empty for shorter sequences.

    Windows are cut out of the sequence's bytes: a part of a text is found by walking there from its start.
    """
    last = F.length(seq) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return let(seq.cast("binary"), lambda b: F.transform(at, lambda i: F.struct(i.alias("pos"), F.substring(b, i + 1, F.lit(k)).cast("string").alias("kmer"))))


def same_text(a: Column, b: Column) -> Column:
    """Equality without regard to case."""
    return F.lower(a) == F.lower(b)
