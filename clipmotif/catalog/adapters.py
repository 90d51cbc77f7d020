"""Sequences, regions, reads and events made of the synthetic tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmotif.functions import seq


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """(seq_id, seq): the nucleotide letters of every text."""
    return table(spark, sf_dir, name).select(F.col(key).alias("seq_id"), seq.normalise(F.coalesce("text", F.lit(""))).alias("seq"))


SEQS = "seqs AS (SELECT doc_id AS seq_id, replace(upper(regexp_replace(coalesce(text, ''), '[^ACGTUacgtu]', '', 'g')), 'U', 'T') AS seq FROM documents)"


def windows_sql(k: int) -> str:
    return f"windows AS (SELECT seq_id, pos, substr(seq, pos + 1, {k}) AS kmer FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - {k - 1}))::INTEGER AS pos FROM seqs))"


def structure(length: Column) -> Column:
    """A stand-in for pairing probabilities, by position and sequence."""
    at = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: ((i * 37 + F.col("seq_id")) % 101) / 100)


def counts(length: Column) -> Column:
    """A stand-in for event counts, by position and sequence."""
    at = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: (F.col("seq_id") * 31 + i * 17) % 5)


def minute() -> Column:
    """Minutes since 1970 of a time without a zone."""
    return (F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) * 1440 + F.hour("ts") * 60 + F.minute("ts")).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, chrom, st, en): every event as an interval of one minute."""
    own = table(spark, sf_dir, "events")
    return own.select("event_id", F.col("event_type").alias("chrom"), minute().alias("st"), (minute() + 1).alias("en"))


EVENTS = "ev AS (SELECT event_id, event_type AS chrom, epoch_us(ts) // 60000000 AS st, epoch_us(ts) // 60000000 + 1 AS en FROM events)"
SPAN = "span AS (SELECT min(epoch_us(ts) // 60000000) AS lo, max(epoch_us(ts) // 60000000) AS hi FROM events)"
TYPES = "types AS (SELECT event_type AS chrom, row_number() OVER (ORDER BY event_type) - 1 AS no, count(*) OVER () AS n FROM (SELECT DISTINCT event_type FROM events))"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, chrom, rs, re, strand): a region of 21 to 80 minutes for every customer, spread over the events' time."""
    own = table(spark, sf_dir, "events")
    span = own.agg(F.min(minute()).alias("lo"), F.max(minute()).alias("hi"))  # one row
    kinds = own.select("event_type").distinct().agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))  # one row of few types
    k = F.col("c_custkey")
    start = F.col("lo") + (k * 7919) % (F.col("hi") - F.col("lo") + 1)
    made = table(spark, sf_dir, "customer").join(F.broadcast(span)).join(F.broadcast(kinds))
    return made.select(k.alias("rank"), F.get("kinds", (k % F.size("kinds")).cast("int")).alias("chrom"), start.alias("rs"), (start + 21 + k % 60).alias("re"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


REGIONS = f"""{SPAN}, {TYPES}, rg AS (SELECT c_custkey AS rank, t.chrom, lo + (c_custkey * 7919) % (hi - lo + 1) AS rs,
  lo + (c_custkey * 7919) % (hi - lo + 1) + 21 + c_custkey % 60 AS re, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM customer, span JOIN types t ON c_custkey % t.n = t.no)"""


def mismatches() -> Column:
    """Edits of a made-up read by its event number, in the form "12T>C 9+AC 5-T"."""
    e = F.col("event_id")
    return (
        F.when(e % 8 == 0, "").when(e % 8 == 1, F.concat((e % 20 + 1).cast("string"), F.lit("T>C"))).when(e % 8 == 2, F.concat((e % 20 + 1).cast("string"), F.lit("-T")))
        .when(e % 8 == 3, F.concat((e % 20 + 1).cast("string"), F.lit("+AC"))).when(e % 8 == 4, F.concat((e % 20 + 1).cast("string"), F.lit("-A")))
        .when(e % 8 == 5, F.concat((e % 20 + 1).cast("string"), F.lit("A>G"))).when(e % 8 == 6, F.concat((e % 9 + 1).cast("string"), F.lit("T>C "), (e % 9 + 11).cast("string"), F.lit("-T")))
        .otherwise("3G>A")
    )


MISMATCHES = """CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN (event_id % 20 + 1)::VARCHAR || 'T>C' WHEN 2 THEN (event_id % 20 + 1)::VARCHAR || '-T'
  WHEN 3 THEN (event_id % 20 + 1)::VARCHAR || '+AC' WHEN 4 THEN (event_id % 20 + 1)::VARCHAR || '-A' WHEN 5 THEN (event_id % 20 + 1)::VARCHAR || 'A>G'
  WHEN 6 THEN (event_id % 9 + 1)::VARCHAR || 'T>C ' || (event_id % 9 + 11)::VARCHAR || '-T' ELSE '3G>A' END"""
READ = "ACGTTGCAACGTTGCAACGTTGCA"
PLUS = "(event_id // 8) % 2 = 0"


def _plus() -> Column:
    return F.floor(F.col("event_id") / 8) % 2 == 0


def read_lines(spark: SparkSession, sf_dir: str, mapper: str) -> DataFrame:
    """(line): every event as a mapped read in a mapper's format, some with blanks after tabs; and lines that are no reads."""
    own = table(spark, sf_dir, "events")
    e3 = F.col("event_id") % 3
    text = lambda c: c.cast("string")
    name = F.concat(F.lit("r"), text(F.col("event_id")))
    start = text(minute())
    if mapper == "novoalign":
        unique = F.when(F.col("event_id") % 5 == 0, "R").otherwise("U")
        cols = [name, F.lit("S"), F.lit(READ), F.lit("IIII"), unique, text(F.col("event_id") % 60), F.lit("1"), F.concat(F.lit(">"), "event_type"), start, F.when(_plus(), "F").otherwise("R"), F.lit("."), F.lit("."), F.lit("."), mismatches()]
    elif mapper == "bowtie":
        e = F.col("event_id")
        mm = F.when(e % 4 == 1, F.concat(text(e % 20), F.lit(":T>C"))).when(e % 4 == 2, F.concat(text(e % 9), F.lit(":A>G,"), text(e % 9 + 10), F.lit(":T>C")))
        cols = [name, F.when(_plus(), "+").otherwise("-"), F.col("event_type"), start, F.lit(READ), F.lit("IIII"), text(e % 7), mm]
    else:
        e = F.col("event_id")
        cols = [F.col("event_type"), start, text(minute() + len(READ)), name, text(e % 3), F.when(_plus(), "+").otherwise("-"), F.when(e % 2 == 0, READ), F.when(e % 2 == 0, "IIII")]
    line = F.concat_ws("\t", *cols)
    loose = F.when(e3 == 0, F.concat(F.regexp_replace(line, "\t", "\t "), F.lit(" \t "))).otherwise(line)
    more = F.when(F.col("event_id") % 50 == 0, F.array(F.lit("# a comment"), F.lit("browser x"), F.lit("track name=y"), F.lit(" ")))
    return own.select(F.explode(F.concat(F.coalesce(more, F.array().cast("array<string>")), F.array(loose))).alias("line"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})
