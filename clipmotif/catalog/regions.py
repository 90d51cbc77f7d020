"""Queries on regions, reads and events: parsing, interval joins, pile-ups, peaks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmotif.catalog.adapters import EVENTS, MISMATCHES, PLUS, READ, REGIONS, SEQS, events, read_lines, regions, seqs, table
from clipmotif.functions.prob import let
from clipmotif.operators import checks, intervals, lineage, reads
from clipmotif.plans import programs
from clipmotif.sources import readers, writers
from clipmotif.streaming import events as stream


def novoalign_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.parse_reads(read_lines(spark, sf_dir, "novoalign"), "novoalign")


def bowtie_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.parse_reads(read_lines(spark, sf_dir, "bowtie"), "bowtie")


def rmap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.parse_reads(read_lines(spark, sf_dir, "rmap"), "rmap")


def read_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = novoalign_parse(spark, sf_dir).select("name", F.explode(reads.edits(F.col("mm"))).alias("e"))
    return own.select("name", "e.*")


def iclip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.events(novoalign_parse(spark, sf_dir), "iCLIP")


def hclip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.events(novoalign_parse(spark, sf_dir), "hCLIP")


def pclip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.events(novoalign_parse(spark, sf_dir), "pCLIP")


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the reads among lines of which some are comments, headers, tracks or blank."""
    lines = read_lines(spark, sf_dir, "rmap")
    return lines.where(reads.is_record(F.col("line"))).select(F.get(reads.tokens(F.col("line")), 3).alias("name"))


def protocol_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the same reads by the rules of every protocol."""
    found = None
    for protocol in ("iCLIP", "hCLIP", "pCLIP"):
        own = reads.events(novoalign_parse(spark, sf_dir), protocol).select(F.lit(protocol).alias("protocol"), "chrom", "st", "en", "name", "strand")
        found = own if found is None else found.unionByName(own)
    return found


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(events(spark, sf_dir), regions(spark, sf_dir)).select("event_id", "rank", "chrom", "st", "rs", "re")


def interval_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("event_id", "chrom", F.col("en").alias("pos"))
    return intervals.stab(own, regions(spark, sf_dir)).select("event_id", "rank")


def event_pile_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pile_up(events(spark, sf_dir), regions(spark, sf_dir))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every region by position, as the lines that are written."""
    return writers.count_lines(intervals.dense_pile_up(events(spark, sf_dir), regions(spark, sf_dir)))


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.bucket_counts(events(spark, sf_dir), regions(spark, sf_dir))


def extract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From mapped reads to event counts of every region."""
    found = programs.extract_events(read_lines(spark, sf_dir, "novoalign"), regions(spark, sf_dir), "novoalign", "pCLIP")
    return found.select("rank", F.array_join(F.transform("counts", lambda x: x.cast("string")), ", ").alias("line"))


def region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.order_faults(regions(spark, sf_dir))


def region_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.expand(regions(spark, sf_dir), 20)


def peak_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = regions(spark, sf_dir).withColumn("rs", F.col("rs") % 500)
    return intervals.peak_regions(own.withColumn("re", F.col("rs") + 40))


def peak_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000 / 1000).alias("p_value"))
    return intervals.loosest_cutoff(own, [0.5, 0.1, 0.05, 0.01, 0.005, 0.001], 5000)


def peak_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.suppress_neighbours(regions(spark, sf_dir), 120)


def region_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of every sequence, cut out of lines of 50 letters; every third on the minus strand."""
    own = seqs(spark, sf_dir).where(F.length("seq") >= 120)
    start = (F.col("seq_id") * 13) % (F.length("seq") - 100)
    places = own.select(F.col("seq_id").alias("rank"), F.col("seq_id").cast("string").alias("chrom"), start.alias("rs"), (start + 100).alias("re"), F.when(F.col("seq_id") % 3 == 0, "-").otherwise("+").alias("strand"))
    return readers.extract_regions(places, _chromosomes(spark, sf_dir))


def _chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, line_no, seq): every sequence as a chromosome in lines of 50 letters."""
    own = seqs(spark, sf_dir).where(F.length("seq") >= 120)
    at = F.sequence(F.lit(0), F.expr("cast((length(seq) - 1) div 50 AS int)"))
    cut = let(F.col("seq").cast("binary"), lambda b: F.transform(at, lambda i: F.substring(b, i * 50 + 1, F.lit(50)).cast("string")))
    return own.select("seq_id", F.posexplode(cut).alias("line_no", "line")).select(F.col("seq_id").cast("string").alias("chrom"), F.col("line_no").cast("long").alias("line_no"), F.col("line").alias("seq"))


def region_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of every sequence, widened by 10, in the order of chromosome and start."""
    own = seqs(spark, sf_dir).where(F.length("seq") >= 120)
    start = 10 + (F.col("seq_id") * 13) % (F.length("seq") - 100)
    line = F.concat_ws("\t", F.col("seq_id").cast("string"), start.cast("string"), (start + 60).cast("string"), F.lit("x"), F.lit("1"), F.when(F.col("seq_id") % 3 == 0, "-").otherwise("+"))
    regions_ = readers.parse_bed(own.select(F.col("seq_id").alias("rank"), line.alias("line")), rename=True)
    found = readers.region_sequences(regions_, _chromosomes(spark, sf_dir), 10)
    return found.select("seq_id", "name", "chrom", F.md5(F.col("seq").cast("binary")).alias("seq"), F.col("len").cast("long").alias("len"))


def chromosome_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are too short, as every seventh chromosome's first is made here; headers anchor the numbers."""
    own = _chromosomes(spark, sf_dir)
    spoilt = F.when((F.col("chrom").cast("long") % 7 == 0) & (F.col("line_no") == 0), F.expr("substring(seq, 1, 49)")).otherwise(F.col("seq"))
    lines = own.select("chrom", (F.col("line_no") + 6).alias("at"), spoilt.alias("seq"))
    heads = own.where("line_no = 0").select("chrom", F.lit(5).cast("long").alias("at"), F.concat(F.lit(">"), "chrom").alias("seq"))
    return readers.short_lines(readers.chromosome_lines(lines.unionByName(heads))).select("chrom", "line_no", "seq")


def stream_pile_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every region by position, kept up to date while the lines of reads arrive as files."""
    folder = f"{lineage.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    read_lines(spark, sf_dir, "rmap").write.text(f"{folder}/in")
    lines = spark.readStream.text(f"{folder}/in").withColumnRenamed("value", "line")

    def sink(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    own = stream.stream_counts(lines, regions(spark, sf_dir))
    stream.write_counts(own, sink, f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("rank", "pos").agg(F.max_by("n", "batch").alias("n"))


def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as BED lines, parsed and renamed by their order."""
    own = regions(spark, sf_dir).select("rank", F.concat_ws("\t", "chrom", F.col("rs").cast("string"), F.col("re").cast("string"), F.lit("peak"), F.lit("5"), "strand").alias("line"))
    return readers.parse_bed(own, rename=True)


def region_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose made-up sequence has another width than they have."""
    own = regions(spark, sf_dir).withColumn("name", F.col("rank").cast("string"))
    made = own.select("name", F.expr("repeat('A', cast(re - rs - if(rank % 10 = 0, 1, 0) AS int))").alias("seq"))
    return checks.region_faults(made, own)


QUERIES = {
    f.__name__: f
    for f in (
        novoalign_parse, bowtie_parse, rmap_parse, read_edits, record_lines, protocol_events, iclip_events, hclip_events, pclip_events, interval_join, interval_stab, event_pile_up, event_counts,
        bucket_counts, extract_events, region_order, region_expand, peak_regions, peak_cutoff, peak_suppress, region_sequences, region_load, chromosome_check, stream_pile_up, bed_lines, region_widths,
    )
}

_N = len(READ)
_MIN = "epoch_us(ts) // 60000000"
_NOVO = f"""nv AS (SELECT event_type AS chrom, {_MIN} AS start, {_MIN} + {_N} AS "end", 'r' || event_id::VARCHAR AS name, (event_id % 60)::DOUBLE AS score,
  CASE WHEN {PLUS} THEN '+' ELSE '-' END AS strand, '{READ}' AS seq, {MISMATCHES} AS mm FROM events WHERE event_id % 5 <> 0)"""
_EDITS = f"""{_NOVO}, ed AS (SELECT name, chrom, start, strand, mm, unnest(CASE WHEN mm = '' THEN [] ELSE string_split(mm, ' ') END) AS e FROM nv),
  ee AS (SELECT *, regexp_extract(e, '^[0-9]+')::INTEGER AS position, regexp_replace(e, '^[0-9]+', '') AS rest FROM ed),
  es AS (SELECT *, CASE WHEN contains(rest, '>') THEN 'mutation' WHEN rest[1] = '+' THEN 'insertion' ELSE 'deletion' END AS type FROM ee),
  et AS (SELECT *, CASE type WHEN 'mutation' THEN split_part(rest, '>', 1) WHEN 'deletion' THEN rest[2:] ELSE '' END AS ref_base,
    CASE type WHEN 'mutation' THEN split_part(rest, '>', 2) WHEN 'insertion' THEN rest[2:] ELSE '' END AS read_base FROM es)"""
_ONE = f"{_EDITS}, one AS (SELECT * FROM et WHERE name IN (SELECT name FROM et GROUP BY name HAVING count(*) = 1))"
_AT = "start + position - CASE WHEN strand = '-' THEN 1 ELSE 2 END"


def _single(plus: str, minus: str) -> str:
    return f"""SELECT chrom, {_AT} AS st, {_AT} + 1 AS en, name, strand FROM one WHERE CASE WHEN strand = '-' THEN {minus} ELSE {plus} END"""


_DEL = "type = 'deletion' AND ref_base = "
_PILE = """pile AS (SELECT rank, CASE WHEN strand = '-' THEN re - rs - 1 - (st - rs) ELSE st - rs END AS pos, count(*) AS n
  FROM ev JOIN rg ON ev.chrom = rg.chrom AND re > st AND rs < en WHERE st >= rs GROUP BY ALL)"""
_DENSE = """SELECT rank, string_agg(coalesce(n, 0)::VARCHAR, ', ' ORDER BY pos) AS line
  FROM (SELECT rank, unnest(range(0, re - rs)) AS pos FROM rg) LEFT JOIN pile USING (rank, pos) GROUP BY rank"""

SQL = {
    "region_load": f"""WITH {SEQS}, p AS (SELECT seq_id, 10 + (seq_id * 13) % (length(seq) - 100) AS rs, seq FROM seqs WHERE length(seq) >= 120),
  c AS (SELECT *, substr(seq, rs - 9, 80) AS s FROM p)
  SELECT row_number() OVER (ORDER BY seq_id::VARCHAR, rs, seq_id) - 1 AS seq_id, 'sequence_' || (seq_id + 1)::VARCHAR AS name, seq_id::VARCHAR AS chrom,
  md5(CASE WHEN seq_id % 3 = 0 THEN translate(reverse(s), 'ACGT', 'TGCA') ELSE s END) AS seq, length(s) AS len FROM c""",
    "chromosome_check": f"WITH {SEQS} SELECT seq_id::VARCHAR AS chrom, 0::BIGINT AS line_no, substr(seq, 1, 49) AS seq FROM seqs WHERE length(seq) >= 120 AND seq_id % 7 = 0",
    "stream_pile_up": f"WITH {EVENTS}, {REGIONS} SELECT rank, st - rs AS pos, count(*) AS n FROM ev JOIN rg ON ev.chrom = rg.chrom AND re > st AND rs < en WHERE st >= rs GROUP BY ALL",
    "peak_suppress": f"""WITH RECURSIVE {REGIONS}, st AS MATERIALIZED (SELECT chrom, rs, min(rank) AS rank FROM rg GROUP BY chrom, rs),
  nx AS MATERIALIZED (SELECT a.chrom, a.rs, b.rs AS next, b.rank FROM st a ASOF JOIN st b ON a.chrom = b.chrom AND a.rs + 120 < b.rs),
  walk AS (SELECT chrom, min(rs) AS rs, arg_min(rank, rs) AS rank FROM st GROUP BY chrom UNION ALL SELECT chrom, nx.next, nx.rank FROM walk JOIN nx USING (chrom, rs))
  SELECT chrom, rs, rank FROM walk""",
    "novoalign_parse": f'WITH {_NOVO} SELECT * FROM nv',
    "bowtie_parse": f"""SELECT event_type AS chrom, {_MIN} + 1 AS start, {_MIN} + 1 + {_N} AS "end", 'r' || event_id::VARCHAR AS name, (event_id % 7)::DOUBLE AS score,
  CASE WHEN {PLUS} THEN '+' ELSE '-' END AS strand, '{READ}' AS seq, CASE event_id % 4
    WHEN 1 THEN (CASE WHEN {PLUS} THEN event_id % 20 + 1 ELSE {_N} - event_id % 20 END)::VARCHAR || 'T>C'
    WHEN 2 THEN (CASE WHEN {PLUS} THEN event_id % 9 + 1 ELSE {_N} - event_id % 9 END)::VARCHAR || 'A>G ' || (CASE WHEN {PLUS} THEN event_id % 9 + 11 ELSE {_N} - 10 - event_id % 9 END)::VARCHAR || 'T>C'
    ELSE '' END AS mm FROM events""",
    "rmap_parse": f"""SELECT event_type AS chrom, {_MIN} AS start, {_MIN} + {_N} AS "end", 'r' || event_id::VARCHAR AS name, (event_id % 3)::DOUBLE AS score,
  CASE WHEN {PLUS} THEN '+' ELSE '-' END AS strand, CASE WHEN event_id % 2 = 0 THEN '{READ}' ELSE 'NA' END AS seq, CASE WHEN event_id % 2 = 0 THEN 'IIII' ELSE 'NA' END AS mm FROM events""",
    "read_edits": f"WITH {_EDITS} SELECT name, type, position, ref_base, read_base FROM et",
    "iclip_events": f"""WITH {_EDITS} SELECT chrom, start AS st, start + 1 AS en, name, strand FROM nv WHERE name NOT IN
  (SELECT name FROM et WHERE type = 'deletion' AND ref_base = CASE WHEN strand = '-' THEN 'A' ELSE 'T' END)""",
    "hclip_events": f"WITH {_ONE} " + _single(_DEL + "'T'", _DEL + "'A'"),
    "pclip_events": f"WITH {_ONE} " + _single("rest = 'T>C'", "rest = 'A>G'"),
    "interval_join": f"WITH {EVENTS}, {REGIONS} SELECT event_id, rank, ev.chrom, st, rs, re FROM ev JOIN rg ON ev.chrom = rg.chrom AND re > st AND rs < en",
    "interval_stab": f"WITH {EVENTS}, {REGIONS} SELECT event_id, rank FROM ev JOIN rg ON ev.chrom = rg.chrom AND en BETWEEN rs AND re",
    "event_pile_up": f"WITH {EVENTS}, {REGIONS}, {_PILE} SELECT rank, pos, n FROM pile",
    "event_counts": f"WITH {EVENTS}, {REGIONS}, {_PILE} {_DENSE}",
    "bucket_counts": f"WITH {EVENTS}, {REGIONS} SELECT rank, count(event_id) AS n FROM rg LEFT JOIN ev ON ev.chrom = rg.chrom AND re > st AND rs < en GROUP BY rank",
    "extract_events": f"WITH {_ONE}, ev AS ({_single("rest = 'T>C'", "rest = 'A>G'")}), {REGIONS}, {_PILE.replace("CASE WHEN strand", "CASE WHEN rg.strand")} {_DENSE}",
    "region_order": f"""WITH {REGIONS} SELECT a.rank, a.chrom, a.rs, a.re, max(b.re) AS reach FROM rg a JOIN rg b ON a.chrom = b.chrom AND a.rank <> b.rank
  AND b.re > a.rs AND b.rs < a.re AND (b.rs < a.rs OR b.rs = a.rs AND b.rank < a.rank) GROUP BY ALL""",
    "region_expand": f"WITH {REGIONS} SELECT rank, chrom, rs - 20 AS rs, re + 20 AS re, strand FROM rg",
    "peak_regions": f"""WITH {REGIONS} SELECT rank, chrom, (rs % 500 * 2 + 40) // 2 - 150 AS rs, (rs % 500 * 2 + 40) // 2 + 150 AS re, strand FROM rg WHERE (rs % 500 * 2 + 40) // 2 - 150 > 0""",
    "peak_cutoff": """WITH n AS (SELECT c::DOUBLE AS cutoff, (SELECT count(*) FROM orders WHERE o_orderkey % 1000 / 1000 <= c) AS n FROM unnest([0.5, 0.1, 0.05, 0.01, 0.005, 0.001]) t(c))
  SELECT cutoff, n FROM n WHERE n < 5000 ORDER BY cutoff DESC LIMIT 1""",
    "region_sequences": f"""WITH {SEQS}, p AS (SELECT seq_id AS rank, substr(seq, (seq_id * 13) % (length(seq) - 100) + 1, 100) AS s FROM seqs WHERE length(seq) >= 120)
  SELECT rank, CASE WHEN rank % 3 = 0 THEN translate(reverse(s), 'ACGT', 'TGCA') ELSE s END AS seq FROM p""",
    "bed_lines": f"WITH {REGIONS} SELECT rank, chrom, rs, re, 'sequence_' || (rank + 1)::VARCHAR AS name, 5.0::DOUBLE AS score, strand FROM rg",
    "region_widths": f"WITH {REGIONS} SELECT rank::VARCHAR AS name, (re - rs - 1)::INTEGER AS len, re - rs AS width FROM rg WHERE rank % 10 = 0",
}
SQL["record_lines"] = "SELECT 'r' || event_id::VARCHAR AS name FROM events"
SQL["protocol_events"] = " UNION ALL ".join(f"SELECT '{p}' AS protocol, chrom, st, en, name, strand FROM ({SQL[p.lower() + '_events']})" for p in ("iCLIP", "hCLIP", "pCLIP"))
