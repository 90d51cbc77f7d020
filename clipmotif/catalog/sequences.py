"""Queries on sequences: composition, k-mers, string functions, structures as text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmotif.catalog.adapters import SEQS, counts, rounded, seqs, structure, table, windows_sql
from clipmotif.functions import prob, seq
from clipmotif.operators import checks, de, fold, kmers, lineage, simulate
from clipmotif.sources import readers, writers


def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kmers.base_composition(seqs(spark, sf_dir)), "share")


def kmer_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.observed(seqs(spark, sf_dir), 4)


def kmer_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kmers.enrichment(seqs(spark, sf_dir), 4), "expected", "score")


def kmer_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kmers.top_kmers(seqs(spark, sf_dir), 6, 10), "expected", "score")


def sequence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse complement, padding and a masked site of every sequence, as digests."""
    own = seqs(spark, sf_dir).where(F.length("seq") >= 10)
    digest = lambda c: F.md5(c.cast("binary"))
    return own.select(
        "seq_id", digest(seq.reverse_complement(F.col("seq"))).alias("revcomp"), digest(seq.pad(F.col("seq"), 20)).alias("padded"),
        digest(seq.mask(F.col("seq"), F.col("seq_id") % (F.length("seq") - 5), 6)).alias("masked"), seq.base2int(F.substring("seq", 1, 1)).alias("first_code"),
        seq.same_text(F.substring("seq", 1, 1), F.lit("a")).alias("starts_with_a"),
    )


def base_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each code follows from the characters of every text."""
    own = seqs(spark, sf_dir).select(F.explode(F.split("seq", "")).alias("c"))
    return own.where("c <> ''").groupBy(seq.base2int(F.col("c")).alias("code")).agg(F.count("*").alias("n"))


def kmer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 4-mer of every sequence with its number, there and back."""
    own = seqs(spark, sf_dir).where(F.length("seq") >= 4).select("seq_id", F.substring("seq", 1, 4).alias("kmer"))
    own = own.withColumn("number", seq.mer2i(F.col("kmer"), 4))
    return own.withColumn("back", seq.i2mer(4, F.col("number")))


def structure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures written without padding and read again: a digest of the line, size and sum of what is read."""
    own = seqs(spark, sf_dir).where(F.length("seq") >= 40)
    lines = writers.structure_lines(own.select("seq_id", structure(F.length("seq")).alias("ss")), 20)
    back = readers.parse_structure(lines)
    found = lines.join(back, "seq_id").select("seq_id", F.length("line").alias("n"), F.size("ss").alias("size"), F.aggregate("ss", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return rounded(found, "total")


def shape_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences whose structure is one value short: those of odd length, as made here."""
    own = seqs(spark, sf_dir)
    n = F.length("seq")
    return checks.shape_faults(own, own.select("seq_id", structure(n - F.when((n > 0) & (n % 2 == 1), 1).otherwise(0)).alias("ss")), "ss")


def matched_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with their structure, after the check that raises where the two differ."""
    own = seqs(spark, sf_dir)
    found = checks.require_shapes(own, own.select("seq_id", structure(F.length("seq")).alias("ss")), "ss", "structure")
    return found.select("seq_id", F.length("seq").alias("len"), F.size("ss").alias("size"))


def event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and greatest share of the normalised event profile of every sequence."""
    own = seqs(spark, sf_dir).where(F.length("seq") > 0).select("seq_id", counts(F.length("seq")).alias("c"))
    found = own.select("seq_id", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("events"), de.normalise(F.col("c"), 0.5).alias("d"))
    return rounded(found.select("seq_id", "events", F.array_max("d").alias("most"), F.array_min("d").alias("least")), "most", "least")


def event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts written as lines and read again."""
    own = seqs(spark, sf_dir).where(F.length("seq") > 0).select(F.col("seq_id").alias("rank"), counts(F.length("seq")).alias("counts"))
    lines = writers.count_lines(own)
    back = readers.parse_counts(lines.withColumnRenamed("rank", "seq_id"))
    return lines.join(back.withColumnRenamed("seq_id", "rank"), "rank").select("rank", F.md5(F.col("line").cast("binary")).alias("line"), F.size("counts").alias("size"))


def _with_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that keep the capital N's of their text."""
    letters = F.replace(F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTUNacgtu]", "")), F.lit("U"), F.lit("T"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), letters.alias("seq"))


def random_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N's left after they are replaced by random bases, and whether all other letters stand as they were."""
    own = _with_n(spark, sf_dir).withColumn("drawn", seq.replace_n(F.col("seq"), F.col("seq_id"), 7))
    same = F.forall(F.arrays_zip(F.split("seq", "").alias("a"), F.split("drawn", "").alias("b")), lambda x: (x["a"] == "N") | (x["a"] == x["b"]))
    return own.select("seq_id", F.length(F.regexp_replace("drawn", "[ACGT]", "")).alias("others"), F.length("drawn").alias("n"), same.alias("same"))


def fasta_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA files in the shared folder and loaded again with padding, in file order."""
    folder = f"{lineage.shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    own = seqs(spark, sf_dir).withColumn("name", F.concat(F.lit("sequence_"), F.col("seq_id").cast("string")))
    writers.write_lines(writers.fasta_lines(own), folder, ["seq_id"])
    back = readers.load_sequences(spark, folder, padding=3)
    return back.select("seq_id", "name", F.md5(F.col("seq").cast("binary")).alias("seq"), F.col("len").cast("long").alias("len"))


def fasta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = checks.without_n(_with_n(spark, sf_dir)).withColumn("name", F.concat(F.lit("sequence_"), F.col("seq_id").cast("string")))
    return writers.fasta_lines(own).select("seq_id", F.md5(F.col("line").cast("binary")).alias("line"))


def fold_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairing probabilities of the benchmark texts' nucleotides."""
    own = seqs(spark, sf_dir, "benchmark", "item_id")
    found = fold.fold(own)
    return found.select("seq_id", F.size("ss").alias("n"), F.round(F.aggregate("ss", F.lit(0.0), lambda a, x: a + x), 6).alias("paired"))


def fold_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the same, summarised."""
    own = seqs(spark, sf_dir, "benchmark", "item_id")
    return fold.brackets(fold.fold_pairs(own), own)


def fold_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fold.ensemble_energy(seqs(spark, sf_dir, "benchmark", "item_id")), "energy")


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of where, relative to its length, each sequence has its first TG."""
    own = seqs(spark, sf_dir).where("instr(seq, 'TG') > 0").select(((F.instr("seq", "TG") - 1) / F.length("seq")).alias("x"))
    return rounded(simulate.location_histogram(own), "density")


def pwm_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information of the matrix of the first six letters of every sequence."""
    own = kmers.windows(seqs(spark, sf_dir), 6).where("pos = 0")
    n = own.select(F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"), "kmer").select("k", F.substring("kmer", F.col("k"), F.lit(1)).alias("base"))
    p = n.groupBy("k").pivot("base", list("ACGT")).count().na.fill(0)
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), (F.col(b) / total).alias("p")) for b in "ACGT"]))
    return rounded(simulate.information_content(p.select("k", each.alias("e")).select("k", "e.*")), "bits", "relative_bits")


def log_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln of the sum of exp over made-up logs of every sequence, and its chance to hold no event."""
    own = seqs(spark, sf_dir).where(F.length("seq") > 0)
    logs = F.transform(structure(F.length("seq")), lambda x: -10 * x)
    return rounded(own.select("seq_id", prob.log_sum_exp(logs).alias("lse"), prob.poisson_zero(F.length("seq") / 1000).alias("none")), "lse", "none")


def geometric_variates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A geometric variate for every sequence, from a number that its id spreads over (0, 1)."""
    u = ((F.col("seq_id") * 7919) % 9973 + 0.5) / 9973
    return seqs(spark, sf_dir).select("seq_id", prob.geometric(u, 0.135).cast("long").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        base_composition, kmer_observed, kmer_enrichment, kmer_top, sequence_functions, base_codes, kmer_numbers, structure_text, shape_faults, matched_shapes,
        event_profiles, event_text, fasta_text, fasta_load, random_bases, fold_structure, fold_brackets, fold_energy, length_histogram, pwm_information, log_sums, geometric_variates,
    )
}

_SHARES = f"""{SEQS}, shares AS (SELECT sum(length(seq)) AS len, {", ".join(f"sum(length(seq) - length(replace(seq, '{b}', '')))::BIGINT AS {b}" for b in "ACGT")} FROM seqs)"""


def _enrichment(k: int) -> str:
    p = " * ".join(f"(CASE substr(kmer, {i + 1}, 1) WHEN 'A' THEN A / len WHEN 'C' THEN C / len WHEN 'G' THEN G / len ELSE T / len END)" for i in range(k))
    return f"""WITH {_SHARES}, {windows_sql(k)}, lens AS (SELECT length(seq) AS l, count(*) AS n FROM seqs GROUP BY 1),
obs AS (SELECT kmer, count(DISTINCT seq_id) AS observed FROM windows GROUP BY kmer),
ps AS (SELECT kmer, observed, {p} AS p FROM obs, shares),
ex AS (SELECT kmer, observed, sum(n * (1 - exp(-l * p))) AS expected FROM ps, lens GROUP BY ALL)
SELECT kmer, observed, round(expected, 6) AS expected, round(observed / expected, 6) AS score FROM ex"""


_WITH_N = "ns AS (SELECT doc_id AS seq_id, replace(upper(regexp_replace(coalesce(text, ''), '[^ACGTUNacgtu]', '', 'g')), 'U', 'T') AS seq FROM documents)"
_SS = "(((i * 37 + seq_id) % 101) / 100)"
_POS = "unnest(range(0, length(seq))) AS i"

SQL = {
    "base_composition": f"WITH {_SHARES} SELECT base, n, round(n / len, 6) AS share FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS base, {b} AS n, len FROM shares" for b in "ACGT") + ")",
    "kmer_observed": f"WITH {SEQS}, {windows_sql(4)} SELECT kmer, count(DISTINCT seq_id) AS observed FROM windows GROUP BY kmer",
    "kmer_enrichment": _enrichment(4),
    "kmer_top": _enrichment(6) + " ORDER BY observed / expected DESC, kmer LIMIT 10",
    "sequence_functions": f"""WITH {SEQS} SELECT seq_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS revcomp, md5(repeat('N', 20) || seq || repeat('N', 20)) AS padded,
  md5(substr(seq, 1, seq_id % (length(seq) - 5)) || 'NNNNNN' || substr(seq, seq_id % (length(seq) - 5) + 7)) AS masked,
  (instr('ACGT', substr(seq, 1, 1)) - 1)::INTEGER AS first_code, substr(seq, 1, 1) = 'A' AS starts_with_a FROM seqs WHERE length(seq) >= 10""",
    "base_codes": f"WITH {SEQS} SELECT (instr('ACGT', c) - 1)::INTEGER AS code, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS c FROM seqs) WHERE c <> '' GROUP BY 1",
    "kmer_numbers": f"""WITH {SEQS} SELECT seq_id, substr(seq, 1, 4) AS kmer, ({" + ".join(f"(instr('ACGT', substr(seq, {i + 1}, 1)) - 1) * {4 ** (3 - i)}" for i in range(4))})::BIGINT AS number,
  substr(seq, 1, 4) AS back FROM seqs WHERE length(seq) >= 4""",
    "structure_text": f"""WITH {SEQS}, v AS (SELECT seq_id, i, ({_SS})::DOUBLE AS x FROM (SELECT seq_id, seq, {_POS} FROM seqs WHERE length(seq) >= 40) WHERE i >= 20 AND i < length(seq) - 20),
  f AS (SELECT seq_id, sum(length(x::VARCHAR) + 1)::INTEGER AS n, count(*)::INTEGER AS size, round(sum(x), 6) AS total FROM v GROUP BY seq_id)
  SELECT seq_id, coalesce(n, 0) AS n, coalesce(size, 0) AS size, coalesce(total, 0.0) AS total FROM (SELECT seq_id FROM seqs WHERE length(seq) >= 40) LEFT JOIN f USING (seq_id)""",
    "shape_faults": f"WITH {SEQS} SELECT seq_id, length(seq)::INTEGER AS len, (length(seq) - 1)::INTEGER AS size FROM seqs WHERE length(seq) % 2 = 1",
    "matched_shapes": f"WITH {SEQS} SELECT seq_id, length(seq)::INTEGER AS len, length(seq)::INTEGER AS size FROM seqs",
    "event_profiles": f"""WITH {SEQS}, c AS (SELECT seq_id, ((seq_id * 31 + i * 17) % 5) AS c FROM (SELECT seq_id, seq, {_POS} FROM seqs)),
  m AS (SELECT seq_id, c, greatest((c + 1)::DOUBLE, 0.5 * max(c + 1) OVER (PARTITION BY seq_id)) AS x FROM c)
  SELECT seq_id, sum(c)::BIGINT AS events, round(max(x) / sum(x), 6) AS most, round(min(x) / sum(x), 6) AS least FROM m GROUP BY seq_id""",
    "event_text": f"""WITH {SEQS} SELECT seq_id AS rank, md5(string_agg(((seq_id * 31 + i * 17) % 5)::VARCHAR, ', ' ORDER BY i)) AS line, count(*)::INTEGER AS size
  FROM (SELECT seq_id, seq, {_POS} FROM seqs) GROUP BY seq_id""",
    "fasta_text": f"WITH {_WITH_N} SELECT seq_id, md5('>sequence_' || seq_id::VARCHAR || chr(10) || seq) AS line FROM ns WHERE NOT contains(seq, 'N')",
    "random_bases": f"WITH {_WITH_N} SELECT seq_id, 0 AS others, length(seq)::INTEGER AS n, TRUE AS same FROM ns",
    "fasta_load": f"WITH {SEQS} SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, 'sequence_' || seq_id::VARCHAR AS name, md5('NNN' || seq || 'NNN') AS seq, length(seq) + 6 AS len FROM seqs",
    "geometric_variates": "SELECT doc_id AS seq_id, floor(ln(((doc_id * 7919) % 9973 + 0.5) / 9973) / ln(1.0 - 0.135))::BIGINT AS n FROM documents",
    "length_histogram": f"""WITH {SEQS}, x AS (SELECT (instr(seq, 'TG') - 1) / length(seq) AS x FROM seqs WHERE instr(seq, 'TG') > 0), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
  b AS (SELECT CASE WHEN hi > lo THEN least(floor((x - lo) * 160 / (hi - lo)), 159)::BIGINT ELSE 0 END AS bin, (hi - lo) / 160 AS width FROM x, e)
  SELECT bin, count(*) AS n, CASE WHEN max(width) > 0 THEN round(count(*) / (SELECT count(*) FROM b) / max(width), 6) END AS density FROM b GROUP BY bin""",
    "pwm_information": f"""WITH {SEQS}, l AS (SELECT k::INTEGER AS k, substr(seq, k, 1) AS base FROM seqs, range(1, 7) t(k) WHERE length(seq) >= 6),
  p AS (SELECT k, base, count(*) / sum(count(*)) OVER (PARTITION BY k) AS p FROM l GROUP BY k, base)
  SELECT k, round(2 + sum(p * log2(p)), 6) AS bits, round(sum(p * log2(p / CASE base WHEN 'A' THEN 0.3 WHEN 'T' THEN 0.3 ELSE 0.2 END)), 6) AS relative_bits FROM p GROUP BY k""",
    "log_sums": f"""WITH {SEQS} SELECT seq_id, round(ln(sum(exp(-10 * {_SS}))), 6) AS lse, round(exp(-max(length(seq)) / 1000), 6) AS none
  FROM (SELECT seq_id, seq, {_POS} FROM seqs) GROUP BY seq_id""",
}
