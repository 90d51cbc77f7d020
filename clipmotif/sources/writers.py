"""Writers of event counts, structures, motifs, indicators and sequences, as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmotif.sources.readers import running

OCCURS = 0.8


def count_lines(dense: DataFrame) -> DataFrame:
    """Rows (rank, line): the counts of each region joined by comma and blank."""
    return dense.select("rank", F.array_join(F.transform("counts", lambda x: x.cast("string")), ", ").alias("line"))


def structure_lines(structures: DataFrame, padding: int = 0) -> DataFrame:
    """Rows (seq_id, line): probabilities without the padding, each followed by a comma; too short ones raise."""
    size = F.size("ss") - 2 * padding
    kept = F.when(size >= 0, F.slice("ss", F.lit(padding + 1), F.greatest(size, F.lit(0)))).otherwise(F.raise_error(F.lit("a structure is shorter than its padding")))
    return structures.select("seq_id", F.array_join(F.transform(kept, lambda x: F.concat(x.cast("string"), F.lit(","))), "").alias("line"))


def fasta_lines(seqs: DataFrame) -> DataFrame:
    """Rows (seq_id, line): header and sequence."""
    return seqs.select("seq_id", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("line"))


def indicator_lines(occupancy: DataFrame) -> DataFrame:
    """Rows (motif_rank, seq_id, line): the probability that each sequence has the motif, best motif first."""
    return occupancy.select("motif_rank", "seq_id", F.col("q").cast("string").alias("line"))


def motif_rows(sites: DataFrame, width: int) -> DataFrame:
    """Rows (k, a, c, g, t), k from 1: sums of q over the bases at the best sites of sequences with q of OCCURS or more."""
    own = sites.where((F.col("q") >= OCCURS) & F.col("site").isNotNull())
    own = own.select("q", F.upper(F.substring("seq", F.col("site").cast("int") + 1, F.lit(width))).alias("own"))
    weight = lambda k, b: F.coalesce(F.sum(F.when(F.substring("own", k + 1, 1) == b, F.col("q"))), F.lit(0.0))
    one = own.agg(*[weight(k, b).alias(f"{b}{k}") for k in range(width) for b in "ACGT"])
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("k"), *[F.col(f"{b}{k}").alias(b.lower()) for b in "ACGT"]) for k in range(width)]))
    return one.select(each.alias("r")).select("r.*")


def site_lines(sites: DataFrame, width: int) -> DataFrame:
    """Rows (seq_id, line): a BS line for each sequence with q of OCCURS or more; ``sites`` may have a strand."""
    own = sites.where((F.col("q") >= OCCURS) & F.col("site").isNotNull())
    strand = F.col("strand") if "strand" in sites.columns else F.lit("+")
    place = F.concat_ws("; ", F.substring("seq", F.col("site").cast("int") + 1, F.lit(width)), "name", F.col("site").cast("string"), F.lit(str(width)))
    return own.select("seq_id", F.concat(F.lit("BS\t"), place, F.lit(";  ;"), strand, F.lit("\t"), F.format_string("%.6g", F.col("q").cast("double"))).alias("line"))


def motif_record(sites: DataFrame, model, name: str, events: bool = False) -> DataFrame:
    """Rows (part, seq_id, line) of a motif's tagged record, to be ordered by part and seq_id; none if no sequence has it.

    ``sites`` has (seq_id, name, seq, site, q).  A column's numbers are the model's probabilities plus
    ``motif_rows``, cut to whole numbers; attributes follow for structure and events, then a line per sequence.
    """
    spark, width = sites.sparkSession, model.width
    lines = site_lines(sites, width)
    if not lines.take(1):
        return spark.createDataFrame([], "part int, seq_id long, line string")
    rows = {r["k"]: r for r in motif_rows(sites, width).collect()}
    head = [f"AC\t{name}", "XX", "TY\tMotif", "XX", "P0\tA\tC\tG\tT"]
    head += ["\t".join([f"{k + 1:02d}", *(str(int(rows[k + 1][b] + model.matrix[k][i])) for i, b in enumerate("acgt"))]) for k in range(width)]
    if model.paired:
        head += ["XX", "AT\tSEC_STR=" + ",".join(f"{x:g}" for x in model.paired)]
    head.append("XX")
    if events:
        head += [f"AT\tGEO_P={model.p:g}", f"AT\tGEO_DELTA={model.delta}", "XX"]
    ends = [(0, i, x) for i, x in enumerate(head)] + [(2, 0, "XX"), (2, 1, "//")]
    return spark.createDataFrame(ends, "part int, seq_id long, line string").unionByName(lines.select(F.lit(1).alias("part"), "seq_id", "line"))


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write the column ``line`` in the order given, as text files whose names sort in that order."""
    lines.orderBy(*order).select("line").write.text(path)


def write_ordered(lines: DataFrame, path: str, order: list[str]) -> None:
    """``write_lines``, and beside it in ``path``.parts the list of its files in order: name, bytes, lines, lines before it.

    Files are dealt out by ranges of the order and committed by Spark's writer, so a task that fails leaves none; the list
    is made of what was committed, and is there only if all of it was.  Joined in the listed order the files are the one
    file that a single writer would have made.
    """
    write_lines(lines, path, order)
    found = lines.sparkSession.read.text(path).groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("lines"))
    listed = running(found, ["file"], "lines", "first")
    write_lines(listed.select("file", F.concat_ws("\t", "file", F.col("bytes").cast("string"), F.col("lines").cast("string"), F.col("first").cast("string")).alias("line")), f"{path}.parts", ["file"])


def listed_parts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, bytes, lines, first) of what ``write_ordered`` wrote, in order; raises where a listed file is not there as it was."""
    t = F.split("value", "\t")
    own = spark.read.text(f"{path}.parts").select(F.get(t, 0).alias("file"), *[F.get(t, i).cast("long").alias(c) for i, c in ((1, "bytes"), (2, "lines"), (3, "first"))])
    there = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("is"))
    lost = F.raise_error(F.concat(F.lit("not as it was written: "), F.col("file")))
    own = own.join(there, "file", "left").withColumn("bytes", F.when(F.col("bytes").eqNullSafe(F.col("is")), F.col("bytes")).otherwise(lost))
    return own.drop("is").orderBy("first")
