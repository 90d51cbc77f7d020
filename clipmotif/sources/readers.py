"""Readers of sequences, regions, reads, structures and event counts.

Rows carry explicit keys.  Where a format has its meaning in the order of lines, ``numbered`` gives every line
its number across files by one count per partition, so that no file has to be read by one task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipmotif.functions.seq import pad, reverse_complement
from clipmotif.operators import reads as read_ops
from clipmotif.operators.lineage import cut

LINE = 50  # bases per line of a chromosome file


SPLIT = ("__file", "__block")  # where a line stands: its file, and where its input split begins there


def text_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(line) of the text files at a path, and the columns SPLIT, by which ``numbered`` puts splits into order."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias(SPLIT[0]), F.col("_metadata.file_block_start").alias(SPLIT[1]))


MOST_SPLITS = 4_000_000  # whose offsets, two longs each, are broadcast; beyond, both sides are shuffled


def running(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before, in the order of ``keys``.

    Rows are dealt out by ranges of the keys; sums go over a range in Spark, and over the ranges, one a task, in the driver.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = cut(rows.repartitionByRange(tasks, *keys).withColumn("__range", F.spark_partition_id()))
    sums = sorted((r["__range"], r["n"]) for r in own.groupBy("__range").agg(F.sum(value).alias("n")).collect())
    base = dict(zip((k for k, _ in sums), accumulate((n for _, n in sums), initial=0), strict=False))
    first = F.get(F.lit([base.get(k, 0) for k in range(max(base, default=0) + 1)]).cast("array<bigint>"), F.col("__range"))
    here = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn(name, first + F.coalesce(F.sum(value).over(here), F.lit(0))).drop("__range")


def numbered(lines: DataFrame, name: str = "rank") -> DataFrame:
    """``lines`` with consecutive numbers from zero in input order: offsets of splits plus the place within.

    Spark deals splits to partitions by size, so with the columns SPLIT they are ordered by file name and place, without
    them by partition.  The offsets are two longs for each split, found by the hash of its file and place; up to
    MOST_SPLITS of them are broadcast (100 TB in splits of 128 MB have 800 000).  ``lines`` is evaluated twice and has to
    come alike both times, as scans and checkpoints do.
    """
    own = lines.withColumn("__id", F.monotonically_increasing_id())
    keys = [c for c in SPLIT if c in lines.columns] or ["__part"]
    own = own.withColumn("__part", F.shiftright("__id", 33)).withColumn("__key", F.xxhash64(*keys))
    splits = own.groupBy("__key", *keys).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    offsets = cut(running(splits, keys, "__n", "__start").select("__key", (F.col("__start") - F.col("__first")).alias("__start")))
    n, different = offsets.agg(F.count("*"), F.count_distinct("__key")).first()
    if n != different:
        raise ValueError("two splits have one hash")
    own = own.join(F.broadcast(offsets) if n <= MOST_SPLITS else offsets, "__key")
    return own.withColumn(name, F.col("__start") + F.col("__id")).drop("__id", "__part", "__key", "__start", *SPLIT)


def read_fasta(spark: SparkSession, path: str, padding: int = 0) -> DataFrame:
    """Rows (seq_id, name, seq, len) of FASTA records in file order; sequences in upper case, ``padding`` N's on either side."""
    records = text_lines(spark, path, "\n>").withColumnRenamed("line", "value")
    own = numbered(records.where(F.trim("value") != ""), "seq_id").withColumn("value", F.regexp_replace("value", "^>", ""))
    name = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r", ""))
    body = F.when(F.contains(F.col("value"), F.lit("\n")), F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n", ""), "\\s", "")).otherwise("")
    own = own.select("seq_id", name.alias("name"), pad(F.upper(body), padding).alias("seq"))
    return own.withColumn("len", F.length("seq"))


def read_bed(spark: SparkSession, path: str, rename: bool = False) -> DataFrame:
    """Rows (rank, chrom, rs, re, name, score, strand) of a BED file in file order; named sequence_1 … if ``rename``."""
    return parse_bed(numbered(text_lines(spark, path).where(read_ops.is_record(F.col("line")))), rename)


def parse_bed(lines: DataFrame, rename: bool = False) -> DataFrame:
    """Regions from ``lines(rank, line)``; missing fields read as X, 0 and +."""
    t = F.split("line", "\t")
    name = F.concat(F.lit("sequence_"), (F.col("rank") + 1).cast("string")) if rename else F.coalesce(F.get(t, 3), F.lit("X"))
    return lines.select(
        "rank", F.get(t, 0).alias("chrom"), F.get(t, 1).cast("long").alias("rs"), F.get(t, 2).cast("long").alias("re"), name.alias("name"),
        F.coalesce(F.get(t, 4).cast("double"), F.lit(0.0)).alias("score"), F.coalesce(F.trim(F.get(t, 5)), F.lit("+")).alias("strand"),
    )


def read_reads(spark: SparkSession, path: str, mapper: str) -> DataFrame:
    """Mapped reads of one of the known mappers."""
    return read_ops.parse_reads(text_lines(spark, path), mapper)


def _numbers(line: Column, kind: str) -> Column:
    return F.transform(F.filter(F.split(line, "[,\\s]+"), lambda x: x != ""), lambda x: x.cast(kind))


def parse_structure(lines: DataFrame) -> DataFrame:
    """Rows (seq_id, ss) from ``lines(seq_id, line)`` of comma-separated probabilities; others than 0 … 1 raise."""
    own = lines.select("seq_id", _numbers(F.col("line"), "double").alias("ss"))
    fine = F.forall("ss", lambda x: x.isNotNull() & (x >= 0) & (x <= 1))
    return own.select("seq_id", F.when(fine, F.col("ss")).otherwise(F.raise_error(F.lit("structure file: a value is not a probability"))).alias("ss"))


def parse_counts(lines: DataFrame) -> DataFrame:
    """Rows (seq_id, counts) from ``lines(seq_id, line)`` of comma-separated counts; negative ones raise."""
    own = lines.select("seq_id", _numbers(F.col("line"), "long").alias("counts"))
    fine = F.forall("counts", lambda x: x.isNotNull() & (x >= 0))
    return own.select("seq_id", F.when(fine, F.col("counts")).otherwise(F.raise_error(F.lit("event file: a value is not a count"))).alias("counts"))


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    return parse_structure(numbered(text_lines(spark, path), "seq_id"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return parse_counts(numbered(text_lines(spark, path).where(F.trim("line") != ""), "seq_id"))


def read_chromosomes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (chrom, line_no, seq) of the chromosome files ``<chrom>.fa``: a header and LINE bases per line.

    Lines are numbered over all splits in the order of files; the header anchors those of its file.
    """
    chrom = F.regexp_extract(F.col(SPLIT[0]), "([^/]+)\\.fa$", 1)
    own = text_lines(spark, f"{folder}/*.fa").select(chrom.alias("chrom"), F.trim("line").alias("seq"), *SPLIT)
    if own.where((F.length("seq") > LINE) & ~F.startswith(F.col("seq"), F.lit(">"))).limit(1).count():
        raise ValueError(f"a chromosome file has lines of more than {LINE} bases")
    return chromosome_lines(numbered(own, "at"))


BLOCK_LINES = 1 << 14  # lines of a chromosome file that are read together


def _ranged(path: str) -> tuple[pafs.FileSystem, str] | None:
    """The file system of a path, if ranges of its files can be read; else None."""
    try:
        return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def _block_lines(files: pafs.FileSystem, path: str, chrom: str, block: int, lines: int) -> list[tuple[str, int, str]]:
    """Rows (chrom, line_no, seq) of one block of a chromosome file, of which only the header and these bytes are read."""
    if files.get_file_info(path).type != pafs.FileType.File:
        return []
    with files.open_input_file(path) as f:
        head = f.read(4096)
        while b"\n" not in head and len(head) < f.size():
            head += f.read(1 << 16)
        if not head.startswith(b">"):
            raise ValueError(f"{path} has no header")
        begin = head.find(b"\n") + 1 or len(head)
        step = LINE + (2 if head[:begin].endswith(b"\r\n") else 1)
        f.seek(min(begin + block * lines * step, f.size()))
        data = f.read(lines * step)
        last = f.tell() >= f.size()
    rows = [(chrom, block * lines + i, data[at : at + step].decode("ascii").strip()) for i, at in enumerate(range(0, len(data), step))]
    while last and rows and not rows[-1][2]:
        rows.pop()
    if any("\n" in seq or "\r" in seq or len(seq) > LINE or (len(seq) < LINE and not (last and n == len(rows) - 1)) for n, (_, _, seq) in enumerate(rows)):
        raise ValueError(f"{path} has lines of other than {LINE} bases")
    return rows


def chromosome_blocks(spark: SparkSession, folder: str, regions: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Rows (chrom, line_no, seq) of the blocks of ``<chrom>.fa`` that ``regions(chrom, rs, re)`` touch, and of no others.

    A file has LINE bases in every line, so a block is a range of bytes.  Blocks are dealt out to tasks, which read these
    bytes alone: what is read goes with the regions and not with the files.  Chromosomes without a file give no row.  The
    folder has to be in a store that Arrow reads (``_ranged``); ``read_chromosomes`` reads whole files of any other.
    """
    where, width = folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder), LINE * lines
    touched = F.explode(F.sequence(F.floor(F.greatest("rs", F.lit(0)) / width), F.floor((F.col("re") - 1) / width)))
    wanted = regions.where("re > rs AND re > 0").select("chrom", touched.alias("block")).distinct()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _ranged(where)
        for batch in batches:
            for chrom, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = _block_lines(files, f"{place}/{chrom}.fa", chrom, block, lines)
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["chrom", "line_no", "seq"])

    return wanted.repartition(tasks, "chrom", "block").mapInArrow(run, "chrom string, line_no long, seq string")


def chromosome_lines(ranked: DataFrame) -> DataFrame:
    """Rows (chrom, line_no, seq) from lines (at, chrom, seq) whose numbers ``at`` count from each header on."""
    first = ranked.where(F.startswith(F.col("seq"), F.lit(">"))).groupBy("chrom").agg(F.min("at").alias("head"))
    return ranked.join(first, "chrom").where("at > head").select("chrom", (F.col("at") - F.col("head") - 1).alias("line_no"), "seq")


def short_lines(chromosomes: DataFrame) -> DataFrame:
    """Lines other than the last of their chromosome that do not have LINE bases: no row for a valid file."""
    last = chromosomes.groupBy("chrom").agg(F.max("line_no").alias("last"))
    return chromosomes.join(last, "chrom").where((F.length("seq") != LINE) & (F.col("line_no") < F.col("last"))).drop("last")


def extract_regions(regions: DataFrame, chromosomes: DataFrame, line: int = LINE, require: bool = True) -> DataFrame:
    """Rows (rank, seq): the bases of each region, in upper case, the reverse complement on the minus strand.

    Regions are joined to the lines that they touch, so that no task reads a chromosome; with ``require`` a
    region on an unknown chromosome raises, otherwise it is left out.
    """
    touched = F.explode(F.sequence(F.floor(F.col("rs") / line), F.floor((F.col("re") - 1) / line)))
    own = regions.where("re > rs").select("rank", "chrom", "rs", "re", "strand", touched.alias("line_no"))
    joined = own.join(chromosomes, ["chrom", "line_no"], "left" if require else "inner")
    if require:
        lost = F.raise_error(F.concat(F.lit("no sequence for chromosome "), F.col("chrom")))
        joined = joined.withColumn("seq", F.when(F.col("seq").isNull(), lost).otherwise(F.col("seq")))
    grouped = joined.groupBy("rank", "rs", "re", "strand").agg(F.array_sort(F.collect_list(F.struct("line_no", "seq"))).alias("lines"))
    whole = F.array_join(F.col("lines.seq"), "")
    begin = (F.col("rs") - F.get("lines", F.lit(0))["line_no"] * line + 1).cast("int")
    piece = F.upper(F.substring(whole, begin, (F.col("re") - F.col("rs")).cast("int")))
    return grouped.select("rank", F.when(F.col("strand") == "-", reverse_complement(piece)).otherwise(piece).alias("seq"))


def region_sequences(regions: DataFrame, chromosomes: DataFrame, padding: int = 0) -> DataFrame:
    """Rows (seq_id, name, seq, rank, chrom, rs, re, strand, len) of BED regions, in the order of chromosome and start.

    Regions are widened by the padding for their sequence, so that it is real sequence.
    """
    wide = regions.withColumn("rs", F.col("rs") - padding).withColumn("re", F.col("re") + padding)
    found = extract_regions(wide, chromosomes).join(regions.select("rank", "chrom", "rs", "re", "name", "strand"), "rank")
    own = numbered(cut(found.orderBy("chrom", "rs", "re", "rank")), "seq_id")
    return own.select("seq_id", "name", "seq", "rank", "chrom", "rs", "re", "strand").withColumn("len", F.length("seq"))


def load_sequences(spark: SparkSession, path: str, chrom_folder: str | None = None, padding: int = 0) -> DataFrame:
    """Rows (seq_id, name, seq, len) from FASTA, or from BED with the chromosomes' folder.

    A FASTA file begins with ">" and takes no folder; its sequences get N's as padding.  BED regions are
    widened by the padding, so that theirs is real sequence, and come in the order of chromosome and start.
    """
    head = spark.read.text(path).limit(1).collect()
    if head and head[0][0].startswith(">"):
        if chrom_folder:
            raise ValueError("a FASTA file needs no chromosome folder")
        return read_fasta(spark, path, padding)
    if not chrom_folder:
        raise ValueError("regions need the folder of the chromosomes")
    regions = read_bed(spark, path)
    if _ranged(chrom_folder):
        own = chromosome_blocks(spark, chrom_folder, regions.withColumns({"rs": F.col("rs") - padding, "re": F.col("re") + padding}))
    else:
        own = read_chromosomes(spark, chrom_folder)
    return region_sequences(regions, own, padding)
