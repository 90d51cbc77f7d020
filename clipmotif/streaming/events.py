"""Counting cross-link events while reads arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from clipmotif.operators import intervals, reads


def stream_counts(lines: DataFrame, regions: DataFrame, mapper: str = "rmap", protocol: str = "iCLIP") -> DataFrame:
    """Rows (rank, pos, n) kept up to date from a stream ``lines(line)``: the batch operators on a streaming frame.

    State holds one row per place at which events begin, however many regions it lies in, so the chromosomes' positions
    bound it and no watermark is needed.  Places whose counts a batch changed are joined to the regions after that.
    Regions that stand there twice count twice; a rank has no two different ones.
    """
    found = reads.events(reads.parse_reads(lines, mapper), protocol, mapper)
    own = regions.groupBy("rank", "chrom", "rs", "re", "strand").agg(F.count("*").alias("times"))
    met = intervals.at_places(intervals.places(found), own, mirror=protocol != "iCLIP", more=("times",))
    return met.select("rank", "pos", (F.col("n") * F.col("times")).alias("n"))


def write_counts(counts: DataFrame, sink, checkpoint: str) -> DataStreamWriter:
    """A writer that hands each batch's changed counts to ``sink(frame, batch_id)``, exactly restartable from ``checkpoint``."""
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
