"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmotif.operators.lineage import cut, shared_folder

__all__ = ["col", "cut", "keep_rows", "shared_folder", "small", "small_batches", "table", "texts_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of an Arrow batch; null reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that what Python holds at once stays bounded."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, written to the checkpoint folder, marked for broadcast only if it has at most ``rows`` rows.

    For narrow tables that grow with the input: beyond the bound they are joined by shuffling both sides.
    """
    df = cut(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keep_rows(docs: DataFrame, run) -> DataFrame:
    """Rows of ``docs`` that an Arrow function of its batches keeps; it finds columns by place, so any names will do."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
