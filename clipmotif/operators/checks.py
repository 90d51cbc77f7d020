"""Consistency checks of inputs that belong together, and of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_faults(seqs: DataFrame, arrays: DataFrame, column: str) -> DataFrame:
    """Rows (seq_id, len, size) of sequences whose array is missing or of another length, or that only one side has."""
    own = seqs.select("seq_id", F.length("seq").alias("len"))
    other = arrays.select("seq_id", F.size(column).alias("size"))
    return own.join(other, "seq_id", "full").where(~F.col("len").eqNullSafe(F.col("size")))


def require_shapes(seqs: DataFrame, arrays: DataFrame, column: str, what: str) -> DataFrame:
    """``seqs`` with the array column; raises if the two do not match row by row."""
    bad = shape_faults(seqs, arrays, column).first()
    if bad:
        raise ValueError(f"{what} and sequences differ at sequence {bad['seq_id']}: {bad['size']} values, {bad['len']} bases")
    return seqs.join(arrays.select("seq_id", column), "seq_id")


def region_faults(seqs: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of sequences and regions, matched by name, that only one side has or whose widths differ."""
    own = seqs.select("name", F.length("seq").alias("len"))
    other = regions.select("name", (F.col("re") - F.col("rs")).alias("width"))
    return own.join(other, "name", "full").where(~F.col("len").cast("long").eqNullSafe(F.col("width")))


def without_n(seqs: DataFrame) -> DataFrame:
    """Sequences that have no N."""
    return seqs.where(~F.contains(F.upper("seq"), F.lit("N")))


def require_parameters(width: int = 6, epsilon: float = 0.0, delta: int | None = None) -> None:
    """Raise for a motif width outside 4 … 12, an epsilon outside 0 … 1, or a delta outside -8 … 8."""
    if not 4 <= width <= 12:
        raise ValueError(f"motif width {width} is not in 4 … 12")
    if not 0 <= epsilon <= 1:
        raise ValueError(f"epsilon {epsilon} is not in 0 … 1")
    if delta is not None and not -8 <= delta <= 8:
        raise ValueError(f"delta {delta} is not in -8 … 8")
