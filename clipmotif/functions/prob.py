"""Probabilities and log-space arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-100


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside the lambdas of array functions an expression is
    evaluated again for every element, a lambda's variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_sum_exp(logs: Column) -> Column:
    """ln of the sum of exp over an array of logs, shifted by the greatest so far; null for an empty array."""

    def step(a: Column, x: Column) -> Column:
        top = F.greatest(a["top"], x)
        return F.struct(top.alias("top"), (F.when(a["sum"] > 0, a["sum"] * F.exp(a["top"] - top)).otherwise(0.0) + F.exp(x - top)).alias("sum"))

    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("sum"))
    return F.aggregate(logs, start, step, lambda a: F.when(a["sum"] > 0, a["top"] + F.log(a["sum"])))


def poisson_zero(rate: Column) -> Column:
    """Probability that a Poisson variable of this rate is zero."""
    return F.exp(-rate)


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in (0, 1) drawn from the md5 of seed and keys, joined by colons: the same wherever the row is computed."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / float(2**52)


def geometric(u: Column, p: float) -> Column:
    """A geometric variate, floor(ln u / ln(1 - p)), from a uniform one."""
    return F.floor(F.log(u) / F.log(F.lit(1.0 - p)))


def filled(entries: Column, length: Column, blank: Column) -> Column:
    """An array of ``length`` values: those of ``entries``, structs (pos, value) of different places, and ``blank`` elsewhere.

    Gaps between sorted entries are filled, so that a row takes time in proportion to its length; null entries are none.
    """

    def fill(e: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1).cast("long")), F.transform(e, lambda x: x["pos"].cast("long")))
        parts = F.zip_with(e, F.slice(ends, F.lit(1), F.size(e)), lambda x, before: F.concat(F.array_repeat(blank, (x["pos"] - before - 1).cast("int")), F.array(x["value"])))
        return F.concat(F.flatten(parts), F.array_repeat(blank, (length - 1 - F.element_at(ends, -1)).cast("int")))

    return F.coalesce(let(F.array_sort(entries), fill), F.array_repeat(blank, length.cast("int")))
