"""Diagnostic events: normalised profiles, their likelihood around a motif site, and its parameters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from clipmotif.functions.prob import let

#: fixed values of the model
GEO_P = 0.135
WEIGHT = 1.1
DELTAS = range(-8, 9)
P_BOUNDS = (0.01, 0.99)
NEWTON_STEPS = 10
NEWTON_TOLERANCE = 1e-3
VALUES = 1 << 18  # of profiles that a task turns into logs at once


def normalise(counts: Column, epsilon: float = 0.0) -> Column:
    """Counts plus one, raised to ``epsilon`` times their maximum, as shares that sum to one."""
    raised = F.transform(counts, lambda x: (x + 1).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    floored = let(raised, lambda r: let(F.array_max(r) * epsilon, lambda low: F.transform(r, lambda x: F.greatest(low, x))))
    return let(floored, lambda f: let(total(f), lambda t: F.transform(f, lambda x: x / t)))


def _reach(ratio: float) -> int:
    """Distance from which ratio ** distance no longer changes a sum."""
    return int(np.ceil(-60 / np.log(ratio))) if 0 < ratio < 1 else 1


def smoothed(d: np.ndarray, ratio: float, power: int = 0) -> np.ndarray:
    """For c from -8 to len(d) + 7 the sum over k of d[k] t (t - 1) … ratio ** (t - power), t = |k - c|."""
    n = min(_reach(ratio), len(d) + 8)
    t = np.abs(np.arange(-n, n + 1)).astype(float)
    kernel = np.where(t >= power, ratio ** np.maximum(t - power, 0), 0.0)
    for k in range(power):
        kernel = kernel * (t - k)
    if len(d) * len(kernel) <= 4_000_000:
        wide = np.convolve(d, kernel)  # index i stands for c = i - n
    else:
        size = 1 << (len(d) + len(kernel) - 2).bit_length()
        wide = np.fft.irfft(np.fft.rfft(d, size) * np.fft.rfft(kernel, size), size)[: len(d) + len(kernel) - 1]
    at = np.arange(-8, len(d) + 8) + n
    ok = (at >= 0) & (at < len(wide))
    return np.where(ok, wide[np.clip(at, 0, len(wide) - 1)], 0.0)


def _logs(d: Sequence[float], p: float, weight: float) -> np.ndarray:
    return weight * np.log(p) + np.log(np.maximum(smoothed(np.asarray(d, float), (1 - p) ** weight), 1e-300))


def _profiles(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """A batch's profiles, as parts of its values; null for null."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False):
        yield values[a:b] if there else None


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about VALUES values of a list column, so that what is made of a part stays small."""
    ends = batch.column(column).offsets.to_numpy().astype(np.int64)
    group = (ends[1:] - ends[0]) // VALUES
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _listed(column: pa.ListArray, p: float, weight: float) -> pa.ListArray:
    """The profiles' logs."""
    none = np.zeros(0)
    logs = [none if d is None or not len(d) else _logs(d, p, weight) for d in _profiles(column)]
    ends = np.cumsum([0, *map(len, logs)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *logs])), mask=column.is_null())


def with_logs(frame: DataFrame, p: float = GEO_P, weight: float = WEIGHT) -> DataFrame:
    """``frame`` with its profiles ``d`` replaced by arrays of ln P for c = -8 … len + 7, c being site plus delta."""
    at = frame.columns.index("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _parts(batch, at):
                yield pa.RecordBatch.from_arrays([_listed(c, p, weight) if i == at else c for i, c in enumerate(own.columns)], names=batch.schema.names)

    return frame.mapInArrow(run, frame.schema)


def with_logs_by_start(frame: DataFrame, ps: Sequence[float], weight: float = WEIGHT) -> DataFrame:
    """``with_logs`` under each of the values ``ps``, whose place is the new column ``at``: a row for each."""
    column = frame.columns.index("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, p in enumerate(ps):
                logs = pa.array([None if d is None else _logs(d, p, weight) if d else [] for d in batch.column(column).to_pylist()], pa.list_(pa.float64()))
                own = [logs if i == column else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(batch.num_rows, at, np.int32))], names=[*batch.schema.names, "at"])

    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField("at", IntegerType())]))


def cube(profiles: DataFrame, width: int, p: float = GEO_P, weight: float = WEIGHT) -> DataFrame:
    """Rows (seq_id, site, de): for every site of ``profiles(seq_id, d)`` the 17 log-likelihoods by delta, -8 first.

    ln P(site, delta) is the log of the sum over positions k of d[k] (p (1 - p) ** |k - site - delta|) ** weight.
    It depends on site + delta alone, so each sequence is smoothed once and its sites take slices of that.
    """
    own = profiles.where(F.size("d") >= width).select("seq_id", F.size("d").alias("len"), "d")
    sites = with_logs(own, p, weight).select("seq_id", "d", F.explode(F.sequence(F.lit(0), F.col("len") - width)).alias("site"))
    return sites.select("seq_id", "site", F.slice("d", F.col("site") + 1, F.lit(len(DELTAS))).alias("de"))


def delta_likelihood(sites: DataFrame) -> DataFrame:
    """Rows (delta, ll) from ``sites(z, de)``: the expected log-likelihood of every delta."""
    found = sites.agg(*[F.sum(F.col("z") * F.col("de")[k]).alias(f"d{k}") for k in range(len(DELTAS))])
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("delta"), F.col(f"d{k}").alias("ll")) for k, d in enumerate(DELTAS)]))
    return found.select(each.alias("e")).select("e.*")


def best_delta(sites: DataFrame) -> int:
    """The likeliest delta; of equal ones the smallest."""
    return delta_likelihood(sites).orderBy(F.desc("ll"), "delta").first()["delta"]


def event_sums(sites: DataFrame, asked: Sequence[tuple[int, int, float]], weight: float = 1.0, slopes: bool = True) -> DataFrame:
    """Rows (at, delta, v, g, h) for every (at, delta, p) of ``asked``: over the rows (at, d, pos, z) of ``sites``, a
    profile and the weights z of the sites pos, sums of z times ln P, and its slope and curvature by p (of weight one).

    The rows of all starts go by in one job, and each sends its sums alone.  Without ``slopes`` g and h are zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(asked), 3))
        for batch in (part for whole in batches for part in _parts(whole, 1)):
            for start, d, pos, z in zip(batch.column(0).to_pylist(), *(_profiles(batch.column(k)) for k in (1, 2, 3)), strict=True):
                own, weights = np.asarray(d, float), np.zeros(len(d) + 16)
                np.add.at(weights, np.asarray(pos, np.int64) + 8, np.asarray(z, float))
                done: dict[float, tuple] = {}
                for n, (at, delta, p) in enumerate(asked):
                    if at != start:
                        continue
                    if p not in done:
                        b = np.maximum(smoothed(own, (1 - p) ** weight), 1e-300)
                        more = (1 / p - (c := smoothed(own, 1 - p, 1)) / b, -1 / p**2 + smoothed(own, 1 - p, 2) / b - (c / b) ** 2) if slopes and weight == 1 else ()
                        done[p] = (weight * np.log(p) + np.log(b), *more)
                    # z of a site is met by what stands delta further on
                    w = weights[max(0, -delta) : len(weights) - max(0, delta)]
                    for k, x in enumerate(done[p]):
                        sums[n, k] += float(w @ x[max(0, delta) : len(x) - max(0, -delta)])
        arrays = [pa.array([a for a, _, _ in asked], pa.int32()), pa.array([d for _, d, _ in asked], pa.int32()), *(pa.array(x) for x in sums.T)]
        yield pa.RecordBatch.from_arrays(arrays, names=["at", "delta", "v", "g", "h"])

    found = sites.select("at", "d", "pos", "z").mapInArrow(run, "at int, delta int, v double, g double, h double")
    return found.groupBy("at", "delta").agg(*[F.sum(c).alias(c) for c in "vgh"])


def fit_geometry(sites: DataFrame, ps: Sequence[float], deltas: Sequence[Sequence[int]]) -> list[tuple[float, int]]:
    """For every start the p and delta that make its events likeliest: p by at most NEWTON_STEPS Newton steps within
    P_BOUNDS for each of its ``deltas``, all starts and deltas in one job a step; of equal deltas the first.

    ``sites`` has rows (at, d, pos, z), ``ps`` the p from which each start's steps begin.  Events have weight one here.
    """
    now = {(at, d): p for at, p in enumerate(ps) for d in deltas[at]}
    moving = set(now)
    for _ in range(NEWTON_STEPS):
        for r in event_sums(sites, [(*k, now[k]) for k in sorted(moving)]).collect():
            k = (r["at"], r["delta"])
            old = now[k]
            now[k] = min(max(old - r["g"] / r["h"], P_BOUNDS[0]), P_BOUNDS[1]) if r["h"] else old
            if abs(now[k] - old) <= NEWTON_TOLERANCE:
                moving.discard(k)
        if not moving:
            break
    found = {(r["at"], r["delta"]): r["v"] for r in event_sums(sites, [(*k, p) for k, p in sorted(now.items())]).collect()}
    best = [max(own, key=lambda d: (found.get((at, d), -np.inf), -d)) for at, own in enumerate(deltas)]  # noqa: B023
    return [(now[at, d], d) for at, d in enumerate(best)]
