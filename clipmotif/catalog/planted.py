"""Queries on test data: motifs drawn, and planted into the sequences of the documents."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmotif.catalog.adapters import SEQS, rounded, seqs
from clipmotif.operators import simulate

MATRIX = [[0.91 if b == c else 0.03 for b in "ACGT"] for c in "TGCATG"]
FIRST = simulate.Plant(MATRIX, 0.8, "stem", 0.7, events=5, noise=0.2, delta=2)
SECOND = simulate.Plant(MATRIX[::-1], 0.5, "unstructured", events=3)
SEED = 12
WIDTH, TARGET, DRAW_SEED, TRIES = 6, 1.5, 3, 16_384


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).withColumn("name", F.concat(F.lit("sequence_"), F.col("seq_id").cast("string")))


def drawn_pwm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random matrix of a given mean information."""
    rows = [(k + 1, b, p) for k, row in enumerate(simulate.draw_pwm(spark, WIDTH, TARGET, DRAW_SEED, batch=TRIES)) for b, p in zip("ACGT", row, strict=True)]
    return rounded(spark.createDataFrame(rows, "k int, base string, p double"), "p")


def plant_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences with a motif planted in each kind of structure, and where it is."""
    own = seqs(spark, sf_dir)
    kinds = [simulate.place(own, replace(FIRST, structure=kind), SEED).withColumn("kind", F.lit(kind)) for kind in simulate.STRUCTURES]
    return reduce(DataFrame.unionByName, kinds).select("kind", "seq_id", "site", "structured", F.md5(F.col("seq").cast("binary")).alias("seq"))


def simulate_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences with two motifs planted, one after the other, and their events: number, and sums by place."""
    made, counts, (first, second) = simulate.simulate(_named(spark, sf_dir), [FIRST, SECOND], SEED)
    summed = lambda f: F.aggregate(F.transform("counts", f), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = counts.select("seq_id", F.size("counts").alias("n"), summed(lambda x: x).alias("events"), summed(lambda x, i: x * i).alias("places"), summed(lambda x, i: x * x * (i + 1)).alias("squares"))
    sites = first.select("seq_id", F.col("site").alias("first")).join(second.select("seq_id", F.col("site").alias("second")), "seq_id")
    return made.select("seq_id", F.md5(F.col("seq").cast("binary")).alias("seq")).join(sites, "seq_id").join(sums, "seq_id")


def truth_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a planted motif and its sites, as lines."""
    return simulate.truth_lines(simulate.place(_named(spark, sf_dir), FIRST, SEED), FIRST, "MOTIF0")


QUERIES = {f.__name__: f for f in (drawn_pwm, plant_sites, simulate_data, truth_record)}


def _draw(seed: int, *keys: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)"


def _below(u: str, n: str) -> str:
    return f"floor({u} * ({n}))::INTEGER"


def _put(text: str, part: str, at: str, width: int) -> str:
    return f"substr({text}, 1, {at}) || {part} || substr({text}, {at} + {width + 1})"


def _letter(seed: int, k: int, row: list[float]) -> str:
    a, c, g, _ = (float(x) for x in np.cumsum(row) / sum(row))
    u = _draw(seed, "seq_id", "'word'", f"'{k}'")
    return f"CASE WHEN {u} < {a!r}::DOUBLE THEN 'A' WHEN {u} < {c!r}::DOUBLE THEN 'C' WHEN {u} < {g!r}::DOUBLE THEN 'G' ELSE 'T' END"


def _placed(source: str, plant: simulate.Plant, seed: int) -> str:
    """A query of (seq_id, seq, site, structured) from a relation (seq_id, seq)."""
    w, u = len(plant.matrix), lambda what: _draw(seed, "seq_id", f"'{what}'")
    arm, at, loop = {"stem": (10, 3, 15), "dsRNA": (w, 0, 15), "ssRNA": (10, 10, w), "unstructured": (0, 0, 0)}[plant.structure]
    fits = f"has AND {u('structured')} < {plant.structured} AND length(seq) >= {2 * arm + loop}" if arm else "false"
    begin = f"CASE WHEN structured THEN {_below(u('at'), f'length(seq) - {2 * arm + loop - 1}')} + {at} ELSE {_below(u('at'), f'length(seq) - {w - 1}')} END"
    paired = f"translate(reverse(substr(seq, site - {at} + 1, {arm})), 'ACGT', 'TGCA')"
    folded = f"CASE WHEN structured THEN {_put('seq', paired, f'(site + {arm + loop - at})', arm)} ELSE seq END"
    return f"""SELECT seq_id, {folded} AS seq, site, structured FROM (SELECT seq_id, CASE WHEN has THEN {_put("seq", "word", "site", w)} ELSE seq END AS seq, site, structured FROM (
  SELECT *, CASE WHEN has THEN {begin} END AS site FROM (SELECT *, {fits} AS structured FROM (
  SELECT seq_id, seq, {" || ".join(_letter(seed, k, row) for k, row in enumerate(plant.matrix))} AS word, {u("has")} < {plant.share} AND length(seq) >= {w} AS has FROM {source}))))"""


def _events(placed: str, plant: simulate.Plant, seed: int) -> str:
    """A query of (seq_id, pos) of the events."""
    u, real = lambda what: _draw(seed, "seq_id", "k", f"'{what}'"), int(np.ceil(plant.events * (1 - plant.noise)))
    far = f"floor(ln({u('far')}) / ln({1.0 - plant.p!r}::DOUBLE))::INTEGER * CASE WHEN {u('side')} < 0.5 THEN -1 ELSE 1 END"
    return f"""SELECT seq_id, CASE WHEN near BETWEEN 0 AND length(seq) - 1 THEN near ELSE {_below(u("any"), "length(seq)")} END AS pos
  FROM (SELECT *, CASE WHEN k <= {real} THEN site + {plant.delta} + {far} END AS near FROM {placed}, range(1, {plant.events + 1}) t(k) WHERE seq <> '')"""


def _record() -> str:
    w = len(MATRIX)
    rows = ["SELECT 0 AS part, 0 AS seq_id, 'AC' || chr(9) || 'MOTIF0' AS line", "SELECT 0, 1, 'XX'", "SELECT 0, 2, 'TY' || chr(9) || 'Motif'", "SELECT 0, 3, 'XX'", "SELECT 0, 4, concat_ws(chr(9), 'P0', 'A', 'C', 'G', 'T')"]
    rows += [f"SELECT 0, {5 + k}, concat_ws(chr(9), '{k + 1:02d}', {', '.join(f'trunc(count(site) * {x!r}::DOUBLE)::BIGINT' for x in row)}) FROM placed" for k, row in enumerate(MATRIX)]
    tail = ["'XX'", f"'AT' || chr(9) || 'GEO_P={FIRST.p:g}'", f"'AT' || chr(9) || 'GEO_delta={FIRST.delta}'", "'XX'"]
    rows += [f"SELECT 0, {5 + w + i}, {x}" for i, x in enumerate(tail)] + ["SELECT 2, 0, 'XX'", "SELECT 2, 1, '//'"]
    rows.append(f"SELECT 1, seq_id, 'BS' || chr(9) || substr(seq, site + 1, {w}) || '; sequence_' || seq_id::VARCHAR || '; ' || site::VARCHAR || '; {w};  ;+' FROM placed WHERE site IS NOT NULL")
    return " UNION ALL ".join(rows)


_POWER = f"pow(10.0, {_draw(DRAW_SEED, 'number', chr(39) + 'power' + chr(39))} * {simulate.POWERS[1] - simulate.POWERS[0]!r}::DOUBLE + {simulate.POWERS[0]!r}::DOUBLE)"
_BACKGROUND = "[" + ", ".join(f"{x!r}::DOUBLE" for x in simulate.BACKGROUND) + "]"

SQL = {
    "drawn_pwm": f"""WITH w AS (SELECT number, k, b, pow(-ln({_draw(DRAW_SEED, "number", "k", "b")}), {_POWER}) AS w FROM range(0, {TRIES}) n(number), range(0, {WIDTH}) c(k), range(0, 4) l(b)),
p AS (SELECT number, k, b, greatest(w / sum(w) OVER (PARTITION BY number, k), 1e-300) AS p FROM w),
hit AS (SELECT number FROM p GROUP BY number HAVING abs(sum(p * abs(log2(p / {_BACKGROUND}[b + 1]))) / {WIDTH} - {TARGET}) <= 0.005)
SELECT (k + 1)::INTEGER AS k, substr('ACGT', b::INTEGER + 1, 1) AS base, round(p, 6) AS p FROM p WHERE number = (SELECT min(number) FROM hit)""",
    "plant_sites": f"WITH {SEQS} " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, seq_id, site, structured, md5(seq) AS seq FROM ({_placed('seqs', replace(FIRST, structure=kind), SEED)})" for kind in simulate.STRUCTURES),
    "simulate_data": f"""WITH {SEQS}, one AS ({_placed("seqs", FIRST, SEED)}), two AS ({_placed("one", SECOND, SEED + 1)}),
ev AS (SELECT seq_id, pos, count(*) AS n FROM ({_events("one", FIRST, SEED)} UNION ALL {_events("two", SECOND, SEED + 1)}) GROUP BY seq_id, pos),
sums AS (SELECT seq_id, sum(n) AS events, sum(n * pos) AS places, sum(n * n * (pos + 1)) AS squares FROM ev GROUP BY seq_id)
SELECT seq_id, md5(two.seq) AS seq, one.site AS first, two.site AS second, length(two.seq)::INTEGER AS n, coalesce(events, 0)::BIGINT AS events, coalesce(places, 0)::BIGINT AS places,
coalesce(squares, 0)::BIGINT AS squares FROM one JOIN two USING (seq_id) LEFT JOIN sums USING (seq_id)""",
    "truth_record": f"WITH {SEQS}, placed AS ({_placed('seqs', FIRST, SEED)}), lines AS ({_record()}) SELECT part::INTEGER AS part, seq_id::BIGINT AS seq_id, line FROM lines",
}
