"""Queries on motif models: scores, expectation and maximisation steps, likelihoods, sites, whole fits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipmotif.catalog.adapters import SEQS, counts, rounded, seqs, structure, windows_sql
from clipmotif.catalog.sequences import SQL as SEQUENCES_SQL
from clipmotif.operators import blocks, de, em, kmers, simulate
from clipmotif.plans import programs
from clipmotif.sources import writers

WIDTH = 6
MODEL = em.seed_model(0, "TGCATC", 1000, 500)
#: the same with structure that differs by column
MODEL_STR = em.replace(MODEL, paired=(0.2, 0.3, 0.4, 0.6, 0.7, 0.8))
MODEL_DE = em.replace(MODEL, delta=2)
MODEL_OTHER = em.seed_model(0, "ATTGCA", 1000, 300)


def _seqs(spark: SparkSession, sf_dir: str, ss: bool = False, d: bool = False) -> DataFrame:
    own = seqs(spark, sf_dir).where(F.length("seq") >= WIDTH).repartition("seq_id")
    if ss:
        own = own.withColumn("ss", structure(F.length("seq")))
    if d:
        own = own.withColumn("d", de.normalise(counts(F.length("seq"))))
    return own


def pwm_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model from which the most enriched k-mer starts; its prior in row 0."""
    own = seqs(spark, sf_dir)
    top = kmers.top_kmers(own, WIDTH, 1).first()
    rows = []
    if top:
        model = em.seed_model(0, top["kmer"], own.count(), top["observed"])
        rows = [(k + 1, b, float(p)) for k, row in enumerate(model.matrix) for b, p in zip("ACGT", row, strict=True)] + [(0, "", float(model.gamma))]
    return rounded(spark.createDataFrame(rows, "k int, base string, p double"), "p")


def _blocks(own: DataFrame) -> tuple[DataFrame, bool]:
    """The blocks of sequences, and whether some sequence has several."""
    long = own.where(F.length("seq") > blocks.SIZE + WIDTH - 1).limit(1).count() > 0
    return blocks.site_blocks(de.with_logs(own) if "d" in own.columns else own, WIDTH), long


def _occupancy(own: DataFrame, *models: em.Model) -> DataFrame:
    found, several = _blocks(own)
    return blocks.occupancy(found, [em.term(m) for m in models], several=several)


def estep_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_occupancy(_seqs(spark, sf_dir), MODEL).select("seq_id", "q"), "q")


def estep_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of probability 0.05 or more."""
    found, several = _blocks(_seqs(spark, sf_dir))
    return rounded(blocks.sites(found, em.term(MODEL), 0.05, several=several), "z")


def estep_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_occupancy(_seqs(spark, sf_dir, ss=True), MODEL_STR).select("seq_id", "q"), "q")


def estep_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_occupancy(_seqs(spark, sf_dir, d=True), MODEL_DE).select("seq_id", "q"), "q")


def _sums(own: DataFrame, model: em.Model) -> dict:
    """All sums of one round, by one pass over the blocks."""
    found, several = _blocks(own)
    return blocks.round_sums(found, [em.term(model)], several=several).first().asDict()


def _stepped(own: DataFrame, model: em.Model) -> tuple[em.Model, dict, dict]:
    row = _sums(own, model)
    return em.m_step(model, row, row), row, row


def _parameters(spark: SparkSession, model: em.Model, ll: float) -> DataFrame:
    rows = [("m", k + 1, b, p) for k, row in enumerate(model.matrix) for b, p in zip("ACGT", row, strict=True)]
    rows += [("f", 0, b, p) for b, p in zip("ACGT", model.f, strict=True)] + [("gamma", 0, "", model.gamma), ("ll", 0, "", ll)]
    rows += [("paired", k + 1, "", p) for k, p in enumerate(model.paired)]
    return rounded(spark.createDataFrame([(*r[:3], float(r[3])) for r in rows], "what string, k int, base string, value double"), "value")


def mstep_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model after one round, and its likelihood."""
    new, row, whole = _stepped(_seqs(spark, sf_dir), MODEL)
    return _parameters(spark, new, em.log_likelihood(new, row, whole) / whole["n"])


def mstep_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, row, whole = _stepped(_seqs(spark, sf_dir, ss=True), MODEL_STR)
    return _parameters(spark, new, em.log_likelihood(new, row, whole) / whole["n"])


def oops_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood after one round if every sequence had a site."""
    new, row, whole = _stepped(_seqs(spark, sf_dir), MODEL)
    return rounded(spark.createDataFrame([(float(em.oops_likelihood(new, row, whole) / whole["n"]),)], "ll double"), "ll")


def em_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model after the whole fit."""
    own = _seqs(spark, sf_dir)
    (new,) = em.fit(blocks.site_blocks(own, WIDTH), None, [MODEL])
    return _parameters(spark, new, new.ll / own.count())


def event_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood of every delta under the model's sites, per sequence."""
    row = _sums(_seqs(spark, sf_dir, d=True), MODEL_DE)
    return rounded(spark.createDataFrame([(d, row[f"de_{d + 8}"] / row["n"]) for d in de.DELTAS], "delta int, ll double"), "ll")


def event_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p after one Newton step from the default, sites weighted alike."""
    own = _seqs(spark, sf_dir, d=True)
    n = F.length("seq") - (WIDTH - 1)
    sites = own.select(F.lit(0).alias("at"), "d", F.sequence(F.lit(0), n - 1).alias("pos"), F.array_repeat(1 / n, n).alias("z"))
    sums = de.event_sums(sites, [(0, 0, de.GEO_P)])
    return rounded(sums.select((F.lit(de.GEO_P) - F.col("g") / F.col("h")).alias("p")), "p")


def event_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood of the events under p = 0.3 for some deltas, sites weighted alike, per sequence."""
    own = _seqs(spark, sf_dir, d=True)
    n = F.length("seq") - (WIDTH - 1)
    sites = own.select(F.lit(0).alias("at"), "d", F.sequence(F.lit(0), n - 1).alias("pos"), F.array_repeat(1 / n, n).alias("z"))
    count = own.count()
    return rounded(de.event_sums(sites, [(0, d, 0.3) for d in (-8, -3, 0, 4, 8)], slopes=False).select("delta", (F.col("v") / count).alias("ll")), "ll")


def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event term of every sequence, summed over its sites, for the least, the middle and the greatest delta."""
    found = de.cube(_seqs(spark, sf_dir, d=True).select("seq_id", "d"), WIDTH)
    sums = [F.sum(F.get("de", F.lit(k))).alias(name) for name, k in (("least", 0), ("middle", 8), ("greatest", 16))]
    return rounded(found.groupBy("seq_id").agg(*sums), "least", "middle", "greatest")


def _best(own: DataFrame) -> DataFrame:
    found, several = _blocks(own)
    return blocks.best_sites(found, em.term(MODEL), several=several, digits=None)


def _sited(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _seqs(spark, sf_dir)
    return own.join(_best(own), "seq_id").withColumn("name", F.concat(F.lit("sequence_"), F.col("seq_id").cast("string")))


def best_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sited(spark, sf_dir).select("seq_id", F.col("site").cast("long").alias("site"), "q"), "q")


def motif_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(writers.motif_rows(_sited(spark, sf_dir), WIDTH), "a", "c", "g", "t")


def motif_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.site_lines(_sited(spark, sf_dir), WIDTH).select("seq_id", F.substring_index("line", "\t", 2).alias("line"))


def motif_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record of a motif with attributes of structure and events, as lines."""
    record = writers.motif_record(_sited(spark, sf_dir), MODEL_STR, "M1", events=True)
    return record.select("part", "seq_id", F.when(F.col("part") == 1, F.substring_index("line", "\t", 2)).otherwise(F.col("line")).alias("line"))


def indicator_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every sequence to have each of two motifs, written as lines and read again."""
    found = _occupancy(_seqs(spark, sf_dir), MODEL, em.replace(MODEL_OTHER, start=1)).withColumnRenamed("start", "motif_rank")
    lines = writers.indicator_lines(found)
    return rounded(lines.select("motif_rank", "seq_id", F.col("line").cast("double").alias("q")), "q")


def mean_pwm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices of the first six letters of the sequences by the last digit of their ids, averaged."""
    own = _seqs(spark, sf_dir).select((F.col("seq_id") % 10).cast("string").alias("name"), F.posexplode(F.split(F.substring("seq", 1, WIDTH), "")).alias("k", "base")).where("base <> ''")
    n = own.groupBy("name", "k", "base").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("name", "k")))
    return rounded(simulate.aggregate_pwm(p.select("name", (F.col("k") + 1).alias("k"), "base", "p")), "p")


def masked_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _seqs(spark, sf_dir)
    masked = em.mask_sites(own, _best(own), WIDTH)
    return masked.select("seq_id", F.md5(F.col("seq").cast("binary")).alias("seq"))


def discover_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motifs of the texts' nucleotides, by the program's own numbers of motifs, starts and rounds."""
    found = programs.discover_motifs(seqs(spark, sf_dir), WIDTH)
    rows = [(r, m.number, m.model.kmer, k + 1, *map(float, p), float(m.model.gamma)) for r, m in enumerate(found) for k, p in enumerate(m.model.matrix)]
    return rounded(spark.createDataFrame(rows, "motif_rank int, motif int, kmer string, k int, a double, c double, g double, t double, gamma double"), "a", "c", "g", "t", "gamma")


QUERIES = {
    f.__name__: f
    for f in (
        pwm_seed, estep_occupancy, estep_sites, estep_structure, estep_events, mstep_model, mstep_structure, oops_likelihood, em_rounds, event_delta, event_newton, event_live, event_cube,
        best_sites, motif_counts, motif_site_lines, motif_record, indicator_text, mean_pwm, masked_sequences, discover_motifs,
    )
}

_LONG = SEQS.replace("FROM documents)", f"FROM documents WHERE length(regexp_replace(coalesce(text, ''), '[^ACGTUacgtu]', '', 'g')) >= {WIDTH})")


def _pick(base: str, values: list[str]) -> str:
    return f"(CASE {base} WHEN 'A' THEN {values[0]} WHEN 'C' THEN {values[1]} WHEN 'G' THEN {values[2]} ELSE {values[3]} END)"


def _number(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _odds(model: em.Model) -> str:
    terms = [_pick(f"substr(kmer, {k + 1}, 1)", [_number(math.log(m) - math.log(f)) for m, f in zip(row, model.f, strict=True)]) for k, row in enumerate(model.matrix)]
    for k, s in enumerate(model.paired):
        ss = f"(((pos + {k}) * 37 + seq_id) % 101 / 100)"
        terms.append(f"{ss} * {_number(math.log(s / model.f_paired))} + (1 - {ss}) * {_number(math.log((1 - s) / (1 - model.f_paired)))}")
    return " + ".join(terms)


def _sites(model: em.Model, events: bool = False) -> str:
    """CTEs up to site: (seq_id, pos, kmer, z, q); with events the likelihood of those around the model's delta counts."""
    g = _number(model.gamma)
    odds, given, more = _odds(model), "windows", ""
    if events:
        more = f", {_smooth(1 - de.GEO_P, de.WEIGHT)}"
        odds, given = f"{odds} + {_number(de.WEIGHT * math.log(de.GEO_P))} + ln(g0)", f"windows JOIN g USING (seq_id) WHERE c = pos + {model.delta}"
    return f"""{_LONG}, {windows_sql(WIDTH)}{more}, scored AS (SELECT seq_id, pos, kmer, {odds} AS odds FROM {given}), top AS (SELECT *, max(odds) OVER (PARTITION BY seq_id) AS top FROM scored),
rel AS (SELECT *, exp(odds - top) AS rel, (1 - {g}) * exp(-top) AS no FROM top), tot AS (SELECT *, sum(rel) OVER (PARTITION BY seq_id) AS s FROM rel),
site AS (SELECT seq_id, pos, kmer, {g} * rel / ({g} * s + no) AS z, {g} * s / ({g} * s + no) AS q FROM tot)"""


def _smooth(rest: float, weight: float) -> str:
    """CTEs up to g: (seq_id, len, c, g0, g1, g2), for every position c of a sequence the sums over k of d[k] r ** t,
    d[k] t r ** (t - 1) and d[k] t (t - 1) r ** (t - 2), t = |k - c|, r = rest ** weight.

    From either end powers are summed within blocks of 512 positions and carried over from the block before; what lies
    two blocks off counts less than 1e-30.
    """
    r = f"pow({_number(rest)}, {_number(weight)})"
    t = [f"coalesce(t{k}, 0)" for k in range(3)]
    return f"""dd AS (SELECT seq_id, len, i, (c + 1) / sum(c + 1) OVER (PARTITION BY seq_id) AS d FROM (SELECT seq_id, len, i, (seq_id * 31 + i * 17) % 5 AS c
  FROM (SELECT seq_id, length(seq) AS len, unnest(range(0, length(seq))) AS i FROM seqs))),
du AS (SELECT *, x // 512 AS b, (x % 512)::DOUBLE AS u, {r} AS r FROM (SELECT seq_id, len, 0 AS way, i AS x, d FROM dd UNION ALL SELECT seq_id, len, 1, len - 1 - i, d FROM dd)),
dp AS (SELECT *, sum(d * pow(r, -u)) OVER w AS p0, sum(d * u * pow(r, -u)) OVER w AS p1, sum(d * u * u * pow(r, -u)) OVER w AS p2 FROM du
  WINDOW w AS (PARTITION BY seq_id, way, b ORDER BY u ROWS UNBOUNDED PRECEDING)),
dt AS (SELECT seq_id, way, b + 1 AS b, sum(d * pow(r, 512 - u)) AS t0, sum(d * (512 - u) * pow(r, 512 - u)) AS t1, sum(d * (512 - u) * (512 - u) * pow(r, 512 - u)) AS t2 FROM du GROUP BY seq_id, way, b),
df AS (SELECT seq_id, len, CASE WHEN way = 0 THEN x ELSE len - 1 - x END AS c, d, pow(r, u) * (p0 + {t[0]}) AS f0, pow(r, u - 1) * (u * p0 - p1 + u * {t[0]} + {t[1]}) AS f1,
  pow(r, u - 2) * ((u * u - u) * p0 - (2 * u - 1) * p1 + p2 + (u * u - u) * {t[0]} + (2 * u - 1) * {t[1]} + {t[2]}) AS f2 FROM dp LEFT JOIN dt USING (seq_id, way, b)),
g AS (SELECT seq_id, len, c, sum(f0) - max(d) AS g0, sum(f1) AS g1, sum(f2) AS g2 FROM df GROUP BY seq_id, len, c)"""


def _rounds_sql(model: em.Model, rounds: int) -> str:
    """The model after so many rounds, one after the other, on the k-mers of each sequence."""
    cells = [(k, b) for k in range(WIDTH) for b in "ACGT"]
    bases = ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS n{b}" for b in "ACGT")
    start = [f"{_number(model.matrix[k]['ACGT'.index(b)])} AS m{k}{b}" for k, b in cells] + [f"{_number(f)} AS b{b}" for f, b in zip(model.f, "ACGT", strict=True)] + [f"{_number(model.gamma)} AS gamma"]
    bg = lambda b: f"(1 + {WIDTH} * t{b} - ({' + '.join(f'f{k}{b}' for k in range(WIDTH))}))"
    col = lambda k: "(4 + " + " + ".join(f"f{k}{b}" for b in "ACGT") + ")"
    new = [f"(1 + f{k}{b}) / {col(k)} AS m{k}{b}" for k, b in cells] + [f"{bg(b)} / ({' + '.join(map(bg, 'ACGT'))}) AS b{b}" for b in "ACGT"] + ["least(qs / n, 1.0) AS gamma"]
    odds = " + ".join(_pick(f"substr(kmer, {k + 1}, 1)", [f"(ln(m{k}{b}) - ln(b{b}))" for b in "ACGT"]) for k in range(WIDTH))
    fg = ", ".join(f"sum(CASE WHEN substr(kmer, {k + 1}, 1) = '{b}' THEN z ELSE 0 END) AS f{k}{b}" for k, b in cells)
    parts = [f"WITH {_LONG}, {windows_sql(WIDTH)}, wk AS MATERIALIZED (SELECT seq_id, kmer, count(*)::DOUBLE AS n FROM windows GROUP BY ALL), km AS MATERIALIZED (SELECT DISTINCT kmer FROM wk)",
        f"base AS MATERIALIZED (SELECT seq_id, {bases} FROM seqs)", f"par0 AS (SELECT {', '.join(start)})"]
    for i in range(1, rounds + 1):
        parts += [
            f"od{i} AS MATERIALIZED (SELECT kmer, exp({odds}) AS rel, gamma AS g FROM km, par{i - 1})",
            f"su{i} AS MATERIALIZED (SELECT seq_id, sum(n * rel) AS s, any_value(g) AS g FROM wk JOIN od{i} USING (kmer) GROUP BY seq_id)",
            f"fg{i} AS (SELECT {fg} FROM (SELECT kmer, sum(n * o.g * rel / (o.g * s + 1 - o.g)) AS z FROM wk JOIN od{i} o USING (kmer) JOIN su{i} USING (seq_id) GROUP BY kmer))",
            f"sq{i} AS (SELECT count(*) AS n, sum(q) AS qs, {', '.join(f'sum(n{b}) AS t{b}, sum(q * n{b}) AS q{b}' for b in 'ACGT')} FROM base JOIN (SELECT seq_id, g * s / (g * s + 1 - g) AS q FROM su{i}) USING (seq_id))",
            f"par{i} AS MATERIALIZED (SELECT *, {', '.join(new)} FROM fg{i}, sq{i})",
        ]
    ll = [f"{bg(b)} * ln(b{b}) + (t{b} - q{b}) * ln(b{b})" for b in "ACGT"] + [f"(1 + f{k}{b}) * ln(m{k}{b})" for k, b in cells] + ["(n - qs) * ln(least(1 - gamma + 1e-100, 1)) + qs * ln(gamma)"]
    rows = [f"SELECT 'm' AS what, {k + 1} AS k, '{b}' AS base, round(m{k}{b}, 6) AS value FROM par{rounds}" for k, b in cells] + [f"SELECT 'f', 0, '{b}', round(b{b}, 6) FROM par{rounds}" for b in "ACGT"]
    rows += [f"SELECT 'gamma', 0, '', round(gamma, 6) FROM par{rounds}", f"SELECT 'll', 0, '', round(({' + '.join(ll)}) / n, 6) FROM par{rounds}"]
    return ",\n".join(parts) + "\n" + " UNION ALL ".join(rows)


_BEST = f"""WITH {_sites(MODEL)}, best AS (SELECT seq_id, arg_max(pos, (z, -pos))::BIGINT AS site, max(q) AS q FROM site GROUP BY seq_id)"""


def _record_sql() -> str:
    """The lines of ``motif_record``."""
    count = lambda k, b: f"(coalesce(sum(CASE WHEN substr(seq, site + {k + 1}, 1) = '{b}' THEN q END), 0) + {_number(MODEL_STR.matrix[k]['ACGT'.index(b)])})::DOUBLE"
    rows = ["SELECT 0 AS part, 0 AS seq_id, 'AC' || chr(9) || 'M1' AS line", "SELECT 0, 1, 'XX'", "SELECT 0, 2, 'TY' || chr(9) || 'Motif'", "SELECT 0, 3, 'XX'", "SELECT 0, 4, concat_ws(chr(9), 'P0', 'A', 'C', 'G', 'T')"]
    rows += [f"SELECT 0, {5 + k}, concat_ws(chr(9), '{k + 1:02d}', {', '.join(f'trunc({count(k, b)})::BIGINT' for b in 'ACGT')}) FROM hit" for k in range(WIDTH)]
    tail = ["XX", "AT' || chr(9) || 'SEC_STR=" + ",".join(f"{x:g}" for x in MODEL_STR.paired), "XX", f"AT' || chr(9) || 'GEO_P={MODEL_STR.p:g}", f"AT' || chr(9) || 'GEO_DELTA={MODEL_STR.delta}", "XX"]
    rows += [f"SELECT 0, {5 + WIDTH + i}, '{x}'" for i, x in enumerate(tail)] + ["SELECT 2, 0, 'XX'", "SELECT 2, 1, '//'"]
    rows.append(f"SELECT 1, seq_id, 'BS' || chr(9) || substr(seq, site + 1, {WIDTH}) || '; sequence_' || seq_id::VARCHAR || '; ' || site::VARCHAR || '; {WIDTH};  ;+' FROM hit")
    every = " UNION ALL ".join(rows)
    return f"""{_BEST},
hit AS (SELECT seq_id, seq, site, q FROM best JOIN seqs USING (seq_id) WHERE q >= 0.8), lines AS ({every})
SELECT part::INTEGER AS part, seq_id::BIGINT AS seq_id, line FROM lines WHERE EXISTS (SELECT 1 FROM hit)"""


def _round_sql(model: em.Model) -> tuple[str, list[str]]:
    """CTEs of one round from ``model`` up to done, a row of its parameters and likelihood, and their SELECTs.

    par has the counts f{k}{base}, the totals and the new parameters."""
    ss = lambda k: f"(((pos + {k}) * 37 + seq_id) % 101 / 100)"
    fg = ", ".join(f"sum(CASE WHEN substr(kmer, {k + 1}, 1) = '{b}' THEN z ELSE 0 END) AS f{k}{b}" for k in range(WIDTH) for b in "ACGT")
    st = "".join(f", sum(q * z * {ss(k)}) AS s{k}" for k in range(WIDTH)) if model.paired else ""
    st += "".join(f", sum(CASE WHEN substr(kmer, {k + 1}, 1) = '{b}' THEN z * {ss(k)} ELSE 0 END) AS p{k}{b}" for k in range(WIDTH) for b in "ACGT") if model.paired else ""
    bases = ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS n{b}" for b in "ACGT")
    paired = ""
    if model.paired:
        paired = f", pb AS (SELECT {', '.join(f"sum(CASE WHEN substr(seq, i + 1, 1) = '{b}' THEN (i * 37 + seq_id) % 101 / 100 ELSE 0 END) AS w{b}" for b in 'ACGT')} FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS i FROM seqs))"
    bg = lambda b: f"(1 + {WIDTH} * t{b} - ({' + '.join(f'f{k}{b}' for k in range(WIDTH))}))"
    all_bg = " + ".join(bg(b) for b in "ACGT")
    col = lambda k: "(4 + " + " + ".join(f"f{k}{b}" for b in "ACGT") + ")"
    params = [f"(1 + f{k}{b}) / {col(k)} AS m{k}{b}" for k in range(WIDTH) for b in "ACGT"] + [f"{bg(b)} / ({all_bg}) AS b{b}" for b in "ACGT"] + ["least(qs / n, 1.0) AS gamma"]
    if model.paired:
        params += [f"s{k} / qs AS c{k}" for k in range(WIDTH)]
        ll = [f"(1 + {WIDTH} * w{b} - ({' + '.join(f'p{k}{b}' for k in range(WIDTH))})) * ln(b{b} * 0.5) + ({bg(b)} + 1 - (1 + {WIDTH} * w{b} - ({' + '.join(f'p{k}{b}' for k in range(WIDTH))}))) * ln(b{b} * 0.5)" for b in "ACGT"]
        ll += [f"(1 + p{k}{b}) * ln(m{k}{b} * c{k}) + (1 + f{k}{b} - p{k}{b}) * ln(m{k}{b} * (1 - c{k}))" for k in range(WIDTH) for b in "ACGT"]
    else:
        ll = [f"{bg(b)} * ln(b{b})" for b in "ACGT"] + [f"(1 + f{k}{b}) * ln(m{k}{b})" for k in range(WIDTH) for b in "ACGT"]
    ll += [f"(t{b} - q{b}) * ln(b{b})" for b in "ACGT"] + ["(n - qs) * ln(1 - gamma) + qs * ln(gamma)"]
    rows = [f"SELECT 'm' AS what, {k + 1} AS k, '{b}' AS base, round(m{k}{b}, 6) AS value FROM done" for k in range(WIDTH) for b in "ACGT"]
    rows += [f"SELECT 'f', 0, '{b}', round(b{b}, 6) FROM done" for b in "ACGT"] + ["SELECT 'gamma', 0, '', round(gamma, 6) FROM done", "SELECT 'll', 0, '', round(ll, 6) FROM done"]
    rows += [f"SELECT 'paired', {k + 1}, '', round(c{k}, 6) FROM done" for k in range(len(model.paired))]
    return f"""WITH {_sites(model)}, fg AS (SELECT {fg}{st} FROM site), base AS (SELECT seq_id, {bases} FROM seqs), qq AS (SELECT seq_id, max(q) AS q FROM site GROUP BY seq_id),
sq AS (SELECT count(*) AS n, sum(q) AS qs, {', '.join(f'sum(n{b}) AS t{b}, sum(q * n{b}) AS q{b}' for b in 'ACGT')} FROM base JOIN qq USING (seq_id)){paired},
par AS (SELECT *, {', '.join(params)} FROM fg, sq{', pb' if paired else ''}), done AS (SELECT *, ({' + '.join(ll)}) / n AS ll FROM par)
""", rows


def _model_sql(model: em.Model) -> str:
    """The parameters and likelihood after one round from ``model``, as rows."""
    ctes, rows = _round_sql(model)
    return ctes + " UNION ALL ".join(rows)


def _oops_sql(model: em.Model) -> str:
    whole = lambda b: f"(1 + {WIDTH} * t{b} - ({' + '.join(f'f{k}{b}' for k in range(WIDTH))})) * ln(b{b})"
    terms = [whole(b) for b in "ACGT"] + [f"(1 + f{k}{b}) * ln(m{k}{b})" for k in range(WIDTH) for b in "ACGT"]
    return f"{_round_sql(model)[0]} SELECT round(({' + '.join(terms)}) / n, 6) AS ll FROM par"


def _events_at(rest: float, weight: float, c: str) -> str:
    """ln of the smoothed events at position ``c``, which may lie outside of the sequence of ``len``; g is joined at its nearest end."""
    return f"(ln(g0) + {_number(weight * math.log(rest))} * (greatest(0, -{c}) + greatest(0, {c} - term.len + 1)))"



SQL = {
    "pwm_seed": f"""WITH top AS (FROM ({SEQUENCES_SQL["kmer_top"].replace("LIMIT 10", "LIMIT 1")})), n AS (SELECT count(*) AS n FROM documents)
  SELECT k::INTEGER AS k, base, round(({em.PSEUDO} + CASE WHEN substr(kmer, k::INTEGER, 1) = base THEN 1 ELSE 0 END) / (1 + 4 * {em.PSEUDO}), 6) AS p
  FROM top, range(1, {WIDTH + 1}) t(k), unnest(['A', 'C', 'G', 'T']) u(base)
  UNION ALL SELECT 0, '', round((n - {em.EXPANSION} * (n - observed)) / n, 6) FROM top, n""",
    "estep_events": f"WITH {_sites(MODEL_DE, events=True)} SELECT seq_id, round(max(q), 6) AS q FROM site GROUP BY seq_id",
    "event_delta": f"""WITH {_sites(MODEL_DE, events=True)}, dl AS (SELECT unnest(range(-8, 9)) AS delta),
  term AS (SELECT delta, z, len, pos + delta AS c, seq_id FROM site JOIN (SELECT seq_id, length(seq) AS len FROM seqs) USING (seq_id), dl)
  SELECT delta::INTEGER AS delta, round(sum(z * ({_number(de.WEIGHT * math.log(de.GEO_P))} + {_events_at(1 - de.GEO_P, de.WEIGHT, "term.c")})) / (SELECT count(*) FROM seqs), 6) AS ll
  FROM term JOIN g ON g.seq_id = term.seq_id AND g.c = least(greatest(term.c, 0), term.len - 1) GROUP BY delta""",
    "event_newton": f"""WITH {_LONG}, {_smooth(1 - de.GEO_P, 1.0)} SELECT round({_number(de.GEO_P)} - sum((1 / {_number(de.GEO_P)} - g1 / g0) / (len - {WIDTH - 1}))
  / sum((-1 / {_number(de.GEO_P**2)} + g2 / g0 - (g1 / g0) * (g1 / g0)) / (len - {WIDTH - 1})), 6) AS p FROM g WHERE c <= len - {WIDTH}""",
    "event_live": f"""WITH {_LONG}, {_smooth(0.7, 1.0)}, term AS (SELECT seq_id, length(seq) AS len, delta, unnest(range(0, length(seq) - {WIDTH - 1})) + delta AS c FROM seqs, unnest([-8, -3, 0, 4, 8]) t(delta))
  SELECT delta::INTEGER AS delta, round(sum(({_number(math.log(0.3))} + {_events_at(0.7, 1.0, "term.c")}) / (term.len - {WIDTH - 1})) / (SELECT count(*) FROM seqs), 6) AS ll
  FROM term JOIN g ON g.seq_id = term.seq_id AND g.c = least(greatest(term.c, 0), term.len - 1) GROUP BY delta""",
    "event_cube": f"""WITH {_LONG}, {_smooth(1 - de.GEO_P, de.WEIGHT)}, term AS (SELECT seq_id, length(seq) AS len, delta, unnest(range(0, length(seq) - {WIDTH - 1})) + delta AS c FROM seqs, unnest([-8, 0, 8]) t(delta)),
  v AS (SELECT term.seq_id, delta, {_number(de.WEIGHT * math.log(de.GEO_P))} + {_events_at(1 - de.GEO_P, de.WEIGHT, "term.c")} AS v FROM term JOIN g ON g.seq_id = term.seq_id AND g.c = least(greatest(term.c, 0), term.len - 1))
  SELECT seq_id, round(sum(v) FILTER (delta = -8), 6) AS least, round(sum(v) FILTER (delta = 0), 6) AS middle, round(sum(v) FILTER (delta = 8), 6) AS greatest FROM v GROUP BY seq_id""",
    "oops_likelihood": _oops_sql(MODEL),
    "em_rounds": _rounds_sql(MODEL, em.MAX_ROUNDS),
    "motif_record": _record_sql(),
    "indicator_text": " UNION ALL ".join(f"SELECT {k}::INTEGER AS motif_rank, seq_id, q FROM (WITH {_sites(m)} SELECT seq_id, round(max(q), 6) AS q FROM site GROUP BY seq_id)" for k, m in enumerate((MODEL, MODEL_OTHER))),
    "mean_pwm": f"""WITH {_LONG}, l AS (SELECT seq_id % 10 AS name, k::INTEGER AS k, substr(seq, k, 1) AS base FROM seqs, range(1, {WIDTH + 1}) t(k)),
  p AS (SELECT name, k, base, count(*) / sum(count(*)) OVER (PARTITION BY name, k) AS p FROM l GROUP BY name, k, base) SELECT k, base, round(sum(p) / sum(sum(p)) OVER (PARTITION BY k), 6) AS p FROM p GROUP BY k, base""",
    "estep_occupancy": f"WITH {_sites(MODEL)} SELECT seq_id, round(max(q), 6) AS q FROM site GROUP BY seq_id",
    "estep_sites": f"WITH {_sites(MODEL)} SELECT seq_id, pos, round(z, 6) AS z FROM site WHERE z >= 0.05",
    "estep_structure": f"WITH {_sites(MODEL_STR)} SELECT seq_id, round(max(q), 6) AS q FROM site GROUP BY seq_id",
    "mstep_model": _model_sql(MODEL),
    "mstep_structure": _model_sql(MODEL_STR),
    "best_sites": f"{_BEST} SELECT seq_id, site, round(q, 6) AS q FROM best",
    "motif_counts": f"{_BEST} SELECT (k + 1)::INTEGER AS k, " + ", ".join(f"round(coalesce(sum(CASE WHEN substr(seq, site + k + 1, 1) = '{b}' THEN q END), 0), 6) AS {b.lower()}" for b in "ACGT")
    + f" FROM best JOIN seqs USING (seq_id), range({WIDTH}) t(k) WHERE q >= 0.8 GROUP BY k",
    "motif_site_lines": f"{_BEST} SELECT seq_id, 'BS' || chr(9) || substr(seq, site + 1, {WIDTH}) || '; sequence_' || seq_id::VARCHAR || '; ' || site::VARCHAR || '; {WIDTH};  ;+' AS line FROM best JOIN seqs USING (seq_id) WHERE q >= 0.8",
    "masked_sequences": f"{_BEST} SELECT seq_id, md5(CASE WHEN q >= 0.8 THEN substr(seq, 1, site) || repeat('N', {WIDTH}) || substr(seq, site + {WIDTH} + 1) ELSE seq END) AS seq FROM seqs LEFT JOIN best USING (seq_id)",
}
