"""Zero-or-one-occurrence motif models, fitted by expectation maximisation over all starts at once.

Sequences are ``(seq_id, seq)`` with, if wanted, ``ss`` (pairing probabilities) and ``d`` (normalised event
profiles).  Everything per site stays in Spark; what comes to the driver per round is a row per start.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmotif.functions.seq import mer2i
from clipmotif.operators import blocks as block_ops
from clipmotif.operators import de as de_ops
from clipmotif.operators.kmers import windows

#: fixed values of the model
PSEUDO = 0.1
TINY = 1e-100
MAX_ROUNDS = 10
TOLERANCE = 1e-10
EXPANSION = 0.75
OCCURS = 0.8


@dataclass(frozen=True)
class Model:
    """Parameters of one start: base probabilities by column, background, prior, structure and event terms."""

    start: int
    kmer: str
    matrix: tuple[tuple[float, ...], ...]
    f: tuple[float, ...] = (0.25,) * 4
    gamma: float = 0.5
    paired: tuple[float, ...] = ()
    f_paired: float = 0.5
    p: float = de_ops.GEO_P
    delta: int = 0
    ll: float = -math.inf
    trace: tuple[float, ...] = field(default=(), compare=False)
    #: the model and the sums of the last E-step, from which these parameters come
    prior: Model | None = field(default=None, compare=False, repr=False)
    sums: dict | None = field(default=None, compare=False, repr=False)

    @property
    def width(self) -> int:
        return len(self.matrix)


def seed_model(start: int, kmer: str, n_seqs: int, observed: int, structure: bool = False, p: float = de_ops.GEO_P, delta: int = 0) -> Model:
    """The model from which a k-mer starts: PSEUDO plus one for its base in each column; prior from how often it occurs."""
    matrix = tuple(tuple((PSEUDO + (b == c)) / (1 + 4 * PSEUDO) for b in "ACGT") for c in kmer)
    gamma = (n_seqs - EXPANSION * (n_seqs - observed)) / n_seqs
    return Model(start, kmer, matrix, gamma=gamma, paired=(0.5,) * len(kmer) if structure else (), p=p, delta=delta)


def site_facts(seqs: DataFrame, width: int, p: float = de_ops.GEO_P, weight: float = de_ops.WEIGHT) -> DataFrame:
    """What the E-step reads of every window over A, C, G, T.

    Without ``ss`` and ``d`` windows of equal k-mers in a sequence give one row (seq_id, code, n); otherwise
    there is a row per site with ``pos``, the window's slice of ``ss``, and the 17 log-likelihoods ``de``.
    """
    if {"ss", "d"} & set(seqs.columns):
        return site_rows(seqs, width, p, weight)
    return site_rows(seqs, width).groupBy("seq_id", "code").agg(F.count("*").alias("n"))


def site_rows(seqs: DataFrame, width: int, p: float = de_ops.GEO_P, weight: float = de_ops.WEIGHT) -> DataFrame:
    """``site_facts`` with a row per site in any case."""
    return _rows(de_ops.with_logs(seqs, p, weight) if "d" in seqs.columns else seqs, width)


def _rows(seqs: DataFrame, width: int) -> DataFrame:
    """Rows per site of sequences whose ``d`` holds the logs of ``with_logs``."""
    more = [c for c in ("ss", "d", "at") if c in seqs.columns]
    own = windows(seqs, width, *more)
    cols = ["seq_id", "pos", mer2i(F.col("kmer"), width).alias("code"), F.lit(1).cast("long").alias("n")]
    if "ss" in more:
        cols.append(F.slice("ss", F.col("pos") + 1, F.lit(width)).alias("ss"))
    if "d" in more:
        cols.append(F.slice("d", F.col("pos") + 1, F.lit(17)).alias("de"))
    return own.select(*cols, *[c for c in more if c == "at"])


def base_counts(seqs: DataFrame) -> DataFrame:
    """Rows (seq_id, A, C, G, T), and with structure A_paired …: letters of each base, N's not counted."""
    own = seqs.select("seq_id", F.upper("seq").alias("seq"), *[c for c in ("ss",) if c in seqs.columns])
    count = lambda b: (F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("double")
    cols = [count(b).alias(b) for b in "ACGT"]
    if "ss" in seqs.columns:
        letters = F.split("seq", "")

        def paired(b: str) -> Column:
            weights = F.zip_with(letters, "ss", lambda c, s: F.when(c == b, s).otherwise(0.0))
            return F.aggregate(weights, F.lit(0.0), lambda a, x: a + x).alias(f"{b}_paired")

        cols += [paired(b) for b in "ACGT"]
    return own.select("seq_id", *cols)


def _logs(model: Model) -> list[float]:
    return [math.log(max(m, TINY)) - math.log(max(f, TINY)) for row in model.matrix for m, f in zip(row, model.f, strict=True)]


def digit(code: Column, k: int, width: int) -> Column:
    return F.shiftright(code, 2 * (width - 1 - k)).bitwiseAND(3).cast("int")


def _log_odds(x: float, y: float) -> float:
    return math.log(max(x, TINY)) - math.log(max(y, TINY))


def _terms(model: Model) -> tuple[list[float], list[float], list[float], float]:
    """Of a model the log odds of bases by column, of paired and of unpaired columns, and a bound of a site's whole."""
    w = _logs(model)
    on = [_log_odds(s, model.f_paired) for s in model.paired]
    off = [_log_odds(1 - s, 1 - model.f_paired) for s in model.paired]
    # the event term is the log of a probability, so it adds nothing to the bound
    return w, on, off, sum(max(w[4 * k : 4 * k + 4]) for k in range(model.width)) + sum(map(max, on, off))


def term(model: Model) -> block_ops.Term:
    """How a model scores the sites of blocks."""
    w, on, off, _ = _terms(model)
    return block_ops.Term(model.start, tuple(w), tuple(on), tuple(off), model.delta, float(model.gamma), min(1 - model.gamma + TINY, 1.0))


def _odds(columns: Sequence[str], width: int, w: Column, on: Column | None, off: Column | None, delta: Column) -> Column:
    """The log of a site's likelihood over the background's."""
    odds = F.lit(0.0)
    for k in range(width):
        odds = odds + F.get(w, digit(F.col("code"), k, width) + 4 * k)
        if on is not None:
            odds = odds + F.get("ss", F.lit(k)) * F.get(on, F.lit(k)) + (1 - F.get("ss", F.lit(k))) * F.get(off, F.lit(k))
    return odds + F.get("de", delta + 8) if "de" in columns else odds


def _with_odds(facts: DataFrame, models: Sequence[Model]) -> tuple[DataFrame, int, list[str]]:
    """``facts`` with ``odds0`` … for every model, how many, and the columns by which a sequence's rows are told.

    Facts with a column ``at`` hold rows for each model apart; the others serve all models.
    """
    width, structure = models[0].width, "ss" in facts.columns
    each = [_terms(m) for m in models]
    listed = lambda xs: F.array(*map(F.lit, xs))
    if "at" in facts.columns:
        own = facts.withColumn("m", F.get(F.array(*[F.struct(listed(w).alias("w"), listed(on).alias("on"), listed(off).alias("off"), F.lit(m.delta).alias("delta")) for m, (w, on, off, _) in zip(models, each, strict=True)]), F.col("at")))
        odds = _odds(facts.columns, width, F.col("m.w"), F.col("m.on") if structure else None, F.col("m.off") if structure else None, F.col("m.delta"))
        return own.select(*facts.columns, odds.alias("odds0")), 1, ["seq_id", "at"]
    odds = [_odds(facts.columns, width, listed(w), listed(on) if structure else None, listed(off) if structure else None, F.lit(m.delta)).alias(f"odds{i}") for i, (m, (w, on, off, _)) in enumerate(zip(models, each, strict=True))]
    return facts.select(*facts.columns, *odds), len(models), ["seq_id"]


def _spread(own: DataFrame, models: Sequence[Model], out) -> DataFrame:
    """A row for every model by ``out(i, start, gamma, bound)``; i is the number in the columns that hold a model's."""
    bounds = [_terms(m)[3] for m in models]
    if "at" in own.columns:
        pick = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("at"))
        return own.withColumn("m", out(0, pick([m.start for m in models]), pick([float(m.gamma) for m in models]), pick(bounds)))
    return own.withColumn("m", F.explode(F.array(*[out(i, F.lit(m.start), F.lit(float(m.gamma)), F.lit(b)) for i, (m, b) in enumerate(zip(models, bounds, strict=True))])))


def _chance(gamma: Column, s: Column, top: Column) -> Column:
    """What the shares of sites and that of no site sum to, all relative to ``top``."""
    return gamma * s + F.least(1 - gamma + TINY, F.lit(1.0)) * F.exp(-top)


def e_step(facts: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Rows of ``facts`` for every start with z, the probability of a site there, and q, that of one in the sequence.

    A site's likelihood relative to the background is a product over the window alone.  Sums by sequence, relative to the
    models' bounds, are partly made where rows lie, so that a long sequence meets in one row and not in one task; rows
    get them by a join, which splits a sequence of very many rows, and are multiplied by the starts after that.
    """
    own, n, keys = _with_odds(facts, models)
    bounds = [_terms(m)[3] for m in models]
    bound = lambda i: F.get(F.array(*map(F.lit, bounds)), F.col("at")) if "at" in keys else F.lit(bounds[i])
    own = own.select(*facts.columns, *[F.exp(F.col(f"odds{i}") - bound(i)).alias(f"rel{i}") for i in range(n)])
    sums = own.groupBy(*keys).agg(*[F.sum(F.col("n") * F.col(f"rel{i}")).alias(f"s{i}") for i in range(n)])
    own = own.join(sums, keys)

    def out(i: int, start: Column, gamma: Column, bound: Column) -> Column:
        total = _chance(gamma, F.col(f"s{i}"), bound)
        return F.struct(start.alias("start"), (gamma * F.col(f"rel{i}") / total).alias("z"), (gamma * F.col(f"s{i}") / total).alias("q"))

    return _spread(own, models, out).select(*facts.columns, "m.start", "m.z", "m.q")


def sequence_occupancy(facts: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Rows (start, seq_id, q) without those of the sites: one aggregate by sequence, relative to the models' bounds."""
    own, n, keys = _with_odds(facts, models)
    shares = lambda i, b: F.sum(F.col("n") * F.exp(F.col(f"odds{i}") - b)).alias(f"s{i}")
    bounds = [_terms(m)[3] for m in models]
    if "at" in keys:
        own = own.groupBy(*keys).agg(shares(0, F.get(F.array(*map(F.lit, bounds)), F.col("at"))))
    else:
        own = own.groupBy(*keys).agg(*[shares(i, F.lit(b)) for i, b in enumerate(bounds)])
    q = lambda i, start, gamma, bound: F.struct(start.alias("start"), (gamma * F.col(f"s{i}") / _chance(gamma, F.col(f"s{i}"), bound)).alias("q"))
    return _spread(own, models, q).select("m.start", "seq_id", "m.q")


def occupancy(sites: DataFrame) -> DataFrame:
    """Rows (start, seq_id, q) of the sites' rows."""
    return sites.groupBy("seq_id", "start").agg(F.max("q").alias("q"))


def expected_counts(sites: DataFrame, counts: DataFrame, width: int, occupied: DataFrame | None = None) -> DataFrame:
    """One row per start with all sums that the M-step and the likelihood need.

    fg_k_b, the expected bases of column k; q, the expected sequences with a site; q_b, their expected bases;
    with structure fgp_k_b, the paired part, and str_k, weighted by q as well; with events de_j by delta.
    Without structure and events sites are first summed by k-mer, or come so from ``kmer_sums``.
    """
    z = F.lit(1.0) if "zn" in sites.columns else F.col("z") * F.col("n")
    occupied = occupancy(sites) if occupied is None else occupied
    if not {"ss", "de", "zn"} & set(sites.columns):
        sites = sites.groupBy("start", "code").agg(F.sum(z).alias("zn"))
    z = F.col("zn") if "zn" in sites.columns else z
    aggs = []
    for k in range(width):
        d = digit(F.col("code"), k, width)
        for b in range(4):
            aggs.append(F.sum(F.when(d == b, z).otherwise(0.0)).alias(f"fg_{k}_{b}"))
            if "ss" in sites.columns:
                aggs.append(F.sum(F.when(d == b, z * F.get("ss", F.lit(k))).otherwise(0.0)).alias(f"fgp_{k}_{b}"))
        if "ss" in sites.columns:
            aggs.append(F.sum(F.col("q") * z * F.get("ss", F.lit(k))).alias(f"str_{k}"))
    if "de" in sites.columns:
        aggs += [F.sum(z * F.get("de", F.lit(j))).alias(f"de_{j}") for j in range(17)]
    by_site = sites.groupBy("start").agg(*aggs)
    own = occupied.join(counts, "seq_id")
    by_seq = own.groupBy("start").agg(F.sum("q").alias("q"), *[F.sum(F.col("q") * F.col(b)).alias(f"q_{b}") for b in "ACGT"])
    return by_site.join(by_seq, "start")


def kmer_sums(facts: DataFrame, models: Sequence[Model], codes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of facts (seq_id, code, n) the expected sites (start, code, zn) by k-mer, and (start, seq_id, q) by sequence.

    A k-mer's share of the background's likelihood is the same in every sequence, so it is computed once for each of the
    k-mers ``codes``, at most 4 ** width; a sequence then gives one number for each start, these are summed by k-mer,
    and shares are multiplied in at the end.  No row is multiplied by the starts before that, and facts dealt by
    seq_id are joined where they lie.  Numbers of the models stand in arrays, so that rounds share their compiled code.
    """
    width, n = models[0].width, len(models)
    each = [_terms(m) for m in models]
    listed = lambda xs: F.array(*map(F.lit, xs))
    weights = F.array(*[listed([*w, bound]) for w, _, _, bound in each])
    gamma, none = listed([float(m.gamma) for m in models]), listed([min(1 - m.gamma + TINY, 1.0) * math.exp(-x[3]) for m, x in zip(models, each, strict=True)])

    def share(w: Column) -> Column:
        odds = F.lit(0.0)
        for k in range(width):
            odds = odds + F.get(w, digit(F.col("code"), k, width) + 4 * k)
        return F.exp(odds - F.get(w, F.lit(4 * width)))

    codes = facts.select("code").distinct() if codes is None else codes
    shares = codes.select("code", F.transform(weights, share).alias("rel"))
    sums = facts.join(shares, "code").groupBy("seq_id").agg(*[F.sum(F.col("n") * F.get("rel", F.lit(i))).alias(f"s{i}") for i in range(n)])
    sums = sums.select("seq_id", F.array(*[f"s{i}" for i in range(n)]).alias("s"))
    part = lambda s, i: F.get(gamma, i) / (F.get(gamma, i) * s + F.get(none, i))
    parts = sums.select("seq_id", F.transform("s", part).alias("t"))
    met = facts.join(parts, "seq_id").groupBy("code").agg(*[F.sum(F.col("n") * F.get("t", F.lit(i))).alias(f"t{i}") for i in range(n)])
    met = met.join(shares, "code").select("code", "rel", F.array(*[f"t{i}" for i in range(n)]).alias("t"))
    starts = listed([m.start for m in models])
    rows = lambda value: F.explode(F.transform(starts, lambda start, i: F.struct(start.alias("start"), value(i).alias("x")))).alias("m")
    sites = met.select("code", rows(lambda i: F.get("t", i) * F.get("rel", i))).select("m.start", "code", F.col("m.x").alias("zn"))
    q = sums.select("seq_id", rows(lambda i: F.get("s", i) * part(F.get("s", i), i))).select("m.start", "seq_id", F.col("m.x").alias("q"))
    return sites, q


def totals(counts: DataFrame) -> dict[str, float]:
    """Number of sequences and sums of their base counts."""
    row = counts.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in counts.columns if c != "seq_id"]).first()
    return {k: float(v or 0) for k, v in row.asDict().items()}


def m_step(model: Model, row: dict, whole: dict[str, float], opt_delta: bool = True) -> Model:
    """New parameters from one row of ``expected_counts``; every base starts with a count of one."""
    w = model.width
    fg = [[1 + row[f"fg_{k}_{b}"] for b in range(4)] for k in range(w)]
    matrix = tuple(tuple(max(x / sum(c), TINY) for x in c) for c in fg)
    bg = [1 + w * whole[b] - sum(row[f"fg_{k}_{i}"] for k in range(w)) for i, b in enumerate("ACGT")]
    gamma = max(min(row["q"] / whole["n"], 1.0), TINY)
    new = replace(model, matrix=matrix, f=tuple(x / sum(bg) for x in bg), gamma=gamma)
    if model.paired:
        new = replace(new, paired=tuple(row[f"str_{k}"] / row["q"] if row["q"] > 0 else 0.5 for k in range(w)), f_paired=0.5)
    if "de_0" in row and opt_delta:
        new = replace(new, delta=max(range(17), key=lambda j: (row[f"de_{j}"], -j)) - 8)
    return new


def log_likelihood(model: Model, row: dict, whole: dict[str, float]) -> float:
    """The objective: base counts with their pseudo-counts, the event term, and sequences without a site."""
    w, log = model.width, lambda x: math.log(max(x, 1e-300))
    ll = 0.0
    for i, b in enumerate("ACGT"):
        fg = [row[f"fg_{k}_{i}"] for k in range(w)]
        if model.paired:
            fgp = [row[f"fgp_{k}_{i}"] for k in range(w)]
            on, off = model.f[i] * model.f_paired, model.f[i] * (1 - model.f_paired)
            ll += (1 + w * whole[f"{b}_paired"] - sum(fgp)) * log(on) + (1 + w * (whole[b] - whole[f"{b}_paired"]) - sum(fg) + sum(fgp)) * log(off)
            for k in range(w):
                ll += (1 + fgp[k]) * log(model.matrix[k][i] * model.paired[k]) + (1 + fg[k] - fgp[k]) * log(model.matrix[k][i] * (1 - model.paired[k]))
        else:
            ll += (1 + w * whole[b] - sum(fg)) * log(model.f[i]) + sum((1 + fg[k]) * log(model.matrix[k][i]) for k in range(w))
        ll += (whole[b] - row[f"q_{b}"]) * log(model.f[i])
    if "de_0" in row:
        ll += row[f"de_{model.delta + 8}"]
    return ll + (whole["n"] - row["q"]) * math.log(min(1 - model.gamma + TINY, 1.0)) + row["q"] * log(model.gamma)


def oops_likelihood(model: Model, row: dict, whole: dict[str, float]) -> float:
    """The objective when every sequence has a site: base counts alone."""
    w = model.width
    fg = [[1 + row[f"fg_{k}_{b}"] for b in range(4)] for k in range(w)]
    bg = [1 + w * whole[b] - sum(row[f"fg_{k}_{i}"] for k in range(w)) for i, b in enumerate("ACGT")]
    return sum(x * math.log(f) for x, f in zip(bg, model.f, strict=True)) + sum(x * math.log(m) for c, r in zip(fg, model.matrix, strict=True) for x, m in zip(c, r, strict=True))


def fit(
    facts: DataFrame | None, counts: DataFrame | None, models: Sequence[Model], rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, opt_delta: bool = True,
    live: DataFrame | None = None, weight: float = de_ops.WEIGHT, block_size: int = block_ops.SIZE,
) -> list[Model]:
    """EM for all starts together; a start whose likelihood no longer moves keeps its parameters.

    ``facts`` may be those of ``site_facts``, or ``blocks.site_blocks``, which need no ``counts``: a round is then one pass
    over the blocks from which every task sends a row a start.  With ``live`` (seq_id, seq, d and, if wanted, ss) in place of ``facts`` the events' p is fitted as well: in every
    round each start's events are weighed by its own p, and p and delta are then fitted to the sites of that round.
    """
    blocks = facts is not None and "first" in facts.columns
    several = blocks and block_ops.has_long(facts)
    coded = None
    if blocks and not {"ss", "d"} & set(facts.columns) and models[0].width <= block_ops.CODED:
        coded = block_ops.coded(facts, models[0].width).persist(StorageLevel.MEMORY_AND_DISK)
    whole = {} if blocks else totals(counts)
    going, done = list(models), []
    codes = None if blocks or facts is None or {"ss", "de"} & set(facts.columns) else facts.select("code").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(rounds):
        if live is not None:
            facts = _rows(de_ops.with_logs_by_start(live, [m.p for m in going], weight), going[0].width)
        if blocks:
            terms = [term(m) for m in going]
            if coded is not None and block_ops.spread(terms) < block_ops.SPREAD:
                found = block_ops.coded_sums(coded, facts.where("NOT whole") if several else None, terms, block_size)
            else:
                found = block_ops.round_sums(facts, terms, block_size, several)
            rows = {r["start"]: r.asDict() for r in found.collect() if sum(r[f"fg_0_{b}"] for b in range(4)) > 0}
            whole = {c: next(iter(rows.values()))[c] for c in ("n", *"ACGT", *[f"{b}_paired" for b in "ACGT" if "ss" in facts.columns])} if rows else {}
        elif {"ss", "de"} & set(facts.columns):
            sites, occupied = e_step(facts, going), None if live is not None else sequence_occupancy(facts, going)
        else:
            sites, occupied = kmer_sums(facts, going, codes)
        if live is not None:
            sites = sites.persist(StorageLevel.MEMORY_AND_DISK)
        if not blocks:
            rows = {r["start"]: r.asDict() for r in expected_counts(sites, counts, going[0].width, occupied).collect()}
        stepped = [m_step(m, rows[m.start], whole, opt_delta and live is None) if m.start in rows else None for m in going]
        if live is not None:
            stepped = _fit_events(sites, live, going, stepped, rows, opt_delta, weight)
            sites.unpersist()
        nxt = []
        for m, new in zip(going, stepped, strict=True):
            if new is None:  # no window anywhere
                done.append(m)
                continue
            ll = log_likelihood(new, rows[m.start], whole)
            still = bool(m.trace) and abs(m.trace[-1] - ll) / abs(m.trace[-1]) < tolerance
            new = replace(new, ll=ll, trace=(*m.trace, ll), prior=replace(m, prior=None, sums=None), sums=rows[m.start])
            (done if still else nxt).append(new)
        going = nxt
        if not going:
            break
    for kept in (codes, coded):
        if kept is not None:
            kept.unpersist()
    return sorted(done + going, key=lambda m: m.start)


def _fit_events(sites: DataFrame, live: DataFrame, models: Sequence[Model], stepped: list[Model | None], rows: dict, opt_delta: bool, weight: float) -> list[Model | None]:
    """The stepped models with p and delta fitted to the sites, and in ``rows`` the event term under them."""
    parts = sites.groupBy("seq_id", "at", F.floor(F.col("pos") / block_ops.SIZE).alias("block"))  # sums over rows add up
    own = parts.agg(F.collect_list("pos").alias("pos"), F.collect_list("z").alias("z"))
    own = own.join(live.select("seq_id", "d"), "seq_id").select("at", "d", "pos", "z").persist(StorageLevel.MEMORY_AND_DISK)
    found = de_ops.fit_geometry(own, [m.p for m in models], [list(de_ops.DELTAS) if opt_delta else [m.delta] for m in models])
    for r in de_ops.event_sums(own, [(at, delta, p) for at, (p, delta) in enumerate(found)], weight).collect():
        row = rows.get(models[r["at"]].start)
        if row:
            row[f"de_{r['delta'] + 8}"] = r["v"]
    own.unpersist()
    return [m and replace(m, p=p, delta=delta) for m, (p, delta) in zip(stepped, found, strict=True)]


def best_sites(seqs: DataFrame, model: Model, **terms: float) -> DataFrame:
    """Rows (seq_id, site, z, q): the first of the likeliest sites of each sequence, null without a window."""
    own, _, _ = _with_odds(site_rows(seqs, model.width, **terms), [model])
    bound, gamma = F.lit(_terms(model)[3]), F.lit(float(model.gamma))
    best = own.groupBy("seq_id").agg(F.max(F.struct(F.col("odds0").alias("odds"), (-F.col("pos")).alias("back"))).alias("b"), F.sum(F.exp(F.col("odds0") - bound)).alias("s"))
    total = _chance(gamma, F.col("s"), bound)
    z, q = gamma * F.exp(F.col("b.odds") - bound) / total, gamma * F.col("s") / total
    return seqs.select("seq_id").join(best.select("seq_id", (-F.col("b.back")).alias("site"), z.alias("z"), q.alias("q")), "seq_id", "left")


def mask_sites(seqs: DataFrame, best: DataFrame, width: int) -> DataFrame:
    """Sequences with N's over the best site where a motif occurs with probability OCCURS or more."""
    own = seqs.join(best.select("seq_id", "site", "q"), "seq_id", "left")
    masked = F.overlay("seq", F.lit("N" * width), (F.col("site") + 1).cast("int"), F.lit(width))
    return own.withColumn("seq", F.when(F.col("q") >= OCCURS, masked).otherwise(F.col("seq"))).select(*seqs.columns)
