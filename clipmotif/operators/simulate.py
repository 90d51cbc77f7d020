"""Test data for motif discovery: occurrences, structure and cross-link events planted into sequences.

All draws hash a seed with the row's key, so that results do not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmotif.functions.prob import filled, geometric, let, uniform
from clipmotif.functions.seq import reverse_complement
from clipmotif.operators import lineage

#: fixed values: background of A, C, G, T; stem, loop and where in the stem a motif begins
BACKGROUND = (0.3, 0.2, 0.2, 0.3)
STEM, LOOP, OFFSET = 10, 15, 3
#: powers of ten between which the common power of a drawn matrix lies
POWERS = (-1.3, 1.3)
STRUCTURES = ("unstructured", "dsRNA", "ssRNA", "stem")


def relative_information(matrix: list[list[float]]) -> float:
    """Mean over the columns of the sum of p |log2(p / background)|."""
    p = np.maximum(np.asarray(matrix, float), 1e-300)
    return float((p * np.abs(np.log2(p / np.array(BACKGROUND)))).sum(axis=1).mean())


def pwm_tries(spark: SparkSession, width: int, seed: int, first: int, last: int) -> DataFrame:
    """Rows (number, matrix, information) of random matrices of ``width`` columns.

    A column's shares are exponential variates, that is one draw of a flat Dirichlet distribution, raised to a power
    that a try's columns have in common, so that matrices of little and of much information are drawn alike.
    """
    u = lambda *keys: uniform(F.col("number"), *keys, seed=seed)
    power = F.pow(F.lit(10.0), u(F.lit("power")) * (POWERS[1] - POWERS[0]) + POWERS[0])
    weights = lambda k: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.pow(-F.log(u(k, b)), F.col("power")))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    column = lambda k: let(weights(k), lambda w: let(total(w), lambda t: F.transform(w, lambda x: F.greatest(x / t, F.lit(1e-300)))))
    drawn = spark.range(first, last).withColumnRenamed("id", "number").withColumn("power", power)
    drawn = drawn.withColumn("matrix", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), column))
    background = F.array(*[F.lit(x) for x in BACKGROUND])
    bits = F.transform("matrix", lambda m: total(F.zip_with(m, background, lambda p, q: p * F.abs(F.log2(p / q)))))
    return drawn.select("number", "matrix", (total(bits) / width).alias("information"))


def draw_pwm(spark: SparkSession, width: int, target: float, seed: int, tolerance: float = 0.005, batch: int = 16_384, batches: int = 128) -> list[list[float]]:
    """The first of the random matrices whose mean information is within ``tolerance`` of the target.

    Tries are the rows of a job, a batch at a time; one row comes back.
    """
    for n in range(batches):
        tries = pwm_tries(spark, width, seed, n * batch, (n + 1) * batch).where(F.abs(F.col("information") - target) <= tolerance)
        found = tries.agg(F.min_by("matrix", "number").alias("matrix")).first()["matrix"]
        if found:
            return [list(row) for row in found]
    raise ValueError(f"no matrix of mean information {target} found")


def _pick(u: Column, shares) -> Column:
    """A base by a uniform number and the shares of A, C, G, T."""
    a, c, g, _ = np.cumsum(np.asarray(shares, float) / sum(shares))
    return F.when(u < float(a), "A").when(u < float(c), "C").when(u < float(g), "G").otherwise("T")


def random_sequences(spark: SparkSession, n: int, length: int, seed: int, shares=BACKGROUND) -> DataFrame:
    """Rows (seq_id, name, seq) of ``n`` background sequences."""
    ids = spark.range(n).withColumnRenamed("id", "seq_id")
    letters = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: _pick(uniform(F.col("seq_id"), F.lit("base"), i, seed=seed), shares))
    return ids.select("seq_id", F.concat(F.lit("sequence_"), (F.col("seq_id") + 1).cast("string")).alias("name"), F.array_join(letters, "").alias("seq"))


def occurrence(key: Column, matrix: list[list[float]], seed: int) -> Column:
    """A word drawn from the matrix."""
    return F.concat(*[_pick(uniform(key, F.lit("word"), F.lit(k), seed=seed), row) for k, row in enumerate(matrix)])


def _below(u: Column, n: Column) -> Column:
    return F.floor(u * n).cast("int")


@dataclass(frozen=True)
class Plant:
    """How a motif is planted: its matrix, the shares of sequences that have it and of those structured, and its events."""

    matrix: list[list[float]]
    share: float = 1.0
    structure: str = "unstructured"
    structured: float = 1.0
    events: int = 0
    noise: float = 0.0
    p: float = 0.2
    delta: int = 0


def place(seqs: DataFrame, plant: Plant, seed: int) -> DataFrame:
    """``seqs`` with occurrences written into them, and columns site (null without one) and structured.

    A stem puts the word OFFSET bases into the left arm and the arm's reverse complement LOOP bases later;
    dsRNA has the word wholly within an arm of its own width, ssRNA within the loop.
    """
    if plant.structure not in STRUCTURES:
        raise ValueError(f"unknown structure {plant.structure!r}; known are {', '.join(STRUCTURES)}")
    w = len(plant.matrix)
    u = lambda what: uniform(F.col("seq_id"), F.lit(what), seed=seed)
    has = (u("has") < plant.share) & (F.length("seq") >= w)
    own = seqs.withColumn("word", occurrence(F.col("seq_id"), plant.matrix, seed)).withColumn("has", has)
    arm = {"stem": max(STEM, OFFSET + w), "dsRNA": w, "ssRNA": STEM}.get(plant.structure, 0)
    loop = w if plant.structure == "ssRNA" else LOOP
    span = 2 * arm + loop if arm else w
    fits = F.col("has") & (F.length("seq") >= span) & (u("structured") < plant.structured) & F.lit(arm > 0)
    own = own.withColumn("structured", fits)
    at = {"stem": OFFSET, "dsRNA": 0, "ssRNA": arm}.get(plant.structure, 0)
    begin = F.when(F.col("structured"), _below(u("at"), F.length("seq") - span + 1) + at).otherwise(_below(u("at"), F.length("seq") - w + 1))
    own = own.withColumn("site", F.when(F.col("has"), begin))
    put = F.overlay("seq", "word", F.col("site") + 1)
    own = own.withColumn("seq", F.when(F.col("has"), put).otherwise(F.col("seq")))
    if arm:
        first = F.col("site") - at
        left = F.substring("seq", first + 1, F.lit(arm))
        folded = F.overlay("seq", reverse_complement(left), first + arm + loop + 1)
        own = own.withColumn("seq", F.when(F.col("structured"), folded).otherwise(F.col("seq")))
    return own.drop("word", "has")


def place_events(seqs: DataFrame, plant: Plant, seed: int) -> DataFrame:
    """Rows (seq_id, pos) of events: ceil(n (1 - noise)) at geometric distances around site + delta, the rest anywhere.

    A draw that falls outside the sequence is replaced by a uniform one, as are all of sequences without a site;
    an empty sequence has none.
    """
    draws = seqs.where("seq <> ''").select("seq_id", "site", F.length("seq").alias("len"), F.explode(F.sequence(F.lit(1), F.lit(plant.events))).alias("k")) if plant.events else None
    if draws is None:
        return seqs.select("seq_id", F.lit(0).cast("long").alias("pos")).where("false")
    real = int(np.ceil(plant.events * (1 - plant.noise)))
    u = lambda what: uniform(F.col("seq_id"), F.col("k"), F.lit(what), seed=seed)
    far = geometric(u("far"), plant.p) * F.when(u("side") < 0.5, -1).otherwise(1)
    near = F.when((F.col("k") <= real) & F.col("site").isNotNull(), F.col("site") + plant.delta + far)
    inside = near.isNotNull() & (near >= 0) & (near < F.col("len"))
    return draws.select("seq_id", F.when(inside, near).otherwise(_below(u("any"), F.col("len"))).cast("long").alias("pos"))


def simulate(seqs: DataFrame, plants: list[Plant], seed: int = 1) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Sequences with all motifs planted one after the other, (seq_id, counts) of all events, and each motif's sites.

    What a motif makes of the sequences is checkpointed: a filter on it would else be pushed down to where every draw
    stands in it many times over, the more so with each motif.
    """
    events, truth = None, []
    for k, plant in enumerate(plants):
        placed = lineage.cut(place(seqs, plant, seed + k))
        found = place_events(placed, plant, seed + k)
        events = found if events is None else events.unionByName(found)
        truth.append(placed.select("seq_id", "name", "seq", "site", "structured"))
        seqs = placed.drop("site", "structured")
    n = events.groupBy("seq_id", "pos").agg(F.count("*").alias("value")).groupBy("seq_id").agg(F.collect_list(F.struct("pos", "value")).alias("found"))
    counts = seqs.join(n, "seq_id", "left").select("seq_id", filled(F.col("found"), F.length("seq"), F.lit(0).cast("long")).alias("counts"))
    return seqs, counts, truth


def truth_lines(truth: DataFrame, plant: Plant, name: str) -> DataFrame:
    """Rows (part, seq_id, line): the planted motif as a tagged record with a BS line for every occurrence."""
    w = len(plant.matrix)
    place_of = F.concat_ws("; ", F.substring("seq", F.col("site") + 1, F.lit(w)), "name", F.col("site").cast("string"), F.lit(str(w)))
    lines = lineage.cut(truth.where("site IS NOT NULL").select(F.lit(1).alias("part"), "seq_id", F.concat(F.lit("BS\t"), place_of, F.lit(";  ;+")).alias("line")))
    n = lines.count()
    head = [f"AC\t{name}", "XX", "TY\tMotif", "XX", "P0\tA\tC\tG\tT", *("\t".join([f"{k + 1:02d}", *(str(int(n * x)) for x in row)]) for k, row in enumerate(plant.matrix)), "XX"]
    head += [f"AT\tGEO_P={plant.p:g}", f"AT\tGEO_delta={plant.delta}", "XX"]
    ends = [(0, i, x) for i, x in enumerate(head)] + [(2, 0, "XX"), (2, 1, "//")]
    return truth.sparkSession.createDataFrame(ends, "part int, seq_id long, line string").unionByName(lines)


def information_content(pwm: DataFrame) -> DataFrame:
    """Rows (k, bits, relative_bits) of ``pwm(k, base, p)``: 2 + sum p log2 p, and sum p log2(p / background)."""
    bg = F.col("base")
    share = F.when(bg == "A", BACKGROUND[0]).when(bg == "C", BACKGROUND[1]).when(bg == "G", BACKGROUND[2]).otherwise(BACKGROUND[3])
    term = lambda x: F.when(F.col("p") > 0, F.col("p") * F.log2(x)).otherwise(0.0)
    return pwm.groupBy("k").agg((2 + F.sum(term(F.col("p")))).alias("bits"), F.sum(term(F.col("p") / share)).alias("relative_bits"))


def location_histogram(places: DataFrame, bins: int = 160) -> DataFrame:
    """Rows (bin, n, density) of ``places(x)`` over equal bins between the least and the greatest."""
    ends = places.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    wide = F.col("hi") - F.col("lo")
    at = F.when(wide > 0, F.least(F.floor((F.col("x") - F.col("lo")) * bins / wide), F.lit(bins - 1))).otherwise(0)
    found = places.join(F.broadcast(ends)).select(at.alias("bin"), (wide / bins).alias("width")).groupBy("bin").agg(F.count("*").alias("n"), F.max("width").alias("width"))
    total = found.agg(F.sum("n").alias("total"))  # one row
    return found.join(F.broadcast(total)).select("bin", "n", F.when(F.col("width") > 0, F.col("n") / F.col("total") / F.col("width")).alias("density"))


def aggregate_pwm(matrices: DataFrame) -> DataFrame:
    """Rows (k, base, p): matrices (name, k, base, p) averaged base by base and normalised by column."""
    sums = matrices.groupBy("k", "base").agg(F.sum("p").alias("s"))
    whole = matrices.groupBy("k").agg(F.sum("p").alias("t"))
    return sums.join(whole, "k").select("k", "base", (F.col("s") / F.col("t")).alias("p"))
