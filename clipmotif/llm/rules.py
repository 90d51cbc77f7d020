"""Quality rules whose thresholds follow each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmotif.llm.common import col, cut, small, small_batches, texts_of

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
GAMMA = 1.02  # a sketch bucket spans this factor: quantiles are right within 1 %
LEAST = 200  # documents that the parent's fences count for where a group's are blended with them
SPREADS = 3.0  # distances from the median to the tail beyond which, and standard errors of a document within which, values are still ordinary
TAIL = 0.1  # share of a group's documents in each tail
#: metric: the column that its count is divided by, and whether low values fail too
METRICS = {
    "word_length": ("n_words", True),
    "symbol_share": ("n_words", False),
    "dup_line_share": ("n_lines", False),
    "repeat_share": ("n_words", False),
    "upper_share": ("n_words", False),
    "stutter_share": ("n_words", False),
}
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_stutter long"


def text_stats(text: str) -> tuple[int, ...]:
    """The columns of STATS for one text."""
    raw = text.encode("utf-8", "surrogatepass").split()
    n = len(raw)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    dup_lines = sum(c - 1 for c in Counter(lines).values())
    repeats = 0
    if n > 5:
        h = np.fromiter(map(hash, raw), dtype=np.int64, count=n).view(np.uint64)
        runs = np.zeros(n - 4, np.uint64)
        for k in range(5):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[k : n - 4 + k]
            runs ^= runs >> np.uint64(29)
        order = np.sort(runs)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            again = np.flatnonzero(np.isin(runs, twice))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + 5, -1)
            repeats = int(np.count_nonzero(np.cumsum(edge)[:n] > 0))
    return n, chars, symbols, dup_lines, repeats, len(lines), sum(map(bytes.isupper, raw)), sum(map(eq, raw, raw[1:]))


def stats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, source, STATS), one per row of ``docs``."""
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            values = np.array([text_stats(t) for t in texts_of(batch)], dtype=np.int64).reshape(-1, len(names))
            arrays = [batch.column(0), batch.column(1), batch.column(2), *(pa.array(v) for v in values.T)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "source", *names])

    own = docs.select(
        col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(col("source").cast("string"), F.lit("")).alias("source"), col("text").cast("string").alias("text"),
    )
    return own.mapInArrow(run, f"doc_id long, lang string, source string, {STATS}")


def metrics() -> dict[str, Column]:
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return {
        "word_length": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "n_words"),
        "stutter_share": per("n_stutter", "n_words"),
    }


def bucket(x: Column) -> Column:
    """Of a value the sketch's bucket: bucket i holds (GAMMA ** (i - 1), GAMMA ** i], -100000 holds zero."""
    return F.when(x > 0, F.ceil(F.log(x) / F.log(F.lit(GAMMA))).cast("int")).otherwise(-100_000)


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts per (level, lang, source, metric): level 2 by language and source, 1 by language, 0 of all.

    Sketches are merged by adding the counts of equal buckets, so higher levels come from lower ones and
    results don't depend on how rows are partitioned.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics().items()]))
    fine = measured.where("n_words > 0").select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))
    fine = cut(fine)
    by_lang = fine.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")).withColumn("source", F.lit("")).withColumn("level", F.lit(1))
    overall = fine.groupBy("metric", "bucket").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("")).withColumn("source", F.lit("")).withColumn("level", F.lit(0))
    return fine.withColumn("level", F.lit(2)).unionByName(by_lang).unionByName(overall)


def quantiles(sketch: DataFrame, group: list[str], qs: dict[str, float]) -> DataFrame:
    """Per group the number of values n and the named quantiles: of the least bucket that reaches the rank."""
    up = Window.partitionBy(*group).orderBy("bucket")
    ranked = sketch.withColumn("upto", F.sum("n").over(up)).withColumn("of", F.sum("n").over(Window.partitionBy(*group)))
    value = F.when(F.col("bucket") == -100_000, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    first = lambda q: F.min(F.when(F.col("upto") >= q * F.col("of"), F.struct("bucket", value.alias("value")))).getField("value")
    return ranked.groupBy(*group).agg(F.max("of").alias("n"), *[first(q).alias(name) for name, q in qs.items()])


def thresholds(measured: DataFrame) -> DataFrame:
    """Rows (level, lang, source, n, and low and high of every metric): the outer edge of the tail quantile's bucket,
    moved out by SPREADS times what lies between the median and that quantile."""
    q = quantiles(sketches(measured), ["level", "lang", "source", "metric"], {"low": TAIL, "mid": 0.5, "high": 1 - TAIL})
    of = lambda m, x, name: F.max(F.when(F.col("metric") == m, x)).alias(name)
    found = []
    for m, (_, low) in METRICS.items():
        found.append(of(m, F.col("high") * (GAMMA + 1) / 2 + SPREADS * (F.col("high") - F.col("mid")), f"{m}_high"))
        if low:
            found.append(of(m, F.col("low") * (GAMMA + 1) / (2 * GAMMA) - SPREADS * (F.col("mid") - F.col("low")), f"{m}_low"))
    return q.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *found)


def ordinary(fence: Column, n: Column, side: int) -> Column:
    """The greatest (side 1) or least (-1) share that a Poisson count at the fence's rate over ``n`` reaches within SPREADS
    standard errors, by Anscombe's square root: of x the root of x + 3/8 has the standard error 1/2."""
    rate, n = F.greatest(fence, F.lit(0.0)), F.greatest(n, F.lit(1))
    return rate + SPREADS**2 / (4 * n) + side * SPREADS * F.sqrt(rate / n + 0.375 / (n * n))


def quality_rules(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed), one per row.

    A document fails by the base rules, or where a metric lies outside the fences of its (lang, source):
    the tail quantiles of that group's sketch, moved out by SPREADS times their distance from the median.
    Fences are blended with those of the language, and these with those of all documents: the parent's
    count for ``least`` documents beside the group's own.  What a document of so few words or lines can show
    by chance, as a Poisson count at the fence, passes.  ``failed`` lists the metrics outside.

    A null text is empty and fails the base rules; null lang and source form their own group, named by
    the empty string; ties at a fence pass; repeated rows count each; other columns are not read; an
    empty table gives no row.
    """
    measured = cut(stats(docs))
    fences = cut(thresholds(measured))
    bounds = [c for c in fences.columns if c.endswith(("_high", "_low"))]
    pack = lambda name: F.struct("n", *bounds).alias(name)
    own = fences.where("level = 2").select("lang", "source", pack("own"))
    lang = fences.where("level = 1").select("lang", pack("of_lang"))
    whole = fences.where("level = 0").select(pack("of_all"))
    blend = lambda n, x, parent: (n * x + int(least) * parent) / (n + int(least))
    upper = lambda c: blend(F.col("of_lang.n"), F.col(f"of_lang.{c}"), F.col(f"of_all.{c}"))
    fence = F.struct(*[blend(F.col("own.n"), F.col(f"own.{c}"), upper(c)).alias(c) for c in bounds]).alias("fence")
    # beyond that many groups both sides are shuffled, and Spark splits the partitions of hot ones
    groups = small(own.join(lang, "lang").join(F.broadcast(whole)).select("lang", "source", fence), 100_000)
    fails = []
    for m, x in metrics().items():
        n, low = METRICS[m]
        out = x > ordinary(F.col(f"fence.{m}_high"), F.col(n), 1)
        if low:
            out = out | (x < ordinary(F.col(f"fence.{m}_low"), F.col(n), -1))
        fails.append(F.when(out, F.lit(m)))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measured.join(groups, ["lang", "source"], "left").withColumn("failed", F.array_compact(F.array(*fails)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed"),
    )
