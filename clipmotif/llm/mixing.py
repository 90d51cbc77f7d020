"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmotif.llm.common import col, cut, small

PATH = ("domain", "lang", "source")
BUCKETS = 4096  # ranges of the seeded order; only the range in which a leaf's prefix ends is sorted
MAX_BROADCAST_LEAVES = 50_000


def tokens(text: Column) -> Column:
    """Number of words of a text: runs of characters that are not ASCII white space."""
    spaced = F.coalesce(text, F.lit(""))
    for white in "\t\n\v\f\r":
        spaced = F.replace(spaced, F.lit(white), F.lit(" "))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    found = F.lit(int(weights.get("*", 1)))
    for key, w in weights.items():
        if key != "*":
            found = F.when(name == key, F.lit(int(w))).otherwise(found)
    return found.cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget``: the parent's ``from_parent`` split among siblings by weight, none above its capacity.

    Siblings are filled in order of capacity by weight: one whose part by weight, of what is still left
    among those not yet filled, reaches its capacity is full and gives up the rest to its siblings.
    """
    order = [F.col("capacity") / F.col("weight"), F.col("node")]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    some = nodes.where("weight > 0 AND capacity > 0")
    some = some.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(onward))
    full = wide("capacity") * wide("weights") <= (wide("from_parent") - wide("used")) * wide("weight")
    some = some.withColumn("full", full)
    kept = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0))
    rest = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), F.lit(0))
    some = some.withColumn("kept", kept).withColumn("rest", rest)
    part = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("cast((cast(from_parent - kept AS decimal(19,0)) * cast(weight AS decimal(10,0))) div rest AS long)"))
    return some.withColumn("budget", part).select(*parent, "node", "budget")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], total: Column, epochs: int) -> DataFrame:
    """Rows (domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens).

    ``weights`` has integer weights by level and name, "*" for those not named; 0 excludes.  ``total`` is
    an expression over sum(tokens).  What a node cannot use, up to ``epochs`` times its tokens, goes to its
    siblings; only what a whole set of siblings cannot use goes back to their parent's siblings, because a
    parent's own capacity is the sum of what its usable children can hold.  Parts are rounded down.
    """
    own = leaves.withColumn("capacity", F.col("tokens") * epochs)
    for level in PATH:
        own = own.withColumn("capacity", F.when(_weight(F.col(level), weights.get(level, {})) > 0, F.col("capacity")).otherwise(0))
    own = cut(own)
    at = own.agg(F.least(total, F.sum("capacity")).cast("long").alias("from_parent")).withColumn("all", F.lit(1))
    known = ["all"]
    for k, level in enumerate(PATH):
        nodes = own.withColumn("all", F.lit(1)).groupBy("all", *PATH[: k + 1]).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(at, known).withColumn("weight", _weight(F.col(level), weights.get(level, {})))
        split = _share(nodes.withColumn("node", F.col(level)), known)
        at = split.withColumnRenamed("node", level).withColumnRenamed("budget", "from_parent")
        known = [*known, level]
    return own.join(at.drop("all"), list(PATH), "left").select(*PATH, "tokens", F.coalesce("from_parent", F.lit(0)).alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], ratio: float = 0.5, epochs: int = 2, seed: str = "mix-1") -> DataFrame:
    """The mixture: columns of ``docs`` and then domain, n_tokens and copies, a row for each document it takes.

    The budget of ``ratio`` times the corpus's words is split down the tree domain, lang, source by
    ``budgets``.  A leaf takes its documents once for each whole epoch that its budget holds; of the next
    epoch it takes the longest prefix, in the order of md5(seed, epoch, doc_id), that the rest holds.
    ``copies`` counts both.  Documents are not shuffled: a narrow table of their lengths is summed per leaf and
    range of that order, and only the lengths in the range in which a prefix ends are sorted.

    Null lang, source and domain read as "", null text as empty; texts without words are never taken;
    ties go by doc_id and length, a null doc_id first; rows equal in both are
    taken if all of them fit; an empty table gives no row.
    Columns of ``docs`` named as the new ones are replaced, all others are passed on.
    """
    named = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    part = F.struct(
        F.coalesce(domain.cast("string"), F.lit("")).alias("domain"), F.coalesce(col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(col("source").cast("string"), F.lit("")).alias("source"), tokens(col("text")).alias("tokens"), F.coalesce(col("doc_id").cast("string"), F.lit("")).alias("id"),
    )
    leaf = [F.col(f"__p.{c}").alias(c) for c in PATH]
    # not filtered here: the filter would be pushed to the scan and count the words once more
    known = docs.select(*[col(c) for c in named], part.alias("__p"))
    narrow = cut(known.select("__p.*", col("doc_id").alias("doc_id"))).where("tokens > 0")
    plan = budgets(narrow.groupBy(*PATH).agg(F.sum("tokens").alias("tokens")), weights, F.floor(F.sum("tokens") * F.lit(ratio)), epochs)
    plan = cut(plan.where("budget > 0").withColumn("whole", F.expr("cast(budget div tokens AS int)")).withColumn("rest", F.expr("budget % tokens")).drop("tokens", "budget"))
    few = plan.count() <= MAX_BROADCAST_LEAVES
    ease = F.broadcast if few else (lambda x: x)
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.col("id")).cast("binary"))
    bucket = lambda o: F.conv(F.substring(o, 1, 3), 16, 10).cast("int")
    sums = narrow.join(ease(plan), list(PATH)).select(*PATH, "rest", bucket(order).alias("range"), F.col("tokens").alias("n"))
    sums = sums.groupBy(*PATH, "rest", "range").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*PATH).orderBy("range")
    ends = sums.withColumn("upto", F.sum("n").over(upto)).where("upto > rest").groupBy(*PATH).agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    plan = plan.join(ends, list(PATH), "left").select(*PATH, "whole", "rest", F.coalesce("end.range", F.lit(BUCKETS)).alias("end"), F.col("end.before").alias("before"))
    plan = cut(plan)
    run = Window.partitionBy(*PATH).orderBy("o", "doc_id", "tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = narrow.join(ease(plan), list(PATH)).withColumn("o", order).where(bucket(F.col("o")) == F.col("end"))
    last = last.withColumn("fits", F.sum("tokens").over(run) + F.col("before") <= F.col("rest")).where("fits")
    last = small(last.select(*[F.col(c).alias(f"__{c}") for c in PATH], F.col("id").alias("__id"), F.col("tokens").alias("__tokens")).distinct())
    plan = ease(plan.select(*[F.col(c).alias(f"__{c}") for c in PATH], F.struct("whole", "end").alias("__b")))
    same = [F.col(f"__p.{c}") == F.col(f"__{c}") for c in PATH]
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("__b.whole").cast("string"), F.col("__p.id")).cast("binary"))
    marked = known.join(plan, same).drop(*[f"__{c}" for c in PATH]).withColumn("__r", bucket(order))
    marked = marked.join(last, [*same, F.col("__p.id") == F.col("__id"), F.col("__p.tokens") == F.col("__tokens")], "left")
    more = (F.col("__r") < F.col("__b.end")) | ((F.col("__r") == F.col("__b.end")) & F.col("__tokens").isNotNull())
    taken = marked.withColumn("__c", F.when(F.col("__p.tokens") > 0, F.col("__b.whole") + more.cast("int"))).where("__c > 0")
    return taken.select(*[col(c) for c in named], leaf[0], F.col("__p.tokens").alias("n_tokens"), F.col("__c").alias("copies"))
