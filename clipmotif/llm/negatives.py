"""Hard negatives: exact inner-product search over candidates sorted by norm, bucket by bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmotif.llm.common import col, cut

SCALE = 256  # a component x counts as floor(SCALE x)
BUCKET = 1024  # candidates that share one bound
CHUNK = 512  # anchors that are compared with a bucket at once
ANCHORS = 16_384  # anchors that one pass over the candidates takes
EXACT = 2.0**53  # whole numbers below this are exact as doubles
INSIDE = 1 + 1e-9  # bounds are widened by this, so that rounding never prunes


def matrix(vectors: pa.ListArray, scale: int = SCALE) -> np.ndarray:
    """The whole-number components of a batch's vectors, a row each; shorter ones are filled with zeros."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    sizes = np.diff(vectors.offsets.to_numpy())
    if not len(sizes) or (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1) if len(sizes) else np.empty((0, 0))
    out = np.zeros((len(sizes), sizes.max()))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of both, as longs."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if norms(a).max() * norms(b).max() * INSIDE < EXACT:  # partial sums are no greater than that
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object)
    return whole(a).dot(whole(b).T).astype(np.int64)  # raises beyond a long


class Best:
    """The best ``k`` different (score, id) of every slot: the greatest scores, of equal ones the smallest ids."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.full = np.zeros(slots, bool)
        self.last = np.zeros(slots, np.int64)  # the k-th score of a full slot

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.isin(self.slot, slot)
        all_ = [np.concatenate([x[touched], y]) for x, y in zip((self.slot, self.score, self.id), (slot, score, ids), strict=True)]
        order = np.lexsort((all_[2], -all_[1], all_[0]))
        again = np.r_[False, np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in all_])]
        order = order[~again]
        own = all_[0][order]
        head = np.r_[True, own[1:] != own[:-1]]
        rank = np.arange(len(own)) - np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))
        end = order[rank == self.k - 1]
        self.full[all_[0][end]] = True
        self.last[all_[0][end]] = all_[1][end]
        kept = order[rank < self.k]
        self.slot, self.score, self.id = (np.concatenate([x[~touched], y[kept]]) for x, y in zip((self.slot, self.score, self.id), all_, strict=True))


def greatest(own: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """``mask`` without what is below the k-th greatest masked score of its row; ties with that stay."""
    if np.count_nonzero(mask, axis=1).max(initial=0) <= k:
        return mask
    low = np.iinfo(np.int64).min
    held = np.where(mask, own, low)
    return mask & (own >= np.partition(held, -k, axis=1)[:, -k, None])


class Search:
    """One task's search: buckets of candidates come in order of falling norm, and meet all anchors of a block.

    A slot is an anchor, or one of its windows.  ``low`` and ``high`` bound a slot's scores.  By Cauchy-Schwarz no score is
    above the anchor's norm times the bucket's greatest norm, so an anchor passes over a bucket, and over all later ones,
    when that is below the low end of each of its windows, or below the running k-th score of those that are full.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.vectors, self.ids, self.labels, self.k, self.same = vectors, ids, labels, k, same
        self.norms, (self.n, self.width) = norms(vectors), low.shape
        self.low, self.high = low, high
        self.best = Best(self.n * self.width, k)
        self.compared = 0

    def least(self) -> np.ndarray:
        """Of every slot the score that a new candidate needs."""
        return np.where(self.best.full.reshape(self.low.shape), np.maximum(self.best.last.reshape(self.low.shape), self.low), self.low)

    def bucket(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        bound = self.norms * norms(vectors).max() * INSIDE
        going = np.flatnonzero(((self.least() <= bound[:, None]) & (self.low <= self.high)).any(axis=1))
        for at in range(0, len(going), CHUNK):
            rows = going[at : at + CHUNK]
            own = scores(self.vectors[rows], vectors)
            self.compared += own.size
            fits = (self.labels[rows, None] == labels) == self.same
            fits &= self.ids[rows, None] != ids
            least = self.least()[rows]
            for w in range(self.width):
                mask = fits & (own >= least[:, w, None]) & (own <= self.high[rows, w, None])
                a, b = np.nonzero(greatest(own, mask, self.k))
                self.best.add(rows[a] * self.width + w, own[a, b], ids[b])


def _search(candidates: DataFrame, block: tuple[np.ndarray, ...], k: int, same: bool, scale: int, bucket: int) -> DataFrame:
    """Rows (anchor, id, score), each once: of every task the best k of each slot of a block of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*block, k, same)
        for batch in batches:
            for at in range(0, batch.num_rows, bucket):
                part = batch.slice(at, bucket)
                search.bucket(matrix(part.column(2), scale), part.column(0).to_numpy(), part.column(1).to_numpy())
        best = search.best
        rows = np.unique(np.stack([best.slot // search.width, best.id, best.score], 1), axis=0) if len(best.slot) else np.empty((0, 3), np.int64)
        for at in range(0, len(rows), 10_000):
            own = rows[at : at + 10_000].T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], names=["anchor", "id", "score"])

    return candidates.mapInArrow(run, "anchor long, id long, score long")


def candidates(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, label, embedding) that take part, dealt out by vec_id and in each task in order of falling norm.

    Every task gets candidates of all norms, so work stays even where a third of all vectors are the same.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.floor(x.cast("double") * scale).cast("double")
    own = vectors.select(col("vec_id").cast("long").alias("vec_id"), col("label").cast("long").alias("label"), col("embedding").alias("embedding"))
    own = own.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.forall("embedding", fine))
    own = own.withColumn("norm", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + whole(x) * whole(x)))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(tasks, "vec_id").sortWithinPartitions(F.desc("norm")).select("vec_id", "label", "embedding")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k rows of every key with the greatest score, then the smallest id, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mine_block(known: DataFrame, asked: DataFrame, positives: int, negatives: int, low: int, high: int, scale: int, bucket: int) -> DataFrame | None:
    """``mine`` for one block of anchors."""
    spark = known.sparkSession
    table = asked.dropDuplicates().orderBy("vec_id", "label", "embedding").toArrow().combine_chunks()
    if not table.num_rows:
        return None
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    once = np.r_[True, ids[1:] != ids[:-1]]
    vecs = matrix(table.column("embedding").combine_chunks(), scale)[once]
    ids, labels = ids[once], labels[once]
    open_ = np.full((len(ids), 1), np.iinfo(np.int64).max)
    found = _first(_search(known, (vecs, ids, labels, -open_, open_), positives, True, scale, bucket), ["anchor"], positives)
    got = found.select("anchor", "rank", "id", "score").toArrow()
    at, rank, positive, score = (got.column(c).to_numpy() for c in got.column_names)
    least, upto = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)  # empty windows
    least[at, rank - 1] = [-(-low * int(s) // 100) for s in score]
    upto[at, rank - 1] = [high * int(s) // 100 for s in score]
    columns = {"anchor": at, "place": rank, "anchor_id": ids[at], "positive_id": positive, "positive_score": score, "least": least[at, rank - 1], "upto": upto[at, rank - 1]}
    windows = spark.createDataFrame(pa.table(columns))
    near = _search(known, (vecs, ids, labels, least, upto), negatives, False, scale, bucket)
    own = near.join(windows, "anchor").where("score BETWEEN least AND upto")
    own = _first(own, ["anchor", "place"], negatives)
    return own.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = SCALE, bucket: int = BUCKET, block_anchors: int = ANCHORS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors(vec_id, embedding, label)``.

    A score is the inner product of the vectors floor(scale x); greater ones come first, ties by smaller vec_id.  The
    rows where ``anchors`` is true are the query set, searched in blocks of ``block_anchors`` against all rows: their
    ``positives`` best rows of the same label, and for each of these the best ``negatives`` rows of other labels whose
    score is from ``low`` to ``high`` per cent of the positive's (none if that is negative).  Of each block one pass over
    the candidates finds positives and one negatives; tasks send their own best, which are compared by anchor.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part.  Rows of one vec_id
    that score alike count once; a row with the anchor's vec_id is never its positive or negative, and of rows that share
    an anchor's vec_id the first in order of label and vector is the anchor.  A shorter vector is filled with zeros; an empty one scores 0.
    Scores have to fit a long.  Other columns are not read; an empty table gives no row.
    """
    known = cut(candidates(vectors, scale))
    asked = known.where(anchors)
    n = max(1, -(-asked.count() // block_anchors))
    out = None
    for k in range(n):
        part = _mine_block(known, asked if n == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == k), positives, negatives, low, high, scale, bucket)
        if part is not None:
            part = part if n == 1 else cut(part)
            out = part if out is None else out.unionByName(part)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out
