"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmotif.llm.common import col, keep_rows, small_batches, texts_of

FEATURES = (
    "log_words", "word_length", "symbols", "upper_words", "exclamations", "pipes", "repeats_next", "distinct", "digits",
    "log_line_words", "dup_lines", "short_words", "stops", "commas", "non_ascii", "top_word", "title_words",
)
MAX_TRAIN = 20_000  # labelled rows that a fit may take; it takes those whose ids hash lowest
THRESHOLD = 0.3


def features(text: str) -> tuple[float, ...]:
    """FEATURES of one text; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    counts = Counter(words)
    count = text.count
    letters = len(text) - count(" ") - count("\n")
    return (
        float(np.log1p(n)),
        letters / n,
        sum(map(count, "#*$%&<>")) / n,
        sum(map(str.isupper, words)) / n,
        count("!") / n,
        count("|") / n,
        sum(map(eq, words, words[1:])) / n,
        len(counts) / n,
        sum(map(count, "0123456789")) / letters,
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        (count(".") + count("?")) / n,
        count(",") / n,
        1 - len(text.encode("ascii", "ignore")) / len(text),
        max(counts.values()) / n,
        sum(map(str.istitle, words)) / n,
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _splits(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Newton steps of a tree of the given depth over ordered bins with gradients g and curvatures h."""
    step = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return step
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
    k = int(np.argmax(gain))
    if gain[k] <= g.sum() ** 2 / (h.sum() + 1) + 1e-12:
        return step
    return np.concatenate([_splits(g[: k + 1], h[: k + 1], depth - 1, least), _splits(g[k + 1 :], h[k + 1 :], depth - 1, least)])


def _quadrants(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four quadrants: its gain, and the Newton step of every cell."""
    best, step = -1.0, np.zeros_like(g)
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            gq = np.array([gc[a, b], gc[a, -1] - gc[a, b], gc[-1, b] - gc[a, b], gc[-1, -1] - gc[a, -1] - gc[-1, b] + gc[a, b]])
            hq = np.array([hc[a, b], hc[a, -1] - hc[a, b], hc[-1, b] - hc[a, b], hc[-1, -1] - hc[a, -1] - hc[-1, b] + hc[a, b]])
            gain = float((gq**2 / (hq + 1)).sum())
            if hq.min() >= min(least, 1.0) and gain > best:
                v = gq / (hq + 1)
                best, step = gain, np.zeros_like(g)
                step[: a + 1, : b + 1], step[: a + 1, b + 1 :], step[a + 1 :, : b + 1], step[a + 1 :, b + 1 :] = v
    return best, step


@dataclass
class AdditiveModel:
    """Score = sigmoid(intercept + a table entry for each feature + a grid entry for each chosen pair)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bins: int = 48, cells: int = 8, rounds: int = 120, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 30) -> AdditiveModel:
        """Boost every feature in turn, round after round; then the pairs that explain most of the rest.

        With no rows the score is 1/2 everywhere; with one class it is that class's smoothed share.
        """
        self, n = cls(), len(y)
        share = (y.sum() + 0.5) / (n + 1)
        self.intercept = float(np.log(share / (1 - share)))
        if n == 0:
            return self
        least = max(1e-3, 0.002 * n * share * (1 - share))
        cuts = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
        self.edges = [cuts(v, bins) for v in x.T]
        at = [np.searchsorted(e, v, side="left") for e, v in zip(self.edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(n, self.intercept)
        for _ in range(rounds):
            for k, own in enumerate(at):
                p = _sigmoid(f)
                size = len(self.tables[k])
                g, h = np.bincount(own, y - p, size), np.bincount(own, p * (1 - p), size)
                step = rate * _splits(g, h, 2, least)
                self.tables[k] += step
                f += step[own]
        self.coarse = [cuts(v, cells) for v in x.T]
        near = [np.searchsorted(e, v, side="left") for e, v in zip(self.coarse, x.T, strict=True)]
        sides = [len(e) + 1 for e in self.coarse]

        def grid(i: int, j: int) -> tuple[float, np.ndarray]:
            p, cell, shape = _sigmoid(f), near[i] * sides[j] + near[j], (sides[i], sides[j])
            g, h = np.bincount(cell, y - p, sides[i] * sides[j]), np.bincount(cell, p * (1 - p), sides[i] * sides[j])
            return _quadrants(g.reshape(shape), h.reshape(shape), least)

        gains = sorted(((-grid(i, j)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))
        self.pairs = [(i, j) for gain, i, j in gains[:pairs] if gain < 0]
        self.grids = [np.zeros((sides[i], sides[j])) for i, j in self.pairs]
        for _ in range(pair_rounds):
            for table, (i, j) in zip(self.grids, self.pairs, strict=True):
                step = rate * grid(i, j)[1]
                table += step
                f += step[near[i], near[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from bin numbers and table additions alone."""
        f = np.full(len(x), self.intercept)
        for e, table, v in zip(self.edges, self.tables, x.T, strict=False):
            f += table[np.searchsorted(e, v, side="left")]
        for table, (i, j) in zip(self.grids, self.pairs, strict=True):
            f += table[np.searchsorted(self.coarse[i], x[:, i], side="left"), np.searchsorted(self.coarse[j], x[:, j], side="left")]
        return _sigmoid(f)


def _features_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = [list(features(t)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(x, pa.list_(pa.float64()))], names=[*keys, "x"])

    return docs.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, train_on: str | None = None, max_train: int = MAX_TRAIN) -> AdditiveModel:
    """Fit on at most ``max_train`` labelled documents: those whose doc_id hashes lowest.

    ``train_on`` is a condition on doc_id that labels must meet.  A document with several labels has
    their mean, rounded up; null labels and ids and labels without a document are left out.  The sample is bounded,
    so it is sent to the driver, where the model is fitted.
    """
    chosen = labels.select(col("doc_id").cast("long").alias("doc_id"), col("quality").alias("quality")).dropna()
    chosen = chosen.where(train_on or "true").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    rows = _features_of(own.join(F.broadcast(chosen), "doc_id"), ["doc_id", "y"])
    # repeated documents must not let the sample outgrow its bound
    rows = rows.groupBy("doc_id").agg(F.min_by("x", F.xxhash64("x")).alias("x"), F.min("y").alias("y")).orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return AdditiveModel.fit(x, rows["y"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """Rows (doc_id, score), one per row of ``docs``: a score in [0, 1], higher for likelier good quality.

    Only the text is scored; a null text is empty and has the score of empty texts; repeated rows score
    alike; other columns are not read; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = np.array([features(t) for t in texts_of(batch)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    own = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``; columns as they were, of any names, no shuffle.

    A null text scores as the empty one, and rows of equal texts stay or go together; a score equal to the
    threshold stays; an empty table gives no row.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return keep_rows(docs, run)


def held_out(doc_id: str = "doc_id") -> str:
    """SQL condition for the fifth of the documents whose labels no fit sees; a null id is never held out."""
    return f"coalesce(crc32(cast(cast({doc_id} AS string) AS binary)) % 5 = 0, false)"
