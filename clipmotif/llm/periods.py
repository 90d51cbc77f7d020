"""Periodic runs: stretches of words that repeat a short sequence, found by matching blocks of power-of-two lengths."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmotif.llm.common import col, small_batches

REPEATS = 4  # a run holds its period so often, at least
LEAST_WORDS = 6
GRAM = 4  # words whose recurrence tells where runs can be
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for every word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def nearest(ids: np.ndarray) -> np.ndarray:
    """Of every GRAM-word stretch how far away the nearest equal one is, by hash; those that do not recur are beyond the end.

    Equal hashes of different stretches make some of them look closer, never farther.
    """
    n = len(ids) - GRAM + 1
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams = grams * MIX + ids[k : k + n].astype(np.uint64)
    order = np.argsort(grams, kind="stable")
    apart = np.where(grams[order][1:] == grams[order][:-1], np.diff(order), len(ids))
    near = np.full(n, len(ids))
    near[order[1:]] = apart
    near[order[:-1]] = np.minimum(near[order[:-1]], apart)
    return near


def stretches(mask: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """The maximal stretches of true values of ``least`` or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= least:
            yield int(a), int(b)


def seeds(ids: np.ndarray, where: list[tuple[int, int]], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of aligned blocks that stand again at a distance of ``block`` up to twice that, and those distances.

    The blocks of ``block`` words at multiples of ``block`` are the keys of an automaton that reads the stretches
    ``where``.  An occurrence has just one aligned block at such a distance before it, so there are no more seeds than
    words.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    names = np.full(len(ids) // block + 1, -1, np.int64)
    read = []
    for a, b in where:
        own = tuple(ids[a:b].tolist())
        for start in range(-(-a // block) * block, b - block + 1, block):
            key = own[start - a : start - a + block]
            names[start // block] = automaton.get(key, -1)
            if names[start // block] < 0:
                names[start // block] = start // block
                automaton.add_word(key, start // block)
        read.append((a, own))
    if not len(automaton):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    automaton.make_automaton()
    found = [np.array([(a + end - block + 1, name) for end, name in automaton.iter(own)], np.int64).reshape(-1, 2) for a, own in read]
    at, name = np.concatenate(found).T
    before = at // block - 1
    fits = (before >= 0) & (names[before] == name)
    return before[fits] * block, at[fits] - before[fits] * block


def extend(ids: np.ndarray, start: int, distance: int) -> tuple[int, int]:
    """The stretch around ``start`` in which words ``distance`` apart are equal: its first word, and the one after its last."""
    n, step = len(ids) - distance, 64
    right = start
    while right < n:
        same = ids[right : min(right + step, n)] == ids[right + distance : min(right + step, n) + distance]
        k = int(np.argmin(same))
        if not same[k]:
            right += k
            break
        right += len(same)
        step *= 2
    left, step = start, 64
    while left:
        low = max(0, left - step)
        same = (ids[low:left] == ids[low + distance : left + distance])[::-1]
        k = int(np.argmin(same))
        if not same[k]:
            left -= k
            break
        left, step = low, 2 * step
    return left, right + distance


def runs(ids: np.ndarray, repeats: int = REPEATS, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """Rows (start, length, period), by start, then period: the maximal stretches with smallest period q that have ``repeats`` q words and ``least`` words or more.

    A run with a period of block up to twice that many words holds an aligned block that stands again one period later,
    so every scale of periods has its seeds, and each seed is extended to both sides word by word.  Scales read only the
    stretches whose GRAM-word parts all recur within two blocks, as those of such a run do.
    """
    if repeats < 4 or least < 6:
        raise ValueError("runs of fewer than 4 periods or 6 words may have no seed")
    n = len(ids)
    if n < least:
        return []
    near = nearest(ids)
    if near.min() >= n:
        return []
    found: dict[tuple[int, int], int] = {}
    end_of, period_of = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the run that reaches farthest, by word
    block = 1
    while repeats * block <= n:
        where = [(a, b + GRAM - 1) for a, b in stretches(near < 2 * block, max(least, repeats * block) - GRAM + 1)]
        if where:
            starts, distances = seeds(ids, where, block)
            # within a run of a shorter period that divides the distance there is nothing new
            new = (end_of[starts] < starts + distances + block) | (distances % period_of[starts] != 0)
            starts, distances = starts[new], distances[new]
            order = np.lexsort((starts, distances))
            starts, distances = starts[order], distances[order]
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(distances)) + 1, [len(distances)]])
            for i, j in pairwise(bounds.tolist()):
                at = i
                while at < j:
                    q = int(distances[at])
                    a, b = extend(ids, int(starts[at]), q)
                    if b - a >= max(least, repeats * q) and (a, b) not in found:
                        found[a, b] = q
                        farther = end_of[a:b] < b
                        period_of[a:b][farther] = q
                        end_of[a:b][farther] = b
                    at = i + int(np.searchsorted(starts[i:j], b - q))
        block *= 2
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, repeats: int = REPEATS, least: int = LEAST_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, runs, text), one per row of ``docs(doc_id, text)``.

    Words stand between ASCII blanks and are numbered from 0.  ``runs`` lists (start, length, period) of every ``runs``,
    by start, then period; ``text`` is what stays when each run is cut down to its first period, words joined by one
    space.  A text takes memory in proportion to its words, and no row needs another one.

    A null or empty text has no words, no runs and the empty text; a null doc_id stays null; repeated rows are treated
    each; a long text is read whole; other columns are not read; an empty table gives no row.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            counts, each, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()
                found = runs(word_ids(words), repeats, least)
                counts.append(len(words))
                each.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapse(words, found)))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(each, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "text"])

    own = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
