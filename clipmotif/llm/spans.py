"""Substring deduplication: runs of consecutive sentences that occur before are removed everywhere else."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmotif.llm.common import col, small_batches, texts_of

MIN_SENTENCES = 2
MIN_WORDS = 20
LONG_SENTENCE = 40  # words from which a sentence is a run by itself
END = re.compile(r"[.!?…。！？]+(?=\s)|\n|\Z")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text: they end after . ! ? … before white space, and at line ends."""
    out, at = [], 0
    for m in END.finditer(text):
        own = text[at : m.end()]
        bare = own.lstrip()
        if bare:
            a = at + len(own) - len(bare)
            out.append((a, a + len(bare.rstrip())))
        at = m.end()
    return out


def runs(text: str, spans: list[tuple[int, int]], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE) -> list[tuple[int, int, int]]:
    """Rows (hash, first sentence, last sentence): every shortest run from each sentence on, and up to each sentence,
    that has ``min_sentences`` sentences and ``min_words`` words, and each sentence of ``long_sentence`` words.

    Any longer repeated passage is covered by such runs, whichever sentence it begins and ends with.
    """
    words = [text[a:b].lower().split() for a, b in spans]
    n = [len(w) for w in words]
    upto = [0, *accumulate(n)]
    found = {(i, i) for i, k in enumerate(n) if k >= long_sentence}
    j = 0
    for i in range(len(n)):
        j = max(j, i + min_sentences - 1)
        while j < len(n) and upto[j + 1] - upto[i] < min_words:
            j += 1
        if j >= len(n):
            break
        found.add((i, j))
    i = len(n) - 1
    for j in range(len(n) - 1, -1, -1):
        i = min(i, j - min_sentences + 1)
        while i >= 0 and upto[j + 1] - upto[i] < min_words:
            i -= 1
        if i < 0:
            break
        found.add((i, j))
    said = [" ".join(w) for w in words]
    digest = xxhash.xxh64_intdigest
    return [(digest("\n".join(said[i : j + 1]).encode("utf-8", "surrogatepass")), i, j) for i, j in sorted(found)]


def remove(text: str, covered: list[tuple[int, int]]) -> str:
    """The text without the character spans given, each with the blanks before it, and without emptied lines."""
    out, at = [], 0
    for a, b in covered:
        out.append(text[at:a].rstrip(" \t"))
        at = b
    out.append(text[at:])
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n") if covered else text


def _marked(docs: DataFrame) -> DataFrame:
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumn("mark", F.xxhash64("text"))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (run, doc_id, mark, first, last, again) sorted by run and place those that are not at their run's first place."""
    run, head = None, None  # the last run that was seen, and its first place
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(0).to_numpy()
        doc = batch.column(1)
        place = np.stack([doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1)
        lead = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(len(own)), 0))
        least = place[lead]
        if own[0] == run:
            least[lead == 0] = head
        run, head = own[-1], least[-1]
        gone = (place != least).any(axis=1) | batch.column(5).to_numpy(zero_copy_only=False)
        if gone.any():
            kept = batch.filter(pa.array(gone))
            yield pa.RecordBatch.from_arrays(kept.columns[1:5], names=["doc_id", "mark", "first", "last"])


def repeated_runs(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE) -> DataFrame:
    """Rows (doc_id, mark, first, last): the runs of ``docs(doc_id, text)`` that an earlier run repeats.

    Earlier means a smaller doc_id, then a smaller mark (the text's hash), then an earlier sentence.  Runs are hashed
    and shuffled once.  Of the equal runs of one batch only the first is sent to meet those of other batches: the
    others are known to be repeated and are dealt out by their own place, so that a run which very many documents
    hold sends one row a batch to its task, which holds one row at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            docs_, marks, hashes, firsts, lasts = [], [], [], [], []
            for n, (text, mark) in enumerate(zip(texts_of(batch), batch.column(2).to_pylist(), strict=True)):
                own = runs(text, sentences(text), min_sentences, min_words, long_sentence)
                docs_ += [n] * len(own)
                marks += [mark] * len(own)
                hashes += [h for h, _, _ in own]
                firsts += [i for _, i, _ in own]
                lasts += [j for _, _, j in own]
            ids = batch.column(0).take(pa.array(docs_, pa.int64()))
            hashed, mark, first, last = np.array(hashes, np.uint64).view(np.int64), np.array(marks, np.int64), np.array(firsts, np.int32), np.array(lasts, np.int32)
            known, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((first, mark, number, known, hashed))
            place = np.stack([known, number, mark, first], 1)[order]
            same = np.r_[False, hashed[order][1:] == hashed[order][:-1]][: len(order)]
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            elsewhere = (place != place[lead]).any(axis=1)
            keep = ~same | elsewhere  # rows of the same place and run come from equal rows
            again = elsewhere[keep]
            rows = order[keep]
            key = hashed[rows]
            key[again] = np.cumsum(again)[again] * np.int64(0x9E3779B97F4A7C1) ^ mark[rows][again] ^ number[rows][again]
            arrays = [pa.array(key), ids.take(pa.array(rows)), pa.array(mark[rows]), pa.array(first[rows]), pa.array(last[rows]), pa.array(again)]
            yield pa.RecordBatch.from_arrays(arrays, names=["run", "doc_id", "mark", "first", "last", "again"])

    found = _marked(docs).mapInArrow(run, "run long, doc_id long, mark long, first int, last int, again boolean")
    found = found.repartition("run").sortWithinPartitions("run", "doc_id", "mark", "first")
    return found.mapInArrow(_later, "doc_id long, mark long, first int, last int")


def drop_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE) -> DataFrame:
    """Rows (doc_id, text, n_sentences, n_removed, removed), one per row of ``docs(doc_id, text)``.

    A sentence goes if a run that covers it occurs earlier in the corpus; ``removed`` has the character
    spans of the original text, neighbours joined, and ``text`` is what is left.  Words are compared in
    lower case and single spaces, sentence ends as they stand.

    A null text is empty and stays so; texts without a long enough run are unchanged; of equal rows (same
    doc_id and text) all are changed alike, as their runs are the first ones; a null doc_id counts as the
    smallest; other columns are not read; an empty table gives no row.
    """
    gone = repeated_runs(docs, min_sentences, min_words, long_sentence)
    gone = gone.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    joined = _marked(docs).join(gone, same, "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            rows = []
            for doc, text, gone in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                spans = sentences(text)
                out = sorted({k for g in gone or () for k in range(g["first"], g["last"] + 1)})
                removed: list[list[int]] = []
                for k in out:
                    if removed and k and removed[-1][1] == spans[k - 1][1]:
                        removed[-1][1] = spans[k][1]
                    else:
                        removed.append(list(spans[k]))
                rows.append((doc, remove(text, [(a, b) for a, b in removed]), len(spans), len(out), removed))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "text", "n_sentences", "n_removed", "removed"])

    return joined.mapInArrow(run, "doc_id long, text string, n_sentences long, n_removed long, removed array<array<long>>")
