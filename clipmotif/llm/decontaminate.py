"""Benchmark decontamination: q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmotif.llm.common import col, cut, keep_rows, small_batches

Q = 12
ERROR_RATE = 0.06  # edits allowed, as a share of an item's characters
BLOCK_CHARS = 4_000_000  # benchmark characters that one pass over the documents takes
CHUNK_CHARS = 150_000  # document characters hashed at a time
BASE = np.uint64(0x9E3779B97F4A7C15)
BITS = 22
PAIRS = 2_000_000  # pairs of equal grams that are held at a time
RUN_DIAGONALS = 1 << 16  # that one alignment takes


def _table() -> np.ndarray:
    """For every code of the basic plane what it becomes: a lower-case letter or digit, or a space."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in map(chr, range(0x10000))]
    return np.array([ord(c) if c.isalnum() else 32 for c in low], np.uint32)


TABLE = _table()


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def normal_codes(texts: list[str]) -> np.ndarray:
    """The normalised texts as codes, each followed by a zero."""
    raw = _raw("\0".join([*texts, ""]))
    codes = TABLE[np.minimum(raw, 0xFFFF)]
    high = raw > 0xFFFF
    if high.any():
        codes[high] = raw[high]
    codes[np.cumsum([len(t) + 1 for t in texts]) - 1] = 0
    gap = codes <= 32
    before, after = np.concatenate([[True], gap[:-1]]), np.concatenate([codes[1:] == 0, [True]])
    return codes[~((codes == 32) & (before | after))]


def normalise(text: str) -> str:
    """Lower-case letters and digits, everything between them one space."""
    codes = normal_codes([text])[:-1]
    # a run of gaps at the end leaves one space before the zero
    return _text(codes).strip(" ")


def _codes(text: str) -> np.ndarray:
    return _raw(text).astype(np.uint64) + np.uint64(1)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every run of q codes, built by doubling."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, width, at, out, done = BASE, 1, codes, None, 0
    rest = q
    while True:
        if rest & 1:
            out = at[:n].copy() if out is None else out * power + at[done : done + n]
            done += width
        rest >>= 1
        if not rest:
            return out * BASE
        at = at[:-width] * power + at[width:]
        power, width = np.uint64(int(power) ** 2 % 2**64), 2 * width


def budget(length: int, rate: float = ERROR_RATE, q: int = Q) -> int:
    """Edits allowed to an item: its share, or less where the lemma would ask for no common gram."""
    return max(0, min(int(rate * length), (length - q) // q))


def banded(item: str, text: str, low: int, high: int, most: int) -> tuple[int, int] | None:
    """The least edits, up to ``most``, of the item against a part of the text whose path stays on the diagonals
    low..high, and where that part ends; None if there is no such part."""
    if not item or high < low:
        return None
    d = np.arange(low, high + 1)
    t = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = most + 1
    inside = lambda i: (d + i >= 0) & (d + i <= len(t))
    row = np.where(inside(0), 0, far)  # the part may begin on any diagonal
    steps = np.arange(len(d))
    for i, c in enumerate(item):
        at = d + i  # text position before the step along each diagonal
        ok = (at >= 0) & (at < len(t))
        same = np.zeros(len(d), bool)
        same[ok] = t[at[ok]] == ord(c)
        new = row + ~same
        new[~ok] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the item missing in the text
        new = np.where(inside(i + 1), np.minimum(new, far), far)
        new = np.minimum.accumulate(new - steps) + steps  # characters more in the text
        row = np.where(inside(i + 1), np.minimum(new, far), far)
        if row.min() > most:
            return None
    k = int(np.argmin(row))
    return (int(row[k]), int(d[k]) + len(item)) if row[k] <= most else None


def _summed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of some (key, count) rows, and the sums of their counts."""
    rows = np.concatenate(parts)
    key, which = np.unique(rows[:, 0], return_inverse=True)
    return key, np.bincount(which, rows[:, 1], len(key)).astype(np.int64)


class Index:
    """Grams of a block of benchmark items: a bitmap to pass over most text, and the postings behind it."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, q: int = Q) -> None:
        self.items, self.q = [(i, normalise(t)) for i, t in items], q
        self.items = [(i, t) for i, t in self.items if t]
        self.short = [(i, t) for i, t in self.items if len(t) < q]
        self.items = [(i, t) for i, t in self.items if len(t) >= q]
        self.edits = np.array([budget(len(t), rate, q) for _, t in self.items], np.int64)
        self.need = np.array([len(t) + 1 - q * (e + 1) for (_, t), e in zip(self.items, self.edits, strict=True)], np.int64)
        hashes = [gram_hashes(_codes(t), q) for _, t in self.items]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, first, counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.counts = first, counts
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.place = (np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64))[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(flat >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Rows (item, low diagonal, high diagonal) of runs of neighbouring bands with enough common grams.

        A text is counted in windows that overlap by what a region of the longest item can take, so that what is held at a
        time follows from the window and the items, not from the text.
        """
        reach = max((len(t) + int(e) for (_, t), e in zip(self.items, self.edits, strict=True)), default=0)
        found = []
        for at in range(0, max(1, len(codes)), CHUNK_CHARS):
            bands = self._bands(codes[at : at + CHUNK_CHARS + reach])
            bands[:, 1:] += at
            found.append(bands)
            if at + CHUNK_CHARS + reach >= len(codes):
                break
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        if not len(rows):
            return rows
        high = np.maximum.accumulate(rows[:, 2] + rows[:, 0] * (4 * len(codes) + 4 * reach + 4)) - rows[:, 0] * (4 * len(codes) + 4 * reach + 4)
        width = rows[:, 1] - np.r_[0, rows[:-1, 1]]
        new = np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] > high[:-1] + 1)]
        # very long runs are cut; the aligned diagonals overlap by the edits on both sides
        run = np.cumsum(new)
        along = np.cumsum(np.where(new, 0, width))
        along = (along - np.maximum.accumulate(np.where(new, along, 0))) // RUN_DIAGONALS
        head = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (along[1:] != along[:-1])])
        return np.stack([rows[head, 0], rows[head, 1], np.maximum.reduceat(rows[:, 2], head)], 1)

    def _bands(self, codes: np.ndarray) -> np.ndarray:
        """Rows (item, low diagonal, high diagonal) of the bands of one window that reach their item's bound."""
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        k = np.searchsorted(self.grams, h[at])
        k[k == len(self.grams)] = 0
        hit = self.grams[k] == h[at] if len(self.grams) else np.zeros(len(at), bool)
        at, k = at[hit], k[hit]
        if not len(k):
            return np.empty((0, 3), np.int64)
        n = self.counts[k]
        if int(n.sum()) <= PAIRS:
            return self._counted(at, k, n)
        # pairs of equal grams by item; an item with many for the window's length is counted along all diagonals at once
        times = np.bincount(k, minlength=len(self.grams))
        gram = np.repeat(np.arange(len(self.grams)), self.counts)
        pairs = np.bincount(self.item, times[gram], len(self.items))
        heavy = np.flatnonzero(pairs > 4 * len(codes))
        found = []
        order = np.argsort(k, kind="stable")
        begin = np.searchsorted(k[order], np.arange(len(self.grams) + 1))
        for item in heavy.tolist():
            mine = np.flatnonzero(self.item == item)
            size = len(self.items[item][1])
            along = np.zeros(len(codes) + size + 1, np.int32)  # by diagonal, moved by the item's length
            for g in np.unique(gram[mine]).tolist():
                if times[g]:
                    there = np.zeros(len(codes), np.int32)
                    there[at[order[begin[g] : begin[g + 1]]]] = 1
                    for place in self.place[mine[gram[mine] == g]].tolist():
                        along[size - place : size - place + len(codes)] += there
            found.append(self._enough(item, np.arange(-size, len(codes) + 1), along))
        light = np.ones(len(self.items), bool)
        light[heavy] = False
        # the others have few pairs each; as many go at a time as PAIRS allows
        for a, b in zip(*self._pieces(n), strict=True):
            found.append(self._pairs(at[a:b], k[a:b], n[a:b], light))
        keys = [x for x in found if x.shape[1] == 2]
        bands = [x for x in found if x.shape[1] == 3]
        if keys:
            bands.append(self._reached(*_summed(keys)))
        return np.concatenate(bands)

    @staticmethod
    def _pieces(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group = np.cumsum(n) // PAIRS
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        return starts, np.r_[starts[1:], len(n)]

    def _pairs(self, at: np.ndarray, k: np.ndarray, n: np.ndarray, light: np.ndarray | None = None) -> np.ndarray:
        """Rows (key, number of pairs) of the bands of postings that meet; a key holds item and band."""
        posting = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        item, diagonal = self.item[posting], np.repeat(at, n) - self.place[posting]
        if light is not None:
            item, diagonal = item[light[item]], diagonal[light[item]]
        key = (item << np.int64(36)) + diagonal // (self.edits[item] + 1) + (1 << 35)
        return np.stack(np.unique(key, return_counts=True), 1)

    def _reached(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Bands of two neighbouring steps whose pairs reach the bound of their item."""
        both, which = np.unique(np.concatenate([key, key - 1]), return_inverse=True)  # each band spans two steps
        total = np.bincount(which, np.concatenate([count, count]), len(both))
        item, band = both >> np.int64(36), (both & ((1 << 36) - 1)) - (1 << 35)
        fits = total >= self.need[item]
        item, band, step = item[fits], band[fits], self.edits[item[fits]] + 1
        return np.stack([item, band * step, (band + 2) * step - 1], 1)

    def _counted(self, at: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self._reached(*self._pairs(at, k, n).T)

    def _enough(self, item: int, diagonals: np.ndarray, along: np.ndarray) -> np.ndarray:
        """The same for the counts of one item along all diagonals."""
        step = int(self.edits[item]) + 1
        band = diagonals // step
        count = np.bincount(band - band[0], along)
        two = count + np.r_[count[1:], 0]
        first = np.flatnonzero(np.r_[count[0], two] >= self.need[item]) - 1 + band[0]  # the first one spans nothing and a step
        return np.stack([np.full(len(first), item), first * step, (first + 2) * step - 1], 1)

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Of each text the (item id, end, edits, item length) of its best region for every item it holds."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        k = 0
        while k < len(texts):
            n, size = 0, 0
            while k + n < len(texts) and (not n or size + len(texts[k + n]) < CHUNK_CHARS):
                size += len(texts[k + n])
                n += 1
            codes = normal_codes(texts[k : k + n])
            ends = np.flatnonzero(codes == 0)
            starts = np.concatenate([[0], ends + 1])
            plain: dict[int, str] = {}
            for item, low, high in self.candidates(codes.astype(np.uint64) + np.uint64(1)).tolist() if self.items else ():
                name, t = self.items[item]
                # a band may cross from one document into the next; every document that it meets is tried
                a, b = np.searchsorted(starts, [max(low, 0), max(high, 0)], side="right") - 1
                for doc in range(a, min(b, n - 1) + 1):
                    begin, end = int(starts[doc]), int(ends[doc])
                    old = out[k + doc].get(name)
                    if old and not old[1] and low - begin + len(t) >= old[0]:
                        continue  # nothing is better than no edit, further to the left
                    if doc not in plain:
                        plain[doc] = _text(codes[begin:end])
                    # beyond the document's own diagonals there is nothing
                    got = self.best(t, plain[doc], max(low, begin - len(t)) - begin, min(high, end) - begin, int(self.edits[item]))
                    if got and (old is None or (got[0], got[1]) < (old[1], old[0])):
                        out[k + doc][name] = (got[1], got[0], len(t))
            k += n
        for own, text in zip(out, map(normalise, texts if self.short else ()), strict=False):
            for name, t in self.short:
                at = f" {text} ".find(f" {t} ")
                if at >= 0 and name not in own:
                    own[name] = (at + len(t), 0, len(t))
        return [[(name, *v) for name, v in sorted(own.items(), key=lambda x: x[0])] for own in out]

    @staticmethod
    def best(item: str, text: str, low: int, high: int, edits: int) -> tuple[int, int] | None:
        at = text.find(item, max(low, 0), max(high + len(item), 0))
        if at >= 0:
            return 0, at + len(item)
        # edits shift the path by their number at most, to either side
        a = max(0, low - edits)
        b = min(len(text), high + len(item) + 2 * edits)
        return (lambda x: x and (x[0], x[1] + a))(banded(item, text[a:b], low - edits - a, high + edits - a, edits)) if b > a else None


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks of about ``block_chars`` characters of the benchmark, and the blocks; one at a time comes to the driver."""
    own = benchmark.select(col("item_id").cast("long").alias("item_id"), col("text").cast("string").alias("text")).dropna().distinct()
    chars = own.agg(F.sum(F.length("text") + 50)).first()[0] or 0
    n = int(chars // block_chars) + 1

    def each() -> Iterator[list[tuple[int, str]]]:
        for k in range(n):
            rows = own if n == 1 else own.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
            block = sorted((r.item_id, r.text) for r in rows.collect())
            if block:
                yield block

    return n, each()


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, edits, region_end, item_chars): the benchmark items that each document holds.

    Both sides are compared as ``normalise`` leaves them.  An item of m characters is held if some part of
    the text is within e = ``budget`` edits of it.  Such a part shares at least m + 1 - q (e + 1) q-grams with
    it on neighbouring diagonals; bands of 2 (e + 1) diagonals, each overlapping half of the next, are
    counted, and those that reach the bound are aligned.  An item of fewer than q characters counts where
    its words stand unchanged.  region_end is the end, in the normalised text, of the best part: of the
    fewest edits, then the first.

    The benchmark is the query set: it is gone through in blocks of bounded size, each a narrow pass over
    all documents.  If there are several, what a block finds is written before the next one comes to the
    driver.  A long or repetitive text is counted in windows, so memory follows from the window and the items.  A null or empty text holds nothing; null or blank items are left out; of equal
    item_ids the better match counts; repeated documents are reported each; other columns are not read;
    empty tables give no row.
    """
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits long, region_end long, item_chars long"
    found = None
    n, blocks = blocks_of(benchmark, block_chars)
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            index = Index(block, rate, q)
            for batch in small_batches(batches, 500):
                hits = index.search([t or "" for t in batch.column(1).to_pylist()])
                rows = [(d, i, e, end, m) for d, own in zip(batch.column(0).to_pylist(), hits, strict=True) for i, end, e, m in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "edits", "region_end", "item_chars"])

        part = own.mapInArrow(run, schema)
        part = part if n == 1 else cut(part)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns as they were.

    For a benchmark of one block rows are filtered where they are read.  For several, what each block finds is written by
    the hash of the text, and documents are joined to that.  Rows that ``find_leaks`` reports go, nulls stay.
    """
    n, blocks = blocks_of(benchmark, block_chars)
    if n > 1:
        mark = F.xxhash64(F.coalesce(col("text").cast("string"), F.lit("")))
        gone = find_leaks(docs.select(mark.alias("doc_id"), col("text").alias("text")), benchmark, rate, q, block_chars).select(F.col("doc_id").alias("__gone")).distinct()
        return docs.join(gone, mark == F.col("__gone"), "left_anti")
    at = docs.columns.index("text")
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block, rate, q)
            for batch in small_batches(batches, 500):
                hits = index.search([t or "" for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        return keep_rows(docs, run)
    return docs
