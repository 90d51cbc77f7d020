"""Line deduplication by a segment-partition edit join: lines within a few edits of an earlier line go."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmotif.llm.common import col, cut, small_batches

TAU = 2  # edits
MIN_CHARS = 1  # shorter lines are never removed
JOIN_CHARS = 3  # characters a segment: lines with fewer for each of their tau + 1 segments are compared whole only
BLOCK = 256  # index lines that meet the probes of their key in one group; a key with more is refined, then split


def segments(length: int, tau: int = TAU) -> list[tuple[int, int]]:
    """Start and length of the tau + 1 segments of a line, the longer ones last."""
    n, longer = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        size = n + (i >= tau + 1 - longer)
        out.append((at, size))
        at += size
    return out


def window(start: int, size: int, i: int, length: int, other: int, tau: int = TAU) -> tuple[int, int]:
    """First and last start, in a line of ``other`` >= ``length`` characters, at which segment i (from 0) of the
    shorter line can stand if it is the first segment left whole: shifts that the edits on both sides allow."""
    delta = other - length
    low = max(0, start - i, start + delta - (tau - i))
    high = min(other - size, start + i, start + delta + (tau - i))
    return low, high


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def near(a: str, b: str, tau: int = TAU) -> bool:
    """Whether the edit distance of a and b is at most ``tau``.

    What both share at the start and the end is cut off.  The rest is compared by bit vectors that hold the
    vertical steps of one column of the dynamic programme within a band of 2 tau + 1 diagonals; the band moves
    down one row with every character of the longer line.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > tau:
        return False
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a:
        return len(b) <= tau
    width = 2 * tau + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + tau)
    up, down, score = mask & ~((1 << tau) - 1), 0, min(tau, len(a))
    limit = 2 * tau + len(b) - len(a)
    for i, c in enumerate(b):
        equal = places.get(c, 0) >> i & mask
        zero = ((((equal & up) + up) ^ up) | equal | down) & mask
        plus, minus = (down | ~(zero | up)) & mask, zero & up
        k = len(a) - 1 + tau - i
        if k >= width - 1:  # the band's lowest row lies above the last row: its diagonal is followed
            score += not zero & top
            if score > limit:
                return False
        else:  # the last row is followed
            score += (plus >> k & 1) - (minus >> k & 1)
        zero >>= 1
        up, down = (minus | ~(zero | plus)) & mask, zero & plus
    return score <= tau


STEP = 64  # a refined row's number in ``probes`` among what is left counts this much in ``how``
PAIRS = 64  # pairs of one group that are compared without a look at their histograms


def histogram(text: str) -> np.ndarray:
    """Counts of character pairs, by a hash in 64 bins; one edit changes at most four counts by one each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((c[:-1] * np.uint32(31) + c[1:]) & np.uint32(63), minlength=64).astype(np.int16)


def probes(tau: int = TAU) -> list[tuple[int, int, int, int]]:
    """Rows (delta, segment, shift, role): what a line sends out, role bit 0 for the index and bit 1 for probes.

    A line probes for shorter or equal lines of each length down to ``tau`` less; shifts are those of ``window``.
    """
    return [
        (delta, i, k, 3 if delta == k == 0 else 2)
        for delta in range(tau + 1)
        for i in range(tau + 1)
        for k in range(max(-i, delta - (tau - i)), min(i, delta + tau - i) + 1)
    ]


@lru_cache(maxsize=4096)
def _cuts(length: int, tau: int) -> list[tuple[int, int, int]]:
    """Start, end and hash seed of what a line of this length sends out, in the order of ``probes``."""
    out = []
    for delta in range(tau + 1):
        parts = segments(length - delta, tau)
        for d, i, k, _ in probes(tau):
            if d == delta:
                start, size = parts[i]
                out.append((start + k, start + k + size, (length - delta) * (tau + 1) + i))
    return out


def line_keys(line: str, tau: int = TAU) -> list[int]:
    """The unsigned keys of one line, in the order of ``probes``: hashes of a substring with its segment and length."""
    raw, digest = line.encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest
    if len(raw) == len(line):
        return [digest(raw[a:b], seed) for a, b, seed in _cuts(len(line), tau)]
    return [digest(line[a:b].encode("utf-8", "surrogatepass"), seed) for a, b, seed in _cuts(len(line), tau)]


def _rest(line: str, e: int, tau: int) -> tuple[str, int]:
    """What is left of a line without the segment that it sends out as row ``e`` of ``probes``, and that row's delta."""
    delta, i, k, _ = probes(tau)[e]
    start, size = segments(len(line) - delta, tau)[i]
    return line[: start + k] + line[start + k + size :], delta


def _matches(s: str, r: str, tau: int) -> Iterator[int]:
    """Rows of ``probes`` by which the longer line r finds a segment of s, in their order."""
    parts = segments(len(s), tau)
    for e, (delta, i, k, _) in enumerate(probes(tau)):
        start, size = parts[i]
        if delta == len(r) - len(s) and s[start : start + size] == r[start + k : start + k + size]:
            yield e


def meeting(s: str, r: str, refined: bool, tau: int = TAU) -> tuple[int, int]:
    """Where the linked lines s and r, not longer first, count: the first shared segment without which they are within
    ``tau`` edits still, and in a refined key the first segment that is shared by what is left; -1 for none.

    Of tau edits at least one of tau + 1 segments is free, with as many edits before it as its shift allows, so there
    is such a segment; it names one group for every pair, whatever keys are refined.
    """
    place = {i: e for e, (delta, i, k, _) in enumerate(probes(tau)) if delta == k == 0}
    for e in _matches(s, r, tau):
        a, b = _rest(s, place[probes(tau)[e][1]], tau)[0], _rest(r, e, tau)[0]
        if near(a, b, tau):
            return e, next(_matches(a, b, tau), -1) if refined else -1
    return -1, -1


def _group_links(index: list[tuple], probing: list[tuple], tau: int) -> list[tuple[int, int]]:
    """Linked pairs (index row, probing row) of one group that count here; rows are (id, how, length, text, ...)."""
    out = []
    if len(index) * len(probing) <= PAIRS:
        pairs = [(x, y) for x in range(len(index)) for y in range(len(probing))]
    else:
        pairs = []
        left = np.stack([histogram(row[3]) for row in index])
        for at in range(0, len(probing), BLOCK):
            right = np.stack([histogram(row[3]) for row in probing[at : at + BLOCK]])
            for low in range(0, len(left), BLOCK):
                close = np.abs(left[low : low + BLOCK, None] - right[None]).sum(axis=2, dtype=np.int32) <= 4 * tau
                pairs += [(low + int(x), at + int(y)) for x, y in zip(*np.nonzero(close), strict=True)]
    for x, y in pairs:
        (s_id, _, _, s), (r_id, how, _, r) = index[x][:4], probing[y][:4]
        if s_id == r_id or (len(s) == len(r) and s_id > r_id):
            continue
        if near(s, r, tau):
            e, f = meeting(s, r, how >= STEP, tau)
            if how == e + STEP * (f + 1):
                out.append((x, y))
    return out


def _keyed(own: DataFrame, tau: int) -> DataFrame:
    """Rows (key, id, role, how) of lines (id, first), dealt by key and sorted by key, role and id.

    how is the row of ``probes``, role 0 for the index and 1 for other probes.  The row's number takes the last bits of
    the hash, so that two numbers are shuffled for each key.
    """
    pattern = probes(tau)
    bits = (len(pattern) - 1).bit_length()
    how = np.arange(len(pattern), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2000):
            ids, keys = [], []
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).field("line").to_pylist(), strict=True):
                if len(line) >= JOIN_CHARS * (tau + 1):
                    ids.append(own)
                    keys += line_keys(line, tau)
            packed = np.array(keys, np.uint64).view(np.int64) >> bits << bits | np.tile(how, len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(packed), pa.array(np.repeat(np.array(ids, np.int64), len(pattern)))], names=["packed", "id"])

    sent = own.select("id", "first").mapInArrow(run, "packed long, id long").repartition(F.shiftright("packed", bits))
    number = F.col("packed").bitwiseAND((1 << bits) - 1).cast("int")
    role = F.when(number.isin([e for e, p in enumerate(pattern) if p[3] == 3]), 0).otherwise(1).cast("byte")
    return sent.select(F.shiftright("packed", bits).alias("key"), "id", role.alias("role"), number.alias("how")).sortWithinPartitions("key", "role", "id")


def _met(block: int, split: bool):
    """An Arrow function on rows (key, id, role, how, ...) sorted by key, role and id: keeps the groups of one key that
    have an index row and two lines.

    Without ``split`` it adds ``hot``, whether the group has more than ``block`` index rows.  With it, index rows are dealt
    to blocks, every row is sent to each block that it has to probe, and ``block`` and ``probe`` are added: an index
    row probes the blocks before its own, as its own has the lines that precede it.  At most 2 * block rows of a group
    are held; of a larger one the rest passes as it comes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        at, seen = None, 0  # the group that is passing, and its index rows so far

        def judged(batch: pa.RecordBatch, going: bool) -> pa.RecordBatch:
            nonlocal at, seen
            key, ids, role = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            index = np.add.reduceat((role == 0).astype(np.int64), starts)
            before = np.zeros(len(starts), np.int64)
            fine = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            if at is not None and key[0] == at:
                before[0], fine[0] = seen, True
            index += before
            if going:
                at, seen, fine[-1] = key[-1], int(index[-1]), True
            fine &= index > 0
            rows = np.flatnonzero(np.repeat(fine, sizes))
            index, before = np.repeat(index, sizes)[rows], np.repeat(before - np.r_[0, np.cumsum(index - before)[:-1]], sizes)
            if not split:
                return pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(index > block)], names=[*batch.schema.names, "hot"])
            number = (np.cumsum(role == 0) - 1 + before)[rows]  # of index rows, within their group
            own = role[rows] == 0
            last = np.where(own, number, index - 1) // block
            rows = np.repeat(rows, last + 1)
            to = np.arange(len(rows)) - np.repeat(np.cumsum(last + 1) - last - 1, last + 1)
            probe = ~np.repeat(own, last + 1) | (to < np.repeat(last, last + 1))
            return pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(to.astype(np.int32)), pa.array(probe)], names=[*batch.schema.names, "block", "probe"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy()
            first = int(np.searchsorted(key, key[-1]))
            if len(key) - first > 2 * block or (at is not None and key[-1] == at):
                held = None
                yield judged(batch, True)
            else:
                held = batch.slice(first)
                if first:
                    yield judged(batch.slice(0, first), False)
        if held is not None:
            yield judged(held, False)

    return run


def _refined(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id, role, how, hot, first) the hot ones again, under keys of segments of what is left of their lines."""
    own = [e for e, p in enumerate(probes(tau)) if p[3] == 3]
    for batch in small_batches(batches, 2000):
        keys, roles, hows, rows = [], [], [], []
        for n, (key, role, how, hot, first) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True)):
            rest, delta = _rest(first["line"], how, tau) if hot else ("", 0)
            if len(rest) - delta <= tau:
                keys.append(key)
                roles.append(role)
                hows.append(how)
                rows.append(n)
                continue
            for f, (start, end, seed) in enumerate(_cuts(len(rest), tau)):
                if probes(tau)[f][0] == delta:
                    sub = xxhash.xxh64_intdigest(rest[start:end].encode("utf-8", "surrogatepass"), seed)
                    keys.append(xxhash.xxh64_intdigest(f"{key}:{sub}") - (1 << 63))
                    roles.append(0 if role == 0 and f in own else 1)
                    hows.append(how + STEP * (f + 1))
                    rows.append(n)
        taken = batch.take(pa.array(rows, pa.int64()))
        arrays = [pa.array(keys, pa.int64()), taken.column(1), pa.array(roles, pa.int8()), pa.array(hows, pa.int32()), taken.column(5)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "id", "role", "how", "first"])


def _places(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, line_no, id, chk, line); mark tells rows apart that share a doc_id."""
    text = F.coalesce(col("text").cast("string"), F.lit(""))
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    own = own.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    return own.select("doc_id", "mark", "line_no", F.shiftrightunsigned(F.xxhash64("line"), 1).alias("id"), F.hash("line").alias("chk"), "line")


def edit_links(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """Rows (id, chk, n_links, earlier): of every line linked to another text, with how many, and whether one comes earlier.

    Different lines, with their first places, send their keys to one shuffle; sorted by key, the groups without two
    lines go, which are nearly all, and only the lines left are joined to their texts.  A key with more than ``block``
    index lines, as a hot segment has, is refined: its lines are dealt again by segments of what is left of them; a
    group that is still larger is split into blocks.  Pairs are not sent on: a pair counts in one group alone (see
    ``meeting``), and groups send sums.
    """
    own = _places(docs).where(F.length("line") >= min_chars)
    own = own.groupBy("id").agg(F.min(F.struct("chk", "doc_id", "mark", "line_no", "line")).alias("first"))
    hits = _keyed(own, tau).mapInArrow(_met(block, False), "key long, id long, role byte, how int, hot boolean")
    kind = own.schema["first"].dataType.simpleString()
    rows = hits.join(own, "id").select("key", "id", "role", "how", "hot", "first")
    rows = rows.mapInArrow(lambda batches: _refined(batches, tau), f"key long, id long, role byte, how int, first {kind}")
    rows = rows.repartition("key").sortWithinPartitions("key", "role", "id")
    rows = rows.mapInArrow(_met(block, True), f"key long, id long, role byte, how int, first {kind}, block int, probe boolean")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, probing = None, [], []
        links: dict[tuple[int, int], list[int]] = {}

        def meet() -> None:
            for x, y in _group_links(index, probing, tau):
                (s, p), (r, q) = index[x][4:], probing[y][4:]
                for own, late in ((s, q < p), (r, p < q)):
                    n = links.setdefault(own, [0, 0])
                    n[0] += 1
                    n[1] |= late
            probing.clear()

        def send() -> pa.RecordBatch:
            rows = [(*own, n, bool(late)) for own, (n, late) in links.items()]
            links.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "chk", "n_links", "earlier"])

        for batch in small_batches(batches, 2000):
            keys, ids, _, hows, firsts, blocks, probes_ = (batch.column(k).to_pylist() for k in range(7))
            for key, own, how, first, to, probe in zip(keys, ids, hows, firsts, blocks, probes_, strict=True):
                if (key, to) != at:
                    meet()
                    at, index = (key, to), []
                place = (first["doc_id"] is not None, first["doc_id"] or 0, first["mark"], first["line_no"])
                row = (own, how, len(first["line"]), first["line"], (own, first["chk"]), place)
                probing.append(row)
                if not probe:
                    index.append(row)
                elif len(probing) >= 8 * BLOCK:
                    meet()
            if links:
                yield send()
        meet()
        if links:
            yield send()

    found = rows.mapInArrow(run, "id long, chk int, n_links long, earlier boolean")
    return found.groupBy("id", "chk").agg(F.sum("n_links").alias("n_links"), F.max("earlier").alias("earlier"))


def line_decisions(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, mark, n_lines, n_links, n_removed, removed), one per different (doc_id, text) of ``docs``.

    A line, trimmed, of ``min_chars`` characters or more is removed if the same line stands earlier in the corpus,
    or its text is within ``tau`` edits of one whose first place is earlier; shorter lines stay.  The edits are for
    lines of JOIN_CHARS * (tau + 1) characters or more, as they would make most shorter ones alike.  Earlier means
    a smaller doc_id, then mark (the text's hash), then line number.  n_links sums, over the lines of the
    document, the different other texts within ``tau`` edits; ``removed`` has the line numbers, from 0.

    A text stays at its first place alone, so a document needs only the numbers of the lines that stay: a line that
    very many documents share sends one row.  The plan is the same at every size.

    A null text is one empty line; equal rows have one answer, which holds for all of them; a null doc_id
    counts as the smallest; lines of any length are compared whole; other columns are not read; an empty
    table gives no row.
    """
    flags = cut(edit_links(docs, tau, min_chars, block))
    places = _places(docs).where(F.length("line") >= min_chars)
    firsts = places.groupBy("id", "chk").agg(F.min(F.struct("doc_id", "mark", "line_no")).alias("first"))
    stay = firsts.join(flags, ["id", "chk"], "left").where("NOT coalesce(earlier, false)").select("first.doc_id", "first.mark", "first.line_no")
    linked = places.select("doc_id", "mark", "id", "chk").join(flags.select("id", "chk", "n_links"), ["id", "chk"]).groupBy("doc_id", "mark").agg(F.sum("n_links").alias("n_links"))
    text = F.coalesce(col("text").cast("string"), F.lit(""))
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.split(text, "\n").alias("lines"))
    long = F.filter(F.transform("lines", lambda x, k: F.when(F.length(F.trim(x)) >= min_chars, k)), lambda k: k.isNotNull())
    own = own.select("doc_id", "mark", F.size("lines").cast("long").alias("n_lines"), long.alias("long"))
    rows = own.unionByName(stay, allowMissingColumns=True).unionByName(linked, allowMissingColumns=True)
    found = rows.groupBy("doc_id", "mark").agg(F.max("n_lines").alias("n_lines"), F.max("n_links").alias("n_links"), F.count("n_lines").alias("copies"), F.max("long").alias("long"), F.collect_list("line_no").alias("stay"))
    removed = F.array_except("long", "stay")
    return found.select("doc_id", "mark", "n_lines", F.coalesce(F.expr("n_links div copies"), F.lit(0)).alias("n_links"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines of ``line_decisions`` removed from ``text``; columns as they were, n_chars, if there, as it now is.

    Documents that lose nothing, null texts among them, are not touched; a document that loses every line keeps an empty text.
    """
    gone = line_decisions(docs, tau, min_chars).where("n_removed > 0")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("removed").alias("__removed"))
    same = col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(col("text"), F.lit(""))) == F.col("__mark"))
    joined = docs.join(gone, same, "left")
    left = F.filter(F.split(col("text"), "\n"), lambda _, k: ~F.array_contains(F.col("__removed"), k))
    text = F.when(F.col("__removed").isNull(), col("text")).otherwise(F.array_join(left, "\n"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("__removed").isNull(), col(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(col(c))
    return joined.select(*out)
