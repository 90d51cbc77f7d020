"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile by tile."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmotif.llm.common import col, cut, small_batches, texts_of
from clipmotif.llm.components import components

SEED = 42
LANES = 4  # population counts are taken over this many 16-bit lanes
TILE_ROWS = 8192  # fingerprints of a class that one tile holds


def fingerprint(text: str, words: int = 3) -> int:
    """The unsigned fingerprint of one text; a text without words has fingerprint zero."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(itertools.accumulate(map(len, parts), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends[:-words])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Rows (doc_id, fp), one per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t, words) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _spanning(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a dense block of links: for rows and columns the least row that each reaches, and which columns have links."""
    rows, none = np.arange(mask.shape[0]), mask.shape[0]
    while True:
        columns = np.where(mask, rows[:, None], none).min(axis=0)
        again = np.minimum(rows, np.where(mask, columns[None, :], none).min(axis=1))
        if (again == rows).all():
            return rows, columns, columns < none
        rows = again


def tile_links(home: np.ndarray, visitors: np.ndarray, radius: int, high: int = 256, wide: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Links of two sets of unsigned fingerprints that join what all their pairs within ``radius`` join."""
    left, right = [], []
    for i in range(0, len(home), high):
        a = home[i : i + high]
        for j in range(0, len(visitors), wide):
            b = visitors[j : j + wide]
            mask = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            n = int(np.count_nonzero(mask))
            if not n:
                continue
            if n <= 2 * sum(mask.shape):
                x, y = np.nonzero(mask)
                left.append(a[x])
                right.append(b[y])
            else:
                rows, columns, linked = _spanning(mask)
                left += [a, a[columns[linked]]]
                right += [a[rows], b[linked]]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    x, y = np.concatenate(left), np.concatenate(right)
    return x[x != y], y[x != y]


def links(fps: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints connected by distances up to ``radius``.

    A tile is a set of fingerprints whose four lanes have the same population counts; two tiles whose
    counts differ by more than ``radius`` in total cannot hold a pair and never meet.  Classes larger
    than ``tile_rows`` are cut into several tiles; a task holds one tile and streams its visitors.  The
    class table has at most 17 ** 4 rows, whatever the input, and is broadcast.  Fingerprints are dealt out
    before each is sent to the up to 65 classes that it visits.
    """
    lane = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = fps.repartition(tasks, "fp").select("fp", *[lane(k).alias(f"p{k}") for k in range(LANES)])
    number = lambda *p: p[0] * 4913 + p[1] * 289 + p[2] * 17 + p[3]
    known = known.withColumn("class", number(*[F.col(f"p{k}") for k in range(LANES)]))
    sizes = cut(known.groupBy("class").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles")))
    sizes = F.broadcast(sizes)
    known = known.join(sizes, "class").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int")).drop("tiles")
    home = known.select("class", "tile", F.lit(0).alias("visits"), "fp")
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=LANES) if sum(map(abs, d)) <= radius and d >= (0,) * LANES]
    there = [
        F.when(
            F.expr(" AND ".join(f"p{k} + {d[k]} BETWEEN 0 AND 16" for k in range(LANES) if d[k]) or "true"),
            F.struct(number(*[F.col(f"p{k}") + d[k] for k in range(LANES)]).alias("class"), F.lit(not any(d)).alias("own")),
        )
        for d in steps
    ]
    visits = known.select("fp", F.col("tile").alias("from"), F.explode(F.array(*there)).alias("to")).where("to IS NOT NULL")
    visits = visits.select("fp", "from", "to.class", "to.own").join(sizes, "class")
    last = F.when(F.col("own"), F.col("from")).otherwise(F.col("tiles") - 1)
    visits = visits.select("class", F.explode(F.sequence(F.lit(0), last)).alias("tile"), F.lit(1).alias("visits"), "fp")
    rows = home.unionByName(visits).repartition("class", "tile").sortWithinPartitions("class", "tile", "visits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in batches:
            cls, tile, visits, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            fp, key = fp.view(np.uint64), cls.astype(np.int64) << 32 | tile
            bounds = np.flatnonzero(np.diff(key)) + 1
            found = []
            for a, b in zip([0, *bounds], [*bounds, len(key)], strict=True):
                if a == b:
                    continue
                if key[a] != at:
                    at, own = key[a], np.empty(0, np.uint64)
                cut_at = a + int(np.searchsorted(visits[a:b], 1))
                if cut_at > a:
                    own = np.concatenate([own, fp[a:cut_at]])
                if b > cut_at:
                    found.append(tile_links(own, fp[cut_at:b], radius))
            u = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
            v = np.concatenate([y for _, y in found]) if found else np.empty(0, np.uint64)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per row of ``docs(doc_id, text)``.

    Fingerprints within ``radius`` differing bits link; component_id is the least doc_id reachable.
    A null or blank text has fingerprint zero and links like any other; a text of fewer than ``words``
    words is one shingle; repeated rows are linked copies; a row with a null doc_id belongs to its
    component without naming it (null if all its members are null); other columns are not read; an
    empty table gives no row.
    """
    all_fps = cut(fingerprints(docs, words))
    distinct = cut(all_fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = cut(components(links(distinct.select("fp"), radius, tile_rows)).join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "first_id"))
    roots = cut(linked.groupBy("root").agg(F.min("first_id").alias("least_id")))
    least = linked.join(roots, "root").select("fp", "least_id")
    classes = cut(distinct.join(least, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")))
    return all_fps.join(classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id; columns as they were.

    Rows that share a doc_id stand or fall together, by the best of them; rows with a null doc_id stay.
    """
    groups = near_duplicates(docs, radius, words).where("doc_id IS NOT NULL")
    gone = groups.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone")
    gone = gone.select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, col("doc_id") == F.col("__gone"), "left_anti")
