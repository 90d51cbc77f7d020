"""Token ids in binary files: one wavelet matrix a shard, written and read by Spark, with access, counts and look-up."""

from __future__ import annotations

import functools
import json
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipmotif.llm.common import col, shared_folder

MAGIC = b"WVMX0001"
BLOCK_BYTES = 4096  # of a plane that are compressed together
SHARD_TOKENS = 1 << 22  # a shard ends with the document that reaches this
END_ID = 2
CACHE = 400_000  # words whose ids a worker keeps in a generation, of two
PIECE_BYTES = 8_000_000  # texts of about so many bytes are encoded at a time
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: ASCII marks around a word; none of them begins a contraction
MARKS = string.punctuation.replace("'", "").encode()
WORD = re.compile(rb"[A-Za-z]+")
#: letters that no normal form changes, and that each have one lower-case letter
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


def _bits(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")


class Wavelet:
    """A wavelet matrix over one file's bytes; only the blocks that a look-up touches are decompressed.

    The plane of the highest bit holds that bit of every token in order; each next plane holds the next bit in the order
    that a stable partition by the bits before gives, zeros first.  Of every plane's blocks the file keeps where they
    begin and how many ones come before them, which makes rank a look-up and a count in one block, and select a binary
    search.  A file may be followed by further bytes.
    """

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("this is no token file")
        size = struct.unpack_from("<Q", data, len(MAGIC))[0]
        at = len(MAGIC) + 8
        head = json.loads(zstandard.decompress(data[at : at + size]))
        self.n, self.width, self.zeros, self.block, self.tables = head["tokens"], head["planes"], head["zeros"], head["block_bytes"], head["tables"]
        self._data, self._at = data, at + size
        self._begins, self._ones = self._table("begins", np.uint32), self._table("ones", np.uint32)
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def _table(self, name: str, kind: type) -> np.ndarray:
        a, b = self.tables[name]
        return np.frombuffer(zstandard.decompress(self._data[self._at + a : self._at + b]), kind)

    @staticmethod
    def build(tokens: np.ndarray, documents: list[tuple[int | None, int]], block: int = BLOCK_BYTES) -> bytes:
        """The file of the ``tokens`` of ``documents``, pairs of an id (or None) and the number of tokens."""
        tokens = np.asarray(tokens, np.uint32)
        n, width = len(tokens), max(1, int(tokens.max(initial=0)).bit_length())
        pack = zstandard.ZstdCompressor(level=1).compress
        own, begins, ones, zeros, parts, at = tokens.astype(np.uint16 if width <= 16 else np.uint32), [], [], [], [], 0
        for level in range(width):
            bit = (own & own.dtype.type(1 << (width - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), block), dtype=np.int64).tolist() if n else []
            packed = packed.tobytes()
            ones += [sum_ - c for sum_, c in zip(np.cumsum(counts).tolist(), counts, strict=True)] + [sum(counts)]
            for k in range(0, len(packed), block):
                part = pack(packed[k : k + block])
                begins.append(at)
                parts.append(part)
                at += len(part)
            begins.append(at)
            zeros.append(n - int(bit.sum()))
            own = np.concatenate([own[~bit], own[bit]])
        ids = np.array([d or 0 for d, _ in documents], np.int64)
        tables, offset = {}, 0
        listed = {
            "doc_ids": ids.tobytes(), "known": np.array([d is not None for d, _ in documents], np.uint8).tobytes(), "lengths": np.array([m for _, m in documents], np.uint32).tobytes(),
            "begins": np.array(begins, np.uint32).tobytes(), "ones": np.array(ones, np.uint32).tobytes(),
        }
        body = []
        for name, data in listed.items():
            body.append(pack(data))
            tables[name] = (offset, offset + len(body[-1]))
            offset += len(body[-1])
        tables["planes"] = (offset, offset + at)
        head = pack(json.dumps({"tokens": n, "planes": width, "zeros": zeros, "block_bytes": block, "documents": len(ids), "tables": tables}).encode())
        return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *body, *parts])

    @property
    def blocks(self) -> int:
        """Blocks of a plane."""
        return -(-self.n // (8 * self.block))

    def documents(self) -> list[tuple[int | None, int, int]]:
        """Rows (doc_id, first token, number of tokens) in order."""
        lengths = self._table("lengths", np.uint32).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        known = self._table("known", np.uint8)
        return [(d if k else None, s, m) for d, k, s, m in zip(self._table("doc_ids", np.int64).tolist(), known.tolist(), starts.tolist(), lengths.tolist(), strict=True)]

    def _block(self, level: int, k: int) -> np.ndarray:
        """The bytes of one block of a plane."""
        if (level, k) not in self._kept:
            own = self._begins[level * (self.blocks + 1) + k :]
            at = self._at + self.tables["planes"][0]
            self._kept[level, k] = np.frombuffer(zstandard.decompress(self._data[at + int(own[0]) : at + int(own[1])]), np.uint8)
        return self._kept[level, k]

    def _plane(self, level: int) -> np.ndarray:
        return _bits(b"".join(self._block(level, k).tobytes() for k in range(self.blocks)))[: self.n]

    def rank(self, level: int, i: int) -> int:
        """The ones among the first ``i`` bits of a plane."""
        k, bit = divmod(i, 8 * self.block)
        count = int(self._ones[level * (self.blocks + 1) + k])
        if bit:
            own = self._block(level, k)
            count += int(POPCOUNT[own[: bit // 8]].sum()) + (int(POPCOUNT[own[bit // 8] & ((1 << bit % 8) - 1)]) if bit % 8 else 0)
        return count

    def select(self, level: int, value: int, j: np.ndarray) -> np.ndarray:
        """The places of the bits of that value, zero or one, that ``j`` such bits come before; ``j`` ascends."""
        own = self._ones[level * (self.blocks + 1) : (level + 1) * (self.blocks + 1)].astype(np.int64)
        own = own if value else np.minimum(np.arange(len(own)) * 8 * self.block, self.n) - own
        home = np.searchsorted(own, j, side="right") - 1
        out = np.empty(len(j), np.int64)
        for k in np.unique(home).tolist():
            bits = _bits(self._block(level, k).tobytes())[: self.n - 8 * self.block * k]
            here = slice(*np.searchsorted(home, [k, k + 1]))
            out[here] = 8 * self.block * k + np.flatnonzero(bits == value)[j[here] - own[k]]
        return out

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.width):
            before = self.rank(level, i)
            bit = self.rank(level, i + 1) - before
            token = 2 * token + bit
            i = self.zeros[level] + before if bit else i - before
        return token

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where the occurrences of a token among the places a..b lie below the last plane."""
        if token >> self.width:
            return 0, 0
        for level in range(self.width):
            before, upto = self.rank(level, a), self.rank(level, b)
            if token >> (self.width - 1 - level) & 1:
                a, b = self.zeros[level] + before, self.zeros[level] + upto
            else:
                a, b = a - before, b - upto
            if a >= b:
                break
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often a token stands at the places a..b, the last one excluded."""
        a, b = self._range(token, max(a, 0), self.n if b is None else min(b, self.n))
        return max(0, b - a)

    def locate(self, token: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """The places a..b at which a token stands, ascending: select, plane by plane upwards."""
        at = np.arange(*self._range(token, max(a, 0), self.n if b is None else min(b, self.n)), dtype=np.int64)
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order: from the last plane up the two halves of each plane are dealt to its zeros and ones."""
        out = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            plane = self._plane(level)
            ones, below = plane.view(bool), out
            out = np.empty_like(below)
            out[~ones] = below[: self.zeros[level]]
            out[ones] = below[self.zeros[level] :] | out.dtype.type(1 << (self.width - 1 - level))
            for k in range(self.blocks):
                self._kept.pop((level, k), None)
        return out.astype(np.uint32)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class Known(dict):
    """The ids of words, as bytes; those of a new word are found when it is first asked for."""

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if "Lowercase" not in steps or splits[0].get("behavior") != "Removed" or not splits[0].get("invert") or splits[-1]["type"] != "ByteLevel":
            raise ValueError("only byte-level tokenizers that lower the case and drop white space are supported")
        self.model, self.kind = self.tokenizer.model, kind
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.old: dict[bytes, bytes] = {}
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})

    def __missing__(self, word: bytes) -> bytes:
        bare = word.rstrip(MARKS)
        if bare.isalpha():  # ASCII letters; only their lower-case form is kept
            low = bare.lower()
            if low != word:
                return self[low] + (self[word[len(bare) :]] if len(bare) < len(word) else b"")
        if len(self) >= CACHE:  # words that are not asked for again are forgotten with the next generation
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self._ids(word)
        self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        bare = word.strip(MARKS)
        if WORD.fullmatch(bare):
            bare = bare.lower()
            own = bare.decode()
        elif LATIN.fullmatch(text := bare.decode("utf-8", "replace")):
            own = text.lower().encode().decode("latin-1").translate(self.letters)
        else:
            own = None
        if own is None or (b"<" in word and any(x in word for x in self.special)):
            return array(self.kind, self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if bare == word:
            return array(self.kind, [t.id for t in self.model.tokenize(own)]).tobytes()
        at = word.index(word.strip(MARKS))
        return b"".join([self[x] for x in (word[:at], bare, word[at + len(bare) :]) if x])


class Encoder:
    """Ids of texts by a tokenizer file.

    The tokenizer may not join what white space parts, as those that drop white space before they split; so texts are
    encoded word by word, and the ids of words met before are kept, up to ``CACHE`` of them.  A word of Latin letters
    between ASCII marks goes to the model in its parts, as the file's splitting would give them; any other word goes
    through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.known = Known(path, "I")
        if self.known.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16:
            self.known.kind = "H"

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end_id`` after each, and where each text's ids end; a null text is empty.

        Arrow splits the texts and names their different words, so Python sees each of those once.
        """
        known, kind = self.known, np.dtype(self.known.kind)
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        named = split.flatten().dictionary_encode()
        named = named.combine_chunks() if isinstance(named, pa.ChunkedArray) else named
        each = [known[w] if w else b"" for w in named.dictionary.cast(pa.large_binary()).to_pylist()]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // kind.itemsize
        flat, begins = np.frombuffer(b"".join(each), kind), np.cumsum(sizes) - sizes
        word = named.indices.to_numpy()
        n = sizes[word]
        upto = np.r_[0, np.cumsum(n)]
        ids = flat[np.repeat(begins[word] - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
        return np.insert(ids.astype(np.uint32), ends, end_id), ends + np.arange(1, len(ends) + 1)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches (doc_id, text, …) whose texts have about ``most`` bytes."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        bounds = [0, *(np.flatnonzero(np.diff(sizes // most)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(bounds):
            if b > a:
                yield batch.slice(a, b - a)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the tokens of ``docs(doc_id, text)`` to files in ``folder``, in ascending order of doc_id.

    Rows are dealt out by ranges of doc_id and sorted; each task encodes its own in order, ends every document with
    ``end_id``, and closes a shard with the document that brings it to ``shard_tokens`` tokens.  A shard is one file in
    part=<range>/shard=<number>/tokens=<tokens>, so folders in order name files in order and how long they are.  Spark
    writes and commits the files, so they can be in any store, and a lost task leaves none.

    A null doc_id comes first; rows of one doc_id come in the order in which they are read; a null or empty text is the
    end id alone; an empty table writes no shard.
    """
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    own = own.withColumn("at", F.monotonically_increasing_id())  # a doc_id with very many rows can be cut
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartitionByRange(tasks, "doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, documents = 0, 0, [], 0, []

        def shard() -> pa.RecordBatch:
            data = Wavelet.build(np.concatenate(held), documents)
            arrays = [pa.array([data], pa.binary()), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["value", "part", "shard", "tokens"])

        for batch in pieces(batches):
            part = batch.column(2)[0].as_py()
            ids, ends = encoder(tokenizer).encode(batch.column(1), end_id)
            names, begin = batch.column(0).to_pylist(), 0
            own = np.diff(np.r_[0, ends]).tolist()
            for k, end in enumerate(ends.tolist()):
                documents.append((names[k], own[k]))
                if size + end - begin >= shard_tokens:
                    held.append(ids[begin:end])
                    size += end - begin
                    yield shard()
                    number, held, size, documents, begin = number + 1, [], 0, [], end
            held.append(ids[begin:])
            size += len(ids) - begin
        if documents:
            yield shard()

    shards = own.mapInArrow(run, "value binary, part int, shard int, tokens long")
    # the text writer puts a column's bytes into the file as they are
    shards = shards.withColumn("value", F.col("value").cast("string"))
    shards.write.partitionBy("part", "shard", "tokens").mode("overwrite").text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(content, part, shard, tokens) of the files of a folder; a folder without files has no numbers in its names."""
    own = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    number = lambda name, kind: (F.col(name) if name in own.columns else F.lit(None)).cast(kind).alias(name)
    return own.select("content", number("part", "int"), number("shard", "int"), number("tokens", "long"))


def shard_table(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (part, shard, tokens, base): the shards of a folder, and how many tokens come before each.

    Read from the folders' names alone.  Sums go over the shards of a range in Spark, and then over ranges, of which
    there is one a task, in the driver.
    """
    own = _files(spark, folder).select("part", "shard", "tokens")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted((r["part"], r["n"]) for r in own.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    before = dict(zip((p for p, _ in parts), accumulate((n for _, n in parts), initial=0), strict=False))
    first = spark.createDataFrame(list(before.items()), "part int, before long")
    own = own.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(first, "part")
    return own.select("part", "shard", "tokens", (F.col("before") + F.col("within")).alias("base"))


def _read(spark: SparkSession, folder: str, run, schema: str) -> DataFrame:
    """Rows that ``run`` makes of each file (``Wavelet``), with their shard's numbers; ``start`` counts from the first shard."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = run(Wavelet(batch.column(0)[k].as_py()))
                own = pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in rows], _kinds(schema))
                numbers = [pa.array([batch.column(i)[k].as_py()] * own.num_rows, pa.int32()) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([*numbers, *own.columns], names=["part", "shard", *fields])

    rows = _files(spark, folder).select("content", "part", "shard").mapInArrow(each, f"part int, shard int, {schema}")
    table = shard_table(spark, folder).select("part", "shard", "base")
    return rows.join(table, ["part", "shard"]).withColumn("start", F.col("base") + F.col("start")).select(*fields)


def _kinds(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the files of a folder; the crc32 is that of the ids as unsigned 32-bit integers."""

    def run(file: Wavelet) -> list[tuple]:
        ids = memoryview(file.tokens().astype("<u4").tobytes())
        return [(doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])) for doc, start, n in file.documents()]

    return _read(spark, folder, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, ids) of the files of a folder."""

    def run(file: Wavelet) -> list[tuple]:
        ids = file.tokens()
        return [(doc, start, ids[start : start + n].tolist()) for doc, start, n in file.documents()]

    return _read(spark, folder, run, "doc_id long, start long, ids array<int>")


def find_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """Rows (doc_id, start, n, places) of the documents that hold a token: how often, and at which of their places.

    Only the blocks on the token's way through the planes are decompressed.
    """

    def run(file: Wavelet) -> list[tuple]:
        found = file.locate(token)
        rows = file.documents()
        starts = np.array([s for _, s, _ in rows], np.int64)
        own = np.searchsorted(starts, found, side="right") - 1
        # documents of no token do not exist: each has its end id
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
        return [(rows[own[a]][0], rows[own[a]][1], len(p), (p - rows[own[a]][1]).tolist()) for a, p in zip(heads, np.split(found, heads[1:]) if len(own) else [], strict=True)]

    return _read(spark, folder, run, "doc_id long, start long, n long, places array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``write_shards`` to a new folder beside the checkpoints, and ``read_documents`` of it.

    The files stay as checkpoints do.  Odd rows are treated as ``write_shards`` says: every row gives one row, and an
    empty table none.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, tokenizer, folder, end_id, shard_tokens)
    return read_documents(spark, folder)
