"""Secret scans: fixed patterns, and random-looking strings told from identifiers by two character models."""

from __future__ import annotations

import hashlib
import importlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmotif.llm.common import col, cut, small_batches, texts_of

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = np.full(128, -1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))
MIN_CHARS = 16  # of a stretch that the models judge
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RUN = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"[A-Za-z]{3,}")
MAX_SAMPLES = 2000  # strings of each label, gathered from the corpus; those that hash lowest
FALSE_ALARMS = 0.001  # of the ordinary training strings, that the evidence asked for may let through
LEAST_EVIDENCE = 12.5  # nats
SHORT = 4  # characters without evidence that may stand within a key, between separators


def gather(docs: DataFrame, max_samples: int = MAX_SAMPLES) -> tuple[list[str], list[str]]:
    """Labelled strings of the whole corpus: values that the fixed patterns find, and ordinary words.

    Of each label the ``max_samples`` different strings that hash lowest, so the sample is bounded and the same
    however rows are dealt out; every task sends so many at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[dict[int, str]] = [{}, {}]
        for batch in small_batches(batches):
            seen: list[set[str]] = [set(), set()]
            for text in texts_of(batch, "text"):
                seen[0].update(WORD.findall(text))
                seen[1].update(v for v in (text[x[0] : x[1]].rpartition("=")[2].rpartition(":")[2].strip(" \"'") for x in base_spans(text)) if TOKEN.fullmatch(v))
            for own, strings in zip(least, seen, strict=True):
                own |= {xxhash.xxh64_intdigest(x) >> 1: x for x in strings}
                for h in sorted(own)[max_samples:]:
                    del own[h]
        rows = [(label, h, x) for label, own in enumerate(least) for h, x in own.items()]
        for at in range(0, len(rows), 1000):
            columns = zip(*rows[at : at + 1000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.string()), strict=True)], names=["label", "h", "string"])

    found = docs.select(col("text").cast("string").alias("text")).mapInArrow(run, "label int, h long, string string").distinct()
    first = lambda label: [r["string"] for r in found.where(F.col("label") == label).orderBy("h").limit(max_samples).collect()]
    found = cut(found)
    return first(1), first(0)


#: modules whose names are ordinary identifiers of programs
MODULES = "argparse asyncio builtins calendar codecs collections concurrent.futures configparser csv ctypes datetime decimal email.message html.parser http.client http.server imaplib inspect io json logging logging.handlers multiprocessing os pathlib pickle re shutil smtplib socket socketserver sqlite3 ssl string subprocess tarfile tempfile threading typing unittest unittest.mock urllib.parse urllib.request uuid warnings xml.dom.minidom xml.etree.ElementTree xml.sax.handler zipfile".split()


def identifiers() -> list[str]:
    """Ordinary identifiers: the public names in MODULES and in their classes."""
    names: set[str] = set()
    for module in map(importlib.import_module, MODULES):
        for name, value in vars(module).items():
            names.add(name)
            if isinstance(value, type):
                names.update(vars(value))
    return sorted(n for n in names if len(n) > 2 and not n.startswith("_"))


def samples(secrets: list[str], words: list[str], n: int = 4000, seed: int = 7) -> tuple[list[str], list[str]]:
    """Labelled strings for the two models: random ones (n uniform draws beside ``secrets``), and n ordinary ones made of
    ``words`` and of ``identifiers`` in the styles of programs, paths and headings, besides numbers, times, versions, ids,
    alphabets and rules."""
    r = random.Random(seed)
    letters = ALPHABET[:62]
    sets = ["0123456789ABCDEF", letters, ALPHABET[:26] + "0123456789", ALPHABET[26:62], ALPHABET[:64], letters + "_-"]
    noise = secrets + ["".join(r.choices(r.choice(sets), k=r.randint(MIN_CHARS, 64))) for _ in range(n)]
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    names, row = identifiers(), string.ascii_lowercase + string.digits
    plain = []
    for i in range(n if words else 0):
        w = r.choices(words, k=r.randint(3, 7))
        x = r.choices(names, k=r.randint(2, 5))
        a = r.randrange(12)
        styles = (
            lambda: "_".join(w).lower(), lambda: w[0] + "".join(x.title() for x in w[1:]), lambda: "-".join(w), lambda: "_".join(w).upper(), lambda: "/".join(w) + digits(r.randint(0, 2)),
            lambda: "".join(w), lambda: "".join(x.title() for x in w), lambda: w[0] * 3, lambda: digits(r.randint(MIN_CHARS, 30)), lambda: r.choice("=-_/+") * r.randint(10, 40) + w[0],
            lambda: f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}-{digits(2)}-{digits(2)}_{w[0]}_{w[1]}", lambda: f"{w[0]}-{w[1]}-v{digits(1)}-{digits(2)}-{digits(1)}-{w[2]}",
            lambda: "-".join("".join(r.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)),
            lambda: x[0] + "".join(y[:1].upper() + y[1:] for y in x[1:]), lambda: "/".join(x) + digits(r.randint(0, 3)), lambda: "_".join(x), lambda: "-".join(y + digits(1) for y in x),
            lambda: f"{x[0]}/{digits(4)}/{digits(2)}/{digits(2)}/{x[1]}_{digits(8)}_{digits(6)}", lambda: "".join(y[:1].upper() + y[1:] for y in x),
            lambda: "".join(c.upper() if i % 2 else c for c in row[a : a + r.randint(MIN_CHARS, 36)]), lambda: (string.ascii_letters + string.digits + "+/")[a:],
        )
        plain.append(styles[i % len(styles)]())
    return noise, plain


def _pairs(string: str) -> tuple[np.ndarray, np.ndarray]:
    c = CODE[np.frombuffer(string.encode("ascii"), np.uint8)]
    return c[:-1], c[1:]


def held_out(string: str) -> bool:
    """Whether a labelled string serves to measure the models and not to train them: one in five, by its hash."""
    return xxhash.xxh64_intdigest(string, 1) % 5 == 0


class Models:
    """Two first-order character models with add-a-half smoothing: the log-likelihood ratio of every pair, random over
    ordinary, and the evidence (summed ratio, nats) from which a stretch counts as random.

    The evidence is what all but FALSE_ALARMS of the ordinary training strings stay below, LEAST_EVIDENCE at
    least.  Without ordinary strings nothing can be told apart, and nothing counts as random.
    """

    def __init__(self, noise: list[str], plain: list[str]) -> None:
        self.table = np.zeros((len(ALPHABET),) * 2)
        for strings, sign in ((noise, 1), (plain, -1)):
            counts = np.full(self.table.shape, 0.5)
            for s in strings:
                if not held_out(s):
                    np.add.at(counts, _pairs(s), 1)
            self.table += sign * np.log(counts / counts.sum(axis=1, keepdims=True))
        self.evidence = LEAST_EVIDENCE if plain else np.inf
        most = [self.best(s)[2] for s in plain if not held_out(s)]
        if most:
            self.evidence = max(self.evidence, float(np.quantile(most, 1 - FALSE_ALARMS)) + 1e-9)

    def parts(self, string: str) -> list[tuple[int, int, float]]:
        """The stretches of a string that may be secrets: (start, end, summed ratio).

        The runs of letters and digits between separators are judged one by one.  Runs of positive ratio that only
        separators part belong together, as do those that runs of up to SHORT characters in all part; any other run ends a
        stretch, so that each of several keys in a path has its own.
        """
        table = self.table
        out: list[tuple[int, int, float]] = []
        gap = True  # whether the next run begins a stretch of its own
        for m in RUN.finditer(string):
            a, b = m.span()
            sum_ = float(table[_pairs(m[0])].sum()) if b - a > 1 else 0.0
            if sum_ <= 0:
                gap |= b - a > SHORT
            elif gap or a - out[-1][1] > SHORT + 2:
                out.append((a, b, sum_))
                gap = False
            else:
                start, end, before = out[-1]
                out[-1] = (start, b, before + sum_ + float(table[_pairs(string[end - 1 : a + 1])].sum()))
        return out

    def best(self, string: str) -> tuple[int, int, float]:
        """Of ``parts`` that are long enough the one of greatest sum; an empty one if there is none."""
        return max((p for p in self.parts(string) if p[1] - p[0] >= MIN_CHARS), key=lambda p: p[2], default=(0, 0, 0.0))

    def spans(self, string: str, offset: int = 0) -> list[tuple[int, int]]:
        """The random stretches of a string of ALPHABET, from left to right; a key's closing = belongs to it."""
        out = []
        for a, b, sum_ in self.parts(string):
            if b - a >= MIN_CHARS and sum_ >= self.evidence:
                while b < len(string) and string[b] == "=":
                    b += 1
                out.append((offset + a, offset + b))
        return out


def rates(models: Models, noise: list[str], plain: list[str]) -> tuple[float, float]:
    """Recall and share of false alarms on the held-out strings of MIN_CHARS characters or more."""
    share = lambda strings: float(np.mean([bool(models.spans(s)) for s in strings if held_out(s) and len(s) >= MIN_CHARS] or [0]))
    return share(noise), share(plain)


def train(docs: DataFrame, max_samples: int = MAX_SAMPLES) -> Models:
    """The models of a corpus: its own words and the values that the fixed patterns find in it label the samples."""
    return Models(*samples(*gather(docs, max_samples)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(text: str, models: Models) -> tuple[list, list]:
    """The base spans of a text, and all spans with those that only the character models find, outside of the base spans."""
    base = base_spans(text)
    more = []
    for m in TOKEN.finditer(text):
        at, end = m.span()
        for x in [*base, (end, end, "")]:
            if x[1] > at and x[0] <= end:
                more += [(a, b, "markov") for a, b in models.spans(text[at : max(at, x[0])], at)]
                at = max(at, x[1])
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov), one per row of ``docs(doc_id, text)``.

    ``spans`` lists kind:start:end in code points, by start and then kind; base_sha256 is taken over the
    same list without the models' spans.  Without ``models`` they are trained on ``docs`` when this is called.

    A null or empty text has no spans (the hash of the empty string); matches of different kinds may
    overlap and all stay; a models' span never overlaps a base span; repeated rows are scanned each;
    other columns are not read; an empty table gives no row.
    """
    models = models or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[list] = [[] for _ in range(6)]
            for text in texts_of(batch):
                base, spans = scan(text, models)
                for i, kind in enumerate(KINDS[:3]):
                    out[i].append(sum(x[2] == kind for x in base))
                out[3].append(hashlib.sha256(_said(base).encode()).hexdigest())
                out[4].append(_said(spans))
                out[5].append(len(spans) - len(base))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    own = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")
