"""Base-pairing probabilities from a nearest-neighbour partition function, over tiles of the sequences.

Spark deals out the tiles and puts them together again; within a task a batch of tiles is computed at once,
one diagonal of the base-pair matrix a step.  Pairs are C-G and A-U; dangles are counted on both sides.
Small interior loops follow rules (``SMALL``) instead of measured tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmotif.functions.prob import filled
from clipmotif.functions.seq import replace_n

TILE, OVERLAP, PADDING, TURN, MAX_LOOP = 250, 50, 20, 3, 30

# Nearest-neighbour energies at 37 C, in 0.01 kcal/mol, as published by Mathews, Sabina, Zuker and Turner, "Expanded
# sequence dependence of thermodynamic parameters improves prediction of RNA secondary structure", J. Mol. Biol. 288
# (1999) 911-940: stacks, loop lengths, terminal mismatches, dangling ends, tetraloop bonuses, multiloops.  Pairs in the
# order CG, GC, AU, UA; bases in the order A, C, G, U.
KT = (37.0 + 273.15) * 1.98717 / 10
STACK = ((-240, -330, -210, -210), (-330, -340, -220, -240), (-210, -220, -110, -90), (-210, -240, -90, -130))
HAIRPIN = (570, 560, 560, 540, 590, 560, 640, 650, 660, 670, 678, 686, 694, 701, 707, 713, 719, 725, 730, 735, 740, 744, 749, 753, 757, 761, 765, 769)  # from 3
BULGE = (380, 280, 320, 360, 400, 440, 459, 470, 480, 490, 500, 510, 519, 527, 534, 541, 548, 554, 560, 565, 571, 576, 580, 585, 589, 594, 598, 602, 605, 609)  # from 1
INTERIOR = (410, 510, 170, 180, 200, 220, 230, 240, 250, 260, 270, 278, 286, 294, 301, 307, 313, 319, 325, 330, 335, 340, 345, 349, 353, 357, 361, 365, 369)  # from 2
MISMATCH_HAIRPIN = (
    ((-150, -150, -140, -180), (-100, -90, -290, -80), (-220, -200, -160, -110), (-170, -140, -180, -200)),
    ((-110, -150, -130, -210), (-110, -70, -240, -50), (-240, -290, -140, -120), (-190, -100, -220, -150)),
    ((-30, -50, -30, -30), (-10, -20, -150, -20), (-110, -120, -20, 20), (-30, -30, -60, -110)),
    ((-50, -30, -60, -50), (-20, -10, -120, 0), (-140, -120, -70, -20), (-30, -10, -50, -80)),
)
DANGLE5 = ((-50, -30, -20, -10), (-20, -30, 0, 0), (-30, -30, -40, -20), (-30, -10, -20, -20))
DANGLE3 = ((-110, -40, -130, -60), (-170, -80, -170, -120), (-70, -10, -70, -10), (-80, -50, -80, -60))
#: tetraloops with their closing pair
TETRALOOPS = {
    "GGGGAC": -300, "GGUGAC": -300, "CGAAAG": -300, "GGAGAC": -300, "CGCAAG": -300,
    "GGAAAC": -300, "CGGAAG": -300, "CUUCGG": -300, "CGUGAG": -300, "CGAAGG": -250,
    "CUACGG": -250, "GGCAAC": -250, "CGCGAG": -250, "UGAGAG": -250, "CGAGAG": -200,
    "AGAAAU": -200, "CGUAAG": -200, "CUAACG": -200, "UGAAAG": -200, "GGAAGC": -150,
    "GGGAAC": -150, "UGAAAA": -150, "AGCAAU": -150, "AGUAAU": -150, "CGGGAG": -150,
    "AGUGAU": -150, "GGCGAC": -150, "GGGAGC": -150, "GUGAAC": -150, "UGGAAA": -150,
}
TERMINAL_AU, NINIO, MAX_NINIO, LOG_LOOP = 50, 50, 300, 107.856
MULTI_CLOSE, MULTI_STEM = 340, 40
#: interior loops of 1x1, 2x1 and 2x2 bases: an energy, and what each A-U end adds
SMALL = {(1, 1): (40, 70), (1, 2): (230, 70), (2, 1): (230, 70), (2, 2): (110, 70)}


def _w(energy) -> np.ndarray:
    return np.exp(-np.asarray(energy, float) / KT * 1.0)


CODES = {c: i + 1 for i, c in enumerate("ACGU")} | {"T": 4}
PAIR = np.zeros((5, 5), int)
PAIR[2, 3], PAIR[3, 2], PAIR[1, 4], PAIR[4, 1] = 1, 2, 3, 4
BACK = np.array([0, 2, 1, 4, 3])
AU = np.array([1, 1, 1, *_w([TERMINAL_AU] * 2)])


def _table(values, fill: float = 1.0) -> np.ndarray:
    """Weights with a row for no pair and a place for no base in front."""
    w = _w(values)
    return np.pad(w, [(1, 0)] * w.ndim, constant_values=fill)


STACK_W, MM_H, D5, D3 = _table(STACK), _table(MISMATCH_HAIRPIN), _table(DANGLE5), _table(DANGLE3) * AU[:, None]
MM_I = np.zeros((4, 4, 4))
MM_I[2:] += 70
for _p in range(4):
    for (_x, _y), _e in {(0, 2): -110, (2, 0): -110, (3, 3): -70}.items():
        MM_I[_p, _x, _y] += _e
MM_I = _table(MM_I)


def _long(values: tuple[int, ...], first: int, n: int) -> np.ndarray:
    """Energies of loops of 0 … n bases; longer than the table by the logarithm of their length."""
    out = np.full(n + 1, np.inf)
    for u in range(first, n + 1):
        k = min(u - first, len(values) - 1)
        out[u] = values[k] + (LOG_LOOP * np.log(u / 30) if u > 30 else 0)
    return out


def pair_probabilities(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays p[b, i, j], i < j, of pairing probabilities of each sequence, and ln of each partition function."""
    size, n = len(seqs), max(map(len, seqs), default=0)
    s = np.zeros((size, n), int)
    for b, seq in enumerate(seqs):
        s[b, : len(seq)] = [CODES.get(c, 0) for c in seq.upper()]
    before, after = np.pad(s, [(0, 0), (1, 0)])[:, :-1], np.pad(s, [(0, 0), (0, 1)])[:, 1:]
    hair, bulge, inner = _long(HAIRPIN, 3, n), _w(_long(BULGE, 1, MAX_LOOP)), _w(_long(INTERIOR, 2, MAX_LOOP))
    hair = _w(hair)
    close, stem = float(_w(MULTI_CLOSE)), float(_w(MULTI_STEM))
    tetra = {loop: float(_w(e)) for loop, e in TETRALOOPS.items()}
    kind = [PAIR[s[:, : n - d], s[:, d:]] if d > TURN else np.zeros((size, n - d), int) for d in range(n)]
    outer = [D5[t, before[:, : n - d]] * D3[t, after[:, d:]] * (t > 0) for d, t in enumerate(kind)]  # dangles outside a stem
    within = [D5[BACK[t], np.pad(s, [(0, 0), (1, 0)])[:, d : d + n - d]] * D3[BACK[t], after[:, : n - d]] * (t > 0) for d, t in enumerate(kind)]
    mm_out = [MM_I[t, after[:, : n - d], before[:, d:]] * (t > 0) for d, t in enumerate(kind)]
    mm_in = [MM_I[BACK[t], after[:, d:], before[:, : n - d]] * (t > 0) for d, t in enumerate(kind)]
    zero = lambda: [np.zeros((size, n - d)) for d in range(n)]
    qb, q1, qm = zero(), zero(), zero()

    def shapes(d: int):
        """Inner spans of loops closed by span d: start offset, inner span, and the weight by (outer kind, inner kind)."""
        for u1 in range(min(MAX_LOOP, d - TURN - 3) + 1):
            for u2 in range(min(MAX_LOOP - u1, d - TURN - 3 - u1) + 1):
                yield u1, u2, d - u1 - u2 - 2

    def weight(d: int, u1: int, u2: int, e: int, width: int):
        t, t2 = kind[d], kind[e][:, u1 + 1 : u1 + 1 + width]
        if u1 == u2 == 0:
            return STACK_W[t, BACK[t2]]
        if u1 == 0 or u2 == 0:
            return bulge[1] * STACK_W[t, BACK[t2]] if u1 + u2 == 1 else bulge[u1 + u2] * np.minimum(AU[t], AU[t2])
        if (u1, u2) in SMALL:
            base, each = SMALL[u1, u2]
            return float(_w(base)) * _w(each) ** ((t > 2).astype(int) + (t2 > 2))
        return inner[u1 + u2] * float(_w(min(MAX_NINIO, NINIO * abs(u1 - u2)))) * mm_out[d] * mm_in[e][:, u1 + 1 : u1 + 1 + width]

    for d in range(TURN + 1, n):
        width, t = n - d, kind[d]
        u = d - 1
        loop = hair[u] * (AU[t] if u == 3 else MM_H[t, after[:, :width], before[:, d:]])
        if u == 4:
            for b, seq in enumerate(seqs):
                own = seq.upper().replace("T", "U")
                for i in range(max(0, len(own) - 5)):
                    loop[b, i] *= tetra.get(own[i : i + 6], 1.0)
        total = loop
        for u1, u2, e in shapes(d):
            total = total + weight(d, u1, u2, e, width) * qb[e][:, u1 + 1 : u1 + 1 + width]
        multi = np.zeros((size, width))
        for k in range(TURN + 2, d - 2 - TURN):
            multi += qm[k - 1][:, 1 : 1 + width] * q1[d - 2 - k][:, 1 + k : 1 + k + width]
        qb[d] = (t > 0) * (total + close * stem * within[d] * multi)
        q1[d] = q1[d - 1][:, :width] + qb[d] * stem * outer[d]
        qm[d] = q1[d].copy()
        for k in range(1, d - TURN):
            qm[d] += (qm[k - 1][:, :width] + 1) * q1[d - k][:, k : k + width]
    left, right = np.ones((size, n + 1)), np.ones((size, n + 1))
    for j in range(n):
        left[:, j + 1] = left[:, j] + sum(left[:, j - d] * qb[d][:, j - d] * outer[d][:, j - d] for d in range(TURN + 1, j + 1))
    for i in range(n - 1, -1, -1):
        right[:, i] = right[:, i + 1] + sum(qb[d][:, i] * outer[d][:, i] * right[:, i + d + 1] for d in range(TURN + 1, n - i))
    ab, a1, am = zero(), zero(), zero()  # derivatives of the whole partition function
    p = np.zeros((size, n, n))
    z = left[:, n]
    for d in range(n - 1, TURN, -1):
        width = n - d
        ab[d] += left[:, :width] * right[:, d + 1 :] * outer[d]
        a1[d] += am[d]
        for k in range(1, d - TURN):
            am[k - 1][:, :width] += am[d] * q1[d - k][:, k : k + width]
            a1[d - k][:, k : k + width] += am[d] * (qm[k - 1][:, :width] + 1)
        a1[d - 1][:, :width] += a1[d]
        ab[d] += a1[d] * stem * outer[d]
        own = ab[d] * (kind[d] > 0)
        for u1, u2, e in shapes(d):
            ab[e][:, u1 + 1 : u1 + 1 + width] += own * weight(d, u1, u2, e, width)
        own = own * close * stem * within[d]
        for k in range(TURN + 2, d - 2 - TURN):
            am[k - 1][:, 1 : 1 + width] += own * q1[d - 2 - k][:, 1 + k : 1 + k + width]
            a1[d - 2 - k][:, 1 + k : 1 + k + width] += own * qm[k - 1][:, 1 : 1 + width]
        at = np.arange(width)
        p[:, at, at + d] = qb[d] * ab[d] / z[:, None]
    return p, np.log(z)


def tiles(seqs: DataFrame, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """Rows (seq_id, start, seq): windows of ``tile`` bases, each beginning ``tile - overlap`` after the one before.

    Tiles are dealt out one by one, so that a long sequence is folded by many tasks.
    """
    step = tile - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("seq") - tile) / step)).cast("int")
    own = seqs.where(F.length("seq") > 0).select("seq_id", F.col("seq").cast("binary").alias("seq"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    cut = own.select("seq_id", (F.col("k") * step).alias("start"), F.substring("seq", F.col("k") * step + 1, F.lit(tile)).cast("string").alias("seq"))
    return cut.repartition("seq_id", "start")


def _folded(frames: Iterator[pd.DataFrame], batch: int, give) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame = frame.iloc[frame["seq"].str.len().argsort()]
        for at in range(0, len(frame), batch):
            own = frame.iloc[at : at + batch]
            yield give(own, *pair_probabilities(own["seq"].tolist()))


def fold_pairs(seqs: DataFrame, least: float = 1e-6, batch: int = 16) -> DataFrame:
    """Rows (seq_id, start, i, j, p): pairs of probability ``least`` or more in each tile; positions are of the sequence."""

    def give(own: pd.DataFrame, p: np.ndarray, _: np.ndarray) -> pd.DataFrame:
        b, i, j = np.nonzero(p >= least)
        start = own["start"].to_numpy()[b]
        return pd.DataFrame({"seq_id": own["seq_id"].to_numpy()[b], "start": start, "i": i + start, "j": j + start, "p": p[b, i, j]})

    return tiles(seqs).mapInPandas(lambda f: _folded(f, batch, give), "seq_id long, start long, i long, j long, p double")


def ensemble_energy(seqs: DataFrame, batch: int = 16) -> DataFrame:
    """Rows (seq_id, start, energy): free energy of each tile's ensemble, in kcal/mol."""
    give = lambda own, p, z: pd.DataFrame({"seq_id": own["seq_id"], "start": own["start"], "energy": -KT / 100 * z})
    return tiles(seqs).mapInPandas(lambda f: _folded(f, batch, give), "seq_id long, start long, energy double")


def fold(seqs: DataFrame, batch: int = 16, blend: bool = False) -> DataFrame:
    """Rows (seq_id, ss): for every base the probability that it is paired.

    Where tiles overlap the earlier one counts, or with ``blend`` the mean of both.
    """

    def give(own: pd.DataFrame, p: np.ndarray, _: np.ndarray) -> pd.DataFrame:
        paired = np.clip(p.sum(axis=1) + p.sum(axis=2), 0, 1)
        values = [v[: len(s)].tolist() for v, s in zip(paired, own["seq"], strict=True)]
        return pd.DataFrame({"seq_id": own["seq_id"], "start": own["start"], "p": values})

    found = tiles(seqs).mapInPandas(lambda f: _folded(f, batch, give), "seq_id long, start long, p array<double>")
    whole = found.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("start", "p"))).alias("t"))
    empty = F.array().cast("array<double>")

    def join(a, x):
        shared = F.size(a) - x["start"].cast("int")
        fresh = F.slice(x["p"], shared + 1, F.greatest(F.size(x["p"]) - shared, F.lit(0)))
        if not blend:
            return F.concat(a, fresh)
        mixed = F.zip_with(F.slice(a, x["start"].cast("int") + 1, F.greatest(shared, F.lit(0))), F.slice(x["p"], F.lit(1), F.greatest(shared, F.lit(0))), lambda u, v: (u + v) / 2)
        return F.concat(F.slice(a, F.lit(1), x["start"].cast("int")), mixed, fresh)

    done = whole.select("seq_id", F.aggregate("t", empty, join).alias("ss"))
    return seqs.select("seq_id").join(done, "seq_id", "left").select("seq_id", F.coalesce("ss", empty).alias("ss"))


def structure_of(seqs: DataFrame, padding: int = PADDING, seed: int = 0) -> DataFrame:
    """Structure of ``seqs(seq_id, seq)`` that carry ``padding`` bases on either side, which are taken off again.

    N's are replaced by bases drawn from seed, sequence and position before folding.
    """
    own = seqs.select("seq_id", replace_n(F.col("seq"), F.col("seq_id"), seed).alias("seq"))
    return fold(own).select("seq_id", F.slice("ss", F.lit(padding + 1), F.greatest(F.size("ss") - 2 * padding, F.lit(0))).alias("ss"))


def brackets(pairs: DataFrame, seqs: DataFrame, cut: float = 0.667) -> DataFrame:
    """Rows (seq_id, summary): ( for bases mostly paired to the right, ) to the left, | either way, "," weakly paired, . unpaired."""
    ends = pairs.select("seq_id", F.explode(F.array(F.struct(F.col("i").alias("pos"), F.col("p").alias("up"), F.lit(0.0).alias("down")), F.struct(F.col("j").alias("pos"), F.lit(0.0).alias("up"), F.col("p").alias("down")))).alias("e"))
    sums = ends.groupBy("seq_id", "e.pos").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    mark = F.when(F.col("up") > cut, "(").when(F.col("down") > cut, ")").when(F.col("up") + F.col("down") > cut, "|").when(F.col("up") + F.col("down") > 1 - cut, ",").otherwise(".")
    marks = sums.groupBy("seq_id").agg(F.collect_list(F.struct("pos", mark.alias("value"))).alias("m"))
    return seqs.join(marks, "seq_id", "left").select("seq_id", F.array_join(filled(F.col("m"), F.length("seq"), F.lit(".")), "").alias("summary"))
