"""Operators that SQL cannot express, against brute force on small inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmotif.functions import prob, seq
from clipmotif.operators import checks, de, em, fold, intervals, kmers, reads, simulate
from clipmotif.plans import programs
from clipmotif.sources import readers, writers
from clipmotif.streaming import events as stream


def random_seqs(n, length, seed, letters="ACGT"):
    r = random.Random(seed)
    return [(i, "".join(r.choices(letters, k=length + r.randint(0, 9)))) for i in range(n)]


def test_suppression_walks_each_chain(spark):
    r = random.Random(1)
    peaks = [(i, r.choice("ab"), r.randrange(30_000)) for i in range(600)]
    got = {(x.chrom, x.rs) for x in intervals.suppress_neighbours(spark.createDataFrame(peaks, "rank long, chrom string, rs long"), 120, span=1000).collect()}
    want, last = set(), {}
    for c, s in sorted({(c, s) for _, c, s in peaks}):
        if c not in last or s - last[c] > 120:
            want.add((c, s))
            last[c] = s
    assert got == want


def test_overlap_join_in_bins_equals_the_plain_join(spark):
    r = random.Random(2)
    points = [(i, "c", s := r.randrange(5000), s + r.randrange(0, 40)) for i in range(300)]
    regions = [(i, "c", s := r.randrange(5000), s + r.randrange(0, 400)) for i in range(100)]
    got = sorted((x.p, x.rank) for x in intervals.overlap_join(spark.createDataFrame(points, "p long, chrom string, st long, en long"), spark.createDataFrame(regions, "rank long, chrom string, rs long, re long")).collect())
    assert got == sorted((p, k) for p, _, s, e in points for k, _, a, b in regions if e > s and b > a and b > s and a < e)


def brute_e_step(s, m, ss=None, de_=None):
    w = m.width
    def logp(b, row): return math.log(row["ACGT".index(b)])
    base = sum(logp(b, m.f) for b in s if b != "N")
    num = []
    for j in range(len(s) - w + 1):
        if "N" in s[j : j + w]:
            continue
        x = base + math.log(m.gamma)
        for k in range(w):
            x += logp(s[j + k], m.matrix[k]) - logp(s[j + k], m.f)
            if ss:
                x += ss[j + k] * math.log(m.paired[k] / 0.5) + (1 - ss[j + k]) * math.log((1 - m.paired[k]) / 0.5)
        if de_ is not None:
            x += de_[j][m.delta + 8]
        num.append((j, x))
    none = base + math.log(1 - m.gamma)
    top = max([none, *(x for _, x in num)])
    total = math.exp(none - top) + sum(math.exp(x - top) for _, x in num)
    return {j: math.exp(x - top) / total for j, x in num}


def test_e_step_matches_the_direct_sum(spark):
    r = random.Random(3)
    rows = [(i, s[:10] + "N" + s[11:], [r.random() for _ in s], [r.randrange(5) for _ in s]) for i, s in random_seqs(6, 40, 4)]
    m = em.replace(em.seed_model(0, "TGCA", 10, 6, True), paired=(0.2, 0.4, 0.6, 0.9), delta=-3)
    df = spark.createDataFrame(rows, "seq_id long, seq string, ss array<double>, counts array<long>").withColumn("d", de.normalise(F.col("counts"), 0.1))
    profiles = {x.seq_id: x.d for x in df.collect()}
    cubes: dict = {}
    for x in de.cube(df.select("seq_id", "d"), 4).collect():
        cubes.setdefault(x.seq_id, {})[x.site] = x.de
    for i, s, _, _ in rows:
        d = profiles[i]
        assert abs(sum(d) - 1) < 1e-9
        for j in (0, 5, len(s) - 4):
            want = [math.log(sum((dk * 0) + math.exp(math.log(dk) + 1.1 * math.log(0.135) + 1.1 * abs(k - j - delta) * math.log(1 - 0.135)) for k, dk in enumerate(d))) for delta in range(-8, 9)]
            assert np.allclose(cubes[i][j], want)
    for parts in (("seq",), ("seq", "ss"), ("seq", "d"), ("seq", "ss", "d")):
        own = df.select("seq_id", *parts)
        model = m if "ss" in parts else em.replace(m, paired=())
        got: dict = {}
        for x in em.e_step(em.site_rows(own, 4), [model]).collect():
            got.setdefault(x.seq_id, {})[x.pos] = (x.z, x.q)
        for i, s, ss, _ in rows:
            want = brute_e_step(s, model, ss if "ss" in parts else None, cubes[i] if "d" in parts else None)
            assert {j: pytest.approx(z, rel=1e-9, abs=1e-12) for j, z in want.items()} == {j: z for j, (z, _) in got[i].items()}
            assert all(abs(q - sum(want.values())) < 1e-9 for _, q in got[i].values())
    collapsed = em.occupancy(em.e_step(em.site_facts(df.select("seq_id", "seq"), 4), [em.replace(m, paired=())])).collect()
    assert all(abs(x.q - sum(brute_e_step(rows[x.seq_id][1], em.replace(m, paired=())).values())) < 1e-9 for x in collapsed)


def test_likelihood_never_falls_much_and_starts_are_independent(spark):
    df = spark.createDataFrame(random_seqs(40, 60, 5), "seq_id long, seq string")
    facts, counts = em.site_facts(df, 5), em.base_counts(df)
    models = [em.seed_model(i, k, 40, 20) for i, k in enumerate(("ACGTA", "TTGCA"))]
    together = em.fit(facts, counts, models, rounds=3)
    for m in models:
        (alone,) = em.fit(facts, counts, [m], rounds=3)
        assert np.allclose(alone.matrix, together[m.start].matrix) and alone.ll == pytest.approx(together[m.start].ll)


def test_newton_derivatives(spark):
    r = random.Random(6)
    ds = [np.array([r.random() for _ in range(n)]) for n in (30, 9)]
    z = [r.random() for _ in range(25)]
    rows = [(0, ds[0].tolist(), list(range(25)), z), (1, ds[1].tolist(), [0, 3], [0.5, 0.25]), (0, ds[1].tolist(), [2], [0.125])]
    frame = spark.createDataFrame(rows, "at int, d array<double>, pos array<int>, z array<double>").repartition(3)

    def value(at, delta, p, weight=1.0):
        return sum(w * (weight * math.log(p) + math.log(sum(x * (1 - p) ** (weight * abs(k - j - delta)) for k, x in enumerate(d)))) for a, d, pos, zs in rows if a == at for j, w in zip(pos, zs, strict=True))

    asked = [(0, 2, 0.3), (0, -8, 0.3), (0, 8, 0.05), (1, 0, 0.135)]
    got = {(x.at, x.delta): x for x in de.event_sums(frame, asked).collect()}
    e = 1e-4
    for at, delta, p in asked:
        x = got[at, delta]
        assert x.v == pytest.approx(value(at, delta, p))
        assert x.g == pytest.approx((value(at, delta, p + e) - value(at, delta, p - e)) / (2 * e), rel=1e-5)
        assert x.h == pytest.approx((value(at, delta, p + e) - 2 * value(at, delta, p) + value(at, delta, p - e)) / e**2, rel=1e-3)
    assert [x.v for x in de.event_sums(frame, [(1, -3, 0.2)], 1.1).collect()] == [pytest.approx(value(1, -3, 0.2, 1.1))]

    def newton(at, delta, p):
        for _ in range(10):
            g, h = (value(at, delta, p + e) - value(at, delta, p - e)) / (2 * e), (value(at, delta, p + e) - 2 * value(at, delta, p) + value(at, delta, p - e)) / e**2
            old, p = p, min(max(p - g / h, 0.01), 0.99)
            if abs(p - old) <= 1e-3:
                break
        return p

    fitted = de.fit_geometry(frame, [0.5, 0.5], [list(de.DELTAS), [1]])
    best = max(de.DELTAS, key=lambda d: (value(0, d, newton(0, d, 0.5)), -d))
    assert fitted[0] == (pytest.approx(newton(0, best, 0.5), abs=1e-4), best) and fitted[1] == (pytest.approx(newton(1, 1, 0.5), abs=1e-4), 1)


def test_smoothing_by_transform_equals_the_plain_sum():
    d = np.random.default_rng(1).random(3000)
    for ratio, power in ((0.99, 0), (0.995, 2), (0.9, 1)):
        t = np.abs(np.arange(3000)[None, :] - np.arange(-8, 3008)[:, None]).astype(float)
        want = ((t * (t - 1) if power == 2 else t if power else 1) * ratio ** np.maximum(t - power, 0) * (t >= power)) @ d
        assert np.allclose(de.smoothed(d, ratio, power), want, rtol=1e-8)


def test_geometry_is_fitted_in_every_round(spark):
    """All rounds of EM with live p and delta, against plain Python."""
    r = random.Random(16)
    rows = [(i, s, [r.randrange(4) for _ in s]) for i, s in random_seqs(12, 18, 17)]
    df = spark.createDataFrame(rows, "seq_id long, seq string, counts array<long>").withColumn("d", de.normalise(F.col("counts"))).drop("counts")
    profiles = {x.seq_id: list(x.d) for x in df.collect()}
    models = [em.seed_model(i, k, 12, 6, p=0.5) for i, k in enumerate(("ACGT", "TTGC"))]
    got = em.fit(None, em.base_counts(df), models, rounds=3, live=df)
    term = lambda d, c, p, w: w * math.log(p) + math.log(sum(x * (1 - p) ** (w * abs(k - c)) for k, x in enumerate(d)))
    whole = {b: sum(s.count(b) for _, s, _ in rows) for b in "ACGT"} | {"n": 12}
    for m, g in zip(models, got, strict=True):
        for _ in range(3):
            z = {}
            for i, s, _ in rows:
                cube = [[term(profiles[i], j + delta, m.p, 1.1) for delta in de.DELTAS] for j in range(len(s) - 3)]
                z[i] = brute_e_step(s, m, None, cube)
            row = {f"fg_{k}_{b}": sum(w for i, s, _ in rows for j, w in z[i].items() if s[j + k] == "ACGT"[b]) for k in range(4) for b in range(4)}
            q = {i: sum(z[i].values()) for i in z}
            row |= {"q": sum(q.values())} | {f"q_{b}": sum(q[i] * s.count(b) for i, s, _ in rows) for b in "ACGT"}
            new = em.m_step(m, row, whole, False)
            sites = spark.createDataFrame([(0, profiles[i], list(z[i]), list(z[i].values())) for i in z], "at int, d array<double>, pos array<int>, z array<double>")
            ((p, delta),) = de.fit_geometry(sites, [m.p], [list(de.DELTAS)])
            new = em.replace(new, p=p, delta=delta)
            row |= {f"de_{k}": 0.0 for k in range(17)} | {f"de_{delta + 8}": sum(w * term(profiles[i], j + delta, p, 1.1) for i in z for j, w in z[i].items())}
            m = em.replace(new, ll=em.log_likelihood(new, row, whole))
        assert (g.p, g.delta, g.ll, g.gamma) == (pytest.approx(m.p), m.delta, pytest.approx(m.ll), pytest.approx(m.gamma)) and np.allclose(g.matrix, m.matrix)
    found = programs.discover_motifs(df.select("seq_id", "seq"), 4, motifs=2, starts=2, counts=spark.createDataFrame([(i, c) for i, _, c in rows], "seq_id long, counts array<long>"), fit_geometry=True, rounds=2)
    assert len(found) == 2 and all(0.01 <= x.model.p <= 0.99 and x.model.p != 0.5 for x in found)


def all_structures(s):
    """Every secondary structure of s as a set of pairs, hairpins of three bases or more."""
    allowed = {("C", "G"), ("G", "C"), ("A", "U"), ("U", "A")}

    def within(i, j):
        if j - i < 4:
            return [()]
        out = list(within(i + 1, j))
        for k in range(i + 4, j + 1):
            if (s[i], s[k]) in allowed:
                out += [((i, k), *a, *b) for a in within(i + 1, k - 1) for b in within(k + 1, j)]
        return out

    return within(0, len(s) - 1)


def weight_of(s, pairs):
    """Boltzmann weight of one structure, loop by loop."""
    code = [fold.CODES[c] for c in s]
    n, kind = len(s), {}
    for i, j in pairs:
        kind[i, j] = fold.PAIR[code[i], code[j]]

    def dangles(t, five, three):
        return fold.D5[t, code[five] if 0 <= five < n else 0] * fold.D3[t, code[three] if 0 <= three < n else 0]

    def children(i, j):
        return [p for p in pairs if i < p[0] and p[1] < j and not any(i < q[0] < p[0] and p[1] < q[1] < j for q in pairs)]

    w = 1.0
    for i, j in children(-1, n):
        w *= dangles(kind[i, j], i - 1, j + 1)
    tetra = fold.TETRALOOPS
    for (i, j), t in kind.items():
        inner = children(i, j)
        if not inner:
            u = j - i - 1
            w *= float(fold._w(fold.HAIRPIN[u - 3])) * (fold.AU[t] if u == 3 else fold.MM_H[t, code[i + 1], code[j - 1]])
            if u == 4 and s[i : j + 1] in tetra:
                w *= float(fold._w(tetra[s[i : j + 1]]))
        elif len(inner) == 1:
            (k, m), = inner
            t2, u1, u2 = kind[k, m], k - i - 1, j - m - 1
            if u1 == u2 == 0:
                w *= fold.STACK_W[t, fold.BACK[t2]]
            elif u1 == 0 or u2 == 0:
                w *= float(fold._w(fold.BULGE[u1 + u2 - 1])) * (fold.STACK_W[t, fold.BACK[t2]] if u1 + u2 == 1 else min(fold.AU[t], fold.AU[t2]))
            elif (u1, u2) in fold.SMALL:
                base, each = fold.SMALL[u1, u2]
                w *= float(fold._w(base + each * (int(t > 2) + int(t2 > 2))))
            else:
                w *= float(fold._w(fold.INTERIOR[u1 + u2 - 2] + min(300, 50 * abs(u1 - u2)))) * fold.MM_I[t, code[i + 1], code[j - 1]] * fold.MM_I[fold.BACK[t2], code[m + 1], code[k - 1]]
        else:
            w *= float(fold._w(fold.MULTI_CLOSE + fold.MULTI_STEM * (len(inner) + 1))) * dangles(fold.BACK[t], j - 1, i + 1)
            for k, m in inner:
                w *= dangles(kind[k, m], k - 1, m + 1)
    return w


def test_partition_function_equals_enumeration():
    r = random.Random(7)
    seqs = ["GGGGAAAACCCC", "GGCGAAAAGCGAAAAGCCC", "GCAAAAGCGCAAAAGC", *("".join(r.choices("ACGU", k=15)) for _ in range(4)), "AAAAAAAA", "GAGCAAAAGCAGCAAAAGCAC"]
    p, log_z = fold.pair_probabilities(seqs)
    for b, s in enumerate(seqs):
        found = [(pairs, weight_of(s, pairs)) for pairs in all_structures(s)]
        z = sum(w for _, w in found)
        assert log_z[b] == pytest.approx(math.log(z), rel=1e-9, abs=1e-12)
        want = np.zeros((len(s), len(s)))
        for pairs, w in found:
            for i, j in pairs:
                want[i, j] += w / z
        assert np.allclose(p[b, : len(s), : len(s)], want, atol=1e-9)


def test_folding_in_tiles(spark):
    rows = [(i, "".join(random.Random(i).choices("ACGT", k=n))) for i, n in enumerate((0, 4, 250, 251, 450))]
    got = {x.seq_id: x.ss for x in fold.fold(spark.createDataFrame(rows, "seq_id long, seq string")).collect()}
    assert {k: len(v) for k, v in got.items()} == {i: len(s) for i, s in rows}
    assert all(0 <= x <= 1 for v in got.values() for x in v)
    first, _ = fold.pair_probabilities([rows[4][1][:250]])
    assert np.allclose(got[4][:250], np.clip(first[0].sum(0) + first[0].sum(1), 0, 1))
    short = fold.structure_of(spark.createDataFrame([(1, "N" * 20 + "GGGGAAAACCCC" + "N" * 20)], "seq_id long, seq string")).first()
    assert len(short.ss) == 12
    marks = fold.brackets(fold.fold_pairs(spark.createDataFrame([(1, "GGGGGAAAACCCCC")], "seq_id long, seq string")), spark.createDataFrame([(1, "GGGGGAAAACCCCC")], "seq_id long, seq string")).first()
    assert marks.summary.count("(") == marks.summary.count(")") > 2 and marks.summary[5:9] == "...."


def test_planted_motif_is_found(spark):
    matrix = [[0.97 if b == c else 0.01 for b in "ACGT"] for c in "TGCATG"]
    seqs, counts, (truth,) = simulate.simulate(simulate.random_sequences(spark, 150, 60, 1), [simulate.Plant(matrix, 0.9, events=4, delta=2)], 2)
    (motif,) = programs.discover_motifs(seqs.select("seq_id", "seq"), 6, motifs=1, starts=3, counts=counts)
    word = "".join("ACGT"[max(range(4), key=lambda b: row[b])] for row in motif.model.matrix)
    assert word == "TGCATG"
    found = motif.sites.join(truth.select("seq_id", F.col("site").alias("planted")), "seq_id").where("planted IS NOT NULL").agg(F.avg((F.col("site") == F.col("planted")).cast("int"))).first()[0]
    assert found > 0.7
    named = motif.sites.join(seqs, "seq_id")
    lines = [x.line for x in writers.motif_record(named, motif.model, "M1", events=True).orderBy("part", "seq_id").collect()]
    assert lines[0] == "AC\tM1" and lines[-1] == "//" and sum(x.startswith("BS\t") for x in lines) > 100
    assert writers.motif_record(named.withColumn("q", F.lit(0.1)), motif.model, "M1").count() == 0
    assert simulate.truth_lines(truth, simulate.Plant(matrix), "T").count() > 100


def test_discovery_matches_plain_python(spark):
    """Seeds, rounds, the choice among starts, masking and the order of motifs, all by direct sums."""
    r = random.Random(27)
    rows = [(i, s[:12] + r.choice(["GATTAC", "GATTAC", "GATTAA", "CCGGTT"]) + s[12:]) for i, s in random_seqs(25, 30, 28)] + [(90, "ACG")]
    found = programs.discover_motifs(spark.createDataFrame(rows, "seq_id long, seq string"), 6, motifs=2, starts=3, rounds=4)
    own = dict(rows[:-1])
    count = lambda seqs: {b: float(sum(s.count(b) for s in seqs.values())) for b in "ACGT"} | {"n": float(len(seqs))}
    masked, original, want = dict(own), count(own), []
    for number in range(2):
        letters = sum(map(len, masked.values()))
        share = {b: sum(s.count(b) for s in masked.values()) / letters for b in "ACGT"}
        seen: dict = {}
        for i, s in masked.items():
            for j in range(len(s) - 5):
                if "N" not in s[j : j + 6]:
                    seen.setdefault(s[j : j + 6], set()).add(i)
        score = {k: len(v) / sum(1 - math.exp(-len(s) * math.prod(share[b] for b in k)) for s in masked.values()) for k, v in seen.items()}
        seeds = sorted(score, key=lambda k: (-score[k], k))[:3]
        whole, best = count(masked), None
        for start, kmer in enumerate(seeds):
            m = em.seed_model(start, kmer, len(own), len(seen[kmer]))
            for _ in range(4):
                z = {i: brute_e_step(s, m) for i, s in masked.items()}
                q = {i: sum(v.values()) for i, v in z.items()}
                row = {f"fg_{k}_{b}": sum(w for i, s in masked.items() for j, w in z[i].items() if s[j + k] == "ACGT"[b]) for k in range(6) for b in range(4)}
                row |= {"q": sum(q.values())} | {f"q_{b}": sum(q[i] * s.count(b) for i, s in masked.items()) for b in "ACGT"}
                before, m = m, em.m_step(m, row, whole)
            ll = em.log_likelihood(m, row, original)
            if best is None or ll > best[0]:
                best = (ll, m, before)
        ll, m, before = best
        want.append((ll, number, m))
        for i, s in masked.items():
            z = brute_e_step(s, before)
            if sum(z.values()) >= 0.8:
                j = max(z, key=lambda j: (z[j], -j))  # noqa: B023
                masked[i] = s[:j] + "NNNNNN" + s[j + 6 :]
    want.sort(key=lambda x: (-x[0], x[1]))
    assert [(m.number, m.model.kmer) for m in found] == [(n, m.kmer) for _, n, m in want]
    for got, (ll, _, m) in zip(found, want, strict=True):
        assert got.model.ll == pytest.approx(ll) and np.allclose(got.model.matrix, m.matrix) and got.model.gamma == pytest.approx(m.gamma)


def test_structure_mode_runs_and_masks(spark):
    df = spark.createDataFrame(random_seqs(30, 40, 8), "seq_id long, seq string")
    ss = df.select("seq_id", F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: (i % 7) / 10).alias("ss"))
    found = programs.discover_motifs(df, 4, motifs=2, starts=2, structure=ss, rounds=3)
    assert len(found) == 2 and found[0].model.ll >= found[1].model.ll and len(found[0].model.paired) == 4
    with pytest.raises(ValueError):
        programs.discover_motifs(df, 4, structure=ss.withColumn("ss", F.slice("ss", 1, 3)))
    for bad in ({"width": 3}, {"epsilon": 2.0}, {"delta": 9}):
        with pytest.raises(ValueError):
            checks.require_parameters(**bad)


def test_simulated_structures(spark):
    base = simulate.random_sequences(spark, 200, 80, 3)
    matrix = [[0.25] * 4] * 6
    for kind in ("stem", "dsRNA"):
        made = simulate.place(base, simulate.Plant(matrix, 1.0, kind), 5).collect()
        arm, at = (10, 3) if kind == "stem" else (6, 0)
        for x in made:
            assert x.structured
            first = x.site - at
            left, right = x.seq[first : first + arm], x.seq[first + arm + 15 : first + 2 * arm + 15]
            assert right == left[::-1].translate(str.maketrans("ACGT", "TGCA"))
    with pytest.raises(ValueError):
        simulate.place(base, simulate.Plant(matrix, structure="knot"), 1)
    assert abs(simulate.relative_information(simulate.draw_pwm(spark, 6, 1.2, 1)) - 1.2) <= 0.005


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACGT\nacgn\n>s2\nTTTT\n")
    got = [(x.seq_id, x.name, x.seq, x.len) for x in readers.load_sequences(spark, str(tmp_path / "a.fa"), padding=2).orderBy("seq_id").collect()]
    assert got == [(0, "s1 first", "NNACGTACGNNN", 12), (1, "s2", "NNTTTTNN", 8)]
    folder = tmp_path / "chroms"
    folder.mkdir()
    letters = "".join(random.Random(9).choices("ACGT", k=130))
    (folder / "c1.fa").write_text(">c1\n" + "\n".join(letters[i : i + 50] for i in range(0, 130, 50)) + "\n")
    (folder / "c2.fa").write_text(">c2\nAACCGGTT\n")
    (tmp_path / "r.bed").write_text("track x\n#c\nc2\t1\t5\tb\t1\t-\nc1\t45\t105\ta\t2\t+\n")
    chroms = readers.read_chromosomes(spark, str(folder))
    assert readers.short_lines(chroms).count() == 0
    got = [(x.name, x.seq) for x in readers.load_sequences(spark, str(tmp_path / "r.bed"), str(folder)).orderBy("seq_id").collect()]
    assert got == [("a", letters[45:105]), ("b", "CGGT")]
    assert [x.name for x in readers.read_bed(spark, str(tmp_path / "r.bed"), rename=True).orderBy("rank").collect()] == ["sequence_1", "sequence_2"]
    for bad in (lambda: readers.load_sequences(spark, str(tmp_path / "r.bed")), lambda: readers.load_sequences(spark, str(tmp_path / "a.fa"), str(folder))):
        with pytest.raises(ValueError):
            bad()
    lost = readers.parse_bed(spark.createDataFrame([(0, "c9\t1\t5\tx\t1\t+")], "rank long, line string"))
    with pytest.raises(Exception, match="c9"):
        readers.extract_regions(lost, chroms).collect()
    (tmp_path / "s.txt").write_text("0.1,0.9,0.5,\n1,0,\n")
    assert [x.ss for x in readers.read_structure(spark, str(tmp_path / "s.txt")).orderBy("seq_id").collect()] == [[0.1, 0.9, 0.5], [1.0, 0.0]]
    (tmp_path / "d.txt").write_text("0, 2, 1\n\n3\n")
    assert [x.counts for x in readers.read_counts(spark, str(tmp_path / "d.txt")).orderBy("seq_id").collect()] == [[0, 2, 1], [3]]
    for parse, line in ((readers.parse_structure, "0.5,1.2"), (readers.parse_counts, "1,-2")):
        with pytest.raises(Exception, match="file"):
            parse(spark.createDataFrame([(0, line)], "seq_id long, line string")).collect()
    with pytest.raises(Exception, match="padding"):
        writers.structure_lines(spark.createDataFrame([(0, [0.1])], "seq_id long, ss array<double>"), 2).collect()
    lines = writers.count_lines(spark.createDataFrame([(1, [0, 2]), (0, [1])], "rank long, counts array<long>"))
    writers.write_lines(lines, str(tmp_path / "out"), ["rank"])
    assert [x.value for x in spark.read.text(str(tmp_path / "out")).collect()] == ["1", "0, 2"]


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    """Larger files come first in Spark's own order, and large ones are split."""
    folder = tmp_path / "parts"
    folder.mkdir()
    want = []
    for k, n in enumerate((3, 4000, 1, 900)):
        own = [f"{k} {i} " + "x" * 30 for i in range(n)]
        (folder / f"part-{k}").write_text("\n".join(own) + "\n")
        want += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.numbered(readers.text_lines(spark, str(folder))).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x.line for x in got] == want and [x["rank"] for x in got] == list(range(len(want)))
    assert [x["rank"] for x in readers.numbered(spark.range(10).repartition(1).select("id")).collect()] == list(range(10))


def test_reads_of_unknown_kind_raise(spark):
    df = spark.createDataFrame([("x",)], "line string")
    for bad in (lambda: reads.parse_reads(df, "other"), lambda: reads.events(df, "xCLIP"), lambda: reads.events(df, "hCLIP", "rmap")):
        with pytest.raises(ValueError):
            bad()


def test_random_bases_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "ANNNGn") for i in range(200)], "seq_id long, seq string")
    draw = lambda d: sorted((x.seq_id, x.s) for x in d.select("seq_id", seq.replace_n(F.col("seq"), F.col("seq_id"), 3).alias("s")).collect())
    got = draw(df)
    assert got == draw(df.repartition(7)) and not any("N" in s.upper() for _, s in got)
    share = sum(s[1] == "C" for _, s in got) / 200
    assert 0.1 < share < 0.4
    assert kmers.observed(df, 3).count() == 0


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    lines = [f"c\t{10 + i % 20}\t{30 + i % 20}\tr{i}\t0\t{'+-'[i % 2]}" for i in range(50)]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(lines[:25]) + "\n")
    (source / "b.txt").write_text("\n".join(lines[25:]) + "\n")
    regions = spark.createDataFrame([(0, "c", 12, 20, "+"), (1, "c", 18, 25, "-")], "rank long, chrom string, rs long, re long, strand string")
    reading = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)).withColumnRenamed("value", "line")
    state: dict = {}
    sink = lambda df, _: state.update({(x.rank, x.pos): x.n for x in df.collect()})
    query = stream.write_counts(stream.stream_counts(reading, regions), sink, str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = intervals.pile_up(reads.events(reads.parse_reads(spark.createDataFrame([(x,) for x in lines], "line string"), "rmap"), "iCLIP", "rmap"), regions, mirror=False)
    assert state == {(x.rank, x.pos): x.n for x in batch.collect()} and state


def test_arrays_are_filled_and_odd_sequences_planted(spark):
    rows = [(1, [(2, 5), (0, 7)], 4), (2, None, 3), (3, [(0, 1)], 1), (4, None, 0), (5, [], 2)]
    df = spark.createDataFrame(rows, "seq_id long, found array<struct<pos: long, value: long>>, n int")
    got = {x.seq_id: x.c for x in df.select("seq_id", prob.filled(F.col("found"), F.col("n"), F.lit(0).cast("long")).alias("c")).collect()}
    assert got == {1: [7, 0, 5, 0], 2: [0, 0, 0], 3: [1], 4: [], 5: [0, 0]}
    odd = spark.createDataFrame([(1, "a", ""), (2, "b", "ACG"), (3, "c", "ACGTACGTAC")], "seq_id long, name string, seq string")
    made, counts, (truth,) = simulate.simulate(odd, [simulate.Plant([[0.25] * 4] * 6, 1.0, "stem", events=3)], 4)
    assert {x.seq_id: len(x.seq) for x in made.collect()} == {1: 0, 2: 3, 3: 10}
    assert {x.seq_id: (len(x.counts), sum(x.counts)) for x in counts.collect()} == {1: (0, 0), 2: (3, 3), 3: (10, 3)}
    assert {x.seq_id: (x.site is None, x.structured) for x in truth.collect()} == {1: (True, False), 2: (True, False), 3: (False, False)}
    with pytest.raises(ValueError):
        simulate.draw_pwm(spark, 6, 5.0, 1, batch=64, batches=2)
