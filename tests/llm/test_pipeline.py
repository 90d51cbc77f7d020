"""The pipeline on a small corpus against a plain Python version of its five stages."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipmotif.llm import classifier, decontaminate, lines, queries, simhash
from clipmotif.llm.common import shared_folder


def corpus(r):
    word = lambda: "".join(r.choices("aeinorstlmd", k=r.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    bench = [(i, line(20)) for i in range(3)]
    shared = [line(12) for _ in range(3)]
    docs, labels = [], []
    for i in range(150):
        text = "\n".join(line(r.randint(8, 20)) for _ in range(3))
        good = i % 6 != 0
        if not good:
            text = " ".join(w + "###" for w in text.split())
        elif i % 7 == 1:
            text += "\n" + r.choice(shared).replace("a", "ä", r.randint(0, 2))
        elif i % 11 == 2:
            text += "\n" + r.choice(bench)[1].upper()
        elif i % 13 == 3 and docs:
            text = docs[r.randrange(len(docs))][1] + " " + word()
        docs.append((i, text, r.choice(["en", "de"]), f"src{r.randrange(5)}", len(text)))
        if i % 2 == 0 or i < 40:
            labels.append((i, int(good), 0))
    return docs, labels, bench


def drop_lines(docs):
    first: dict = {}
    for d, text, *_ in docs:
        for k, x in enumerate(text.split("\n")):
            if len(x.strip(" ")) >= lines.MIN_CHARS:
                first.setdefault(x.strip(" "), (d, k))
    out = []
    for d, text, lang, source, n in docs:
        kept = []
        for k, x in enumerate(text.split("\n")):
            own = x.strip(" ")
            gone = own in first and (first[own] != (d, k) or any(first[y] < first[own] and lines.near(y, own) for y in first if y != own))
            if not gone:
                kept.append(x)
        new = "\n".join(kept)
        out.append((d, new, lang, source, n if new == text else len(new)))
    return out


def keep_one(docs):
    fps = {d: simhash.fingerprint(t) for d, t, *_ in docs}
    root = {d: d for d in fps}
    for _ in range(len(fps)):
        before = dict(root)
        for a in fps:
            root[a] = min(root[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3)
        if before == root:
            break
    return [x for x in docs if root[x[0]] == x[0]]


def fill(budget, nodes):
    """Split a budget among nodes {name: (capacity, weight)}, each full one giving its rest to the others."""
    out, left = {}, {k: v for k, v in nodes.items() if v[0] > 0 and v[1] > 0}
    while left:
        total = sum(w for _, w in left.values())
        full = {k: c for k, (c, w) in left.items() if c * total <= budget * w}
        if not full:
            return out | {k: budget * w // total for k, (_, w) in left.items()}
        out |= full
        budget -= sum(full.values())
        left = {k: v for k, v in left.items() if k not in full}
    return out


def mix(docs):
    rows = [(f"d{int(s[3:]) % 4}", lang, s, d, len(t.split())) for d, t, lang, s, _ in docs]
    rows = [x for x in rows if x[4]]
    weight = lambda level, k: queries.WEIGHTS[level].get(k, queries.WEIGHTS[level]["*"])
    cap = lambda *p: sum(x[4] * queries.MIX_EPOCHS for x in rows if x[: len(p)] == p)
    total = min(int(sum(x[4] for x in rows) * queries.MIX_RATIO), cap())
    plan = {}
    for a, b1 in fill(total, {a: (cap(a), weight("domain", a)) for a in {x[0] for x in rows}}).items():
        for b, b2 in fill(b1, {b: (cap(a, b), weight("lang", b)) for b in {x[1] for x in rows if x[0] == a}}).items():
            for c, b3 in fill(b2, {c: (cap(a, b, c), weight("source", c)) for c in {x[2] for x in rows if x[:2] == (a, b)}}).items():
                plan[a, b, c] = b3
    out = {}
    for leaf, budget in plan.items():
        own = [x for x in rows if x[:3] == leaf]
        whole, rest = divmod(budget, sum(x[4] for x in own))
        upto = 0
        for x in sorted(own, key=lambda x: hashlib.md5(f"{queries.MIX_SEED}:{whole}:{x[3]}".encode()).hexdigest()):
            upto += x[4]
            copies = whole + (upto <= rest)
            if copies:
                out[x[3]] = (leaf[0], x[4], copies)
    return out


def test_pipeline(spark, tmp_path):
    docs, labels, bench = corpus(random.Random(5))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    texts = {d: t for d, t, *_ in docs}
    train = [(d, q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 5]
    model = classifier.AdditiveModel.fit(np.array([classifier.features(texts[d]) for d, _ in train]), np.array([q for _, q in train], float))
    score = model.score(np.array([classifier.features(x[1]) for x in docs]))
    kept = [x for x, s in zip(docs, score, strict=True) if s >= classifier.THRESHOLD]
    assert {x[0] for x in kept} == {d for d in texts if d % 6}
    kept = keep_one(drop_lines(kept))
    index = decontaminate.Index(bench)
    leaks = {d for d, *_ in kept if index.search([dict((x[0], x[1]) for x in kept)[d]])[0]}
    assert leaks
    kept = [x for x in kept if x[0] not in leaks]
    want = mix(kept)
    assert {d: (x.domain, x.n_tokens, x.copies) for d, x in got.items()} == want
    assert {d: (x.text, x.n_chars) for d, x in got.items()} == {x[0]: (x[1], x[4]) for x in kept if x[0] in want}


def test_odd_rows_pass_the_pipeline(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, blank texts, further columns with names that stages use; empty tables."""
    docs, labels, bench = corpus(random.Random(8))
    odd = [*docs, (None, docs[1][1] + " more", None, None, None), (700, None, "en", "src1", None), (701, "", None, "src1", 0), (702, " \n\t", "en", None, 3), docs[2], (3, docs[4][1], "de", "src0", 1)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("mark", "key", "id", "removed", "gone", "copies", "a.b")
    for name in names:
        df = df.withColumn(name, F.lit("mine"))
    for at, rows in (("full", df), ("empty", df.limit(0))):
        rows.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        spark.createDataFrame([*labels, (None, 1, 0), (700, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{at}/labels.parquet")
        spark.createDataFrame([*bench, (None, None), (9, "")], "item_id long, text string").write.parquet(f"{tmp_path}/{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{at}")
        assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", *names, "domain", "n_tokens"}
        found = got.collect()
        assert bool(found) == (at == "full")
        assert all(x["a.b"] == "mine" and x["copies"] in (1, 2) and x["text"].split() for x in found)
        assert all(x["n_tokens"] == len(x["text"].split()) for x in found)


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    docs, labels, bench = corpus(random.Random(9))
    for name, rows, kind in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    want = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    seen = []

    def watched(name, f, broken):
        def stage(*args):
            seen.append(name)
            if broken:
                raise RuntimeError("lost")
            return f(*args)

        return name, stage

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(n, f, k == 2) for k, (n, f) in enumerate(stages)])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/between")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(n, f, False) for n, f in stages])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/between").collect())) == want
    assert seen == [n for n, _ in stages[:3]] + [n for n, _ in stages[2:]]
    assert sorted(x.name for x in (tmp_path / "between").iterdir()) == ["3-decontamination"]
    # other inputs are not taken for the same
    spark.createDataFrame(docs[: len(docs) // 2], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    seen.clear()
    half = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/between").collect()))
    assert seen == [n for n, _ in stages] and half != want


def test_a_run_leaves_no_tables(spark, tmp_path):
    docs, labels, bench = corpus(random.Random(9))
    for name, rows, kind in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    folder = shared_folder(spark).removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("pipeline-")]
    assert got.count()
