"""The operators on small tables: brute force, nulls, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from clipmotif.llm import classifier, components, decontaminate, html, lines, mixing, queries, rules, secrets, simhash, spans, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "gone string, id string, key string, kept string, tokens string, copies string, domain string, score string, mark string, `a.b` string"


def make(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def words(r, n):
    return " ".join("".join(r.choices("abcdefghijklm", k=r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, blank and long texts, repeated rows, columns with clashing names."""
    r = random.Random(1)
    long = "\n".join(words(r, 30) + ". " + words(r, 25) + "." for _ in range(400))
    rows = [(1, None, None, None, None), (None, "only a text here", "en", "src1", 4), (2, "", "en", "src1", 0), (3, " \n\t ", "en", None, 4), (4, long, "de", "src0", len(long))]
    rows += [(5, "same text twice in this table", "en", "src1", 3)] * 2 + [(6, long, "de", "src0", 7), (7, "x", None, "src2", 1)]
    df = make(spark, rows)
    for name in ("gone", "id", "key", "kept", "tokens", "copies", "domain", "score", "mark", "a.b"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def test_odd_rows_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same text twice in this table"), (3, "unrelated words stand here for nothing")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    empty = odd.limit(0)
    n = odd.count()
    for docs, size in ((odd, n), (empty, 0)):
        model = classifier.train(docs, labels)
        assert spans.drop_repeats(docs).count() == size
        assert secrets.scan_secrets(docs).count() == size
        assert rules.quality_rules(docs).count() == size
        assert simhash.near_duplicates(docs).count() == size
        assert classifier.score_quality(docs, model).where("score BETWEEN 0 AND 1").count() == size
        assert {r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()} == ({5} if size else set())
        for kept in (classifier.keep_good(docs, model), simhash.keep_one(docs), decontaminate.drop_leaks(docs, bench), lines.drop_lines(docs)):
            assert kept.columns == docs.columns
            assert kept.count() <= size
        assert mixing.mix(docs, queries.domain(), queries.WEIGHTS, 1.0).count() <= size
        assert lines.line_decisions(docs).count() == (len({(1, ""), (None, "t"), (2, ""), (3, " "), (4, "l"), (5, "s"), (6, "l"), (7, "x")}) if size else 0)
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, bench.limit(0)).count() == n


def test_odd_rows_have_the_values_stated(spark, odd):
    by_id = lambda df: {x.doc_id: x for x in df.where("doc_id IS NOT NULL").collect()}
    model = classifier.train(odd, spark.createDataFrame([(4, 1, 0), (5, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int"))
    scores = [(x.doc_id, x.score) for x in classifier.score_quality(odd, model).collect()]
    of = dict(scores)
    assert of[1] == of[2] == of[3] and len({x for d, x in scores if d == 5}) == 1 and of[4] == of[6] > of[5]
    rules_ = by_id(rules.quality_rules(odd))
    assert all((rules_[d].n_words, rules_[d].base_failed, rules_[d].kept) == (0, True, False) for d in (1, 2, 3)) and rules_[4].n_words == 400 * 55
    found = by_id(secrets.scan_secrets(odd))
    assert all((found[d].spans, found[d].base_sha256) == ("", hashlib.sha256(b"").hexdigest()) for d in (1, 2, 3))
    groups = by_id(simhash.near_duplicates(odd))
    assert all((groups[d].fingerprint, groups[d].component_id) == ("0" * 16, 1) for d in (1, 2, 3)) and groups[6].component_id == 4
    decided = by_id(lines.line_decisions(odd))
    # blank lines stay; the later copy of the long text loses every line
    assert (decided[1].n_lines, decided[1].removed) == (1, []) and (decided[3].n_lines, decided[3].removed) == (2, []) and decided[6].removed == list(range(400)) and decided[4].n_removed == 0
    left = {x.doc_id: x for x in lines.drop_lines(odd).collect()}
    assert left[1].text is None and (left[6].text, left[6].n_chars) == ("", 0) and left[4].n_chars == odd.where("doc_id = 4").first().n_chars
    repeats = by_id(spans.drop_repeats(odd))
    assert repeats[6].text == "" and repeats[4].n_removed == 0 and (repeats[1].text, repeats[1].n_sentences) == ("", 0)
    mixed = [(x.doc_id, x.domain, x.lang, x.source, x.n_tokens, x.copies) for x in mixing.mix(odd, queries.domain(), {}, 1.0, 1).collect()]
    assert sorted(mixed, key=repr) == sorted([(None, "d1", "en", "src1", 4, 1), (4, "d0", "de", "src0", 22_000, 1), (5, "d1", "en", "src1", 6, 1), (5, "d1", "en", "src1", 6, 1), (6, "d0", "de", "src0", 22_000, 1), (7, "d2", None, "src2", 1, 1)], key=repr)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(60):
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("tile_rows", [simhash.TILE_ROWS, 2])
def test_simhash_groups(spark, tile_rows):
    r = random.Random(3)
    base = [words(r, 120) for _ in range(12)]
    rows = [(k * 100 + i, t if i < 3 else t + " " + words(r, i), "en", "s", 1) for k, t in enumerate(base) for i in range(6)]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(make(spark, rows), tile_rows=tile_rows).collect()}
    fps = {d: simhash.fingerprint(t) for d, t, *_ in rows}
    root = {d: d for d in fps}
    for _ in range(8):
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {d: (f"{fps[d]:016x}", root[d]) for d in fps}
    assert {x.doc_id for x in simhash.keep_one(make(spark, rows)).collect()} == set(root.values())


@pytest.mark.parametrize("block", [lines.BLOCK, 3])
def test_line_decisions_match_brute_force(spark, block):
    """Small blocks refine nearly every key and split what is left."""
    r = random.Random(4)
    base = [words(r, 8) for _ in range(8)] + ["Copyright 2024 by all of the authors of this page no. 0001", "ab" * 15]

    def vary(t):
        t = list(t)
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice("xyz")
        return "".join(t)

    texts = ["\n".join([vary(r.choice(base)) for _ in range(4)] + ["short", "short"]) for _ in range(40)]
    got = {x.doc_id: (x.n_links, x.removed) for x in lines.line_decisions(make(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)]), block=block).collect()}
    first: dict = {}
    for i, t in enumerate(texts):
        for k, x in enumerate(t.split("\n")):
            if len(x) >= lines.MIN_CHARS:
                first.setdefault(x, (i, k))
    near = {x: [y for y in first if y != x and lines.near(x, y)] for x in first}
    for i, t in enumerate(texts):
        own = [(k, x) for k, x in enumerate(t.split("\n")) if x in first]
        gone = [k for k, x in own if first[x] != (i, k) or any(first[y] < first[x] for y in near[x])]
        assert got[i] == (sum(len(near[x]) for _, x in own), gone)


def test_short_lines_are_removed_too(spark):
    texts = ["All rights reserved.\nRead more\nNo\n\n", "All rights reserved!\nRead more\nNo\n\nOn", "x\nRead mare\nNo."]
    got = {x.doc_id: (x.n_lines, x.n_links, x.removed) for x in lines.line_decisions(make(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert got == {0: (5, 2, []), 1: (5, 2, [0, 1, 2]), 2: (3, 1, [1])}


def test_spans_keep_the_first_copy(spark):
    r = random.Random(5)
    passage = ". ".join(words(r, 14).capitalize() for _ in range(4)) + "."
    lone = words(r, 60).capitalize() + "."
    rows = [(i, f"{words(r, 20).capitalize()}.\n{passage}\n{words(r, 20).capitalize()}. {lone}", "en", "s", 1) for i in range(5)] + [(9, words(r, 50) + ".", "en", "s", 1)]
    got = {x.doc_id: x for x in spans.drop_repeats(make(spark, rows)).collect()}
    assert got[0].n_removed == 0 and got[9].n_removed == 0 and got[0].text == rows[0][1]
    for i in range(1, 5):
        assert passage not in got[i].text and lone not in got[i].text and got[i].n_removed == 5 and rows[i][1].split("\n")[0] in got[i].text


def test_repeats_match_brute_force(spark):
    """Every run of every length, by text, against those at earlier places."""
    r = random.Random(15)
    pool = [words(r, r.choice([3, 9, 14, 45])).capitalize() + "." for _ in range(14)]
    rows = [(r.choice([i, i, i // 2]), " ".join(r.choice(pool) if r.random() < 0.8 else words(r, 12).capitalize() + "." for _ in range(r.randint(0, 9))), "en", "s", 1) for i in range(60)]
    rows += [(3, rows[3][1], "en", "s", 1)] * 2 + [(None, rows[5][1], "en", "s", 1)] + rows[:2]
    df = make(spark, rows).repartition(5)
    marks = {x.text: x.mark for x in df.select("text", F.xxhash64("text").alias("mark")).collect()}
    seen: dict = {}
    every = {}
    for doc, text, *_ in rows:
        said = [text[a:b].lower().split() for a, b in spans.sentences(text)]
        own = []
        for i in range(len(said)):
            for j in range(i, len(said)):
                n = sum(map(len, said[i : j + 1]))
                if (j > i and n >= spans.MIN_WORDS) or (j == i and n >= spans.LONG_SENTENCE):
                    own.append((repr(said[i : j + 1]), i, j))
        every[doc, text] = own
        for run, i, _ in own:
            place = (doc is not None, doc or 0, marks[text], i)
            seen[run] = min(seen.get(run, place), place)
    want = {k: {x for run, i, j in own if seen[run] != (k[0] is not None, k[0] or 0, marks[k[1]], i) for x in range(i, j + 1)} for k, own in every.items()}
    got = spans.repeated_runs(df).collect()
    covered: dict = {}
    for x in got:
        covered.setdefault((x.doc_id, x.mark), set()).update(range(x["first"], x["last"] + 1))
    assert {(k[0], marks[k[1]]): v for k, v in want.items() if v} == covered
    texts = sorted((x.doc_id is not None, x.doc_id or 0, x.n_removed, x.text) for x in spans.drop_repeats(df).collect())
    left = lambda k: spans.remove(k[1], [spans.sentences(k[1])[x] for x in sorted(want[k])])
    assert len(texts) == len(rows)
    assert [x[:3] for x in texts] == sorted((d is not None, d or 0, len(want[d, t])) for d, t, *_ in rows)
    assert sorted(x[3].split() for x in texts) == sorted(left((d, t)).split() for d, t, *_ in rows)


def test_quality_rules_follow_their_group(spark):
    r = random.Random(6)
    rows = [(i, " ".join(words(r, 1) + ("#" if lang == "xx" and r.random() < 0.5 else "") for _ in range(60)), lang, "s", 1) for lang, at in (("en", 0), ("xx", 1000)) for i in range(at, at + 80)]
    rows += [(5000, " ".join(w + "#" for w in words(r, 60).split()), "en", "s", 1), (5001, "too short", "en", "s", 1)]
    got = {x.doc_id: x for x in rules.quality_rules(make(spark, rows), least=50).collect()}
    assert not got[5000].kept and got[5000].failed == "symbol_share" and not got[5000].base_failed
    assert got[5001].base_failed and not got[5001].kept
    assert all(x.kept for d, x in got.items() if d < 5000)


def test_quality_fences_come_from_the_data(spark):
    r = random.Random(8)
    text = lambda share: " ".join(w + "#" * (r.random() < share) for w in words(r, 400).split())
    rows = [(i, text(0.0), "en", "s", 1) for i in range(300)] + [(1000 + i, text(0.3), "en", "t", 1) for i in range(300)]
    rows += [(5000, text(0.06), "en", "s", 1), (5001, text(0.06), "en", "t", 1)]
    got = {x.doc_id: x for x in rules.quality_rules(make(spark, rows), least=1).collect()}
    assert got[5000].failed == "symbol_share" and got[5001].failed == ""  # far outside the first source, though under one in ten words
    assert all(x.kept for d, x in got.items() if d < 5000)
    same = [(i, "alpha gamma delta kappa sigma omega theta north south west1 east1 brown", "en", "s", 1) for i in range(30)]
    assert all(x.failed in ("", "repeat_share") for x in rules.quality_rules(make(spark, same)).collect())


def plain_verdicts(docs, least):
    """kept and failed of every document by the rules' text, with plain sorts and counts."""
    white = " \t\n\v\f\r"
    out, measured = {}, []
    for d, text, lang, source, _ in docs:
        text, w = text or "", [x for x in re.split(f"[{white}]+", text or "") if x]
        lines_ = [x for x in text.split("\n") if x.strip(white)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n_of = {g: grams.count(g) for g in set(grams)}
        repeats = len({k for i, g in enumerate(grams) if n_of[g] > 1 for k in range(i, i + 5)})
        n, m = len(w), len(lines_)
        counts = {
            "word_length": (sum(map(len, w)), n), "symbol_share": (sum(c in "#*$%&|<>" for x in w for c in x), n), "dup_line_share": (m - len(set(lines_)), m), "repeat_share": (repeats, n),
            "upper_share": (sum(x.isupper() for x in w), n), "stutter_share": (sum(x == y for x, y in zip(w, w[1:], strict=False)), n),
        }
        measured.append((d, text, lang or "", source or "", n, m, {k: x / y if y else 0.0 for k, (x, y) in counts.items()}, n < 10 or 100 * repeats > 20 * n))
    g = rules.GAMMA
    edge = lambda v, up: 0.0 if v is None else g**v if up else g ** (v - 1)
    middle = lambda v: 0.0 if v is None else 2 * g**v / (g + 1)

    def fences(rows):
        found = {}
        for k in rules.METRICS:
            own = sorted((-(10**6) if x[6][k] <= 0 else math.ceil(math.log(x[6][k]) / math.log(g)) for x in rows))
            at = lambda q: (lambda v: None if v == -(10**6) else v)(own[max(0, math.ceil(q * len(own) - 1e-9) - 1)])  # noqa: B023, E731
            low, mid, high = at(0.1), at(0.5), at(0.9)
            found[f"{k}_high"] = edge(high, True) + 3 * (middle(high) - middle(mid))
            found[f"{k}_low"] = edge(low, False) - 3 * (middle(mid) - middle(low))
        return len(rows), found

    spoken = [x for x in measured if x[4]]
    of_all = fences(spoken)
    of_lang = {k: fences([x for x in spoken if x[2] == k]) for k in {x[2] for x in spoken}}
    own = {k: fences([x for x in spoken if x[2:4] == k]) for k in {x[2:4] for x in spoken}}
    blend = lambda x, parent: {k: (x[0] * v + least * parent[k]) / (x[0] + least) for k, v in x[1].items()}
    for d, text, lang, source, n, m, values, base in measured:
        failed = []
        if n:
            fence = blend(own[lang, source], blend(of_lang[lang], of_all[1]))
            for k, (per, low) in rules.METRICS.items():
                size = max(1, n if per == "n_words" else m)
                room = lambda rate, side: max(rate, 0.0) + 9 / (4 * size) + side * 3 * math.sqrt(max(rate, 0.0) / size + 0.375 / size**2)  # noqa: B023, E731
                if values[k] > room(fence[f"{k}_high"], 1) or (low and values[k] < room(fence[f"{k}_low"], -1)):
                    failed.append(k)
        out.setdefault(d, []).append((not base and not failed, ",".join(failed), base))
    return out


def test_quality_verdicts_match_brute_force(spark):
    r = random.Random(17)
    rows = []
    for i in range(260):
        w = words(r, r.choice([5, 12, 60, 200])).split()
        kind = i % 13
        if kind == 0:
            w = [x + "#" * r.randint(0, 2) for x in w]
        if kind == 1:
            w = [x.upper() for x in w]
        if kind == 2:
            w = [x for x in w for _ in range(r.randint(1, 3))]
        if kind == 3:
            w = ["".join(w[k : k + 4]) for k in range(0, len(w), 4)]
        text = "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))
        if kind == 4:
            text += "\n" + "\n".join(r.choices(text.split("\n"), k=6))
        rows.append((i, text, r.choice(["en", "en", "de", None]), r.choice(["s0", "s0", "s1", None]), 1))
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0), (502, "x " * 40, "xx", "alone", 1), *rows[:3]]
    for least in (200, 5):
        got: dict = {}
        for x in rules.quality_rules(make(spark, rows).repartition(4), least=least).collect():
            got.setdefault(x.doc_id, []).append((x.kept, x.failed, x.base_failed))
        want = plain_verdicts(rows, least)
        assert got == want
    assert {k for v in want.values() for x in v for k in x[1].split(",")} >= {"symbol_share", "upper_share", "stutter_share", "word_length"}


def test_values_at_a_fence_pass(spark):
    """All documents alike: each stands at the quantile, and none is outside."""
    text = " ".join(f"Word{k}" for k in range(40)) + " # HIGH"
    got = rules.quality_rules(make(spark, [(i, text, "en", "s", 1) for i in range(50)])).collect()
    assert all(x.kept and x.failed == "" for x in got) and len(got) == 50


def test_sketch_quantiles_are_close(spark):
    values = [((i * 7919) % 10_000) / 100 for i in range(10_000)]
    df = spark.createDataFrame([(x,) for x in values], "x double").select(rules.bucket(F.col("x")).alias("bucket"), F.lit("g").alias("g"))
    row = rules.quantiles(df.groupBy("g", "bucket").agg(F.count("*").alias("n")), ["g"], {"q10": 0.1, "q50": 0.5, "q99": 0.99}).first()
    for q in (10, 50, 99):
        assert abs(row[f"q{q}"] / q - 1) < 0.02


def test_mixing_redistributes_among_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 100), ("d0", "en", "b", 10), ("d0", "de", "c", 1000), ("d1", "en", "d", 1000), ("d2", "en", "e", 50)], "domain string, lang string, source string, tokens long")
    weights = {"domain": {"d2": 0, "*": 1}, "lang": {}, "source": {}}
    got = {x.source: x.budget for x in mixing.budgets(leaves, weights, F.lit(400), 1).collect()}
    assert got == {"a": 90, "b": 10, "c": 100, "d": 200, "e": 0}  # b's shortage goes to a alone
    got = {x.source: x.budget for x in mixing.budgets(leaves, weights, F.lit(10_000), 1).collect()}
    assert got == {"a": 100, "b": 10, "c": 1000, "d": 1000, "e": 0}
    got = {x.source: x.budget for x in mixing.budgets(leaves, weights, F.lit(600), 1).collect()}
    assert got == {"a": 100, "b": 10, "c": 190, "d": 300, "e": 0}  # what their parent cannot use goes to its sibling


def test_mixing_takes_prefixes(spark):
    r = random.Random(7)
    rows = [(i, words(r, r.randint(1, 40)), "en", f"src{i % 3}", 1) for i in range(300)]
    docs = make(spark, rows)
    got = mixing.mix(docs, queries.domain(), {}, 0.5, 2).collect()
    total = sum(len(t.split()) for _, t, *_ in rows)
    assert 0.4 * total < sum(x.n_tokens * x.copies for x in got) <= total * 0.5
    assert all(len(x.text.split()) == x.n_tokens for x in got)
    more = mixing.mix(docs.where("source = 'src0'"), queries.domain(), {}, 1.5, 2).collect()
    assert {x.copies for x in more} == {1, 2}


def test_revisits(spark):
    head = lambda **kv: "\n".join(f"{k.replace('_', '-')}: {v}" for k, v in kv.items())
    rows = [
        (1, "http://www.A.com:80/x/?utm_source=q&b=2&a=1#f", 10, "response", 200, head(ETag='"e1"', Content_Type="t", Date="d1"), "p1", 5),
        (2, "https://a.com/x?a=1&b=2", 20, "response", 200, head(ETag='"e2"', Date="d2"), "p2", 6),
        (3, "https://a.com/x?a=1&b=2", 20, "revisit", 304, head(ETag='W/"e1"', Date="d3", Server="s"), None, None),
        (4, "https://a.com/x?b=2&a=1", 999_999, "revisit", 304, head(ETag='"e1"'), None, None),
        (5, "https://a.com/x?b=2&a=1", 10, "revisit", 304, head(ETag='"e1"'), None, None),
        (6, "https://a.com/x?b=2&a=1", 30, "revisit", 304, None, None, None),
        (7, None, 30, "revisit", 304, head(ETag='"e1"'), None, None),
        (8, "https://a.com/x?b=2&a=1", None, "revisit", 304, head(ETag='"e1"'), None, None),
        (None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, type string, http_status int, headers string, payload_digest string, payload_length long")
    got = {x.record_id: x for x in warc.resolve_revisits(df.withColumn("canonical", F.lit("mine")).withColumn("span", F.lit(1)), 100).collect()}
    assert {k: v.status for k, v in got.items()} == {3: "resolved", 4: "mismatch", 5: "no_response", 6: "no_validator", 7: "no_response", 8: "no_response"}
    assert (got[3].response_id, got[3].payload_digest, got[3].headers) == (1, "p1", 'content-type: t\ndate: d3\netag: W/"e1"')
    assert got[4].response_id is None and got[3].canonical == "https://a.com/x?a=1&b=2"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_secrets_of_a_corpus(spark):
    """Base columns against a plain version; the models find keys that no pattern does, in documents alone that have one."""
    r = random.Random(21)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda k: "".join(r.choices(letters, k=k))
    rows, planted = [], set()
    for i in range(200):
        text = words(r, 60)
        if i % 5 == 1:
            text += f" token={key(24)} and {words(r, 3)}"
        if i % 5 == 2:
            text += f" AKIA{'QWERTYUIOPASDFGH'} {'0a1b2c3d' * 4}"
        if i % 5 == 3:
            text += f" {words(r, 2)} /{words(r, 1)}/{key(28)} {words(r, 2)}"
            planted.add(i)
        rows.append((i, text, "en", "s", 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)] + rows[:2]
    df = make(spark, rows).withColumn("spans", F.lit("mine")).withColumn("h", F.lit(1))
    got = secrets.scan_secrets(df.repartition(3)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, secrets.scan_secrets(df.repartition(7)).collect()))
    texts = {d: t or "" for d, t, *_ in rows}
    for x in got:
        own = texts[x.doc_id]
        base = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"token=[A-Za-z0-9]{24}", own)]
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]{16,}", own)] + [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]{24,}", own)]
        assert x.base_sha256 == hashlib.sha256(",".join(y[2] for y in sorted(base)).encode()).hexdigest()
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(y[1] == k for y in base) for k in range(3))
    found = {x.doc_id for x in got if x.n_markov}
    assert len(found & planted) >= 0.9 * len(planted) and not found - planted
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_revisits_match_brute_force(spark):
    """Few URLs and times, so that spans, ties, repeated rows and hot seconds all occur."""
    r = random.Random(23)
    rows = []
    for k in range(400):
        full = r.random() < 0.3
        tag = f'"{r.randrange(3)}"'
        url = r.choice(["http://a.com/x", "https://www.a.com/x/", "http://b.com/?q=1", None])
        rows.append((k // 2 if r.random() < 0.1 else k, url, r.choice([None, *range(60)]), "response" if full else "revisit", r.choice([200, 200, 404]) if full else 304, f"ETag: {tag}" if r.random() < 0.8 else None, f"p{k}" if full else None, k if full else None))
    rows += rows[:40]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, type string, http_status int, headers string, payload_digest string, payload_length long")
    canonical = {"http://a.com/x": "https://a.com/x", "https://www.a.com/x/": "https://a.com/x", "http://b.com/?q=1": "https://b.com?q=1", None: None}
    full = [x for x in rows if x[3] == "response" and x[4] == 200 and x[1] and x[2] is not None]
    want = []
    for x in rows:
        if x[3] != "revisit":
            continue
        earlier = [y for y in full if canonical[y[1]] == canonical[x[1]] and x[2] is not None and y[2] < x[2]]
        best = max(earlier, key=lambda y: (y[2], y[0], y[6], y[7]), default=None)
        status = "no_response" if not best else "no_validator" if not (x[5] and best[5]) else "resolved" if x[5] == best[5] else "mismatch"
        want.append((x[0], x[2], status, *((best[0], best[6]) if status == "resolved" else (None, None))))
    for span in (7, 1000):
        got = [(x.record_id, x.ts, x.status, x.response_id, x.payload_digest) for x in warc.resolve_revisits(df.repartition(3), span).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_leaks_in_several_blocks(spark):
    r = random.Random(25)
    bench = [(i, words(r, 20)) for i in range(12)] + [(3, words(r, 20)), (12, None), (None, words(r, 20))]
    rows = [(i, words(r, 15) + (" " + bench[i % 14][1] if i % 3 and bench[i % 14][1] else ""), "en", "s", 1) for i in range(60)] + [(60, None, None, None, None)]
    docs, items = make(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate.blocks_of(items, 300)[0] > 3
    one = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    assert one == sorted(map(tuple, decontaminate.find_leaks(docs, items, block_chars=300).collect())) and one
    for chars in (decontaminate.BLOCK_CHARS, 300):
        left = decontaminate.drop_leaks(docs, items, block_chars=chars)
        assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == {x[0] for x in rows} - {x[0] for x in one}


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_pages(spark):
    long = "".join(f"<p>Sentence number {k} of a very long page.</p>" for k in range(20_000))
    rows = [(1, "u", "<article><p>a</p></article>"), (None, None, None), (2, "u", ""), (1, "u", "<article><p>a</p></article>"), (3, "v", f"<nav>x</nav><div>{long}</div>"), (4, "w", "<p>a\x00b &amp; c"), (5, "w", "<<<>>><")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("text", "n_chars", "line", "a.b"):
        df = df.withColumn(name, F.lit("mine"))
    got = sorted((x.page_id or 0, x.url or "", x.n_chars) for x in html.extract_text(df).collect())
    n = sum(len(f"Sentence number {k} of a very long page.") for k in range(20_000)) + 19_999
    assert [x for x in got if x[0] < 4] == [(0, "", 0), (1, "u", 1), (1, "u", 1), (2, "u", 0), (3, "v", n)]
    assert all(x.n_chars == len(x.text) for x in html.extract_text(df).collect())
    assert html.extract_text(df.limit(0)).count() == 0


def test_classifier_holds_out_a_fifth(spark):
    docs = spark.createDataFrame([(i,) for i in range(2000)], "doc_id long")
    n = docs.where(classifier.held_out()).count()
    assert 300 < n < 500
