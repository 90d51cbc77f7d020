"""Token files against plain lists and the tokenizer itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clipmotif.llm import queries, wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize(("n", "most"), [(0, 1), (1, 0), (1, 50_000), (300, 5), (5000, 49_408), (70_000, 300)])
def test_wavelet_against_lists(n, most):
    r = np.random.default_rng(n)
    tokens = np.minimum(r.zipf(1.3, n) - 1, most).astype(np.uint32)
    lengths = [n // 3, n - n // 3] if n else []
    file = wavelet.Wavelet(wavelet.Wavelet.build(tokens, list(zip([None, 7], lengths, strict=False)), block=64) + b"\n")
    assert file.tokens().tolist() == tokens.tolist()
    assert file.documents() == ([(None, 0, n // 3), (7, n // 3, n - n // 3)] if n else [])
    for i in r.integers(0, n, 40) if n else ():
        assert file.access(int(i)) == tokens[i]
    for token in [0, 1, 2, most, 70_000, *tokens[:5].tolist()]:
        a, b = sorted(r.integers(0, n + 1, 2).tolist())
        assert file.count(token) == (tokens == token).sum()
        assert file.count(token, a, b) == (tokens[a:b] == token).sum()
        assert file.locate(token, a, b).tolist() == (a + np.flatnonzero(tokens[a:b] == token)).tolist()
    with pytest.raises(IndexError):
        file.access(n)


def test_files_are_compressed_and_checked():
    tokens = np.minimum(np.random.default_rng(1).zipf(1.2, 100_000), 49_000).astype(np.uint32)
    assert len(wavelet.Wavelet.build(tokens, [(1, 100_000)])) < 1.5 * 100_000
    with pytest.raises(ValueError):
        wavelet.Wavelet(b"something else")


def test_encoder_equals_the_tokenizer_on_real_words():
    words = ["Hello", "world's", "(word)", "<|endoftext|>", "x<|endoftext|>y", "été", "İstanbul", "ΣΑΣ", "don't", "a.b", "3.14", "''s", "%%%", "_a_", "A B", "a\u001cb", "　x", "中文", "🙂", "'", '"it\'s"', "ﬁ", "K", "ͅ", "--x--", "I'LL"]
    r = random.Random(0)
    texts = [r.choice(" \n\t").join(r.choices(words, k=r.randint(0, 30))) for _ in range(300)]
    own = wavelet.Encoder(PATH)
    ids, ends = own.encode(pa.array(texts), 2)
    for text, a, b in zip(texts, [0, *ends], ends, strict=False):
        assert ids[a:b].tolist() == ids_of(text), text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=20), max_size=6), st.sampled_from([" ", "\n", "\t ", "\r\n", "\x0b", "\x0c"]))
def test_encoder_equals_the_tokenizer_on_any_text(parts, gap):
    text = gap.join(parts)
    assert wavelet.encoder(PATH).encode(pa.array([text]), 2)[0].tolist() == ids_of(text)


def test_encoder_forgets_words(monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE", 5)
    own = wavelet.Encoder(PATH)
    for text in ("a b c", "d e f g h i j", "a, b. (c)", "k l m"):
        assert own.encode(pa.array([None, text]), 2)[0].tolist() == [2, *ids_of(text)]


def plain(rows):
    out, at = [], 0
    for doc, text in rows:
        ids = ids_of(text)
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_plain_version(spark, tmp_path):
    r = random.Random(2)
    rows = [(i * 3 % 101 - 20, " ".join(r.choices(["Abc", "de's", "fé.", "123", "--", "long" * 9], k=r.randint(0, 200)))) for i in range(101)]
    rows += [(500, None), (501, ""), (502, "word " * 30_000)]
    spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, `start` string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op13_token_files"](spark, str(tmp_path)).collect()
    assert sorted(tuple(g) for g in got) == plain(sorted(rows, key=lambda x: x[0]))


def test_shards_nulls_repeats_and_look_up(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["one", "two", "three"], k=r.randint(0, 40)))) for i in range(60)]
    rows += [(None, "none"), (7, rows[7][1]), (7, rows[7][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"{tmp_path}/tokens"
    wavelet.write_shards(docs, PATH, folder, shard_tokens=50)
    table = sorted(tuple(x) for x in wavelet.shard_table(spark, folder).collect())
    assert len(table) > 8
    assert all(n >= 50 for (p, _, n, _), nxt in zip(table, table[1:], strict=False) if nxt[0] == p)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    want = plain(order)
    assert sorted((tuple(x) for x in wavelet.read_documents(spark, folder).collect()), key=lambda x: x[1]) == want
    ids = {x["start"]: x["ids"] for x in wavelet.read_tokens(spark, folder).collect()}
    assert [ids[s] for _, s, _, _ in want] == [ids_of(t) for _, t in order]
    token = ids_of("two")[0]
    found = {x["start"]: (x["doc_id"], x["n"], x["places"]) for x in wavelet.find_token(spark, folder, token).collect()}
    assert found == {s: (d, ids[s].count(token), [i for i, t in enumerate(ids[s]) if t == token]) for d, s, _, _ in want if token in ids[s]}


def test_no_documents(spark):
    assert wavelet.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
