"""Wavelet matrices against plain arrays, and the store against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pricelode.llm import latin_words as lw
from pricelode.llm import wavelet_store as ws

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=80), st.integers(0, 80))
def test_matrix(tokens, end):
    m = ws.WaveletMatrix.from_bytes(memoryview(ws.WaveletMatrix.build(np.array(tokens, np.uint32)).to_bytes()))
    assert m.all().tolist() == tokens
    end = min(end, len(tokens))
    for i, t in enumerate(tokens):
        assert m.access(i) == t
        assert m.rank(t, end) == tokens[:end].count(t)
        assert m.select(t, tokens[:i].count(t)) == i
    assert m.count(70_001) == 0
    with pytest.raises(IndexError):
        m.select(70_001, 0)


def test_long_matrix():
    tokens = np.random.default_rng(1).zipf(1.3, 20_000) % 50_257
    m = ws.WaveletMatrix.build(tokens)
    where = np.flatnonzero(tokens == tokens[777])
    assert m.count(tokens[777]) == len(where) and [m.select(tokens[777], k) for k in (0, len(where) // 2, len(where) - 1)] == where[[0, len(where) // 2, -1]].tolist()
    assert [m.access(i) for i in (0, 511, 512, 19_999)] == tokens[[0, 511, 512, 19_999]].tolist()


def test_store_equals_library(spark):
    data = ["", None, "Hello world", "  lead\n\n tail  ", "x" * 5000, "été 漢字 😀", "a <|endoftext|> b", "it's 12 o'clock\t\t", "w " * 30_000, "same", "same"]
    rows = [(i * 3 % 7, t, "x") for i, t in enumerate(data)] + [(None, "none", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    tokenizer = Tokenizer.from_file(PATH)
    coded = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    for limit in (ws.SHARD_TOKENS, 50):
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in ws.read_store(ws.write_store(df, PATH, shard_tokens=limit)).collect())
        assert [g[1] for g in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
        at = 0
        for start, _, n, _ in got:
            assert start == at
            at += n
        crc = lambda t: (len(coded(t)), zlib.crc32(np.array(coded(t), "<u4").tobytes()))
        assert sorted((d if d is not None else -1, n, c) for _, d, n, c in got) == sorted((d if d is not None else -1, *crc(t)) for d, t, _ in rows)
    assert ws.read_store(ws.write_store(df.limit(0), PATH)).count() == 0


def test_words_are_cut_like_the_pattern():
    rnd, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    bits = ["a", "é", "the", "'", "'s", "'re", "'ll", "'x", "''s", " ", "  ", "\n", "\t", "\r\n", "1", "23", ".", "!?", "$", "ÿ", " '", "' "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(9))) for _ in range(5000)]
    buffer = np.frombuffer(b"\xff".join(t.encode() for t in texts) + b"\xff", np.uint8)
    starts, ends = lw.cut_words(buffer)
    edges = np.searchsorted(starts, np.cumsum([0, *(len(t.encode()) + 1 for t in texts)]))
    for t, a, b in zip(texts, edges[:-1], edges[1:]):
        assert [bytes(buffer[i:j]).decode() for i, j in zip(starts[a:b], ends[a:b])] == pattern.findall(t), t


def test_encoder_equals_library_in_small_tables(monkeypatch):
    tokenizer, rnd = Tokenizer.from_file(PATH), random.Random(2)
    monkeypatch.setattr(ws, "KEPT_WORDS", 20)
    encoder = ws.Encoder(PATH)
    bits = ["one", "two", " three", " Été", " ", "\n", "'s", "漢", "9", "<|endoftext|>", "–", " zz"]
    for _ in range(200):
        data = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(8))) for _ in range(rnd.randrange(1, 6))]
        ids, sizes = encoder.encode([t.encode() for t in data])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in data]


@pytest.mark.parametrize("limit", [1, 40, 5000])
def test_word_table(limit, monkeypatch):
    """Codes stay right when the table starts afresh, grows within a slice, or all words share a home."""
    rnd = random.Random(limit)
    pool = ["".join(rnd.choices("abcdé", k=rnd.randrange(1, 7))) for _ in range(1500)]
    codes = lambda word: list(word.encode())
    asked = []

    def encode(words):
        asked.extend(words)
        return np.concatenate([codes(w) for w in words]), np.array([len(codes(w)) for w in words])

    for blunt in (False, True):
        if blunt:
            monkeypatch.setattr(lw, "_hash", lambda buffer, starts, ends, base, inverse, f=lw._hash: f(buffer, starts, ends, base, inverse) << np.uint64(40))
        table = lw.HashedWords(encode, limit)
        for size in (3, 200, 1, 1200, 40):
            data = [" ".join(rnd.choices(pool, k=rnd.randrange(0, 30))).encode() for _ in range(size)]
            found = table.codes(data)
            if found is None:  # a blunt hash may not tell words apart; then the texts go the general way
                assert blunt
                continue
            flat, per_text = found
            assert flat.tolist() == [b for x in data for b in x] and per_text.tolist() == [len(x) for x in data]
    assert len(asked) >= len(set(asked))
