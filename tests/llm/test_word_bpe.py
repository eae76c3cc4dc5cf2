"""Ids and texts against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from helpers import awkward, empty, prose
from tokenizers import Tokenizer

from scanlake.llm import word_bpe
from scanlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return word_bpe.read_tokenizer(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    out = QUERIES["op11_word_bpe"](spark, SF).toPandas()
    assert sorted(out.doc_id) == sorted(docs.index)
    for row in out.itertuples():
        ids = ids_of(library, docs.text[row.doc_id] or "")
        assert row.n_tokens == len(ids) and row.ids_sha256 == sha(" ".join(map(str, ids)))
        assert row.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_awkward_rows(spark, library, tokenizer):
    rows = awkward(spark).selectExpr("*", "7 AS token_ids", "'x' AS decoded")
    out = word_bpe.decode(word_bpe.encode(rows, tokenizer), tokenizer).collect()
    assert len(out) == rows.count()
    for r in out:
        ids = ids_of(library, r.text or "")
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.lang is None or r.lang in ("en", "de")
    assert word_bpe.decode(word_bpe.encode(empty(spark), tokenizer), tokenizer).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([343, None, 99_999_999, -1, 49407],)], "token_ids array<int>")
    assert sorted(r.decoded for r in word_bpe.decode(odd, tokenizer).collect()) == ["", "", library.decode([343, 49407], skip_special_tokens=False)]


def test_texts_of_all_kinds(library, tokenizer):
    """Random letters fail the guess often; marks, special tokens, scripts, characters newer than Python's tables."""
    rng = random.Random(1)
    texts = ["", "<|endoftext|>x<|startoftext|><|endoftext|> <|endo", "ΣΑΣ İ ǅ ẞ", "é ẛ̣", "՘Ᲊ Ab࢏", "it's we'Ll 'S 12½ Ⅷ", "\x00​﻿"]
    texts += ["".join(rng.choices("abcdetions", k=rng.randrange(1, 60))) for _ in range(2000)]
    texts += ["".join(rng.choices("aing!?.=-'", k=rng.randrange(1, 60))) for _ in range(1000)]
    points = [range(32, 127), range(160, 0x600), range(0x3000, 0xD000), range(0x10000, 0x1FFFF)]
    texts += ["".join(chr(rng.choice(rng.choice(points))) for _ in range(rng.randrange(1, 40))) for _ in range(1000)]
    values, sizes = word_bpe._Words(tokenizer).encode(texts)
    at = 0
    for text, size in zip(texts, sizes.tolist()):
        assert values[at : at + size].tolist() == ids_of(library, text), text
        at += size


def test_long_words(library, tokenizer):
    """Words of many tokens are merged again only around pairs that fail."""
    rng = random.Random(2)
    texts = ["a" * n for n in (255, 256, 257, 5000)] + ["ab" * 3000, "日本語のテキスト" * 500, "=-" * 2000, prose(4, 3000).replace(" ", "")]
    texts += ["".join(rng.choices("theandingofinretions", k=100_000))]
    words = word_bpe._Words(tokenizer)
    for text in texts:
        assert words.encode([text])[0].tolist() == ids_of(library, text)


def test_pairs_are_apart_if_merging_them_keeps_them(tokenizer):
    encoder = word_bpe.Encoder(tokenizer)
    spelt = {i: t for t, i in tokenizer.tokens.items()}
    rng = random.Random(3)
    value = {c: b for b, c in enumerate(word_bpe.byte_characters())}
    tokens = [i for i, t in spelt.items() if not t.endswith("</w>") and len(t) < 6]
    a, b = (rng.choices(tokens[:4000], k=4000) for _ in range(2))
    import numpy as np

    apart = encoder._apart(np.array(a), np.array(b))
    for x, y, told in zip(a, b, apart.tolist()):
        symbols = [int(encoder.symbol[value[c]]) for c in spelt[x] + spelt[y]]
        assert (encoder._merge(symbols) == [x, y]) == told
    assert not apart.all() and apart.any()


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        word_bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
