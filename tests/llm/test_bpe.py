"""Ids against the tiktoken library, and round trips."""

import hashlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import awkward, empty, prose

from scanlake.llm import bpe
from scanlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    out = QUERIES["op2_bpe"](spark, SF).toPandas()
    assert sorted(out.doc_id) == sorted(docs.index)
    for row in out.itertuples():
        text = docs.text[row.doc_id] or ""
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_rows(spark, ranks, library):
    rows = awkward(spark).selectExpr("*", "7 AS token_ids", "'x' AS decoded")
    out = bpe.decode(bpe.encode(rows, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(out) == rows.count()
    for r in out:
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty(spark), ranks, public_tokenizers.PATTERN).count() == 0


def test_words_on_both_sides_of_the_long_bound(ranks, library):
    encoder = bpe.Encoder(ranks)
    words = ["a" * n for n in (1, 2, 191, 192, 193, 1000)] + ["ab" * 300, "=-" * 400, prose(5, 200).replace(" ", ""), "日本語のテキスト" * 40, " " * 700]
    for word in words:
        assert np.frombuffer(encoder.packed([[word]])[0], "<u4").tolist() == library._encode_single_piece(word)


def test_characters_split_as_in_the_library(ranks, library):
    encoder, split = bpe.Encoder(ranks), bpe.regex.compile(public_tokenizers.PATTERN).findall
    points = [c for c in range(0, 0x3100, 3)] + [*range(0x80, 0x100), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x85, 0x1C, 0x1F, 0xFEFF, 0x1F600]
    texts = ["a" + chr(c) + "1 " + chr(c) + chr(c) + " b" for c in points]
    for text, ids in zip(texts, encoder.packed([split(t) for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_unknown_ids_are_an_error(spark, ranks):
    bad = spark.createDataFrame([(bytes([255, 255, 255, 0]),)], "token_ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad, ranks).collect()


def test_stretches_that_do_not_meet(ranks, library, monkeypatch):
    """With short stretches most words need longer pieces, and tokens longer than a stretch come up."""
    monkeypatch.setattr(bpe, "HALF", 4)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(letters), 1500)) for letters in ("ab", "etaoinshr", "=-", "日本", "  ")]
    words += [prose(8, 300).replace(" ", ""), "abcdefg" * 100, "a" * 777, " " * 1001, "=" * 999, "日" * 500]
    pieces, append = [], bpe.Encoder._append
    monkeypatch.setattr(bpe.Encoder, "_append", lambda *args: pieces.append(1) or append(*args))
    encoder = bpe.Encoder(ranks)
    for word in words:
        assert np.frombuffer(encoder.packed([[word]])[0], "<u4").tolist() == library._encode_single_piece(word)
    assert pieces


def test_a_match_of_ten_megabytes(spark, ranks, library):
    rows = spark.sql("SELECT 1 AS doc_id, repeat('a', 10000000) AS text UNION ALL SELECT 2, repeat('abcdefghijk', 910000)")
    out = {r.doc_id: r for r in bpe.round_trip(rows, ranks, public_tokenizers.PATTERN).collect()}
    for doc, piece, times in ((1, "a", 10_000_000), (2, "abcdefghijk", 910_000)):
        assert np.array_equal(np.frombuffer(bytes(out[doc].token_ids), "<u4"), library._encode_single_piece(piece * times))
        assert bytes(out[doc].decoded) == (piece * times).encode()


def test_rows_leave_in_small_batches(ranks):
    """A batch of 8 MB isn't held with its ids and decoded bytes at once, by the worker or by what it hands them to."""
    texts = [prose(k, 900) for k in range(1200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "text": texts})
    held = SimpleNamespace(value=ranks)
    encoding, decoding = bpe._encoding(held, public_tokenizers.PATTERN, "text", ["doc_id", "text"]), bpe._decoding(held, "token_ids", "decoded")
    out = list(decoding(encoding(iter([batch, batch.slice(0, 0)]))))
    assert batch.nbytes > 5 * bpe.BATCH_BYTES and max(b.nbytes for b in out) < 5 * bpe.BATCH_BYTES
    rows = pa.Table.from_batches(out)
    assert rows["doc_id"].to_pylist() == list(range(1200)) and rows["decoded"].to_pylist() == [t.encode() for t in texts]


def test_full_cache_keeps_words_in_use(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    encoder, learned = bpe.Encoder(ranks), []
    learn = encoder._learn
    encoder._learn = lambda words: learned.append(len(words)) or learn(words)
    split = bpe.regex.compile(public_tokenizers.PATTERN).findall
    for k in range(6):
        text = "the same words again " + " ".join(f"own{k}x{j}" for j in range(60))
        assert np.frombuffer(encoder.packed([split(text)])[0], "<u4").tolist() == library.encode_ordinary(text)
    encoder.packed([split("the same words again")])
    assert learned[-1] == 0 and len(encoder.known) < 50
