"""Held-out accuracy, and the forward pass against all segmentations."""

import math
import zlib
from itertools import combinations

import numpy as np
import pytest
from helpers import awkward, empty, prose

from scanlake.llm import langid
from scanlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_query_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    out = QUERIES["op5_langid"](spark, SF).toPandas()
    assert sorted(out.doc_id) == sorted(docs.index)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(out.doc_id, out.held_out))
    held = out[out.held_out]
    assert (held.lang_pred.values == docs.lang[held.doc_id].values).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces([b"ab", b"abc", b" a", b"bc", b"X", b" a1"], 8)
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces.pieces), 2))
    number = {t: k for k, t in enumerate(pieces.pieces)}
    for word in ("abcab", "a", "bcbc"):
        raw, total = b" " + word.encode(), np.zeros(2)
        for k in range(len(raw)):
            for cuts in combinations(range(1, len(raw)), k):
                parts = [raw[a:b] for a, b in zip((0, *cuts), (*cuts, len(raw)))]
                if all(x in number for x in parts):
                    total += math.prod(p[number[x]] for x in parts)
        got = langid.word_scores(pieces, p * pieces.gain[:, None], ["zzz", word])
        assert np.allclose(got[1], np.log(total))


def test_expected_counts_add_up_to_the_bytes():
    pieces = langid.Pieces([b"ab", b"abc", b" a"], 8)
    p = np.full(len(pieces.pieces), 0.01) * pieces.gain
    counts = langid.expected_counts(pieces, p, ["abcab", "q" * 100], np.array([3, 1]))
    assert counts @ [len(t) for t in pieces.pieces] == pytest.approx(3 * 6 + 101)


def test_awkward_rows(spark):
    rows = awkward(spark).selectExpr("*", "'x' AS score")
    tokens = [b" the", b"tion", b"ing", b"sch", b"ung", b"ein"]
    model = langid.fit(rows, tokens)
    assert model[0] == ["de", "en"]
    out = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    assert [out[k].lang_pred for k in (3, 4, 5, 6)] == ["und"] * 4 and out[6].score == 0
    assert out[1].lang_pred == "en" and out[7].lang_pred == "en" and out[10].lang_pred in ("de", "en")
    assert langid.identify(rows, model).count() == rows.count()
    kept = langid.keep_identified(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and {3, 4, 5, 6}.isdisjoint({r.doc_id for r in kept.collect()})
    nothing = langid.fit(empty(spark), tokens)
    assert {r.lang_pred for r in langid.identify(rows, nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def test_words():
    assert langid.words_of("Don't ½a x² Über_all 12") == ["don", "t", "a", "x", "über", "all"]
    assert langid.words_of(prose(1, 5)) == prose(1, 5).split()
