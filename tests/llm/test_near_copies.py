"""Groups of near copies against all pairs by brute force."""

import random

import corpus_pipeline
import numpy as np
from helpers import DOCS, awkward, prose

from scanlake.llm import near_copies
from scanlake.llm.common import forest


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def roots(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    near = [(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if len(x & y) >= threshold * len(x | y)]
    return forest(len(sets), np.array([i for i, _ in near], np.int64), np.array([j for _, j in near], np.int64))


def rows(seed=0):
    """Texts and copies of them with some words exchanged, wrapped anew, and in long chains."""
    rng = random.Random(seed)
    out = []
    for k in range(30):
        words = [f"{w}{rng.randrange(40)}" for w in prose(k, rng.randrange(20, 400)).split()]
        out.append(" ".join(words))
        for _ in range(rng.randrange(0, 5)):
            words = words[:]
            for _ in range(rng.randrange(1, 2 + len(words) // 25)):
                words[rng.randrange(len(words))] = "other"
            out.append("\n".join(" ".join(words[a : a + 9]) for a in range(0, len(words), 9)))
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], DOCS)
    label = roots(texts)
    got = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    assert got == set(label.tolist()) and len(got) < len(texts)


def test_stage_finds_all_near_copies(spark):
    check(spark, rows())


def test_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(near_copies, "BLOCK_SETS", 4)
    base = [f"w{k}" for k in range(150)]
    chain = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 150, 3)]
    check(spark, rows(1) + chain)


def test_awkward_rows(spark):
    got = near_copies.drop_near_copies(awkward(spark))
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert ids[:2] == [1, 3] and got.columns == awkward(spark).columns


def test_the_pipeline_links_by_fingerprint_too(spark):
    """Texts of one long repeated passage have one fingerprint, but few five-word shingles in common; links of both kinds chain."""
    import corpus_pipeline

    words = " ".join(f"w{k}" for k in range(41))
    texts = [" ".join([words] * 50 + [f"{name}{k}" for k in range(60)]) for name in "ab"]
    texts += [texts[1] + " more", "another text of a few words only"]
    docs = spark.createDataFrame([(k + 1, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == [1, 2, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [1, 4]
