"""Counts and base scores by hand, the model as a distribution, and held-out gain."""

import math
import time
import zlib
from collections import Counter

import numpy as np
from helpers import awkward, empty
from pyspark.sql import functions as F

from scanlake.llm import lm
from scanlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def base_of(docs, training):
    tokens = [[*(t or "").encode().translate(lm.LOWER).split(), b""] for t in docs]
    counts = Counter(w for t, use in zip(tokens, training) if use for w in t)
    n, v = sum(counts.values()), len(counts)
    return tokens, counts, n, [sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) for t in tokens]


def check(out, docs, training):
    tokens, counts, n, base = base_of(docs, training)
    for row, t, b in zip(out.itertuples(), tokens, base):
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(row.base_score, b, rel_tol=1e-9, abs_tol=1e-9)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    out = QUERIES["op7_lm"](spark, SF).toPandas().sort_values("doc_id")
    held = [zlib.crc32(str(d).encode()) % 5 == 1 for d in docs.doc_id]
    assert out.doc_id.tolist() == docs.doc_id.tolist() and out.held_out.tolist() == held
    check(out, docs.text, [not x for x in held])
    rows = out[out.held_out]
    assert rows.score.sum() > rows.base_score.sum() and (out.score < 0).all()


def test_rare_words_by_join(spark, monkeypatch):
    """With a small table of hot words and many tasks, most counts come from the join and changes are added in groups."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm, "HOT", 40)
    monkeypatch.setattr(lm, "TASK_TOKENS", 2_000)
    docs = docs.repartition(12)
    out = lm.fit_and_score(docs, F.col("doc_id") % 2 == 0).toPandas().sort_values("doc_id")
    rows = docs.toPandas().sort_values("doc_id")
    check(out, rows.text, (rows.doc_id % 2 == 0).tolist())


def test_model_is_a_distribution():
    words = [f"w{k}".encode() for k in range(70)]
    vocabulary = lm.Vocabulary(7000, 100, {w: 100 for w in words}, {w: k for k, w in enumerate(words)}, 500)
    model = lm.Model(vocabulary)
    rng = np.random.default_rng(0)
    model.classes[:] = rng.standard_normal(model.classes.shape)
    model.members[:] = rng.standard_normal(model.members.shape)
    context = np.repeat(rng.integers(0, 2**32, (4, 1), np.int64).astype(np.uint32), 71, axis=1)
    got = lm.log_probabilities(model, np.array([*range(70), -1], np.int32), context)
    assert np.isclose(np.exp(got).sum(), 1, atol=1e-5)


def test_gradient_lowers_the_loss():
    words = [f"w{k}".encode() for k in range(60)]
    vocabulary = lm.Vocabulary(6000, 60, {w: 100 for w in words}, {w: k for k, w in enumerate(words)}, 0)
    texts = [b" ".join(words[(k + j * j) % 60] for j in range(50)) for k in range(60)]
    (_, place, context), *_ = lm.Stream(iter(texts), vocabulary).chunks()
    model = lm.Model(vocabulary)
    squares = [np.zeros_like(t) for t in model.tables]
    before = lm.log_probabilities(model, place, context).mean()
    for _ in range(5):
        lm.train_on(model, squares, place, context, 0.1)
    assert lm.log_probabilities(model, place, context).mean() > before + 1


def test_awkward_rows(spark):
    rows = awkward(spark).selectExpr("*", "'x' AS score", "1 AS row")
    out = lm.fit_and_score(rows, F.lit(True)).toPandas()
    assert len(out) == rows.count()
    by_id = out.set_index("doc_id")
    assert by_id.n_tokens[3] == by_id.n_tokens[4] == by_id.n_tokens[5] == 1 and by_id.n_tokens[7] == 3001
    assert by_id.base_score[1] == by_id.base_score[2].iloc[0] and np.isfinite(out.score).all()
    unlearned = lm.fit_and_score(rows, F.lit(False)).toPandas()
    assert len(unlearned) == rows.count() and (unlearned.n_known == 0).all() and (unlearned.train_tokens == 0).all()
    assert lm.fit_and_score(empty(spark), F.lit(True)).count() == 0


def test_sums_of_rows(monkeypatch):
    """Against one addition at a time, with short and long runs; and in far less time than segments of sorted rows take."""
    rng = np.random.default_rng(1)
    delta = rng.standard_normal((8192, 33)).astype(np.float32)
    rows = np.concatenate([(rng.zipf(1.3, 8192) % lm.BUCKETS), *rng.integers(0, lm.BUCKETS, (3, 8192))])
    want = np.zeros((lm.BUCKETS, 33))
    np.add.at(want, rows, np.tile(delta, (4, 1)))
    for layers in (1, 2, lm.LAYERS, 1 << 20):
        monkeypatch.setattr(lm, "LAYERS", layers)
        which, sums = lm._sums(rows, delta)
        assert sorted(which) == sorted(set(rows.tolist())) and np.allclose(sums, want[which], atol=1e-3)
    monkeypatch.undo()

    def segments():
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        np.add.reduceat(delta[order % len(delta)], starts, axis=0)

    def seconds(run):
        times = []
        for _ in range(7):
            begun = time.process_time()
            run()
            times.append(time.process_time() - begun)
        return min(times)

    weights, squares = np.zeros((2, lm.BUCKETS, 33), np.float32)
    assert seconds(lambda: lm._descend(weights, squares, rows, delta, 0.1)) < seconds(segments)
