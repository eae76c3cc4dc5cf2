"""Recall and scores against brute force."""

import numpy as np

from scanlake.llm import ann
from scanlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ROW = "vec_id long, embedding array<float>, score string"


def brute(ids, x, query, q_id, k):
    score = (x * query).sum(axis=1)
    rows = np.flatnonzero(ids != q_id)
    return [(int(ids[r]), float(score[r])) for r in rows[np.lexsort((ids[rows], -score[rows]))[:k]]]


def results(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = results(QUERIES["op9_ann"](spark, SF))
    assert set(got) == {i for i in ids if i % 20 == 0}
    found = 0
    for q, near in got.items():
        want = brute(ids, x, x[ids == q][0], q, 20)
        assert len(near) == 20 and near == sorted(near, key=lambda n: (-n[1], n[0])) and q not in dict(near)
        assert all(s == (x[ids == v][0] * x[ids == q][0]).sum() for v, s in near)
        found += len(set(dict(near)) & set(dict(want)))
    assert found / (20 * len(got)) >= 0.9


def test_many_blocks_and_chunks(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((300, 16)), np.repeat(rng.standard_normal((1, 16)), 100, axis=0)]).astype(np.float32)
    x[:50] *= 7
    rows = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], ROW)
    got = results(ann.search(ann.build(rows, block_rows=60), rows.where("vec_id % 20 = 0"), k=5, want=32, chunk=7))
    for q, near in got.items():
        assert near == brute(np.arange(400), x.astype(float), x[q].astype(float), q, 5)


def test_awkward_vectors(spark):
    good = [(1, [1.0, 0.0], "a"), (2, [0.5, 0.5], "a"), (2, [0.5, 0.5], "a"), (5, [2.0, 1.0], "a"), (None, [1.0, 1.0], "a"), (8, [1.0, 2.0, 3.0], "a")]
    bad = [(20, None, "a"), (40, [0.0, 0.0], "a"), (60, [float("nan"), 1.0], "a"), (80, [float("inf"), 1.0], "a"), (100, [None, 1.0], "a"), (120, [], "a")]
    rows = spark.createDataFrame(good + bad, ROW)
    got = results(ann.search(ann.build(rows), rows))
    assert got == {1: [(5, 2.0), (2, 0.5), (2, 0.5)], 2: [(5, 1.5), (1, 0.5)], 5: [(1, 2.0), (2, 1.5), (2, 1.5)]}
    assert ann.search(ann.build(rows.limit(0)), rows).count() == 0
    assert ann.search(ann.build(rows), rows.limit(0)).count() == 0
