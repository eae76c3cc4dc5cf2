"""Results against plain products of integers."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.llm import hard_negatives
from scanlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
ROW = "vec_id long, embedding array<float>, label int, score string, anchor int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, k=5):
    """Rows are (id, vector, label); a null id comes after all others."""
    good = [(i, [math.floor(256 * float(v)) for v in x], n) for i, x, n in rows if n is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    place = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for a, x, n in {(i, tuple(x), n) for i, x, n in good if is_anchor(i)}:
        scored = [(i, sum(p * q for p, q in zip(x, y)), m) for i, y, m in good if len(x) == len(y)]
        for pid, ps, _ in sorted((r for r in scored if r[2] == n and r[0] != a), key=place)[:k]:
            negatives = sorted((r for r in scored if r[2] != n and 80 * ps <= 100 * r[1] <= 100 * ps), key=place)[:k]
            out += [(a, pid, rank, nid, ps, ns) for rank, (nid, ns, _) in enumerate(negatives, 1)]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r[c] for c in NAMES) for r in frame.collect()), key=repr)


def test_query_equals_products(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    flipped = [(int(i), [float(v) for v in x], (int(n) + 1) % 10 if i % 7 == 0 else int(n)) for i, x, n in zip(table.vec_id, table.embedding, table.label)]
    got = rows_of(QUERIES["op13_hard_negatives"](spark, SF))
    assert got and got == brute(flipped, lambda i: i % 100 == 0)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cursor = con.execute(ORACLES["op13_hard_negatives"])
    order = [[d[0] for d in cursor.description].index(c) for c in NAMES]
    assert got == sorted((tuple(r[k] for k in order) for r in cursor.fetchall()), key=repr)


def test_many_parts_ties_and_copies(spark, monkeypatch):
    """Few values, so that scores tie; a third of the rows are one vector; anchors in several parts; two lengths."""
    monkeypatch.setattr(hard_negatives, "PART", 7)
    rng = np.random.default_rng(0)
    rows = [(k, (rng.integers(0, 3, 6) / 4).tolist(), int(rng.integers(0, 3))) for k in range(300)]
    rows += [(k, [0.25] * 6, 1) for k in range(300, 450)] + [(k, [float(v) for v in rng.standard_normal(3)], k % 2) for k in range(450, 500)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], ROW).repartition(5)
    got = rows_of(hard_negatives.mine(frame, F.col("id") % 10 == 0))
    assert got == brute(rows, lambda i: i % 10 == 0)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (2, [0.9, 0.5], 2), (None, [0.95, 0.5], 2),
        (None, [1.0, 0.5], 1), (3, None, 1), (4, [1.0, 0.5], None), (5, [float("nan"), 1.0], 2), (6, [None, 1.0], 2), (7, [float("inf"), 1.0], 2),
        (8, [], 1), (9, [], 2), (10, [0.0, 0.0], 3), (11, [0.0, 0.0], 4), (20, [-1.0, -1.0], 5), (21, [1.0, 1.0], 5), (30, [1.0, 2.0, 3.0], 5),
        (40, [], 1),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], ROW)
    assert rows_of(hard_negatives.mine(frame, F.col("id") % 10 == 0)) == brute(rows, lambda i: i is not None and i % 10 == 0)
    assert hard_negatives.mine(frame.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame.where("label IS NULL"), F.col("id") % 10 == 0).count() == 0
    with pytest.raises(OverflowError):
        hard_negatives.mine(spark.createDataFrame([(0, [1e30], 1, "x", 1)], ROW), F.col("id") == 0)


def test_residues_give_exact_products():
    rng = np.random.default_rng(1)
    for top, dim in ((3, 5), (300, 700), (2**20, 300), (2**24, 3000)):
        a, b = (rng.integers(-top, top + 1, (7, dim)).astype(float) for _ in range(2))
        bound = max((a * a).sum(axis=1).max(), (b * b).sum(axis=1).max())
        primes = hard_negatives._primes(bound)
        got = hard_negatives._scores(*([hard_negatives._residues(m, p) for p in primes] for m in (a, b)), primes)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert got.tolist() == want
