import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.functions.vectors import best_shift, best_shifts
from scanlake.operators import places


@pytest.fixture(scope="module")
def sparse():
    rng = np.random.default_rng(5)
    rows = []
    for item in range(6):
        cells = rng.choice(20 * 60, 5 if item == 4 else 300, replace=False)
        rows += [(item, int(c // 60), int(c % 60), float(h)) for c, h in zip(cells, rng.normal(2, 1, len(cells)))]
    return rows


def _distance(rows, a, b, shift):
    dense = np.zeros((2, 20, 60))
    for item, ring, sector, h in rows:
        if item == a:
            dense[0, ring, sector] = h
        if item == b:
            dense[1, ring, (sector + shift) % 60] = h
    lengths = np.sqrt((dense**2).sum(axis=1))
    common = (lengths > 0).all(axis=0)
    if not common.any():
        return None
    return 1 - float(((dense[0] * dense[1]).sum(axis=0)[common] / lengths.prod(axis=0)[common]).mean())


def test_distances_equal_loops_and_meet_as_whole_descriptors(spark, sparse):
    table = spark.createDataFrame(sparse, "item int, ring int, sector int, h double")
    asked = [(a, b, (7 * a + b) % 60) for a in range(7) for b in range(6) if a != b]
    pairs = spark.createDataFrame(asked, "a int, b int, shift int")
    plain = places.column_distance(pairs, table, "a", "b", "item")
    for a, b, shift, distance in plain.collect():
        wanted = _distance(sparse, a, b, shift)
        assert distance is None if wanted is None else distance == pytest.approx(wanted, abs=1e-12)
    assert plain.count() == len(asked)
    best = places.shifted_distance(pairs, table, "a", "b", "item")
    found = {(r.a, r.b): (r.distance, r.shift) for r in best.collect()}
    for a, b, shift in asked:
        tries = [(_distance(sparse, a, b, (shift + s) % 60), (shift + s) % 60) for s in range(-3, 4)]
        tries = [t for t in tries if t[0] is not None]
        if not tries:
            assert (a, b) not in found
        else:
            assert found[a, b][0] == pytest.approx(min(tries)[0], abs=1e-12) and found[a, b][1] == min(tries)[1]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan


def test_best_shifts_in_batches_are_those_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.integers(0, 2, 60).astype(float).tolist(), rng.integers(0, 2, 60).astype(float).tolist()) for _ in range(50)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert df.where(best_shift(F.col("a"), F.col("b")) != best_shifts(F.col("a"), F.col("b"))).count() == 0


def test_multiplied_rows_are_not_broadcast(spark):
    from scanlake.operators import neighbours as nb
    from scanlake.session import cut

    poses = ", ".join(f"cast(kf_id as double) {c}" for c in ("x", "y", "z", "roll", "pitch", "yaw"))
    keyframes = cut(spark.range(200).select(F.lit(1).cast("long").alias("vehicle_id"), F.col("id").alias("kf_id")).selectExpr("*", *poses.split(", ")))
    points = cut(keyframes.select("vehicle_id", "kf_id", "x", "y", "z"))
    wanted = cut(keyframes.select("vehicle_id", "kf_id", F.col("kf_id").alias("loop_id")))
    around = nb.key_window(wanted, keyframes, 25).drop("kf_id").withColumnRenamed("near_id", "kf_id")
    made = nb.assemble_submap(around, keyframes, points, leaf=1.0, group=["loop_id"])
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.agg(F.sum("n")).first()[0] == around.count() == 200 * 51 - 2 * sum(range(1, 26))
