"""Loops by descriptor: drives of few scans in one task each, others by tables."""

import numpy as np
import pandas as pd

from scanlake.operators import places
from scanlake.plans import loops


def clouds(spark):
    rng = np.random.default_rng(6)
    parts = []
    for drive, frames in ((1, 40), (2, 25), (3, 2), (4, 60)):
        world = rng.uniform(-60, 60, (3, 60, 3)) * [1, 1, 0.05] + [0, 0, 2.5]
        for k in range(frames):
            a = rng.uniform(0, 2 * np.pi)
            turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
            xyz = world[rng.integers(3)][rng.random(60) < 0.8] @ turn.T
            parts.append(pd.DataFrame(xyz, columns=list("xyz")).assign(vehicle_id=drive, kf_id=2 * k))
    return spark.createDataFrame(pd.concat(parts))


def found(df):
    return df.toPandas().sort_values(["vehicle_id", "kf_id"]).reset_index(drop=True)[["vehicle_id", "kf_id", "loop_id", "distance", "yaw"]]


def test_drives_in_one_task_have_the_loops_of_the_tables(spark, monkeypatch):
    points = clouds(spark)
    small = found(loops.mine_by_descriptor(points, ["vehicle_id"], "kf_id", 4, 3, 0.6))
    tables = found(loops._mine_by_tables(places.scan_descriptor(points, ["vehicle_id", "kf_id"]), ["vehicle_id"], "kf_id", 4, 3, 0.6))
    monkeypatch.setattr(places, "ITEMS", 30)
    mixed = found(loops.mine_by_descriptor(points, ["vehicle_id"], "kf_id", 4, 3, 0.6))
    assert len(small) > 60 and set(small.vehicle_id) == {1, 2, 4} and (small.loop_id <= small.kf_id - 4).all()
    pd.testing.assert_frame_equal(small, tables)
    pd.testing.assert_frame_equal(mixed, tables)


def test_small_drives_are_sent_once(spark):
    """After the descriptors of small drives are made, nothing is joined or grouped."""
    plan = loops.mine_by_descriptor(clouds(spark), ["vehicle_id"], "kf_id", 4, 3, 0.6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "CoGroup" not in plan and "MapInArrow" in plan
