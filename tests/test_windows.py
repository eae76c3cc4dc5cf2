"""Clouds of overlapping windows of keyframes, made where they are aligned."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanlake.operators import neighbours as nb
from scanlake.operators.scans import min_count
from scanlake.plans import alignment

POSE = ["x", "y", "z", "roll", "pitch", "yaw"]


def drive(rng, vehicle, frames, each=12):
    pose = np.column_stack([rng.uniform(-3, 3, (frames, 2)), rng.uniform(-0.2, 0.2, (frames, 1)), rng.uniform(-0.05, 0.05, (frames, 3))])
    kf = pd.DataFrame(pose, columns=POSE).assign(vehicle_id=vehicle, kf_id=np.arange(frames))
    at = np.repeat(np.arange(frames), rng.integers(each // 2, each, frames))
    points = pd.DataFrame(rng.uniform(-8, 8, (len(at), 3)), columns=list("xyz")).assign(vehicle_id=vehicle, kf_id=at)
    return kf, points.assign(z=points.z / 8, point_idx=np.arange(len(points)))


def by_tables(pairs, kf, points, n, leaf, least, most, **options):
    """The same by the operators for windows, submaps and alignment, one after the other."""
    keys = ["vehicle_id"]

    def made(name, n, least):
        around = nb.key_window(pairs.select(*keys, F.col(name), F.col(name).alias("kf_id")).distinct(), kf, n, keys)
        around = around.drop("kf_id").withColumnRenamed("near_id", "kf_id")
        cloud = nb.assemble_submap(around, kf, points, leaf=leaf, keys=keys, group=[name])
        return min_count(cloud, [*keys, name], least).select(*keys, name, F.struct("vx", "vy", "vz").alias("point_id"), "x", "y", "z")

    source, target = made("cur_id", 0, least), made("loop_id", n, most)
    return alignment.align_clouds(pairs, source, [*keys, "cur_id"], target, [*keys, "loop_id"], yaw="yaw", **options)


@pytest.mark.parametrize("together", [64, 3])
def test_windows_are_those_of_the_tables(spark, together):
    """Near and far sources, windows across stretches, a candidate of many pairs, small clouds, unknown keyframes."""
    rng = np.random.default_rng(7)
    sides = [drive(rng, 1, 150), drive(rng, 2, 9)]
    kf, points = (spark.createDataFrame(pd.concat(s)) for s in zip(*sides))
    pairs = [(1, int(c), int(g), 0.1) for c, g in rng.integers(0, 150, (40, 2))] + [(1, c, 64, 0.0) for c in range(100, 110)]
    pairs += [(2, 8, 0, 0.0), (2, 3, 7, 0.2), (2, 4, 99, 0.0), (1, 999, 3, 0.0)]
    pairs = spark.createDataFrame(pairs, "vehicle_id long, cur_id long, loop_id long, yaw double").dropDuplicates(["vehicle_id", "cur_id", "loop_id"])
    options = dict(size=2.0, max_d=6.0, rounds=12)
    want = by_tables(pairs, kf, points, 5, 1.0, 6, 20, **options).toPandas()
    got = alignment.align_windows(pairs, kf, points, ["vehicle_id"], 5, 1.0, 6, 20, together=together, **options).toPandas()
    names = ["vehicle_id", "cur_id", "loop_id"]
    want, got = (d.sort_values(names).reset_index(drop=True) for d in (want, got))
    assert 30 < len(want) < pairs.count()
    assert got[[*names, "rounds", "converged"]].equals(want[[*names, "rounds", "converged"]])
    assert np.allclose(got[[*alignment.NAMES, "fitness"]], want[[*alignment.NAMES, "fitness"]], atol=1e-7)


def test_points_are_not_sent_once_for_each_window(spark, monkeypatch):
    """What goes to the tasks grows with the points, not with the windows that hold them."""
    rng = np.random.default_rng(3)
    kf, points = drive(rng, 1, 256)
    kf, points = kf.assign(kf_id=kf.kf_id.astype("int64")), points.assign(kf_id=points.kf_id.astype("int64"))
    sent = []
    dealt = alignment._dealt
    monkeypatch.setattr(alignment, "_dealt", lambda df, at: (sent.append(df.where("_kind = 1").count()), dealt(df, at))[1])
    pairs = spark.createDataFrame([(1, k, (k + 100) % 256, 0.0) for k in range(256)], "vehicle_id long, cur_id long, loop_id long, yaw double")
    alignment.align_windows(pairs, spark.createDataFrame(kf), spark.createDataFrame(points), ["vehicle_id"], 25, 0.5, 3, 50, rounds=1).count()
    assert sent[0] < 2 * len(points)
