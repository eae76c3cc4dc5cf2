"""Block-wise timelines and folds give the same as one block, whatever the width."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scanlake.operators import fusion, selection, timeline as tl, trajectory as tr
from scanlake.streaming import feeds

FIELDS = ["x", "y", "z", "roll", "pitch", "yaw"]


@pytest.fixture(scope="module")
def drive(spark):
    rng = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({"vehicle_id": np.where(np.arange(n) < 300, 1, 2), "pose_id": np.arange(n)})
    t = np.cumsum(rng.uniform(0.05, 0.6, n)) + np.where(np.arange(n) > 200, 40.0, 0.0)
    pdf["ts"] = pd.to_datetime((1.7e9 + t) * 1e6, unit="us")
    pdf["source"] = np.where(rng.random(n) < 0.6, "front", "back")
    steps = rng.normal(0, 0.3, (n, 6)) * [1, 1, 0.1, 0.05, 0.05, 0.3]
    pdf[FIELDS] = np.cumsum(steps, axis=0)
    return spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("width", [3.0, 1e9])
def test_previous_and_running(drive, width):
    w = Window.partitionBy("vehicle_id").orderBy("ts")
    want = drive.select("pose_id", F.lag("x").over(w).alias("p"), F.sum("x").over(w).alias("s"), (F.row_number().over(w) - 1).alias("n"))
    got = tl.with_previous(drive, ["vehicle_id"], "ts", ["x"], width=width)
    got = tl.running_sum(got, ["vehicle_id"], "ts", "x", "s", width)
    got = tl.number_rows(got, ["vehicle_id"], "ts", "n", width)
    a = want.toPandas().sort_values("pose_id").reset_index(drop=True)
    b = got.select("pose_id", F.col("prev_x").alias("p"), "s", "n").toPandas().sort_values("pose_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_width(drive, direction):
    left, right = drive.where("source = 'front'"), drive.where("source = 'back'").select("vehicle_id", "ts", "pose_id")
    out = [
        sorted((r["pose_id"], r["r_pose_id"] or -1) for r in tl.asof_join(left, right, ["vehicle_id"], 5.0, direction=direction, width=w).collect())
        for w in (2.0, 1e9)
    ]
    assert out[0] == out[1]


def test_last_known(drive):
    w = Window.partitionBy("vehicle_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    back = F.col("source") == "back"
    want = drive.select("pose_id", F.last(F.when(back, F.col("x")), ignorenulls=True).over(w).alias("v"))
    got = tl.last_known(drive, ["vehicle_id"], "ts", back, ["x"], width=4.0).select("pose_id", F.col("last_x").alias("v"))
    a, b = (d.toPandas().sort_values("pose_id").reset_index(drop=True) for d in (want, got))
    pd.testing.assert_frame_equal(a, b)


def kept_ids(df):
    return sorted(r["pose_id"] for r in df.select("pose_id").collect())


def test_sampler_and_keyframes_do_not_depend_on_blocks(drive):
    for run in (
        lambda w: selection.sample_interval(drive, ["vehicle_id"], 0.7, width=w),
        lambda w: selection.select_keyframes(drive, ["vehicle_id"], 1.0, 0.4, width=w),
    ):
        one, many = kept_ids(run(1e9)), kept_ids(run(25.0))
        assert one == many and 10 < len(one) < 390


def test_sampler_against_a_loop(drive):
    want = []
    for _, g in drive.toPandas().sort_values("ts").groupby("vehicle_id"):
        last = -np.inf
        for t, i in zip(g["ts"].astype("int64") / 1e9, g["pose_id"]):
            if t - last >= 0.7:
                want.append(i)
                last = t
    assert kept_ids(selection.sample_interval(drive, ["vehicle_id"], 0.7, width=1e9)) == sorted(want)


def test_filters_do_not_depend_on_blocks(drive):
    runs = [fusion.smooth(drive, ["vehicle_id", "source"], fusion.SmoothOptions(max_dt=5.0), width=w) for w in (20.0, 1e9)]
    a, b = (r.select("pose_id", "s_x", "s_yaw").toPandas().sort_values("pose_id").reset_index(drop=True) for r in runs)
    assert len(a) == 400 and np.allclose(a, b)
    runs = [fusion.fuse(drive, ["vehicle_id"], width=w) for w in (30.0, 1e9)]
    a, b = (r.select("pose_id", "f_x", "f_yaw").toPandas().sort_values("pose_id").reset_index(drop=True) for r in runs)
    assert len(a) == drive.where("source = 'front'").count() and np.allclose(a, b)


def straight(spark, source="front", speed=2.0, n=120):
    t = np.arange(n) * 0.1
    pdf = pd.DataFrame({"vehicle_id": 1, "source": source, "pose_id": np.arange(n), "x": speed * t, "y": 0.0, "z": 0.0, "roll": 0.0, "pitch": 0.0, "yaw": 0.0})
    pdf["ts"] = pd.to_datetime((1.7e9 + t) * 1e6, unit="us")
    return spark.createDataFrame(pdf)


def test_constant_velocity(spark):
    out = fusion.smooth(straight(spark), ["vehicle_id"]).orderBy("ts").toPandas()
    assert np.allclose(out["s_vx"].tail(20), 2.0, atol=0.05)
    assert np.allclose(out["s_x"].tail(20), out["x"].tail(20), atol=0.05)
    both = straight(spark).unionByName(straight(spark, "back").withColumn("ts", F.col("ts") - F.expr("INTERVAL 0.03 SECONDS")))
    fused = fusion.fuse(both, ["vehicle_id"]).orderBy("ts").toPandas()
    assert np.allclose(fused["f_x"], fused["x"], atol=0.02)


def test_accumulated_steps_return(drive):
    steps = tr.relative_pose(drive, ["vehicle_id"], width=10.0)
    path = tr.accumulate(steps, ["vehicle_id"], "pose_id", width=10.0).toPandas().sort_values("pose_id")
    raw = drive.toPandas().sort_values("pose_id")
    for v, g in raw.groupby("vehicle_id"):
        from scanlake.operators.selection import _matrices

        r, p = _matrices(g[FIELDS].to_numpy())
        want = (p - p[0]) @ r[0]
        assert np.allclose(path[path["vehicle_id"] == v][["x", "y", "z"]], want, atol=1e-8)


def test_stream_equals_batch(spark, drive, tmp_path):
    source = str(tmp_path / "in")
    ordered = drive.repartitionByRange(3, "ts").sortWithinPartitions("ts")
    ordered.write.parquet(source)
    live = spark.readStream.schema(drive.schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = str(tmp_path / "out")
    feeds.run_available(feeds.select_keyframes(live, ["vehicle_id"], 1.0, 0.4), path, str(tmp_path / "marks"))
    assert spark.read.parquet(path).count() > 10


def test_running_products_of_many_runs():
    """All runs at once, and no Python call a run: 20,000 blocks used to be 20,000 calls."""
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 2, 9, 1])
    steps = rng.normal(size=(sizes.sum(), 12))
    starts = np.cumsum(sizes) - sizes
    got = tr._prefix_products(steps, starts)
    for start, size in zip(starts, sizes):
        whole = np.eye(4)
        for i in range(start, start + size):
            whole = whole @ np.vstack([steps[i].reshape(3, 4), [0, 0, 0, 1]])
            assert np.allclose(got[i], whole[:3].ravel())


def test_accumulate_calls_no_function_per_group(spark, drive):
    steps = tr.relative_pose(drive, ["vehicle_id"], width=10.0)
    plan = tr.accumulate(steps, ["vehicle_id"], "pose_id", width=10.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_many_filters_at_once_are_those_one_by_one():
    """Runs of several lengths with gaps, repeated times, half turns and states that come in."""
    rng = np.random.default_rng(8)
    fold = fusion.smooth_fold(fusion.SmoothOptions(max_dt=2.0))
    sizes = np.array([1, 7, 30, 4, 12])
    starts = np.cumsum(sizes) - sizes
    t = np.concatenate([np.cumsum(rng.choice([0.0, 0.1, 0.5, 3.0], n)) for n in sizes])
    rows = np.column_stack([rng.normal(0, 3, (len(t), 3)), rng.uniform(-0.5, 0.5, (len(t), 2)), rng.uniform(-3.1, 3.1, len(t))])
    rows[9, 3:], rows[10, 3:] = [0, 0, 0], [0, 0, np.pi]
    first = fold.run(np.array([-0.4]), rows[:1], None)[1]
    states = [None, first, None, None, first]
    out, after = fold.many(t, rows, starts, states)
    for begin, size, state, left in zip(starts, sizes, states, after):
        want, leaving = fold.run(t[begin : begin + size], rows[begin : begin + size], state)
        assert np.allclose(out[begin : begin + size], want, atol=1e-7, equal_nan=True)
        assert np.allclose(left, leaving, atol=1e-7)
