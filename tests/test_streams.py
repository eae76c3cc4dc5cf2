"""Folds on live feeds: equal to the batch over several triggers, late rows dropped, state gone in time."""

import numpy as np
import pandas as pd
import pytest

from scanlake.functions.poses import FIELDS
from scanlake.operators import selection
from scanlake.operators.folds import Fold, chained_fold
from scanlake.streaming import feeds

T0 = 1_700_000_000.0


def drives(spark, vehicles=(1, 2, 3), n=90, seed=0):
    rng = np.random.default_rng(seed)
    frames = []
    for v in vehicles:
        t = T0 + np.cumsum(rng.random(n)) * 10
        pdf = pd.DataFrame(rng.standard_normal((n, 6)) * [2, 2, 0.1, 0.1, 0.1, 0.5], columns=["x", "y", "z", "roll", "pitch", "yaw"])
        frames.append(pdf.assign(vehicle_id=v, pose_id=v * 1000 + np.arange(n), ts=pd.to_datetime(np.round(t * 1e6), unit="us")))
    return spark.createDataFrame(pd.concat(frames))


def ids(df):
    return sorted(r.pose_id for r in df.select("pose_id").collect())


def play(spark, parts, transform, tmp_path):
    """Feeds the parts one after the other; the rows that came out and the progress of all triggers."""
    progress = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(parts[0].schema).parquet(str(tmp_path / "in"))
        out = transform(live)
        progress += feeds.run_available(out, str(tmp_path / "out"), str(tmp_path / "marks"))
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")), progress


def by_time(df, cuts):
    marks = [T0 - 1e6, *(T0 + c for c in cuts), T0 + 1e6]
    return [df.where(f"unix_micros(ts) / 1e6 >= {a!r} AND unix_micros(ts) / 1e6 < {b!r}") for a, b in zip(marks, marks[1:])]


def test_three_triggers_equal_the_batch(spark, tmp_path):
    drive = drives(spark)
    out, progress = play(spark, by_time(drive, [100, 200]), lambda s: feeds.select_keyframes(s, ["vehicle_id"], 3.0, 0.8), tmp_path)
    assert ids(out) == ids(selection.select_keyframes(drive, ["vehicle_id"], 3.0, 0.8, width=50.0))
    assert sum(p["numInputRows"] > 0 for p in progress) == 3


def test_sampler_goes_on_between_triggers(spark, tmp_path):
    drive = drives(spark, seed=1)
    out, _ = play(spark, by_time(drive, [60, 61, 300]), lambda s: feeds.sample_interval(s, ["vehicle_id"], 17.0), tmp_path)
    assert ids(out) == ids(selection.sample_interval(drive, ["vehicle_id"], 17.0, width=40.0))


def test_late_rows_and_silent_keys_go(spark, tmp_path):
    """Vehicle 2 falls silent: its state goes with the watermark, and it starts anew. A row far behind is dropped."""
    def rows(vehicle, seconds, first):
        return [(vehicle, first + k, pd.Timestamp((T0 + s) * 1e9).to_pydatetime(), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for k, s in enumerate(seconds)]

    ddl = "vehicle_id long, pose_id long, ts timestamp, x double, y double, z double, roll double, pitch double, yaw double"
    parts = [
        spark.createDataFrame(rows(1, [0, 10], 10) + rows(2, [0, 10], 20), ddl),
        spark.createDataFrame(rows(1, [500, 1000], 12), ddl),
        spark.createDataFrame(rows(1, [1010], 14) + rows(2, [1005], 22) + rows(1, [100], 99), ddl),
        spark.createDataFrame(rows(1, [1020], 15) + rows(2, [1020], 23), ddl),
    ]
    out, progress = play(
        spark, parts, lambda s: feeds.select_keyframes(s, ["vehicle_id"], 3.0, 0.8, lateness="20 seconds", expire=600.0), tmp_path
    )
    assert ids(out) == [10, 20, 22]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert min(held[2:]) < held[0] and sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) == 1


@pytest.mark.parametrize("forgets", [False, True])
def test_blocks_hand_the_state_on(spark, forgets):
    """A fold that never forgets gives the same whether states go block by block or all blocks are settled together."""
    def run(t, values, state):
        begin = 0.0 if state is None else state[0]
        total = begin + np.cumsum(values[:, 0])
        return total[:, None], total[-1:]

    drive = drives(spark).withColumnRenamed("pose_id", "big").selectExpr("*", "big + 9007199254740993 AS pose_id", "CAST(NULL AS STRING) AS note").drop("big")
    got = chained_fold(drive, ["vehicle_id"], "ts", 60.0, Fold(["x"], ["total double"], run, forgets=forgets)).toPandas()
    assert len(got) == 270 and got.note.isna().all()
    for _, g in got.sort_values("ts").groupby("vehicle_id"):
        assert np.allclose(g.total, g.x.cumsum()) and (g.pose_id.diff().dropna() == 1).all()


def test_folds_of_many_short_runs_equal_one_by_one(spark):
    fold = selection.keyframe_fold(3.0, 0.8)
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((300, 6))
    starts = np.array([0, 1, 40, 41, 290])
    states = [None, np.zeros(6), None, rows[5], rows[7]]
    keep, after = fold.many(np.arange(300.0), rows, starts, states)
    for begin, end, state, left in zip(starts, [*starts[1:], 300], states, after):
        alone, leaving = fold.run(np.arange(300.0)[begin:end], rows[begin:end], state)
        assert (keep[begin:end] == alone).all() and (leaving == left).all()


def test_many_keys_share_a_row_of_state(spark, tmp_path):
    """Keys of a bucket go through one call and lie in one row of state, null keys among them."""
    drive = drives(spark, range(400), 4, seed=5).selectExpr("nullif(vehicle_id, 7) AS vehicle_id", *FIELDS, "pose_id", "ts")
    out, progress = play(spark, by_time(drive, [12]), lambda s: feeds.sample_interval(s, ["vehicle_id"], 9.0), tmp_path)
    assert ids(out.where("vehicle_id is not null")) == ids(selection.sample_interval(drive.where("vehicle_id is not null"), ["vehicle_id"], 9.0))
    assert 0 < out.where("vehicle_id is null").count() < 4
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert 0 < max(held) <= feeds.BUCKETS
