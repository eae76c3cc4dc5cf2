"""Readers prune folders and row groups; exports hold exactly the points with a keyframe."""

from pyspark.sql import functions as F

from scanlake.sources import readers, sinks
from scanlake.sources import shapes as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_by_scan(spark, tmp_path):
    points = fx.points(spark, SF).withColumn("scan_id", F.col("scan_id") * 50)
    sinks.write_points(points, str(tmp_path / "t"))
    back = readers.read_points(spark, str(tmp_path / "t"), scans=(100, 250))
    assert back.schema == readers.POINT_SCHEMA
    assert back.count() == points.where("scan_id BETWEEN 100 AND 250").count()
    text = plan(back)
    assert "PartitionFilters: [isnotnull(scans" in text and "GreaterThanOrEqual(scan_id,100)" in text
    assert len(back.inputFiles()) >= 1 and readers.read_points(spark, str(tmp_path / "t")).count() == points.count()


def test_poses_by_day(spark, tmp_path):
    poses = fx.poses(spark, SF)
    sinks.write_poses(poses, str(tmp_path / "t"))
    low, high = (str(d) for d in poses.agg(F.to_date(F.min("ts")) + 2, F.to_date(F.min("ts")) + 4).first())
    back = readers.read_poses(spark, str(tmp_path / "t"), days=(low, high), vehicles=[1, 3])
    assert back.schema == readers.POSE_SCHEMA
    want = poses.where(F.to_date("ts").between(F.lit(low).cast("date"), F.lit(high).cast("date")) & F.col("vehicle_id").isin(1, 3))
    assert back.count() == want.count() and "PartitionFilters: [isnotnull(day" in plan(back)


def test_points_without_a_keyframe_are_in_neither_export(spark, tmp_path):
    keyframes = fx.keyframes(spark, SF).where("kf_id <> 2")
    points = fx.keyframe_points(spark, SF)
    sinks.write_keyframes(points, keyframes, str(tmp_path / "t"))
    own, world = (spark.read.parquet(str(tmp_path / "t" / n)) for n in ("keyframes", "global"))
    assert own.count() == world.count() == points.where("kf_id <> 2").count() < points.count()


def test_exported_files_do_not_grow_with_drives(spark, tmp_path):
    keyframes, points = fx.keyframes(spark, SF), fx.keyframe_points(spark, SF)
    sinks.write_keyframes(points, keyframes, str(tmp_path / "t"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("keyframes", "global"):
        out = spark.read.parquet(str(tmp_path / "t" / name))
        assert len(out.inputFiles()) <= partitions < points.select("vehicle_id").distinct().count()
        assert dict(out.dtypes)["vehicle_id"] == dict(points.dtypes)["vehicle_id"] and out.count() == points.count()


def test_every_keyframe_has_points_and_every_point_a_keyframe(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        points, keyframes = fx.keyframe_points(spark, sf), fx.keyframes(spark, sf)
        assert points.join(keyframes, ["vehicle_id", "kf_id"], "left_anti").count() == 0
        assert keyframes.join(points, ["vehicle_id", "kf_id"], "left_anti").count() == 0
        assert points.count() == fx.points(spark, sf).count()
