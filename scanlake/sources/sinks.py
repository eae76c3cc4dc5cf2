"""Exports: keyframe clouds, trajectory and pose graph text, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.operators.graph import graph_lines, trajectory_lines
from scanlake.operators.scans import transform_points
from scanlake.sources.readers import DAY_FOLDER, POINT_SCHEMA, POSE_SCHEMA, SCAN_FOLDER, SCANS


def write_keyframes(
    points: DataFrame, keyframes: DataFrame, path: str, keys: Sequence[str] = ("vehicle_id",)
) -> None:
    """Points in their own frames below ``path/keyframes`` and in the world frame below ``path/global``.

    Files and their row groups follow each other by drive and keyframe, so a reader of one drive or keyframe skips the rest
    by its statistics. A range partitioning makes as many files as the points' size asks for, however many drives there
    are, and splits large drives and keyframes. Points whose keyframe isn't among ``keyframes`` have no place in the world and are in neither output.
    """
    layout = [*keys, "kf_id"]
    known = points.join(keyframes.select(*layout).distinct(), layout, "left_semi")
    for name, cloud in (("keyframes", known), ("global", transform_points(known, keyframes, layout).select(known.columns))):
        order = [*layout, "point_idx"]
        sorted_ = cloud.repartitionByRange(*order).sortWithinPartitions(*order)
        sorted_.write.parquet(f"{path}/{name}")


def write_points(points: DataFrame, path: str) -> None:
    """Points in folders of ``SCANS`` scans, each sorted by scan, over as few files as their size asks for."""
    placed = points.select(POINT_SCHEMA.names).withColumn(SCAN_FOLDER, F.floor(F.col("scan_id") / SCANS))
    order = [SCAN_FOLDER, "scan_id", "point_idx"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(SCAN_FOLDER).parquet(path)


def write_poses(poses: DataFrame, path: str) -> None:
    """Odometry samples in a folder per day, sorted by vehicle and time."""
    placed = poses.select(POSE_SCHEMA.names).withColumn(DAY_FOLDER, F.to_date("ts"))
    order = [DAY_FOLDER, "vehicle_id", "ts"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(DAY_FOLDER).parquet(path)


def write_trajectory(df: DataFrame, path: str, keys: Sequence[str] = ("vehicle_id",), ts: str = "ts") -> None:
    """Trajectory text in time order, one folder per vehicle.

    A range partitioning on (vehicle, time) cuts long drives into several part files whose names
    keep the order.
    """
    lines = trajectory_lines(df, ts)
    ordered = lines.repartitionByRange(*keys, ts).sortWithinPartitions(*keys, ts)
    ordered.select(*keys, F.col("line").alias("value")).write.partitionBy(*keys).text(path)


def write_graph(keyframes: DataFrame, edges: DataFrame, path: str, keys: Sequence[str] = ("vehicle_id",)) -> None:
    """Pose graph text: vertices, then odometry, loop and prior edges; one folder per vehicle."""
    order = [*keys, "part", "a", "b"]
    lines = graph_lines(keyframes, edges, keys)
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(*keys, F.col("line").alias("value")).write.partitionBy(*keys).text(path)


def write_snapshot(keyframes: DataFrame, path: str) -> None:
    """Pose tables of a snapshot: positions, and full poses."""
    keyframes.select("vehicle_id", "kf_id", "x", "y", "z").write.parquet(f"{path}/positions")
    keyframes.select("vehicle_id", "kf_id", "ts", "x", "y", "z", "roll", "pitch", "yaw").write.parquet(f"{path}/poses")
