"""Point and pose sources, in batch and as file streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_SCHEMA = T.StructType(
    [
        T.StructField("scan_id", T.LongType()),
        T.StructField("point_idx", T.LongType()),
        T.StructField("ring", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("intensity", T.DoubleType()),
        T.StructField("t_rel", T.DoubleType()),
    ]
)

POSE_SCHEMA = T.StructType(
    [
        T.StructField("vehicle_id", T.LongType()),
        T.StructField("pose_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "roll", "pitch", "yaw")],
    ]
)


#: Scans of a folder, and the columns that name folders of points and of poses.
SCANS, SCAN_FOLDER, DAY_FOLDER = 64, "scans", "day"


def read_points(
    spark: SparkSession, path: str, stream: bool = False, scans: tuple[int, int] | None = None
) -> DataFrame:
    """Points below ``path`` as ``write_points`` lays them out, or as a table without folders.

    The schema is declared, so no file is read to find it. ``scans`` asks for a range of scan numbers, both included:
    other folders aren't listed among the files to read, and other row groups are skipped by their statistics.
    """
    reader = spark.readStream if stream else spark.read
    points = reader.schema(POINT_SCHEMA).parquet(path)
    if scans is not None:
        low, high = scans
        points = points.where(F.col("scan_id").between(low, high))
        if SCAN_FOLDER in points.columns:
            points = points.where(F.col(SCAN_FOLDER).between(low // SCANS, high // SCANS))
    return points.select(POINT_SCHEMA.names)


def read_poses(
    spark: SparkSession, path: str, stream: bool = False, days: tuple[str, str] | None = None,
    vehicles: Sequence[int] | None = None, nested: bool = False,
) -> DataFrame:
    """Odometry samples below ``path``, a row per sample, as ``write_poses`` lays them out or as a table without folders.

    ``days`` (first and last, as dates) leaves only their folders to be read, ``vehicles`` the row groups that can hold
    them. ``nested`` reads messages with structs as recorded, whose schema is theirs, and flattens them.
    """
    if nested:
        return flatten_poses(spark.read.parquet(path))
    reader = spark.readStream if stream else spark.read
    poses = reader.schema(POSE_SCHEMA).parquet(path)
    if days is not None:
        low, high = (F.lit(d).cast("date") for d in days)
        poses = poses.where(F.to_date("ts").between(low, high))
        if DAY_FOLDER in poses.columns:
            poses = poses.where(F.col(DAY_FOLDER).cast("date").between(low, high))
    if vehicles is not None:
        poses = poses.where(F.col("vehicle_id").isin(list(vehicles)))
    return poses.select(POSE_SCHEMA.names)


def flatten_poses(df: DataFrame) -> DataFrame:
    """Nested odometry messages as flat columns; flat tables pass through.

    A message has structs ``position`` (x, y, z), ``orientation`` (x, y, z, w) and optionally
    ``linear`` and ``angular``.
    """
    if "position" not in df.columns:
        return df
    from scanlake.functions.rotations import quat_normalise, quat_rpy

    q = quat_normalise([F.col(f"orientation.{c}") for c in "xyzw"])
    roll, pitch, yaw = quat_rpy(q)
    out = [F.col(c) for c in ("vehicle_id", "pose_id", "ts", "source") if c in df.columns]
    out += [F.col(f"position.{c}").cast("double").alias(c) for c in "xyz"]
    out += [roll.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw")]
    out += [c.alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"))]
    for group, short in (("linear", "v"), ("angular", "w")):
        if group in df.columns:
            out += [F.col(f"{group}.{c}").cast("double").alias(short + c) for c in "xyz"]
    return df.select(*out)
