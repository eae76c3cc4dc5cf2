"""Row-wise scan operators: schema normalisation, filters, projections and deskew."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.geometry import matvec, norm3
from scanlake.functions.poses import apply, between, from_columns
from scanlake.functions.rotations import rpy_matrix
from scanlake.operators.timeline import seconds

XYZ = ("x", "y", "z")


def normalise_sensor(df: DataFrame, kind: str) -> DataFrame:
    """Points of a sensor brought to the common schema.

    ``velodyne`` clouds carry seconds in ``time``; ``ouster`` clouds carry nanoseconds in ``t``.
    """
    if kind == "velodyne":
        t_rel = F.col("time").cast("double")
    elif kind == "ouster":
        t_rel = F.col("t").cast("double") * 1e-9
    else:
        raise ValueError(f"unknown sensor kind {kind!r}, use 'velodyne' or 'ouster'")
    return df.select(
        F.col("scan_id").cast("bigint").alias("scan_id"),
        F.col("point_idx").cast("bigint").alias("point_idx"),
        F.col("ring").cast("int").alias("ring"),
        *[F.col(c).cast("double").alias(c) for c in (*XYZ, "intensity")],
        t_rel.alias("t_rel"),
    )


def check_scan(df: DataFrame, time_field: str = "t_rel") -> DataFrame:
    """Per scan: point count, rows with NaN coordinates, and which fields the schema has."""
    bad = F.lit(False)
    for c in XYZ:
        bad = bad | F.isnan(c) | F.col(c).isNull()
    return df.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(bad).alias("n_bad"),
        F.lit("ring" in df.columns).alias("has_ring"),
        F.lit(time_field in df.columns).alias("has_time"),
    ).withColumn("is_dense", F.col("n_bad") == 0)


def range_filter(df: DataFrame, minimum: float, maximum: float) -> DataFrame:
    """Points whose distance from the sensor lies in the closed interval."""
    return df.where(norm3(*map(F.col, XYZ)).between(float(minimum), float(maximum)))


def ring_filter(df: DataFrame, n_rings: int, rate: int = 1) -> DataFrame:
    """Rings inside the sensor's count, thinned to every ``rate``-th one."""
    return df.where(F.col("ring").between(0, n_rings - 1) & (F.col("ring") % rate == 0))


def image_column(x: Column, y: Column, horizon: int) -> Column:
    """Range image column, counted from the negative y axis; out-of-range values are kept."""
    step = 360.0 / horizon
    raw = -F.round((F.degrees(F.atan2(x, y)) - 90.0) / step).cast("bigint") + horizon // 2
    return F.when(raw >= horizon, raw - horizon).otherwise(raw)


def ring_from_elevation(df: DataFrame, n_rings: int) -> DataFrame:
    """Ring from the elevation angle for 16, 32 and 64 line sensors; others points dropped."""
    angle = F.degrees(F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))))

    def whole(value: Column) -> Column:
        return value.cast("int")

    # The elevation layouts of the 16, 32 and 64 line sensors.
    if n_rings == 16:
        ring, keep = whole((angle + 15) / 2 + 0.5), F.lit(True)
        last = 15
    elif n_rings == 32:
        ring, keep = whole((angle + 92.0 / 3.0) * 3.0 / 4.0), F.lit(True)
        last = 31
    elif n_rings == 64:
        ring = F.when(angle >= -8.83, whole((2 - angle) * 3.0 + 0.5)).otherwise(
            F.lit(32) + whole((-8.83 - angle) * 2.0 + 0.5)
        )
        keep, last = angle.between(-24.33, 2.0), 50
    else:
        raise ValueError("n_rings must be 16, 32 or 64")
    return df.withColumn("ring", ring).where(keep & F.col("ring").between(0, last))


def drop_close(df: DataFrame, radius: float) -> DataFrame:
    """Points without NaN coordinates and not nearer than ``radius``."""
    clean = ~(F.isnan("x") | F.isnan("y") | F.isnan("z"))
    sq = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return df.where(clean).where(sq >= float(radius) ** 2)


def permute_axes(df: DataFrame) -> DataFrame:
    """LiDAR axes to camera axes: x takes y, y takes z, z takes x."""
    swap = {"x": F.col("y"), "y": F.col("z"), "z": F.col("x")}
    return df.withColumns(swap)


def rel_time(time: Column) -> Column:
    return F.abs(time)


def azimuth_time(df: DataFrame, scan_period: float = 0.1) -> DataFrame:
    """Time of a point inside its scan, from its azimuth unwrapped over one sensor turn.

    Once a point lies more than half a turn after the start, all later points of the scan are
    unwrapped on the far side. That flag needs only the first such point of a scan, so start,
    end and flag are three aggregates with a map-side part, joined back; no scan-wide window.
    """
    pi = math.pi
    ori = -F.atan2(F.col("y"), F.col("x"))
    bounds = df.groupBy("scan_id").agg(
        F.min_by(ori, "point_idx").alias("_start"), F.max_by(ori, "point_idx").alias("_last")
    )
    end = F.col("_last") + 2 * pi
    span = end - F.col("_start")
    end = F.when(span > 3 * pi, end - 2 * pi).when(span < pi, end + 2 * pi).otherwise(end)
    bounds = bounds.withColumn("_end", end).drop("_last")
    start = F.col("_start")
    near = F.when(ori < start - pi / 2, ori + 2 * pi).when(
        ori > start + pi * 1.5, ori - 2 * pi
    ).otherwise(ori)
    unwrapped = df.join(bounds, "scan_id").withColumn("_near", near)
    flags = unwrapped.groupBy("scan_id").agg(
        F.min(F.when(F.col("_near") - start > pi, F.col("point_idx"))).alias("_half")
    )
    far = ori + 2 * pi
    far = F.when(far < F.col("_end") - pi * 1.5, far + 2 * pi).when(
        far > F.col("_end") + pi / 2, far - 2 * pi
    ).otherwise(far)
    passed = F.coalesce(F.col("point_idx") > F.col("_half"), F.lit(False))
    value = F.when(passed, far).otherwise(F.col("_near"))
    return (
        unwrapped.join(flags, "scan_id")
        .withColumn("t_azimuth", scan_period * (value - start) / (F.col("_end") - start))
        .drop("_start", "_end", "_near", "_half")
    )


def scan_motion(
    scans: DataFrame, poses: DataFrame, keys: Sequence[str], tolerance: float, ts: str = "ts"
) -> DataFrame:
    """Motion per scan: from its first odometry sample within ``tolerance`` seconds before or
    after the scan to its newest one in the same interval.

    ``scans`` has the keys, ``scan_id`` and ``ts``. Time buckets make it an equi-join.
    """
    bucket = F.floor(seconds(ts) / F.lit(float(tolerance)))
    probes = scans.select(
        *keys, "scan_id", seconds(ts).alias("_st"),
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"),
    )
    fields = ("x", "y", "z", "roll", "pitch", "yaw")
    samples = poses.select(*keys, bucket.alias("_bucket"), seconds(ts).alias("_t"), *fields)
    found = (
        probes.join(samples, [*keys, "_bucket"])
        .where(F.abs(F.col("_t") - F.col("_st")) <= tolerance)
        .groupBy(*keys, "scan_id")
        .agg(
            F.min(F.struct("_t", *fields)).alias("_a"), F.max(F.struct("_t", *fields)).alias("_b"),
        )
        .select(
            *keys, "scan_id", (F.col("_b._t") - F.col("_a._t")).alias("odom_dt"),
            *[F.col(f"_{end}.{c}").alias(f"{end}_{c}") for end in "ab" for c in fields],
        )
    )
    motion = between(
        from_columns(*[F.col(f"a_{c}") for c in fields]),
        from_columns(*[F.col(f"b_{c}") for c in fields]),
    )
    return found.select(*keys, "scan_id", "odom_dt", *motion.columns("d"))


def deskew(points: DataFrame, motion: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Points turned back by the part of the scan's rotation that passed before them.

    ``motion`` has ``droll, dpitch, dyaw`` and ``odom_dt`` per scan. Translation is left alone on
    purpose. Points of scans without motion stay as they are.
    """
    ratio = F.col("t_rel") / F.when(F.col("odom_dt") > 0, F.col("odom_dt"))
    turned = matvec(
        rpy_matrix(*[-F.col(c) * ratio for c in ("droll", "dpitch", "dyaw")]), [F.col(c) for c in XYZ]
    )
    joined = points.join(motion.select(*keys, "droll", "dpitch", "dyaw", "odom_dt"), list(keys), "left")
    moved = {c: F.coalesce(v, F.col(c)) for c, v in zip(XYZ, turned)}
    return joined.withColumns(moved).drop("droll", "dpitch", "dyaw", "odom_dt")


def transform_points(points: DataFrame, poses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points moved by the pose that shares their keys."""
    fields = ("x", "y", "z", "roll", "pitch", "yaw")
    renamed = poses.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in fields])
    pose = from_columns(*[F.col(f"_p_{c}") for c in fields])
    moved = apply(pose, [F.col(c) for c in XYZ])
    return (
        points.join(renamed, list(keys))
        .withColumns(dict(zip(XYZ, moved)))
        .drop(*[f"_p_{c}" for c in fields])
    )


def deadband(df: DataFrame, linear: float, angular: float) -> DataFrame:
    """Small increments set to zero: ``dx, dy, dz`` by ``linear``, the angles by ``angular``."""
    limits = {c: linear for c in ("dx", "dy", "dz")} | {c: angular for c in ("droll", "dpitch", "dyaw")}
    return df.withColumns(
        {c: F.when(F.abs(c) < lim, F.lit(0.0)).otherwise(F.col(c)) for c, lim in limits.items()}
    )


def choose_noise(df: DataFrame, default: Sequence[float], floor: float = 1e-12) -> DataFrame:
    """Six noise variances per row: those of the message when all are finite and positive, else
    ``default``; never below ``floor``. ``diagonal`` is the message's array."""
    usable = F.forall(
        "diagonal", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf) & (v > 0)
    ) & (F.size("diagonal") == 6)
    base = F.when(F.coalesce(usable, F.lit(False)), F.col("diagonal")).otherwise(
        F.array(*[F.lit(float(v)) for v in default])
    )
    return df.withColumn("noise", F.transform(base, lambda v: F.greatest(v, F.lit(floor))))


def min_count(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of the groups that have at least ``n`` rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return df.join(big.select(*keys), list(keys), "left_semi")
