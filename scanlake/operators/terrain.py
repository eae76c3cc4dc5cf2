"""Ground height, local surfaces and vehicle attitude gates on ground map tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.geometry import dot3
from scanlake.functions.matrices import eigen3
from scanlake.functions.poses import apply, from_columns
from scanlake.operators.fits import PAIRS, neighbour_moments
from scanlake.operators.neighbours import nearest_xy, radius_xy

GROUND_CELLS = (2.0, 4.0, 8.0, 16.0, 32.0)
Wheels = Sequence[tuple[float, float]]


def z_inliers(df: DataFrame, keys: Sequence[str], t: float, z: str = "n_z") -> DataFrame:
    """Rows whose height lies within ``t`` population deviations of their group's mean."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.avg(z).alias("_mean"), F.stddev_pop(z).alias("_dev"))
    low, high = F.col("_mean") - float(t) * F.col("_dev"), F.col("_mean") + float(t) * F.col("_dev")
    return df.join(stats, keys).where((F.col(z) >= low) & (F.col(z) <= high)).drop("_mean", "_dev")


def avg_height(
    queries: DataFrame, ground: DataFrame, keys: Sequence[str], query_id: str, point_id: str,
    radius: float, min_neighbours: int, cells: Sequence[float] = GROUND_CELLS,
) -> DataFrame:
    """Mean ground height around the point nearest to each query ``x, y``; the nearest height
    itself when fewer than ``min_neighbours`` points lie within ``radius`` of that point."""
    keys = list(keys)
    near = nearest_xy(queries, ground, keys, query_id, point_id, cells)
    centre = near.select(*keys, query_id, F.col("n_x").alias("x"), F.col("n_y").alias("y"), F.col("n_z").alias("_z"))
    around = radius_xy(centre, ground, keys, radius, query_id, point_id)
    mean = around.groupBy(*keys, query_id).agg(F.avg("n_z").alias("_avg"), F.count(F.lit(1)).alias("_n"))
    enough = F.col("_n") >= min_neighbours
    return centre.join(mean, [*keys, query_id], "left").select(
        *keys, query_id, F.when(enough, F.col("_avg")).otherwise(F.col("_z")).alias("height")
    )


def surface_z(
    queries: DataFrame, ground: DataFrame, keys: Sequence[str], query_id: str, point_id: str,
    radius: float = 0.6, outliers: float = 3.0, min_points: int = 15,
) -> DataFrame:
    """Height of the local plane at each query ``x, y``; only queries with a usable plane return.

    The plane goes through the centroid of the inliers along their smallest eigenvector.
    """
    keys = list(keys)
    at = [*keys, query_id]
    near = radius_xy(queries, ground, keys, radius, query_id, point_id)
    full = near.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    kept = z_inliers(near.join(full.select(*at), at, "left_semi"), at, outliers)
    cov = F.array(*[F.col(f"c{a}{b}") for a, b in PAIRS])
    fits = neighbour_moments(kept, at).where(F.col("n") >= min_points).withColumn("_e", eigen3(cov))
    normal = [F.get("_e.vectors", i) for i in range(3)]
    offset = -dot3(normal, [F.col("mx"), F.col("my"), F.col("mz")])
    joined = fits.select(
        *at, normal[0].alias("_a"), normal[1].alias("_b"), normal[2].alias("_c"), offset.alias("_d")
    ).join(queries.select(*at, "x", "y"), at)
    z = -(F.col("_a") * F.col("x") + F.col("_b") * F.col("y") + F.col("_d")) / F.col("_c")
    return joined.where(F.abs("_c") >= 1e-6).select(*at, z.alias("z"))


def wheel_points(wheels: Wheels, com_z: float = 0.0) -> Column:
    """The wheel contact points of a vehicle as an array of structs, below its body origin."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("wheel"), F.lit(float(x)).alias("wx"), F.lit(float(y)).alias("wy"), F.lit(-float(com_z)).alias("wz"))
            for i, (x, y) in enumerate(wheels)
        ]
    )


def initial_z(
    queries: DataFrame, ground: DataFrame, keys: Sequence[str], wheels: Wheels, query_id: str = "query_id",
    point_id: str = "point_idx", radius: float = 0.3, min_neighbours: int = 5, com_z: float = 1.0,
    drop: float = 1.0, cells: Sequence[float] = GROUND_CELLS,
) -> DataFrame:
    """Start height per query (``qx``, ``qy``, ``qyaw``): the lowest mean ground height below its
    wheels, plus the body height, minus ``drop``; 0 without any ground."""
    keys = list(keys)
    turned = queries.withColumn("_w", F.explode(wheel_points(wheels))).select(
        *keys, query_id, (F.col(query_id) * len(wheels) + F.col("_w.wheel")).alias("_wheel_id"),
        (F.col("qx") + F.cos("qyaw") * F.col("_w.wx") - F.sin("qyaw") * F.col("_w.wy")).alias("x"),
        (F.col("qy") + F.sin("qyaw") * F.col("_w.wx") + F.cos("qyaw") * F.col("_w.wy")).alias("y"),
    )
    heights = avg_height(turned, ground, keys, "_wheel_id", point_id, radius, min_neighbours, cells)
    lowest = (
        turned.select(*keys, query_id, "_wheel_id")
        .join(heights, [*keys, "_wheel_id"])
        .groupBy(*keys, query_id)
        .agg(F.min("height").alias("_h"))
    )
    return queries.join(lowest, [*keys, query_id], "left").withColumn(
        "z0", F.coalesce(F.col("_h") + float(com_z) - float(drop), F.lit(0.0))
    ).drop("_h")


def placed_wheels(poses: DataFrame, keys: Sequence[str], wheels: Wheels, query_id: str, com_z: float) -> DataFrame:
    """World position ``x, y, z`` of every wheel of posed vehicles, with the body normal ``bx..bz``."""
    names = ("x", "y", "z", "roll", "pitch", "yaw")
    pose = from_columns(*[F.col(c) for c in names])
    spread = poses.withColumn("_w", F.explode(wheel_points(wheels, com_z)))
    local = [F.col("_w.wx"), F.col("_w.wy"), F.col("_w.wz")]
    return spread.select(
        *keys, query_id, F.col("_w.wheel").alias("wheel"),
        (F.col(query_id) * len(wheels) + F.col("_w.wheel")).alias("wheel_id"),
        *[v.alias(c) for v, c in zip(apply(pose, local), ("x", "y", "z"))],
        *[pose.rotation[i][2].alias(f"b{c}") for i, c in enumerate("xyz")],
    )


def wheel_distances(
    poses: DataFrame, ground: DataFrame, keys: Sequence[str], wheels: Wheels, query_id: str = "query_id",
    point_id: str = "point_idx", com_z: float = 1.0, cells: Sequence[float] = GROUND_CELLS,
) -> DataFrame:
    """Signed distances of the wheels to their nearest ground points along the body normal, one
    array per query in wheel order."""
    keys = list(keys)
    placed = placed_wheels(poses, keys, wheels, query_id, com_z)
    near = nearest_xy(placed, ground, keys, "wheel_id", point_id, cells)
    gap = [F.col(c) - F.col(f"n_{c}") for c in ("x", "y", "z")]
    d = dot3(gap, [F.col("bx"), F.col("by"), F.col("bz")])
    rows = placed.join(near, [*keys, "wheel_id"]).select(*keys, query_id, "wheel", d.alias("d"))
    ordered = F.array_sort(F.collect_list(F.struct("wheel", "d")))
    return rows.groupBy(*keys, query_id).agg(F.transform(ordered, lambda s: s["d"]).alias("distances"))


def attitude_gate(
    df: DataFrame, z_min: float, z_max: float, roll: float, pitch: float, wheel_distance: float
) -> DataFrame:
    """Column ``ok`` and the first ``reason`` that failed, for settled attitudes.

    Needs ``z, roll, pitch, distances`` and ``end_reason``; running out of rounds is a failure, and so are no distances.
    """
    reason = (
        F.when(F.col("distances").isNull(), "ground")
        .when(~F.col("z").between(float(z_min), float(z_max)), "z")
        .when((F.abs("roll") > float(roll)) | (F.abs("pitch") > float(pitch)), "tilt")
        .when(~F.forall("distances", lambda v: F.abs(v) <= float(wheel_distance)), "wheels")
        .when(F.col("end_reason") == "max_iters", "max_iters")
    )
    return df.withColumn("reason", F.coalesce(reason, F.lit("none"))).withColumn("ok", F.col("reason") == "none")


def footprint(
    wheels: DataFrame, keys: Sequence[str], size_x: float = 2.0, size_y: float = 2.0, com_z: float = 1.0
) -> DataFrame:
    """Box around the wheels ``wx, wy`` per vehicle: centre and dimensions, at least 0.1 each."""
    agg = wheels.groupBy(*keys).agg(
        F.min("wx").alias("_x0"), F.max("wx").alias("_x1"), F.min("wy").alias("_y0"), F.max("wy").alias("_y1")
    )
    x0, x1 = F.coalesce("_x0", F.lit(-size_x / 2)), F.coalesce("_x1", F.lit(size_x / 2))
    y0, y1 = F.coalesce("_y0", F.lit(-size_y / 2)), F.coalesce("_y1", F.lit(size_y / 2))
    height = F.greatest(F.lit(float(com_z)), F.lit(0.1))
    return agg.select(
        *keys, (0.5 * (x0 + x1)).alias("cx"), (0.5 * (y0 + y1)).alias("cy"), (-0.5 * height).alias("cz"),
        F.greatest(x1 - x0, F.lit(0.1)).alias("size_x"), F.greatest(y1 - y0, F.lit(0.1)).alias("size_y"),
        height.alias("size_z"),
    )
