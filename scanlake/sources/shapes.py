"""Views that shape the TPC-H-like driver tables as scans, odometry feeds and ground maps.

Every view covers its whole table. Each one is a plain projection or a join, but for the numbers of keyframes and
of their points.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.operators.timeline import number_rows
from scanlake.session import cut

BLOCK = 10 * 86400.0
"""Seconds per timeline block for the sparse fixture feeds (hours between samples)."""

FOLD_BLOCK = 6 * 86400.0
"""Seconds per fold block: a drive of 30 days hands its state on five times or so."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: scans are suppliers, coordinates come from prices."""
    price = F.col("l_extendedprice")
    z = (F.col("l_quantity") - 25.0) / 10.0 + 0.0029
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").alias("scan_id"),
            (
                ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")) * 100
                + F.col("l_quantity").cast("bigint")
            ).alias("point_idx"),
            (F.col("l_partkey") % 16).cast("int").alias("ring"),
            ((F.round(price * 100).cast("bigint") % 8000 - 4000).cast("double") / 100.0 + 0.0037).alias("x"),
            (((F.round(price).cast("bigint") * 37) % 8000 - 4000).cast("double") / 100.0 + 0.0041).alias("y"),
            z.alias("z"),
            ((F.col("l_partkey") % 16).cast("double") * z).alias("intensity"),
            ((F.col("l_orderkey") % 1000).cast("double") / 10000.0).alias("t_rel"),
        )
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: two odometry sources per user."""
    return shape_poses(table(spark, sf_dir, "events"))


def shape_poses(events: DataFrame) -> DataFrame:
    """Events, from a table or a stream, as odometry samples."""
    e = F.col("event_id")
    front = F.col("event_type").isin("click", "view", "purchase")
    return events.select(
        F.col("user_id").alias("vehicle_id"),
        e.alias("pose_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(front, "front").otherwise("back").alias("source"),
        ((e % 2003).cast("double") / 40.0).alias("x"),
        ((e % 1009).cast("double") / 40.0).alias("y"),
        (F.col("value") / 500.0).alias("z"),
        (((e * 7) % 61 - 30).cast("double") / 1000.0).alias("roll"),
        (((e * 11) % 61 - 30).cast("double") / 1000.0).alias("pitch"),
        (((e * 13) % 629 - 314).cast("double") / 100.0).alias("yaw"),
    )


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front samples with a dense number per vehicle."""
    front = poses(spark, sf_dir).where(F.col("source") == "front").drop("source")
    return number_rows(front, ["vehicle_id"], "ts", "kf_id", BLOCK)


def keyframe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point, dealt in turn to the keyframes of the vehicle that its order's number selects.

    So each keyframe of each vehicle has a cloud, and each point a keyframe. Written once, as queries read it several times.
    """
    feed = poses(spark, sf_dir)
    vehicles = feed.agg(F.max("vehicle_id") + 1).first()[0]
    sizes = feed.where(F.col("source") == "front").groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("_n"))
    dealt = points(spark, sf_dir).withColumn("vehicle_id", F.expr(f"point_idx div 8000000000 % {vehicles}"))
    turn = F.row_number().over(Window.partitionBy("vehicle_id").orderBy("point_idx", "x", "y")) - 1
    clouds = dealt.withColumn("_turn", turn).join(sizes, "vehicle_id").select(
        "vehicle_id", (F.col("_turn") % F.col("_n")).cast("bigint").alias("kf_id"), "point_idx", "ring", "x", "y", "z", "intensity",
    )
    return cut(clouds)


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest rings of every scan as one ground tile each."""
    return (
        points(spark, sf_dir)
        .where(F.col("ring") < 4)
        .select(F.col("scan_id").alias("tile_id"), "point_idx", "x", "y", "z", F.col("ring").alias("label"))
    )


def ground_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vehicle position per customer, on the tile that its number selects."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("query_id"),
        F.floor(c / 15).cast("bigint").alias("tile_id"),
        (((c * 37) % 8000 - 4000).cast("double") / 100.0 + 0.0013).alias("qx"),
        (((c * 53) % 8000 - 4000).cast("double") / 100.0 + 0.0017).alias("qy"),
        ((c % 629 - 314).cast("double") / 100.0).alias("qyaw"),
    )


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("desc_id"), F.col("embedding").alias("key"), "label"
    )


WHEELS = [(0.4, 0.3), (0.4, -0.3), (-0.4, 0.3), (-0.4, -0.3)]
"""Wheel contact points of the fixture vehicle in its body frame."""

PI = math.pi

# The same views for the SQL oracle.
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "points": (
        (),
        """SELECT l_suppkey AS scan_id,
       ((l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS point_idx,
       CAST(l_partkey % 16 AS INTEGER) AS ring,
       CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 8000 - 4000 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.0037 AS DOUBLE) AS x,
       CAST((CAST(round(l_extendedprice) AS BIGINT) * 37) % 8000 - 4000 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.0041 AS DOUBLE) AS y,
       (l_quantity - CAST(25 AS DOUBLE)) / CAST(10 AS DOUBLE) + CAST(0.0029 AS DOUBLE) AS z,
       CAST(l_partkey % 16 AS DOUBLE) * ((l_quantity - CAST(25 AS DOUBLE)) / CAST(10 AS DOUBLE) + CAST(0.0029 AS DOUBLE)) AS intensity,
       CAST(l_orderkey % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS t_rel
FROM lineitem""",
    ),
    "poses": (
        (),
        """SELECT user_id AS vehicle_id, event_id AS pose_id, ts, epoch_us(ts) / 1e6 AS t,
       CASE WHEN event_type IN ('click','view','purchase') THEN 'front' ELSE 'back' END AS source,
       CAST(event_id % 2003 AS DOUBLE) / CAST(40 AS DOUBLE) AS x,
       CAST(event_id % 1009 AS DOUBLE) / CAST(40 AS DOUBLE) AS y,
       value / CAST(500 AS DOUBLE) AS z,
       CAST((event_id * 7) % 61 - 30 AS DOUBLE) / CAST(1000 AS DOUBLE) AS roll,
       CAST((event_id * 11) % 61 - 30 AS DOUBLE) / CAST(1000 AS DOUBLE) AS pitch,
       CAST((event_id * 13) % 629 - 314 AS DOUBLE) / CAST(100 AS DOUBLE) AS yaw
FROM events""",
    ),
    "keyframes": (
        ("poses",),
        """SELECT vehicle_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts) - 1 AS kf_id,
       pose_id, ts, t, x, y, z, roll, pitch, yaw
FROM poses WHERE source = 'front'""",
    ),
    "keyframe_points": (
        ("points", "keyframes"),
        """SELECT vehicle_id, (row_number() OVER (PARTITION BY vehicle_id ORDER BY point_idx, x, y) - 1) % n AS kf_id,
       point_idx, ring, x, y, z, intensity
FROM (SELECT *, point_idx // 8000000000 % (SELECT max(vehicle_id) + 1 FROM poses) AS vehicle_id FROM points)
JOIN (SELECT vehicle_id, count(*) AS n FROM keyframes GROUP BY 1) USING (vehicle_id)""",
    ),
    "ground": (
        ("points",),
        "SELECT scan_id AS tile_id, point_idx, x, y, z, ring AS label FROM points WHERE ring < 4",
    ),
    "ground_queries": (
        (),
        """SELECT c_custkey AS query_id, c_custkey // 15 AS tile_id,
       CAST((c_custkey * 37) % 8000 - 4000 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.0013 AS DOUBLE) AS qx,
       CAST((c_custkey * 53) % 8000 - 4000 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.0017 AS DOUBLE) AS qy,
       CAST(c_custkey % 629 - 314 AS DOUBLE) / CAST(100 AS DOUBLE) AS qyaw
FROM customer""",
    ),
    "descriptors": ((), "SELECT vec_id AS desc_id, embedding AS key, label FROM embeddings"),
    "pixels": (
        ("points",),
        """SELECT scan_id, ring, col, min(point_idx) AS point_idx, arg_min(x, point_idx) AS x,
       arg_min(y, point_idx) AS y, arg_min(z, point_idx) AS z, arg_min(rng, point_idx) AS rng,
       arg_min(intensity, point_idx) AS intensity, arg_min(t_rel, point_idx) AS t_rel
FROM (SELECT *, CASE WHEN col0 >= 1024 THEN col0 - 1024 ELSE col0 END AS col
      FROM (SELECT *, sqrt(x*x + y*y + z*z) AS rng,
                   CAST(-round((degrees(atan2(x, y)) - 90) / CAST(0.3515625 AS DOUBLE)) AS BIGINT) + 512 AS col0
            FROM points)
      WHERE rng BETWEEN 1 AND 100 AND ring BETWEEN 0 AND 15)
WHERE col BETWEEN 0 AND 1023
GROUP BY scan_id, ring, col""",
    ),
    "indexed": (
        ("pixels",),
        """SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ring, col) - 1 AS idx FROM pixels""",
    ),
}


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views and those they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in SQL_VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in ordered)
