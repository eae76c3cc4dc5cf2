"""Queries on scans: sources, filters, projections, deskew."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.catalog.registry import ORACLES, q6, q6s, query, r6, rounded, sql_matvec, sql_rotation
from scanlake.functions.angles import clamp
from scanlake.operators import images, scans, voxels
from scanlake.session import scratch_table
from scanlake.sources import readers, shapes as fx, sinks

XYZ = ["x", "y", "z"]
DAY = 86400.0


@query(
    "flagship_range_image_voxels",
    f"""SELECT scan_id, CAST(floor(x / CAST(2 AS DOUBLE)) AS BIGINT) AS vx, CAST(floor(y / CAST(2 AS DOUBLE)) AS BIGINT) AS vy,
       CAST(floor(z / CAST(2 AS DOUBLE)) AS BIGINT) AS vz, {', '.join(f'{q6(f"avg({c})")} AS {c}' for c in XYZ)}, count(*) AS n
FROM pixels GROUP BY 1, 2, 3, 4""",
    ("pixels",),
)
def flagship(spark, d):
    image = images.first_hit(fx.points(spark, d))
    return rounded(voxels.voxel_downsample(image, ["scan_id"], 2.0), ["scan_id", "vx", "vy", "vz", "n"], XYZ)


@query(
    "read_points",
    f"SELECT scan_id, point_idx, ring, {q6s([*XYZ, 'intensity', 't_rel'])} FROM points",
    ("points",),
)
def read_points(spark, d):
    """All points, written in folders of scans and read back."""
    path = scratch_table(spark, "points")
    sinks.write_points(fx.points(spark, d), path)
    return rounded(readers.read_points(spark, path), ["scan_id", "point_idx", "ring"], [*XYZ, "intensity", "t_rel"])


@query(
    "read_poses",
    f"SELECT vehicle_id, pose_id, source, {q6s([*XYZ, 'roll', 'pitch', 'yaw'])} FROM poses",
    ("poses",),
)
def read_poses(spark, d):
    flat = fx.poses(spark, d)
    from scanlake.functions.rotations import rpy_quat

    q = rpy_quat(F.col("roll"), F.col("pitch"), F.col("yaw"))
    nested = flat.select(
        "vehicle_id", "pose_id", "ts", "source",
        F.struct(*XYZ).alias("position"),
        F.struct(*[c.alias(n) for c, n in zip(q, "xyzw")]).alias("orientation"),
    )
    return rounded(
        readers.flatten_poses(nested), ["vehicle_id", "pose_id", "source"], [*XYZ, "roll", "pitch", "yaw"]
    )


@query(
    "normalise_sensor",
    f"""SELECT scan_id, point_idx, ring, {q6s([*XYZ, 'intensity'])},
       round(CAST(CAST(round(t_rel * 1e9) AS BIGINT) AS DOUBLE) * CAST(1e-9 AS DOUBLE), 9) AS t_rel FROM points""",
    ("points",),
)
def normalise_sensor(spark, d):
    raw = fx.points(spark, d).withColumns(
        {"t": F.round(F.col("t_rel") * 1e9).cast("bigint"), "ring": F.col("ring").cast("smallint"),
         **{"reflectivity": F.lit(0), "noise": F.lit(0)}}
    )
    out = scans.normalise_sensor(raw, "ouster").withColumn("t_rel", F.round("t_rel", 9))
    return out.select("scan_id", "point_idx", "ring", *[r6(c).alias(c) for c in (*XYZ, "intensity")], "t_rel")


@query(
    "check_scan",
    """SELECT scan_id, count(*) AS n_points, count(*) FILTER (WHERE isnan(zz)) AS n_bad,
       true AS has_ring, true AS has_time, count(*) FILTER (WHERE isnan(zz)) = 0 AS is_dense
FROM (SELECT *, CASE WHEN abs(x) < CAST(0.01 AS DOUBLE) THEN CAST('nan' AS DOUBLE) ELSE z END AS zz FROM points) GROUP BY scan_id""",
    ("points",),
)
def check_scan(spark, d):
    nan = F.when(F.abs("x") < 0.01, F.lit(float("nan"))).otherwise(F.col("z"))
    return scans.check_scan(fx.points(spark, d).withColumn("z", nan))


@query(
    "range_filter",
    f"SELECT scan_id, point_idx, {q6s(XYZ)} FROM points WHERE sqrt(x*x + y*y + z*z) BETWEEN 5 AND 30",
    ("points",),
)
def range_filter(spark, d):
    return rounded(scans.range_filter(fx.points(spark, d), 5, 30), ["scan_id", "point_idx"], XYZ)


@query(
    "ring_filter",
    "SELECT scan_id, point_idx, ring FROM points WHERE ring BETWEEN 0 AND 11 AND ring % 2 = 0",
    ("points",),
)
def ring_filter(spark, d):
    return scans.ring_filter(fx.points(spark, d), 12, 2).select("scan_id", "point_idx", "ring")


@query(
    "image_column",
    """SELECT scan_id, point_idx, CASE WHEN c >= 1024 THEN c - 1024 ELSE c END AS col
FROM (SELECT *, CAST(-round((degrees(atan2(x, y)) - 90) / CAST(0.3515625 AS DOUBLE)) AS BIGINT) + 512 AS c FROM points)""",
    ("points",),
)
def image_column(spark, d):
    return fx.points(spark, d).select(
        "scan_id", "point_idx", scans.image_column(F.col("x"), F.col("y"), 1024).alias("col")
    )


_ANGLE = "degrees(atan(z / sqrt(x*x + y*y)))"


@query(
    "ring_from_elevation",
    f"""SELECT 16 AS lines, scan_id, point_idx, CAST(trunc((a + 15) / 2 + 0.5) AS INTEGER) AS ring FROM (SELECT *, {_ANGLE} AS a FROM points)
WHERE CAST(trunc((a + 15) / 2 + 0.5) AS INTEGER) BETWEEN 0 AND 15
UNION ALL SELECT 32, scan_id, point_idx, CAST(trunc((a + CAST(92 AS DOUBLE) / 3) * 3 / 4) AS INTEGER) FROM (SELECT *, {_ANGLE} AS a FROM points)
WHERE CAST(trunc((a + CAST(92 AS DOUBLE) / 3) * 3 / 4) AS INTEGER) BETWEEN 0 AND 31
UNION ALL SELECT 64, scan_id, point_idx, r FROM (SELECT *, CASE WHEN a >= -8.83 THEN CAST(trunc((2 - a) * 3 + 0.5) AS INTEGER)
  ELSE 32 + CAST(trunc((CAST(-8.83 AS DOUBLE) - a) * 2 + 0.5) AS INTEGER) END AS r FROM (SELECT *, {_ANGLE} AS a FROM points))
WHERE a <= 2 AND a >= -24.33 AND r BETWEEN 0 AND 50""",
    ("points",),
)
def ring_from_elevation(spark, d):
    pts = fx.points(spark, d)
    parts = [
        scans.ring_from_elevation(pts, n).select(F.lit(n).alias("lines"), "scan_id", "point_idx", "ring")
        for n in (16, 32, 64)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "drop_close",
    f"SELECT scan_id, point_idx, {q6s(XYZ)} FROM points WHERE NOT (isnan(x) OR isnan(y) OR isnan(z)) AND x*x + y*y + z*z >= 100",
    ("points",),
)
def drop_close(spark, d):
    return rounded(scans.drop_close(fx.points(spark, d), 10.0), ["scan_id", "point_idx"], XYZ)


@query(
    "permute_axes",
    f"SELECT scan_id, point_idx, {q6('y')} AS x, {q6('z')} AS y, {q6('x')} AS z FROM points",
    ("points",),
)
def permute_axes(spark, d):
    return rounded(scans.permute_axes(fx.points(spark, d)), ["scan_id", "point_idx"], XYZ)


@query(
    "rel_time",
    f"SELECT scan_id, point_idx, {q6('abs(t_rel - CAST(0.05 AS DOUBLE))')} AS t_rel FROM points",
    ("points",),
)
def rel_time(spark, d):
    return fx.points(spark, d).select(
        "scan_id", "point_idx", r6(scans.rel_time(F.col("t_rel") - 0.05)).alias("t_rel")
    )


@query(
    "azimuth_time",
    f"""WITH o AS (SELECT scan_id, point_idx, -atan2(y, x) AS ori FROM points),
b AS (SELECT scan_id, s, CASE WHEN e - s > 3*pi() THEN e - 2*pi() WHEN e - s < pi() THEN e + 2*pi() ELSE e END AS e
      FROM (SELECT scan_id, arg_min(ori, point_idx) AS s, arg_max(ori, point_idx) + 2*pi() AS e FROM o GROUP BY scan_id)),
n AS (SELECT o.*, s, e, CASE WHEN ori < s - pi()/2 THEN ori + 2*pi() WHEN ori > s + pi()*1.5 THEN ori - 2*pi() ELSE ori END AS near
      FROM o JOIN b USING (scan_id)),
f AS (SELECT *, coalesce(bool_or(near - s > pi()) OVER (PARTITION BY scan_id ORDER BY point_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS half FROM n),
v AS (SELECT *, CASE WHEN NOT half THEN near WHEN ori + 2*pi() < e - pi()*1.5 THEN ori + 4*pi() WHEN ori + 2*pi() > e + pi()/2 THEN ori ELSE ori + 2*pi() END AS un FROM f)
SELECT scan_id, point_idx, {q6('CAST(0.1 AS DOUBLE) * (un - s) / (e - s)')} AS t_azimuth FROM v""",
    ("points",),
)
def azimuth_time(spark, d):
    return rounded(scans.azimuth_time(fx.points(spark, d)), ["scan_id", "point_idx"], ["t_azimuth"])


def _scans(spark, d):
    """Scan times: one scan per front sample of its vehicle."""
    return fx.poses(spark, d).where("source = 'front'").select("vehicle_id", F.col("pose_id").alias("scan_id"), "ts")


_MOTION = """a AS (SELECT s.vehicle_id, s.pose_id AS scan_id, p.* EXCLUDE (vehicle_id, pose_id, ts, source) FROM poses s JOIN poses p
      ON p.vehicle_id = s.vehicle_id AND s.source = 'front' AND p.source = 'back' AND abs(p.t - s.t) <= 43200),
m AS (SELECT vehicle_id, scan_id, max(t) - min(t) AS odom_dt,
      arg_min(x,t) AS ax, arg_min(y,t) AS ay, arg_min(z,t) AS az, arg_min(roll,t) AS aroll, arg_min(pitch,t) AS apitch, arg_min(yaw,t) AS ayaw,
      arg_max(x,t) AS bx, arg_max(y,t) AS by_, arg_max(z,t) AS bz, arg_max(roll,t) AS broll, arg_max(pitch,t) AS bpitch, arg_max(yaw,t) AS byaw
      FROM a GROUP BY 1, 2)"""


def _between_sql() -> dict[str, str]:
    from scanlake.catalog.registry import sql_between

    return {k: v.replace("by -", "by_ -") for k, v in sql_between("a", "b").items()}


@query(
    "scan_motion",
    f"WITH {_MOTION} SELECT vehicle_id, scan_id, {q6('odom_dt')} AS odom_dt, "
    + ", ".join(f"{q6(v)} AS d{k}" for k, v in _between_sql().items())
    + " FROM m",
    ("poses",),
)
def scan_motion(spark, d):
    poses = fx.poses(spark, d)
    out = scans.scan_motion(_scans(spark, d), poses.where("source = 'back'"), ["vehicle_id"], DAY / 2)
    return rounded(out, ["vehicle_id", "scan_id"], ["odom_dt", "dx", "dy", "dz", "droll", "dpitch", "dyaw"])


_TURN = sql_matvec(sql_rotation("(-droll*k)", "(-dpitch*k)", "(-dyaw*k)"), XYZ)


@query(
    "deskew",
    f"""WITH m AS (SELECT vehicle_id AS scan_id, avg(roll) AS droll, avg(pitch) AS dpitch, avg(yaw) AS dyaw FROM poses GROUP BY 1)
SELECT scan_id, point_idx, {', '.join(f'{q6(v)} AS {c}' for v, c in zip(_TURN, XYZ))}
FROM (SELECT p.*, droll, dpitch, dyaw, t_rel / CAST(0.1 AS DOUBLE) AS k FROM points p JOIN m USING (scan_id))""",
    ("points", "poses"),
)
def deskew(spark, d):
    motion = fx.poses(spark, d).groupBy(F.col("vehicle_id").alias("scan_id")).agg(
        *[F.avg(c).alias("d" + c) for c in ("roll", "pitch", "yaw")], F.first(F.lit(0.1)).alias("odom_dt")
    )
    return rounded(scans.deskew(fx.points(spark, d), motion), ["scan_id", "point_idx"], XYZ)


_MOVE = sql_matvec(sql_rotation("k.roll", "k.pitch", "k.yaw"), ["p.x", "p.y", "p.z"])


@query(
    "transform_points",
    f"""SELECT vehicle_id, kf_id, point_idx, {', '.join(f'{q6(v + " + k." + c)} AS {c}' for v, c in zip(_MOVE, XYZ))}
FROM keyframe_points p JOIN keyframes k USING (vehicle_id, kf_id)""",
    ("keyframe_points", "keyframes"),
)
def transform_points(spark, d):
    out = scans.transform_points(fx.keyframe_points(spark, d), fx.keyframes(spark, d), ["vehicle_id", "kf_id"])
    return rounded(out, ["vehicle_id", "kf_id", "point_idx"], XYZ)


@query(
    "clamp",
    "SELECT pose_id, " + ", ".join(
        f"{q6(f'greatest(least({c}, CAST({lim} AS DOUBLE)), CAST(-{lim} AS DOUBLE))')} AS {c}"
        for c, lim in (("roll", 0.01), ("pitch", 0.02), ("z", 0.5))
    ) + " FROM poses",
    ("poses",),
)
def clamp_query(spark, d):
    return fx.poses(spark, d).select(
        "pose_id", *[r6(clamp(F.col(c), lim)).alias(c) for c, lim in (("roll", 0.01), ("pitch", 0.02), ("z", 0.5))]
    )


@query(
    "deadband",
    "SELECT pose_id, " + ", ".join(
        f"{q6(f'CASE WHEN abs({c}) < {lim} THEN 0 ELSE {c} END')} AS d{c}"
        for c, lim in (("x", 2.0), ("y", 2.0), ("z", 2.0), ("roll", 0.015), ("pitch", 0.015), ("yaw", 0.015))
    ) + " FROM poses",
    ("poses",),
)
def deadband(spark, d):
    steps = fx.poses(spark, d).select(
        "pose_id", *[F.col(c).alias("d" + c) for c in (*XYZ, "roll", "pitch", "yaw")]
    )
    out = scans.deadband(steps, 2.0, 0.015)
    return rounded(out, ["pose_id"], ["dx", "dy", "dz", "droll", "dpitch", "dyaw"])


_DIAG = ["x - 1", "y", "z", "abs(roll)", "abs(pitch)", "abs(yaw)"]


@query(
    "choose_noise",
    "WITH a AS (SELECT pose_id, "
    + ", ".join(f"{c} AS c{i}" for i, c in enumerate(_DIAG))
    + " FROM poses) SELECT pose_id, "
    + ", ".join(
        q6(
            f"greatest(CASE WHEN {' AND '.join(f'c{j} > 0' for j in range(6))} THEN c{i} ELSE {v} END, CAST(1e-12 AS DOUBLE))"
        ) + f" AS noise{i}"
        for i, v in enumerate([0.04, 0.04, 0.04, 0.01, 0.01, 0.01])
    )
    + " FROM a",
    ("poses",),
)
def choose_noise(spark, d):
    df = fx.poses(spark, d).select("pose_id", F.array(*[F.expr(c) for c in _DIAG]).alias("diagonal"))
    out = scans.choose_noise(df, [0.04, 0.04, 0.04, 0.01, 0.01, 0.01])
    return out.select("pose_id", *[r6(F.get("noise", i)).alias(f"noise{i}") for i in range(6)])


@query(
    "export_keyframes",
    ORACLES["transform_points"],
)
def export_keyframes(spark, d):
    """The exported cloud in the world frame, read back."""
    path = scratch_table(spark, "keyframes")
    sinks.write_keyframes(fx.keyframe_points(spark, d), fx.keyframes(spark, d), path)
    back = spark.read.parquet(f"{path}/global").withColumn("vehicle_id", F.col("vehicle_id").cast("bigint"))
    return rounded(back, ["vehicle_id", "kf_id", "point_idx"], XYZ)


@query(
    "min_count",
    """SELECT vehicle_id, kf_id, point_idx FROM keyframe_points JOIN
(SELECT vehicle_id, kf_id FROM keyframe_points GROUP BY 1, 2 HAVING count(*) >= 10) USING (vehicle_id, kf_id)""",
    ("keyframe_points",),
)
def min_count(spark, d):
    return scans.min_count(fx.keyframe_points(spark, d), ["vehicle_id", "kf_id"], 10).select(
        "vehicle_id", "kf_id", "point_idx"
    )
