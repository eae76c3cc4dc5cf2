"""Queries on odometry feeds and keyframes."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.catalog.registry import (
    q6, q6s, query, r6, rounded, sql_between, sql_matmul, sql_matvec, sql_rotation, sql_rpy, sql_transpose,
)
from scanlake.functions import geometry as g
from scanlake.functions import rotations as rot
from scanlake.functions.angles import azimuth360, deg2rad, rad2deg, wrap_angle
from scanlake.functions.poses import FIELDS, between, compose, from_columns, inverse
from scanlake.functions.rotations import boxminus, boxplus, rpy_quat
from scanlake.functions.vectors import covariance_block
from scanlake.operators import timeline as tl
from scanlake.operators import trajectory as tr
from scanlake.session import scratch_table
from scanlake.sources import shapes as fx
from scanlake.sources.readers import read_poses
from scanlake.sources.sinks import write_poses

XYZ = ["x", "y", "z"]
STEP = ["d" + f for f in FIELDS]
BLOCK = fx.BLOCK
VS = ["vehicle_id", "source"]
V = ["vehicle_id"]
HALF_DAY, DAY = 43200.0, 86400.0


def front(spark, d):
    return fx.poses(spark, d).where("source = 'front'").drop("source")


def back(spark, d):
    return fx.poses(spark, d).where("source = 'back'").drop("source")


def steps(spark, d):
    return tr.relative_pose(fx.poses(spark, d), VS, width=BLOCK)


# ---- scalar functions -------------------------------------------------------------------------


@query(
    "norm_and_distance",
    f"SELECT pose_id, {q6('sqrt(x*x + y*y + z*z)')} AS norm, {q6('sqrt((x-z)*(x-z) + (y-x)*(y-x) + (z-y)*(z-y))')} AS dist FROM poses",
    ("poses",),
)
def norm_and_distance(spark, d):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return fx.poses(spark, d).select(
        "pose_id", r6(g.norm3(x, y, z)).alias("norm"), r6(g.dist3([x, y, z], [z, x, y])).alias("dist")
    )


@query(
    "angle_units",
    f"""SELECT pose_id, {q6('x * pi() / 180')} AS rad, {q6('yaw * 180 / pi()')} AS deg,
  {q6('atan2(sin(yaw * 3), cos(yaw * 3))')} AS wrapped,
  {q6('CASE WHEN atan2(yaw, roll) < 0 THEN atan2(yaw, roll) + 2 * pi() ELSE atan2(yaw, roll) END * 180 / pi()')} AS azimuth FROM poses""",
    ("poses",),
)
def angle_units(spark, d):
    return fx.poses(spark, d).select(
        "pose_id", r6(deg2rad(F.col("x"))).alias("rad"), r6(rad2deg(F.col("yaw"))).alias("deg"),
        r6(wrap_angle(F.col("yaw") * 3)).alias("wrapped"),
        r6(azimuth360(F.col("roll"), F.col("yaw"))).alias("azimuth"),
    )


_R = sql_rotation("roll", "pitch", "yaw")


@query(
    "rotation_matrix",
    "SELECT pose_id, " + ", ".join(f"{q6(m)} AS r{i // 3}{i % 3}" for i, m in enumerate(_R)) + ", "
    + ", ".join(f"{q6(m)} AS {n}" for m, n in zip(sql_rpy(_R), ("roll", "pitch", "yaw"))) + " FROM poses",
    ("poses",),
)
def rotation_matrix(spark, d):
    m = rot.rpy_matrix(F.col("roll"), F.col("pitch"), F.col("yaw"))
    product = g.matmul(rot.rot_z(F.col("yaw")), g.matmul(rot.rot_y(F.col("pitch")), rot.rot_x(F.col("roll"))))
    return fx.poses(spark, d).select(
        "pose_id",
        *[r6(product[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)],
        *[r6(v).alias(n) for v, n in zip(rot.matrix_rpy(m), ("roll", "pitch", "yaw"))],
    )


_HALF = {f"{f}{n}": f"{f}({a}/2)" for n, a in (("r", "roll"), ("p", "pitch"), ("y", "yaw")) for f in ("sin", "cos")}
_Q = [
    "({sinr}*{cosp}*{cosy} - {cosr}*{sinp}*{siny})".format(**_HALF),
    "({cosr}*{sinp}*{cosy} + {sinr}*{cosp}*{siny})".format(**_HALF),
    "({cosr}*{cosp}*{siny} - {sinr}*{sinp}*{cosy})".format(**_HALF),
    "({cosr}*{cosp}*{cosy} + {sinr}*{sinp}*{siny})".format(**_HALF),
]


@query(
    "quaternions",
    f"""WITH q AS (SELECT pose_id, x, y, z, roll, pitch, yaw, {', '.join(f'{e} AS q{n}' for e, n in zip(_Q, 'xyzw'))} FROM poses),
n AS (SELECT *, sqrt(x*x + y*y + z*z) AS len FROM q)
SELECT pose_id, {q6s(['qx', 'qy', 'qz', 'qw', 'roll', 'pitch', 'yaw'])},
 {q6('qw*qx + qx*qw - qy*qz + qz*qy')} AS sx, {q6('qw*qy + qx*qz + qy*qw - qz*qx')} AS sy,
 {q6('qw*qz - qx*qy + qy*qx + qz*qw')} AS sz, {q6('qw*qw - qx*qx - qy*qy - qz*qz')} AS sw,
 {q6('CASE WHEN len < CAST(1 AS DOUBLE) THEN 0 ELSE x/len END')} AS nx, {q6('CASE WHEN len < CAST(1 AS DOUBLE) THEN 1 ELSE 0 END')} AS nw FROM n""",
    ("poses",),
)
def quaternions(spark, d):
    base = fx.poses(spark, d).select("pose_id", *FIELDS)
    q = rot.rpy_quat(F.col("roll"), F.col("pitch"), F.col("yaw"))
    staged = base.select("pose_id", *XYZ, *[v.alias(f"q{n}") for v, n in zip(q, "xyzw")])
    q = [F.col(f"q{n}") for n in "xyzw"]
    unit = rot.quat_normalise([F.col(c) for c in XYZ] + [F.lit(0.0)], tiny=1.0)
    return staged.select(
        "pose_id", *[r6(v).alias(f"q{n}") for v, n in zip(q, "xyzw")],
        *[r6(v).alias(n) for v, n in zip(rot.quat_rpy(q), ("roll", "pitch", "yaw"))],
        *[r6(v).alias(f"s{n}") for v, n in zip(rot.quat_multiply(q, q), "xyzw")],
        r6(unit[0]).alias("nx"), r6(unit[3]).alias("nw"),
    )


@query(
    "slerp",
    f"""WITH q AS (SELECT pose_id, {', '.join(f'{e} AS a{n}' for e, n in zip(_Q, 'xyzw'))},
  CAST(0 AS DOUBLE) AS bx, CAST(0 AS DOUBLE) AS by_, sin(yaw/2) AS bz, cos(yaw/2) AS bw FROM poses),
d AS (SELECT *, az*bz + aw*bw AS dp FROM q), t AS (SELECT *, acos(least(abs(dp), CAST(1 AS DOUBLE))) AS th FROM d),
w AS (SELECT *, CASE WHEN abs(dp) > 1 - 1e-12 THEN 0.8 ELSE sin(CAST(0.8 AS DOUBLE)*th)/sin(th) END AS wa,
  CASE WHEN abs(dp) > 1 - 1e-12 THEN 0.2 ELSE sin(CAST(0.2 AS DOUBLE)*th)/sin(th) END * CASE WHEN dp < 0 THEN -1 ELSE 1 END AS wb FROM t)
SELECT pose_id, {q6('wa*ax + wb*bx')} AS x, {q6('wa*ay + wb*by_')} AS y, {q6('wa*az + wb*bz')} AS z, {q6('wa*aw + wb*bw')} AS w FROM w""",
    ("poses",),
)
def slerp(spark, d):
    level = rot.rpy_quat(F.lit(0.0), F.lit(0.0), F.col("yaw"))
    own = rot.rpy_quat(F.col("roll"), F.col("pitch"), F.col("yaw"))
    blend = rot.slerp(own, level, 0.2)
    return fx.poses(spark, d).select("pose_id", *[r6(v).alias(n) for v, n in zip(blend, "xyzw")])


@query(
    "so3_maps",
    f"""WITH a AS (SELECT pose_id, roll AS wx, pitch AS wy, yaw AS wz, sqrt(roll*roll + pitch*pitch + yaw*yaw) AS th FROM poses),
e AS (SELECT *, sin(th/2)/th AS s, cos(th/2) AS qw FROM a),
q AS (SELECT *, s*wx AS qx, s*wy AS qy, s*wz AS qz FROM e),
l AS (SELECT *, sqrt(qx*qx + qy*qy + qz*qz) AS n FROM q)
SELECT pose_id, {q6s(['qx', 'qy', 'qz', 'qw'])}, {q6('2*atan(n/qw)/n*qx')} AS lx, {q6('2*atan(n/qw)/n*qy')} AS ly,
 {q6('2*atan(n/qw)/n*qz')} AS lz, {q6('-wz')} AS k01, {q6('wy')} AS k02, {q6('-wx')} AS k12 FROM l""",
    ("poses",),
)
def so3_maps(spark, d):
    w = [F.col("roll"), F.col("pitch"), F.col("yaw")]
    q = rot.so3_exp(w)
    k = rot.skew(w)
    staged = fx.poses(spark, d).select(
        "pose_id", *[v.alias(f"q{n}") for v, n in zip(q, "xyzw")],
        k[0][1].alias("k01"), k[0][2].alias("k02"), k[1][2].alias("k12"),
    )
    log = rot.so3_log([F.col(f"q{n}") for n in "xyzw"])
    return staged.select(
        "pose_id", *[r6(f"q{n}").alias(f"q{n}") for n in "xyzw"],
        *[r6(v).alias(f"l{n}") for v, n in zip(log, "xyz")], *[r6(c).alias(c) for c in ("k01", "k02", "k12")],
    )


@query(
    "boxplus_boxminus",
    f"SELECT pose_id, {q6('roll')} AS wx, {q6('pitch')} AS wy, {q6('roll - pitch')} AS wz FROM poses",
    ("poses",),
)
def boxplus_boxminus(spark, d):
    base = fx.poses(spark, d)
    q = rot.rpy_quat(F.col("roll"), F.col("pitch"), F.col("yaw"))
    w = [F.col("roll"), F.col("pitch"), F.col("roll") - F.col("pitch")]
    turned = base.select(
        "pose_id", *[v.alias(f"q{n}") for v, n in zip(q, "xyzw")],
        *[v.alias(f"p{n}") for v, n in zip(rot.boxplus(q, w), "xyzw")],
    )
    step = rot.quat_multiply(
        rot.quat_inverse([F.col(f"q{n}") for n in "xyzw"]), [F.col(f"p{n}") for n in "xyzw"]
    )
    steps_ = turned.select("pose_id", *[v.alias(f"s{n}") for v, n in zip(step, "xyzw")])
    back_again = rot.so3_log([F.col(f"s{n}") for n in "xyzw"])
    return steps_.select("pose_id", *[r6(v).alias(f"w{n}") for v, n in zip(back_again, "xyz")])


_K = ["0", "(-yaw)", "pitch", "yaw", "0", "(-roll)", "(-pitch)", "roll", "0"]
_K2 = sql_matmul(_K, _K)
_JAC = [f"({1 if i in (0, 4, 8) else 0} + ca*{_K[i]} + cb*{_K2[i]})" for i in range(9)]
_EXP = [f"({1 if i in (0, 4, 8) else 0} + sth/th*{_K[i]} + ca*{_K2[i]})" for i in range(9)]


@query(
    "se3_exp",
    f"""WITH a AS (SELECT *, sqrt(roll*roll + pitch*pitch + yaw*yaw) AS th FROM poses),
b AS (SELECT *, sin(th) AS sth, (1 - cos(th))/(th*th) AS ca, (th - sin(th))/(th*th*th) AS cb FROM a)
SELECT pose_id, {', '.join(f'{q6(m)} AS r{i // 3}{i % 3}' for i, m in enumerate(_EXP))},
 {', '.join(f'{q6(v)} AS t{c}' for v, c in zip(sql_matvec(_JAC, XYZ), XYZ))} FROM b""",
    ("poses",),
)
def se3_exp(spark, d):
    r, t = rot.se3_exp([F.col("roll"), F.col("pitch"), F.col("yaw")], [F.col(c) for c in XYZ])
    return fx.poses(spark, d).select(
        "pose_id", *[r6(r[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)],
        *[r6(v).alias(f"t{c}") for v, c in zip(t, XYZ)],
    )


_RA = sql_rotation("roll", "pitch", "yaw")
_RB = sql_rotation("(roll*2)", "(pitch*2)", "(yaw/2)")
_CT = [f"({v} + {c})" for v, c in zip(sql_matvec(_RA, ["y", "z", "x"]), XYZ)]
_IT = [f"(-{v})" for v in sql_matvec(sql_transpose(_RA), XYZ)]


@query(
    "pose_algebra",
    "SELECT pose_id, "
    + ", ".join(f"{q6(v)} AS c{f}" for v, f in zip([*_CT, *sql_rpy(sql_matmul(_RA, _RB))], FIELDS)) + ", "
    + ", ".join(f"{q6(v)} AS i{f}" for v, f in zip([*_IT, *sql_rpy(sql_transpose(_RA))], FIELDS))
    + " FROM poses",
    ("poses",),
)
def pose_algebra(spark, d):
    a = from_columns(*[F.col(f) for f in FIELDS])
    b = from_columns(F.col("y"), F.col("z"), F.col("x"), F.col("roll") * 2, F.col("pitch") * 2, F.col("yaw") / 2)
    return fx.poses(spark, d).select(
        "pose_id",
        *[r6(v).alias(f"c{f}") for f, v in compose(a, b).fields().items()],
        *[r6(v).alias(f"i{f}") for f, v in inverse(a).fields().items()],
    )


@query(
    "point_line_plane",
    f"""SELECT pose_id, {q6('sqrt((y-1)*(y-1) + (z-2)*(z-2))')} AS line_d, {q6('(y-1)/sqrt((y-1)*(y-1) + (z-2)*(z-2))')} AS line_ny,
 {q6('(x + 2*y + 2*z)/3 + CAST(0.5 AS DOUBLE)')} AS plane_d FROM poses""",
    ("poses",),
)
def point_line_plane(spark, d):
    p = [F.col(c) for c in XYZ]
    centre, along = [F.lit(0.0), F.lit(1.0), F.lit(2.0)], [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    n = [F.lit(1.0 / 3), F.lit(2.0 / 3), F.lit(2.0 / 3)]
    return fx.poses(spark, d).select(
        "pose_id", r6(g.point_line_distance(p, centre, along)).alias("line_d"),
        r6(g.point_line_normal(p, centre, along)[1]).alias("line_ny"),
        r6(g.point_plane_distance(p, n, F.lit(0.5))).alias("plane_d"),
    )


@query(
    "ids_and_seconds",
    f"SELECT pose_id, lpad(CAST(pose_id AS VARCHAR), 6, '0') AS padded, {q6('epoch_us(ts) / 1e6 - 1704067200')} AS secs FROM poses",
    ("poses",),
)
def ids_and_seconds(spark, d):
    return fx.poses(spark, d).select(
        "pose_id", F.lpad(F.col("pose_id").cast("string"), 6, "0").alias("padded"),
        r6(tl.seconds("ts") - 1704067200).alias("secs"),
    )


# ---- steps and windows ------------------------------------------------------------------------

_PREV = ", ".join(f"lag({c}) OVER w AS p{c}" for c in ("t", *FIELDS))
_STEPS = f"""l AS (SELECT *, {_PREV} FROM poses WINDOW w AS (PARTITION BY vehicle_id, source ORDER BY t)),
steps AS (SELECT *, t - pt AS dt, {', '.join(f'{v} AS d{k}' for k, v in sql_between('p', '').items())} FROM l)"""


@query(
    "relative_pose",
    f"WITH {_STEPS} SELECT pose_id, {q6s([*STEP, 'dt'])} FROM steps",
    ("poses",),
)
def relative_pose(spark, d):
    return rounded(steps(spark, d), ["pose_id"], [*STEP, "dt"])


@query(
    "pair_dt",
    f"WITH {_STEPS} SELECT pose_id, {', '.join(f'CASE WHEN dt > 1e-6 AND dt <= 43200 THEN {q6(c)} END AS {c}' for c in ('dx', 'dyaw', 'dt'))} FROM steps",
    ("poses",),
)
def pair_dt(spark, d):
    return rounded(tr.pair_dt(steps(spark, d), HALF_DAY), ["pose_id"], ["dx", "dyaw", "dt"])


@query(
    "rates",
    f"WITH {_STEPS} SELECT pose_id, {', '.join(f'{q6(f"d{f}/dt*3600")} AS {n}' for f, n in zip(FIELDS, ('vx', 'vy', 'vz', 'wroll', 'wpitch', 'wyaw')))}, {q6('sqrt(dx*dx + dy*dy + dz*dz)/dt*3600')} AS speed FROM steps",
    ("poses",),
)
def rates(spark, d):
    out = tr.rates(steps(spark, d))
    names = ["vx", "vy", "vz", "wroll", "wpitch", "wyaw", "speed"]
    return out.select("pose_id", *[r6(F.col(c) * 3600).alias(c) for c in names])


@query(
    "jump_gate",
    """WITH l AS (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(roll) OVER w AS pr, lag(pitch) OVER w AS pp, lag(yaw) OVER w AS pw
  FROM poses WINDOW w AS (PARTITION BY vehicle_id, source ORDER BY t))
SELECT pose_id, coalesce(NOT (((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)) / ((t-pt)*(t-pt)) >= 1e-6
  OR ((roll-pr)*(roll-pr) + (pitch-pp)*(pitch-pp) + (yaw-pw)*(yaw-pw)) / ((t-pt)*(t-pt)) >= 1e-8), true) AS ok FROM l""",
    ("poses",),
)
def jump_gate(spark, d):
    return tr.jump_gate(fx.poses(spark, d), VS, linear=1e-6, angular=1e-8, width=BLOCK).select("pose_id", "ok")


_SEG = """s AS (SELECT *, CAST(sum(CASE WHEN t - pt > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id, source ORDER BY t) AS BIGINT) AS segment
  FROM (SELECT *, lag(t) OVER (PARTITION BY vehicle_id, source ORDER BY t) AS pt FROM poses))"""


@query("segments", f"WITH {_SEG} SELECT pose_id, segment FROM s", ("poses",))
def segments(spark, d):
    return tr.segments(fx.poses(spark, d), VS, HALF_DAY, width=BLOCK).select("pose_id", "segment")


@query(
    "propagate_translation",
    f"""WITH {_STEPS}, g AS (SELECT *, lag(dx) OVER w AS lx, lag(dy) OVER w AS ly, lag(dz) OVER w AS lz, lag(dt) OVER w AS ldt FROM steps WINDOW w AS (PARTITION BY vehicle_id, source ORDER BY t))
SELECT pose_id, {q6('lx * (dt/ldt)')} AS gx, {q6('ly * (dt/ldt)')} AS gy, {q6('lz * (dt/ldt)')} AS gz FROM g""",
    ("poses",),
)
def propagate_translation(spark, d):
    return rounded(tr.propagate_translation(steps(spark, d), VS, width=BLOCK), ["pose_id"], ["gx", "gy", "gz"])


@query("accumulate")
def accumulate(spark, d):
    path = tr.accumulate(steps(spark, d), VS, "pose_id", width=BLOCK)
    return path.select(*VS, "pose_id", *[F.round(f, 4).alias(f) for f in FIELDS])


@query(
    "accumulate_round_trip",
    f"""WITH f AS (SELECT *, first_value(x) OVER w AS ax, first_value(y) OVER w AS ay, first_value(z) OVER w AS az,
  first_value(roll) OVER w AS aroll, first_value(pitch) OVER w AS apitch, first_value(yaw) OVER w AS ayaw FROM poses WINDOW w AS (PARTITION BY vehicle_id, source ORDER BY t))
SELECT pose_id, {', '.join(f'round({v}, 4) + CAST(0 AS DOUBLE) AS {k}' for k, v in sql_between('a', '').items() if k in XYZ)} FROM f""",
    ("poses",),
)
def accumulate_round_trip(spark, d):
    path = tr.accumulate(steps(spark, d), VS, "pose_id", width=BLOCK)
    return path.select("pose_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in XYZ])


@query(
    "recent_path",
    """SELECT a.pose_id, string_agg(CAST(b.pose_id AS VARCHAR), ',' ORDER BY b.t) AS path FROM poses a JOIN poses b
ON a.vehicle_id = b.vehicle_id AND b.t <= a.t AND b.t >= a.t - 86400 GROUP BY 1""",
    ("poses",),
)
def recent_path(spark, d):
    out = tr.recent_path(fx.poses(spark, d), V, DAY, "pose_id")
    return out.select("pose_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(
    "last_n",
    "SELECT vehicle_id, pose_id FROM poses QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY t DESC) <= 25",
    ("poses",),
)
def last_n(spark, d):
    return tr.last_n(fx.poses(spark, d), V, 25, width=BLOCK).select("vehicle_id", "pose_id")


@query(
    "reverse_path",
    "SELECT vehicle_id, pose_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY t DESC) - 1 AS path_idx FROM poses",
    ("poses",),
)
def reverse_path(spark, d):
    return tr.reverse_path(fx.poses(spark, d), V, "pose_id", width=BLOCK).select("vehicle_id", "pose_id", "path_idx")


@query(
    "merge_feeds",
    "SELECT vehicle_id, pose_id, source, CASE WHEN source = 'front' THEN 0 ELSE 1 END AS feed_rank FROM poses",
    ("poses",),
)
def merge_feeds(spark, d):
    return tr.merge_feeds(front(spark, d), back(spark, d)).select("vehicle_id", "pose_id", "source", "feed_rank")


@query(
    "monotonic",
    """WITH a AS (SELECT *, t + ((pose_id * 37) % 7 - 3) * 20000 AS stamp FROM poses),
m AS (SELECT *, max(stamp) OVER (PARTITION BY vehicle_id, source ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a)
SELECT pose_id FROM m WHERE top IS NULL OR stamp > top""",
    ("poses",),
)
def monotonic(spark, d):
    df = fx.poses(spark, d).withColumn("arrival", tl.seconds("ts"))
    df = df.withColumn("stamp", F.col("arrival") + ((F.col("pose_id") * 37) % 7 - 3) * 20000)
    return tr.monotonic(df, VS, "arrival", "stamp", BLOCK).select("pose_id")


@query(
    "until_distance",
    f"""WITH k AS (SELECT pose_id, range AS k, x + range * (roll * 20) AS fx, y + range * (pitch * 20) AS fy, z AS fz FROM poses, range(1, 41)),
s AS (SELECT *, coalesce(sqrt(power(fx - lag(fx) OVER w, 2) + power(fy - lag(fy) OVER w, 2) + power(fz - lag(fz) OVER w, 2)), 0) AS step FROM k WINDOW w AS (PARTITION BY pose_id ORDER BY k)),
c AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY pose_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT pose_id, CAST(k AS INTEGER) AS k, {q6('fx')} AS x FROM c WHERE before < CAST(8.0037 AS DOUBLE)""",
    ("poses",),
)
def until_distance(spark, d):
    state = fx.poses(spark, d).select(
        "pose_id", *XYZ, (F.col("roll") * 20).alias("vx"), (F.col("pitch") * 20).alias("vy"), F.lit(0.0).alias("vz")
    )
    ahead = tr.forecast(state, 1.0, 40).select("pose_id", "k", *[F.col(f"f{c}").alias(c) for c in XYZ])
    return tr.until_distance(ahead, ["pose_id"], "k", 8.0037).select("pose_id", "k", r6("x").alias("x"))


# ---- joins in time ----------------------------------------------------------------------------


@query(
    "asof_join",
    """SELECT f.pose_id, CASE WHEN f.t - b.t <= 21600 THEN b.pose_id ELSE -1 END AS b_pose_id FROM (SELECT * FROM poses WHERE source = 'front') f
ASOF LEFT JOIN (SELECT * FROM poses WHERE source = 'back') b ON f.vehicle_id = b.vehicle_id AND f.t >= b.t""",
    ("poses",),
)
def asof_join(spark, d):
    right = back(spark, d).select("vehicle_id", "ts", "pose_id")
    out = tl.asof_join(front(spark, d), right, V, 21600.0, prefix="b_", width=BLOCK)
    return out.select("pose_id", F.coalesce("b_pose_id", F.lit(-1)).cast("bigint").alias("b_pose_id"))


@query(
    "nearest_time_join",
    """SELECT f.pose_id, arg_min(b.pose_id, abs(f.t - b.t)) AS b_pose_id FROM poses f JOIN poses b
ON f.vehicle_id = b.vehicle_id AND f.source = 'front' AND b.source = 'back' AND abs(f.t - b.t) <= 21600 GROUP BY 1""",
    ("poses",),
)
def nearest_time_join(spark, d):
    right = back(spark, d).select("vehicle_id", "ts", "pose_id")
    out = tl.nearest_time_join(front(spark, d).select("vehicle_id", "ts", "pose_id"), right, V, 21600.0, "pose_id", prefix="b_")
    return out.select("pose_id", "b_pose_id")


@query(
    "loops_from_times",
    """WITH p AS (SELECT vehicle_id, pose_id, t AS t_cur, t - 86400 * ((pose_id % 9) + 1) AS t_pre FROM poses WHERE source = 'back'),
e AS (SELECT vehicle_id, max(kf_id) AS last FROM keyframes GROUP BY 1),
j AS (SELECT p.vehicle_id, p.pose_id, coalesce(min(k.kf_id) FILTER (WHERE k.t >= p.t_cur), any_value(e.last)) AS key_cur,
  coalesce(max(k.kf_id) FILTER (WHERE k.t <= p.t_pre), 0) AS key_pre
  FROM p JOIN e USING (vehicle_id) JOIN keyframes k USING (vehicle_id) WHERE abs(t_cur - t_pre) >= 172800 GROUP BY 1, 2)
SELECT * FROM j WHERE key_cur <> key_pre""",
    ("keyframes",),
)
def loops_from_times(spark, d):
    pairs = back(spark, d).select(
        "vehicle_id", "pose_id", F.col("ts").alias("t_cur"),
        F.timestamp_micros(F.unix_micros("ts") - 86400000000 * ((F.col("pose_id") % 9) + 1)).alias("t_pre"),
    )
    out = tr.loops_from_times(pairs, fx.keyframes(spark, d), V, 2 * DAY, width=BLOCK)
    return out.select("vehicle_id", "pose_id", "key_cur", "key_pre")


_FR = sql_rotation("froll", "fpitch", "fyaw")
_MR = sql_rotation("mroll", "mpitch", "myaw")
_XR = sql_rotation("roll", "pitch", "yaw")
_INNER = sql_matvec(sql_transpose(_FR), ["(x - fx)", "(y - fy)", "(z - fz)"])


def _pre(prefix: str, alias: str) -> str:
    return ", ".join(f"{alias}.{f} AS {prefix}{f}" for f in FIELDS)


@query(
    "correct_drift",
    f"""WITH o AS (SELECT * FROM poses WHERE source = 'front'), m AS (SELECT * FROM poses WHERE source = 'back'),
a AS (SELECT m.vehicle_id, m.t, {_pre('m', 'm')}, {_pre('f', 'o')} FROM m ASOF JOIN o ON m.vehicle_id = o.vehicle_id AND m.t < o.t),
j AS (SELECT o.*, a.* EXCLUDE (vehicle_id, t) FROM o ASOF JOIN a ON o.vehicle_id = a.vehicle_id AND o.t >= a.t),
i AS (SELECT *, {', '.join(f'{v} AS i{c}' for v, c in zip(_INNER, XYZ))} FROM j)
SELECT pose_id, {', '.join(f'{q6(f"{v} + m{c}")} AS c{c}' for v, c in zip(sql_matvec(_MR, ['ix', 'iy', 'iz']), XYZ))},
  {', '.join(f'{q6(v)} AS c{c}' for v, c in zip(sql_rpy(sql_matmul(_MR, sql_matmul(sql_transpose(_FR), _XR))), FIELDS[3:]))} FROM i""",
    ("poses",),
)
def correct_drift(spark, d):
    out = tr.correct_drift(front(spark, d), back(spark, d), V, width=BLOCK)
    return rounded(out, ["pose_id"], ["c" + f for f in FIELDS])


@query(
    "valid_priors",
    """WITH c AS (SELECT vehicle_id, max(t) AS ct, arg_max(x, t) AS cx, arg_max(y, t) AS cy, arg_max(z, t) AS cz FROM poses WHERE source = 'front' GROUP BY 1)
SELECT pose_id FROM poses p JOIN c USING (vehicle_id) WHERE source = 'back' AND abs(ct - t) <= 864000 AND sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) <= 20""",
    ("poses",),
)
def valid_priors(spark, d):
    current = front(spark, d).groupBy("vehicle_id").agg(
        F.max("ts").alias("ts"), *[F.max_by(c, "ts").alias(c) for c in XYZ]
    )
    return tr.valid_priors(back(spark, d), current, V, 10 * DAY, 20.0).select("pose_id")


# ---- rates, forecasts, resampling -------------------------------------------------------------

_RATES = ", ".join(
    f"CASE WHEN dt > 1e-6 AND dt <= 86400 THEN d{f}/dt END AS {n}"
    for f, n in zip(FIELDS, ("vx", "vy", "vz", "wroll", "wpitch", "wyaw"))
)
_SYNC_LIN = ", ".join(f"{q6(f'b.{n} * f.fdt')} AS s{n}" for n in ("vx", "vy", "vz"))
_SYNC_ANG = ", ".join(
    f"{q6(f'atan2(sin(b.{n} * f.fdt), cos(b.{n} * f.fdt))')} AS s{n}" for n in ("wroll", "wpitch", "wyaw")
)


@query(
    "sync_back",
    f"""WITH {_STEPS}, r AS (SELECT pose_id, vehicle_id, source, t, CASE WHEN dt > 1e-6 AND dt <= 86400 THEN dt END AS fdt, {_RATES} FROM steps),
f AS (SELECT * FROM r WHERE source = 'front'), b AS (SELECT * FROM r WHERE source = 'back' AND vx IS NOT NULL)
SELECT f.pose_id, {_SYNC_LIN}, {_SYNC_ANG}, {q6('CAST(1.5 AS DOUBLE) * (1 + (f.t - b.t))')} AS noise
FROM f ASOF JOIN b ON f.vehicle_id = b.vehicle_id AND f.t >= b.t WHERE f.t - b.t <= 43200""",
    ("poses",),
)
def sync_back(spark, d):
    moving = tr.rates(tr.pair_dt(steps(spark, d), DAY))
    out = tr.sync_back(
        moving.where("source = 'front'").select("vehicle_id", "pose_id", "ts", "dt"),
        moving.where("source = 'back'"), V, HALF_DAY, width=BLOCK,
    )
    return rounded(out, ["pose_id"], ["svx", "svy", "svz", "swroll", "swpitch", "swyaw", "noise"])


def _states(spark, d):
    """Samples with a velocity and an acceleration made from their attitude."""
    return fx.poses(spark, d).select(
        "vehicle_id", "pose_id", "ts", *FIELDS,
        (F.col("roll") * 100).alias("vx"), (F.col("pitch") * 100).alias("vy"), (F.col("yaw") / 10).alias("vz"),
        F.col("pitch").alias("ax"), F.col("roll").alias("ay"), F.lit(0.1).alias("az"),
    )


@query(
    "forecast",
    f"""SELECT pose_id, CAST(range AS INTEGER) AS k, {q6('x + range*CAST(0.2 AS DOUBLE)*roll*100')} AS fx, {q6('y + range*CAST(0.2 AS DOUBLE)*pitch*100')} AS fy,
 {q6('z + range*CAST(0.2 AS DOUBLE)*yaw/10')} AS fz, {q6('x + range*CAST(0.2 AS DOUBLE)*roll*100 + CAST(0.5 AS DOUBLE)*(range*CAST(0.2 AS DOUBLE))*(range*CAST(0.2 AS DOUBLE))*pitch')} AS ax FROM poses, range(1, 11)""",
    ("poses",),
)
def forecast(spark, d):
    plain = tr.forecast(_states(spark, d), 0.2, 10)
    bent = tr.forecast(_states(spark, d), 0.2, 10, acceleration=True).select("pose_id", "k", F.col("fx").alias("bx"))
    return plain.join(bent, ["pose_id", "k"]).select(
        "pose_id", "k", *[r6(f"f{c}").alias(f"f{c}") for c in XYZ], r6("bx").alias("ax")
    )


@query(
    "forecast_distance",
    f"""WITH s AS (SELECT pose_id, x, roll*100 AS vx, sqrt(power(roll*100, 2) + power(pitch*100, 2) + power(yaw/10, 2)) AS speed FROM poses),
k AS (SELECT s.*, (SELECT min(range) FROM range(1, 501) WHERE range * CAST(0.1 AS DOUBLE) * speed >= 8 - 1e-9) AS n FROM s),
h AS (SELECT *, greatest(least(coalesce(n * CAST(0.1 AS DOUBLE), 50), 50), 1) AS horizon FROM k)
SELECT pose_id, {q6('horizon')} AS horizon, {q6('x + horizon * vx')} AS fx FROM h""",
    ("poses",),
)
def forecast_distance(spark, d):
    out = tr.forecast_distance(_states(spark, d), ["pose_id"], 8.0, 0.1, 50.0, 1.0)
    return rounded(out, ["pose_id"], ["horizon", "fx"])


@query(
    "forecast_local",
    f"""WITH s AS (SELECT *, {', '.join(f'{v} AS m{k}' for k, v in zip(range(9), sql_matmul(sql_rotation('roll', 'pitch', 'yaw'), sql_rotation('atan2(sin(1.5*pitch), cos(1.5*pitch))', 'atan2(sin(3*roll), cos(3*roll))', 'atan2(sin(1.5*yaw), cos(1.5*yaw))'))))},
  {', '.join(f'{v} AS p{c}' for c, v in zip(XYZ, sql_matvec(sql_rotation('roll', 'pitch', 'yaw'), ['(1.5*roll*100)', '(1.5*pitch*100)', '(1.5*yaw/10)'])))} FROM poses)
SELECT pose_id, {', '.join(f'{q6(f"{c} + p{c}")} AS f_{c}' for c in XYZ)}, {', '.join(f'{q6(v)} AS f_{f}' for f, v in zip(FIELDS[3:], sql_rpy([f'm{k}' for k in range(9)])))} FROM s""",
    ("poses",),
)
def forecast_local(spark, d):
    """The full pose 1.5 s ahead by rates in the own frame."""
    state = _states(spark, d).withColumns({"wroll": F.col("pitch"), "wpitch": F.col("roll") * 2, "wyaw": F.col("yaw")})
    return rounded(tr.forecast_local(state, F.lit(1.5)), ["pose_id"], ["f_" + f for f in FIELDS])


_TURNED = {"wx": "pitch * 4", "wy": "roll * 6", "wz": "yaw / 5", "bx": "roll", "by": "pitch / 2", "bz": "0.05D"}


def _path_sql(dt: float, n: int, distance: float | None) -> str:
    """The steps one by one: place by the polynomial, attitude by the quaternion of each step's mean rate."""
    u = [f"(({w}) + (k + 0.5)*{dt}*({b}))*{dt}" for w, b in (("pitch*4", "roll"), ("roll*6", "pitch/2"), ("yaw/5", "0.05"))]
    place = [
        f"{c} + (k+1)*{dt}*({v}) + 0.5*((k+1)*{dt})*((k+1)*{dt})*({a})"
        for c, v, a in (("x", "roll*100", "pitch"), ("y", "pitch*100", "roll"), ("z", "yaw/10", "0.1"))
    ]
    half = [f"{f}/2" for f in FIELDS[3:]]
    (cr, cp, cy), (sr, sp, sy) = ([f"{f}({h})" for h in half] for f in ("cos", "sin"))
    start = [f"{sr}*{cp}*{cy} - {cr}*{sp}*{sy}", f"{cr}*{sp}*{cy} + {sr}*{cp}*{sy}", f"{cr}*{cp}*{sy} - {sr}*{sp}*{cy}", f"{cr}*{cp}*{cy} + {sr}*{sp}*{sy}"]
    stop = "" if distance is None else f" AND gone < {distance} AND moved >= 1e-12"
    return f"""WITH RECURSIVE s(pose_id, k, x, y, z, roll, pitch, yaw, px, py, pz, qx, qy, qz, qw, gone) AS (
SELECT pose_id, 0, x, y, z, roll, pitch, yaw, x, y, z, {', '.join(start)}, CAST(0 AS DOUBLE) FROM poses
UNION ALL SELECT pose_id, k + 1, x, y, z, roll, pitch, yaw, nx, ny, nz,
  qw*ex + qx*ew + qy*ez - qz*ey, qw*ey - qx*ez + qy*ew + qz*ex, qw*ez + qx*ey - qy*ex + qz*ew, qw*ew - qx*ex - qy*ey - qz*ez, gone + moved
FROM (SELECT *, ux*f AS ex, uy*f AS ey, uz*f AS ez, cos(th/2) AS ew, sqrt((nx-px)*(nx-px) + (ny-py)*(ny-py) + (nz-pz)*(nz-pz)) AS moved
  FROM (SELECT *, CASE WHEN th < 1e-10 THEN 0.5 ELSE sin(th/2)/th END AS f
    FROM (SELECT *, sqrt(ux*ux + uy*uy + uz*uz) AS th
      FROM (SELECT *, {', '.join(f'{v} AS u{c}' for c, v in zip(XYZ, u))}, {', '.join(f'{v} AS n{c}' for c, v in zip(XYZ, place))} FROM s))))
WHERE k < {n}{stop})
SELECT pose_id, CAST(k AS INTEGER) AS k, {', '.join(f'{q6(f"p{c}")} AS f{c}' for c in XYZ)}, {q6('atan2(2*(qy*qz + qw*qx), 1 - 2*(qx*qx + qy*qy))')} AS froll,
  {q6('asin(greatest(-1, least(1, 2*(qw*qy - qx*qz))))')} AS fpitch, {q6('atan2(2*(qx*qy + qw*qz), 1 - 2*(qy*qy + qz*qz))')} AS fyaw, {q6('gone')} AS gone FROM s WHERE k > 0"""


def _path(spark, d, dt, n, distance=None):
    state = _states(spark, d).withColumns({c: F.expr(v) for c, v in _TURNED.items()})
    out = tr.forecast_path(state, dt, n, distance)
    return rounded(out, ["pose_id", "k"], ["fx", "fy", "fz", "froll", "fpitch", "fyaw", "gone"])


@query("forecast_path", _path_sql(0.2, 10, None), ("poses",))
def forecast_path(spark, d):
    """Full poses of ten steps at constant acceleration."""
    return _path(spark, d, 0.2, 10)


@query("forecast_until", _path_sql(0.1, 60, 8.0), ("poses",))
def forecast_until(spark, d):
    """Full poses until the way is 8 m long."""
    return _path(spark, d, 0.1, 60, 8.0)


@query("pose_gap", f"SELECT pose_id, {q6('pitch * 4')} AS gx, {q6('roll * 6')} AS gy, {q6('yaw / 5')} AS gz FROM poses", ("poses",))
def pose_gap(spark, d):
    """The rotation vector between an attitude and the one it was turned to."""
    own = rpy_quat(*[F.col(f) for f in FIELDS[3:]])
    turned = boxplus(own, [F.expr(_TURNED[w]) for w in ("wx", "wy", "wz")])
    gap = boxminus(turned, own)
    return fx.poses(spark, d).select("pose_id", *[r6(v).alias(c) for v, c in zip(gap, ("gx", "gy", "gz"))])


@query(
    "covariance_block",
    f"SELECT pose_id, {', '.join(q6(v) + f' AS b{k}' for k, v in enumerate(['pitch', 'z', 'yaw + 2', 'x + 2']))} FROM poses",
    ("poses",),
)
def covariance_block_query(spark, d):
    """Rows 1 and 2 of a 3x3 covariance, columns 2 and 0."""
    whole = F.array(*[F.col(f) for f in ("x", "y", "roll")], F.col("z"), F.col("y"), F.col("pitch"), F.col("x") + 2, F.col("roll"), F.col("yaw") + 2)
    block = covariance_block(whole, 3, [1, 2], [2, 0])
    return fx.poses(spark, d).select("pose_id", *[r6(F.get(block, k)).alias(f"b{k}") for k in range(4)])


@query("read_pose_feed", f"SELECT pose_id, vehicle_id, source, t, {q6s(FIELDS)} FROM poses", ("poses",))
def read_back_poses(spark, d):
    """All samples, written in folders per day and read back."""
    path = scratch_table(spark, "poses")
    write_poses(fx.poses(spark, d), path)
    back = read_poses(spark, path).withColumn("t", tl.seconds("ts"))
    return rounded(back, ["pose_id", "vehicle_id", "source", "t"], list(FIELDS))


_NX = ", ".join(f"lead({f}) OVER w AS f{f}" for f in FIELDS)


@query(
    "to_local",
    f"""WITH n AS (SELECT *, {_NX} FROM poses WINDOW w AS (PARTITION BY vehicle_id, source ORDER BY t))
SELECT pose_id, {', '.join(f'{q6(v)} AS l{k}' for k, v in sql_between('', 'f').items())} FROM n WHERE fx IS NOT NULL""",
    ("poses",),
)
def to_local(spark, d):
    later = fx.poses(spark, d)
    prev = tl.with_previous(later, VS, "ts", ["pose_id", *FIELDS], width=BLOCK).where("prev_pose_id is not null")
    turned = prev.select(
        F.col("prev_pose_id").alias("pose_id"), *[F.col(f"prev_{f}").alias(f) for f in FIELDS],
        *[F.col(f).alias(f"f_{f}") for f in FIELDS],
    )
    return rounded(tr.to_local(turned), ["pose_id"], ["l" + f for f in FIELDS])


@query(
    "resample",
    f"""WITH s AS (SELECT *, CAST(ceil(t / 7200) AS BIGINT) AS a, coalesce(CAST(ceil(lead(t) OVER w / 7200) AS BIGINT) - 1, CAST(floor(t / 7200) AS BIGINT)) AS b
  FROM poses WHERE source = 'front' WINDOW w AS (PARTITION BY vehicle_id ORDER BY t)),
k AS (SELECT *, unnest(range(a, b + 1)) AS tick FROM s WHERE a <= b)
SELECT vehicle_id, tick, pose_id, {q6('tick * CAST(7200 AS DOUBLE) - t')} AS dt_tick, {q6('x + (tick * CAST(7200 AS DOUBLE) - t) * (roll / 1000)')} AS rx FROM k""",
    ("poses",),
)
def resample(spark, d):
    state = front(spark, d).select(
        "vehicle_id", "pose_id", "ts", *XYZ, (F.col("roll") / 1000).alias("vx"),
        (F.col("pitch") / 1000).alias("vy"), F.lit(0.0).alias("vz"),
    )
    return rounded(tr.resample(state, V, 7200.0, width=BLOCK), ["vehicle_id", "tick", "pose_id"], ["dt_tick", "rx"])
