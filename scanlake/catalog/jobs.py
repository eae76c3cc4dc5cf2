"""Queries on folds, registration, whole jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.catalog import graphs, places  # noqa: F401  (their oracles are reused)
from scanlake.catalog.poses import DAY, V, VS
from scanlake.catalog.registry import ORACLES, q6, query, rounded, sql_matvec, sql_rotation
from scanlake.functions.poses import FIELDS
from scanlake.operators import fits, fusion, registration as reg, voxels
from scanlake.plans.alignment import align_clouds
from scanlake.plans.features import feature_job
from scanlake.plans.loops import mine_by_descriptor, mine_loops, verify_loops
from scanlake.plans.mapping import build_map, refine_to_map
from scanlake.plans.priors import associate_priors
from scanlake.plans.registration import register_pairs
from scanlake.plans.terrain import settle
from scanlake.session import cut, scratch_table
from scanlake.sources import shapes as fx
from scanlake.streaming import feeds

XYZ = ["x", "y", "z"]
CELLS = [4.0, 8.0, 16.0, 32.0]


# ---- normal equations -------------------------------------------------------------------------

_LEAF = "CAST(floor({c} / CAST(4 AS DOUBLE) - CAST(0.5 AS DOUBLE)) AS BIGINT)"
_PAIR_R = sql_rotation("CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)", "CAST(0.05 AS DOUBLE)")
_PV = sql_matvec(_PAIR_R, ["x", "y", "z"])
# both covariances are the same constant C, so the combined one is C + R C R'
_PAIR = f"""v AS (SELECT scan_id, {', '.join(_LEAF.format(c=c) + f' AS v{c}' for c in XYZ)}, count(*) AS n, {', '.join(f'avg({c}) AS m{c}' for c in XYZ)} FROM points GROUP BY 1, 2, 3, 4),
p AS (SELECT scan_id AS pair_id, scan_id + 1 AS target_id, x, y, z, {', '.join(f'{v} + CAST({t} AS DOUBLE) AS p{c}' for v, t, c in zip(_PV, (0.5, -0.25, 0.1), XYZ))} FROM points),
j AS (SELECT p.*, sqrt(v.n) AS w, {', '.join(f'm{c} - p{c} AS e{c}' for c in XYZ)}, cos(CAST(0.05 AS DOUBLE)) AS ct, sin(CAST(0.05 AS DOUBLE)) AS st FROM p JOIN v ON v.scan_id = p.target_id
  AND {' AND '.join(f'v.v{c} = {_LEAF.format(c="p." + "p" + c)}' for c in XYZ)}),
s AS (SELECT *, 0.5 + ct*ct*0.5 - 2*ct*st*0.1 + st*st*0.4 AS sxx, 0.1 + ct*st*0.5 + (ct*ct - st*st)*0.1 - ct*st*0.4 AS sxy, -st*0.05 AS sxz,
  0.4 + st*st*0.5 + 2*ct*st*0.1 + ct*ct*0.4 AS syy, 0.05 + ct*0.05 AS syz, CAST(0.6 AS DOUBLE) AS szz FROM j),
d AS (SELECT *, sxx*(syy*szz - syz*syz) - sxy*(sxy*szz - syz*sxz) + sxz*(sxy*syz - syy*sxz) AS det FROM s),
m AS (SELECT *, (syy*szz - syz*syz)/det AS mxx, (sxz*syz - sxy*szz)/det AS mxy, (sxy*syz - sxz*syy)/det AS mxz, (sxx*szz - sxz*sxz)/det AS myy, (sxy*sxz - sxx*syz)/det AS myz, (sxx*syy - sxy*sxy)/det AS mzz FROM d)"""


def _pair_matches(spark, d):
    pts = fx.points(spark, d).select("scan_id", "point_idx", *XYZ)
    cov = {"cxx": 0.5, "cxy": 0.1, "cxz": 0.0, "cyy": 0.4, "cyz": 0.05, "czz": 0.3}
    with_cov = pts.withColumns({k: F.lit(v) for k, v in cov.items()})
    vox = voxels.voxel_map(with_cov, ["scan_id"], 4.0)
    target = vox.withColumn("pair_id", F.col("scan_id") - 1).drop("scan_id")
    source = with_cov.withColumnRenamed("scan_id", "pair_id")
    c, s = F.cos(F.lit(0.05)), F.sin(F.lit(0.05))
    o, i = F.lit(0.0), F.lit(1.0)
    names = [f"r{a}{b}" for a in range(3) for b in range(3)] + ["t0", "t1", "t2"]
    values = [c, -s, o, s, c, o, o, o, i, F.lit(0.5), F.lit(-0.25), F.lit(0.1)]
    state = pts.select(F.col("scan_id").alias("pair_id")).distinct().select(
        "pair_id", *[v.alias(n) for v, n in zip(values, names)]
    )
    return reg.correspondences(source, target, state, ["pair_id"], 4.0)


def _sym(a: str, b: str) -> str:
    return f"m{min(a, b)}{max(a, b)}"


_SKEW = {"x": ("0", "pz", "(-py)"), "y": ("(-pz)", "0", "px"), "z": ("py", "(-px)", "0")}
_J = {i: [_SKEW[c][k] for k in range(3)] for i, c in enumerate(XYZ)}


def _jm(i: int, k: int) -> str:
    return "(" + " + ".join(f"{_J[i][a]}*{_sym(XYZ[a], XYZ[k])}" for a in range(3)) + ")"


_H3 = ", ".join(
    f"round(sum(w*({' + '.join(f'{_jm(i, k)}*{_J[j][k]}' for k in range(3))})), 4) + CAST(0 AS DOUBLE) AS h{i}{j}"
    for i in range(3) for j in range(i, 3)
)
_G3 = ", ".join(
    f"round(sum(w*({' + '.join(f'{_jm(i, k)}*e{XYZ[k]}' for k in range(3))})), 4) + CAST(0 AS DOUBLE) AS g{i}" for i in range(3)
)
_EME = " + ".join(f"e{a}*{_sym(a, b)}*e{b}" for a in XYZ for b in XYZ)


@query("normal_eq_pair", f"WITH {_PAIR} SELECT pair_id, {_H3}, {_G3}, count(*) AS n FROM m GROUP BY 1", ("points",))
def normal_eq_pair(spark, d):
    out = reg.normal_eq_pair(_pair_matches(spark, d), ["pair_id"], "rotation")
    names = [f"h{i}{j}" for i in range(3) for j in range(i, 3)] + [f"g{i}" for i in range(3)]
    return out.select("pair_id", "n", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in names])


@query("normal_eq_pair_full")
def normal_eq_pair_full(spark, d):
    out = reg.normal_eq_pair(_pair_matches(spark, d), ["pair_id"], "full")
    return out.select(*[F.round(c, 3).alias(c) if c not in ("pair_id", "n") else F.col(c) for c in out.columns])


@query("normal_eq_pair_translation")
def normal_eq_pair_translation(spark, d):
    drift = {"vx": F.lit(0.2), "vy": F.lit(-0.1), "vz": F.lit(0.0), "dt": F.lit(0.1)}
    out = reg.normal_eq_pair(
        _pair_matches(spark, d).withColumns(drift), ["pair_id"], "translation", ["vx", "vy", "vz"], "dt"
    )
    return out.select(*[F.round(c, 3).alias(c) if c not in ("pair_id", "n") else F.col(c) for c in out.columns])


@query("pair_error", f"WITH {_PAIR} SELECT pair_id, {q6(f'sum(w*({_EME}))')} AS error, count(*) AS n FROM m GROUP BY 1", ("points",))
def pair_error(spark, d):
    return rounded(reg.pair_error(_pair_matches(spark, d), ["pair_id"]), ["pair_id", "n"], ["error"])


def _map_matches(spark, d):
    pts = fx.points(spark, d)
    att = fx.poses(spark, d).groupBy(F.col("vehicle_id").alias("scan_id")).agg(
        *[F.avg(c).alias(c) for c in ("roll", "pitch", "yaw")]
    )
    w = 1 / (1 + F.abs("z"))
    return pts.join(att, "scan_id").select(
        "scan_id", *XYZ, "roll", "pitch", "yaw",
        (w * F.cos("t_rel")).alias("a"), (w * F.sin("t_rel")).alias("b"), (w * 0.5).alias("c"), (w * F.col("t_rel")).alias("d"),
    )


# numeric derivative of the rotated point by each angle, an independent check of the Jacobian
_EPS = "CAST(0.00001 AS DOUBLE)"


def _slope(which: str) -> str:
    def rotated(sign: str) -> list[str]:
        names = [f"({n} {sign} {_EPS})" if n == which else n for n in ("roll", "pitch", "yaw")]
        return sql_matvec(sql_rotation(*names), XYZ)

    up, down = rotated("+"), rotated("-")
    return "(" + " + ".join(f"{n}*({u} - {v})" for n, u, v in zip("abc", up, down)) + f") / (2*{_EPS})"


@query(
    "normal_eq_map",
    f"""WITH att AS (SELECT vehicle_id AS scan_id, avg(roll) AS roll, avg(pitch) AS pitch, avg(yaw) AS yaw FROM poses GROUP BY 1),
q AS (SELECT scan_id, x, y, z, roll, pitch, yaw, cos(t_rel)/(1 + abs(z)) AS a, sin(t_rel)/(1 + abs(z)) AS b, CAST(0.5 AS DOUBLE)/(1 + abs(z)) AS c, t_rel/(1 + abs(z)) AS d FROM points JOIN att USING (scan_id)),
s AS (SELECT scan_id, {', '.join(f'{_slope(n)} AS j{i}' for i, n in enumerate(('roll', 'pitch', 'yaw')))}, a AS j3, b AS j4, c AS j5, d FROM q)
SELECT scan_id, {', '.join(f'round(sum(j{i}*j{j}) + CAST(0.137 AS DOUBLE), 0) + CAST(0 AS DOUBLE) AS h{i}{j}' for i in range(6) for j in range(i, 6))}, {', '.join(f'round(sum(-j{i}*d) + CAST(0.137 AS DOUBLE), 0) + CAST(0 AS DOUBLE) AS g{i}' for i in range(6))}, count(*) AS n FROM s GROUP BY 1""",
    ("points", "poses"),
)
def normal_eq_map(spark, d):
    out = fits.normal_eq_map(_map_matches(spark, d), ["scan_id"])
    names = [c for c in out.columns if c not in ("scan_id", "n")]
    return out.select("scan_id", "n", *[(F.round(F.col(c) + 0.137, 0) + F.lit(0.0)).alias(c) for c in names])


@query("degeneracy")
def degeneracy(spark, d):
    out = reg.degeneracy(fits.normal_eq_map(_map_matches(spark, d), ["scan_id"]), ["scan_id"])
    return out.select("scan_id", "degenerate", F.round(F.get("eigenvalues", 0), 3).alias("weakest"))


# ---- filters ----------------------------------------------------------------------------------


def _quick(poses):
    """The same samples with half days told as seconds, the pace the filter is made for."""
    return poses.withColumn("ts", F.timestamp_micros((F.unix_micros("ts") / 43200).cast("bigint")))


@query("smooth")
def smooth(spark, d):
    out = fusion.smooth(_quick(fx.poses(spark, d)), VS, fusion.SmoothOptions(max_dt=2.0), width=12.0)
    return out.select("vehicle_id", "source", "pose_id", *[F.round(f"s_{f}", 4).alias(f) for f in XYZ])


@query("fuse")
def fuse(spark, d):
    options = fusion.FuseOptions(max_pair_dt=2 * DAY, max_age=DAY, age_scale=1e-5)
    out = fusion.fuse(fx.poses(spark, d), V, options, width=fx.FOLD_BLOCK)
    return out.select("vehicle_id", "pose_id", *[F.round(f"f_{f}", 3).alias(f) for f in XYZ])


# ---- whole jobs -------------------------------------------------------------------------------


@query("feature_job")
def features(spark, d):
    return rounded(feature_job(fx.points(spark, d)), ["scan_id", "ring", "kind"], XYZ)


@query("register_pairs")
def register(spark, d):
    pts = fx.points(spark, d)
    pairs = pts.select("scan_id").distinct().select(
        F.col("scan_id").alias("pair_id"), F.col("scan_id").alias("source_id"), (F.col("scan_id") + 1).alias("target_id")
    )
    out = register_pairs(pts, pairs, k=10, cells=CELLS, size=8.0)
    return out.select("pair_id", *[F.round(c, 4).alias(c) for c in ("r00", "r01", "t0", "t1", "t2")], "rounds")


@query("refine_to_map")
def refine(spark, d):
    cloud = fx.points(spark, d).select("scan_id", F.col("point_idx").alias("point_id"), "ring", *XYZ)
    guess = cloud.select("scan_id").distinct().select("scan_id", *[F.lit(0.0).alias(f) for f in FIELDS])
    edges, surfaces = cloud.where("ring < 8"), cloud.where("ring >= 8")
    out = refine_to_map(
        edges, surfaces, edges, surfaces, guess, ["scan_id"], max_d=12.0, tolerance=1.0, min_matches=20
    )
    return out.select("scan_id", "rounds", *[F.round(f, 3).alias(f) for f in FIELDS])


@query("mine_loops")
def mine(spark, d):
    return mine_loops(
        fx.keyframes(spark, d), fx.keyframe_points(spark, d), V, 10.0, 5 * DAY, 2, 0.6
    ).select("vehicle_id", "kf_id", "loop_id", "kind", F.round("score", 4).alias("score"))


@query("mine_loops_by_scan")
def mine_scans(spark, d):
    out = mine_by_descriptor(fx.points(spark, d), [], "scan_id", 3, 3, 0.6)
    return out.select("scan_id", "loop_id", F.round("distance", 6).alias("distance"))


ORACLES["mine_loops_by_scan"] = ORACLES["best_loop"].replace(
    f"SELECT scan_id, n_scan_id, {q6('distance')} AS distance, {q6('radians(shift * 6)')} AS yaw FROM b",
    "SELECT scan_id, n_scan_id AS loop_id, round(distance, 6) AS distance FROM b",
)


@query("verify_loops")
def verify(spark, d):
    kf, kp = fx.keyframes(spark, d), fx.keyframe_points(spark, d)
    candidates = cut(mine_loops(kf, kp, V, 10.0, 5 * DAY, 2, 0.6))
    options = {"leaf": 1.0, "min_source": 6, "min_target": 60, "size": 4.0}
    by_place = verify_loops(candidates.where("kind = 'radius'"), kf, kp, V, max_d=20.0, **options)
    by_sight = verify_loops(candidates.where("kind = 'descriptor'"), kf, kp, V, max_d=150.0, frame="base", **options)
    out = by_place.unionByName(by_sight)
    return out.select("vehicle_id", "from_id", "to_id", "robust", F.round("var0", 3).alias("fitness"))


@query(
    "align_clouds",
    f"""SELECT DISTINCT vehicle_id, kf_id, true AS converged, {q6('cos(CAST(0.01 AS DOUBLE))')} AS r00, {q6('sin(CAST(0.01 AS DOUBLE))')} AS r01,
  {q6('-0.3*cos(CAST(0.01 AS DOUBLE)) + 0.2*sin(CAST(0.01 AS DOUBLE))')} AS tx, {q6('0.3*sin(CAST(0.01 AS DOUBLE)) + 0.2*cos(CAST(0.01 AS DOUBLE))')} AS ty,
  CAST(-0.1 AS DOUBLE) AS tz, CAST(0 AS DOUBLE) AS fitness
FROM keyframes""",
    ("keyframes",),
)
def aligned(spark, d):
    """Every keyframe's cloud, turned and shifted a little, is brought back onto it."""
    cloud = fx.keyframe_points(spark, d).select("vehicle_id", "kf_id", F.col("point_idx").alias("point_id"), *XYZ)
    c, s = F.cos(F.lit(0.01)), F.sin(F.lit(0.01))
    moved = {"x": c * F.col("x") - s * F.col("y") + 0.3, "y": s * F.col("x") + c * F.col("y") - 0.2, "z": F.col("z") + 0.1}
    both = ["vehicle_id", "kf_id"]
    out = align_clouds(cloud.select(*both).distinct(), cloud.withColumns(moved), both, cloud, both, size=4.0)
    return rounded(out, [*both, "converged"], ["r00", "r01", "tx", "ty", "tz", "fitness"])


_MOVE = sql_matvec(sql_rotation("k.roll", "k.pitch", "k.yaw"), ["p.x", "p.y", "p.z"])


@query(
    "build_map",
    f"""WITH w AS (SELECT vehicle_id, kf_id, {', '.join(f'{v} + k.{c} AS {c}' for v, c in zip(_MOVE, XYZ))} FROM keyframe_points p JOIN keyframes k USING (vehicle_id, kf_id)),
c AS (SELECT vehicle_id, arg_max(x, kf_id) AS cx, arg_max(y, kf_id) AS cy, arg_max(z, kf_id) AS cz FROM keyframes GROUP BY 1),
t AS (SELECT vehicle_id, floor(x/10) AS gx, floor(y/10) AS gy, floor(z/10) AS gz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM keyframes JOIN c USING (vehicle_id)
  WHERE sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) <= 1000 GROUP BY 1, 2, 3, 4),
s AS (SELECT t.vehicle_id, arg_min(k.kf_id, (t.x-k.x)*(t.x-k.x) + (t.y-k.y)*(t.y-k.y) + (t.z-k.z)*(t.z-k.z)) AS kf_id FROM t JOIN keyframes k USING (vehicle_id) GROUP BY t.vehicle_id, gx, gy, gz)
SELECT vehicle_id, {', '.join(f'CAST(floor({c}) AS BIGINT) AS v{c}' for c in XYZ)}, count(*) AS n, {', '.join(f'{q6(f"avg({c})")} AS {c}' for c in XYZ)} FROM w JOIN s USING (vehicle_id, kf_id) GROUP BY 1, 2, 3, 4""",
    ("keyframe_points", "keyframes"),
)
def whole_map(spark, d):
    out = build_map(fx.keyframes(spark, d), fx.keyframe_points(spark, d))
    return rounded(out, ["vehicle_id", "vx", "vy", "vz", "n"], XYZ)


@query("settle")
def settled(spark, d):
    out = settle(
        fx.ground_queries(spark, d), fx.ground(spark, d), fx.WHEELS, com_z=0.5, radius=6.0, min_neighbours=3,
        fit=(8.0, 3.0, 5),
    )
    return out.select("query_id", *[F.round(c, 4).alias(c) for c in ("z", "roll", "pitch")], "reason")


_PLANE = "(0.05*qx - 0.03*qy + CAST(tile_id % 7 AS DOUBLE) / 10)"


@query(
    "settle_on_plane",
    f"""SELECT query_id, reason, {q6('z')} AS z, {q6('roll')} AS roll, {q6('pitch')} AS pitch
FROM (SELECT query_id, 'none' AS reason, {_PLANE} + 0.5*sqrt(1 + 0.05*0.05 + 0.03*0.03) - CAST(1 AS DOUBLE)/80 AS z,
    -asin((0.05*sin(qyaw) + 0.03*cos(qyaw)) / sqrt(1 + 0.05*0.05 + 0.03*0.03)) AS roll, atan2(-0.05*cos(qyaw) + 0.03*sin(qyaw), CAST(1 AS DOUBLE)) AS pitch
  FROM ground_queries)""",
    ("ground_queries",),
)
def settled_on_plane(spark, d):
    """Every tile's points moved onto a slope, on which the vehicle's rest is known."""
    slope = 0.05 * F.col("x") - 0.03 * F.col("y") + (F.col("tile_id") % 7).cast("double") / 10
    ground = fx.ground(spark, d).withColumn("z", slope)
    out = settle(
        fx.ground_queries(spark, d), ground, fx.WHEELS, com_z=0.5, radius=6.0, min_neighbours=3, fit=(200.0, 3.0, 5)
    )
    return rounded(out, ["query_id", "reason"], ["z", "roll", "pitch"])


@query("associate_priors")
def priors(spark, d):
    kf, kp = fx.keyframes(spark, d), fx.keyframe_points(spark, d)
    ahead = kf.select(
        "vehicle_id", F.col("kf_id").alias("prior_id"), F.col("kf_id").alias("linked_id"),
        F.lit(4.0).alias("x"), *[F.lit(0.0).alias(c) for c in ("y", "z", "roll", "pitch", "yaw")],
    )
    seen = kp.select("vehicle_id", "kf_id", F.col("point_idx").alias("point_id"), *XYZ)
    patches = seen.withColumnRenamed("kf_id", "prior_id")
    out = associate_priors(
        ahead, kf, patches, seen, radius=4.0, max_fitness=200.0, max_z=10.0, max_angle=3.0, size=4.0
    )
    return out.select("vehicle_id", "from_id", "to_id", *[F.round(c, 3).alias(c) for c in ("x", "y", "z", "var0")])


# ---- streams ----------------------------------------------------------------------------------


def _collected(spark, d, transform, name, parts=3):
    """What a query gives on a feed that arrives in parts, by time: each is added to the feed's folder and processed
    before the next, by a query that goes on from the checkpoint."""
    events = fx.table(spark, d, "events")
    low, high = events.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * parts / (high - low + 1))
    feed, path, marks = (scratch_table(spark, name + end) for end in ("-feed", "", "-marks"))
    for number in range(parts):
        events.where(part == number).write.mode("append").parquet(feed)
        out = transform(fx.shape_poses(spark.readStream.schema(events.schema).parquet(feed)))
        feeds.run_available(out, path, marks)
    return spark.read.schema(out.schema).parquet(path)


def _displaced(live):
    live = live.withColumn("arrival", F.unix_micros("ts") / 1e6)
    return live.withColumn("stamp", F.col("arrival") + ((F.col("pose_id") * 37) % 7 - 3) * 20000)


@query("stream_monotonic", ORACLES["monotonic"])
def stream_monotonic(spark, d):
    def run(live):
        return feeds.monotonic(_displaced(live), VS, "arrival", "stamp", expire=20 * DAY).select("pose_id")

    return _collected(spark, d, run, "monotonic")


@query("stream_sample_interval", ORACLES["sample_interval"])
def stream_sample_interval(spark, d):
    return _collected(spark, d, lambda live: feeds.sample_interval(live, V, DAY).select("pose_id"), "interval")


@query("stream_select_keyframes", ORACLES["select_keyframes"])
def stream_select_keyframes(spark, d):
    def run(live):
        return feeds.select_keyframes(live.where("source = 'front'"), V, 15.0, 2.5, expire=20 * DAY).select("pose_id")

    return _collected(spark, d, run, "keyframes")


@query("stream_smooth")
def stream_smooth(spark, d):
    def run(live):
        out = feeds.smooth(_quick(live), VS, fusion.SmoothOptions(max_dt=2.0), lateness="2 seconds")
        return out.select("vehicle_id", "source", "pose_id", *[F.round(f"s_{f}", 4).alias(f) for f in XYZ])

    return _collected(spark, d, run, "smooth")


@query(
    "drop_stale",
    """SELECT s.pose_id AS scan_id, p.pose_id FROM poses s JOIN poses p ON p.vehicle_id = s.vehicle_id AND s.source = 'front' AND p.source = 'back' AND abs(s.t - p.t) <= 21600""",
    ("poses",),
)
def drop_stale(spark, d):
    def run(live):
        scans = live.where("source = 'front'").select("vehicle_id", F.col("pose_id").alias("scan_id"), "ts")
        return feeds.drop_stale(scans, live.where("source = 'back'"), V, 21600.0, "1 hour").select("scan_id", "pose_id")

    return _collected(spark, d, run, "stale")
