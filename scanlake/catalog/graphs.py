"""Queries on selections, pose graphs and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.catalog.images import indexed
from scanlake.catalog.poses import _Q, DAY, V
from scanlake.catalog.registry import q6, query, r6, rounded, sql_between
from scanlake.functions import vectors
from scanlake.functions.poses import FIELDS
from scanlake.operators import graph, images, selection
from scanlake.operators import timeline
from scanlake.sources import shapes as fx

BLOCK = fx.BLOCK
VARS = [f"var{i}" for i in range(6)]


# ---- selections -------------------------------------------------------------------------------


def _masked(spark, d):
    base = images.curvature(indexed(spark, d))
    masked = images.parallel_mask(images.occlusion_mask(base))
    return masked.withColumn("blocked", F.col("occluded") | F.col("parallel"))


def _bounds(spark, d):
    return images.ring_bounds(images.first_hit(fx.points(spark, d)), 16)


@query("pick_corners")
def pick_corners(spark, d):
    return selection.pick_corners(_masked(spark, d), _bounds(spark, d))


@query("pick_surfaces")
def pick_surfaces(spark, d):
    return selection.pick_surfaces(selection.pick_features(_masked(spark, d), _bounds(spark, d)))


@query("pick_classes")
def pick_classes(spark, d):
    return selection.pick_classes(images.curvature_xyz(indexed(spark, d)), _bounds(spark, d))


@query(
    "sample_interval",
    """WITH RECURSIVE k(vehicle_id, t) AS (SELECT vehicle_id, min(t) FROM poses GROUP BY 1
UNION ALL SELECT k.vehicle_id, min(p.t) FROM k JOIN poses p ON p.vehicle_id = k.vehicle_id AND p.t >= k.t + 86400 GROUP BY 1)
SELECT p.pose_id FROM k JOIN poses p USING (vehicle_id, t)""",
    ("poses",),
)
def sample_interval(spark, d):
    return selection.sample_interval(fx.poses(spark, d), V, DAY, width=fx.FOLD_BLOCK).select("pose_id")


def _moved_sql() -> str:
    rel = sql_between("k.", "p.")
    turned = " OR ".join(f"abs({rel[a]}) >= 2.5" for a in ("roll", "pitch", "yaw"))
    return f"({turned} OR sqrt((p.x-k.x)*(p.x-k.x) + (p.y-k.y)*(p.y-k.y) + (p.z-k.z)*(p.z-k.z)) >= 15)"


@query(
    "select_keyframes",
    f"""WITH RECURSIVE f AS (SELECT * FROM poses WHERE source = 'front'),
nx AS (SELECT k.pose_id, arg_min(p.pose_id, p.t) AS next_id FROM f k JOIN f p ON p.vehicle_id = k.vehicle_id AND p.t > k.t AND {_moved_sql()} GROUP BY 1),
s(pose_id) AS (SELECT arg_min(pose_id, t) FROM f GROUP BY vehicle_id UNION ALL SELECT nx.next_id FROM s JOIN nx ON nx.pose_id = s.pose_id)
SELECT pose_id FROM s""",
    ("poses",),
)
def select_keyframes(spark, d):
    front = fx.poses(spark, d).where("source = 'front'")
    return selection.select_keyframes(front, V, 15.0, 2.5, width=fx.FOLD_BLOCK).select("pose_id")


@query(
    "sampled_path",
    """WITH RECURSIVE k(vehicle_id, t) AS (SELECT vehicle_id, min(t) FROM poses GROUP BY 1
UNION ALL SELECT k.vehicle_id, min(p.t) FROM k JOIN poses p ON p.vehicle_id = k.vehicle_id AND p.t > k.t + 21600 GROUP BY 1),
thin AS (SELECT p.* FROM k JOIN poses p USING (vehicle_id, t))
SELECT a.pose_id, string_agg(CAST(b.pose_id AS VARCHAR), ',' ORDER BY b.t) AS path FROM thin a JOIN thin b
ON a.vehicle_id = b.vehicle_id AND b.t BETWEEN a.t - 172800 AND a.t GROUP BY 1""",
    ("poses",),
)
def sampled_path(spark, d):
    """Trailing path over a thinned feed: a pose joins only when enough time passed."""
    from scanlake.operators.trajectory import recent_path

    thin = selection.sample_interval(fx.poses(spark, d), V, DAY / 4, width=fx.FOLD_BLOCK, strict=True)
    out = recent_path(thin, V, 2 * DAY, "pose_id")
    return out.select("pose_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


# ---- bags and registries ----------------------------------------------------------------------


@query(
    "features_union",
    "SELECT scan_id, point_idx, 'corner' AS kind FROM points WHERE ring < 8 UNION ALL SELECT scan_id, point_idx, 'surface' FROM points WHERE ring >= 4",
    ("points",),
)
def features_union(spark, d):
    pts = fx.points(spark, d).select("scan_id", "point_idx", "ring")
    corners = pts.where("ring < 8").withColumn("kind", F.lit("corner"))
    surfaces = pts.where("ring >= 4").withColumn("kind", F.lit("surface"))
    return corners.unionByName(surfaces).drop("ring")


_PREVKF = ", ".join(f"lag({f}) OVER w AS p{f}" for f in FIELDS)
_LOOPS = """lp AS (SELECT a.vehicle_id, a.kf_id, a.kf_id // 2 AS loop_id, abs(a.roll) + CAST(0.01 AS DOUBLE) AS fitness FROM keyframes a WHERE a.kf_id % 5 = 4)"""
_PRIORS = """pr AS (SELECT a.vehicle_id, a.kf_id, a.kf_id - 1 AS linked_id, abs(a.pitch) AS fitness FROM keyframes a WHERE a.kf_id % 7 = 6)"""
_REL = {k: v for k, v in sql_between("a.", "b.").items()}
_EDGES = f"""e AS (
SELECT vehicle_id, CASE WHEN px IS NULL THEN 'first' ELSE 'odometry' END AS kind, CASE WHEN px IS NULL THEN kf_id ELSE kf_id - 1 END AS from_id, kf_id AS to_id,
  {', '.join(f'CASE WHEN px IS NULL THEN {k} ELSE {v} END AS {k}' for k, v in sql_between('p', '').items())}, false AS robust,
  {', '.join(f'CASE WHEN px IS NULL THEN {a} ELSE CAST({b} AS DOUBLE) END AS var{i}' for i, (a, b) in enumerate(zip(('CAST(0.01 AS DOUBLE)', 'CAST(0.01 AS DOUBLE)', 'pi()*pi()', '1e8', '1e8', '1e8'), graph.ODOMETRY_VARIANCES)))}
FROM (SELECT *, {_PREVKF} FROM keyframes WINDOW w AS (PARTITION BY vehicle_id ORDER BY kf_id))
UNION ALL SELECT lp.vehicle_id, 'loop', lp.kf_id, lp.loop_id, {', '.join(_REL[f] for f in FIELDS)}, true, {', '.join(['fitness'] * 6)}
FROM lp JOIN keyframes a ON a.vehicle_id = lp.vehicle_id AND a.kf_id = lp.kf_id JOIN keyframes b ON b.vehicle_id = lp.vehicle_id AND b.kf_id = lp.loop_id
UNION ALL SELECT pr.vehicle_id, 'prior', pr.linked_id, pr.kf_id, {', '.join(_REL[f] for f in FIELDS)}, false,
  greatest(fitness, CAST(1e-6 AS DOUBLE))*100, greatest(fitness, CAST(1e-6 AS DOUBLE))*100, 1e-6, 1e-6, 1e-6, greatest(fitness, CAST(1e-6 AS DOUBLE))*100
FROM pr JOIN keyframes a ON a.vehicle_id = pr.vehicle_id AND a.kf_id = pr.linked_id JOIN keyframes b ON b.vehicle_id = pr.vehicle_id AND b.kf_id = pr.kf_id)"""


def _edges(spark, d):
    kf = fx.keyframes(spark, d)
    loops = kf.where("kf_id % 5 = 4").select(
        *V, "kf_id", F.floor(F.col("kf_id") / 2).alias("loop_id"), (F.abs("roll") + 0.01).alias("fitness"),
        F.lit(True).alias("robust"),
    )
    priors = kf.where("kf_id % 7 = 6").select(
        *V, "kf_id", (F.col("kf_id") - 1).alias("linked_id"), F.abs("pitch").alias("fitness")
    )
    return kf, graph.graph_edges(
        graph.odometry_edges(kf, V, width=BLOCK), graph.loop_edges(loops, kf, V), graph.prior_edges(priors, kf, V)
    )


@query(
    "graph_edges",
    f"WITH {_LOOPS}, {_PRIORS}, {_EDGES} SELECT vehicle_id, kind, from_id, to_id, robust, "
    + ", ".join(f"{q6(c)} AS {c}" for c in (*FIELDS, *VARS)) + " FROM e",
    ("keyframes",),
)
def graph_edges(spark, d):
    return rounded(_edges(spark, d)[1], ["vehicle_id", "kind", "from_id", "to_id", "robust"], [*FIELDS, *VARS])


@query(
    "new_loops",
    """WITH c AS (SELECT vehicle_id, kf_id, kf_id - 20 AS loop_id FROM keyframes), o AS (SELECT vehicle_id, kf_id FROM keyframes WHERE kf_id % 3 = 0)
SELECT vehicle_id, kf_id, loop_id FROM c ANTI JOIN o USING (vehicle_id, kf_id) WHERE loop_id >= 0""",
    ("keyframes",),
)
def new_loops(spark, d):
    kf = fx.keyframes(spark, d)
    candidates = kf.select(*V, "kf_id", (F.col("kf_id") - 20).alias("loop_id"))
    return graph.new_loops(candidates, kf.where("kf_id % 3 = 0"), kf, V).select(*V, "kf_id", "loop_id")


@query(
    "upsert_loops",
    "SELECT vehicle_id, kf_id, CASE WHEN kf_id % 4 = 0 THEN kf_id // 3 ELSE kf_id // 2 END AS loop_id, CASE WHEN kf_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM keyframes",
    ("keyframes",),
)
def upsert_loops(spark, d):
    kf = fx.keyframes(spark, d)
    old = kf.select(*V, "kf_id", F.floor(F.col("kf_id") / 2).alias("loop_id"), F.lit(1).alias("version"))
    new = kf.where("kf_id % 4 = 0").select(*V, "kf_id", F.floor(F.col("kf_id") / 3).alias("loop_id"), F.lit(2).alias("version"))
    return graph.upsert_loops(old, new, V)


@query(
    "apply_corrections",
    f"SELECT vehicle_id, kf_id, {q6('CASE WHEN kf_id % 2 = 0 THEN x + 1 ELSE x END')} AS x, {q6('CASE WHEN kf_id % 2 = 0 THEN yaw / 2 ELSE yaw END')} AS yaw FROM keyframes",
    ("keyframes",),
)
def apply_corrections(spark, d):
    kf = fx.keyframes(spark, d)
    fixed = kf.where("kf_id % 2 = 0").withColumns({"x": F.col("x") + 1, "yaw": F.col("yaw") / 2})
    return rounded(graph.apply_corrections(kf, fixed, V), ["vehicle_id", "kf_id"], ["x", "yaw"])


@query(
    "prior_gate",
    """SELECT pose_id FROM poses WHERE abs(z - CAST(0.1 AS DOUBLE)) <= 0.5 AND abs(atan2(sin(roll*40), cos(roll*40))) <= 1 AND abs(atan2(sin(pitch*50 - yaw), cos(pitch*50 - yaw))) <= 1""",
    ("poses",),
)
def prior_gate(spark, d):
    df = fx.poses(spark, d).select(
        "pose_id", F.col("z").alias("o_z"), F.lit(0.1).alias("p_z"), (F.col("roll") * 40).alias("o_roll"),
        F.lit(0.0).alias("p_roll"), (F.col("pitch") * 50).alias("o_pitch"), F.col("yaw").alias("p_pitch"),
    )
    return graph.prior_gate(df, 0.5, 1.0).select("pose_id")


@query(
    "snapshot",
    f"""WITH s AS (SELECT vehicle_id, least(count(DISTINCT kf_id) FILTER (WHERE ring < 8), count(DISTINCT kf_id) FILTER (WHERE ring >= 8)) AS n FROM keyframe_points GROUP BY 1)
SELECT vehicle_id, kf_id, {', '.join(f'{q6(f)} AS {f}' for f in FIELDS)} FROM keyframes JOIN s USING (vehicle_id) WHERE kf_id < n""",
    ("keyframe_points", "keyframes"),
)
def snapshot(spark, d):
    kp = fx.keyframe_points(spark, d)
    out = graph.snapshot(fx.keyframes(spark, d), kp.where("ring < 8"), kp.where("ring >= 8"), V)
    return rounded(out, ["vehicle_id", "kf_id"], list(FIELDS))


_TEXT = [f"round({c}, 6) + CAST(0 AS DOUBLE)" for c in ("x", "y", "z", *_Q)]


@query(
    "trajectory_lines",
    f"SELECT vehicle_id, kf_id, printf('%.6f' || repeat(' %.6f', 7), t, {', '.join(_TEXT)}) AS line FROM keyframes",
    ("keyframes",),
)
def trajectory_lines(spark, d):
    return graph.trajectory_lines(fx.keyframes(spark, d)).select("vehicle_id", "kf_id", "line")


@query(
    "graph_lines",
    f"""WITH {_LOOPS}, {_PRIORS}, {_EDGES}
SELECT vehicle_id, 0 AS part, kf_id AS a, CAST(-1 AS BIGINT) AS b, printf('VERTEX_SE3:QUAT %d' || repeat(' %.6f', 7), kf_id, {', '.join(_TEXT)}) AS line FROM keyframes
UNION ALL SELECT vehicle_id, CASE kind WHEN 'odometry' THEN 1 WHEN 'loop' THEN 2 ELSE 3 END, from_id, to_id,
  printf('EDGE_SE3:QUAT %d %d' || repeat(' %.6f', 7), from_id, to_id, {', '.join(_TEXT)}) FROM e WHERE kind <> 'first'""",
    ("keyframes",),
)
def graph_lines(spark, d):
    kf, edges = _edges(spark, d)
    return graph.graph_lines(kf, edges, V)


@query(
    "permute_covariance",
    "WITH a AS (SELECT pose_id, x + range AS v, range AS i FROM poses, range(36)) SELECT pose_id, CAST(range AS INTEGER) AS i, "
    + q6("x + list_value(0,1,2,5,4,3)[range // 6 + 1] * 6 + list_value(0,1,2,5,4,3)[range % 6 + 1]")
    + " AS v FROM poses, range(36)",
    ("poses",),
)
def permute_covariance(spark, d):
    full = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.col("x") + i)
    df = fx.poses(spark, d).select("pose_id", full.alias("c"))
    out = df.select("pose_id", F.posexplode(vectors.permute_covariance(F.col("c"), [0, 1, 2, 5, 4, 3])).alias("i", "v"))
    return out.select("pose_id", "i", r6("v").alias("v"))


@query("number_rows", "SELECT vehicle_id, pose_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY t) - 1 AS seq FROM poses", ("poses",))
def number_rows(spark, d):
    return timeline.number_rows(fx.poses(spark, d), V, "ts", "seq", BLOCK).select("vehicle_id", "pose_id", "seq")


