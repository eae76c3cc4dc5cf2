"""Queries on neighbour joins, fits and terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.catalog.registry import q6, q6s, query, r6, rounded, sql_matvec, sql_rotation
from scanlake.functions.matrices import nearest_psd
from scanlake.operators import fits, neighbours as nb, terrain, voxels
from scanlake.operators.scans import transform_points
from scanlake.sources import shapes as fx

XYZ = ["x", "y", "z"]
COV = ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"]
V = ["vehicle_id"]
DAY = 86400.0
CELLS = [4.0, 8.0, 16.0, 32.0]


def _d2(a: str, b: str, dims="xyz") -> str:
    return "(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in dims) + ")"


_QUERY_POINTS = "q AS (SELECT vehicle_id, kf_id, point_idx, x + CAST(0.5 AS DOUBLE) AS x, y - CAST(0.25 AS DOUBLE) AS y, z FROM keyframe_points)"


def _shifted(spark, d, kp=None):
    kp = fx.keyframe_points(spark, d) if kp is None else kp
    return kp.withColumns({"x": F.col("x") + 0.5, "y": F.col("y") - 0.25})


def _scan_map(spark, d, kp=None):
    """All points of a vehicle as its map."""
    return (fx.keyframe_points(spark, d) if kp is None else kp).select("vehicle_id", "point_idx", *XYZ)


_KNN5 = f"""{_QUERY_POINTS}, m AS (SELECT vehicle_id, point_idx, x, y, z FROM keyframe_points),
k AS (SELECT q.vehicle_id, q.point_idx, m.point_idx AS n_point_idx, {_d2('q', 'm')} AS d2, m.x AS nx, m.y AS ny, m.z AS nz,
  row_number() OVER (PARTITION BY q.vehicle_id, q.point_idx ORDER BY {_d2('q', 'm')}, m.point_idx) AS rank
  FROM q JOIN m ON q.vehicle_id = m.vehicle_id AND {_d2('q', 'm')} < 64 QUALIFY rank <= 5),
f AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY vehicle_id, point_idx) = 5)"""


@query(
    "knn_join",
    f"WITH {_KNN5} SELECT vehicle_id, point_idx, n_point_idx, CAST(rank AS INTEGER) AS rank, {q6('d2')} AS d2 FROM f",
    ("keyframe_points",),
)
def knn_join(spark, d):
    out = nb.knn_join(
        _shifted(spark, d), _scan_map(spark, d), V, 5, "point_idx", "point_idx", [4.0, 8.0], max_d=8.0, complete=True
    )
    return rounded(out, ["vehicle_id", "point_idx", "n_point_idx", "rank"], ["d2"])


_SELF10 = f"""k AS (SELECT a.scan_id, a.point_idx, b.x, b.y, b.z, b.point_idx AS n_point_idx, {_d2('a', 'b')} AS d2,
  row_number() OVER (PARTITION BY a.scan_id, a.point_idx ORDER BY {_d2('a', 'b')}, b.point_idx) AS rank
  FROM points a JOIN points b ON a.scan_id = b.scan_id QUALIFY rank <= 10)"""


@query(
    "knn_self",
    f"WITH {_SELF10} SELECT scan_id, point_idx, n_point_idx, CAST(rank AS INTEGER) AS rank, {q6('d2')} AS d2 FROM k",
    ("points",),
)
def knn_self(spark, d):
    pts = fx.points(spark, d).select("scan_id", "point_idx", *XYZ)
    out = nb.knn_self(pts, ["scan_id"], 10, "point_idx", CELLS)
    return rounded(out, ["scan_id", "point_idx", "n_point_idx", "rank"], ["d2"])


_MOMENTS = ", ".join(f"covar_pop({a}, {b}) AS c{a}{b}" for a, b in fits.PAIRS)


@query(
    "local_cov",
    f"""WITH {_SELF10}, c AS (SELECT scan_id, point_idx, {', '.join(f'avg({c}) AS m{c}' for c in XYZ)}, {_MOMENTS} FROM k GROUP BY 1, 2 HAVING count(*) = 10)
SELECT scan_id, point_idx, {q6s(['mx', 'my', 'mz', *COV])} FROM c""",
    ("points",),
)
def local_cov(spark, d):
    pts = fx.points(spark, d).select("scan_id", "point_idx", *XYZ)
    out = fits.local_cov(pts, ["scan_id"], 10, "point_idx", CELLS)
    return rounded(out, ["scan_id", "point_idx"], ["mx", "my", "mz", *COV])


def _regularised(method: str):
    def run(spark, d):
        pts = fx.points(spark, d).select("scan_id", "point_idx", *XYZ)
        out = fits.local_cov(pts, ["scan_id"], 10, "point_idx", CELLS, method)
        return rounded(out, ["scan_id", "point_idx"], COV)

    return run


for _method in ("frobenius", "plane", "min_eig", "normalized_min_eig", "plane_s"):
    query(f"local_cov_{_method}")(_regularised(_method))


@query(
    "radius_join",
    f"""WITH j AS (SELECT a.scan_id, a.point_idx, b.point_idx AS n_point_idx, sqrt({_d2('a', 'b')}) AS d FROM points a JOIN points b
  ON a.scan_id = b.scan_id AND {_d2('a', 'b')} <= 16)
SELECT scan_id, point_idx, n_point_idx, {q6('d')} AS d, {q6('greatest(least(1 - d/4, CAST(1 AS DOUBLE)), CAST(0.001 AS DOUBLE))')} AS w FROM j""",
    ("points",),
)
def radius_join(spark, d):
    pts = fx.points(spark, d).select("scan_id", "point_idx", *XYZ)
    out = nb.radius_join(pts, pts, ["scan_id"], 4.0, "point_idx", "point_idx")
    return rounded(out, ["scan_id", "point_idx", "n_point_idx"], ["d", "w"])


@query(
    "weighted_neighbours",
    f"""WITH j AS (SELECT a.scan_id, a.point_idx, b.x, b.y, b.z, greatest(least(1 - sqrt({_d2('a', 'b')})/4, CAST(1 AS DOUBLE)), CAST(0.001 AS DOUBLE)) AS w
  FROM points a JOIN points b ON a.scan_id = b.scan_id AND {_d2('a', 'b')} <= 16)
SELECT scan_id, point_idx, count(*) AS n, {q6('sum(w)')} AS w, {', '.join(f'{q6(f"sum(w*{c})/sum(w)")} AS m{c}' for c in XYZ)},
 {', '.join(f'{q6(f"sum(w*{a}*{b})/sum(w) - sum(w*{a})*sum(w*{b})/(sum(w)*sum(w))")} AS c{a}{b}' for a, b in fits.PAIRS)} FROM j GROUP BY 1, 2""",
    ("points",),
)
def weighted_neighbours(spark, d):
    pts = fx.points(spark, d).select("scan_id", "point_idx", *XYZ)
    sums = nb.radius_join(pts, pts, ["scan_id"], 4.0, "point_idx", "point_idx", sums=nb.PLACES)
    out = nb.weighted_neighbours(sums, ["scan_id", "point_idx"])
    return rounded(out, ["scan_id", "point_idx", "n"], ["w", "mx", "my", "mz", *COV])


_OWN = {f"c{a}{b}": f"(0.1 + ring * 0.01 * {i + 1})" for i, (a, b) in enumerate(fits.PAIRS)}


@query(
    "weighted_covariances",
    f"""WITH j AS (SELECT a.scan_id, a.point_idx, b.x, b.y, b.z, b.ring, greatest(least(1 - sqrt({_d2('a', 'b')})/4, CAST(1 AS DOUBLE)), CAST(0.001 AS DOUBLE)) AS w
  FROM points a JOIN points b ON a.scan_id = b.scan_id AND {_d2('a', 'b')} <= 16)
SELECT scan_id, point_idx, count(*) AS n, {', '.join(f'{q6(f"sum(w*{c})/sum(w)")} AS m{c}' for c in XYZ)}, {', '.join(f'{q6(f"sum(w*{v})/sum(w)")} AS {c}' for c, v in _OWN.items())}
FROM j GROUP BY 1, 2""",
    ("points",),
)
def weighted_covariances(spark, d):
    """Every point has a covariance of its own, here made from its ring."""
    pts = fx.points(spark, d).select("scan_id", "point_idx", "ring", *XYZ)
    own = pts.select("*", *[F.expr(v.replace("0.1 +", "0.1D +").replace("0.01", "0.01D")).alias(c) for c, v in _OWN.items()])
    sums = nb.radius_join(pts, own, ["scan_id"], 4.0, "point_idx", "point_idx", values=list(_OWN), sums=nb.COVARIANCES)
    out = nb.weighted_covariances(sums, ["scan_id", "point_idx"])
    return rounded(out, ["scan_id", "point_idx", "n"], ["mx", "my", "mz", *_OWN])


_NEWEST = "c AS (SELECT vehicle_id, arg_max(x, kf_id) AS cx, arg_max(y, kf_id) AS cy, arg_max(z, kf_id) AS cz, max(t) AS ct, max(kf_id) AS ck FROM keyframes GROUP BY 1)"


@query(
    "near_keyframes",
    f"""WITH {_NEWEST} SELECT vehicle_id, kf_id, {q6('sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz))')} AS d FROM keyframes JOIN c USING (vehicle_id)
WHERE sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) <= 15""",
    ("keyframes",),
)
def near_keyframes(spark, d):
    return rounded(nb.near_keyframes(fx.keyframes(spark, d), 15.0), ["vehicle_id", "kf_id"], ["d"])


_THIN = f"""t AS (SELECT vehicle_id, floor(x/10) AS gx, floor(y/10) AS gy, floor(z/10) AS gz, avg(x) AS x, avg(y) AS y, avg(z) AS z
  FROM keyframes JOIN c USING (vehicle_id) WHERE sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) <= 30 GROUP BY 1, 2, 3, 4),
s AS (SELECT t.vehicle_id, t.gx, t.gy, t.gz, arg_min(k.kf_id, {_d2('t', 'k')}) AS kf_id, min({_d2('t', 'k')}) AS d2 FROM t JOIN keyframes k USING (vehicle_id) GROUP BY 1, 2, 3, 4)"""


def _thinned(spark, d):
    kf = fx.keyframes(spark, d)
    thin = voxels.voxel_downsample(nb.near_keyframes(kf, 30.0), V, 10.0)
    return kf, thin.withColumn("thin_id", F.struct("vx", "vy", "vz"))


@query(
    "snap_nearest",
    f"WITH {_NEWEST}, {_THIN} SELECT vehicle_id, CAST(gx AS BIGINT) AS vx, CAST(gy AS BIGINT) AS vy, CAST(gz AS BIGINT) AS vz, kf_id, {q6('d2')} AS d2 FROM s",
    ("keyframes",),
)
def snap_nearest(spark, d):
    kf, thin = _thinned(spark, d)
    out = nb.snap_nearest(thin, kf, V, "thin_id", "kf_id")
    return out.select("vehicle_id", "thin_id.vx", "thin_id.vy", "thin_id.vz", "kf_id", r6("d2").alias("d2"))


@query(
    "local_keyframes",
    f"""WITH {_NEWEST}, {_THIN} SELECT vehicle_id, kf_id FROM s UNION ALL
SELECT vehicle_id, kf_id FROM keyframes JOIN c USING (vehicle_id) WHERE ct - t < 259200""",
    ("keyframes",),
)
def local_keyframes(spark, d):
    return nb.local_keyframes(fx.keyframes(spark, d), 30.0, 10.0, 3 * DAY)


@query(
    "nearest_xy",
    f"""SELECT query_id, tile_id, arg_min(point_idx, d2) AS n_point_idx, {q6('min(d2)')} AS d2 FROM (SELECT q.query_id, q.tile_id, g.point_idx,
  (qx - x)*(qx - x) + (qy - y)*(qy - y) AS d2 FROM ground_queries q JOIN ground g USING (tile_id)) GROUP BY 1, 2""",
    ("ground", "ground_queries"),
)
def nearest_xy(spark, d):
    q = fx.ground_queries(spark, d).select("query_id", "tile_id", F.col("qx").alias("x"), F.col("qy").alias("y"))
    out = nb.nearest_xy(q, fx.ground(spark, d), ["tile_id"], "query_id", "point_idx")
    return rounded(out, ["query_id", "tile_id", "n_point_idx"], ["d2"])


_NEAR_XY = "(qx - x)*(qx - x) + (qy - y)*(qy - y)"


@query(
    "radius_xy",
    f"SELECT query_id, tile_id, point_idx AS n_point_idx, {q6(f'sqrt({_NEAR_XY})')} AS d FROM ground_queries JOIN ground USING (tile_id) WHERE {_NEAR_XY} <= 36",
    ("ground", "ground_queries"),
)
def radius_xy(spark, d):
    q = fx.ground_queries(spark, d).select("query_id", "tile_id", F.col("qx").alias("x"), F.col("qy").alias("y"))
    out = nb.radius_xy(q, fx.ground(spark, d), ["tile_id"], 6.0, "query_id", "point_idx")
    return rounded(out, ["query_id", "tile_id", "n_point_idx"], ["d"])


@query(
    "crop_patch",
    "SELECT query_id, tile_id, point_idx, label FROM ground_queries JOIN ground USING (tile_id) WHERE x BETWEEN qx - 10 AND qx + 10 AND y BETWEEN qy - 10 AND qy + 10",
    ("ground", "ground_queries"),
)
def crop_patch(spark, d):
    centres = fx.ground_queries(spark, d).select("query_id", "tile_id", F.col("qx").alias("cx"), F.col("qy").alias("cy"))
    out = nb.crop_patch(fx.ground(spark, d), centres, ["tile_id"], 20.0, "query_id")
    return out.select("query_id", "tile_id", "point_idx", "label")


@query(
    "key_window",
    """SELECT a.vehicle_id, a.kf_id, b.kf_id AS near_id FROM keyframes a JOIN keyframes b ON a.vehicle_id = b.vehicle_id AND b.kf_id BETWEEN a.kf_id - 3 AND a.kf_id + 3""",
    ("keyframes",),
)
def key_window(spark, d):
    kf = fx.keyframes(spark, d)
    return nb.key_window(kf.select("vehicle_id", "kf_id"), kf, 3)


_MOVE = sql_matvec(sql_rotation("k.roll", "k.pitch", "k.yaw"), ["p.x", "p.y", "p.z"])
_WORLD = f"""w AS (SELECT vehicle_id, kf_id, point_idx, {', '.join(f'{v} + k.{c} AS {c}' for v, c in zip(_MOVE, XYZ))}
  FROM keyframe_points p JOIN keyframes k USING (vehicle_id, kf_id))"""


@query(
    "assemble_submap",
    f"""WITH {_WORLD}, s AS (SELECT a.vehicle_id, a.kf_id AS centre, b.kf_id FROM keyframes a JOIN keyframes b ON a.vehicle_id = b.vehicle_id AND b.kf_id BETWEEN a.kf_id - 1 AND a.kf_id + 1)
SELECT vehicle_id, centre, {', '.join(f'CAST(floor({c} / 2) AS BIGINT) AS v{c}' for c in XYZ)}, count(*) AS n, {', '.join(f'{q6(f"avg({c})")} AS {c}' for c in XYZ)}
FROM w JOIN s USING (vehicle_id, kf_id) GROUP BY 1, 2, 3, 4, 5""",
    ("keyframe_points", "keyframes"),
)
def assemble_submap(spark, d):
    kf = fx.keyframes(spark, d)
    near = nb.key_window(kf.select("vehicle_id", "kf_id"), kf, 1)
    selected = near.select("vehicle_id", F.col("kf_id").alias("centre"), F.col("near_id").alias("kf_id"))
    out = nb.assemble_submap(selected, kf, fx.keyframe_points(spark, d), leaf=2.0, group=["centre"])
    return rounded(out, ["vehicle_id", "centre", "vx", "vy", "vz", "n"], XYZ)


@query(
    "loop_by_radius",
    f"""SELECT q.vehicle_id, q.kf_id, arg_min(c.kf_id, {_d2('q', 'c')}) AS loop_id, {q6(f'min({_d2("q", "c")})')} AS d2 FROM keyframes q JOIN keyframes c
ON q.vehicle_id = c.vehicle_id AND c.t < q.t - 432000 AND {_d2('q', 'c')} < 100 GROUP BY 1, 2""",
    ("keyframes",),
)
def loop_by_radius(spark, d):
    return rounded(
        nb.loop_by_radius(fx.keyframes(spark, d), 10.0, 5 * DAY), ["vehicle_id", "kf_id", "loop_id"], ["d2"]
    )


@query(
    "match_priors",
    f"""WITH p AS (SELECT vehicle_id, kf_id AS prior_id, kf_id AS linked_id, x + 4*cos(yaw) AS x, y + 4*sin(yaw) AS y FROM keyframes)
SELECT k.vehicle_id, k.kf_id, min(prior_id) AS prior_id, arg_min(linked_id, prior_id) AS linked_id, {q6('arg_min(sqrt((k.x-p.x)*(k.x-p.x) + (k.y-p.y)*(k.y-p.y)), prior_id)')} AS d
FROM keyframes k JOIN p ON k.vehicle_id = p.vehicle_id AND p.linked_id < k.kf_id AND (k.x-p.x)*(k.x-p.x) + (k.y-p.y)*(k.y-p.y) < 25 GROUP BY 1, 2""",
    ("keyframes",),
)
def match_priors(spark, d):
    kf = fx.keyframes(spark, d)
    priors = kf.select(
        "vehicle_id", F.col("kf_id").alias("prior_id"), F.col("kf_id").alias("linked_id"),
        (F.col("x") + 4 * F.cos("yaw")).alias("x"), (F.col("y") + 4 * F.sin("yaw")).alias("y"),
    )
    return rounded(nb.match_priors(priors, kf, 5.0), ["vehicle_id", "kf_id", "prior_id", "linked_id"], ["d"])


# ---- fits -------------------------------------------------------------------------------------

_S = "a AS (SELECT vehicle_id, point_idx, " + ", ".join(
    f"sum(n{a}*n{b}) AS s{a}{b}" for a, b in fits.PAIRS
) + ", sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM f GROUP BY 1, 2)"
_DET = "(sxx*(syy*szz - syz*syz) - sxy*(sxy*szz - syz*sxz) + sxz*(sxy*syz - syy*sxz))"
_DX = "(-sx*(syy*szz - syz*syz) - sxy*(-sy*szz + syz*sz) + sxz*(-sy*syz + syy*sz))"
_DY = "(sxx*(-sy*szz + syz*sz) + sx*(sxy*szz - syz*sxz) + sxz*(-sxy*sz + sy*sxz))"
_DZ = "(sxx*(-syy*sz + sy*syz) - sxy*(-sxy*sz + sy*sxz) - sx*(sxy*syz - syy*sxz))"


@query(
    "plane_matches",
    f"""WITH {_KNN5}, {_S}, p AS (SELECT vehicle_id, point_idx, {_DX}/{_DET} AS ux, {_DY}/{_DET} AS uy, {_DZ}/{_DET} AS uz FROM a WHERE abs({_DET}) > 1e-12),
u AS (SELECT vehicle_id, point_idx, ux/l AS ux, uy/l AS uy, uz/l AS uz, 1/l AS ud FROM (SELECT *, sqrt(ux*ux + uy*uy + uz*uz) AS l FROM p) WHERE l > 0),
v AS (SELECT u.vehicle_id, u.point_idx, any_value(ux) AS ux, any_value(uy) AS uy, any_value(uz) AS uz, any_value(ud) AS ud
  FROM u JOIN f USING (vehicle_id, point_idx) GROUP BY 1, 2 HAVING max(abs(ux*nx + uy*ny + uz*nz + ud)) <= CAST(1.0037 AS DOUBLE)),
r AS (SELECT v.*, ux*x + uy*y + uz*z + ud AS d, sqrt(sqrt(x*x + y*y + z*z)) AS reach FROM v JOIN q USING (vehicle_id, point_idx)),
w AS (SELECT *, 1 - CAST(0.9 AS DOUBLE)*abs(d)/reach AS w FROM r)
SELECT vehicle_id, point_idx, {q6('w*ux')} AS a, {q6('w*uy')} AS b, {q6('w*uz')} AS c, {q6('w*d')} AS d, {q6('w')} AS w FROM w WHERE w > 0.1""",
    ("keyframe_points",),
)
def plane_matches(spark, d):
    kp = fx.keyframe_points(spark, d)
    out = fits.plane_matches(
        _shifted(spark, d, kp), _scan_map(spark, d, kp), V, "point_idx", "point_idx", max_d=8.0, tolerance=1.0037
    )
    return rounded(out, ["vehicle_id", "point_idx"], ["a", "b", "c", "d", "w"])


@query("edge_matches")
def edge_matches(spark, d):
    out = fits.edge_matches(_shifted(spark, d), _scan_map(spark, d), V, "point_idx", "point_idx", max_d=8.0)
    return out.select("vehicle_id", "point_idx", F.round("d", 5).alias("d"), F.round("w", 5).alias("w"))


@query("normals")
def normals(spark, d):
    pts = fx.points(spark, d).select("scan_id", "point_idx", *XYZ)
    out = fits.normals(pts, ["scan_id"], 10, "point_idx", CELLS)
    return rounded(out, ["scan_id", "point_idx"], ["nx", "ny", "nz", "curvature"])


@query("fpfh")
def fpfh(spark, d):
    pts = fx.points(spark, d).select("scan_id", "point_idx", *XYZ)
    nrm = fits.normals(pts, ["scan_id"], 10, "point_idx", CELLS)
    out = fits.fpfh(nrm, ["scan_id"], 10, "point_idx", CELLS)
    return out.select("scan_id", "point_idx", F.col("bin").cast("int").alias("bin"), F.round("value", 3).alias("value"))


@query(
    "nearest_psd",
    f"""WITH e AS (SELECT pose_id, x AS a, (z + y)/2 AS b, yaw AS c, (x + yaw)/2 AS mid, sqrt((x - yaw)*(x - yaw)/4 + (z + y)*(z + y)/4) AS r FROM poses),
f AS (SELECT *, greatest(mid + r, 1e-9) AS hi, greatest(mid - r, 1e-9) AS lo FROM e),
g AS (SELECT *, CASE WHEN r > 0 THEN (hi - lo)/(2*r) ELSE 0 END AS g FROM f)
SELECT pose_id, {q6('g*(a - mid + r) + lo')} AS m00, {q6('g*b')} AS m01, {q6('g*b')} AS m10, {q6('g*(c - mid + r) + lo')} AS m11 FROM g""",
    ("poses",),
)
def nearest_psd_query(spark, d):
    """A 2x2 matrix, made symmetric, with its eigenvalues raised: M = g (S - low I) + low' I in closed form."""
    pair = F.array(F.col("x"), F.col("z"), F.col("y"), F.col("yaw"))
    fixed = fx.poses(spark, d).select("pose_id", nearest_psd(2)(pair).alias("m"))
    return fixed.select("pose_id", *[r6(F.get("m", i)).alias(n) for i, n in enumerate(("m00", "m01", "m10", "m11"))])


def _aligned_pairs(spark, d):
    kf = fx.keyframes(spark, d)
    kp = fx.keyframe_points(spark, d)
    moved = transform_points(kp, kf, ["vehicle_id", "kf_id"])
    named = moved.select("vehicle_id", "kf_id", "point_idx", *[F.col(c).alias(f"n_{c}") for c in XYZ])
    return kp.join(named, ["vehicle_id", "kf_id", "point_idx"])


@query(
    "alignment_sums",
    f"""WITH {_WORLD} SELECT vehicle_id, kf_id, count(*) AS n, {', '.join(f'{q6(f"avg(p.{c}) + CAST(0.000000137 AS DOUBLE)")} AS s{c}, {q6(f"avg(w.{c}) + CAST(0.000000137 AS DOUBLE)")} AS t{c}' for c in XYZ)},
{', '.join(f'{q6(f"covar_pop(p.{a}, w.{b})")} AS k{a}{b}' for a in XYZ for b in XYZ)} FROM keyframe_points p JOIN w USING (vehicle_id, kf_id, point_idx) GROUP BY 1, 2""",
    ("keyframe_points", "keyframes"),
)
def alignment_sums(spark, d):
    out = fits.alignment_sums(_aligned_pairs(spark, d), ["vehicle_id", "kf_id"])
    # the small shift keeps means that end in a half away from the rounding edge
    means = {f"{p}{c}": F.col(f"{p}{c}") + 0.000000137 for p in "st" for c in XYZ}
    return rounded(
        out.withColumns(means), ["vehicle_id", "kf_id", "n"], [*means, *[f"k{a}{b}" for a in XYZ for b in XYZ]]
    )


_KR = sql_rotation("roll", "pitch", "yaw")


@query(
    "rigid_align",
    f"""SELECT vehicle_id, kf_id, {', '.join(f'round({m}, 5) + CAST(0 AS DOUBLE) AS r{i // 3}{i % 3}' for i, m in enumerate(_KR))},
 {', '.join(f'round({c}, 5) + CAST(0 AS DOUBLE) AS t{c}' for c in XYZ)} FROM keyframes""",
    ("keyframes",),
)
def rigid_align(spark, d):
    """The transform that a keyframe's cloud was moved by is that keyframe's pose, for all keyframes."""
    out = fits.rigid_align(_aligned_pairs(spark, d), ["vehicle_id", "kf_id"])
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]
    return out.select("vehicle_id", "kf_id", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in names])


@query(
    "fitness",
    f"""WITH {_QUERY_POINTS}, n AS (SELECT q.vehicle_id, q.point_idx, min({_d2('q', 'm')}) AS d2 FROM q JOIN keyframe_points m ON q.vehicle_id = m.vehicle_id GROUP BY 1, 2)
SELECT vehicle_id, {q6('avg(d2)')} AS fitness, count(*) AS n FROM n GROUP BY 1""",
    ("keyframe_points",),
)
def fitness(spark, d):
    out = fits.fitness(_shifted(spark, d), _scan_map(spark, d), V, "point_idx", "point_idx", CELLS)
    return rounded(out, ["vehicle_id", "n"], ["fitness"])


# ---- terrain ----------------------------------------------------------------------------------


def _ground_pairs(spark, d):
    q = fx.ground_queries(spark, d).select("query_id", "tile_id", F.col("qx").alias("x"), F.col("qy").alias("y"))
    return nb.radius_xy(q, fx.ground(spark, d), ["tile_id"], 8.0, "query_id", "point_idx")


@query(
    "z_inliers",
    f"""WITH p AS (SELECT query_id, point_idx AS n_point_idx, z, avg(z) OVER w AS m, stddev_pop(z) OVER w AS s FROM ground_queries JOIN ground USING (tile_id)
  WHERE {_NEAR_XY} <= 64 WINDOW w AS (PARTITION BY query_id))
SELECT query_id, n_point_idx FROM p WHERE z BETWEEN m - CAST(1.5 AS DOUBLE)*s AND m + CAST(1.5 AS DOUBLE)*s""",
    ("ground", "ground_queries"),
)
def z_inliers(spark, d):
    out = terrain.z_inliers(_ground_pairs(spark, d), ["tile_id", "query_id"], 1.5)
    return out.select("query_id", "n_point_idx")


_AVG_HEIGHT = """n AS (SELECT query_id, tile_id, arg_min(x, d2) AS cx, arg_min(y, d2) AS cy, arg_min(z, d2) AS cz FROM
  (SELECT q.query_id, q.tile_id, g.x, g.y, g.z, (q.x - g.x)*(q.x - g.x) + (q.y - g.y)*(q.y - g.y) AS d2 FROM q JOIN ground g USING (tile_id)) GROUP BY 1, 2),
h AS (SELECT query_id, tile_id, CASE WHEN count(*) >= 3 THEN avg(z) ELSE any_value(cz) END AS height FROM n JOIN ground g USING (tile_id)
  WHERE (cx - x)*(cx - x) + (cy - y)*(cy - y) <= 36 GROUP BY 1, 2)"""


@query(
    "avg_height",
    f"WITH q AS (SELECT query_id, tile_id, qx AS x, qy AS y FROM ground_queries), {_AVG_HEIGHT} SELECT query_id, {q6('height')} AS height FROM h",
    ("ground", "ground_queries"),
)
def avg_height(spark, d):
    q = fx.ground_queries(spark, d).select("query_id", "tile_id", F.col("qx").alias("x"), F.col("qy").alias("y"))
    out = terrain.avg_height(q, fx.ground(spark, d), ["tile_id"], "query_id", "point_idx", 6.0, 3)
    return rounded(out, ["query_id"], ["height"])


_WHEEL_ROWS = ", ".join(f"({i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for i, (x, y) in enumerate(fx.WHEELS))


@query(
    "initial_z",
    f"""WITH v AS (SELECT * FROM (VALUES {_WHEEL_ROWS}) t(wheel, wx, wy)),
q AS (SELECT query_id * 4 + wheel AS query_id, tile_id, qx + cos(qyaw)*wx - sin(qyaw)*wy AS x, qy + sin(qyaw)*wx + cos(qyaw)*wy AS y FROM ground_queries, v), {_AVG_HEIGHT}
SELECT g.query_id, {q6('coalesce(m.low, 0)')} AS z0 FROM ground_queries g LEFT JOIN (SELECT query_id // 4 AS query_id, min(height) + CAST(0.5 AS DOUBLE) - 1 AS low FROM h GROUP BY 1) m USING (query_id)""",
    ("ground", "ground_queries"),
)
def initial_z(spark, d):
    out = terrain.initial_z(
        fx.ground_queries(spark, d), fx.ground(spark, d), ["tile_id"], fx.WHEELS, radius=6.0, min_neighbours=3, com_z=0.5
    )
    return rounded(out, ["query_id"], ["z0"])


def _posed(spark, d):
    return fx.ground_queries(spark, d).select(
        "query_id", "tile_id", F.col("qx").alias("x"), F.col("qy").alias("y"), F.lit(0.25).alias("z"),
        (F.col("qyaw") / 20).alias("roll"), (F.col("qyaw") / -30).alias("pitch"), F.col("qyaw").alias("yaw"),
    )


_PR = sql_rotation("(qyaw/20)", "(qyaw/(-30))", "qyaw")
_PW = sql_matvec(_PR, ["wx", "wy", "CAST(-0.5 AS DOUBLE)"])


@query(
    "wheel_distances",
    f"""WITH v AS (SELECT * FROM (VALUES {_WHEEL_ROWS}) t(wheel, wx, wy)),
q AS (SELECT query_id, wheel, tile_id, {_PW[0]} + qx AS x, {_PW[1]} + qy AS y, {_PW[2]} + CAST(0.25 AS DOUBLE) AS z, {_PR[2]} AS bx, {_PR[5]} AS by_, {_PR[8]} AS bz FROM ground_queries, v),
n AS (SELECT query_id, wheel, arg_min((q.x - g.x)*bx + (q.y - g.y)*by_ + (q.z - g.z)*bz, (q.x - g.x)*(q.x - g.x) + (q.y - g.y)*(q.y - g.y)) AS d FROM q JOIN ground g USING (tile_id) GROUP BY 1, 2)
SELECT query_id, {', '.join(f'{q6(f"max(d) FILTER (WHERE wheel = {i})")} AS d{i}' for i in range(4))} FROM n GROUP BY 1""",
    ("ground", "ground_queries"),
)
def wheel_distances(spark, d):
    out = terrain.wheel_distances(_posed(spark, d), fx.ground(spark, d), ["tile_id"], fx.WHEELS, com_z=0.5)
    return out.select("query_id", *[r6(F.get("distances", i)).alias(f"d{i}") for i in range(4)])


@query("surface_z")
def surface_z(spark, d):
    q = fx.ground_queries(spark, d).select("query_id", "tile_id", F.col("qx").alias("x"), F.col("qy").alias("y"))
    out = terrain.surface_z(q, fx.ground(spark, d), ["tile_id"], "query_id", "point_idx", 12.0, 3.0, 5)
    return out.select("query_id", F.round("z", 5).alias("z"))


@query(
    "attitude_gate",
    """WITH a AS (SELECT query_id, qx/30 AS z, qyaw/5 AS roll, qyaw/8 AS pitch, qx/100 AS d0, qy/100 AS d1, CASE WHEN query_id % 7 = 0 THEN 'max_iters' ELSE 'converged' END AS e FROM ground_queries),
r AS (SELECT query_id, CASE WHEN z NOT BETWEEN -1 AND 1 THEN 'z' WHEN abs(roll) > 0.5 OR abs(pitch) > 0.3 THEN 'tilt' WHEN abs(d0) > 0.3 OR abs(d1) > 0.3 THEN 'wheels' WHEN e = 'max_iters' THEN 'max_iters' ELSE 'none' END AS reason FROM a)
SELECT query_id, reason, reason = 'none' AS ok FROM r""",
    ("ground_queries",),
)
def attitude_gate(spark, d):
    df = fx.ground_queries(spark, d).select(
        "query_id", (F.col("qx") / 30).alias("z"), (F.col("qyaw") / 5).alias("roll"), (F.col("qyaw") / 8).alias("pitch"),
        F.array(F.col("qx") / 100, F.col("qy") / 100).alias("distances"),
        F.when(F.col("query_id") % 7 == 0, "max_iters").otherwise("converged").alias("end_reason"),
    )
    return terrain.attitude_gate(df, -1, 1, 0.5, 0.3, 0.3).select("query_id", "reason", "ok")


@query(
    "footprint",
    f"""WITH w AS (SELECT tile_id, CASE WHEN tile_id % 3 = 0 THEN NULL ELSE qx/40 END AS wx, CASE WHEN tile_id % 3 = 0 THEN NULL ELSE qy/40 END AS wy FROM ground_queries),
a AS (SELECT tile_id, coalesce(min(wx), -1) AS x0, coalesce(max(wx), 1) AS x1, coalesce(min(wy), -1) AS y0, coalesce(max(wy), 1) AS y1 FROM w GROUP BY 1)
SELECT tile_id, {q6('(x0 + x1)/2')} AS cx, {q6('(y0 + y1)/2')} AS cy, CAST(-0.5 AS DOUBLE) AS cz, {q6('greatest(x1 - x0, CAST(0.1 AS DOUBLE))')} AS size_x, {q6('greatest(y1 - y0, CAST(0.1 AS DOUBLE))')} AS size_y, CAST(1 AS DOUBLE) AS size_z FROM a""",
    ("ground_queries",),
)
def footprint(spark, d):
    known = F.col("tile_id") % 3 != 0
    wheels = fx.ground_queries(spark, d).select(
        "tile_id", F.when(known, F.col("qx") / 40).alias("wx"), F.when(known, F.col("qy") / 40).alias("wy")
    )
    return rounded(terrain.footprint(wheels, ["tile_id"]), ["tile_id"], ["cx", "cy", "cz", "size_x", "size_y", "size_z"])
