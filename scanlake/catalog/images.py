"""Queries on range images and voxel maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.catalog.registry import q6, q6s, query, r6, rounded
from scanlake.functions import geometry as g
from scanlake.operators import images, voxels
from scanlake.sources import shapes as fx

XYZ = ["x", "y", "z"]


def image(spark, d):
    return images.first_hit(fx.points(spark, d))


def indexed(spark, d):
    return images.dense_index(image(spark, d))


@query(
    "first_hit",
    f"SELECT scan_id, ring, col, point_idx, {q6s([*XYZ, 'rng', 't_rel'])} FROM pixels",
    ("pixels",),
)
def first_hit(spark, d):
    return rounded(image(spark, d), ["scan_id", "ring", "col", "point_idx"], [*XYZ, "rng", "t_rel"])


@query("dense_index", "SELECT scan_id, ring, col, idx FROM indexed", ("indexed",))
def dense_index(spark, d):
    return indexed(spark, d).select("scan_id", "ring", "col", "idx")


_BOUNDS = """b AS (SELECT scan_id, ring, CAST(coalesce(sum(n) OVER (PARTITION BY scan_id ORDER BY ring ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 4 AS BIGINT) AS start_idx,
  CAST(sum(n) OVER (PARTITION BY scan_id ORDER BY ring) - 6 AS BIGINT) AS end_idx
FROM (SELECT s.scan_id, r.ring, count(p.col) AS n FROM (SELECT DISTINCT scan_id FROM pixels) s
      CROSS JOIN (SELECT CAST(range AS INTEGER) AS ring FROM range(16)) r LEFT JOIN pixels p ON p.scan_id = s.scan_id AND p.ring = r.ring GROUP BY 1, 2))"""


@query("ring_bounds", f"WITH {_BOUNDS} SELECT * FROM b", ("pixels",))
def ring_bounds(spark, d):
    return images.ring_bounds(image(spark, d), 16)


@query(
    "sectors",
    f"""WITH {_BOUNDS} SELECT * FROM (SELECT scan_id, ring, CAST(j AS INTEGER) AS sector, (start_idx * (6 - j) + end_idx * j) // 6 AS sp,
  (start_idx * (5 - j) + end_idx * (j + 1)) // 6 - 1 AS ep FROM b CROSS JOIN (SELECT range AS j FROM range(6))) WHERE sp < ep""",
    ("pixels",),
)
def sectors(spark, d):
    return images.sectors(images.ring_bounds(image(spark, d), 16))


_W = "OVER (PARTITION BY scan_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
_SIZED = "s AS (SELECT *, count(*) OVER (PARTITION BY scan_id) AS size FROM indexed)"


@query(
    "curvature",
    f"WITH {_SIZED} SELECT scan_id, idx, CASE WHEN idx >= 5 AND idx < size - 5 THEN {q6(f'power(sum(rng) {_W} - 11 * rng, 2)')} END AS curvature FROM s",
    ("indexed",),
)
def curvature(spark, d):
    return rounded(images.curvature(indexed(spark, d)), ["scan_id", "idx"], ["curvature"])


@query(
    "curvature_xyz",
    f"WITH {_SIZED} SELECT scan_id, idx, CASE WHEN idx >= 5 AND idx < size - 5 THEN "
    + q6(" + ".join(f"power(sum({c}) {_W} - 11 * {c}, 2)" for c in XYZ))
    + " END AS curvature FROM s",
    ("indexed",),
)
def curvature_xyz(spark, d):
    return rounded(images.curvature_xyz(indexed(spark, d)), ["scan_id", "idx"], ["curvature"])


@query(
    "occlusion_mask",
    f"""WITH {_SIZED}, n AS (SELECT *, lead(rng) OVER w AS r2, lead(col) OVER w AS c2 FROM s WINDOW w AS (PARTITION BY scan_id ORDER BY idx)),
e AS (SELECT scan_id, idx, rng - r2 AS step FROM n WHERE idx >= 5 AND idx < size - 6 AND abs(c2 - col) < 10),
h AS (SELECT scan_id, idx - o AS idx FROM e, (SELECT range AS o FROM range(6)) WHERE step > 0.3
      UNION SELECT scan_id, idx + 1 + o FROM e, (SELECT range AS o FROM range(6)) WHERE step < -0.3)
SELECT s.scan_id, s.idx, h.idx IS NOT NULL AS occluded FROM s LEFT JOIN h ON h.scan_id = s.scan_id AND h.idx = s.idx""",
    ("indexed",),
)
def occlusion_mask(spark, d):
    return images.occlusion_mask(indexed(spark, d)).select("scan_id", "idx", "occluded")


@query(
    "parallel_mask",
    f"""WITH {_SIZED} SELECT scan_id, idx, coalesce(idx >= 5 AND idx < size - 6
  AND abs(lag(rng) OVER w - rng) > CAST(0.02 AS DOUBLE) * rng AND abs(lead(rng) OVER w - rng) > CAST(0.02 AS DOUBLE) * rng, false) AS parallel
FROM s WINDOW w AS (PARTITION BY scan_id ORDER BY idx)""",
    ("indexed",),
)
def parallel_mask(spark, d):
    return images.parallel_mask(indexed(spark, d)).select("scan_id", "idx", "parallel")


@query(
    "voxel_downsample",
    "SELECT scan_id, " + ", ".join(f"CAST(floor({c} / CAST(0.5 AS DOUBLE)) AS BIGINT) AS v{c}" for c in XYZ)
    + ", count(*) AS n, " + ", ".join(f"{q6(f'avg({c})')} AS {c}" for c in (*XYZ, "intensity"))
    + " FROM points GROUP BY 1, 2, 3, 4",
    ("points",),
)
def voxel_downsample(spark, d):
    out = voxels.voxel_downsample(fx.points(spark, d), ["scan_id"], 0.5, ["intensity"])
    return rounded(out, ["scan_id", "vx", "vy", "vz", "n"], [*XYZ, "intensity"])


def _stats_sql(keys: list[str], raw: bool = False) -> str:
    unit = ", ".join(f"avg({c} / rng) AS u{c}" for c in XYZ)
    r_bar = "sqrt(mx*mx + my*my + mz*mz + 1)" if raw else "sqrt(ux*ux + uy*uy + uz*uz)"
    return f"""v AS (SELECT scan_id, {', '.join(f'CAST(floor({k}) AS BIGINT) AS v{c}' for k, c in zip(keys, XYZ))}, count(*) AS n,
  {', '.join(f'avg({c}) AS m{c}' for c in XYZ)}, {unit}
  FROM (SELECT *, sqrt(x*x + y*y + z*z) AS rng FROM points) GROUP BY 1, 2, 3, 4),
r AS (SELECT *, {r_bar} AS r_bar FROM v)
SELECT scan_id, vx, vy, vz, n, {q6s(['mx', 'my', 'mz', 'r_bar'])}, {q6('''CASE WHEN r_bar < 1e-8 THEN 0
  WHEN r_bar < 0.6 THEN 3 * r_bar * (1 + 0.6 * power(r_bar, 2) + CAST(99 AS DOUBLE) / 175 * power(r_bar, 4))
  ELSE r_bar * (3 - r_bar*r_bar) / (1 - r_bar*r_bar) END''')} AS kappa FROM r"""


@query(
    "voxel_map",
    "WITH " + _stats_sql([f"{c} / CAST(2 AS DOUBLE) - CAST(0.5 AS DOUBLE)" for c in XYZ], raw=True),
    ("points",),
)
def voxel_map(spark, d):
    out = voxels.voxel_map(fx.points(spark, d), ["scan_id"], 2.0, raw=True)
    return rounded(out, ["scan_id", "vx", "vy", "vz", "n"], ["mx", "my", "mz", "r_bar", "kappa"])


_POLAR = [
    "(atan2(y, x) + pi()) / CAST(0.175 AS DOUBLE)",
    "acos(z / rng) / CAST(0.175 AS DOUBLE)",
    "rng / CAST(2 AS DOUBLE)",
]


@query(
    "polar_voxel_map",
    "WITH " + _stats_sql(_POLAR, raw=True),
    ("points",),
)
def polar_voxel_map(spark, d):
    out = voxels.polar_voxel_map(fx.points(spark, d), ["scan_id"], raw=True)
    return rounded(out, ["scan_id", "vx", "vy", "vz", "n"], ["mx", "my", "mz", "r_bar", "kappa"])


@query(
    "voxel_keys",
    f"""WITH k AS (SELECT scan_id, point_idx, {', '.join(f'CAST(floor({c} / CAST(2 AS DOUBLE) - CAST(0.5 AS DOUBLE)) AS BIGINT) AS c{c}' for c in XYZ)},
  {', '.join(f'CAST(floor({p}) AS BIGINT) AS p{c}' for p, c in zip(_POLAR, XYZ))} FROM (SELECT *, sqrt(x*x + y*y + z*z) AS rng FROM points)),
a AS (SELECT *, (px + CAST(0.5 AS DOUBLE)) * CAST(0.175 AS DOUBLE) - pi() AS th, (py + CAST(0.5 AS DOUBLE)) * CAST(0.175 AS DOUBLE) AS ph, (pz + CAST(0.5 AS DOUBLE)) * 2 AS r FROM k)
SELECT scan_id, point_idx, cx, cy, cz, px, py, pz, {', '.join(f'{q6(f"(c{c} + CAST(0.5 AS DOUBLE)) * 2")} AS c{c}_m' for c in XYZ)},
 {q6('r*sin(ph)*cos(th)')} AS px_m, {q6('r*sin(ph)*sin(th)')} AS py_m, {q6('r*cos(ph)')} AS pz_m FROM a""",
    ("points",),
)
def voxel_keys(spark, d):
    p = [F.col(c) for c in XYZ]
    size = (0.175, 0.175, 2.0)
    keyed = fx.points(spark, d).select(
        "scan_id", "point_idx",
        *[k.alias(f"c{c}") for k, c in zip(g.voxel_key(p, 2.0), XYZ)],
        *[k.alias(f"p{c}") for k, c in zip(g.polar_key(p, size), XYZ)],
    )
    return keyed.select(
        "*",
        *[r6(v).alias(f"c{c}_m") for v, c in zip(g.voxel_centre([F.col(f"c{c}") for c in XYZ], 2.0), XYZ)],
        *[r6(v).alias(f"p{c}_m") for v, c in zip(g.polar_centre([F.col(f"p{c}") for c in XYZ], size), XYZ)],
    )


@query(
    "concentration",
    f"""SELECT pose_id, {q6('''CASE WHEN r < 1e-8 THEN 0 WHEN r < 0.6 THEN 3*r*(1 + CAST(0.6 AS DOUBLE)*r*r + CAST(99 AS DOUBLE)/175*r*r*r*r)
  ELSE r*(3 - r*r)/(1 - r*r) END''')} AS kappa FROM (SELECT pose_id, abs(roll) * 30 AS r FROM poses)""",
    ("poses",),
)
def concentration(spark, d):
    return fx.poses(spark, d).select("pose_id", r6(g.concentration(F.abs("roll") * 30)).alias("kappa"))


_CELL = ", ".join(f"CAST(floor({c} / CAST(2 AS DOUBLE) - CAST(0.5 AS DOUBLE)) AS BIGINT) AS v{c}" for c in XYZ)


@query(
    "voxel_join",
    f"""WITH v AS (SELECT scan_id, {_CELL}, count(*) AS n, {', '.join(f'avg({c}) AS m{c}' for c in XYZ)} FROM points GROUP BY 1, 2, 3, 4),
s AS (SELECT scan_id, point_idx, {_CELL} FROM (SELECT scan_id, point_idx, x + 1 AS x, y - 1 AS y, z FROM points))
SELECT s.scan_id, s.point_idx, v.vx, v.vy, v.vz, v.n AS v_n, {', '.join(f'{q6(f"m{c}")} AS v_m{c}' for c in XYZ)} FROM s JOIN v
  ON v.scan_id = s.scan_id AND abs(v.vx - s.vx) + abs(v.vy - s.vy) + abs(v.vz - s.vz) <= 1""",
    ("points",),
)
def voxel_join(spark, d):
    pts = fx.points(spark, d)
    source = pts.select("scan_id", "point_idx", (F.col("x") + 1).alias("x"), (F.col("y") - 1).alias("y"), "z")
    vox = voxels.voxel_map(pts, ["scan_id"], 2.0)
    cells = g.voxel_key([F.col(c) for c in XYZ], 2.0)
    out = voxels.voxel_join(source, vox, ["scan_id"], cells, 7)
    return rounded(out, ["scan_id", "point_idx", "vx", "vy", "vz", "v_n"], ["v_mx", "v_my", "v_mz"])
