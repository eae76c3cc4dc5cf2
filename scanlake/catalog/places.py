"""Queries on place descriptors and descriptor search."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.catalog.registry import q6, query, r6, rounded
from scanlake.functions import vectors
from scanlake.operators import places
from scanlake.session import cut
from scanlake.sources import shapes as fx

_DESC = """d AS (SELECT scan_id, CAST(greatest(least(ceil(sqrt(x*x + y*y) / 80 * 20), 20), 1) - 1 AS INTEGER) AS ring,
  CAST(greatest(least(ceil((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2*pi() ELSE atan2(y, x) END) * 180 / pi() / 360 * 60), 60), 1) - 1 AS INTEGER) AS sector, max(z + 2) AS h
  FROM points WHERE sqrt(x*x + y*y) <= 80 GROUP BY 1, 2, 3)"""
_RK = """rk AS (SELECT s.scan_id, list(coalesce(v, 0) ORDER BY r.ring) AS key FROM (SELECT DISTINCT scan_id FROM d) s CROSS JOIN (SELECT range AS ring FROM range(20)) r
  LEFT JOIN (SELECT scan_id, ring, sum(h)/60 AS v FROM d GROUP BY 1, 2) a ON a.scan_id = s.scan_id AND a.ring = r.ring GROUP BY 1)"""
_SK = """sk AS (SELECT s.scan_id, list(coalesce(v, 0) ORDER BY r.sector) AS key FROM (SELECT DISTINCT scan_id FROM d) s CROSS JOIN (SELECT range AS sector FROM range(60)) r
  LEFT JOIN (SELECT scan_id, sector, sum(h)/20 AS v FROM d GROUP BY 1, 2) a ON a.scan_id = s.scan_id AND a.sector = r.sector GROUP BY 1)"""
_KNN = """n AS (SELECT q.scan_id, c.scan_id AS n_scan_id, list_distance(q.key, c.key) * list_distance(q.key, c.key) AS d2,
  row_number() OVER (PARTITION BY q.scan_id ORDER BY list_distance(q.key, c.key), c.scan_id) AS rank FROM rk q JOIN rk c ON c.scan_id <= q.scan_id - 3 QUALIFY rank <= 3)"""
_SHIFT = """al AS (SELECT scan_id, n_scan_id, arg_min(s, dist ORDER BY s) AS shift FROM (SELECT n.scan_id, n.n_scan_id, range AS s,
   round(list_distance(a.key, list_concat(b.key[61-range:60], b.key[1:60-range])), 12) AS dist FROM n JOIN sk a ON a.scan_id = n.scan_id JOIN sk b ON b.scan_id = n.n_scan_id, range(60)) GROUP BY 1, 2)"""
_SHIFT = _SHIFT.replace("arg_min(s, dist ORDER BY s)", "min(s) FILTER (WHERE dist = low)").replace(
    "FROM (SELECT n.scan_id", "FROM (SELECT *, min(dist) OVER (PARTITION BY scan_id, n_scan_id) AS low FROM (SELECT n.scan_id"
).replace("range(60)) GROUP BY", "range(60))) GROUP BY")
_TRY = "tr AS (SELECT scan_id, n_scan_id, CAST((shift + o + 60) % 60 AS INTEGER) AS shift FROM al, (SELECT range AS o FROM range(-3, 4)))"


def _distance_sql(pairs: str) -> str:
    return f"""cn AS (SELECT scan_id, sector, sqrt(sum(h*h)) AS n FROM d GROUP BY 1, 2 HAVING sqrt(sum(h*h)) > 0),
cc AS (SELECT p.scan_id, p.n_scan_id, p.shift, a.sector, a.n * b.n AS nn FROM {pairs} p JOIN cn a ON a.scan_id = p.scan_id JOIN cn b ON b.scan_id = p.n_scan_id AND (b.sector + p.shift) % 60 = a.sector),
dd AS (SELECT p.scan_id, p.n_scan_id, p.shift, a.sector, sum(a.h * b.h) AS dot FROM {pairs} p JOIN d a ON a.scan_id = p.scan_id JOIN d b ON b.scan_id = p.n_scan_id AND b.ring = a.ring AND (b.sector + p.shift) % 60 = a.sector GROUP BY 1, 2, 3, 4),
ds AS (SELECT cc.scan_id, cc.n_scan_id, cc.shift, 1 - avg(coalesce(dot, 0) / nn) AS distance FROM cc LEFT JOIN dd USING (scan_id, n_scan_id, shift, sector) GROUP BY 1, 2, 3)"""


_BEST = """bs AS (SELECT scan_id, n_scan_id, min(distance) AS distance, min(shift) FILTER (WHERE distance = low) AS shift FROM
  (SELECT *, min(distance) OVER (PARTITION BY scan_id, n_scan_id) AS low FROM ds) GROUP BY 1, 2)"""


def descriptors(spark, d):
    return places.scan_descriptor(fx.points(spark, d))


@query("scan_descriptor", f"WITH {_DESC} SELECT scan_id, ring, sector, {q6('h')} AS h FROM d", ("points",))
def scan_descriptor(spark, d):
    return rounded(descriptors(spark, d), ["scan_id", "ring", "sector"], ["h"])


def _unrolled(df):
    return df.select("scan_id", F.posexplode("key").alias("i", "v")).select("scan_id", "i", r6("v").alias("v"))


@query(
    "ring_key",
    f"WITH {_DESC}, {_RK} SELECT scan_id, CAST(range AS INTEGER) AS i, {q6('key[range + 1]')} AS v FROM rk, range(20)",
    ("points",),
)
def ring_key(spark, d):
    return _unrolled(places.ring_key(descriptors(spark, d)))


@query(
    "sector_key",
    f"WITH {_DESC}, {_SK} SELECT scan_id, CAST(range AS INTEGER) AS i, {q6('key[range + 1]')} AS v FROM sk, range(60)",
    ("points",),
)
def sector_key(spark, d):
    return _unrolled(places.sector_key(descriptors(spark, d)))


def _candidates(spark, d):
    sparse = cut(descriptors(spark, d))
    return sparse, places.descriptor_knn(places.ring_key(sparse), [], 3, 3)


@query(
    "descriptor_knn",
    f"WITH {_DESC}, {_RK}, {_KNN} SELECT scan_id, n_scan_id, CAST(rank AS INTEGER) AS rank, {q6('d2')} AS d2 FROM n",
    ("points",),
)
def descriptor_knn(spark, d):
    return rounded(_candidates(spark, d)[1], ["scan_id", "n_scan_id", "rank"], ["d2"])


@query(
    "descriptor_knn_embeddings",
    f"""WITH n AS (SELECT q.desc_id, c.desc_id AS n_desc_id, list_distance(CAST(q.key AS DOUBLE[]), CAST(c.key AS DOUBLE[])) AS dist,
  row_number() OVER (PARTITION BY q.desc_id ORDER BY list_distance(CAST(q.key AS DOUBLE[]), CAST(c.key AS DOUBLE[])), c.desc_id) AS rank FROM descriptors q JOIN descriptors c ON c.desc_id <= q.desc_id - 30 QUALIFY rank <= 3)
SELECT desc_id, n_desc_id, CAST(rank AS INTEGER) AS rank, {q6('dist*dist')} AS d2 FROM n""",
    ("descriptors",),
)
def descriptor_knn_embeddings(spark, d):
    out = places.descriptor_knn(fx.descriptors(spark, d), [], 3, 30, "desc_id")
    return rounded(out, ["desc_id", "n_desc_id", "rank"], ["d2"])


@query(
    "mutual_nn",
    f"""WITH a AS (SELECT * FROM descriptors WHERE label % 2 = 0), b AS (SELECT * FROM descriptors WHERE label % 2 = 1),
p AS (SELECT a.desc_id AS a_id, b.desc_id AS b_id, list_distance(CAST(a.key AS DOUBLE[]), CAST(b.key AS DOUBLE[])) AS dist FROM a, b),
f AS (SELECT a_id, arg_min(b_id, dist) AS b_id, min(dist) AS dist FROM p GROUP BY 1), g AS (SELECT b_id, arg_min(a_id, dist) AS a_id FROM p GROUP BY 1)
SELECT a_id, b_id, {q6('dist*dist')} AS d2 FROM f JOIN g USING (a_id, b_id)""",
    ("descriptors",),
)
def mutual_nn(spark, d):
    df = fx.descriptors(spark, d)
    out = places.mutual_nn(df.where("label % 2 = 0"), df.where("label % 2 = 1"), [], "desc_id")
    return rounded(out, ["a_id", "b_id"], ["d2"])


@query(
    "vector_metrics",
    f"""WITH p AS (SELECT a.desc_id, CAST(a.key AS DOUBLE[]) AS u, CAST(b.key AS DOUBLE[]) AS v FROM descriptors a JOIN descriptors b ON b.desc_id = a.desc_id + 1)
SELECT desc_id, {q6('list_sum(list_transform(list_zip(u, v), lambda t: abs(t[1] - t[2])))')} AS l1, {q6('list_distance(u, v) * list_distance(u, v)')} AS l2,
 {q6('atan2(sin(v[64] - u[64]), cos(v[64] - u[64]))')} AS so2, {q6('list_distance(u, v) * list_distance(u, v)')} AS so3, {q6('u[60]')} AS shifted_head FROM p""",
    ("descriptors",),
)
def vector_metrics(spark, d):
    df = fx.descriptors(spark, d)
    nxt = df.select((F.col("desc_id") - 1).alias("desc_id"), F.col("key").alias("v"))
    u, v = F.col("key"), F.col("v")
    return df.join(nxt, "desc_id").select(
        "desc_id", r6(vectors.l1(u, v)).alias("l1"), r6(vectors.l2_squared(u, v)).alias("l2"),
        r6(vectors.so2(u, v)).alias("so2"), r6(vectors.so3(u, v)).alias("so3"),
        r6(F.get(vectors.circular_shift(u, 5), 0).cast("double")).alias("shifted_head"),
    )


def _aligned(spark, d):
    sparse, near = _candidates(spark, d)
    pairs = near.select("scan_id", "n_scan_id")
    return sparse, places.align_pairs(pairs, places.sector_key(sparse), "scan_id", "n_scan_id", "scan_id")


@query(
    "align_pairs",
    f"WITH {_DESC}, {_RK}, {_SK}, {_KNN}, {_SHIFT} SELECT scan_id, n_scan_id, CAST(shift AS INTEGER) AS shift FROM al",
    ("points",),
)
def align_pairs(spark, d):
    return _aligned(spark, d)[1]


@query(
    "column_distance",
    f"WITH {_DESC}, {_RK}, {_SK}, {_KNN}, {_SHIFT}, {_distance_sql('al')} SELECT scan_id, n_scan_id, CAST(shift AS INTEGER) AS shift, {q6('distance')} AS distance FROM ds",
    ("points",),
)
def column_distance(spark, d):
    sparse, pairs = _aligned(spark, d)
    out = places.column_distance(pairs, _renamed(sparse), "scan_id", "n_scan_id", "item")
    return rounded(out, ["scan_id", "n_scan_id", "shift"], ["distance"])


def _renamed(sparse):
    return sparse.withColumnRenamed("scan_id", "item")


@query(
    "shifted_distance",
    f"WITH {_DESC}, {_RK}, {_SK}, {_KNN}, {_SHIFT}, {_TRY}, {_distance_sql('tr')}, {_BEST} SELECT scan_id, n_scan_id, shift, {q6('distance')} AS distance FROM bs",
    ("points",),
)
def shifted_distance(spark, d):
    sparse, pairs = _aligned(spark, d)
    out = places.shifted_distance(pairs, _renamed(sparse), "scan_id", "n_scan_id", "item")
    return rounded(out, ["scan_id", "n_scan_id", "shift"], ["distance"])


@query(
    "best_loop",
    f"""WITH {_DESC}, {_RK}, {_SK}, {_KNN}, {_SHIFT}, {_TRY}, {_distance_sql('tr')}, {_BEST},
b AS (SELECT scan_id, arg_min(n_scan_id, distance) AS n_scan_id, min(distance) AS distance, arg_min(shift, distance) AS shift FROM bs GROUP BY 1)
SELECT scan_id, n_scan_id, {q6('distance')} AS distance, {q6('radians(shift * 6)')} AS yaw FROM b WHERE distance < 0.6""",
    ("points",),
)
def best_loop(spark, d):
    sparse, pairs = _aligned(spark, d)
    scored = places.shifted_distance(pairs, _renamed(sparse), "scan_id", "n_scan_id", "item")
    return rounded(places.best_loop(scored, "scan_id", "n_scan_id", 0.6), ["scan_id", "n_scan_id"], ["distance", "yaw"])
