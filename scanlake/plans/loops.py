"""Loop mining and verification over whole drives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.geometry import matmul, matvec
from scanlake.functions.poses import FIELDS, Pose, between, from_columns, inverse
from scanlake.functions.rotations import rpy_matrix
from scanlake.operators import neighbours as nb, places
from scanlake.operators.graph import EDGE
from scanlake.plans.alignment import align_windows
from scanlake.session import cut

XYZ = ("x", "y", "z")


def mine_by_descriptor(
    points: DataFrame, keys: Sequence[str], item: str = "kf_id", gap: int = 30, k: int = 3, threshold: float = 0.4
) -> DataFrame:
    """Loops by place descriptor: for each item the best of its ``k`` nearest earlier ring keys
    whose shift-searched distance is below ``threshold``. ``keys`` name the drive.

    Drives of few items are searched in one task each, larger ones by tables."""
    keys = list(keys)
    at = [*keys, item]
    sparse = cut(places.scan_descriptor(points, at))
    if not keys:
        return _mine_by_tables(sparse, keys, item, gap, k, threshold)
    count = F.count(F.lit(1)).alias("_n")
    large = cut(sparse.groupBy(*keys).agg(count).where(F.col("_n") > places.ITEMS).select(*keys))
    if not large.isEmpty():
        items = sparse.join(large, keys, "left_semi").select(*at).distinct()
        large = cut(items.groupBy(*keys).agg(count).where(F.col("_n") > places.ITEMS).select(*keys))
    if large.isEmpty():
        return places.drive_loops(sparse, keys, item, k, gap, threshold)
    small = places.drive_loops(sparse.join(large, keys, "left_anti"), keys, item, k, gap, threshold)
    return small.unionByName(_mine_by_tables(cut(sparse.join(large, keys, "left_semi")), keys, item, gap, k, threshold))


def _mine_by_tables(sparse: DataFrame, keys: list[str], item: str, gap: int, k: int, threshold: float) -> DataFrame:
    """``mine_by_descriptor`` from the descriptors of drives of any length."""
    at = [*keys, item]
    near = places.descriptor_knn(places.ring_key(sparse, at), keys, k, gap, item)
    a, b = f"_{item}_a", f"_{item}_b"
    whole = F.struct(*at) if keys else F.col(item)
    named = sparse.select(whole.alias("item"), "ring", "sector", "h")
    sector = places.sector_key(sparse, at).select(whole.alias("item"), "key")
    other = F.struct(*[F.col(c) for c in keys], F.col(f"n_{item}").alias(item)) if keys else F.col(f"n_{item}")
    pairs = near.select(whole.alias(a), other.alias(b))
    aligned = places.align_pairs(pairs, sector, a, b, "item")
    scored = places.shifted_distance(aligned, named, a, b, "item")
    best = places.best_loop(scored, a, b, threshold)
    out = [F.col(f"{a}.{c}").alias(c) for c in at] if keys else [F.col(a).alias(item)]
    loop = F.col(f"{b}.{item}") if keys else F.col(b)
    return best.select(*out, loop.alias("loop_id"), "distance", "yaw")


def mine_loops(
    keyframes: DataFrame, points: DataFrame, keys: Sequence[str] = ("vehicle_id",), radius: float = 30.0,
    min_seconds: float = 30.0, gap: int = 30, threshold: float = 0.4,
) -> DataFrame:
    """Loop candidates of all keyframes by position and by descriptor, with their ``kind``."""
    keys = list(keys)
    near = nb.loop_by_radius(keyframes, radius, min_seconds, keys).select(
        *keys, "kf_id", "loop_id", F.lit("radius").alias("kind"), F.sqrt("d2").alias("score"), F.lit(None).cast("double").alias("yaw")
    )
    seen = mine_by_descriptor(points, keys, "kf_id", gap, 3, threshold).select(
        *keys, "kf_id", "loop_id", F.lit("descriptor").alias("kind"), F.col("distance").alias("score"), "yaw"
    )
    return near.unionByName(seen)


def verify_loops(
    candidates: DataFrame,
    keyframes: DataFrame,
    points: DataFrame,
    keys: Sequence[str] = ("vehicle_id",),
    neighbours: int = 25,
    leaf: float = 0.2,
    min_source: int = 300,
    min_target: int = 1000,
    max_fitness: float = 0.3,
    size: float = 1.0,
    max_d: float | None = 60.0,
    rounds: int = 100,
    frame: str = "world",
    turned: bool = False,
) -> DataFrame:
    """Candidates whose clouds align: loop edges with the fitness as variance.

    The current keyframe's cloud (``kf_id``) is aligned to the clouds of the ``neighbours`` on both sides of the candidate
    (``loop_id``), reduced to one centroid per ``leaf``; small clouds are left out. A candidate's cloud is made in the task that
    aligns its pairs (``align_windows``).

    ``frame`` "world" places each cloud by its own pose, and the edge leads from the corrected pose to the candidate's. "base"
    places all clouds of a drive by the pose of its first keyframe, as loops by descriptor are checked; the edge is then
    the correction itself undone, and robust. ``turned`` starts from the candidates' ``yaw``, if they have one.
    """
    if frame not in ("world", "base"):
        raise ValueError(f"unknown frame {frame!r}")
    keys = list(keys)
    yaw = F.coalesce("yaw", F.lit(0.0)) if turned else F.lit(0.0)
    wanted = cut(candidates.select(*keys, F.col("kf_id").alias("cur_id"), "loop_id", yaw.alias("yaw")).dropDuplicates([*keys, "cur_id", "loop_id"]))
    placed = keyframes.select(*keys, "kf_id", *FIELDS)
    if frame == "base":
        base = placed.groupBy(*keys).agg(F.min_by(F.struct(*FIELDS), "kf_id").alias("_base"))
        placed = placed.select(*keys, "kf_id").join(base, keys).select(*keys, "kf_id", *[F.col(f"_base.{f}").alias(f) for f in FIELDS])
    fitted = align_windows(wanted, placed, points, keys, neighbours, leaf, min_source, min_target, size, max_d, rounds)
    good = fitted.where(F.col("converged") & (F.col("fitness") <= max_fitness))

    def poses(prefix: str, name: str) -> DataFrame:
        return keyframes.select(*keys, F.col("kf_id").alias(name), *[F.col(f).alias(prefix + f) for f in FIELDS])

    r = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    shift = [F.col(f"t{c}") for c in XYZ]
    if frame == "base":
        joined, step = good, inverse(Pose(r, shift)).fields()
    else:
        joined = good.join(poses("a_", "cur_id"), [*keys, "cur_id"]).join(poses("b_", "loop_id"), [*keys, "loop_id"])
        attitude = rpy_matrix(F.col("a_roll"), F.col("a_pitch"), F.col("a_yaw"))
        place = [v + t for v, t in zip(matvec(r, [F.col(f"a_{c}") for c in XYZ]), shift)]
        corrected = Pose(matmul(r, attitude), place)
        step = between(corrected, from_columns(*[F.col(f"b_{f}") for f in FIELDS])).fields()
    edges = joined.select(
        *keys, F.lit("loop").alias("kind"), F.col("cur_id").alias("from_id"), F.col("loop_id").alias("to_id"),
        *[step[f].alias(f) for f in FIELDS], F.lit(frame == "base").alias("robust"),
        *[F.col("fitness").alias(f"var{i}") for i in range(6)],
    )
    return edges.select(*keys, *EDGE)
