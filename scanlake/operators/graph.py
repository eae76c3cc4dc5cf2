"""Pose graph tables: edges, loop registry, corrections, gates and text lines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.angles import wrap_angle
from scanlake.functions.poses import FIELDS, Pose, between, from_columns
from scanlake.functions.rotations import rpy_quat
from scanlake.operators.timeline import HOUR, seconds, with_previous

EDGE = ("kind", "from_id", "to_id", *FIELDS, "robust", *[f"var{i}" for i in range(6)])

# Variances of an odometry edge and of the first pose (roll, pitch, yaw, x, y, z).
ODOMETRY_VARIANCES = (1e-6, 1e-6, 1e-6, 1e-4, 1e-4, 1e-4)
FIRST_POSE_VARIANCES = (1e-2, 1e-2, math.pi * math.pi, 1e8, 1e8, 1e8)


def _fields(prefix: str) -> Pose:
    return from_columns(*[F.col(prefix + f) for f in FIELDS])


def _edge(keys: Sequence[str], kind: str, a: Column, b: Column, rel: dict, robust: Column, variances) -> list[Column]:
    return [
        *[F.col(k) for k in keys],
        F.lit(kind).alias("kind"),
        a.cast("bigint").alias("from_id"),
        b.cast("bigint").alias("to_id"),
        *[rel[f].alias(f) for f in FIELDS],
        robust.alias("robust"),
        *[(v if isinstance(v, Column) else F.lit(float(v))).alias(f"var{i}") for i, v in enumerate(variances)],
    ]


def odometry_edges(keyframes: DataFrame, keys: Sequence[str], ts: str = "ts", width: float = HOUR) -> DataFrame:
    """Edges between consecutive keyframes, and the first pose as an edge to itself."""
    prev = with_previous(keyframes, keys, ts, ["kf_id", *FIELDS], width=width)
    first = prev.where("prev_kf_id is null")
    rest = prev.where("prev_kf_id is not null")
    own = {f: F.col(f) for f in FIELDS}
    step = between(_fields("prev_"), _fields("")).fields()
    return first.select(
        *_edge(keys, "first", F.col("kf_id"), F.col("kf_id"), own, F.lit(False), FIRST_POSE_VARIANCES)
    ).unionByName(
        rest.select(*_edge(keys, "odometry", F.col("prev_kf_id"), F.col("kf_id"), step, F.lit(False), ODOMETRY_VARIANCES))
    )


def loop_edges(loops: DataFrame, keyframes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges of accepted loops (``kf_id``, ``loop_id``, ``fitness``, ``robust``): the relative pose
    of the two keyframes with the fitness as every variance."""
    joined = _with_poses(loops, keyframes, keys, "kf_id", "loop_id")
    rel = between(_fields("a_"), _fields("b_")).fields()
    return joined.select(
        *_edge(keys, "loop", F.col("kf_id"), F.col("loop_id"), rel, F.col("robust"), [F.col("fitness")] * 6)
    )


def prior_edges(priors: DataFrame, keyframes: DataFrame, keys: Sequence[str], weight: float = 100.0) -> DataFrame:
    """Edges of matched priors (``linked_id``, ``kf_id``, ``fitness``): roll, pitch and z follow the
    fitness times ``weight``, the rest is tight."""
    joined = _with_poses(priors, keyframes, keys, "linked_id", "kf_id")
    rel = between(_fields("a_"), _fields("b_")).fields()
    noise = F.greatest(F.col("fitness"), F.lit(1e-6)) * float(weight)
    tight = F.lit(1e-6)
    return joined.select(
        *_edge(
            keys, "prior", F.col("linked_id"), F.col("kf_id"), rel, F.lit(False),
            [noise, noise, tight, tight, tight, noise],
        )
    )


def _with_poses(pairs: DataFrame, keyframes: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    pose_a = keyframes.select(*keys, F.col("kf_id").alias(a), *[F.col(f).alias(f"a_{f}") for f in FIELDS])
    pose_b = keyframes.select(*keys, F.col("kf_id").alias(b), *[F.col(f).alias(f"b_{f}") for f in FIELDS])
    return pairs.join(pose_a, [*keys, a]).join(pose_b, [*keys, b])


def graph_edges(odometry: DataFrame, loops: DataFrame | None = None, priors: DataFrame | None = None) -> DataFrame:
    """All edges in one table."""
    out = odometry
    for more in (loops, priors):
        if more is not None:
            out = out.unionByName(more)
    return out


def new_loops(candidates: DataFrame, closed: DataFrame, keyframes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates whose keyframe is not closed yet and whose two ids exist."""
    known = keyframes.select(*keys, "kf_id")
    return (
        candidates.join(closed.select(*keys, "kf_id"), [*keys, "kf_id"], "left_anti")
        .join(known, [*keys, "kf_id"], "left_semi")
        .join(known.withColumnRenamed("kf_id", "loop_id"), [*keys, "loop_id"], "left_semi")
    )


def upsert_loops(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """One loop per keyframe, the one with the highest version."""
    both = old.unionByName(new)
    return both.groupBy(*keys, "kf_id").agg(
        F.max_by("loop_id", version).alias("loop_id"), F.max(version).alias(version)
    )


def apply_corrections(keyframes: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyframes with the corrected pose where one is given."""
    renamed = corrections.select(*keys, "kf_id", *[F.col(f).alias(f"_n_{f}") for f in FIELDS])
    return (
        keyframes.join(renamed, [*keys, "kf_id"], "left")
        .withColumns({f: F.coalesce(F.col(f"_n_{f}"), F.col(f)) for f in FIELDS})
        .drop(*[f"_n_{f}" for f in FIELDS])
    )


def prior_gate(df: DataFrame, max_z: float, max_angle: float) -> DataFrame:
    """Rows whose predicted and driven steps agree in z, roll and pitch (``o_`` and ``p_`` columns)."""
    gap = {f: F.col(f"o_{f}") - F.col(f"p_{f}") for f in ("z", "roll", "pitch")}
    return df.where(
        (F.abs(gap["z"]) <= float(max_z))
        & (F.abs(wrap_angle(gap["roll"])) <= float(max_angle))
        & (F.abs(wrap_angle(gap["pitch"])) <= float(max_angle))
    )


def snapshot(keyframes: DataFrame, corners: DataFrame, surfaces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyframes below the shortest of the pose, corner and surface lists of their vehicle."""

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count_distinct("kf_id").alias(name))

    sizes = size(corners, "_a").join(size(surfaces, "_b"), list(keys))
    return (
        keyframes.join(sizes, list(keys))
        .where(F.col("kf_id") < F.least("_a", "_b"))
        .drop("_a", "_b")
    )


def trajectory_lines(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``line`` per pose: seconds, position and quaternion, separated by blanks."""
    q = rpy_quat(F.col("roll"), F.col("pitch"), F.col("yaw"))
    values = [F.col("x"), F.col("y"), F.col("z"), *q]
    text = F.format_string("%.6f" + " %.6f" * 7, seconds(ts), *[F.round(v, 6) + F.lit(0.0) for v in values])
    return df.withColumn("line", text)


def _pose_text(fields: dict) -> list[Column]:
    q = rpy_quat(fields["roll"], fields["pitch"], fields["yaw"])
    return [F.round(v, 6) + F.lit(0.0) for v in (fields["x"], fields["y"], fields["z"], *q)]


def graph_lines(keyframes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertex and edge lines of the pose graph with their sort columns.

    Edges to unknown keyframes are left out; a first-pose edge has no line.
    """
    vertices = keyframes.select(
        *keys, F.lit(0).alias("part"), F.col("kf_id").alias("a"), F.lit(-1).cast("bigint").alias("b"),
        F.format_string(
            "VERTEX_SE3:QUAT %d" + " %.6f" * 7, F.col("kf_id"), *_pose_text({f: F.col(f) for f in FIELDS})
        ).alias("line"),
    )
    part = F.when(F.col("kind") == "odometry", 1).when(F.col("kind") == "loop", 2).otherwise(3)
    known = keyframes.select(*keys, "kf_id")
    drawn = (
        edges.where(F.col("kind") != "first")
        .join(known.withColumnRenamed("kf_id", "from_id"), [*keys, "from_id"], "left_semi")
        .join(known.withColumnRenamed("kf_id", "to_id"), [*keys, "to_id"], "left_semi")
        .select(
            *keys, part.alias("part"), F.col("from_id").alias("a"), F.col("to_id").alias("b"),
            F.format_string(
                "EDGE_SE3:QUAT %d %d" + " %.6f" * 7, F.col("from_id"), F.col("to_id"),
                *_pose_text({f: F.col(f) for f in FIELDS}),
            ).alias("line"),
        )
    )
    return vertices.unionByName(drawn)
