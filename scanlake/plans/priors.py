"""Prior association: predicted poses and patches against later keyframes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.geometry import matmul, matvec
from scanlake.functions.poses import FIELDS, Pose, between, compose, from_columns, inverse
from scanlake.functions.rotations import matrix_rpy, quat_matrix, quat_normalise, rpy_quat, slerp
from scanlake.operators import neighbours as nb
from scanlake.operators.graph import EDGE, prior_gate
from scanlake.plans.alignment import align_clouds
from scanlake.session import cut

XYZ = ("x", "y", "z")


def _pose(prefix: str) -> Pose:
    return from_columns(*[F.col(prefix + f) for f in FIELDS])


def associate_priors(
    priors: DataFrame,
    keyframes: DataFrame,
    prior_patches: DataFrame,
    ground: DataFrame,
    keys: Sequence[str] = ("vehicle_id",),
    radius: float = 1.0,
    patch_size: float = 20.0,
    max_fitness: float = 0.05,
    max_z: float = 1.0,
    max_angle: float = math.radians(5.0),
    blend: float = 0.2,
    weight: float = 100.0,
    size: float = 1.0,
    rounds: int = 100,
) -> DataFrame:
    """Prior edges between keyframes.

    ``priors`` has ``prior_id``, ``linked_id`` and the predicted pose relative to the linked
    keyframe; ``prior_patches`` the ground points seen at prediction (``prior_id``, ``point_id``),
    ``ground`` those seen at each keyframe (``kf_id``, ``point_id``). A keyframe takes the first
    earlier prior near it in the plane whose patch fits its ground; roll and pitch of the driven
    step are then blended with the predicted ones. Points further apart than ``patch_size`` don't count as paired.
    """
    keys = list(keys)
    links = keyframes.select(*keys, F.col("kf_id").alias("linked_id"), *[F.col(f).alias(f"k_{f}") for f in FIELDS])
    joined = priors.join(links, [*keys, "linked_id"])
    ahead = compose(_pose("k_"), _pose("")).fields()
    predicted = joined.select(*keys, "prior_id", "linked_id", *[ahead[c].alias(c) for c in XYZ])
    near = nb.radius_join(
        keyframes, predicted, keys, radius, "kf_id", "prior_id", dims=("x", "y"), values=("linked_id",)
    ).where((F.col("d") < float(radius)) & (F.col("n_linked_id") < F.col("kf_id")))
    pairs = cut(
        near.select(*keys, "kf_id", F.col("n_prior_id").alias("prior_id"), F.col("n_linked_id").alias("linked_id"))
    )

    pair = [*keys, "kf_id", "prior_id"]
    half = patch_size / 2
    source = prior_patches.where((F.abs("x") <= half) & (F.abs("y") <= half))
    fitted = align_clouds(
        pairs.select(*pair), source, [*keys, "prior_id"], ground, [*keys, "kf_id"], size, patch_size, rounds
    ).where(F.col("converged") & (F.col("fitness") <= max_fitness))

    staged = (
        fitted.join(pairs, pair)
        .join(priors.select(*keys, "prior_id", *[F.col(f).alias(f"q_{f}") for f in FIELDS]), [*keys, "prior_id"])
        .join(links, [*keys, "linked_id"])
        .join(keyframes.select(*keys, "kf_id", *[F.col(f).alias(f"c_{f}") for f in FIELDS]), [*keys, "kf_id"])
    )
    driven = compose(_pose("c_"), inverse(_pose("k_"))).fields()
    r = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    guess = _pose("q_")
    patched = Pose(
        matmul(r, guess.rotation), [v + F.col(f"t{c}") for v, c in zip(matvec(r, guess.translation), XYZ)]
    ).fields()
    steps = staged.select(
        *keys, "kf_id", "prior_id", "linked_id", "fitness", *[F.col(f"k_{f}") for f in FIELDS],
        *[v.alias(f"o_{f}") for f, v in driven.items()], *[v.alias(f"p_{f}") for f, v in patched.items()],
    )
    passed = prior_gate(cut(steps), max_z, max_angle)
    first = passed.groupBy(*keys, "kf_id").agg(F.min("prior_id").alias("prior_id"))
    chosen = passed.join(first, [*keys, "kf_id", "prior_id"], "left_semi")

    own = rpy_quat(F.col("o_roll"), F.col("o_pitch"), F.col("o_yaw"))
    goal = rpy_quat(F.col("p_roll"), F.col("p_pitch"), F.col("o_yaw"))
    mixed = chosen.withColumns(dict(zip(["_qx", "_qy", "_qz", "_qw"], quat_normalise(slerp(own, goal, blend)))))
    attitude = matrix_rpy(quat_matrix([F.col(c) for c in ("_qx", "_qy", "_qz", "_qw")]))
    mixed = cut(mixed.withColumns(dict(zip(["b_roll", "b_pitch", "b_yaw"], attitude))))
    step = from_columns(*[F.col(f"o_{c}") for c in XYZ], F.col("b_roll"), F.col("b_pitch"), F.col("b_yaw"))
    goal_pose = compose(step, _pose("k_"))
    rel = between(_pose("k_"), goal_pose).fields()
    noise, tight = F.greatest(F.col("fitness"), F.lit(1e-6)) * float(weight), F.lit(1e-6)
    return mixed.select(
        *keys, F.lit("prior").alias("kind"), F.col("linked_id").alias("from_id"), F.col("kf_id").alias("to_id"),
        *[rel[f].alias(f) for f in FIELDS], F.lit(False).alias("robust"),
        *[v.alias(f"var{i}") for i, v in enumerate([noise, noise, tight, tight, tight, noise])],
    ).select(*keys, *EDGE)
