"""Batch registration of scan pairs: all pairs advance together, one aggregate per round."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.operators import fits, registration as reg
from scanlake.operators.voxels import polar_voxel_map, voxel_map
from scanlake.session import Rounds, cut

NAMES = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
STATE = "pair_id bigint, " + ", ".join(f"{n} double" for n in NAMES) + ", damping double, settled boolean, rounds int"


def _rows(df: pd.DataFrame) -> np.ndarray:
    flat = df[NAMES].to_numpy(dtype=float)
    return np.concatenate([flat[:, :9].reshape(-1, 3, 3), flat[:, 9:, None]], axis=2)


def _rotate(eps: float):
    def run(batches):
        for pdf in batches:
            pairs = zip(pdf["moments"], _rows(pdf), pdf["damping"].to_numpy(float).tolist())
            found = [reg.rotation_step(np.asarray(m, float), v.reshape(-1), lam, eps) for m, v, lam in pairs]
            flat = np.array([v for v, _, _ in found], float).reshape(-1, 3, 4)
            moved = np.concatenate([flat[:, :, :3].reshape(-1, 9), flat[:, :, 3]], axis=1)
            yield pd.DataFrame(moved, columns=NAMES).assign(
                pair_id=pdf["pair_id"].to_numpy(), damping=[float(lam) for _, lam, _ in found], settled=[bool(s) for _, _, s in found],
                rounds=pdf["rounds"].to_numpy() + 1,
            )[["pair_id", *NAMES, "damping", "settled", "rounds"]]

    return run


def register_pairs(
    points: DataFrame,
    pairs: DataFrame,
    k: int = 20,
    cells: Sequence[float] = (0.5, 1.0, 2.0, 4.0),
    size: Sequence[float] | float = (0.175, 0.175, 2.0),
    method: str = "plane",
    offsets: int = 1,
    rotation_eps: float = 2e-3,
    translation_eps: float = 5e-4,
    strength: float = 1.0,
    rounds: int = 64,
) -> DataFrame:
    """Transform per pair that moves its source scan onto its target scan.

    ``points`` are feature points (``scan_id``, ``point_idx``, x, y, z); ``pairs`` has ``pair_id``,
    ``source_id``, ``target_id`` and optionally the translation guess ``g0..g2``, the last
    translation ``l0..l2`` and the time steps ``dt``, ``last_dt``. Rotation rounds re-associate
    points and voxels; pairs that have settled leave. The translation is then solved from one
    more aggregate. Returns ``pair_id``, ``r00..r22``, ``t0..t2``, ``rounds``.
    """
    defaults = {**{f"g{i}": 0.0 for i in range(3)}, **{f"l{i}": 0.0 for i in range(3)}, "dt": 0.1, "last_dt": 0.1}
    full = pairs.withColumns({n: F.lit(v) for n, v in defaults.items() if n not in pairs.columns})
    used = full.select(F.col("source_id").alias("scan_id")).union(full.select("target_id")).distinct()
    cloud = points.select("scan_id", "point_idx", "x", "y", "z").join(used, "scan_id", "left_semi")
    cov = fits.local_cov(cloud, ["scan_id"], k, "point_idx", cells, method)
    with_cov = cut(
        cloud.join(cov.select("scan_id", "point_idx", *reg.COV), ["scan_id", "point_idx"])
    )
    build = (lambda df: voxel_map(df, ["scan_id"], size)) if isinstance(size, (int, float)) else (
        lambda df: polar_voxel_map(df, ["scan_id"], size)
    )
    voxels = cut(build(with_cov))
    source = with_cov.join(
        full.select("pair_id", F.col("source_id").alias("scan_id")), "scan_id"
    ).drop("scan_id")
    target = voxels.join(full.select("pair_id", F.col("target_id").alias("scan_id")), "scan_id").drop("scan_id")

    identity = {f"r{i}{j}": F.lit(1.0 if i == j else 0.0) for i in range(3) for j in range(3)}
    state = full.select(
        "pair_id", *[v.alias(n) for n, v in identity.items()], *[F.col(f"g{i}").alias(f"t{i}") for i in range(3)],
        F.lit(-1.0).alias("damping"), F.lit(False).alias("settled"), F.lit(0).alias("rounds"),
    )
    steps = Rounds(points.sparkSession, "register")
    for _ in range(rounds):
        matches = reg.correspondences(source, target, state, ["pair_id"], size, offsets)
        moments = reg.pair_moments(matches, ["pair_id"])
        stepped = state.join(moments, "pair_id").mapInPandas(_rotate(rotation_eps), STATE)
        lost = state.join(moments, "pair_id", "left_anti").withColumn("settled", F.lit(True))
        stepped = steps.add(stepped.unionByName(lost))
        state = stepped.where("not settled")
        if state.isEmpty():
            break
    rotated = steps.all().where("settled").unionByName(state)

    matches = reg.correspondences(source, target, rotated, ["pair_id"], size, offsets)
    moments = reg.pair_moments(matches, ["pair_id"])
    extra = full.select("pair_id", *defaults)

    def shift(batches):
        for pdf in batches:
            last, times = pdf[["l0", "l1", "l2"]].to_numpy(float), pdf[["dt", "last_dt"]].to_numpy(float).tolist()
            counts = pdf["n"].to_numpy(float).tolist()
            moved = [
                v[:, 3] + reg.translation_solve(np.asarray(m, float), n, v.reshape(-1), v[:, 3], l, *dts, strength, translation_eps)
                for m, n, v, l, dts in zip(pdf["moments"], counts, _rows(pdf), last, times)
            ]
            moved = np.array(moved, float).reshape(-1, 3)
            yield pdf[["pair_id", *NAMES, "rounds"]].assign(t0=moved[:, 0], t1=moved[:, 1], t2=moved[:, 2])

    solved = rotated.join(moments, "pair_id").join(extra, "pair_id").mapInPandas(
        shift, "pair_id bigint, " + ", ".join(f"{n} double" for n in NAMES) + ", rounds int"
    )
    unmatched = rotated.join(moments, "pair_id", "left_anti").select("pair_id", *NAMES, "rounds")
    return solved.unionByName(unmatched)
