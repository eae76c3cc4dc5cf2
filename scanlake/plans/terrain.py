"""Terrain attitude: spring equilibrium of many vehicle poses on the ground map."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.operators import contact, terrain
from scanlake.operators.neighbours import nearest_xy, patches_xy
from scanlake.operators.runs import map_runs

RESULT = "x double, y double, z double, roll double, pitch double, yaw double, cost double, rounds int, end_reason string, distances array<double>"


def _start_height(patches: contact.Patches, places: np.ndarray, radius: float, least: int, rise: float) -> np.ndarray:
    """The lowest mean ground height around the points nearest to the wheels, plus ``rise``; 0 without ground."""
    nearest = patches.nearest(patches.distances(places[..., :2]))
    around = np.nan_to_num(nearest)
    mean = patches.mean_height(patches.distances(around[..., :2]), radius, least)
    lowest = np.where(np.isnan(mean), nearest[..., 2], mean).min(axis=1)
    return np.where(np.isnan(lowest), 0.0, lowest + rise)


def settle(
    queries: DataFrame,
    ground: DataFrame,
    wheels,
    keys: Sequence[str] = ("tile_id",),
    query_id: str = "query_id",
    point_id: str = "point_idx",
    com_z: float = 1.0,
    k_spring: float = 20.0,
    g: float = 1.0,
    max_iters: int = 50,
    damping: float = 0.01,
    tol_cost: float = 1e-12,
    tol_step: float = 1e-10,
    radius: float = 0.3,
    min_neighbours: int = 5,
    fit: tuple[float, float, int] = (0.6, 3.0, 15),
    cells: Sequence[float] = terrain.GROUND_CELLS,
    limits: tuple[float, float, float, float, float] = (-10.0, 10.0, 1.0, 1.0, 1.0),
) -> DataFrame:
    """Height, roll and pitch of every query (``qx``, ``qy``, ``qyaw``) at rest on the ground.

    Springs under the wheels balance the weight; the yaw stays fixed. However a vehicle tilts, its wheels stay
    within the length of its longest arm, and the nearest ground point of each within that length, twice, plus the
    distance of the query's own. So each query's patch of that radius, or of arm and fit radius, is looked up once and
    answers every later question exactly as the whole map would. All queries of a task then advance together, to the
    last round, without another lookup.

    The pose with the lowest cost is returned with its wheel distances and the gate's verdict; ``limits`` are
    lowest z, highest z, roll, pitch and wheel distance. A query on a tile without ground has null distances and the
    reason ``ground``.
    """
    keys = list(keys)
    at = [*keys, query_id]
    local = np.array([(x, y, -float(com_z)) for x, y in wheels], float)
    arm = float(np.sqrt((local**2).sum(axis=1)).max())
    asked = queries.select(*at, F.col("qx").alias("x"), F.col("qy").alias("y"), "qyaw")
    near = nearest_xy(asked, ground, keys, query_id, point_id, cells).select(*at, F.sqrt("d2").alias("_d"))
    reach = F.greatest(F.lit(arm + fit[0]), 2 * arm + F.col("_d") + float(radius)) * (1 + 1e-9)
    patches = patches_xy(asked.join(near.withColumn("reach", reach), at), ground, keys, query_id, point_id)
    rows = asked.withColumnsRenamed({"x": "qx", "y": "qy"}).join(patches, at, "left")

    def solve(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        weight = np.nan_to_num(pdf["n"].to_numpy(float))
        held = contact.Patches(starts, pdf[["x", "y", "z"]].to_numpy(float), weight)
        one = pdf.iloc[starts]
        xy, yaw = one[["qx", "qy"]].to_numpy(float), one["qyaw"].to_numpy(float)
        flat = local * [1.0, 1.0, 0.0]
        _, places = contact.wheel_places(contact.turns(2, yaw), np.column_stack([xy, 0 * yaw]), flat)
        height = _start_height(held, places, radius, min_neighbours, float(com_z) - 1.0)
        found = contact.rest(held, xy, yaw, height, local, k_spring, g, fit, max_iters, damping, tol_cost, tol_step)
        rotation = found["rotation"]
        _, places = contact.wheel_places(rotation, np.column_stack([xy, found["z"]]), local)
        gaps = ((places - held.nearest(held.distances(places[..., :2]))) * rotation[:, None, :, 2]).sum(axis=-1)
        level = contact.turns(2, -yaw) @ rotation
        return one[at].assign(
            x=xy[:, 0], y=xy[:, 1], z=found["z"], roll=np.arctan2(level[:, 2, 1], level[:, 2, 2]),
            pitch=np.arctan2(-level[:, 2, 0], level[:, 0, 0]), yaw=yaw, cost=found["cost"], rounds=found["rounds"],
            end_reason=np.where(found["settled"], "converged", "max_iters"),
            distances=[None if np.isnan(d).any() else d.tolist() for d in gaps],
        )

    schema = T.StructType([*(queries.schema[c] for c in at), *T.StructType.fromDDL(RESULT)])
    return terrain.attitude_gate(map_runs(rows, at, [point_id], solve, schema), *limits)
