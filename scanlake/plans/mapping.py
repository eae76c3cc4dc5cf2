"""Scan-to-map refinement and map building."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.functions.angles import clamp
from scanlake.functions.geometry import dist3
from scanlake.functions.poses import FIELDS
from scanlake.operators import fits, neighbours as nb, refine
from scanlake.operators.runs import map_table_runs
from scanlake.operators.scans import transform_points
from scanlake.operators.tiles import TILE
from scanlake.operators.voxels import voxel_downsample
from scanlake.session import Rounds, cut

XYZ = ("x", "y", "z")
UNKNOWNS = ("roll", "pitch", "yaw", "x", "y", "z")


def _step(keys: list[str], limits: refine.Limits):
    upper = [(i, j) for i in range(6) for j in range(i, 6)]

    def run(batches):
        for pdf in batches:
            out = pdf[[*keys, *FIELDS, "settled", "projection", "rounds", "degenerate"]].reset_index(drop=True)
            out["rounds"] += 1
            enough = pdf["n"].to_numpy(float) >= limits.min_matches
            settled, degenerate = ~enough, out["degenerate"].to_numpy(bool).copy()
            rows = np.flatnonzero(enough)
            if len(rows):
                some = pdf.iloc[rows]
                h = np.zeros((len(rows), 6, 6))
                for i, j in upper:
                    h[:, i, j] = h[:, j, i] = some[f"h{i}{j}"].to_numpy(float)
                g = some[[f"g{i}" for i in range(6)]].to_numpy(float)
                before = np.array([np.full(36, np.nan) if v is None else v for v in some["projection"]], float)
                x, p, weak = refine.advance(h, g, before, limits.threshold)
                degenerate[rows[weak]] = True
                places = np.full((len(pdf), 36), np.nan)
                places[rows] = p
                out["projection"] = [list(v) if e else w for v, e, w in zip(places, enough, out["projection"])]
                for k, name in enumerate(UNKNOWNS):
                    column = out[name].to_numpy(float).copy()
                    column[rows] += x[:, k]
                    out[name] = column
                settled[rows] = refine.small_step(x, limits.rot_eps, limits.trans_eps)
            yield out.assign(settled=settled, degenerate=degenerate)

    return run


def refine_to_map(
    edges: DataFrame,
    surfaces: DataFrame,
    edge_map: DataFrame,
    surface_map: DataFrame,
    guesses: DataFrame,
    keys: Sequence[str],
    point_id: str = "point_id",
    max_d: float = 1.0,
    tolerance: float = 0.2,
    rounds: int = 30,
    min_matches: int = 50,
    threshold: float = 100.0,
    rot_eps: float = 0.05,
    trans_eps: float = 0.05,
    rotation_limit: float | None = None,
    z_limit: float | None = None,
    at_once: int = TILE,
) -> DataFrame:
    """Pose of every scan refined against its map by edge and surface matches.

    A scan of whose points and maps none has more than ``at_once`` points is sent to one task and takes all its rounds
    there. Larger scans advance together: each round is one pass of neighbour joins and one aggregate of 27
    sums per scan, then a 6x6 solve per scan; scans that settled (or have fewer than
    ``min_matches`` matches) leave. ``edges`` and ``surfaces`` are in the sensor frame, the maps in
    the world frame, all carry ``keys`` (the scan) and ``point_id``; ``guesses`` has the start pose.
    """
    keys = list(keys)
    limits = refine.Limits(max_d, tolerance, rounds, min_matches, threshold, rot_eps, trans_eps)
    clouds = [df.select(*keys, point_id, *XYZ) for df in (edges, surfaces, edge_map, surface_map)]
    sizes = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > at_once).select(*keys) for df in clouds]
    large = cut(sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(sizes[3]).distinct())
    if large.isEmpty():
        result = _refine_small(clouds, guesses, keys, point_id, limits)
    else:
        small = _refine_small([df.join(large, keys, "left_anti") for df in clouds], guesses.join(large, keys, "left_anti"), keys, point_id, limits)
        wide = [df.join(large, keys, "left_semi") for df in clouds]
        result = small.unionByName(_refine_large(wide, guesses.join(large, keys, "left_semi"), keys, point_id, limits))
    if rotation_limit is not None:
        result = result.withColumns({c: clamp(F.col(c), rotation_limit) for c in ("roll", "pitch")})
    if z_limit is not None:
        result = result.withColumn("z", clamp(F.col("z"), z_limit))
    return result


def _refine_small(clouds: list[DataFrame], guesses: DataFrame, keys: list[str], point_id: str, limits: refine.Limits) -> DataFrame:
    """Scans that fit a task: each with its maps in one run, which takes all rounds."""
    poses = guesses.select(*keys, F.lit(0).alias("_kind"), *[F.col(c).cast("double").alias(c) for c in FIELDS])
    rows = poses
    for kind, df in enumerate(clouds, 1):
        known = df.dropna(subset=[*keys, *XYZ]).select(
            *keys, F.lit(kind).alias("_kind"), F.col(point_id).alias("_point"), *[F.col(c).cast("double").alias(c) for c in XYZ]
        )
        rows = rows.unionByName(known, allowMissingColumns=True)
    names = [*FIELDS, "settled", "rounds", "degenerate"]
    fields = [T.DoubleType()] * len(FIELDS) + [T.BooleanType(), T.IntegerType(), T.BooleanType()]
    schema = T.StructType([*(guesses.schema[k] for k in keys), *(T.StructField(n, t) for n, t in zip(names, fields))])

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        kind = table.column("_kind").to_numpy()
        values = np.column_stack([table.column(c).fill_null(float("nan")).to_numpy() for c in FIELDS])
        at, found = [], []
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            edges = begin + np.searchsorted(kind[begin:end], np.arange(6))
            edge, surface, edge_map, surface_map = (values[a:b, :3] for a, b in zip(edges[1:], edges[2:]))
            sides = [(refine.lines, edge, edge_map), (refine.planes, surface, surface_map)]
            for row in range(edges[0], edges[1]):
                at.append(row)
                found.append(refine.refine_scan(values[row], sides, limits))
        out = table.select(keys).take(pa.array(at, pa.int64()))
        poses = np.array([f[0] for f in found], float).reshape(-1, 6)
        columns = [pa.array(c) for c in poses.T]
        columns += [pa.array([f[i] for f in found], t) for i, t in ((1, pa.bool_()), (2, pa.int32()), (3, pa.bool_()))]
        for name, column in zip(names, columns):
            out = out.append_column(name, column)
        return out

    return map_table_runs(rows, keys, ["_kind", "_point"], run, schema)


def _refine_large(clouds: list[DataFrame], guesses: DataFrame, keys: list[str], point_id: str, limits: refine.Limits) -> DataFrame:
    """Scans of any size: all advance together, a round a pass over tables."""
    edges, surfaces, edge_map, surface_map = clouds
    types = {f.name: f.dataType.simpleString() for f in guesses.schema.fields}
    schema = ", ".join(
        [*(f"{k} {types[k]}" for k in keys), *(f"{f} double" for f in FIELDS), "settled boolean",
         "projection array<double>", "rounds int", "degenerate boolean"]
    )
    state = guesses.select(
        *keys, *FIELDS, F.lit(False).alias("settled"), F.lit(None).cast("array<double>").alias("projection"),
        F.lit(0).alias("rounds"), F.lit(False).alias("degenerate"),
    )
    names = [f"h{i}{j}" for i in range(6) for j in range(i, 6)] + [f"g{i}" for i in range(6)]

    def matched(cloud: DataFrame, goal: DataFrame, poses: DataFrame, plane: bool) -> DataFrame:
        kept = cloud.select(*keys, point_id, *XYZ, *[F.col(c).alias(f"raw_{c}") for c in XYZ])
        moved = transform_points(kept, poses, keys)
        if plane:
            hits = fits.plane_matches(
                moved, goal, keys, point_id, point_id, limits.max_d, tolerance=limits.tolerance, range_columns=["raw_x", "raw_y", "raw_z"]
            )
        else:
            hits = fits.edge_matches(moved, goal, keys, point_id, point_id, limits.max_d)
        attitude = poses.select(*keys, "roll", "pitch", "yaw")
        return hits.join(cloud.select(*keys, point_id, *XYZ), [*keys, point_id]).join(attitude, keys)

    steps = Rounds(guesses.sparkSession, "refine")
    for _ in range(limits.rounds):
        both = matched(edges, edge_map, state, False).unionByName(matched(surfaces, surface_map, state, True))
        sums = fits.normal_eq_map(both, keys)
        joined = state.join(sums.select(*keys, "n", *names), keys, "left")
        stepped = steps.add(joined.mapInPandas(_step(keys, limits), schema))
        state = stepped.where("not settled")
        if state.isEmpty():
            break
    return steps.all().where("settled").unionByName(state).drop("projection")


def build_map(
    keyframes: DataFrame,
    points: DataFrame,
    radius: float = 1000.0,
    pose_density: float = 10.0,
    leaf: float = 1.0,
    keys: Sequence[str] = ("vehicle_id",),
    cells: Sequence[float] = (2.0, 4.0, 8.0, 16.0),
) -> DataFrame:
    """Global map per vehicle: keyframes near the newest one, thinned to one per ``pose_density``,
    their clouds in the world frame, one centroid per ``leaf``."""
    keys = list(keys)
    near = nb.near_keyframes(keyframes, radius, keys)
    thin = voxel_downsample(near, keys, pose_density).withColumn("thin_id", F.struct("vx", "vy", "vz"))
    current = nb.newest(keyframes.select(*keys, "kf_id", *XYZ), keys)
    inside = dist3([F.col(c) for c in XYZ], [F.col(f"c_{c}") for c in XYZ]) <= float(radius)
    thin = thin.join(current, keys).where(inside).drop(*[f"c_{c}" for c in ("kf_id", *XYZ)])
    chosen = nb.snap_nearest(thin, keyframes, keys, "thin_id", "kf_id", cells).select(*keys, "kf_id")
    return nb.assemble_submap(chosen, keyframes, points, leaf=leaf, keys=keys)
