"""Voxel aggregates and voxel correspondences. All sums combine on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.geometry import concentration, grid_cell, norm3, polar_key, voxel_key

XYZ = ("x", "y", "z")
COV = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
VOXEL = ("vx", "vy", "vz")


def voxel_downsample(
    df: DataFrame, keys: Sequence[str], leaf: float, values: Sequence[str] = ()
) -> DataFrame:
    """Centroid and means of ``values`` per cubic leaf and key."""
    cells = [grid_cell(F.col(c), leaf).alias(v) for c, v in zip(XYZ, VOXEL)]
    return df.groupBy(*keys, *cells).agg(
        *[F.avg(c).alias(c) for c in (*XYZ, *values)], F.count(F.lit(1)).alias("n")
    )


def _voxel_stats(df: DataFrame, keys: Sequence[str], cells: list[Column], raw: bool) -> DataFrame:
    x, y, z = map(F.col, XYZ)
    length = norm3(x, y, z)
    safe = F.when(length > 0, length)
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in XYZ]]
    aggs += [F.avg(F.col(c) / safe).alias(f"u{c}") for c in XYZ]
    if all(c in df.columns for c in COV):
        aggs += [F.avg(c).alias(c) for c in COV]
    stats = df.groupBy(*keys, *[c.alias(v) for c, v in zip(cells, VOXEL)]).agg(*aggs)
    if raw:
        r_bar = F.sqrt(sum((F.col(f"m{c}") * F.col(f"m{c}") for c in XYZ), F.lit(1.0)))
    else:
        r_bar = norm3(F.col("ux"), F.col("uy"), F.col("uz"))
    return stats.withColumn("r_bar", r_bar).withColumn("kappa", concentration(F.col("r_bar"))).drop(
        "ux", "uy", "uz"
    )


def voxel_map(df: DataFrame, keys: Sequence[str], size: float, raw: bool = False) -> DataFrame:
    """Cartesian voxels: count, mean, mean point covariance (when the points carry one), mean
    resultant length of the directions and its concentration.

    ``raw`` uses the coordinates themselves with a homogeneous 1 instead of unit directions.
    """
    return _voxel_stats(df, keys, voxel_key([F.col(c) for c in XYZ], size), raw)


def polar_voxel_map(
    df: DataFrame,
    keys: Sequence[str],
    size: Sequence[float] = (0.175, 0.175, 2.0),
    raw: bool = False,
) -> DataFrame:
    """The same over azimuth, inclination and range."""
    return _voxel_stats(df, keys, polar_key([F.col(c) for c in XYZ], size), raw)


def neighbour_offsets(n: int) -> list[tuple[int, int, int]]:
    """Voxel offsets: the voxel itself, with its 6 faces, or with all 26 neighbours."""
    steps = (-1, 0, 1)
    cube = [(i, j, k) for i in steps for j in steps for k in steps]
    reach = {1: 0, 7: 1, 27: 3}
    if n not in reach:
        raise ValueError("offsets must be 1, 7 or 27")
    return [o for o in cube if sum(map(abs, o)) <= reach[n]]


def voxel_join(
    source: DataFrame,
    voxels: DataFrame,
    keys: Sequence[str],
    cells: Sequence[Column],
    offsets: int = 1,
    prefix: str = "v_",
) -> DataFrame:
    """Source points with the voxels at their index plus each offset, an equi-join.

    ``cells`` are the three voxel index expressions of a (transformed) source point.
    """
    near = neighbour_offsets(offsets)
    probes = source.withColumns({f"_{v}": c for v, c in zip(VOXEL, cells)})
    if offsets == 1:
        probes = probes.withColumns({v: F.col(f"_{v}") for v in VOXEL})
    else:
        probes = probes.withColumn(
            "_o", F.explode(F.array(*[F.struct(*[F.lit(c).alias(v) for c, v in zip(o, VOXEL)]) for o in near]))
        ).withColumns({v: F.col(f"_{v}") + F.col(f"_o.{v}") for v in VOXEL}).drop("_o")
    named = voxels.select(
        *keys, *VOXEL, *[F.col(c).alias(prefix + c) for c in voxels.columns if c not in (*keys, *VOXEL)]
    )
    return probes.join(named, [*keys, *VOXEL]).drop(*[f"_{v}" for v in VOXEL])
