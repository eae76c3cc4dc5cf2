"""Feature job: raw points to corners and surfaces of every scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.operators import images, scans, selection
from scanlake.operators.voxels import voxel_downsample


def feature_job(
    points: DataFrame,
    motion: DataFrame | None = None,
    n_rings: int = 16,
    horizon: int = 1024,
    minimum: float = 1.0,
    maximum: float = 100.0,
    edge: float = 0.1,
    flat: float = 0.1,
    corners: int = 20,
    leaf: float = 0.2,
) -> DataFrame:
    """Rows (scan, ``kind``, x, y, z): corners as picked, surfaces as centroids per ring and leaf.

    With ``motion`` (see ``scan_motion``) the points are deskewed after the range image is made,
    so ranges and columns stay those of the sensor.
    """
    image = images.first_hit(points, n_rings, horizon, minimum, maximum)
    if motion is not None:
        image = scans.deskew(image, motion)
    indexed = images.parallel_mask(images.occlusion_mask(images.curvature(images.dense_index(image))))
    masked = indexed.withColumn("blocked", F.col("occluded") | F.col("parallel"))
    pixels = selection.pick_features(masked, images.ring_bounds(image, n_rings), edge, flat, corners, ["ring", "x", "y", "z"])
    picked = pixels.where("label = 1").select("scan_id", "ring", F.lit("corner").alias("kind"), "x", "y", "z")
    rest = voxel_downsample(pixels.where("in_sector and label <= 0"), ["scan_id", "ring"], leaf)
    return picked.unionByName(
        rest.select("scan_id", "ring", F.lit("surface").alias("kind"), "x", "y", "z")
    )
