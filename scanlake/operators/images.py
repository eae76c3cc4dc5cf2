"""Range images: first hit per pixel, scan-line order, curvature and masks.

``first_hit`` leaves at most one row per pixel, so afterwards a scan has at most
rings x columns rows whatever came in, and the scan windows below run on bounded groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scanlake.functions.geometry import norm3
from scanlake.operators.scans import image_column

def _scan() -> WindowSpec:
    return Window.partitionBy("scan_id").orderBy("idx")


def first_hit(
    points: DataFrame,
    n_rings: int = 16,
    horizon: int = 1024,
    minimum: float = 1.0,
    maximum: float = 100.0,
    rate: int = 1,
) -> DataFrame:
    """The range image as sparse rows (scan, ring, column): the first point to hit a pixel wins.

    Every direction has a column from 0 to ``horizon - 1``, so columns need no check, which would compute them twice.
    """
    rng = norm3(F.col("x"), F.col("y"), F.col("z"))
    col = image_column(F.col("x"), F.col("y"), horizon)
    kept = (
        points.where(rng.between(minimum, maximum))
        .where(F.col("ring").between(0, n_rings - 1) & (F.col("ring") % rate == 0))
        .withColumns({"rng": rng, "col": col})
    )
    values = [c for c in kept.columns if c not in ("scan_id", "ring", "col", "point_idx")]
    return kept.groupBy("scan_id", "ring", "col").agg(
        F.min("point_idx").alias("point_idx"),
        *[F.min_by(c, "point_idx").alias(c) for c in values],
    )


def dense_index(pixels: DataFrame) -> DataFrame:
    """Position of a pixel in the scan, row by row, from 0."""
    order = Window.partitionBy("scan_id").orderBy("ring", "col")
    return pixels.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint"))


def ring_bounds(pixels: DataFrame, n_rings: int) -> DataFrame:
    """First and last usable index of every ring: five pixels are left at both ends."""
    counts = pixels.groupBy("scan_id", "ring").agg(F.count(F.lit(1)).alias("n"))
    rings = (
        counts.select("scan_id").distinct()
        .withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(n_rings - 1))))
    )
    before = Window.partitionBy("scan_id").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("scan_id").orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce("n", F.lit(0))
    return rings.join(counts, ["scan_id", "ring"], "left").select(
        "scan_id",
        "ring",
        (F.coalesce(F.sum(n).over(before), F.lit(0)) - 1 + 5).cast("bigint").alias("start_idx"),
        (F.sum(n).over(upto) - 1 - 5).cast("bigint").alias("end_idx"),
    )


def _inner(lead: int, tail: int) -> Column:
    """Rows with at least ``lead`` rows before and ``tail`` after them in the scan."""
    size = F.count(F.lit(1)).over(Window.partitionBy("scan_id"))
    return (F.col("idx") >= lead) & (F.col("idx") < size - tail)


def _eleven_sum(value: Column) -> Column:
    return F.sum(value).over(_scan().rowsBetween(-5, 5)) - 11 * value


def curvature(indexed: DataFrame) -> DataFrame:
    """Squared difference of a range to its five neighbours on either side; null at the ends."""
    diff = _eleven_sum(F.col("rng"))
    return indexed.withColumn("curvature", F.when(_inner(5, 5), diff * diff))


def curvature_xyz(indexed: DataFrame) -> DataFrame:
    """The same per coordinate, squares summed."""
    total = sum((_eleven_sum(F.col(c)) * _eleven_sum(F.col(c)) for c in ("y", "z")),
                _eleven_sum(F.col("x")) * _eleven_sum(F.col("x")))
    return indexed.withColumn("curvature", F.when(_inner(5, 5), total))


def occlusion_mask(indexed: DataFrame, column_gap: int = 10, depth_step: float = 0.3) -> DataFrame:
    """True for the six points on the far side of a depth step between neighbours."""
    ahead = F.lead("rng").over(_scan())
    gap = F.abs(F.lead("col").over(_scan()) - F.col("col"))
    near = _inner(5, 6) & (gap < column_gap)
    steps = indexed.withColumns(
        {
            "_back": F.coalesce(near & (F.col("rng") - ahead > depth_step), F.lit(False)),
            "_fwd": F.coalesce(near & (ahead - F.col("rng") > depth_step), F.lit(False)),
        }
    )
    blocked = F.max("_back").over(_scan().rowsBetween(0, 5)) | F.coalesce(
        F.max("_fwd").over(_scan().rowsBetween(-6, -1)), F.lit(False)
    )
    return steps.withColumn("occluded", blocked).drop("_back", "_fwd")


def parallel_mask(indexed: DataFrame, share: float = 0.02) -> DataFrame:
    """True where the range differs from both neighbours by more than ``share`` of itself."""
    limit = share * F.col("rng")
    before = F.abs(F.lag("rng").over(_scan()) - F.col("rng"))
    after = F.abs(F.lead("rng").over(_scan()) - F.col("rng"))
    flag = _inner(5, 6) & (before > limit) & (after > limit)
    return indexed.withColumn("parallel", F.coalesce(flag, F.lit(False)))


def sectors(bounds: DataFrame, n: int = 6) -> DataFrame:
    """Equal parts of every ring's usable index range, both ends inclusive; empty ones dropped."""
    s, e, j = F.col("start_idx"), F.col("end_idx"), F.col("sector")

    def whole(v: Column) -> Column:
        return (v / F.lit(n)).cast("bigint")

    return (
        bounds.withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumns(
            {
                "sp": whole(s * (n - j) + e * j),
                "ep": whole(s * (n - 1 - j) + e * (j + 1)) - 1,
            }
        )
        .where(F.col("sp") < F.col("ep"))
        .select("scan_id", "ring", "sector", "sp", "ep")
    )
