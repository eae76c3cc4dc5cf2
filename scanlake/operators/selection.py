"""Ordered selections that depend on what was picked before: features, samplers, keyframes.

Picks inside a scan run per scan (a range image bounds its size). Selections along a drive run block by
block: the sampler follows pointers, keyframes are a fold (``operators.folds``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.functions.poses import FIELDS
from scanlake.operators.folds import Fold, chained_fold
from scanlake.operators.images import sectors
from scanlake.operators.runs import map_table_runs
from scanlake.operators.timeline import HOUR, block_of, seconds



# ---- picks inside a scan ------------------------------------------------------------------------


def _reach(jump: np.ndarray, n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """How many neighbours ahead and behind each index are joined to it without a jump."""
    at = np.flatnonzero(jump)
    i = np.arange(n)
    ahead_at = np.searchsorted(at, i)
    next_jump = np.where(ahead_at < len(at), at[np.minimum(ahead_at, len(at) - 1)] if len(at) else n - 1, n - 1)
    behind_at = np.searchsorted(at, i - 1, side="right") - 1
    last_jump = np.where(behind_at >= 0, at[np.maximum(behind_at, 0)] + 1 if len(at) else 0, 0)
    return np.minimum(next_jump - i, span), np.minimum(i - last_jump, span)


def label_scans(
    starts: np.ndarray, idx: np.ndarray, curvature: np.ndarray, blocked: np.ndarray, jump: np.ndarray, sp: np.ndarray, ep: np.ndarray,
    edge: float, flat: float, sharpest: int, sharp: int, flattest: int | None, sort_last: bool,
) -> np.ndarray:
    """Labels of scans that lie behind each other from ``starts``, each in order of ``idx``: 2 sharpest, 1 sharp, 0 none, -1 flat.

    ``jump`` tells whether a row isn't joined to the next one, ``sp`` and ``ep`` (NaN for none) the sector of a row. Sectors
    are visited in order. Corners are taken by falling curvature, then flat points by rising curvature; every pick
    blocks its connected neighbours, across sector borders too. Order and candidates of all sectors are found at once.
    """
    n = len(idx)
    scan = np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
    curvature = np.nan_to_num(curvature, nan=0.0, posinf=np.inf, neginf=-np.inf)
    jump = jump.copy()
    jump[np.append(starts[1:], n) - 1] = True
    ahead, behind = _reach(jump[:-1], n, 5)
    inside = np.flatnonzero(~np.isnan(sp))
    shift = starts[scan[inside]] - idx[starts][scan[inside]]
    spans = np.unique(np.stack([sp[inside] + shift, ep[inside] + shift], axis=1).astype(np.int64), axis=0)
    sizes = spans[:, 1] - spans[:, 0] + 1
    sector = np.repeat(np.arange(len(spans)), sizes)
    row = np.arange(sizes.sum()) + np.repeat(spans[:, 0] - (np.cumsum(sizes) - sizes), sizes)
    last = np.zeros(len(row), bool) if sort_last else row == spans[sector, 1]
    order = np.lexsort((row, curvature[row], last, sector))
    free = order[~blocked[row[order]]]
    low, high = free[curvature[row[free]] < flat], free[curvature[row[free]] > edge][::-1]
    flats, corners = row[low].tolist(), row[high].tolist()
    whole = np.arange(len(spans) + 1)
    flat_from = np.searchsorted(sector[low], whole).tolist()
    corner_from = (len(corners) - np.searchsorted(sector[high[::-1]], whole)).tolist()
    label = np.zeros(n, np.int32)
    taken, ones = bytearray(blocked.astype(np.uint8).tobytes()), bytes([1]) * 16
    begin, end = (np.arange(n) - behind).tolist(), (np.arange(n) + ahead + 1).tolist()
    for k in range(len(spans)):
        picked = 0
        for i in corners[corner_from[k + 1] : corner_from[k]]:
            if taken[i]:
                continue
            picked += 1
            if picked > sharp:
                break
            label[i] = 2 if picked <= sharpest else 1
            taken[begin[i] : end[i]] = ones[: end[i] - begin[i]]
        picked = 0
        for i in flats[flat_from[k] : flat_from[k + 1]]:
            if taken[i]:
                continue
            label[i] = -1
            picked += 1
            if flattest is not None and picked >= flattest:
                break
            taken[begin[i] : end[i]] = ones[: end[i] - begin[i]]
    return label


def _jumps(col: np.ndarray | None, xyz: np.ndarray | None, column_gap: int | None, step_sq: float) -> np.ndarray:
    """Whether a row isn't joined to the next; false for the last."""
    if column_gap is not None:
        jump = np.abs(np.diff(col)) > column_gap
    else:
        jump = (np.diff(xyz, axis=0) ** 2).sum(1) > step_sq
    return np.append(jump, False)


def label_scan(
    pdf: pd.DataFrame, edge: float, flat: float, sharpest: int, sharp: int, flattest: int | None,
    column_gap: int | None, step_sq: float, sort_last: bool,
) -> pd.DataFrame:
    """``label_scans`` for the rows of one scan, in any order."""
    pdf = pdf.sort_values("idx").reset_index(drop=True)
    jump = _jumps(pdf["col"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(float), column_gap, step_sq)
    columns = [pdf[c].to_numpy(t) for c, t in (("idx", np.int64), ("curvature", float), ("blocked", bool))]
    spans = [pdf[c].to_numpy(float) for c in ("sp", "ep")]
    label = label_scans(np.zeros(1, np.int64), *columns, jump, *spans, edge, flat, sharpest, sharp, flattest, sort_last)
    return pdf.assign(label=label)[["scan_id", "idx", "label", "in_sector"]]


def _labelled(
    masked: DataFrame, bounds: DataFrame, edge: float, flat: float, sharpest: int, sharp: int, flattest: int | None,
    column_gap: int | None, step_sq: float, sort_last: bool, values: Sequence[str] = (),
) -> DataFrame:
    spans = bounds.groupBy("scan_id", "ring").agg(F.collect_list(F.struct("sp", "ep")).alias("_spans"))
    hit = F.filter("_spans", lambda s: (F.col("idx") >= s["sp"]) & (F.col("idx") <= s["ep"]))
    joins = ["col"] if column_gap is not None else ["x", "y", "z"]
    read = list(dict.fromkeys([*joins, *values]))
    rows = (
        masked.join(spans, ["scan_id", "ring"], "left")
        .withColumn("_s", F.get(hit, 0))
        .select(
            "scan_id", "idx", "curvature", "blocked", *read, F.col("_s.sp").cast("double").alias("_sp"), F.col("_s.ep").cast("double").alias("_ep"),
            F.col("_s").isNotNull().alias("in_sector"),
        )
    )

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        def column(name: str) -> np.ndarray:
            return table.column(name).cast(pa.float64()).fill_null(float("nan")).to_numpy()

        col = column("col") if column_gap is not None else None
        xyz = None if column_gap is not None else np.column_stack([column(c) for c in ("x", "y", "z")])
        blocked = table.column("blocked").to_numpy().astype(bool)
        label = label_scans(
            starts, table.column("idx").to_numpy(), column("curvature"), blocked, _jumps(col, xyz, column_gap, step_sq), column("_sp"),
            column("_ep"), edge, flat, sharpest, sharp, flattest, sort_last,
        )
        return table.select(["scan_id", "idx", *values]).append_column("label", pa.array(label)).append_column("in_sector", table.column("in_sector"))

    fields = [rows.schema[c] for c in ("scan_id", "idx", *values)]
    schema = T.StructType([*fields, T.StructField("label", T.IntegerType()), T.StructField("in_sector", T.BooleanType())])
    return map_table_runs(rows, ["scan_id"], ["idx"], run, schema)


def pick_features(
    masked: DataFrame, bounds: DataFrame, edge: float = 0.1, flat: float = 0.1, corners: int = 20, values: Sequence[str] = ()
) -> DataFrame:
    """Corner (1) and flat (-1) labels on a range image.

    ``masked`` is an indexed range image with ``curvature`` and ``blocked``; ``bounds`` comes from
    ``ring_bounds``. Up to ``corners`` corners per sector. ``values`` are columns of ``masked`` that go along.
    """
    return _labelled(
        masked, sectors(bounds), edge=edge, flat=flat, sharpest=0, sharp=corners, flattest=None,
        column_gap=10, step_sq=0.0, sort_last=False, values=values,
    )


def pick_corners(masked: DataFrame, bounds: DataFrame, edge: float = 0.1, corners: int = 20) -> DataFrame:
    """Pixels picked as corners."""
    return pick_features(masked, bounds, edge, -1.0, corners).where("label = 1").select("scan_id", "idx")


def pick_surfaces(labels: DataFrame) -> DataFrame:
    """Surface pixels: every pixel of a sector that is not a corner, picked as flat or not."""
    return labels.where("in_sector and label <= 0").select("scan_id", "idx")


def class_sectors(bounds: DataFrame, n: int = 6) -> DataFrame:
    """Sectors of the four-class variant; rings with fewer than six usable indexes are skipped."""
    s, e, j = F.col("start_idx") + 1, F.col("end_idx"), F.col("sector")
    return (
        bounds.withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .where(e - s >= 6)
        .select(
            "scan_id", "ring", "sector",
            (s + ((e - s) * j / n).cast("bigint")).alias("sp"),
            (s + ((e - s) * (j + 1) / n).cast("bigint") - 1).alias("ep"),
        )
    )


def pick_classes(
    indexed: DataFrame, bounds: DataFrame, threshold: float = 0.1, sharpest: int = 2, sharp: int = 20,
    flattest: int = 4, step_sq: float = 0.05,
) -> DataFrame:
    """Four classes: sharpest (2), sharp (1), flat (-1), and the rest (0) of every sector.

    Neighbours are blocked until two consecutive points are further apart than ``step_sq``.
    """
    masked = indexed.withColumn("blocked", F.lit(False))
    return _labelled(
        masked, class_sectors(bounds), edge=threshold, flat=threshold, sharpest=sharpest, sharp=sharp,
        flattest=flattest, column_gap=None, step_sq=step_sq, sort_last=True,
    ).where("in_sector").drop("in_sector")


# ---- selections along a drive -----------------------------------------------------------------


def _next_at(t: np.ndarray, starts: np.ndarray, wanted: np.ndarray, side: str) -> np.ndarray:
    """For each row the first row of its run at or (side "right") after its ``wanted`` time, or the number of rows."""
    found = np.empty(len(t), np.int64)
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(t)]):
        at = begin + np.searchsorted(t[begin:end], wanted[begin:end], side)
        found[begin:end] = np.where(at < end, at, len(t))
    return np.maximum(found, np.arange(len(t)) + 1)


def sample_interval(
    df: DataFrame, keys: Sequence[str], dt: float, ts: str = "ts", width: float = HOUR, strict: bool = False
) -> DataFrame:
    """Rows at least ``dt`` seconds (``strict``: more than) after the last kept one, from the first; one of equal times.

    Each row points to the row that would be kept after it. In every block of time the pointers are doubled until
    they lead to the last row kept in the block, for the few rows by which a block can be entered: those within ``dt`` of
    its begin, and the first one behind. Only these ways through the blocks are followed from a key's first
    row, and so each block learns where it is entered, whatever its width. Blocks are at least 16 ``dt`` wide.
    """
    if dt <= 0 and not strict:
        return df
    keys, side, width = list(keys), "right" if strict else "left", max(width, 16 * dt)
    at, columns = [*keys, "_block"], list(df.columns)
    blocked = df.withColumns({"_t": seconds(ts), "_block": block_of(ts, width)})

    def through(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t, n = table.column("_t").to_numpy(), table.num_rows
        jump = _next_at(t, starts, t + dt, side)
        last = np.where(jump < n, np.minimum(jump, n - 1), np.arange(n))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        begin = table.column("_block").to_numpy() * width
        entry = t < begin + dt
        behind = _next_at(t, starts, begin + dt, "left")[starts]
        entry[starts] = True
        entry[behind[behind < n]] = True
        rows = pa.array(np.flatnonzero(entry))
        found = table.select(at).take(rows).append_column("_in", pa.array(t[entry]))
        return found.append_column("_out", pa.array(t[last[entry]]))

    def follow(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t = table.column("_in").to_numpy()
        after = _next_at(t, starts, table.column("_out").to_numpy() + dt, side).tolist()
        met = []
        for begin in starts.tolist():
            here = begin
            while here < len(after):
                met.append(here)
                here = after[here]
        return table.select([*at, "_in"]).take(pa.array(met, pa.int64()))

    def keep(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t = table.column("_t").to_numpy()
        after = _next_at(t, starts, t + dt, side).tolist()
        first = _next_at(t, starts, table.column("_in").to_numpy(), "left")[starts]
        entered = np.where(t[starts] >= table.column("_in").to_numpy()[starts], starts, first)
        met = []
        for here in entered.tolist():
            while here < len(after):
                met.append(here)
                here = after[here]
        return table.select(columns).take(pa.array(met, pa.int64()))

    fields = [blocked.schema[c] for c in at]
    ways = map_table_runs(
        blocked.select(*at, "_t"), at, ["_t"], through,
        T.StructType([*fields, T.StructField("_in", T.DoubleType()), T.StructField("_out", T.DoubleType())]),
    )
    entries = map_table_runs(ways, keys, ["_in"], follow, T.StructType([*fields, T.StructField("_in", T.DoubleType())]))
    ties = [c.name for c in df.schema.fields if isinstance(c.dataType, T.AtomicType) and c.name not in keys]
    return map_table_runs(blocked.join(entries, at), at, ["_t", *ties], keep, df.schema)


def _matrices(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and translations of pose rows x, y, z, roll, pitch, yaw."""
    cr, cp, cy = np.cos(rows[:, 3]), np.cos(rows[:, 4]), np.cos(rows[:, 5])
    sr, sp, sy = np.sin(rows[:, 3]), np.sin(rows[:, 4]), np.sin(rows[:, 5])
    r = np.empty((len(rows), 3, 3))
    r[:, 0] = np.stack([cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], axis=1)
    r[:, 1] = np.stack([sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], axis=1)
    r[:, 2] = np.stack([-sp, cp * sr, cp * cr], axis=1)
    return r, rows[:, :3]


def moved_enough(rows: np.ndarray, last: np.ndarray, distance: float, angle: float) -> np.ndarray:
    """Which poses differ from ``last``, one for all or one each, by a rotation angle or by the distance."""
    r, t = _matrices(rows)
    r0, t0 = _matrices(np.atleast_2d(last))
    rel = r0.transpose(0, 2, 1) @ r
    roll = np.arctan2(rel[:, 2, 1], rel[:, 2, 2])
    pitch = np.arcsin(np.clip(-rel[:, 2, 0], -1, 1))
    yaw = np.arctan2(rel[:, 1, 0], rel[:, 0, 0])
    turned = np.maximum(np.maximum(np.abs(roll), np.abs(pitch)), np.abs(yaw)) >= angle
    return turned | (np.linalg.norm(t - t0, axis=1) >= distance)


def keyframe_fold(distance: float, angle: float) -> Fold:
    """Keeps the first pose and then each one that moved enough from the last kept one."""

    def run(t: np.ndarray, rows: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        keep = np.zeros((len(rows), 1))
        i, last = 0, state
        if last is None:
            keep[0], last, i = 1.0, rows[0], 1
        span = 16
        while i < len(rows):
            hit = np.flatnonzero(moved_enough(rows[i : i + span], last, distance, angle))
            if len(hit):
                i += int(hit[0])
                keep[i], last = 1.0, rows[i]
                i, span = i + 1, 16
            else:
                i, span = i + span, min(span * 2, 4096)
        return keep, last

    def many(t: np.ndarray, rows: np.ndarray, starts: np.ndarray, states: list[np.ndarray | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The j-th rows of all runs at once."""
        keep = np.zeros((len(rows), 1))
        sizes = np.diff(starts, append=len(rows))
        last = np.array([np.full(6, np.nan) if s is None else s for s in states]).reshape(-1, 6)
        known = np.array([s is not None for s in states], bool)
        for j in range(int(sizes.max(initial=0))):
            runs = np.flatnonzero(sizes > j)
            here = rows[starts[runs] + j]
            taken = ~known[runs]
            taken[~taken] = moved_enough(here[~taken], last[runs[~taken]], distance, angle)
            keep[starts[runs] + j, 0] = taken
            last[runs[taken]], known[runs] = here[taken], True
        return keep, list(last)

    return Fold(FIELDS, ["kept boolean"], run, many, forgets=True)


def select_keyframes(
    df: DataFrame, keys: Sequence[str], distance: float = 1.0, angle: float = 0.2, ts: str = "ts", width: float = HOUR
) -> DataFrame:
    """Poses that moved by ``distance`` or turned by ``angle`` since the last kept one, and the first."""
    return chained_fold(df, keys, ts, width, keyframe_fold(distance, angle)).where("kept").drop("kept")
