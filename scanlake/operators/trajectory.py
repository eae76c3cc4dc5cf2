"""Trajectory operators on odometry samples: steps, segments, rates, forecasts, resampling.

A sample has the keys (usually ``vehicle_id`` and ``source``), ``ts`` and the six pose columns.
Ordered steps go through the block-wise timeline helpers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.functions.angles import wrap_angle
from scanlake.functions.geometry import dist3, norm3
from scanlake.functions.matrices import rotation_exps, rpy_matrices
from scanlake.functions.poses import FIELDS, between, compose, from_columns, inverse
from scanlake.operators.runs import map_table_runs
from scanlake.operators.timeline import (
    HOUR, asof_join, block_of, last_known, number_rows, running_sum, seconds, with_previous,
)
from scanlake.session import cut

XYZ = ("x", "y", "z")
STEP = tuple("d" + f for f in FIELDS)


def _pose(prefix: str = ""):
    return from_columns(*[F.col(prefix + f) for f in FIELDS])


def relative_pose(df: DataFrame, keys: Sequence[str], ts: str = "ts", width: float = HOUR) -> DataFrame:
    """Step ``dx..dyaw`` from the preceding sample, in its frame, and ``dt`` in seconds; null first."""
    prev = with_previous(df, keys, ts, [ts, *FIELDS], width=width)
    step = between(_pose("prev_"), _pose()).fields()
    return prev.withColumns(
        {**{f"d{f}": v for f, v in step.items()}, "dt": seconds(ts) - seconds(f"prev_{ts}")}
    ).drop(*[f"prev_{c}" for c in (ts, *FIELDS)])


def pair_dt(df: DataFrame, max_dt: float, dt: str = "dt", tiny: float = 1e-6) -> DataFrame:
    """Steps made null when their time difference is tiny, negative or above ``max_dt``."""
    usable = (F.col(dt) > tiny) & (F.col(dt) <= float(max_dt))
    return df.withColumns({c: F.when(usable, F.col(c)) for c in (*STEP, dt) if c in df.columns})


def rates(df: DataFrame, dt: str = "dt") -> DataFrame:
    """Step over time as ``v..`` and ``w..`` columns, with the linear speed."""
    names = dict(zip(STEP, ("vx", "vy", "vz", "wroll", "wpitch", "wyaw")))
    safe = F.when(F.col(dt) > 0, F.col(dt))
    out = df.withColumns({n: F.col(c) / safe for c, n in names.items()})
    return out.withColumn("speed", norm3(F.col("vx"), F.col("vy"), F.col("vz")))


def jump_gate(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", linear: float = 5.0, angular: float = 0.04,
    width: float = HOUR,
) -> DataFrame:
    """Flag ``ok``: squared pose difference over squared time below both limits; true on the first row."""
    prev = with_previous(df, keys, ts, [ts, *FIELDS], width=width)
    dt = seconds(ts) - seconds(f"prev_{ts}")

    def gap(names: Sequence[str]) -> Column:
        return sum(
            ((F.col(n) - F.col(f"prev_{n}")) * (F.col(n) - F.col(f"prev_{n}")) for n in names), F.lit(0.0)
        ) / F.when(dt != 0, dt * dt)

    ok = ~((gap(XYZ) >= linear) | (gap(FIELDS[3:]) >= angular))
    return prev.withColumn("ok", F.coalesce(ok, F.lit(True))).drop(*[f"prev_{c}" for c in (ts, *FIELDS)])


def segments(df: DataFrame, keys: Sequence[str], max_dt: float, ts: str = "ts", width: float = HOUR) -> DataFrame:
    """Number ``segment`` that grows after each gap above ``max_dt``; repeated stamps dropped."""
    prev = with_previous(df, keys, ts, [ts], width=width)
    dt = seconds(ts) - seconds(f"prev_{ts}")
    fresh = prev.where(dt.isNull() | (dt > 0)).withColumn("_new", F.when(dt > float(max_dt), 1).otherwise(0))
    return running_sum(fresh.drop(f"prev_{ts}"), keys, ts, "_new", "segment", width).drop("_new")


def propagate_translation(
    steps: DataFrame, keys: Sequence[str], ts: str = "ts", width: float = HOUR
) -> DataFrame:
    """Constant-velocity guess ``gx, gy, gz``: the last step scaled to this time difference."""
    prev = with_previous(steps, keys, ts, ["dx", "dy", "dz", "dt"], width=width)
    ratio = F.col("dt") / F.when(F.col("prev_dt") != 0, F.col("prev_dt"))
    return prev.withColumns({f"g{c}": F.col(f"prev_d{c}") * ratio for c in XYZ}).drop(
        "prev_dx", "prev_dy", "prev_dz", "prev_dt"
    )


def _prefix_products(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running products of rows of 3x4 transforms, for all runs together: row i of each run, then row i + 1."""
    sizes = np.diff(starts, append=len(steps))
    out = np.array(steps, float).reshape(-1, 3, 4)
    longest = np.argsort(-sizes, kind="stable")
    left = np.searchsorted(-sizes[longest], -np.arange(1, sizes.max(initial=0) + 1), "right")
    for i in range(1, len(left)):
        now = starts[longest[: left[i]]] + i
        before, step = out[now - 1], out[now]
        moved = before[:, :, :3] @ step
        moved[:, :, 3] += before[:, :, 3]
        out[now] = moved
    return out.reshape(-1, 12)


def _products_of(table: pa.Table, starts: np.ndarray) -> pa.Table:
    """The rows with ``_path``, the running products of ``_step``."""
    steps = table.column("_step").combine_chunks().flatten().to_numpy().reshape(-1, 12)
    path = pa.FixedSizeListArray.from_arrays(pa.array(_prefix_products(steps, starts).ravel()), 12)
    return table.drop_columns(["_step"]).append_column("_path", path.cast(pa.list_(pa.float64())))


def accumulate(
    steps: DataFrame, keys: Sequence[str], row_id: str, ts: str = "ts", width: float = HOUR
) -> DataFrame:
    """Path from steps: the running product of ``dx..dyaw`` per key, the first row as identity.

    Poses multiply associatively, so each block multiplies its own steps, the block totals are
    multiplied over the blocks of a key, and every block is moved by the total before it.
    """
    keys = list(keys)
    step = from_columns(*[F.coalesce(F.col(c), F.lit(0.0)) for c in STEP])
    flat = F.array(*[c for row, t in zip(step.rotation, step.translation) for c in (*row, t)])
    rows = steps.select(*keys, row_id, block_of(ts, width).alias("_block"), seconds(ts).alias("_o"), flat.alias("_step"))
    path = T.StructField("_path", T.ArrayType(T.DoubleType()))

    def running(df: DataFrame, run: list[str]) -> DataFrame:
        return map_table_runs(df, run, ["_o"], _products_of, T.StructType([*(f for f in df.schema if f.name != "_step"), path]))

    inside = cut(running(rows, [*keys, "_block"]))
    totals = inside.groupBy(*keys, "_block").agg(F.max_by("_path", "_o").alias("_step"))
    over = running(totals.withColumn("_o", F.col("_block").cast("double")), keys)
    before = over.select(
        *keys, "_block", F.lag("_path").over(Window.partitionBy(*keys).orderBy("_block")).alias("_base")
    )
    joined = inside.join(before, [*keys, "_block"])
    identity = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]
    base = F.coalesce(F.col("_base"), F.array(*[F.lit(float(v)) for v in identity]))
    joined = joined.withColumn("_base", base)

    def at(name: str, i: int, j: int) -> Column:
        return F.get(name, 4 * i + j)

    from scanlake.functions.poses import Pose

    def as_pose(name: str) -> Pose:
        return Pose([[at(name, i, j) for j in range(3)] for i in range(3)], [at(name, i, 3) for i in range(3)])

    return joined.select(*keys, row_id, *compose(as_pose("_base"), as_pose("_path")).columns())


def until_distance(
    df: DataFrame, keys: Sequence[str], order: str, distance: float
) -> DataFrame:
    """Rows up to the one where the running path length first reaches ``distance``, it included.

    ``keys`` identify one forecast, whose step count is bounded by its horizon.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    step = dist3([F.col(c) for c in XYZ], [F.lag(c).over(w) for c in XYZ])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
        .withColumn("_before", F.coalesce(F.sum("_step").over(before), F.lit(0.0)))
        .where(F.col("_before") < float(distance))
        .drop("_step", "_before")
    )


def recent_path(df: DataFrame, keys: Sequence[str], window_s: float, row_id: str, ts: str = "ts") -> DataFrame:
    """For each sample the ids of the samples of the last ``window_s`` seconds, oldest first.

    Buckets as wide as the window make it an equi-join over two buckets.
    """
    bucket = F.floor(seconds(ts) / F.lit(float(window_s)))
    now = df.select(*keys, row_id, seconds(ts).alias("_now"), F.explode(F.array(bucket - 1, bucket)).alias("_b"))
    past = df.select(*keys, bucket.alias("_b"), seconds(ts).alias("_then"), F.col(row_id).alias("_id"))
    age = F.col("_now") - F.col("_then")
    pairs = now.join(past, [*keys, "_b"]).where(age.between(0.0, float(window_s)))
    path = F.array_sort(F.collect_list(F.struct("_then", "_id")))
    return pairs.groupBy(*keys, row_id).agg(F.transform(path, lambda s: s["_id"]).alias("path"))


def last_n(df: DataFrame, keys: Sequence[str], n: int = 10000, ts: str = "ts", width: float = HOUR) -> DataFrame:
    """The newest ``n`` samples per key."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    numbered = number_rows(df, keys, ts, "_row", width).join(size, list(keys))
    return numbered.where(F.col("_row") >= F.col("_size") - n).drop("_row", "_size")


def merge_feeds(front: DataFrame, back: DataFrame) -> DataFrame:
    """Both feeds in one table with ``source`` and ``feed_rank``: order by (ts, feed_rank)."""
    return front.withColumns({"source": F.lit("front"), "feed_rank": F.lit(0)}).unionByName(
        back.withColumns({"source": F.lit("back"), "feed_rank": F.lit(1)}), allowMissingColumns=True
    )


def reverse_path(df: DataFrame, keys: Sequence[str], row_id: str, ts: str = "ts", width: float = HOUR) -> DataFrame:
    """Samples with ``path_idx`` from 0 at the newest."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    numbered = number_rows(df, keys, ts, "_row", width).join(size, list(keys))
    return numbered.withColumn("path_idx", F.col("_size") - 1 - F.col("_row")).drop("_row", "_size")


def monotonic(
    df: DataFrame, keys: Sequence[str], arrival: str, stamp: str, width: float, slack: float = 0.0
) -> DataFrame:
    """Samples later than everything of their key that arrived before them, in arrival order.

    ``arrival`` and ``stamp`` are numeric columns; ``width`` is the block size on ``arrival``.
    """
    blocked = df.withColumn("_block", F.floor(F.col(arrival) / F.lit(float(width))))
    tops = blocked.groupBy(*keys, "_block").agg(F.max(stamp).alias("_top"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = tops.select(*keys, "_block", F.max("_top").over(over).alias("_head"))
    inside = Window.partitionBy(*keys, "_block").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.greatest(F.col("_in"), F.col("_head"))
    return (
        blocked.withColumn("_in", F.max(stamp).over(inside))
        .join(heads, [*keys, "_block"])
        .where(latest.isNull() | (F.col(stamp) > latest + slack))
        .drop("_block", "_in", "_head")
    )


def sync_back(
    front: DataFrame, back: DataFrame, keys: Sequence[str], max_age: float = 0.9, noise_scale: float = 1.5,
    age_scale: float = 1.0, ts: str = "ts", width: float = HOUR,
) -> DataFrame:
    """Back-feed rates turned into increments over the front's time step.

    ``front`` has ``dt``; ``back`` has its step rates. Latest back sample at or before the front
    one, at most ``max_age`` old; ``s..`` are the increments, ``noise`` their noise factor.
    """
    names = ("vx", "vy", "vz", "wroll", "wpitch", "wyaw")
    right = back.where(F.col("vx").isNotNull()).select(*keys, ts, *names)
    joined = asof_join(front, right, keys, max_age, ts, prefix="b_", width=width)
    age = seconds(ts) - seconds(f"b_{ts}")
    out = {f"s{n}": F.col(f"b_{n}") * F.col("dt") for n in names[:3]}
    out |= {f"s{n}": wrap_angle(F.col(f"b_{n}") * F.col("dt")) for n in names[3:]}
    scale = noise_scale * F.greatest(1 + age_scale * age, F.lit(1.0))
    return (
        joined.withColumns({**out, "age": age, "noise": scale})
        .where(F.col("age").isNotNull())
        .drop(f"b_{ts}", *[f"b_{n}" for n in names])
    )


def forecast(df: DataFrame, dt: float, n: int, acceleration: bool = False) -> DataFrame:
    """Positions ``k * dt`` ahead for k = 1..n from ``x, y, z``, ``vx, vy, vz`` and, when asked
    for, ``ax, ay, az``."""
    ahead = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(int(n)))))
    t = F.col("k") * float(dt)
    out = {}
    for c in XYZ:
        out[f"f{c}"] = F.col(c) + t * F.col(f"v{c}")
        if acceleration:
            out[f"f{c}"] = out[f"f{c}"] + 0.5 * t * t * F.col(f"a{c}")
    return ahead.withColumns(out)


def forecast_distance(
    df: DataFrame, keys: Sequence[str], distance: float = 8.0, step: float = 0.1, max_s: float = 50.0,
    extra_s: float = 0.0,
) -> DataFrame:
    """Time ahead at which a constant-rate forecast is ``distance`` away, at least ``extra_s``.

    At constant rate the distance after k steps is k * step * speed, so the first k is a division
    and no step has to be simulated; the horizon ends at ``max_s``.
    """
    speed = norm3(F.col("vx"), F.col("vy"), F.col("vz"))
    steps = F.ceil(distance / F.when(speed > 0, speed) / step - 1e-9)
    horizon = F.least(F.coalesce(steps * step, F.lit(float(max_s))), F.lit(float(max_s)))
    horizon = F.greatest(horizon, F.lit(float(extra_s)))
    out = {f"f{c}": F.col(c) + F.col("horizon") * F.col(f"v{c}") for c in XYZ}
    return df.withColumn("horizon", horizon).withColumns(out)


def forecast_local(df: DataFrame, ahead: Column) -> DataFrame:
    """Full pose ``f_x..f_yaw`` after ``ahead`` seconds at the constant rates ``vx..vz, wroll..wyaw`` of the own frame.

    The step is what the rates make of the time, angles wrapped, taken in the frame of the pose.
    """
    t = F.greatest(ahead, F.lit(0.0))
    move = [t * F.col(f"v{c}") for c in XYZ]
    turn = [wrap_angle(t * F.col(f"w{f}")) for f in FIELDS[3:]]
    found = compose(_pose(), from_columns(*move, *turn)).fields()
    return df.withColumns({f"f_{f}": v for f, v in found.items()})


def forecast_path(df: DataFrame, dt: float, n: int, distance: float | None = None) -> DataFrame:
    """The pose after each of up to ``n`` steps of ``dt`` at constant acceleration, a row per step ``k`` from 1.

    Rows have ``x..yaw``, world velocity ``vx, vy, vz`` and acceleration ``ax, ay, az``, body turn rate ``wx, wy, wz`` and its
    growth ``bx, by, bz``. In each step the attitude is turned on its right by the exponential of the step's mean rate.
    Gives ``fx..fyaw`` and ``gone``, the length of the way so far. With ``distance`` the path ends with the step that
    reaches it, or where a step doesn't move.
    """
    names = ["k", "fx", "fy", "fz", "froll", "fpitch", "fyaw", "gone"]
    schema = T.StructType([*df.schema.fields, T.StructField("k", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in names[1:])])
    reach = np.inf if distance is None else float(distance)

    def paths(batch: pa.RecordBatch) -> pa.RecordBatch:
        def columns(*wanted: str) -> np.ndarray:
            return np.column_stack([batch.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy() for c in wanted])

        place, v, a = columns("x", "y", "z"), columns("vx", "vy", "vz"), columns("ax", "ay", "az")
        turn, growth = columns("wx", "wy", "wz"), columns("bx", "by", "bz")
        rotation = rpy_matrices(columns("roll", "pitch", "yaw"))
        here, gone, going = place.copy(), np.zeros(len(place)), np.arange(len(place))
        found: list[tuple] = []
        for k in range(1, int(n) + 1):
            t = k * float(dt)
            new = place[going] + t * v[going] + 0.5 * t * t * a[going]
            moved = np.sqrt(((new - here[going]) ** 2).sum(axis=1))
            if distance is not None:
                on = (gone[going] < reach) & (moved >= 1e-12)
                going, new, moved = going[on], new[on], moved[on]
            if not len(going):
                break
            rotation[going] = rotation[going] @ rotation_exps((turn[going] + (k - 0.5) * float(dt) * growth[going]) * float(dt))
            here[going], gone[going] = new, gone[going] + moved
            r = rotation[going]
            angles = [np.arctan2(r[:, 2, 1], r[:, 2, 2]), np.arcsin(np.clip(-r[:, 2, 0], -1, 1)), np.arctan2(r[:, 1, 0], r[:, 0, 0])]
            found.append((going, np.full(len(going), k), *new.T, *angles, gone[going]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 9
        order = np.lexsort((cols[1], cols[0]))
        rows = batch.take(pa.array(cols[0][order].astype(np.int64)))
        added = [pa.array(cols[1][order], pa.int32()), *(pa.array(c[order].astype(float)) for c in cols[2:])]
        return pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*rows.schema.names, *names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, 200_000 // max(1, int(n)))
        for batch in batches:
            for at in range(0, batch.num_rows, some):
                yield paths(batch.slice(at, some))

    return df.mapInArrow(scan, schema)


def to_local(df: DataFrame, future: str = "f_") -> DataFrame:
    """The pose with prefix ``future`` seen from the row's own pose, as ``l..`` columns."""
    local = between(_pose(), _pose(future)).fields()
    return df.withColumns({f"l{f}": v for f, v in local.items()})


def resample(
    df: DataFrame, keys: Sequence[str], period: float, ts: str = "ts", width: float = HOUR
) -> DataFrame:
    """Latest state carried forward to every tick of ``period`` seconds between the key's first
    and last sample. ``df`` has ``x, y, z`` and ``vx, vy, vz``; ticks are multiples of the period.

    Each sample fills the ticks up to the next one, so the grid is made from samples, not per key.
    """
    def tick(t: Column) -> Column:
        return F.ceil(t / F.lit(float(period)))

    flipped = df.withColumn("_rev", F.timestamp_seconds(-seconds(ts)))
    ahead = with_previous(flipped, keys, "_rev", [ts], "next_", width).drop("_rev")
    first, last = tick(seconds(ts)), tick(seconds(f"next_{ts}")) - 1
    own = F.when(F.col(f"next_{ts}").isNull(), F.floor(seconds(ts) / F.lit(float(period)))).otherwise(last)
    ticks = (
        ahead.withColumns({"_a": first, "_b": own})
        .where(F.col("_a") <= F.col("_b"))
        .withColumn("tick", F.explode(F.sequence("_a", "_b")))
    )
    dt = F.col("tick") * float(period) - seconds(ts)
    return (
        ticks.withColumn("dt_tick", dt)
        .withColumns({f"r{c}": F.col(c) + F.col("dt_tick") * F.col(f"v{c}") for c in XYZ})
        .drop("_a", "_b", f"next_{ts}")
    )


def loops_from_times(
    pairs: DataFrame, keyframes: DataFrame, keys: Sequence[str], min_gap: float = 30.0, width: float = HOUR
) -> DataFrame:
    """Keyframe pair of each time pair (``t_cur``, ``t_pre``): the earliest keyframe at or after
    ``t_cur`` (else the last one), the latest at or before ``t_pre`` (else the first one)."""
    kf = keyframes.select(*keys, "kf_id", "ts")
    ends = kf.groupBy(*keys).agg(F.max("kf_id").alias("_last"))
    near = pairs.where(F.abs(seconds("t_cur") - seconds("t_pre")) >= float(min_gap))
    forward = asof_join(near.withColumn("ts", F.col("t_cur")), kf, keys, None, "ts", "forward", "a_", width)
    both = asof_join(
        forward.drop("ts", "a_ts").withColumn("ts", F.col("t_pre")), kf, keys, None, "ts", "backward", "b_", width
    )
    return (
        both.join(ends, list(keys))
        .withColumns(
            {
                "key_cur": F.coalesce("a_kf_id", "_last"),
                "key_pre": F.coalesce("b_kf_id", F.lit(0)).cast("bigint"),
            }
        )
        .where(F.col("key_cur") != F.col("key_pre"))
        .drop("ts", "a_kf_id", "b_kf_id", "b_ts", "_last")
    )


def correct_drift(
    odometry: DataFrame, mapped: DataFrame, keys: Sequence[str], ts: str = "ts", width: float = HOUR
) -> DataFrame:
    """Odometry moved onto the map: ``mapped * inverse(front) * latest``.

    ``mapped`` is the newest map pose before the sample; ``front`` is the first odometry sample
    after that map pose. Samples before any map pose are dropped.
    """
    fields = list(FIELDS)
    plain = odometry.select(*keys, ts, *fields)
    just_after = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + 1)
    anchors = asof_join(
        mapped.select(*keys, just_after.alias(ts), *fields), plain, keys, None, ts, "forward", "f_", width
    ).where(F.col(f"f_{ts}").isNotNull())
    joined = asof_join(odometry, anchors, keys, None, ts, "backward", "m_", width)
    joined = joined.where(F.col(f"m_{ts}").isNotNull())
    front = from_columns(*[F.col(f"m_f_{f}") for f in fields])
    moved = compose(_pose("m_"), compose(inverse(front), _pose())).fields()
    extra = [c for c in joined.columns if c.startswith("m_")]
    return joined.withColumns({f"c{f}": v for f, v in moved.items()}).drop(*extra)


def valid_priors(
    priors: DataFrame, current: DataFrame, keys: Sequence[str], max_age: float, max_range: float
) -> DataFrame:
    """Priors whose age and distance to the vehicle's current pose are within the limits."""
    now = current.select(*keys, F.col("ts").alias("_now"), *[F.col(c).alias(f"_{c}") for c in XYZ])
    age = F.abs(seconds("_now") - seconds("ts"))
    d = dist3([F.col(c) for c in XYZ], [F.col(f"_{c}") for c in XYZ])
    return (
        priors.join(now, list(keys))
        .where((age <= float(max_age)) & (d <= float(max_range)))
        .drop("_now", "_x", "_y", "_z")
    )


__all__ = [
    "accumulate", "asof_join", "correct_drift", "forecast", "forecast_distance", "jump_gate", "last_known",
    "last_n", "loops_from_times", "merge_feeds", "monotonic", "pair_dt", "propagate_translation", "rates",
    "recent_path", "relative_pose", "resample", "reverse_path", "segments", "sync_back", "to_local",
    "until_distance", "valid_priors",
]
