"""Structured Streaming on pose feeds: late samples, stale samples, folds with keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanlake.operators.folds import Fold
from scanlake.operators.fusion import SmoothOptions, smooth_fold
from scanlake.operators.selection import keyframe_fold
from scanlake.operators.timeline import seconds

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


BUCKETS = 256
"""Groups that a feed's keys are dealt to. It is part of a feed's checkpoint."""


def _folding(fold: Fold, fields: list[str], order: list[str], expire: float):
    """Keeps the fold's states of all keys of a bucket, and when the first of them has been silent for long enough to go.

    A call costs far more than the few rows of a key in a trigger, so the keys of a bucket share one.
    """
    silent = int(expire * 1000)

    def run(bucket: tuple, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known = {k: (s, int(t)) for k, s, t in zip(*held.get)} if held.exists else {}
        watermark = held.getCurrentWatermarkMs()
        seen: dict[str, tuple[bytes, int]] = {}
        parts = [] if held.hasTimedOut else [part for part in rows if len(part)]
        if parts:
            some = pd.concat(parts, ignore_index=True)
            some.columns = [*fields, "_t", "_key", "_bucket"]
            codes, keys = pd.factorize(some["_key"])
            at = np.lexsort([*(some[c].to_numpy(float) for c in reversed([*order, *fold.inputs])), codes])
            some = some.take(at)
            t, values = some["_t"].to_numpy(float), some[list(fold.inputs)].to_numpy(float)
            starts = np.flatnonzero(np.diff(codes[at], prepend=-1))
            before = [np.frombuffer(known[k][0]) if k in known else None for k in keys]
            if fold.many and len(starts) ** 2 > len(t):
                out, after = fold.many(t, values, starts, before)
            else:
                ends = np.append(starts[1:], len(t))
                done = [fold.run(t[a:b], values[a:b], state) for a, b, state in zip(starts, ends, before)]
                out, after = np.concatenate([d[0] for d in done]), [d[1] for d in done]
            latest = np.maximum.reduceat(t, starts)
            for key, state, last in zip(keys, after, latest.tolist()):
                seen[key] = np.asarray(state, float).tobytes(), max(int(last * 1000), known[key][1] if key in known else 0)
            yield some[fields].assign(**dict(zip(fold.names, fold.columns(out))))
        kept = seen | {k: v for k, v in known.items() if k not in seen and v[1] + silent >= watermark}
        if kept:
            held.update((list(kept), [s for s, _ in kept.values()], [t for _, t in kept.values()]))
            held.setTimeoutTimestamp(max(min(t for _, t in kept.values()) + silent, watermark + 1))
        else:
            held.remove()

    return run


def stream_fold(
    df: DataFrame, keys: Sequence[str], ts: str, fold: Fold, lateness: str, expire: float, order: Sequence[str] = ()
) -> DataFrame:
    """A fold over a live feed, keyed by ``keys``.

    ``fold`` is the one that the batch operators use, so both give the same rows: within a trigger the key's rows
    are put in time order (or by ``order``) and the state that the fold leaves is kept for the next. Samples that come
    later than ``lateness`` behind the newest one of the feed are dropped by the watermark, for what followed them has
    been decided. A key's state goes when the watermark passes ``expire`` seconds after its last sample; should the key come
    back, it starts anew. Keys are dealt to ``BUCKETS`` groups, each with one row of state for its keys.
    """
    types = T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(fold.outputs)).fields])
    function = _folding(fold, df.columns, list(order or ["_t"]), expire)
    dealt = df.withWatermark(ts, lateness).withColumns({"_t": seconds(ts), "_key": F.to_json(F.struct(*keys))})
    return (
        dealt.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS))).groupBy("_bucket")
        .applyInPandasWithState(
            function, types, "keys array<string>, states array<binary>, latest array<long>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def _latest_fold(stamp: str, slack: float) -> Fold:
    def run(t: np.ndarray, values: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        start = -np.inf if state is None else state[0]
        before = np.maximum.accumulate(np.concatenate([[start], values[:, 0]]))
        return (values > before[:-1, None] + slack).astype(float), before[-1:]

    return Fold([stamp], ["kept boolean"], run)


def _interval_fold(dt: float) -> Fold:
    def run(t: np.ndarray, values: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        keep, last = np.zeros((len(t), 1)), -np.inf if state is None else float(state[0])
        at = int(np.searchsorted(t, last + dt))
        while at < len(t):
            keep[at], last = 1.0, float(t[at])
            at = max(at + 1, int(np.searchsorted(t, last + dt)))
        return keep, np.array([last])

    return Fold([], ["kept boolean"], run)


HOUR, DAY = "1 hour", 86400.0


def monotonic(
    df: DataFrame, keys: Sequence[str], arrival: str, stamp: str, ts: str = "ts", slack: float = 0.0,
    lateness: str = HOUR, expire: float = DAY,
) -> DataFrame:
    """Samples of a live feed that are later than all earlier arrivals of their key."""
    out = stream_fold(df, keys, ts, _latest_fold(stamp, slack), lateness, expire, [arrival])
    return out.where("kept").drop("kept")


def sample_interval(
    df: DataFrame, keys: Sequence[str], dt: float, ts: str = "ts", lateness: str = HOUR, expire: float = DAY
) -> DataFrame:
    """Minimum-interval sampling of a live feed. ``expire`` is at least ``dt``, or rows would be kept too soon."""
    return stream_fold(df, keys, ts, _interval_fold(dt), lateness, max(expire, dt)).where("kept").drop("kept")


def select_keyframes(
    df: DataFrame, keys: Sequence[str], distance: float = 1.0, angle: float = 0.2, ts: str = "ts", lateness: str = HOUR,
    expire: float = DAY,
) -> DataFrame:
    """Keyframe selection on a live feed."""
    return stream_fold(df, keys, ts, keyframe_fold(distance, angle), lateness, expire).where("kept").drop("kept")


def smooth(
    df: DataFrame, keys: Sequence[str], options: SmoothOptions = SmoothOptions(), ts: str = "ts", lateness: str = HOUR
) -> DataFrame:
    """Pose smoothing of a live feed. A key's state goes after a gap that would make the filter start anew."""
    return stream_fold(df, keys, ts, smooth_fold(options), lateness, options.max_dt).where("used").drop("used")


def drop_stale(
    scans: DataFrame, poses: DataFrame, keys: Sequence[str], tolerance: float, lateness: str = "1 minute",
    ts: str = "ts",
) -> DataFrame:
    """Odometry samples that lie within ``tolerance`` seconds of a scan, with the scan.

    On streams this is an interval join under watermarks, whose state is dropped once neither
    side can match any more; on tables it is an ordinary join. ``scans`` has ``scan_id``.
    """
    left, right = scans, poses
    if scans.isStreaming:
        left, right = scans.withWatermark(ts, lateness), poses.withWatermark(ts, lateness)
    a = left.select(*[F.col(k).alias(f"_l_{k}") for k in keys], "scan_id", F.col(ts).alias("scan_ts"))
    on = (F.col("scan_ts") >= F.col(ts) - F.expr(f"INTERVAL {tolerance:.6f} SECONDS")) & (
        F.col("scan_ts") <= F.col(ts) + F.expr(f"INTERVAL {tolerance:.6f} SECONDS")
    )
    for k in keys:
        on = on & (F.col(f"_l_{k}") == F.col(k))
    return a.join(right, on).drop(*[f"_l_{k}" for k in keys])


def run_available(df: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Processes everything a stream has now into Parquet and stops; the progress of its triggers.

    State is kept in the RocksDB store, which is set while the query is started.
    """
    spark: SparkSession = df.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        query = (
            df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()
    return list(query.recentProgress)
