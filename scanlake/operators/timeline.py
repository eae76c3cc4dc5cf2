"""Ordered operations on long timelines without one task per vehicle.

A window over a vehicle's whole history puts that history into one task. The helpers here split
each timeline into blocks of ``width`` seconds, keep one summary row per block (built with
map-side partial aggregates), run the per-vehicle window over the summaries only, and hand each
block what it needs from the rows before it. The detail rows are then windowed per (keys, block),
so a task never holds more than a block of one vehicle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600.0


def seconds(ts: str | Column) -> Column:
    """Time stamp as seconds since the epoch."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def block_of(ts: str, width: float) -> Column:
    return F.floor(seconds(ts) / F.lit(float(width)))


def _carry(totals: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exclusive running sum of ``value`` over the blocks of a key."""
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_carry", F.coalesce(F.sum(value).over(w), F.lit(0)))


def number_rows(
    df: DataFrame, keys: Sequence[str], ts: str, name: str, width: float = HOUR
) -> DataFrame:
    """Dense row number from 0 in time order, per key."""
    blocked = df.withColumn("_block", block_of(ts, width))
    totals = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    carry = _carry(totals, keys, "_n").drop("_n")
    w = Window.partitionBy(*keys, "_block").orderBy(ts)
    return (
        blocked.withColumn("_in_block", F.row_number().over(w))
        .join(carry, [*keys, "_block"])
        .withColumn(name, (F.col("_carry") + F.col("_in_block") - 1).cast("bigint"))
        .drop("_block", "_in_block", "_carry")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str, width: float = HOUR
) -> DataFrame:
    """Inclusive running sum of ``value`` in time order, per key."""
    blocked = df.withColumn("_block", block_of(ts, width))
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_n"))
    carry = _carry(totals, keys, "_n").drop("_n")
    w = Window.partitionBy(*keys, "_block").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)))
        .join(carry, [*keys, "_block"])
        .withColumn(name, F.col("_carry") + F.col("_in"))
        .drop("_block", "_in", "_carry")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    prefix: str = "prev_",
    width: float = HOUR,
) -> DataFrame:
    """The ``columns`` of the preceding row in time, per key; null on the first row.

    Rows of one time are ordered by ``columns``, so a row's values are always those of one row.
    """
    blocked = df.withColumn("_block", block_of(ts, width))
    in_block = Window.partitionBy(*keys, "_block").orderBy(ts, *columns)
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    tails = blocked.groupBy(*keys, "_block").agg(
        F.max(F.struct(F.col(ts).alias("_at"), *[F.col(c).alias(f"_{c}") for c in columns])).alias("_last")
    )
    heads = tails.select(*keys, "_block", F.lag("_last").over(over_blocks).alias("_head")).select(
        *keys, "_block", *[F.col(f"_head._{c}").alias(f"_head_{c}") for c in columns]
    )
    first = F.col("_row") == 1
    return (
        blocked.select(
            "*",
            F.row_number().over(in_block).alias("_row"),
            *[F.lag(c).over(in_block).alias(f"_lag_{c}") for c in columns],
        )
        .join(heads, [*keys, "_block"])
        .select(
            *df.columns,
            *[
                F.when(first, F.col(f"_head_{c}")).otherwise(F.col(f"_lag_{c}")).alias(prefix + c)
                for c in columns
            ],
        )
    )


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    wanted: Column,
    columns: Sequence[str],
    order: Sequence[Column] | None = None,
    prefix: str = "last_",
    width: float = HOUR,
    include_current: bool = True,
) -> DataFrame:
    """For each row the ``columns`` of the latest row where ``wanted`` holds, up to this row.

    Rows of one time stamp are taken in ``order`` (default: the stamp alone).
    """
    order = list(order or [F.col(ts)])
    names = [f"_v_{c}" for c in columns]
    blocked = df.withColumn("_block", block_of(ts, width)).select(
        "*",
        F.when(wanted, F.lit(True)).alias("_w"),
        *[F.when(wanted, F.struct(F.col(c))).alias(n) for c, n in zip(columns, names)],
    )
    tails = blocked.groupBy(*keys, "_block").agg(
        *[F.max_by(n, F.when(F.col("_w"), F.struct(*order))).alias(n) for n in names]
    )
    over_blocks = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = tails.select(
        *keys,
        "_block",
        *[F.last(n, ignorenulls=True).over(over_blocks).alias(f"_head{n}") for n in names],
    )
    in_block = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    return (
        blocked.select(
            *df.columns,
            "_block",
            *[F.last(n, ignorenulls=True).over(in_block).alias(f"_in{n}") for n in names],
        )
        .join(heads, [*keys, "_block"])
        .select(
            *df.columns,
            *[
                F.coalesce(F.col(f"_in{n}"), F.col(f"_head{n}"))[c].alias(prefix + c)
                for c, n in zip(columns, names)
            ],
        )
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    tolerance: float | None = None,
    ts: str = "ts",
    direction: str = "backward",
    prefix: str = "r_",
    width: float = HOUR,
    unique: str = "pose_id",
) -> DataFrame:
    """Left rows with the nearest right row at or before (``forward``: at or after) them.

    ``right_ts`` and the other right columns come back with ``prefix``; they are null when no
    right row qualifies or when it is further than ``tolerance`` seconds.
    """
    values = [c for c in right.columns if c not in keys]
    sign = F.lit(1.0) if direction == "backward" else F.lit(-1.0)
    l_cols = [c for c in left.columns if c not in keys]
    tagged_left = left.select(
        *keys, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*l_cols).alias("_l"),
        F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_r"),
    )
    tagged_right = right.select(
        *keys, F.col(ts).alias("_ts"), F.lit(0).alias("_side"),
        F.lit(None).cast(tagged_left.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"),
    )
    both = tagged_left.unionByName(tagged_right).withColumn("_t", sign * seconds("_ts"))
    blocked = both.withColumn("_block", F.floor(F.col("_t") / F.lit(float(width))))
    tails = blocked.groupBy(*keys, "_block").agg(
        F.max_by("_r", F.when(F.col("_side") == 0, F.col("_t"))).alias("_tail")
    )
    over_blocks = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = tails.select(
        *keys, "_block", F.last("_tail", ignorenulls=True).over(over_blocks).alias("_head")
    )
    in_block = (
        Window.partitionBy(*keys, "_block")
        .orderBy("_t", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = (
        blocked.withColumn("_in", F.last("_r", ignorenulls=True).over(in_block))
        .where(F.col("_side") == 1)
        .join(heads, [*keys, "_block"])
        .withColumn("_m", F.coalesce("_in", "_head"))
    )
    age = F.abs(F.col("_t") - sign * seconds(F.col(f"_m.{ts}")))
    if tolerance is not None:
        found = found.withColumn("_m", F.when(age <= tolerance, F.col("_m")))
    return found.select(
        *keys,
        *[F.col(f"_l.{c}").alias(c) for c in l_cols],
        *[F.col(f"_m.{c}").alias(prefix + c) for c in values],
    )


def nearest_time_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    tolerance: float,
    left_id: str,
    ts: str = "ts",
    prefix: str = "r_",
) -> DataFrame:
    """Left rows with the right row nearest in time within ``tolerance`` seconds.

    Buckets as wide as the tolerance make it an equi-join over three buckets; the earlier right
    row wins a tie. Left rows without a match are dropped.
    """
    values = [c for c in right.columns if c not in keys]
    bucket = F.floor(seconds(ts) / F.lit(float(tolerance)))
    probes = left.withColumn("_lt", seconds(ts)).withColumn(
        "_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))
    )
    sides = right.select(
        *keys,
        bucket.alias("_bucket"),
        seconds(ts).alias("_rt"),
        *[F.col(c).alias(prefix + c) for c in values],
    )
    gap = F.abs(F.col("_lt") - F.col("_rt"))
    pairs = probes.join(sides, [*keys, "_bucket"]).where(gap <= tolerance)
    best = F.struct(gap.alias("d"), F.col("_rt").alias("t"))
    kept = [c for c in left.columns if c not in (*keys, left_id)]
    return pairs.groupBy(*keys, left_id).agg(
        *[F.first(c).alias(c) for c in kept],
        *[F.min_by(prefix + c, best).alias(prefix + c) for c in values],
    )
