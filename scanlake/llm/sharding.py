"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their stratum and ranked there; rank r of n becomes the
fraction (r + 0.5) / n. In the order of those fractions every stretch of the corpus has each
stratum in its overall proportion, so cutting that order into equal stretches gives shards that
all match the mixture and whose row counts differ by one at most.

Ranks come from counts: the hash divides each stratum into buckets of a bounded size, bucket
counts give each bucket's offset, and only rows of one bucket meet in a task. The fractions, again
cut into buckets, are numbered in the same way. A stratum that holds most rows is just more buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import prefix_sums


def interleave(
    rows: DataFrame,
    shards: int,
    stratum: str,
    order: Sequence[str],
    seed: int = 0,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 in each shard, no gaps).

    ``order`` names columns that tell rows apart; they are hashed with ``seed`` for the shuffle and
    break its ties. Rows equal in all of them are interchangeable. A null stratum is a stratum of
    its own. Columns called ``shard`` or ``slot`` are replaced; an empty table stays empty.
    """
    total = rows.count()
    buckets = max(64, -(-total // bucket_rows))
    rows = rows.drop("shard", "slot").withColumns(
        {"_s": F.struct(F.col(stratum).isNull().alias("none"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("name"))}
    )
    rows = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *order), 1))
    rows = rows.withColumn("_b", _bucket(F.col("_h") / F.lit(float(2**63)), buckets))

    counts = rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("_s")
    starts = counts.select(
        "_s", "_b",
        F.coalesce(F.sum("_n").over(within.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(within).alias("_size"),
    )
    local = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", *order)) - 1
    ranked = (
        rows.withColumn("_local", local)
        .join(starts, ["_s", "_b"])
        .withColumn("_f", (F.col("_start") + F.col("_local") + F.lit(0.5)) / F.col("_size"))
        .withColumn("_rank", F.col("_start") + F.col("_local"))
        .withColumn("_fb", _bucket(F.col("_f"), buckets))
        .drop("_b", "_h", "_local", "_start", "_size")
    )
    offsets = prefix_sums(ranked.groupBy("_fb").agg(F.count(F.lit(1)).alias("_n")), "_fb", "_n", "_offset").drop("_n")
    place = F.row_number().over(Window.partitionBy("_fb").orderBy("_f", "_s", "_rank")) - 1
    at = F.col("_at")
    shard = F.expr(f"(_at * {shards}) div {max(total, 1)}")
    start = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("_p", place)
        .join(offsets, "_fb")
        .withColumn("_at", F.col("_offset") + F.col("_p"))
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", at - start)
        .drop("_s", "_f", "_rank", "_fb", "_p", "_offset", "_at")
    )


def _bucket(fraction: Column, buckets: int) -> Column:
    return F.least(F.floor(fraction * buckets), F.lit(buckets - 1)).cast("bigint")


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """The shards as folders of Parquet files, each file a run of slots, written by ``files`` tasks."""
    (
        sharded.repartitionByRange(files, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .mode("overwrite")
        .parquet(path)
    )
