"""What several of the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.session import cut


BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(rows: DataFrame, scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows`` through ``scan``, in Arrow batches of at most ``BATCH_BYTES`` but for single larger rows.

    A worker holds a batch, what is derived from it and its result at once. Batches of the session's default
    size leave little of a small executor when several workers are at it.
    """
    conf = rows.sparkSession.conf
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", conf.get(BATCH_CONF).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        conf.set(BATCH_CONF, f"{BATCH_BYTES}b")
    return rows.mapInArrow(scan, schema)


def text_bytes(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The UTF-8 bytes of each row of a string column; of a null, none."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def append(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns behind its own."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )


def prefix_sums(counts: DataFrame, order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Exclusive running sum of ``value`` over the non-negative integer ``order``.

    Blocks of ``block`` orders are summed first, so no task holds more than a block, and the one
    task that sees all blocks reads ``block`` times fewer rows than the table has.
    """
    blocked = counts.withColumn("_block", F.floor(F.col(order) / block))
    whole = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        blocked.groupBy("_block")
        .agg(F.sum(value).alias("_sum"))
        .select("_block", F.coalesce(F.sum("_sum").over(whole), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.join(before, "_block")
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_block", "_before")
    )


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each vertex's component, for vertices 0 to n-1 and links i-j.

    Labels fall to the smaller end of each link and are then shortened by following them, until
    nothing changes.
    """
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        if (a == b).all():
            return label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def components(links: DataFrame, limit: int = 64) -> DataFrame:
    """``vertex, root`` for every vertex of ``links`` (columns ``a``, ``b``): the smallest vertex reachable.

    Large-star and small-star rounds: each vertex hands the smallest neighbour to its larger
    neighbours, then to its smaller ones, so that paths halve and end as stars around the smallest
    vertex. Each round is written to the shared folder and read again, which cuts the lineage and
    outlives lost executors. Grouping only ever takes minima, which partial aggregation shrinks
    before the shuffle; the joins behind a hot vertex are plain equi-joins that can be split.
    """
    edges = cut(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    for _ in range(limit):
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = (
            both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        ).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = (
            joined.where(F.col("u") != F.col("m"))
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .union(least.select("v", F.col("m").alias("u")))
            .distinct()
        )
        new = cut(small)
        a, b = (x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first() for x in (edges, new))
        edges = new
        if tuple(a) == tuple(b):
            break
    else:
        raise RuntimeError(f"links of a component were not joined within {limit} rounds")
    return edges.select(F.col("v").alias("vertex"), F.col("u").alias("root")).union(
        edges.select(F.col("u").alias("vertex"), F.col("u").alias("root")).distinct()
    )
