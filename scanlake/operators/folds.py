"""Folds along a drive: a small state carried from row to row, block by block.

A fold sees the rows of one block of one key as arrays, and the state that the block before left. Rows of many keys are
sorted into runs and folded task by task; between blocks the state goes through a table with one row per key. The
same folds run on streams, where the state store carries the state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.operators.runs import map_table_runs
from scanlake.operators.timeline import block_of, seconds
from scanlake.session import cut, scratch_table


@dataclass(frozen=True)
class Fold:
    """``run(t, values, state)`` gets the times in seconds, a column of ``values`` per name in ``inputs``, and the state
    that came in, or None. It returns a column per entry of ``outputs`` ("name type", double or boolean) and the state
    that goes out, an array of doubles."""

    inputs: Sequence[str]
    outputs: Sequence[str]
    run: Callable[[np.ndarray, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]
    #: The same for many short runs, which go on together: ``many(t, values, starts, states)`` with a state or None each.
    many: Callable[[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray | None]], tuple[np.ndarray, list[np.ndarray]]] | None = None
    #: Whether the state that goes out is soon the same whatever came in, as where it is a row that was picked.
    forgets: bool = False

    @property
    def names(self) -> list[str]:
        return [o.split()[0] for o in self.outputs]

    def columns(self, out: np.ndarray) -> list[np.ndarray]:
        """The outputs in their types."""
        return [out[:, i] != 0 if o.split()[1] == "boolean" else out[:, i] for i, o in enumerate(self.outputs)]


def _values(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    columns = [table.column(n).cast(pa.float64()).fill_null(float("nan")).to_numpy() for n in names]
    return np.column_stack(columns) if columns else np.zeros((table.num_rows, 0))


def _folded(fold: Fold, fields: list[str]):
    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        is_state = table.column("_kind").to_numpy() == 0
        t, values = _values(table, ["_t"])[:, 0], _values(table, fold.inputs)
        states = table.column("_state")
        out = np.full((table.num_rows, len(fold.outputs)), np.nan)
        leaving: list[list[float] | None] = [None] * table.num_rows
        rows = np.flatnonzero(~is_state)
        ends = np.append(starts[1:], table.num_rows)
        entering = {int(b): np.array(states[int(b)].as_py(), float) for b in starts[is_state[starts]]}
        full = starts + is_state[starts] < ends
        begins, ends = starts[full], ends[full]
        if fold.many and len(begins) ** 2 > len(rows):
            firsts = np.cumsum(ends - begins - is_state[begins]) - (ends - begins - is_state[begins])
            out[rows], after = fold.many(t[rows], values[rows], firsts, [entering.get(b) for b in begins.tolist()])
            for end, state in zip(ends.tolist(), after):
                leaving[end - 1] = [float(v) for v in state]
        else:
            for begin, end in zip(begins.tolist(), ends.tolist()):
                state = entering.get(begin)
                begin += state is not None
                out[begin:end], state = fold.run(t[begin:end], values[begin:end], state)
                leaving[end - 1] = [float(v) for v in state]
        found = table.select(fields).take(pa.array(rows))
        for name, column in zip(fold.names, fold.columns(out[rows])):
            found = found.append_column(name, pa.array(column))
        return found.append_column("_leaving", pa.array([leaving[r] for r in rows.tolist()], pa.list_(pa.float64())))

    return run


def chained_fold(df: DataFrame, keys: Sequence[str], ts: str, width: float, fold: Fold) -> DataFrame:
    """``fold`` in time order per key, rows of one time by its inputs. A task holds one block of ``width`` seconds of a key.

    A fold that ``forgets`` is done as ``settled_fold``. For others, round r folds the r-th block of every key at once, starting from the states of round r - 1, so the number
    of rounds is the longest drive over ``width`` and does not depend on the number of rows or vehicles. A state
    comes in as one row per key. Each round's result is a table in the shared checkpoint folder, so a lost executor
    repeats one round only.
    """
    if fold.forgets:
        return settled_fold(df, keys, ts, width, fold)
    keys, fields = list(keys), list(df.columns)
    spark = df.sparkSession
    blocked = df.withColumns({"_t": seconds(ts), "_block": block_of(ts, width)})
    blocks = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_block")
    numbered = blocks.withColumn("_round", F.row_number().over(order) - 1).drop("_n")
    staged = scratch_table(spark, "fold-in")
    blocked.join(numbered, [*keys, "_block"]).drop("_block").write.partitionBy("_round").parquet(staged)
    rows = spark.read.parquet(staged)
    rounds = (rows.agg(F.max("_round")).first()[0] or 0) + 1
    out = T.StructType(list(df.schema.fields) + list(T.StructType.fromDDL(", ".join(fold.outputs)).fields))
    carried = T.StructType([*out.fields, T.StructField("_leaving", T.ArrayType(T.DoubleType()))])
    target = scratch_table(spark, "fold-out")
    states: DataFrame | None = None
    for r in range(rounds):
        now = rows.where(F.col("_round") == r).drop("_round").withColumn("_kind", F.lit(1))
        now = now.withColumn("_state", F.lit(None).cast("array<double>"))
        if states is not None:
            now = now.unionByName(states.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        path = f"{target}/round={r}"
        map_table_runs(now, keys, ["_kind", "_t", *fold.inputs], _folded(fold, fields), carried).write.parquet(path)
        states = spark.read.schema(carried).parquet(path).where("_leaving is not null").select(*keys, F.col("_leaving").alias("_state"))
    return spark.read.schema(out).parquet(*[f"{target}/round={r}" for r in range(rounds)])


def settled_fold(df: DataFrame, keys: Sequence[str], ts: str, width: float, fold: Fold) -> DataFrame:
    """The same, with all blocks at once: each is first folded as if nothing came before it.

    Then every block whose entering state was not what the block before it now leaves is folded again, until all
    fit. Where a fold forgets, few blocks leave another state than at first, so a few rounds do for drives of any
    length; at worst a key takes as many as it has blocks. Only states go round; the rows are read once more at the end.
    """
    keys, fields = list(keys), list(df.columns)
    at = [*keys, "_block"]
    blocked = df.withColumns({"_t": seconds(ts), "_block": block_of(ts, width), "_kind": F.lit(1)})
    blocked = blocked.withColumn("_state", F.lit(None).cast("array<double>"))
    narrow = blocked.select(*at, "_t", "_kind", "_state", *[c for c in fold.inputs if c not in at])
    out = T.StructType(list(df.schema.fields) + list(T.StructType.fromDDL(", ".join(fold.outputs)).fields))
    leaving = T.StructField("_leaving", T.ArrayType(T.DoubleType()))
    order = ["_kind", "_t", *fold.inputs]

    def entered(rows: DataFrame, states: DataFrame | None) -> DataFrame:
        if states is None:
            return rows
        came = states.where("_state is not null").select(*at, F.lit(0).alias("_kind"), "_state")
        return rows.unionByName(came, allowMissingColumns=True)

    def ends(table: pa.Table, starts: np.ndarray) -> pa.Table:
        found = folded(table, starts)
        return found.filter(found.column("_leaving").is_valid()).select([*at, "_leaving"])

    folded = _folded(fold, at)
    schema = T.StructType([*(narrow.schema[c] for c in at), leaving])
    before = Window.partitionBy(*keys).orderBy("_block")
    known = cut(map_table_runs(narrow, at, order, ends, schema).withColumn("_used", F.lit(None).cast("array<double>")))
    while True:
        fits = known.withColumn("_state", F.lag("_leaving").over(before))
        again = cut(fits.where(~F.col("_state").eqNullSafe(F.col("_used"))).select(*at, "_state"))
        if again.isEmpty():
            break
        redone = map_table_runs(entered(narrow.join(again.select(*at), at, "left_semi"), again), at, order, ends, schema)
        new = redone.withColumnRenamed("_leaving", "_new")
        known = cut(fits.join(new, at, "left").select(*at, F.coalesce("_new", "_leaving").alias("_leaving"), F.col("_state").alias("_used")))
    states = known.select(*at, F.col("_used").alias("_state"))
    whole = map_table_runs(entered(blocked, states), at, order, _folded(fold, fields), T.StructType([*out.fields, leaving]))
    return whole.drop("_leaving")
