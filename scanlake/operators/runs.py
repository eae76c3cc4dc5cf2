"""Runs of rows with equal keys, read from sorted partitions many at a time.

A group function would be called once per key. Here rows are dealt by key, sorted, and read in large pieces that
end with a run, so numpy works on many keys at once and no call is paid per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 100_000


def run_starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Where each run of equal keys begins in rows that are sorted by them."""
    if not len(pdf):
        return np.zeros(0, np.int64)
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for key in keys:
        values = pdf[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pd.DataFrame], keys: Sequence[str], rows: int = ROWS) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Pieces of some ``rows`` rows, whole runs each, with the places where their runs begin."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size >= rows:
            pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else batch.reset_index(drop=True)
            starts = run_starts(pdf, keys)
            last = int(starts[-1])
            if last:
                yield pdf.iloc[:last], starts[:-1]
            held, size = [pdf.iloc[last:]], len(pdf) - last
    if held:
        pdf = pd.concat(held, ignore_index=True)
        yield pdf, run_starts(pdf, keys)


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by key, over as many tasks as the session's shuffles have: small rows can stand for long work, so they aren't
    brought together by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def map_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], function: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
    schema, rows: int = ROWS, unread: Sequence[str] = (),
) -> DataFrame:
    """``function`` on pieces of whole runs of ``df`` by ``keys``, each run in ``order``.

    A run lies in one task, so it must have a bound. Columns of ``order`` that the function doesn't read can be left
    out of what it gets as ``unread``.
    """
    keys = list(keys)
    dealt = _dealt(df, keys).sortWithinPartitions(*keys, *order).drop(*unread)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_runs(batches, keys, rows):
            yield function(pdf, starts)

    return dealt.mapInPandas(scan, schema)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values, nulls included."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()


def table_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """As ``whole_runs``, on Arrow tables, which keep integers and nulls as they are."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in keys:
            values = _codes(table.column(key))
            new[1:] |= values[1:] != values[:-1]
        return table, np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table, starts = joined()
            last = int(starts[-1])
            if last:
                yield table.slice(0, last), starts[:-1]
            held, size = table.slice(last).to_batches(), table.num_rows - last
    if held:
        yield joined()


def map_table_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], function: Callable[[pa.Table, np.ndarray], pa.Table],
    schema, rows: int = ROWS,
) -> DataFrame:
    """As ``map_runs``, on Arrow tables."""
    keys = list(keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in table_runs(batches, keys, rows):
            yield from function(table, starts).to_batches()

    return _dealt(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(scan, schema)
