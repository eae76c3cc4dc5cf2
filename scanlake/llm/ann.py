"""Approximate nearest neighbours by inner product: a hash-prefix forest.

A tree is an array of long hash strings, sorted. Each bit of a string is the side of a random
hyperplane on which a vector lies; for inner products the vectors of a block are scaled to a length
of one at most and given a last component that fills the length up, which queries have as zero. A
query descends in all trees of a block to its longest matching prefixes, then ascends in all trees
at once, one bit at a time, until the ranges of its prefixes hold ``want`` times the block's rows
(a row counts in each tree where it is met). All rows met are scored on their original vectors.

Rows are dealt by a hash into blocks of about ``block_rows``, each with its own forest: the index is a
table of blocks, its vectors and trees packed as bytes. Every query meets every block, in chunks
of ``chunk`` queries, and the best of each block are ranked once more. So a task holds one block and one
chunk, whatever the size of a group of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import in_batches
from scanlake.session import cut

BLOCK = "dim int, block long, ids binary, vectors binary, keys binary, orders binary"


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, dim, x`` of rows with an id and a vector of finite numbers that aren't all zero."""
    x = F.col("x")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    narrow = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    return narrow.where(F.col("id").isNotNull() & x.isNotNull()).where(whole).withColumn("dim", F.size("x"))


def _planes(dim: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, bits, dim + 1)).astype(np.float32)


def _hashes(planes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """``[tree, row]``: the bits of a hash string as an unsigned number, the first highest."""
    bits = planes.shape[1]
    place = np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.stack([((vectors @ p.T) > 0) @ place for p in planes]).astype(np.uint32)


def build(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", trees: int = 32, bits: int = 24,
    block_rows: int = 8192, seed: int = 0,
) -> DataFrame:
    """The index: a row per block. Written once by ``cut``, it serves any number of searches."""
    good = usable(rows, key, vector)
    blocks = max(1, -(-good.count() // block_rows))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        dim = table.column("dim")[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        order = np.lexsort((ids,))
        ids, x = ids[order], x[order]
        norms = np.sqrt((x * x).sum(axis=1))
        top = norms.max()
        longer = np.concatenate([x / top, np.sqrt(np.maximum(0, 1 - (norms / top) ** 2))[:, None]], axis=1).astype(np.float32)
        keys = _hashes(_planes(dim, trees, bits, seed), longer)
        orders = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        blobs = [ids, x, np.take_along_axis(keys, orders, 1), orders]
        first = {"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1).combine_chunks()}
        return pa.table(first | {c: pa.array([b.tobytes()]) for c, b in zip(("ids", "vectors", "keys", "orders"), blobs)})

    dealt = good.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)))
    return cut(dealt.groupBy("dim", "block").applyInArrow(pack, BLOCK))


def search(
    index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20,
    want: float = 1.5, trees: int = 32, bits: int = 24, seed: int = 0, chunk: int = 512,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows found for each query, best first, ties to the smaller id.

    Every block gives at least ``2 * k`` candidates, or all it has, so no query gets fewer than ``k`` while there
    are more. Rows of the query's own id are no candidates. Queries equal in id and vector count once; a query
    whose vector is null, zero or not finite has no result. ``trees``, ``bits`` and ``seed`` are the index's.
    """
    good = usable(queries, key, vector).dropDuplicates(["id", "x"])
    chunks = max(1, -(-good.count() // chunk))

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy()
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "q_ids": pa.array([table.column("id").to_numpy().tobytes()]),
            "q_vectors": pa.array([x.tobytes()]),
        })

    dealt = good.withColumn("part", F.pmod(F.xxhash64("id", "x"), F.lit(chunks)))
    packed = cut(dealt.groupBy("dim", "part").applyInArrow(pack, "dim int, q_ids binary, q_vectors binary"))
    to_each = packed.join(index.select("dim", "block"), "dim")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["vectors"]).reshape(-1, dim)
                forest = [np.frombuffer(row[c], t).reshape(trees, -1) for c, t in (("keys", np.uint32), ("orders", np.int32))]
                q = np.frombuffer(row["q_vectors"]).reshape(-1, dim)
                longer = np.concatenate([q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros((len(q), 1))], axis=1)
                found = _ascend(*forest, _hashes(_planes(dim, trees, bits, seed), longer.astype(np.float32)), bits, want, 2 * k)
                yield _best(found, np.frombuffer(row["q_ids"], np.int64), q, ids, x, k)

    met = index.join(to_each, ["dim", "block"]).transform(in_batches, scan, "query_id long, q_at binary, vec_id long, score double")
    order = Window.partitionBy("query_id", "q_at").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ascend(keys: np.ndarray, orders: np.ndarray, hashes: np.ndarray, bits: int, want: float, least: int) -> Iterator[np.ndarray]:
    """For each query the rows met, as positions in the block; at least ``least`` of them, if there are as many."""
    trees, n = keys.shape
    low = np.zeros((bits + 1, trees, hashes.shape[1]), np.int32)
    high = np.full_like(low, n)
    for length in range(1, bits + 1):
        shift = np.uint32(bits - length)
        for tree in range(trees):
            prefix = hashes[tree] >> shift
            sorted_prefixes = keys[tree] >> shift
            low[length, tree] = np.searchsorted(sorted_prefixes, prefix, "left")
            high[length, tree] = np.searchsorted(sorted_prefixes, prefix, "right")
    held = (high - low).sum(axis=1)
    for query in range(hashes.shape[1]):
        length = int(np.flatnonzero(held[:, query] >= min(want, trees) * n)[-1])
        while True:
            met = np.zeros(n, bool)
            for tree in range(trees):
                met[orders[tree, low[length, tree, query] : high[length, tree, query]]] = True
            rows = np.flatnonzero(met)
            if length == 0 or len(rows) >= least:
                break
            length -= 1
        yield rows


def _best(found: Iterator[np.ndarray], q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """The best ``k`` rows of the block for each query.

    Products in single precision pick what can be among them, with everything in reach of rounding;
    those are scored in double precision and ranked exactly.
    """
    single, lengths = x.astype(np.float32), np.sqrt((x * x).sum(axis=1))
    out: list[tuple[np.ndarray, ...]] = []
    for at, rows in enumerate(found):
        rows = rows[ids[rows] != q_ids[at]]
        if len(rows) > k:
            rough = single[rows] @ q[at].astype(np.float32)
            slack = 4e-7 * x.shape[1] * lengths.max() * np.sqrt((q[at] * q[at]).sum()) + 1e-30
            rows = rows[rough >= np.partition(rough, -k)[-k] - slack] if np.isfinite(rough).all() else rows
        score = (x[rows] * q[at]).sum(axis=1)
        first = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(first), q_ids[at]), np.full(len(first), at), ids[rows][first], score[first]))
    cols = [np.concatenate(c) for c in zip(*out)]
    marks = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in q]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0].astype(np.int64)), pa.array([marks[int(a)] for a in cols[1]], pa.binary()), pa.array(cols[2].astype(np.int64)), pa.array(cols[3].astype(float))],
        names=["query_id", "q_at", "vec_id", "score"],
    )

