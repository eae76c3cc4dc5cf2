"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

A node of the trie is a prefix of the 64 bits. Pairs of nodes of one depth are followed downwards
together, the bits in which their prefixes differ are added up, and a pair is dropped once they
exceed the error budget; what reaches the leaves are exactly the pairs of fingerprints within the
budget. The upper levels are DataFrames: node counts by prefix, and a frontier of node pairs that
is deepened two bits at a time until both nodes of a pair hold at most ``node_rows`` fingerprints.
Then a task takes both nodes as sorted arrays and goes on in numpy, in chunks of bounded size.

Only distinct fingerprints enter the trie, so copies are never paired. A task keeps of the pairs it
finds what still connects (a star per component), so that groups of many near fingerprints don't
leave all their pairs behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.llm.common import append, components, forest, in_batches, text_bytes
from scanlake.session import cut

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 1 << 20


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles, repeats included; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        parts = [words[k:] for k in range(shingle)]
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*parts)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        some = np.array(hashes[at : at + CHUNK], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long. Null and blank texts get 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t, shingle) for t in text_bytes(batch, text)], np.uint64)
            kept = batch.select([c for c in batch.schema.names if c != "fp"])
            yield append(kept, fp=pa.array(found.view(np.int64)))

    docs = docs.drop("fp")
    return docs.transform(in_batches, scan, T.StructType([*docs.schema, T.StructField("fp", T.LongType())]))


def near_links(fps: DataFrame, budget: int = 3, node_rows: int = 8192) -> DataFrame:
    """Links ``a, b`` that connect exactly what pairs of the distinct ``fp`` within ``budget`` bits connect."""
    frontier, ready, depth = None, [], 0
    while True:
        depth += 2
        nodes = fps.groupBy(_prefix(depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        bits = F.array([F.lit(k) for k in range(4)])
        if frontier is None:
            frontier = fps.sparkSession.range(1).select(
                F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("d")
            )
        deeper = (
            frontier.withColumn("x", F.explode(bits))
            .withColumn("y", F.explode(bits))
            .select(
                (F.shiftleft("a", 2) + F.col("x")).alias("a"),
                (F.shiftleft("b", 2) + F.col("y")).alias("b"),
                (F.col("d") + F.bit_count(F.col("x").bitwiseXOR(F.col("y")))).alias("d"),
                ((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y"))).alias("once"),
            )
            .where((F.col("d") <= budget) & F.col("once"))
            .join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
            .select("a", "b", "d", "na", "nb")
        )
        deeper = cut(deeper)
        small = (F.col("na") <= node_rows) & (F.col("nb") <= node_rows)
        if depth >= 6:
            ready.append((depth, deeper.where(small).select("a", "b", "d")))
            frontier = deeper.where(~small)
        else:
            frontier = deeper
        if depth == 64 or (depth >= 6 and frontier.isEmpty()):
            break
    links = None
    for at, pairs in ready:
        some = _leaves(fps, pairs, at, budget)
        links = some if links is None else links.union(some)
    return links


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("fp", 64 - depth) if depth < 64 else F.col("fp")


def _leaves(fps: DataFrame, pairs: DataFrame, depth: int, budget: int) -> DataFrame:
    """The joins below the node pairs of one depth; a row holds both nodes' fingerprints."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    held = (
        fps.select(_prefix(depth).alias("node"), "fp")
        .join(wanted, "node", "left_semi")
        .groupBy("node")
        .agg(F.collect_list("fp").alias("fps"))
    )
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("fps").alias("left")), "a").join(
        held.select(F.col("node").alias("b"), F.col("fps").alias("right")), "b"
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in ("left", "right")]
            flat = [s.values.to_numpy(zero_copy_only=False).view(np.uint64) for s in sides]
            ends = [s.offsets.to_numpy() for s in sides]
            for row, (a, b, d) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "d")))):
                left, right = (np.sort(f[o[row] : o[row + 1]]) for f, o in zip(flat, ends))
                one, other = node_join(left, right, depth, d, budget, a == b)
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (one, other)], names=["a", "b"])

    return both.select("a", "b", "d", "left", "right").transform(in_batches, scan, "a long, b long")


def node_join(
    left: np.ndarray, right: np.ndarray, depth: int, d: int, budget: int, same: bool, leaf: int = 32
) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of two nodes (sorted; ``same``: one node with itself).

    The frontier is a stack of chunks of node pairs, as ranges in the two arrays. A chunk is split
    bit by bit; pairs of ranges with few combinations are compared outright.
    """
    n = len(left)
    i_all, j_all, held = [], [], 0
    stack = [(depth, np.array([[0, n, 0, len(right), d]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > CHUNK // 4:
            half = len(pairs) // 2
            stack += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        work = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        done = (work <= leaf) | (depth == 64)
        for i, j in _compare(left, right, pairs[done], work[done], budget, same):
            i_all.append(i)
            j_all.append(j)
            held += len(i)
            if held > CHUNK:
                i, j = _star(n, len(right), np.concatenate(i_all), np.concatenate(j_all), same)
                i_all, j_all, held = [i], [j], 0
        pairs = pairs[~done]
        if len(pairs):
            bit = np.uint64(1 << (63 - depth))
            lo, hi, rlo, rhi, diff = pairs.T
            mid, rmid = _middle(left, lo, bit), _middle(right, rlo, bit)
            parts = [
                np.stack([a0, a1, b0, b1, diff + extra], 1)
                for a0, a1, b0, b1, extra in (
                    (lo, mid, rlo, rmid, 0), (mid, hi, rmid, rhi, 0), (lo, mid, rmid, rhi, 1), (mid, hi, rlo, rmid, 1),
                )
            ]
            if same:
                parts[3] = parts[3][lo != rlo]
            down = np.concatenate(parts)
            down = down[(down[:, 1] > down[:, 0]) & (down[:, 3] > down[:, 2]) & (down[:, 4] <= budget)]
            if len(down):
                stack.append((depth + 1, down))
    if not i_all:
        return left[:0], left[:0]
    i, j = _star(n, len(right), np.concatenate(i_all), np.concatenate(j_all), same)
    every = left if same else np.concatenate([left, right])
    return every[i], every[j]


def _middle(values: np.ndarray, begin: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where, in the range of a prefix that starts at ``begin``, the next bit becomes one."""
    prefix = values[begin] & ~(bit | (bit - np.uint64(1)))
    return np.searchsorted(values, prefix | bit)


def _compare(left, right, pairs, work, budget, same):
    """Positions of near fingerprints in pairs of short ranges; the right side's follow the left's."""
    ends = np.cumsum(work)
    at = 0
    while at < len(pairs):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        some, sizes = pairs[at:upto], work[at:upto]
        row = np.repeat(np.arange(len(some)), sizes)
        k = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = (some[:, 3] - some[:, 2])[row]
        i, j = some[row, 0] + k // width, some[row, 2] + k % width
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if same:
            near &= i < j
        yield i[near], j[near] + (0 if same else len(left))
        at = upto


def _star(n: int, m: int, i: np.ndarray, j: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The links again, as one star per component."""
    label = forest(n if same else n + m, i, j)
    leaves = np.flatnonzero(label != np.arange(len(label)))
    return label[leaves], leaves


def group_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 3, node_rows: int = 8192) -> DataFrame:
    """``key, text_hash, fp, component_id, group`` for each row of ``docs``.

    ``group`` is the smallest fingerprint (as a signed long) of the rows linked over any number of
    steps, ``component_id`` their smallest key; nulls among the keys don't count, and a group of
    null keys only has a null ``component_id``. Rows repeated in ``docs`` are repeated here.
    """
    narrow = cut(
        fingerprints(docs.select(key, text), text).select(key, F.xxhash64(text).alias("text_hash"), "fp")
    )
    least = cut(narrow.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(near_links(least.select("fp"), budget, node_rows))
    rooted = least.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("group")
    )
    smallest = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    return narrow.join(rooted.join(smallest, "group").select("fp", "group", "component_id"), "fp")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest key (null keys come last).

    The text is shuffled once, to meet the rows to be kept by key and hash of the text.
    """
    groups = group_near_duplicates(docs, key, text, **options)
    kept = (
        groups.groupBy("group")
        .agg(F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), F.col("text_hash"))).alias("least"))
        .select(F.col("least.key").alias("_key"), F.col("least.text_hash").alias("_hash"))
    )
    hashed = docs.withColumn("_text_hash", F.xxhash64(text))
    met = hashed.join(kept, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    return met.dropDuplicates([key, "_text_hash"]).select(*docs.columns)
