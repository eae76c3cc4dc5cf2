"""Hard negatives by exact integer products in a residue number system.

Components become integers. A table of rows is scanned in tiles of rows times anchors: a tile's products are taken
modulo several small primes, each a product of single-precision matrices of symmetric residues, whose sums stay
below 2 ** 24 and so are exact; the signed scores come back by Chinese remaindering. As many primes are taken as the
largest vectors ask for.

Anchors are sent out in parts of about ``PART``, which bounds what the driver and a worker hold. For each part
the rows are scanned twice where they lie, without a shuffle. A task keeps the first few rows of each anchor,
so only those leave it, and a window picks the first of all: the positives first, then what lies in the
score window of each positive.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import in_batches
from scanlake.session import scratch_table

#: Anchors that are sent out at once; rows and anchors of a tile.
PART, ROWS, ANCHORS = 32_768, 10_240, 256
#: Primes whose symmetric residues are at most 254, the largest first.
PRIMES = [p for p in range(509, 2, -1) if all(p % d for d in range(2, int(p**0.5) + 1))]
#: Components multiplied at once: 254 * 254 * 256 < 2 ** 24.
DEPTH = 256
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
CANDIDATE = "anchor int, slot int, id long, score long"


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id, x, label`` of the rows with a label and a vector of finite numbers."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    narrow = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"), F.col(label).cast("long").alias("label"))
    return narrow.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad)


def _integers(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


def _residues(x: np.ndarray, prime: int) -> np.ndarray:
    """Symmetric residues of whole numbers, in single precision."""
    r = np.fmod(x, prime)
    return (r - prime * np.rint(r / prime)).astype(np.float32)


def _primes(bound: float) -> list[int]:
    """So many primes that products of up to ``bound`` on both sides of zero are told apart."""
    taken, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            return taken
        taken.append(p)
        product *= p
    raise OverflowError("inner products don't fit a long")


def _scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed inner products of all rows of ``a`` with all of ``b``, given by their residues."""
    value = np.zeros((len(a[0]), len(b[0])), np.int64)
    product = 1
    for prime, left, right in zip(primes, a, b):
        rest = np.zeros(value.shape, np.int64)
        for low in range(0, left.shape[1], DEPTH):
            rest += (left[:, low : low + DEPTH] @ right[:, low : low + DEPTH].T).astype(np.int64)
        digit = (rest - value) % prime * pow(product, -1, prime) % prime
        digit[digit > prime // 2] -= prime
        value += digit * product
        product *= prime
    return value


class _Best:
    """The first ``k`` rows of each of ``n`` groups: higher scores first, then smaller ids, a null id last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids, self.null = np.full((n, k), NONE), np.full((n, k), LAST), np.ones((n, k), bool)
        self.some = np.zeros((n, k), bool)

    def worst(self) -> np.ndarray:
        """What a row must reach to come in."""
        return np.where(self.some[:, -1], self.scores[:, -1], NONE)

    def add(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        touched = np.unique(group)
        held = self.some[touched]
        groups = np.concatenate([np.repeat(touched, held.sum(axis=1)), group])
        cols = [np.concatenate([c[touched][held], new]) for c, new in ((self.scores, score), (self.ids, id_), (self.null, null))]
        order = np.lexsort((cols[1], cols[2], -cols[0], groups))
        groups, cols = groups[order], [c[order] for c in cols]
        begin = np.searchsorted(groups, touched)
        place = np.arange(len(groups)) - np.repeat(begin, np.diff(begin, append=len(groups)))
        first = place < self.k
        self.some[touched] = False
        for mine, new in zip((self.scores, self.ids, self.null, self.some), (*cols, np.ones(len(groups), bool))):
            mine[groups[first], place[first]] = new[first]

    def rows(self, slots: int) -> pa.RecordBatch:
        """Groups are numbered ``anchor * slots + slot``."""
        group, place = np.nonzero(self.some)
        return pa.RecordBatch.from_arrays(
            [
                pa.array((group // slots).astype(np.int32)), pa.array((group % slots).astype(np.int32)),
                pa.array(self.ids[group, place], mask=self.null[group, place]), pa.array(self.scores[group, place]),
            ],
            names=["anchor", "slot", "id", "score"],
        )


def _matrix(column: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def _tiles(batches: Iterator[pa.RecordBatch], part: dict, primes: list[int], scale: float):
    """For tiles of anchors and rows: places of the anchors, scores, and the rows' ids, null ids and labels."""
    residues = functools.cache(lambda dim: [_residues(_integers(part["x"][dim][1], scale), p) for p in primes])
    for batch in batches:
        sizes = pc.list_value_length(batch.column("x")).to_numpy()
        ids, labels = batch.column("id"), batch.column("label").to_numpy()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        id_ = ids.fill_null(LAST).to_numpy()
        for dim, (places, _) in part["x"].items():
            found = np.flatnonzero(sizes == dim)
            for low in range(0, len(found), ROWS):
                at = found[low : low + ROWS]
                x = _integers(_matrix(batch.column("x"), at, dim), scale)
                there = [_residues(x, p) for p in primes]
                for begin in range(0, len(places), ANCHORS):
                    some = slice(begin, begin + ANCHORS)
                    yield places[some], _scores([r[some] for r in residues(dim)], there, primes), id_[at], null[at], labels[at]


def _positives(held: Broadcast, primes: list[int], scale: float, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held.value
        best = _Best(len(part["ids"]), k)
        for places, scores, ids, null, labels in _tiles(batches, part, primes, scale):
            other = (ids != part["ids"][places, None]) | null
            a, r = np.nonzero(other & (labels == part["labels"][places, None]) & (scores >= best.worst()[places, None]))
            best.add(places[a], scores[a, r], ids[r], null[r])
        yield best.rows(1)

    return scan


def _negatives(held: Broadcast, primes: list[int], scale: float, k: int, share: tuple[int, int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held.value
        high = part["positive"]
        slots = high.shape[1]
        over, under = share
        #: The least whole score of which ``under`` parts reach ``over`` parts of the positive's; no window below zero.
        low = np.where(high >= 0, -(-over * high // under), LAST)
        best = _Best(high.size, k)
        for places, scores, ids, null, labels in _tiles(batches, part, primes, scale):
            least = np.maximum(low[places], best.worst().reshape(high.shape)[places])
            near = (scores <= high[places].max(axis=1)[:, None]) & (scores >= least.min(axis=1)[:, None])
            a, r = np.nonzero(near & (labels != part["labels"][places, None]))
            for slot in range(slots):
                s = scores[a, r]
                inside = (s <= high[places[a], slot]) & (s >= least[a, slot])
                best.add(places[a[inside]] * slots + slot, s[inside], ids[r[inside]], null[r[inside]])
        yield best.rows(slots)

    return scan


def _first(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, long but for ``rank``.

    ``is_anchor`` is a condition on ``id`` and ``label``. A score is the inner product of two rows' components,
    each ``floor(scale * x)``. An anchor's positives are its first ``positives`` rows of the same label and another id; for
    each of them the first ``negatives`` rows of another label are given whose score is at most the positive's and
    at least the share of it. First are higher scores, then smaller ids, null ids last.

    Rows without a label, without a vector, or with a null or non-finite component take no part, nor do
    vectors of another length with an anchor. Anchors equal in id, label and vector count once; other repeated rows
    count as often as they come. An anchor without positives, or a positive without negatives, has no row, and an
    empty table gives none. Scores beyond a long are an error.
    """
    spark = rows.sparkSession
    good = usable(rows, key, vector, label)
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.pow(F.floor(F.lit(scale) * v.cast("double")).cast("double"), F.lit(2.0)))
    (longest,) = good.agg(F.max(square)).first()
    anchors = good.where(is_anchor).dropDuplicates(["id", "label", "x"])
    path = scratch_table(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    if longest is not None:
        if longest >= 2.0**62:
            raise OverflowError("inner products don't fit a long")
        primes = _primes(longest * (1 + 1e-9) + 1)
        parts = max(1, -(-anchors.count() // PART))
        for number in range(parts):
            part = anchors.where(F.pmod(F.xxhash64("id", "label", "x"), F.lit(parts)) == number)
            found = _mine_part(good, part.toArrow(), primes, scale, positives, negatives, share)
            if found is not None:
                found.select([f.split()[0] for f in schema.split(", ")]).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _mine_part(
    rows: DataFrame, anchors: pa.Table, primes: list[int], scale: float, positives: int, negatives: int, share: tuple[int, int]
) -> DataFrame | None:
    if not anchors.num_rows:
        return None
    spark = rows.sparkSession
    column = anchors.column("x").combine_chunks()
    sizes = pc.list_value_length(column).to_numpy()
    dims = {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}
    part = {
        "ids": anchors.column("id").to_numpy(), "labels": anchors.column("label").to_numpy(),
        "x": {d: (at, _matrix(column, at, d)) for d, at in dims.items()},
    }
    near = rows.transform(in_batches, _positives(spark.sparkContext.broadcast(part), primes, scale, positives), CANDIDATE)
    found = _first(near, positives).orderBy("anchor", "rank").toArrow()
    if not found.num_rows:
        return None
    place, slot = found.column("anchor").to_numpy(), found.column("rank").to_numpy() - 1
    part["positive"] = np.full((len(part["ids"]), positives), -1, np.int64)
    part["positive"][place, slot] = found.column("score").to_numpy()
    far = rows.transform(in_batches, _negatives(spark.sparkContext.broadcast(part), primes, scale, negatives, share), CANDIDATE)
    named = pa.table({
        "anchor": pa.array(place, pa.int32()), "slot": pa.array(slot, pa.int32()), "anchor_id": pa.array(part["ids"][place]),
        "positive_id": found.column("id"), "positive_score": found.column("score"),
    })
    best = _first(far, negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    return best.join(spark.createDataFrame(named), ["anchor", "slot"])
