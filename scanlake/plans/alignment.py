"""Point-to-point alignment of many cloud pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.functions.matrices import rpy_matrices
from scanlake.functions.poses import FIELDS
from scanlake.operators import clouds
from scanlake.operators.runs import _dealt, map_runs, run_starts, table_runs
from scanlake.session import cut

XYZ = ("x", "y", "z")
NAMES = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]


def align_clouds(
    pairs: DataFrame,
    source: DataFrame,
    source_on: Sequence[str],
    target: DataFrame,
    target_on: Sequence[str],
    size: float = 1.0,
    max_d: float | None = None,
    rounds: int = 100,
    eps: float = 1e-6,
    point_id: str = "point_id",
    together: int = 64,
    yaw: str | None = None,
) -> DataFrame:
    """For each of ``pairs`` the transform that brings its source cloud onto its target cloud.

    ``source`` and ``target`` hold each cloud once, named by ``source_on`` and ``target_on``; pairs have both. A target
    cloud is sent to one task with up to some ``together`` of its pairs, indexed there once by cells from ``size``
    up, and searched in all rounds without another shuffle. Targets of many pairs go to several tasks. Clouds must
    be bounded, as those with one point per voxel are.

    In each round the moved source points meet their nearest target points and the pairs within ``max_d`` are aligned
    rigidly, until the mean squared distance changes by less than ``eps``. ``fitness`` is that of all source points
    at the end, without a limit; ``converged`` is false where fewer than three points came within ``max_d``. ``yaw``
    names a column of ``pairs`` with a first turn. Pairs without points on either side give no row.
    """
    source_on, target_on = list(source_on), list(target_on)
    at = list(dict.fromkeys([*target_on, *source_on]))
    inner = [c for c in at if c not in target_on]
    turn = [F.col(yaw).cast("double").alias("_yaw")] if yaw else [F.lit(0.0).alias("_yaw")]
    wanted = pairs.select(*at, *turn).dropDuplicates(at)
    parts = wanted.groupBy(*target_on).agg(F.ceil(F.count(F.lit(1)) / together).alias("_parts"))
    dealt = wanted.join(parts.hint("merge"), target_on).withColumn("_part", F.pmod(F.xxhash64(*at), F.col("_parts")).cast("int")).drop("_parts")
    point = [F.col(point_id).alias("_point"), *[F.col(c).cast("double").alias(c) for c in XYZ]]
    from_source = source.join(dealt.hint("merge"), source_on).select(*at, "_part", F.lit(1).alias("_kind"), "_yaw", *point)
    used = dealt.join(source.select(*source_on).distinct().hint("merge"), source_on, "left_semi").select(*target_on, "_part").distinct()
    to_target = target.join(used.hint("merge"), target_on).select(
        *[(F.col(c) if c in target_on else F.lit(0).cast(pairs.schema[c].dataType)).alias(c) for c in at],
        "_part", F.lit(0).alias("_kind"), F.lit(0.0).alias("_yaw"), *point,
    )
    schema = T.StructType(
        [*(pairs.schema[c] for c in at), *(T.StructField(n, T.DoubleType()) for n in [*NAMES, "fitness"]),
         T.StructField("rounds", T.IntegerType()), T.StructField("converged", T.BooleanType())]
    )

    def solve(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(pdf)))
        goal = pdf["_kind"].to_numpy() == 0
        xyz = pdf[list(XYZ)].to_numpy(float)
        own = pdf[~goal]
        both = np.isin(group[~goal], group[goal])
        own, cloud, points = own[both], group[~goal][both], xyz[~goal][both]
        if not len(own):
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema})
        begin = run_starts(own.assign(_group=cloud), ["_group", *inner])
        index = clouds.CloudIndex(group[goal], xyz[goal], size)
        first = _first_turns(own["_yaw"].to_numpy(float)[begin])
        found = clouds.align(index, cloud[begin], points, begin, max_d, rounds, eps, first)
        out = own.iloc[begin][at].reset_index(drop=True)
        flat = np.concatenate([found["rotation"].reshape(-1, 9), found["shift"]], axis=1)
        return out.assign(**dict(zip(NAMES, flat.T)), **{c: found[c] for c in ("fitness", "rounds", "converged")})

    rows = from_source.unionByName(to_target)
    return map_runs(rows, [*target_on, "_part"], ["_kind", *inner, "_point"], solve, schema, unread=["_point"])


WINDOWS = 64
"""Keyframes whose windows are made in one task."""
CLOUDS = 400_000
"""Points of target clouds that are indexed together."""


def _first_turns(yaws: np.ndarray) -> np.ndarray:
    first = np.zeros((len(yaws), 3, 3))
    first[:, 2, 2] = 1.0
    first[:, 0, 0] = first[:, 1, 1] = np.cos(yaws)
    first[:, 1, 0], first[:, 0, 1] = np.sin(yaws), -np.sin(yaws)
    return first


def _placed(xyz: np.ndarray, poses: np.ndarray) -> np.ndarray:
    r = rpy_matrices(poses[:, 3:])
    return np.stack([r[:, i, 0] * xyz[:, 0] + r[:, i, 1] * xyz[:, 1] + r[:, i, 2] * xyz[:, 2] + poses[:, i] for i in range(3)], axis=1)


def _leaves(xyz: np.ndarray, leaf: float) -> tuple[np.ndarray, int]:
    """The number of each point's leaf among all leaves, in their order, and how many there are."""
    cells = np.floor(xyz / leaf)
    cells -= cells.min(axis=0)
    shape = cells.max(axis=0) + 1
    if np.prod(shape) < 2.0**52:
        numbers = (cells[:, 0] * shape[1] + cells[:, 1]) * shape[2] + cells[:, 2]
        found, codes = np.unique(numbers, return_inverse=True)
    else:
        found, codes = np.unique(cells, axis=0, return_inverse=True)
    return codes.ravel(), len(found)


def _centroids(group: np.ndarray, groups: int, codes: np.ndarray, leaves: int, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and centroid of each filled leaf, in the order of groups and leaves."""
    at = group * leaves + codes
    if groups * leaves <= 4 * len(at) + 1024:
        number = np.bincount(at, minlength=groups * leaves)
        filled = np.flatnonzero(number)
        sums = [np.bincount(at, weights=xyz[:, i], minlength=groups * leaves)[filled] for i in range(3)]
        return filled // leaves, np.stack(sums, axis=1) / number[filled][:, None]
    filled, where = np.unique(at, return_inverse=True)
    sums = [np.bincount(where, weights=xyz[:, i], minlength=len(filled)) for i in range(3)]
    return filled // leaves, np.stack(sums, axis=1) / np.bincount(where, minlength=len(filled))[:, None]


def align_windows(
    pairs: DataFrame, keyframes: DataFrame, points: DataFrame, keys: Sequence[str], n: int, leaf: float, min_source: int, min_target: int,
    size: float = 1.0, max_d: float | None = None, rounds: int = 100, eps: float = 1e-6, together: int = WINDOWS,
) -> DataFrame:
    """``align_clouds`` of the cloud of each pair's keyframe ``cur_id`` to those of ``n`` keyframes on both sides of ``loop_id``.

    Clouds are placed by the poses in ``keyframes`` and reduced to one centroid per ``leaf``; pairs with smaller clouds than
    ``min_source`` and ``min_target`` points are left out. Windows overlap, so they are made where they are used: the points of
    some keyframes in a row and of ``n`` on both sides go to one task, which takes the windows out of them. So a point is sent
    once or twice, not once for each window that holds it. A keyframe that lies in these stretches isn't sent again as a source.
    ``together`` pairs go to one task; stretches of more pairs go to several. ``pairs`` name each pair once, with ``yaw``.
    """
    keys, b = list(keys), WINDOWS
    at = [*keys, "_block", "_part"]
    posed = keyframes.select(*keys, F.col("kf_id").alias("cur_id"), *[F.col(f).cast("double").alias(f"_p_{f}") for f in FIELDS])
    wanted = pairs.select(*keys, "cur_id", "loop_id", F.col("yaw").cast("double").alias("_yaw"), F.floor(F.col("loop_id") / b).alias("_block"))
    parts = wanted.groupBy(*keys, "_block").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("_parts"))
    split = cut(parts.where("_parts > 1"))
    dealt = wanted.join(posed.hint("merge"), [*keys, "cur_id"]).withColumn("_part", F.lit(0))
    several = not split.isEmpty()
    if several:
        part = F.pmod(F.xxhash64("cur_id", "loop_id"), F.coalesce("_parts", F.lit(1))).cast("int")
        dealt = dealt.drop("_part").join(split, [*keys, "_block"], "left").withColumn("_part", part).drop("_parts")
    low, high = F.col("_block") * b - n, F.col("_block") * b + b + n
    dealt = cut(dealt.withColumn("_far", ~((F.col("cur_id") >= low) & (F.col("cur_id") < high))))

    def around(df: DataFrame) -> DataFrame:
        first = F.greatest(F.floor((F.col("kf_id") - n) / b), F.least(F.lit(0).cast("long"), F.floor(F.col("kf_id") / b)))
        out = df.withColumn("_block", F.explode(F.sequence(first, F.floor((F.col("kf_id") + n) / b)))).withColumn("_part", F.lit(0))
        if several:
            out = out.drop("_part").join(split, [*keys, "_block"], "left")
            out = out.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        return out

    def rows(df: DataFrame, kind: int, a: str, other: str | None, place: Sequence[Column], yaw: Column | None = None) -> DataFrame:
        none = F.lit(0.0)
        place = [p.cast("double") for p in place]
        return df.select(
            *at, F.lit(kind).alias("_kind"), F.col(a).cast("long").alias("_a"), (F.col(other).cast("long") if other else F.lit(0).cast("long")).alias("_b"),
            *[p.alias(f"_x{i}") for i, p in enumerate([*place, *[none] * (6 - len(place))])], (none if yaw is None else yaw).alias("_yaw"),
        )

    xyz = [F.col(c) for c in XYZ]
    sent = rows(around(keyframes.select(*keys, "kf_id", *FIELDS)), 0, "kf_id", None, [F.col(f) for f in FIELDS])
    sent = sent.unionByName(rows(around(points.select(*keys, "kf_id", *XYZ).dropna()), 1, "kf_id", None, xyz))
    sent = sent.unionByName(rows(dealt, 2, "loop_id", "cur_id", [F.col(f"_p_{f}") for f in FIELDS], F.coalesce("_yaw", F.lit(0.0))))
    far = dealt.where("_far").select(*at, "cur_id", "loop_id")
    if not far.isEmpty():
        own = points.select(*keys, F.col("kf_id").alias("cur_id"), *XYZ).dropna()
        sent = sent.unionByName(rows(own.join(far.hint("merge"), [*keys, "cur_id"]), 3, "loop_id", "cur_id", xyz))
    schema = T.StructType(
        [*(pairs.schema[c] for c in [*keys, "cur_id", "loop_id"]), *(T.StructField(c, T.DoubleType()) for c in [*NAMES, "fitness"]),
         T.StructField("rounds", T.IntegerType()), T.StructField("converged", T.BooleanType())]
    )
    types = {c: pairs.schema[c].dataType for c in ("cur_id", "loop_id")}

    def targets(loops: np.ndarray, kf: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of loops in ``loops``, the clouds of their windows that are large enough, and whose points those are."""
        if not len(kf):
            return
        codes, leaves = _leaves(place, leaf)
        begin, end = np.searchsorted(kf, loops - n, "left"), np.searchsorted(kf, loops + n, "right")
        upto = np.cumsum(end - begin)
        first = 0
        while first < len(loops):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + 4 * CLOUDS, "right")))
            sizes = (end - begin)[first:last]
            group = np.repeat(np.arange(last - first), sizes)
            some = np.arange(len(group)) + np.repeat(begin[first:last] - (np.cumsum(sizes) - sizes), sizes)
            if len(some):
                of, xyz = _centroids(group, last - first, codes[some], leaves, place[some])
                enough = np.bincount(of, minlength=last - first) >= max(1, min_target)
                kept = enough[of]
                yield first + np.flatnonzero(enough), (np.cumsum(enough) - 1)[of[kept]], xyz[kept]
            first = last

    def solve(table: pa.Table, held: list[tuple]) -> pa.RecordBatch:
        """Alignments of the pairs in ``held``: target clouds with their points, and rows of pairs with their sources."""
        goal, cloud, row, source, of = [], [], [], [], []
        clouds_, pairs_ = 0, 0
        for number, goal_of, goal_xyz, pair_rows, pair_cloud, own_of, own_xyz in held:
            goal.append(goal_xyz)
            cloud.append((goal_of + clouds_, pair_cloud + clouds_))
            row.append(pair_rows)
            source.append(own_xyz)
            of.append(own_of + pairs_)
            clouds_, pairs_ = clouds_ + number, pairs_ + len(pair_rows)
        row, of = np.concatenate(row), np.concatenate(of)
        index = clouds.CloudIndex(np.concatenate([c[0] for c in cloud]), np.concatenate(goal), size)
        begin = np.searchsorted(of, np.arange(len(row)))
        first = _first_turns(table.column("_yaw").to_numpy()[row])
        found = clouds.align(index, np.concatenate([c[1] for c in cloud]), np.concatenate(source), begin, max_d, rounds, eps, first)
        flat = np.concatenate([found["rotation"].reshape(-1, 9), found["shift"]], axis=1)
        pick = pa.array(row)
        columns = [table.column(c).take(pick).combine_chunks() for c in keys]
        columns += [table.column(c).take(pick).combine_chunks().cast(pa.int32() if types[name] == T.IntegerType() else pa.int64()) for name, c in (("cur_id", "_b"), ("loop_id", "_a"))]
        columns += [pa.array(np.ascontiguousarray(v)) for v in flat.T]
        columns += [pa.array(found["fitness"]), pa.array(found["rounds"].astype(np.int32)), pa.array(found["converged"])]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def piece(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, a, other = (table.column(c).to_numpy() for c in ("_kind", "_a", "_b"))
        x = [table.column(f"_x{i}").to_numpy() for i in range(6)]
        held: list[tuple] = []
        weight = 0
        for start, stop in zip(starts, [*starts[1:], table.num_rows]):
            p, q, r = start + np.searchsorted(kind[start:stop], [1, 2, 3])
            if q == r:
                continue
            known, poses = a[start:p], np.stack([v[start:p] for v in x], axis=1)
            kf, place = a[p:q], np.stack([v[p:q] for v in x[:3]], axis=1)
            posed = np.searchsorted(known, kf)
            fine = np.zeros(len(kf), bool) if not len(known) else known[np.minimum(posed, len(known) - 1)] == kf
            kf, place, posed = kf[fine], place[fine], posed[fine]
            place = _placed(place, poses[posed]) if len(kf) else place
            real = np.isfinite(place).all(axis=1)
            kf, place = kf[real], place[real]
            loops, loop_of = np.unique(a[q:r], return_inverse=True)
            # The source of a pair: points of the stretch if it lies there, else those sent for it.
            cur, pair_pose = other[q:r], np.stack([v[q:r] for v in x], axis=1)
            block = a[q] // b * b
            near = (cur >= block - n) & (cur < block + b + n)
            begin, end = np.searchsorted(kf, cur, "left"), np.searchsorted(kf, cur, "right")
            sizes = np.where(near, end - begin, 0)
            own_of = np.repeat(np.arange(r - q), sizes)
            own = place[np.arange(len(own_of)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)]
            if r < stop:
                code = pd.MultiIndex.from_arrays([a[q:r], cur]).get_indexer(pd.MultiIndex.from_arrays([a[r:stop], other[r:stop]]))
                more = _placed(np.stack([v[r:stop] for v in x[:3]], axis=1), pair_pose[code])
                real = np.isfinite(more).all(axis=1)
                own_of, own = np.concatenate([own_of, code[real]]), np.concatenate([own, more[real]])
            if not len(own):
                continue
            codes, leaves = _leaves(own, leaf)
            own_of, own = _centroids(own_of, r - q, codes, leaves, own)
            large = np.bincount(own_of, minlength=r - q) >= max(1, min_source)
            for which, goal_of, goal_xyz in targets(loops, kf, place):
                number = np.full(len(loops), -1)
                number[which] = np.arange(len(which))
                chosen = np.flatnonzero(large & (number[loop_of] >= 0))
                if not len(chosen):
                    continue
                renamed = np.full(r - q, -1)
                renamed[chosen] = np.arange(len(chosen))
                mine = renamed[own_of] >= 0
                held.append((len(which), goal_of, goal_xyz, q + chosen, number[loop_of[chosen]], renamed[own_of[mine]], own[mine]))
                weight += len(goal_xyz) + int(mine.sum())
                if weight >= CLOUDS:
                    yield solve(table, held)
                    held, weight = [], 0
        if held:
            yield solve(table, held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in table_runs(batches, at):
            yield from piece(table, starts)

    return _dealt(sent, at).sortWithinPartitions(*at, "_kind", "_a", "_b").mapInArrow(scan, schema)
