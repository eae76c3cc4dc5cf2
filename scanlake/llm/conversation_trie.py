"""The prefix trie of conversations, as balanced parentheses.

A turn is known by a 128-bit digest of its fields, a sequence of turns by four sums of powers modulo a
prime of 31 bits, which can be added up over parts of a conversation. Conversations are cut into segments of ``SEGMENT``
turns. A segment's key is its level, the sum of what comes before it, and its turns; equal segments are counted
first, so copies are one row, and the rest is sorted by key over all tasks.

A task reads its stretch of the sorted segments in shards of about ``UNITS`` turns. A shard's trie is written as
parentheses, an opening one for each node in preorder: of each segment, those beyond what it shares with the one
before. The excess of opening over closing ones is kept with minima of blocks and a tree of minima above
them, in which all closing parentheses are found at once. They delimit the subtrees, so that leaves are ranks of
the pair "()", and members and savings are differences of cumulative arrays.

Nodes that another shard may have too lie on the path of a shard's first or last segment: its spines. Their
counts are partial and are added up over shards; where two shards meet, what both counted is taken back once.
Segments that go on at the next level have their path among the spines too, and take in the sums of that level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import append, in_batches
from scanlake.session import cut

#: Turns of a segment, turns of a shard, positions of a block of excess, and ids that are packed into one row.
SEGMENT, UNITS, BLOCK, PACKED = 256, 200_000, 64, 50_000
PRIME = (1 << 31) - 1
#: Where the four sums are taken: any numbers below the prime.
BASES = (1_103_515_245, 1_664_525, 214_013, 2_147_001_325)
INNER, SPINE, PIECE, FIRST, LAST, PATH = range(6)
ROW = (
    "kind int, node binary, depth long, parent binary, parent_conv long, conv long, n long, n_end long, children long, "
    "leaves long, saved long, part int, shard int, key binary, words binary, goes_on boolean"
)
NO_IDS = hashlib.sha256(b"").hexdigest()


def read_turns(
    rows: DataFrame, key: str = "conv_id", order: str = "turn", fields: tuple[str, ...] = ("role", "text"), text: str = "text"
) -> DataFrame:
    """``conv, pos, sym, words``: each turn's place in its conversation from 0, digest of its fields and words of its text.

    Turns are in ``order``, null first, equal ones by digest. Null fields count as empty. Rows without a key belong to no
    conversation and are left out. Repeated rows are turns of their own.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    framed = F.concat(*[part for f in filled for part in (F.octet_length(f).cast("string"), F.lit(":"), f)])
    turns = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(order).cast("long").alias("turn"), F.unhex(F.md5(framed)).alias("sym"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"),
    )
    return _number(cut(turns))


def _number(turns: DataFrame) -> DataFrame:
    """Places by a sort over all tasks: a place within the task's stretch, plus what the stretches before have."""
    dealt = turns.repartitionByRange("conv", "turn", "sym").sortWithinPartitions("conv", "turn", "sym")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            sizes = np.diff(begin, append=len(conv))
            place = np.arange(len(conv)) - np.repeat(begin, sizes)
            if last == conv[0]:
                place[: sizes[0]] += seen
            last, seen = conv[-1], int(place[-1]) + 1
            yield append(batch, part=pa.array(np.full(len(conv), part), pa.int32()), pos=pa.array(place, pa.int64()))

    numbered = cut(dealt.transform(in_batches, scan, "conv long, turn long, sym binary, words int, part int, pos long"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    later = counts.withColumn("before", F.sum("n").over(before)).where(F.col("before") > 0).select("conv", "part", "before")
    # Only the conversation that a stretch begins with can have turns before it: a row per task at most.
    placed = numbered.join(F.broadcast(later), ["conv", "part"], "left")
    return placed.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "sym", "words")


def borrow_heads(turns: DataFrame, span: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first of their ``span`` ids; and ``conv, size`` of every conversation.

    A conversation c begins with the first h turns of c - c % span (all, if there are fewer; none without it) and goes on
    with its own after its first h, if any, where h is the CRC-32 of the decimal c modulo ``most`` + 1. The remainder has
    the sign of c.
    """
    sizes = cut(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")))
    base, head = F.col("conv") - F.col("conv") % span, F.crc32(F.col("conv").cast("string")) % (most + 1)
    others = sizes.withColumn("base", base).where(F.col("conv") != F.col("base")).withColumn("head", head)
    bases = sizes.where(F.col("conv") % span == 0).select(F.col("conv").alias("base"), F.col("own").alias("offered"))
    known = others.join(bases, "base", "left").withColumn("got", F.least("head", F.coalesce("offered", F.lit(0))))
    lacking = known.where(F.col("got") < F.col("head")).select("conv", (F.col("head") - F.col("got")).alias("lack"))
    heads = turns.where((F.col("conv") % span == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "base")
    borrowed = heads.join(others.select("base", "conv", "head"), "base").where(F.col("pos") < F.col("head"))
    own = turns.where((F.col("conv") == base) | (F.col("pos") >= head)).join(lacking, "conv", "left")
    columns = ["conv", "pos", "sym", "words"]
    rebuilt = own.withColumn("pos", F.col("pos") - F.coalesce("lack", F.lit(0))).select(columns).union(borrowed.select(columns))
    ends = known.select("conv", (F.col("got") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("size"))
    return rebuilt, ends.union(sizes.where(F.col("conv") % span == 0).select("conv", F.col("own").alias("size")))


def _lanes(sym: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``[turn, 4]``: what each turn (16 bytes, as four numbers) adds to the sums at its place in the conversation."""
    places, back = np.unique(place, return_inverse=True)
    power = np.array([[pow(b, int(p) + 1, PRIME) for b in BASES] for p in places], np.uint64).reshape(-1, 4)
    return sym % np.uint64(PRIME) * power[back] % np.uint64(PRIME)


def _digests(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All digests of a batch's segments behind each other, and where each segment's begin."""
    sizes = pc.list_value_length(batch.column("syms")).to_numpy().astype(np.int64)
    values = b"".join(batch.column("syms").flatten().to_pylist())
    return np.frombuffer(values, ">u4").astype(np.uint64).reshape(-1, 4), np.concatenate([[0], np.cumsum(sizes)])


def _sums(batch: pa.RecordBatch, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments' sums ``[segment, 4]``, digests, and their bounds."""
    sym, bounds = _digests(batch)
    sizes = np.diff(bounds)
    level = np.repeat(batch.column("level").to_numpy(), sizes)
    added = _lanes(sym, level * segment + np.arange(len(sym)) - np.repeat(bounds[:-1], sizes))
    upto = np.concatenate([np.zeros((1, 4), np.uint64), np.cumsum(added, axis=0, dtype=np.uint64)])
    return (upto[bounds[1:]] - upto[bounds[:-1]]) % np.uint64(PRIME), sym, bounds


def _as_bytes(sums: np.ndarray) -> np.ndarray:
    """Sums as 16 bytes each."""
    return np.ascontiguousarray(sums.astype(">u4")).view("V16").ravel()


def _segments(turns: DataFrame, sizes: DataFrame, segment: int) -> DataFrame:
    """``conv, key, words, node, goes_on``: the segments of all conversations; ``node`` is where one ends."""
    cells = turns.groupBy("conv", F.floor(F.col("pos") / segment).cast("int").alias("level")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "sym", "words"))).alias("turns")
    )
    long = sizes.where(F.col("size") > segment).select("conv", F.ceil(F.col("size") / segment).cast("int").alias("levels"))
    bare = sizes.where(F.col("size") == 0).select(
        "conv", F.lit(0).alias("level"), F.array().cast("array<binary>").alias("syms"), F.array().cast("array<int>").alias("words"),
        F.lit(False).alias("goes_on"),
    )
    cells = cut(
        cells.join(long, "conv", "left")
        .select(
            "conv", "level", F.col("turns.sym").alias("syms"), F.col("turns.words").alias("words"),
            (F.col("level") + 1 < F.coalesce("levels", F.lit(1))).alias("goes_on"),
        )
        .unionByName(bare)
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _sums(batch, segment)[0].astype(np.int64)
            yield append(batch.select(["conv", "level"]), **{f"s{k}": pa.array(sums[:, k]) for k in range(4)})

    many = cells.join(long.select("conv"), "conv", "left_semi")
    narrow = many.transform(in_batches, add, "conv long, level int, s0 long, s1 long, s2 long, s3 long")
    before = Window.partitionBy("conv").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    roots = narrow.select("conv", "level", *[(F.sum(f"s{k}").over(before) % PRIME).alias(f"r{k}") for k in range(4)])
    rooted = cells.join(roots.where(F.col("level") > 0), ["conv", "level"], "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sym, bounds = _sums(batch, segment)
            root = np.stack([batch.column(f"r{k}").fill_null(0).to_numpy() for k in range(4)], axis=1).astype(np.uint64)
            words = np.ascontiguousarray(batch.column("words").flatten().to_numpy(zero_copy_only=False), "<i4").tobytes()
            turns = sym.astype(">u4").tobytes()
            level = batch.column("level").to_pylist()
            heads = [a.to_bytes(4, "big") + b.tobytes() for a, b in zip(level, _as_bytes(root))]
            spans = list(zip(heads, bounds[:-1].tolist(), bounds[1:].tolist()))
            yield append(
                batch.select(["conv", "goes_on"]), key=pa.array([h + turns[16 * a : 16 * b] for h, a, b in spans], pa.binary()),
                words=pa.array([words[4 * a : 4 * b] for _, a, b in spans], pa.binary()),
                node=pa.array([v.tobytes() for v in _as_bytes((root + sums) % np.uint64(PRIME))], pa.binary()),
            )

    return cut(rooted.transform(in_batches, scan, "conv long, goes_on boolean, key binary, words binary, node binary"))


def find_close(excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each opening parenthesis the position of its closing one: the first behind it with an excess below its own.

    ``excess`` is that after each position. What isn't found within a block is looked for in a tree of minima: up and to
    the right until a node reaches low enough, then down to the first block that does.
    """
    below = excess[opens] - 1
    size = -(-(len(excess) + 1) // BLOCK) * BLOCK
    padded = np.full(size, np.iinfo(np.int64).max)
    padded[: len(excess)] = excess
    blocks = padded.reshape(-1, BLOCK)
    found = np.full(len(opens), -1, np.int64)
    active, at = np.arange(len(opens)), opens + 1
    while len(active):
        hit = padded[at] <= below[active]
        found[active[hit]] = at[hit]
        active, at = active[~hit], at[~hit] + 1
        inside = at % BLOCK != 0
        active, at = active[inside], at[inside]
    left = np.flatnonzero(found < 0)
    if not len(left):
        return found
    levels = [blocks.min(axis=1)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
        levels.append(low.reshape(-1, 2).min(axis=1))
    tree = np.concatenate([np.append(v, [np.iinfo(np.int64).max] * 2) for v in levels])
    offset = np.cumsum([0, *(len(v) + 2 for v in levels)])
    level, node, want = np.zeros(len(left), np.int64), opens[left] // BLOCK + 1, below[left]
    climbing = np.arange(len(left))
    while len(climbing):
        high = tree[offset[level[climbing]] + node[climbing]] > want[climbing]
        climbing = climbing[high]
        up = node[climbing] % 2 == 1
        node[climbing] = np.where(up, (node[climbing] + 1) // 2, node[climbing] + 1)
        level[climbing] += up
    falling = np.flatnonzero(level > 0)
    while len(falling):
        level[falling] -= 1
        node[falling] *= 2
        node[falling] += tree[offset[level[falling]] + node[falling]] > want[falling]
        falling = falling[level[falling] > 0]
    for begin in range(0, len(left), 4096):
        some = slice(begin, begin + 4096)
        found[left[some]] = node[some] * BLOCK + (blocks[node[some]] <= want[some, None]).argmax(axis=1)
    return found


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for many ranges, none of them empty."""
    rows = [values]
    while 2 ** len(rows) <= len(values):
        half = 2 ** (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    power = np.log2(high - low).astype(np.int64)
    out = np.empty(len(low), values.dtype)
    for k, row in enumerate(rows):
        at = np.flatnonzero(power == k)
        out[at] = np.minimum(row[low[at]], row[high[at] - 2**k])
    return out


class _Shard:
    """The trie of sorted, distinct segments. A unit is a turn; a segment's unit 0 is what it starts from."""

    def __init__(self, keys: list[bytes], words: list[bytes], conv: np.ndarray, n: np.ndarray, n_end: np.ndarray, segment: int):
        self.sizes = np.array([(len(k) - 4) // 16 for k in keys], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        units = np.frombuffer(b"".join(k[4:] for k in keys), ">u4").astype(np.uint64).reshape(-1, 4)
        self.level = np.array([int.from_bytes(k[:4], "big") for k in keys], np.int64)
        self.words = np.frombuffer(b"".join(b"\0\0\0\0" + w for w in words), "<i4").astype(np.int64)
        self.conv, self.n, self.n_end, self.segment = conv, n, n_end, segment
        self.unit = np.arange(len(units)) - np.repeat(self.starts, self.sizes)
        self.shared = self._shared(units)
        self.hashes = self._hashes(units)

    def _shared(self, units: np.ndarray) -> np.ndarray:
        """How many units each segment has in common with the one before."""
        shared = np.zeros(len(self.sizes), np.int64)
        if len(self.sizes) > 1:
            both = np.minimum(self.sizes[1:], self.sizes[:-1])
            begin = np.cumsum(both) - both
            step = np.arange(both.sum()) - np.repeat(begin, both)
            differs = (units[np.repeat(self.starts[1:], both) + step] != units[np.repeat(self.starts[:-1], both) + step]).any(axis=1)
            shared[1:] = np.minimum.reduceat(np.where(differs, step, np.repeat(both, both)), begin)
            shared[1:][self.level[1:] != self.level[:-1]] = 0
        return shared

    def _hashes(self, units: np.ndarray) -> np.ndarray:
        """The sums of the turns up to each unit, as 16 bytes."""
        first = self.unit == 0
        place = np.repeat(self.level, self.sizes) * self.segment + self.unit - 1
        added = np.where(first[:, None], units, 0).astype(np.uint64)
        added[~first] = _lanes(units[~first], place[~first])
        upto = np.concatenate([np.zeros((1, 4), np.uint64), np.cumsum(added, axis=0, dtype=np.uint64)])
        return _as_bytes((upto[1:] - np.repeat(upto[self.starts], self.sizes, axis=0)) % np.uint64(PRIME))

    def rows(self, part: int, shard: int, keys: list[bytes], words: list[bytes]) -> Iterator[pa.RecordBatch]:
        new = self.sizes - self.shared
        segment = np.repeat(np.arange(len(new)), new)
        unit = np.arange(new.sum()) - np.repeat(np.cumsum(new) - new, new) + np.repeat(self.shared, new)
        flat = self.starts[segment] + unit
        closing = np.concatenate([[0], self.sizes[:-1] - self.shared[1:]])
        counts = np.append(np.stack([closing, new], axis=1).ravel(), self.sizes[-1])
        bits = np.repeat(np.append(np.tile([-1, 1], len(new)), -1), counts)
        opens = np.flatnonzero(bits > 0)
        closes = find_close(np.cumsum(bits), opens)
        first = np.arange(len(opens))
        after = first + (closes - opens + 1) // 2

        def subtree(values: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(values)])
            return upto[after] - upto[first]

        ends = np.cumsum(new) - 1
        goes_on = self.n > self.n_end
        members, leaf, ended = (np.zeros(len(opens), np.int64) for _ in range(3))
        members[ends], ended[ends] = self.n, self.n_end
        leaf[ends] = (closes[ends] == opens[ends] + 1) & ~goes_on
        n = subtree(members)
        word = self.words[flat]
        conv = _range_min(self.conv, segment, np.concatenate([segment, [len(new)]])[after])
        parent, spine = self._parents(new, goes_on)
        top = unit == 0
        known = ~top & ~spine & ~(spine | top)[parent]
        depth = self.level[segment] * self.segment + unit
        kind = np.where(top & (self.level[segment] > 0), PIECE, np.where(spine, SPINE, INNER))
        node = self.hashes[flat]
        none = np.zeros(len(opens), bool)
        yield _batch(
            kind=kind, node=_binary(node), depth=depth, parent=_binary(node[parent], known | top),
            parent_conv=pa.array(conv[parent], mask=~known), conv=conv, n=n, n_end=ended,
            children=np.bincount(parent[~top], minlength=len(opens)), leaves=subtree(leaf), saved=subtree((n - 1) * word),
            part=none + part, shard=none + shard,
        )
        edges = [0, len(keys) - 1]
        yield _batch(
            kind=np.array([FIRST, LAST]), part=np.full(2, part), shard=np.full(2, shard), key=pa.array([keys[k] for k in edges], pa.binary()),
            words=pa.array([words[k] for k in edges], pa.binary()), goes_on=pa.array(goes_on[edges]),
        )
        paths = np.flatnonzero(goes_on)
        if len(paths):
            yield _batch(
                kind=np.full(len(paths), PATH), node=_binary(self.hashes[(self.starts + self.sizes - 1)[paths]]),
                depth=(self.level[paths] + 1) * self.segment,
                key=pa.array([self.hashes[self.starts[k] : self.starts[k] + self.sizes[k]].tobytes() for k in paths], pa.binary()),
            )

    def _parents(self, new: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's parent (a top is its own), and whether it lies on a spine."""
        total = int(new.sum())
        parent = np.arange(total) - 1
        spine = np.zeros(total, bool)
        path: list[int] = []
        begin = 0
        for at, (shared, more, onward) in enumerate(zip(self.shared.tolist(), new.tolist(), goes_on.tolist())):
            parent[begin] = path[shared - 1] if shared else begin
            del path[shared:]
            path.extend(range(begin, begin + more))
            begin += more
            if onward or at in (0, len(new) - 1):
                spine[path] = True
        return parent, spine


def _binary(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """16 bytes each; null where ``mask`` is set."""
    return pa.array([None if m else v.tobytes() for v, m in zip(values, np.zeros(len(values), bool) if mask is None else mask)], pa.binary())


def _batch(**columns) -> pa.RecordBatch:
    """A record batch of ``ROW``; columns that aren't given are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    rows = len(next(iter(columns.values())))
    arrays, names = [], []
    for name, kind in (field.split() for field in ROW.split(", ")):
        value = columns.get(name)
        names.append(name)
        if value is None:
            arrays.append(pa.nulls(rows, kinds[kind]))
        else:
            arrays.append(value.cast(kinds[kind]) if isinstance(value, pa.Array) else pa.array(value, kinds[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _shards(segment: int, units: int):
    """The rows of the shards of a task's stretch of sorted segments, of about ``units`` turns each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def built() -> Iterator[pa.RecordBatch]:
            keys, words, *counts = (list(c) for c in zip(*held))
            yield from _Shard(keys, words, *(np.array(c, np.int64) for c in counts), segment).rows(part, shard, keys, words)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "conv", "n", "n_end"))):
                held.append(row)
                size += len(row[0]) // 16
                if size >= units:
                    yield from built()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield from built()

    return scan


def _corrections(segment: int):
    """What two shards that meet both counted: for nodes shared by the last segment of one and the first of the next."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other, words, goes_on in zip(*(batch.column(c).to_pylist() for c in ("key", "next_key", "words", "goes_on"))):
                if one[:20] != other[:20]:
                    continue
                both = _Shard([one, other], [words, words.ljust(len(other) // 4 - 5, b"\0")], *np.zeros((3, 2), np.int64), segment)
                shared, level = int(both.shared[1]), int(both.level[0])
                unit, none = np.arange(shared), np.zeros(shared, np.int64)
                ends_there = shared == both.sizes[0] and not goes_on
                yield _batch(
                    kind=np.where((unit == 0) & (level > 0), PIECE, SPINE), node=_binary(both.hashes[:shared]),
                    depth=level * segment + unit, n=none, n_end=none, children=-(unit + 1 < shared).astype(np.int64),
                    leaves=none - int(ends_there), saved=np.cumsum(both.words[:shared][::-1])[::-1].copy(),
                )

    return scan


def build(turns: DataFrame, sizes: DataFrame, segment: int = SEGMENT, units: int = UNITS) -> DataFrame:
    """A row per node of the trie of all conversations: those that begin with the same ``depth`` turns are its members.

    ``turns`` has ``conv, pos, sym, words`` with places from 0 without gaps, ``sizes`` has ``conv, size`` of every
    conversation, those without turns too, which are members of the root only. Columns: ``node`` (16 bytes), ``depth``,
    ``conv_id`` (smallest member), ``parent_conv_id`` (the parent's; of the root null), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes in the subtree, the node included), ``saved_tokens`` (summed over the subtree, the node's
    members less one times the words of its last turn), ``ends_sha256`` (of the ids of members that end here, ascending
    and comma-joined). Without conversations there are no rows.
    """
    segments = _segments(turns, sizes, segment)
    counted = segments.groupBy("key").agg(
        F.first("words").alias("words"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("goes_on")).alias("n_end"),
    )
    dealt = counted.repartitionByRange("key").sortWithinPartitions("key")
    found = cut(dealt.transform(in_batches, _shards(segment, units), ROW))
    measures = ["children", "leaves", "saved"]
    spine = found.where(F.col("kind").isin(SPINE, PIECE)).unionByName(_where_shards_meet(found, segment))
    pieces = spine.where(F.col("kind") == PIECE).select("node", "depth", *measures)
    carried = _carry(pieces, found.where(F.col("kind") == PATH).select("node", "depth", "key"), segment)
    spine = spine.where(F.col("kind") == SPINE).select("node", "depth", "parent", "conv", "n", "n_end", *measures)
    if carried is not None:
        spine = spine.unionByName(carried, allowMissingColumns=True)
    merged = cut(
        spine.groupBy("node", "depth").agg(
            F.first("parent", ignorenulls=True).alias("parent"), F.min("conv").alias("conv"),
            *[F.sum(c).alias(c) for c in ("n", "n_end", *measures)],
        )
    )
    first = sizes.agg(F.min("conv")).first()[0]
    inner = found.where(F.col("kind") == INNER)
    columns = ["node", "depth", "conv", "parent_conv", "n", "n_end", *measures]
    # Nodes under the root have its smallest member as parent; the rest is joined with the spines, which are few.
    searched = inner.where(F.col("parent").isNotNull()).select(merged.columns).unionByName(merged)
    near, far = searched.where(F.col("depth") <= 1), searched.where(F.col("depth") > 1)
    near = near.withColumn("parent_conv", F.when(F.col("depth") == 1, F.lit(first).cast("long")))
    spines = merged.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv"))
    far = far.join(spines, ["parent", "depth"], "left")
    nodes = inner.where(F.col("parent_conv").isNotNull()).select(columns).unionByName(near.select(columns)).unionByName(far.select(columns))
    ends = segments.where(~F.col("goes_on")).select("node", "conv")
    with_ends = nodes.where(F.col("n_end") > 0).join(_ids_digest(ends), "node")
    return with_ends.unionByName(nodes.where(F.col("n_end") == 0).withColumn("ends_sha256", F.lit(NO_IDS))).select(
        "node", "depth", F.col("conv").alias("conv_id"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def _where_shards_meet(found: DataFrame, segment: int) -> DataFrame:
    """The corrections at the borders of shards. The one ordered window has a row per shard."""
    shards = found.where(F.col("kind") == FIRST).select("part", "shard")
    order = Window.orderBy("part", "shard")
    following = shards.select("part", "shard", F.lead("part").over(order).alias("next_part"), F.lead("shard").over(order).alias("next_shard"))
    lasts = found.where(F.col("kind") == LAST).select("part", "shard", "key", "words", "goes_on")
    firsts = found.where(F.col("kind") == FIRST).select(
        F.col("part").alias("next_part"), F.col("shard").alias("next_shard"), F.col("key").alias("next_key")
    )
    pairs = lasts.join(following, ["part", "shard"]).join(firsts, ["next_part", "next_shard"])
    return pairs.select("key", "next_key", "words", "goes_on").transform(in_batches, _corrections(segment), ROW)


def _carry(pieces: DataFrame, paths: DataFrame, segment: int) -> DataFrame | None:
    """What the nodes on ``paths`` get from the levels below: a round per level, from the deepest up.

    The sums of a level's tops go to the segment that leads there, its nodes and its top.
    """
    deepest = paths.agg(F.max("depth")).first()[0]
    if deepest is None:
        return None
    every: list[DataFrame] = []
    above: DataFrame | None = None
    for depth in range(deepest, 0, -segment):
        tops = pieces.where(F.col("depth") == depth).drop("depth")
        tops = tops if above is None else tops.unionByName(above)
        sums = tops.groupBy("node").agg(*[F.sum(c).alias(c) for c in tops.columns if c != "node"])
        place = F.explode(F.sequence(F.lit(0), F.lit(segment))).alias("unit")
        led = paths.where(F.col("depth") == depth).join(sums, "node").select("*", place)
        handed = cut(
            led.select(
                F.substring("key", F.col("unit") * 16 + 1, F.lit(16)).alias("node"), (F.col("unit") + depth - segment).cast("long").alias("depth"),
                F.when(F.col("unit") == segment, F.col("children")).otherwise(0).alias("children"), "leaves", "saved",
            )
        )
        above = handed.where(F.col("depth") == depth - segment).drop("depth")
        every.append(handed if depth == segment else handed.where(F.col("depth") > depth - segment))
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out.withColumns({"n": F.lit(0).cast("long"), "n_end": F.lit(0).cast("long")})


def _ids_digest(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` from ``node, conv``.

    Ids are sorted over all tasks. A node whose ids lie within one stretch is digested there; of others, the ids go on in
    packed rows, in which one task reads even a node of very many ids without holding more than a row.
    """
    dealt = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, True
        node, ids = None, []
        out: list[tuple] = []

        def flush(whole: bool) -> None:
            nonlocal number
            text = ",".join(map(str, ids))
            out.append((node, part, number, text, None) if not whole else (node, part, 0, None, hashlib.sha256(text.encode()).hexdigest()))
            number += 1

        for batch in batches:
            for this, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()):
                if this != node:
                    if node is not None:
                        flush(whole=not first and number == 0)
                        first = False
                    node, ids, number = this, [], 0
                ids.append(conv)
                if len(ids) == PACKED:
                    flush(whole=False)
                    ids = []
            yield _packed(out)
            out.clear()
        if ids:
            flush(whole=False)
        yield _packed(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for this, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if not text:
                    continue
                if this != node:
                    if node is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = this, hashlib.sha256(text.encode())
                else:
                    sha.update(f",{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])

    packed = cut(dealt.transform(in_batches, pack, "node binary, part int, number int, ids string, ends_sha256 string"))
    parts = packed.where(F.col("ids").isNotNull()).repartition("node").sortWithinPartitions("node", "part", "number")
    rest = parts.select("node", "ids").transform(in_batches, digest, "node binary, ends_sha256 string")
    return packed.where(F.col("ends_sha256").isNotNull()).select("node", "ends_sha256").unionByName(rest)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "part", "number", "ids", "ends_sha256"])
