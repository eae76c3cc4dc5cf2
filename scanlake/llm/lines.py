"""Fuzzy line deduplication over a whole corpus.

Lines are compared in lower case with white space made single spaces. Each distinct line has a
MinHash signature of its character shingles, cut into bands; lines that agree in a band are
candidates, whose shingle sets are then compared exactly. Lines linked over any number of steps form
a component, and of a component one line, the first by document and position, is kept.

All lines of a band are compared, but no pair of them is ever a row. The lines of a band come together with
their texts; a band of many is dealt into blocks of bounded size by a hash, and each pair of
blocks is one row of one task. There the sets are bit rows, intersections are counted for a line against
all others at once, and what leaves the task is a star per component found. Bands of the same lines, as
near copies have many, are looked at once.

Texts are not shuffled but for candidates: bands and positions are rows of numbers, and the texts of
candidates are picked by a second scan that knows them by a bit array of fixed size (which lets
some others through; a join takes those out).

A line is known by the 64-bit hash of its compared form. Two different lines of one hash would count as
one; among 6 billion distinct lines one such pair is expected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.llm.common import components, forest, in_batches
from scanlake.session import cut

SHINGLE = 8
#: Bands of rows: at a similarity of 0.8 a pair shares a band with a probability of 0.9998.
BANDS, ROWS = 16, 4
FILTER_BITS = 1 << 24
PIECE = 200_000
#: A block of lines to be compared holds about as many lines or characters.
BLOCK_LINES, BLOCK_CHARS = 1024, 512_000
#: So many lines are compared pair by pair; bit rows pay for more.
FEW = 6
#: Few lines of fewer characters altogether are compared as sets of strings, others as sorted numbers.
SHORT = 800
_RANDOM = np.random.default_rng(12)
MULTIPLY = (_RANDOM.integers(0, 2**31, BANDS * ROWS, np.int64) * 2 + 1).astype(np.uint32)
ADD = _RANDOM.integers(0, 2**32, BANDS * ROWS, np.int64).astype(np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def compared(line: str) -> str:
    return " ".join(line.lower().split())


def line_hash(line: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(line.encode())).astype(np.int64))


def shingles(line: str) -> set[str]:
    """All runs of ``SHINGLE`` characters; a shorter line is one shingle as a whole."""
    return {line[k : k + SHINGLE] for k in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def signatures(lines: list[str]) -> np.ndarray:
    """A band value per line and band, as signed 64-bit integers."""
    least = np.full((len(lines), BANDS * ROWS), np.uint32(0xFFFFFFFF))
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for k, line in enumerate(lines):
        line = line.ljust(SHINGLE, "\0")
        for at in range(0, max(1, len(line) - SHINGLE + 1), PIECE):
            parts.append(line[at : at + PIECE + SHINGLE - 1])
            owners.append(k)
            held += len(parts[-1])
            if held > PIECE:
                _lower(least, owners, parts)
                owners, parts, held = [], [], 0
    if parts:
        _lower(least, owners, parts)
    bands = least.reshape(len(lines), BANDS, ROWS).astype(np.uint64)
    value = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * MIX
    for r in range(ROWS):
        value = (value ^ bands[:, :, r]) * MIX
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def _lower(least: np.ndarray, owners: list[int], parts: list[str]) -> None:
    """Lowers the minima of the owners by the shingles of their parts."""
    sizes = np.array([len(p) for p in parts])
    h = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    factor = int(MIX)
    for step in (1, 2, 4):
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % 2**64
    inside = np.ones(len(h), bool)
    for back in range(1, SHINGLE):
        ends = np.cumsum(sizes)[:-1] - back
        inside[ends] = False
    h = h[inside]
    x = ((h ^ (h >> np.uint64(31))) * MIX >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])
    owner = np.asarray(owners)
    alone = len(set(owners)) == len(owners)
    for k in range(BANDS * ROWS):
        low = np.minimum.reduceat(x * MULTIPLY[k] + ADD[k], starts)
        if alone:
            least[owner, k] = np.minimum(least[owner, k], low)
        else:
            np.minimum.at(least[:, k], owner, low)


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, text_hash, line_no, line, bands`` of every line that isn't blank.

    ``line`` is the line's hash; ``bands`` is null where the line came before in the same batch.
    """
    schema = T.StructType(
        [T.StructField("doc", docs.schema[key].dataType), *T._parse_datatype_string("text_hash long, line_no int, line long, bands array<long>")]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            row, number, which, hashes = [], [], [], []
            for at, raw in enumerate(batch.column(text)):
                value = raw.as_py()
                hashes.append(xxhash.xxh64_intdigest((value or "").encode(), 42))
                for k, line in enumerate((value or "").split("\n")):
                    line = compared(line)
                    if line:
                        row.append(at)
                        number.append(k)
                        which.append(known.setdefault(line, len(known)))
            if not row:
                continue
            index = np.array(which)
            lines = list(known)
            line = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in lines], np.uint64).view(np.int64)[index]
            first = np.zeros(len(index), bool)
            first[np.unique(index, return_index=True)[1]] = True
            ends = np.concatenate([[0], np.cumsum(first * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(signatures(lines).ravel()), mask=pa.array(~first))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(row)), pa.array(np.array(hashes, np.uint64).view(np.int64)[row]),
                    pa.array(number, pa.int32()), pa.array(line), bands,
                ],
                names=schema.names,
            )

    return docs.select(key, text).transform(in_batches, scan, schema)


def _texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``line, compared`` for the wanted line hashes."""
    spot = F.pmod("line", F.lit(FILTER_BITS))
    words = wanted.groupBy(F.floor(spot / 64).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(line, {FILTER_BITS}) % 64 as int))")).alias("bits"))
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        filled[r.word] = r.bits
    held = docs.sparkSession.sparkContext.broadcast(filled.view(np.uint8))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            lines = {compared(line) for raw in batch.column(0) for line in (raw.as_py() or "").split("\n")} - {""}
            some = [(line_hash(x), x) for x in lines]
            some = [s for s in some if bits[s[0] % FILTER_BITS >> 3] >> (s[0] & 7) & 1]
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in some], t) for k, t in enumerate((pa.int64(), pa.string()))], names=["line", "compared"])

    found = docs.select(text).transform(in_batches, scan, "line long, compared string")
    return found.join(wanted, "line", "left_semi").dropDuplicates(["line"])


def _shingle_numbers(texts: list[str]) -> list[np.ndarray] | None:
    """Each line's distinct shingles as sorted 64-bit numbers that are equal exactly where the shingles are.

    A shingle is eight characters in eight bytes: their Latin-1 codes, or else numbers from 1 among the characters of all the
    lines. A shorter line is filled with zeros. None if the lines have more than 255 different characters.
    """
    joined = "".join(texts)
    try:
        small = np.frombuffer(joined.encode("latin-1"), np.uint8) if "\0" not in joined else None
    except UnicodeEncodeError:
        small = None
    if small is None:
        known, small = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        if len(known) > 255:
            return None
        small = (small + 1).astype(np.uint8)
    found, begin = [], 0
    for text in texts:
        line = small[begin : begin + len(text)]
        begin += len(text)
        if len(line) < SHINGLE:
            line = np.concatenate([line, np.zeros(SHINGLE - len(line), np.uint8)])
        numbers = np.lib.stride_tricks.sliding_window_view(line, SHINGLE).copy().view(np.uint64).ravel()
        numbers.sort()
        found.append(numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])])
    return found


def _pairs_of_few(sets: list[set[str]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    near = [
        (i, j) for j in range(len(sets)) for i in range(j)
        if min(len(sets[i]), len(sets[j])) >= threshold * max(len(sets[i]), len(sets[j]))
        and (both := len(sets[i] & sets[j])) >= threshold * (len(sets[i]) + len(sets[j]) - both)
    ]
    return np.array([i for i, _ in near], np.int64), np.array([j for _, j in near], np.int64)


def block_links(texts: list[str], sides: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of lines whose shingle sets are similar enough, exactly; of many lines one star per component.

    ``sides`` has the block of each line; with two blocks, only lines of different ones are compared.
    Sets are bit rows over the shingles that more than one line has, which is all that intersections need.
    """
    if len(texts) <= FEW and sum(map(len, texts)) < SHORT:
        return _pairs_of_few([shingles(t) for t in texts], threshold)
    sets = _shingle_numbers(texts)
    if sets is None:
        every = [shingles(t) for t in texts]
        number = {x: k for k, x in enumerate(set().union(*every))}
        sets = [np.array(sorted(map(number.__getitem__, s)), np.uint64) for s in every]
    sizes = np.array([len(s) for s in sets])
    if len(sets) <= FEW:
        near = []
        for j in range(len(sets)):
            for i in range(j):
                if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]):
                    merged = np.concatenate([sets[i], sets[j]])
                    merged.sort()
                    both = int((merged[1:] == merged[:-1]).sum())
                    if both >= threshold * (sizes[i] + sizes[j] - both):
                        near.append((i, j))
        return np.array([i for i, _ in near], np.int64), np.array([j for _, j in near], np.int64)
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1
    number = np.cumsum(often) - 1
    rows = np.zeros((len(sets), (int(often.sum()) + 63) // 64 * 8), np.uint8)
    flags = np.zeros(rows.shape[1] * 8, np.uint8)
    begin = 0
    for k, size in enumerate(sizes.tolist()):
        ids = which[begin : begin + size]
        ids = number[ids[often[ids]]]
        begin += size
        flags[ids] = 1
        rows[k] = np.packbits(flags)
        flags[ids] = 0
    bits, side = rows.view(np.uint64), np.array(sides)
    across = len(set(sides)) > 1
    i_all, j_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(sets) - 1):
        both = np.bitwise_count(bits[k] & bits[k + 1 :]).sum(axis=1, dtype=np.int64)
        near = both >= threshold * (sizes[k] + sizes[k + 1 :] - both)
        if across:
            near &= side[k + 1 :] != side[k]
        found = np.flatnonzero(near) + k + 1
        i_all.append(np.full(len(found), k))
        j_all.append(found)
    label = forest(len(sets), np.concatenate(i_all), np.concatenate(j_all))
    leaves = np.flatnonzero(label != np.arange(len(label)))
    return label[leaves], leaves


def line_groups(lines: DataFrame, docs: DataFrame, text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``line, root`` for the lines of ``line_table`` that are linked to another; ``root`` names the component."""
    banded = lines.where(F.col("bands").isNotNull()).select(F.explode("bands").alias("band"), "line")
    of_band = Window.partitionBy("band")
    members = cut(
        banded.withColumns({"low": F.min("line").over(of_band), "high": F.max("line").over(of_band)})
        .where(F.col("low") < F.col("high"))
        .select("band", "line")
        .distinct()
    )
    texts = cut(_texts(docs, text, members.select("line").distinct()))
    # Bands of the same lines need one look.
    cost = F.greatest(F.length("compared"), F.lit(BLOCK_CHARS // BLOCK_LINES))
    h = F.xxhash64("line").cast("decimal(20,0)")
    bands = (
        members.join(texts.select("line", cost.alias("cost")), "line")
        .groupBy("band")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"), F.min("line").alias("low"), F.sum("cost").alias("cost"))
        .groupBy("n", "h", "low")
        .agg(F.min("band").alias("band"), F.ceil(F.first("cost") / BLOCK_CHARS).alias("blocks"))
        .select("band", "blocks")
    )
    own = F.pmod(F.xxhash64("line", F.lit(7)), F.col("blocks"))
    partners = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own").alias("x"), F.greatest(k, "own").alias("y")))
    met = (
        members.join(bands, "band")
        .withColumn("own", own)
        .withColumn("at", F.explode(partners))
        .join(texts, "line")
        .groupBy("band", "at")
        .agg(F.collect_list(F.struct("line", "own", "compared")).alias("some"))
        .select("some")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            rows, bounds = batch.column(0).flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(0)).to_numpy())]).tolist()
            lines, own, texts_ = rows.field("line").to_numpy(), rows.field("own").to_pylist(), rows.field("compared")
            for low, high in zip(bounds, bounds[1:]):
                i, j = block_links(texts_.slice(low, high - low).to_pylist(), own[low:high], threshold)
                a.append(lines[low:high][i])
                b.append(lines[low:high][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    links = met.transform(in_batches, compare, "a long, b long")
    return components(links).select(F.col("vertex").alias("line"), "root")


def judge_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``doc, text_hash, line_no, line, root, kept_doc, kept_hash, kept_no, kept`` for every line that isn't blank.

    The line kept of a component is the first by id (null ids last), hash of the text, and position.
    Rows of ``docs`` equal in id and text are one document here: their lines are listed once for
    each, and are kept or not alike. A null text has no lines.
    """
    lines = cut(line_table(docs, key, text))
    roots = line_groups(lines, docs, text, threshold)
    rooted = lines.drop("bands").join(roots, "line", "left").withColumn("root", F.coalesce("root", "line"))
    rooted = cut(rooted)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash", "line_no")
    first = rooted.groupBy("root").agg(F.min(place).alias("first"))
    return rooted.join(first, "root").select(
        "doc", "text_hash", "line_no", "line", "root", F.col("first.doc").alias("kept_doc"),
        F.col("first.text_hash").alias("kept_hash"), F.col("first.line_no").alias("kept_no"),
        (place == F.col("first")).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with the lines that aren't kept taken out of ``text``, without documents that lose all they had.

    Blank lines stay. Null texts, and texts that had no line but blank ones, stay as they are.
    """
    gone = (
        judge_lines(docs, key, text, threshold)
        .groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"))
        .agg(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias("_gone"), F.count_if("kept").alias("_kept"))
        .where(F.size("_gone") > 0)
    )
    hashed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    met = hashed.join(gone, F.col(key).eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")), "left")
    numbered = F.transform(F.split(text, "\n"), lambda line, k: F.struct(line.alias("line"), k.alias("k")))
    left = F.filter(numbered, lambda x: ~F.array_contains("_gone", x["k"]))
    shorter = F.array_join(F.transform(left, lambda x: x["line"]), "\n")
    return (
        met.where(F.col("_kept").isNull() | (F.col("_kept") > 0))
        .withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(shorter))
        .select(*docs.columns)
    )
