"""Near copies among documents: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

Words are runs of bytes between white space, in lower case (ASCII). Documents of one set of shingles
count as one. Each distinct set has MinHash values in bands; sets that agree in a band meet, and their
similarity is counted exactly before they are linked. As with lines, a band of many sets is dealt
into blocks, each pair of blocks is one row of one task, and a star per component leaves it. With
``bits`` the fingerprints of ``simhash`` are joined by their trie too, and both kinds of links make one graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.llm import simhash
from scanlake.llm.common import append, components, forest, in_batches, text_bytes
from scanlake.session import cut

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHINGLE = 5
#: At a similarity of 0.8 a pair shares no band with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: A block holds about so many shingles, and at most so many sets.
BLOCK_SHINGLES, BLOCK_SETS = 200_000, 1024
PIECE = 1 << 16
_RANDOM = np.random.default_rng(15)
MULTIPLY = _RANDOM.integers(0, 2**63, BANDS * ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(text: bytes) -> np.ndarray:
    """The distinct hashes of the shingles, in order; a text of fewer words is one shingle, one without words has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    parts = [words[k:] for k in range(SHINGLE)]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*parts)], np.uint64))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A value per band, as signed 64-bit integers."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), PIECE):
        some = shingles[at : at + PIECE]
        some = (some ^ (some >> np.uint64(31))) * MIX
        for k in range(BANDS * ROWS):
            x = some * MULTIPLY[k]
            least[k] = min(least[k], (x ^ (x >> np.uint64(32))).min())
    value = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for row in least.reshape(BANDS, ROWS).T:
        value = (value ^ row) * MIX
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def _scanned(docs: DataFrame, key: str, text: str, marked: bool = False) -> DataFrame:
    """``key, text_hash, set, n, bands``: the hash and size of each row's set, and its bands; if ``marked`` also ``fp``, its fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, bands, marks = [], [], [], []
            for raw in text_bytes(batch, text):
                if marked:
                    marks.append(simhash.fingerprint_of(raw))
                found = shingles_of(raw)
                sets.append(xxhash.xxh64_intdigest(found.tobytes(), 7))
                sizes.append(len(found))
                bands.append(bands_of(found))
            yield append(
                batch.select([key, "text_hash"]), set=pa.array(np.array(sets, np.uint64).view(np.int64)), n=pa.array(sizes, pa.int64()),
                bands=pa.array(bands, pa.list_(pa.int64())), **({"fp": pa.array(np.array(marks, np.uint64).view(np.int64))} if marked else {}),
            )

    hashed = docs.select(key, F.xxhash64(text).alias("text_hash"), text)
    schema = T.StructType([*hashed.schema[:2], *T._parse_datatype_string("set long, n long, bands array<long>" + (", fp long" if marked else ""))])
    return hashed.transform(in_batches, scan, schema)


def _members(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``set, shingles`` of the wanted sets, known by the hash of a text that has them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles_of(raw).view(np.int64) for raw in text_bytes(batch, text)]
            yield append(batch.select(["set"]), shingles=pa.array(found, pa.list_(pa.int64())))

    texts = docs.select(F.xxhash64(text).alias("text_hash"), text).join(wanted, "text_hash").dropDuplicates(["set"])
    return texts.select("set", text).transform(in_batches, scan, "set long, shingles array<long>")


def block_links(sets: list[np.ndarray], sides: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of sets that are similar enough, exactly, as one star per component.

    ``sides`` has the block of each set; with two blocks, only sets of different ones are compared.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Occurrences in order of the shingle: the sets that have it are a range.
    order = np.argsort(number, kind="stable")
    holders, ends = owner[order], np.cumsum(often)
    begins, firsts = ends - often, np.cumsum(sizes) - sizes
    across = len(np.unique(sides)) > 1
    i_all, j_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(sets) - 1):
        own = number[firsts[k] : firsts[k] + sizes[k]]
        own = own[often[own] > 1]
        both = np.zeros(len(sets), np.int64)
        for at in range(0, len(own), 1024):
            some = own[at : at + 1024]
            n = often[some]
            where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[some], n)
            both += np.bincount(holders[where], minlength=len(sets))
        near = both >= threshold * (sizes[k] + sizes - both)
        near[: k + 1] = False
        if across:
            near &= sides != sides[k]
        found = np.flatnonzero(near)
        i_all.append(np.full(len(found), k))
        j_all.append(found)
    label = forest(len(sets), np.concatenate(i_all), np.concatenate(j_all))
    leaves = np.flatnonzero(label != np.arange(len(label)))
    return label[leaves], leaves


def near_links(sets: DataFrame, docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """Links ``a, b`` that connect what pairs of the distinct sets in ``set, text_hash, n, bands`` of that similarity connect."""
    banded = sets.where("n > 0").select(F.explode("bands").alias("band"), "set", "n")
    shared = banded.groupBy("band").agg(F.min("set").alias("low"), F.max("set").alias("high")).where(F.col("low") < F.col("high"))
    members = cut(banded.join(shared.select("band"), "band"))
    wanted = sets.join(members.select("set").distinct(), "set", "left_semi").select("set", "text_hash")
    held = cut(_members(docs, text, wanted))
    # Bands of the same sets need one look.
    cost = F.greatest("n", F.lit(BLOCK_SHINGLES // BLOCK_SETS))
    bands = (
        members.groupBy("band")
        .agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("h"), F.min("set").alias("low"), F.sum(cost).alias("cost"))
        .groupBy("k", "h", "low")
        .agg(F.min("band").alias("band"), F.ceil(F.first("cost") / BLOCK_SHINGLES).alias("blocks"))
        .select("band", "blocks")
    )
    own = F.pmod(F.xxhash64("set", F.lit(7)), F.col("blocks"))
    partners = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own").alias("x"), F.greatest(k, "own").alias("y")))
    met = (
        members.join(bands, "band")
        .withColumn("own", own)
        .withColumn("at", F.explode(partners))
        .join(held, "set")
        .groupBy("band", "at")
        .agg(F.collect_list(F.struct("set", "own", "shingles")).alias("some"))
        .where(F.size("some") > 1)
        .select("some")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for some in batch.column(0):
                names, sides, lists = some.values.flatten()
                sets = [x.values.to_numpy() for x in lists]
                i, j = block_links(sets, sides.to_numpy(), threshold)
                a.append(names.to_numpy()[i])
                b.append(names.to_numpy()[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    return met.transform(in_batches, compare, "a long, b long")


def _fingerprint_links(narrow: DataFrame, bits: int) -> DataFrame:
    """Links ``a, b`` between sets and fingerprints: rows hold both, and fingerprints within ``bits`` are linked."""
    vertex = F.xxhash64(F.lit("fp"), F.col("fp"))
    fps = cut(narrow.groupBy("fp").agg(F.min("set").alias("low"), F.max("set").alias("high")))
    links = cut(simhash.near_links(fps.select("fp"), bits))
    met = links.select(F.col("a").alias("fp")).union(links.select("b")).union(fps.where(F.col("low") < F.col("high")).select("fp")).distinct()
    own = narrow.join(met, "fp", "left_semi").select(F.col("set").alias("a"), vertex.alias("b")).distinct()
    ends = [F.xxhash64(F.lit("fp"), F.col(c)).alias(c) for c in ("a", "b")]
    return links.select(*ends).union(own)


def drop_near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, bits: int | None = None
) -> DataFrame:
    """``docs`` with one row of each group linked over any number of steps: that of the smallest key (null keys come last).

    Texts without a word are one group. ``bits`` also links rows whose fingerprints differ in no more bits.
    """
    narrow = cut(_scanned(docs, key, text, bits is not None))
    sets = cut(narrow.groupBy("set").agg(F.min(F.struct("text_hash", "n", "bands")).alias("x")).select("set", "x.*"))
    links = near_links(sets, docs, text, threshold)
    if bits is not None:
        links = links.union(_fingerprint_links(narrow, bits))
    roots = components(links).select(F.col("vertex").alias("set"), "root")
    kept = (
        narrow.drop("bands").join(roots, "set", "left")
        .groupBy(F.coalesce("root", "set").alias("group"))
        .agg(F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), F.col("text_hash"))).alias("least"))
        .select(F.col("least.key").alias("_key"), F.col("least.text_hash").alias("_hash"))
    )
    hashed = docs.withColumn("_text_hash", F.xxhash64(text))
    met = hashed.join(kept, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    return met.dropDuplicates([key, "_text_hash"]).select(*docs.columns)
