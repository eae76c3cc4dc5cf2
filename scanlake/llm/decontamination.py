"""Benchmark decontamination by token windows.

Every run of ``width`` words of a benchmark item is a window; an item with fewer words is one window
as a whole. The windows are a hash set that each task holds while it scans the documents' words: a
word that no window has ends a run, and only runs long enough are looked up, by their exact word
ids, so a hit needs no further check against collisions.

The set is broadcast in parts of at most ``part_windows`` windows. One part is the usual case. A
larger benchmark is dealt into parts by a hash of the window; the documents then pass once per part
and carry what was hit so far, and each pass is written before the next so that one part at a time
is held.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.llm.common import append, in_batches, text_bytes
from scanlake.session import cut

#: Bytes that are no part of a word become spaces, A-Z becomes a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
FOUND = ("n_words", "hit_words", "item_ids")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def windows(items: DataFrame, text: str, item_id: str, width: int) -> DataFrame:
    """``window`` (its words, space-joined) and ``item`` of every window, once for each item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(1).to_pylist(), text_bytes(batch, batch.schema.names[0])):
                words = words_of(raw)
                if words:
                    found = sorted({b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], names=["window", "item"]
                    )

    narrow = items.select(F.col(text), F.coalesce(F.col(item_id).cast("string"), F.lit("")))
    return narrow.transform(in_batches, scan, "window binary, item string").distinct()


def mark_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 13,
    part_windows: int = 500_000,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (positions inside windows) and ``item_ids`` (whose windows, sorted).

    A null or empty text has no words and no hit. A null item id counts as the empty string, and
    items of one id as one item. Columns of ``docs`` with these names are replaced; all others stay.
    """
    found = cut(windows(items, item_text, item_id, width))
    parts = max(1, -(-found.count() // part_windows))
    docs = docs.drop(*FOUND)
    schema = T.StructType([*docs.schema, *T._parse_datatype_string("n_words long, hit_words array<int>, item_ids array<string>")])
    for part in range(parts):
        chosen = found.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        held = docs.sparkSession.sparkContext.broadcast(_lookup(chosen.collect()))
        docs = docs.transform(in_batches, _scan(text, held), schema)
        if parts > 1:
            docs = cut(docs)
            held.unpersist()
    return docs


def _lookup(rows: list) -> tuple[dict[bytes, int], dict[int, dict[bytes, list[str]]]]:
    """Ids of words, and by length the windows (as bytes of their word ids) with their items."""
    ids: dict[bytes, int] = {}
    by_length: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for window, item in rows:
        words = bytes(window).split(b" ")
        key = np.array([ids.setdefault(w, len(ids)) for w in words], np.int32).tobytes()
        by_length[len(words)][key].append(item)
    return ids, {k: dict(v) for k, v in by_length.items()}


def _scan(text: str, held):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by_length = held.value
        for batch in batches:
            old = [batch.column(c).to_pylist() if c in batch.schema.names else [[]] * batch.num_rows for c in FOUND[1:]]
            counts, positions, items = [], [], []
            for raw, was_hit, had in zip(text_bytes(batch, text), *old):
                words = words_of(raw)
                hit, names = _hits(words, ids, by_length)
                counts.append(len(words))
                positions.append(sorted({*was_hit, *hit}))
                items.append(sorted({*had, *names}))
            kept = batch.select([c for c in batch.schema.names if c not in FOUND])
            yield append(
                kept, n_words=pa.array(counts, pa.int64()), hit_words=pa.array(positions, pa.list_(pa.int32())),
                item_ids=pa.array(items, pa.list_(pa.string())),
            )

    return scan


def _hits(words: list[bytes], ids: dict, by_length: dict) -> tuple[set[int], set[str]]:
    known = np.fromiter((ids.get(w, -1) for w in words), np.int32, len(words))
    seen = np.concatenate([[0], np.cumsum(known >= 0)])
    hit: set[int] = set()
    names: set[str] = set()
    for length, found in by_length.items():
        if length > len(words):
            continue
        for at in np.flatnonzero(seen[length:] - seen[:-length] == length):
            got = found.get(known[at : at + length].tobytes())
            if got:
                hit.update(range(at, at + length))
                names.update(got)
    return hit, names


def is_contaminated() -> Column:
    """At least one word in twenty lies in a window."""
    return (F.size("hit_words") > 0) & (20 * F.size("hit_words") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, action: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``spans``) all of them without the words hit."""
    marked = mark_contaminated(docs, items, text, **options)
    if action == "documents":
        return marked.where(~is_contaminated()).select(*docs.columns)
    if action != "spans":
        raise ValueError("action is documents or spans")
    columns = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            kept = [
                None if raw is None else without_words(raw.encode(), hit).decode() if hit else raw
                for raw, hit in zip(batch.column(at).to_pylist(), batch.column("hit_words").to_pylist())
            ]
            yield batch.set_column(at, text, pa.array(kept, batch.schema.field(at).type)).select(columns)

    return marked.transform(in_batches, scan, docs.schema)


def without_words(text: bytes, hit: list[int]) -> bytes:
    """The text without each run of words hit, and without what stands between the words of a run."""
    spaced, words, at = text.translate(WORD_BYTES), [], 0
    for word in spaced.split():
        at = spaced.index(word, at)
        words.append((at, at + len(word)))
        at += len(word)
    out, begin = [], 0
    runs = np.split(np.asarray(hit), np.flatnonzero(np.diff(hit) > 1) + 1)
    for run in runs:
        out.append(text[begin : words[run[0]][0]])
        begin = words[run[-1]][1]
    return b"".join([*out, text[begin:]])

