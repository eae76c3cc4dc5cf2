"""Byte-level BPE encoding and decoding by recursive queries.

Spark deals the documents out; each task holds a DuckDB connection of one thread with the merge
table (left token, right token, merged token: every split of a vocabulary entry into two entries).
Matches of the split pattern become rows of (word, position, token), one byte each. A recursive
query joins neighbours with the merge table, contracts in every word the leftmost pair of least rank,
and ends when no word has a pair left. Each distinct word is encoded once and kept for the task in a
cache of bounded size, which when full goes on with the words of the texts at hand. Decoding joins ids with the vocabulary and concatenates the bytes of each
text in the order of position.

A row of tokens is what its bytes are merged to exactly if each two neighbours are what their own bytes
are merged to: until the first merge across a border, what lies between two borders goes its way by
itself. So a word of many bytes is encoded in short stretches that overlap by half, and two rows that
share a token go over into each other there. Where they don't, the last tokens are merged again together with
the next bytes, from further back until the first of them stays as it was. In such a piece all occurrences of
the least pair are contracted in a round, unless one of them would make a pair of even lower rank; then only the
leftmost is. That is what the one-at-a-time order would arrive at. Of its rounds only the last is held.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scanlake.llm.common import append, in_batches, text_bytes

#: Words of more bytes are encoded in stretches of twice ``HALF`` bytes, so many of them at a time.
LONG, HALF, STRETCHES = 192, 64, 4_096
#: Stretches that don't meet make way for longer pieces, up to so many bytes more.
FURTHEST = 1 << 16
WORDS_AT_ONCE, BYTES_AT_ONCE, CHARS_AT_ONCE, CACHE, TOKENS_AT_ONCE = 15_000, 200_000, 1_000_000, 400_000, 200_000
#: Rows leave the encoder in batches of about so many bytes of text and the columns kept with it.
BATCH_BYTES = 1 << 20
#: All rounds of short words have at most so many rows, as a word of n bytes leaves n, n - 1, ... in its rounds.
ROWS_AT_ONCE = 2_000_000

#: ``start`` has running positions with a gap behind each word, so that neighbours are found by one join:
#: a token ends where the next begins. ``made`` is the merged rank, then a place for the position, then the length.
SHORT_WORDS = """
WITH RECURSIVE step AS (
  SELECT word, pos, pos + 1 AS upto, tok, 0 AS round FROM start
  UNION ALL (
    WITH best AS (
      SELECT a.word, min(made | (a.pos << 8)) AS b
      FROM step a JOIN step z ON a.upto = z.pos JOIN packed ON pair = ((a.tok << 24) | z.tok) GROUP BY a.word
    ), pick AS (
      SELECT word, b >> 40 AS m, (b >> 8) & 4294967295 AS here, b & 255 AS size FROM best
    )
    SELECT word, pos, CASE WHEN pos = here THEN here + size ELSE upto END, CASE WHEN pos = here THEN m ELSE tok END, round + 1
    FROM step JOIN pick USING (word) WHERE pos <= here OR pos >= here + size
  )
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round) GROUP BY word
"""
LONG_ROUND = """
WITH cur AS (
  SELECT *, lag(tok) OVER w AS prv, lead(tok) OVER w AS nxt, lead(pos) OVER w AS npos, lead(tok, 2) OVER w AS nxt2
  FROM step WINDOW w AS (ORDER BY pos)
), pairs AS (
  SELECT pos, npos, prv, nxt2, m FROM cur JOIN merges ON tok = l AND nxt = r
), least AS (
  SELECT *, coalesce(lag(npos) OVER (ORDER BY pos) = pos, false) AS meets FROM pairs WHERE m = (SELECT min(m) FROM pairs)
), lower AS (
  SELECT count(*) AS n FROM (
    SELECT m, prv AS l, m AS r FROM least UNION ALL
    SELECT m, m, nxt2 FROM least UNION ALL
    SELECT m, m, m FROM least
  ) made JOIN merges USING (l, r) WHERE merges.m < made.m
), runs AS (
  SELECT *, sum(CASE WHEN meets THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS run FROM least
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) % 2 = 1 AS free, row_number() OVER (ORDER BY pos) = 1 AS leftmost FROM runs
), pick AS (
  SELECT pos, npos, m FROM ranked WHERE CASE WHEN (SELECT n FROM lower) = 0 THEN free ELSE leftmost END
)
SELECT cur.pos, coalesce(a.m, tok) AS tok
FROM cur LEFT JOIN pick a ON a.pos = cur.pos ANTI JOIN pick z ON z.npos = cur.pos
"""
DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS text, count(*) - count(piece) AS unknown
FROM given LEFT JOIN vocab USING (tok) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _connection() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})


class Encoder:
    """Encodes words in one task."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 1 << 22 or max(map(len, ranks)) > 255:
            raise ValueError("ranks of 22 bits and tokens of 255 bytes at most")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        splits = array("q")
        for t, rank in ranks.items():
            for i in range(1, len(t)):
                if (left := ranks.get(t[:i])) is not None and (right := ranks.get(t[i:])) is not None:
                    splits.extend((left, right, rank, len(t)))
        self.db = _connection()
        rows = np.frombuffer(splits, np.int64).reshape(-1, 4)
        self.db.register("given", pa.table({c: pa.array(rows[:, k]) for k, c in enumerate("lrms")}))
        self.db.execute("CREATE TABLE merges AS SELECT l, r, m FROM given")
        self.db.execute("CREATE TABLE packed AS SELECT (l << 24) | r AS pair, (m << 40) | s AS made FROM given")
        self.db.unregister("given")
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.ranks = ranks
        self.known: dict[str, bytes] = {}

    def packed(self, texts: Sequence[list[str]]) -> list[bytes]:
        """Ids of each text, given as its words, as little-endian unsigned 32-bit integers."""
        distinct = dict.fromkeys(w for words in texts for w in words)
        if len(self.known) > CACHE:
            self.known = {w: self.known[w] for w in distinct if w in self.known}
        self._learn([w for w in distinct if w not in self.known])
        return [b"".join(map(self.known.__getitem__, words)) for words in texts]

    def _learn(self, words: list[str]) -> None:
        short: dict[str, bytes] = {}
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[word] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.known[word] = self._long(raw)
            else:
                short[word] = raw
        self.known.update(zip(short, (ids.tobytes() for ids in self._short(list(short.values())))))

    def _short(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each word, in groups of bounded size."""
        group: list[bytes] = []
        held = rows = 0
        for raw in words:
            more = len(raw) * (len(raw) + 1) // 2
            if group and (len(group) >= WORDS_AT_ONCE or held + len(raw) > BYTES_AT_ONCE or rows + more > ROWS_AT_ONCE):
                yield from self._encode(group)
                group, held, rows = [], 0, 0
            group.append(raw)
            held += len(raw)
            rows += more
        if group:
            yield from self._encode(group)

    def _encode(self, group: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(raw) for raw in group])
        word = np.repeat(np.arange(len(group)), sizes)
        pos = np.arange(len(word)) + word
        tok = self.single[np.frombuffer(b"".join(group), np.uint8)]
        self.db.register("start", pa.table({"word": pa.array(word), "pos": pa.array(pos), "tok": pa.array(tok)}))
        out = self.db.sql(SHORT_WORDS).to_arrow_table().combine_chunks()
        self.db.unregister("start")
        ids = out.column("ids").combine_chunks()
        flat, ends = ids.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        found = [flat[:0]] * len(group)
        for k, w in enumerate(out.column("word").to_pylist()):
            found[w] = flat[ends[k] : ends[k + 1]]
        return found

    def _long(self, raw: bytes) -> bytes:
        """Ids of a word of any length; ``ids`` and ``starts`` are always what the bytes up to ``done`` are merged to."""
        ids, starts, done, further = array("I"), array("q"), 0, 0
        count = -(-(len(raw) - HALF) // HALF)
        for at in range(0, count, STRETCHES):
            some = [raw[k * HALF : (k + 2) * HALF] for k in range(at, min(at + STRETCHES, count))]
            distinct = list(dict.fromkeys(some))
            found = dict(zip(distinct, self._short(distinct)))
            for k, piece in enumerate(some, at):
                begin, end = k * HALF, k * HALF + len(piece)
                if end <= done:
                    continue
                own = found[piece]
                first = (begin + np.cumsum(self.sizes[own]) - self.sizes[own]).tolist()
                own = own.tolist()
                index = dict(zip(zip(first, own), range(len(own))))
                for i in range(bisect_left(starts, begin), len(starts)):
                    if (j := index.get((starts[i], ids[i]))) is not None:
                        break
                else:
                    i, j = (0, 0) if not done else (0, None)
                if j is None:
                    further = min(2 * further + HALF, FURTHEST)
                    end = min(len(raw), end + further)
                    self._append(raw, ids, starts, end)
                else:
                    further = 0
                    del ids[i:], starts[i:]
                    ids.extend(own[j:])
                    starts.extend(first[j:])
                done = end
        return np.array(ids, "<u4").tobytes()

    def _append(self, raw: bytes, ids: array, starts: array, end: int) -> None:
        """Goes on to ``end`` by merging the last tokens again with the bytes that follow."""
        back = 8
        while True:
            at = max(0, len(ids) - back)
            new = self._rounds(raw[starts[at] : end])
            if not at or new[0] == ids[at]:
                break
            back *= 8
        first = starts[at] + np.cumsum(self.sizes[new]) - self.sizes[new]
        del ids[at:], starts[at:]
        ids.extend(new.tolist())
        starts.extend(first.tolist())

    def _rounds(self, raw: bytes) -> np.ndarray:
        """Ids of a word, of which each round replaces the one before."""
        tok = self.single[np.frombuffer(raw, np.uint8)]
        self.db.register("given", pa.table({"pos": pa.array(np.arange(len(tok))), "tok": pa.array(tok)}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE step AS SELECT * FROM given")
        self.db.unregister("given")
        left = len(tok)
        while True:
            (now,) = self.db.execute(f"CREATE OR REPLACE TEMP TABLE step AS {LONG_ROUND}").fetchone()
            if now == left:
                return self.db.execute("SELECT tok FROM step ORDER BY pos").fetchnumpy()["tok"].astype("<u4")
            left = now


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``BATCH_BYTES`` or so on average, of one row at least."""
    for batch in batches:
        rows = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, BATCH_BYTES))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _encoding(held: Broadcast, pattern: str, text: str, keep: list[str]) -> Scan:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = None, regex.compile(pattern).findall
        for batch in small_batches(batches):
            encoder = encoder or Encoder(held.value)
            packed: list[bytes] = []
            some: list[list[str]] = []
            size = 0
            for raw in batch.column(text):
                value = raw.as_py() or ""
                some.append(split(value))
                size += len(value)
                if size > CHARS_AT_ONCE:
                    packed += encoder.packed(some)
                    some, size = [], 0
            packed += encoder.packed(some)
            yield append(
                batch.select(keep), n_tokens=pa.array([len(p) // 4 for p in packed], pa.int64()),
                token_ids=pa.array(packed, pa.binary()),
            )
        if encoder:
            encoder.db.close()

    return scan


def _decoding(held: Broadcast, ids: str, name: str) -> Scan:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = None
        for batch in batches:
            db = db or _vocabulary(held.value)
            packed = list(text_bytes(batch, ids))
            out = [b""] * len(packed)
            some: list[tuple[int, bytes]] = []
            size = 0
            for at, value in enumerate(packed):
                for begin in range(0, len(value), 4 * TOKENS_AT_ONCE):
                    part = value[begin : begin + 4 * TOKENS_AT_ONCE]
                    if size + len(part) > 4 * TOKENS_AT_ONCE:
                        _decode(db, some, out)
                        some, size = [], 0
                    some.append((at, part))
                    size += len(part)
            _decode(db, some, out)
            kept = batch.select([c for c in batch.schema.names if c != name])
            yield append(kept, **{name: pa.array(out, pa.binary())})
        if db:
            db.close()

    return scan


def _encoded(docs: DataFrame, keep: list[str]) -> list[T.StructField]:
    return [*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """``keep`` columns (all) of ``docs`` with ``n_tokens`` and ``token_ids``, packed as unsigned 32-bit integers.

    The whole text is split by ``pattern`` and each match is merged by itself. Special tokens aren't
    looked for. A null text counts as an empty one, which has no ids. Columns ``n_tokens`` and
    ``token_ids`` of ``docs`` are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "token_ids")]
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    return docs.transform(in_batches, _encoding(held, pattern, text, keep), T.StructType(_encoded(docs, keep)))


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that packed ``ids`` stand for; of null or no ids, no bytes.

    An id outside the vocabulary is an error.
    """
    held = rows.sparkSession.sparkContext.broadcast(ranks)
    fields = [f for f in rows.schema if f.name != name]
    schema = T.StructType([*fields, T.StructField(name, T.BinaryType())])
    return rows.transform(in_batches, _decoding(held, ids, name), schema)


def round_trip(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """``encode``, and ``decoded`` as ``decode`` gives it from the ids, in one pass of one worker per task."""
    gone = ("n_tokens", "token_ids", "decoded")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in gone]
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    encoding, decoding = _encoding(held, pattern, text, keep), _decoding(held, "token_ids", "decoded")
    schema = T.StructType([*_encoded(docs, keep), T.StructField("decoded", T.BinaryType())])
    return docs.transform(in_batches, lambda batches: decoding(encoding(batches)), schema)


def _vocabulary(ranks: dict[bytes, int]) -> duckdb.DuckDBPyConnection:
    """A byte of a token is held as the character of that number."""
    db = _connection()
    pieces = [t.decode("latin-1") for t in ranks]
    db.register("given", pa.table({"tok": pa.array(list(ranks.values()), pa.uint32()), "piece": pa.array(pieces)}))
    db.execute("CREATE TABLE vocab AS SELECT * FROM given")
    db.unregister("given")
    return db


def _decode(db: duckdb.DuckDBPyConnection, some: list[tuple[int, bytes]], out: list[bytes]) -> None:
    """Adds to the texts of ``out`` what the next ids of each stand for."""
    if not some:
        return
    sizes = np.array([len(p) // 4 for _, p in some])
    tok = np.frombuffer(b"".join(p for _, p in some), "<u4")
    doc = np.repeat([at for at, _ in some], sizes)
    db.register("given", pa.table({"doc": pa.array(doc), "pos": pa.array(np.arange(len(tok))), "tok": pa.array(tok)}))
    for at, text, unknown in db.execute(DECODE).fetchall():
        if unknown:
            raise ValueError(f"{unknown} ids are not in the vocabulary")
        out[at] += text.encode("latin-1")
    db.unregister("given")
