"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are words and one end per text. The most frequent tokens of the training texts are the head:
by rank they fall into classes of ``MEMBERS``. All other tokens, unknown ones with them, are one more
class, the tail. The probability of a token is that of its class in its context, times that of the
token within the class: a second softmax in the context for a head token, smoothed counts for a tail
token. Contexts are features of the tokens before: the last, the last two, and the second and the third
last by themselves (skips), each hashed to a row of weights.

Three passes over the texts. Counting: each task counts its batches, and partial sums are added up.
Training: every training text is used in one of ``rounds``; a task goes from the shared weights over
its texts by minibatch gradient steps (Adagrad), and the changes are added up in groups of eight,
then averaged over the tasks that touched a row. Scoring: sparse lookups and dense sums over
batches in numpy.

A token's count is looked up in the tasks if it is one of those with at least 1/``HOT`` of all
tokens, of which there are at most ``HOT``, so the table sent to all is bounded. Rarer tokens, of which
each text leaves a list, meet the table of counts in a join in which no key has many rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.llm.common import in_batches, text_bytes
from scanlake.session import cut

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The end of a text; no word is empty.
END = b""
CLASSES, MEMBERS = 32, 32
TAIL = CLASSES
BUCKETS = 1 << 14
HOT = 400_000
CHUNK, STEP, TASK_TOKENS = 1 << 17, 1 << 13, 4_000_000
#: Runs of at least so many gradients of one row are added up by themselves.
LAYERS = 32
P1, P2, P3 = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


@dataclass
class Vocabulary:
    """What is known of the training tokens: totals, and the counts of the hot ones."""

    tokens: int
    distinct: int
    counts: dict[bytes, int]
    head: dict[bytes, int]
    tail_tokens: int

    @property
    def tail_distinct(self) -> int:
        return self.distinct - len(self.head)


def count_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """``token, n`` of all tokens of the texts, as a written table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for raw in text_bytes(batch, text):
                found.update(tokens_of(raw))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "n"]
            )

    return cut(texts.select(text).transform(in_batches, scan, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    hot = counts.where(F.col("n") * HOT >= total.n).collect()
    hot.sort(key=lambda r: (-r.n, bytes(r.token)))
    known = {bytes(r.token): r.n for r in hot}
    head = {token: k for k, token in enumerate(list(known)[: CLASSES * MEMBERS])}
    return Vocabulary(total.n, total.v, known, head, total.n - sum(known[t] for t in head))


class Model:
    """Weights: ``classes`` rows of CLASSES + 1, ``members`` rows of MEMBERS; the last rows are biases."""

    def __init__(self, words: Vocabulary):
        self.classes = np.zeros((BUCKETS + 1, CLASSES + 1), np.float32)
        self.members = np.zeros((BUCKETS + CLASSES, MEMBERS), np.float32)
        filled = len(words.head)
        self.no_class = np.array([k * MEMBERS >= filled for k in range(CLASSES)] + [False])
        self.no_member = np.arange(CLASSES * MEMBERS).reshape(CLASSES, MEMBERS) >= filled

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.classes, self.members


class Stream:
    """Texts of a batch as running token arrays, in chunks; each distinct token is looked at once a batch."""

    def __init__(self, texts: Iterator[bytes], words: Vocabulary):
        self.index: dict[bytes, int] = defaultdict(count().__next__)
        self.rows = []
        for raw in texts:
            tokens = tokens_of(raw)
            self.rows.append(np.fromiter(map(self.index.__getitem__, tokens), np.int32, len(tokens)))
        self.distinct = list(self.index)
        self.hash = np.array([zlib.crc32(t) for t in self.distinct], np.uint32) * P1
        self.place = np.array([words.head.get(t, -1) for t in self.distinct], np.int32)

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text of each token, its place in the text, and its number in ``distinct``."""
        begin, held = 0, 0
        for at, row in enumerate(self.rows):
            held += len(row)
            if held >= CHUNK or at == len(self.rows) - 1:
                some = self.rows[begin : at + 1]
                sizes = np.array([len(r) for r in some])
                token = np.concatenate(some)
                yield np.repeat(np.arange(begin, at + 1), sizes), np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes), token
                begin, held = at + 1, 0

    def context(self, where: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The four context hashes of each token."""
        h = self.hash[token]
        before = [np.where(where >= k, np.concatenate([np.zeros(k, np.uint32), h[:-k]])[: len(h)], np.uint32(k)) for k in (1, 2, 3)]
        context = np.stack([before[0] * P2 + P1, (before[0] * P3) ^ (before[1] * P2 + P3), before[1] * P1 + P2, before[2] * P3 + P1])
        return context ^ (context >> np.uint32(15))

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text of each token, head place of each token (or -1), and the four context hashes."""
        for owner, where, token in self.groups():
            yield owner, self.place[token], self.context(where, token)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * P2) >> np.uint32(18)).astype(np.int32)


def _class_rows(context: np.ndarray) -> list[np.ndarray]:
    return [_bucket(c) for c in context]


def _member_rows(context: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
    """Of the last token and of the second last, each with the class."""
    salt = (cls.astype(np.uint32) + np.uint32(1)) * P3
    return [_bucket(context[k] ^ salt) for k in (0, 2)]


def _exponents(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, banned: np.ndarray) -> np.ndarray:
    """Summed weights of each context less the largest of them, at most 0."""
    z = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0)
    z += bias
    if banned.any():
        z[np.broadcast_to(banned, z.shape)] = -1e30
    z -= z.max(axis=1, keepdims=True)
    return z


def _softmax(*given) -> np.ndarray:
    z = _exponents(*given)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _log_softmax_at(which: np.ndarray, *given) -> np.ndarray:
    """Of each context, the log probability of one of its choices."""
    z = _exponents(*given)
    own = z[np.arange(len(z)), which]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def log_probabilities(model: Model, place: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural log of the class's probability, times that within the class for head tokens."""
    out = np.empty(len(place))
    for at in range(0, len(place), STEP):
        p, c = place[at : at + STEP], context[:, at : at + STEP]
        cls = np.where(p >= 0, p // MEMBERS, TAIL)
        got = _log_softmax_at(cls, model.classes, _class_rows(c), model.classes[BUCKETS], model.no_class).astype(float)
        head = np.flatnonzero(p >= 0)
        if len(head):
            k = cls[head]
            biases = np.take(model.members, BUCKETS + k, axis=0)
            got[head] += _log_softmax_at(p[head] % MEMBERS, model.members, _member_rows(c[:, head], k), biases, model.no_member[k])
        out[at : at + STEP] = got
    return out


def _sums(rows: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each the sum of ``delta`` where it comes; ``delta`` holds for each len(delta) of ``rows`` again.

    Runs of a row are added up in layers of first, second, ... places, the few long ones each by itself.
    """
    order = np.argsort(rows.astype(np.uint16) if BUCKETS + CLASSES < 1 << 16 else rows, kind="stable")
    ordered, order = rows[order], order % len(delta)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(starts, len(order)))
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    long = int(np.searchsorted(-sizes, -LAYERS))
    out = np.take(delta, order[starts], axis=0)
    for k in range(long):
        out[k] = np.take(delta, order[starts[k] : starts[k] + sizes[k]], axis=0).sum(axis=0)
    for layer in range(1, LAYERS):
        upto = int(np.searchsorted(-sizes, -layer))
        if upto <= long:
            break
        out[long:upto] += np.take(delta, order[starts[long:upto] + layer], axis=0)
    return ordered[starts], out


def _descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, delta: np.ndarray, rate: float) -> None:
    """An Adagrad step on the rows, whose gradients are summed where a row comes more than once."""
    which, g = _sums(rows, delta)
    s = np.take(squares, which, axis=0)
    s += g * g
    squares[which] = s
    s += 1e-6
    g *= rate
    g /= np.sqrt(s, out=s)
    weights[which] = np.take(weights, which, axis=0) - g


def train_on(model: Model, squares: list[np.ndarray], place: np.ndarray, context: np.ndarray, rate: float) -> None:
    for at in range(0, len(place), STEP):
        p, c = place[at : at + STEP], context[:, at : at + STEP]
        cls = np.where(p >= 0, p // MEMBERS, TAIL)
        rows = _class_rows(c)
        delta = _softmax(model.classes, rows, model.classes[BUCKETS], model.no_class)
        delta[np.arange(len(p)), cls] -= 1
        head = np.flatnonzero(p >= 0)
        if len(head):
            k = cls[head]
            m_rows = _member_rows(c[:, head], k)
            m_delta = _softmax(model.members, m_rows, np.take(model.members, BUCKETS + k, axis=0), model.no_member[k])
            m_delta[np.arange(len(head)), p[head] % MEMBERS] -= 1
            _descend(model.members, squares[1], np.concatenate([*m_rows, BUCKETS + k]), m_delta, rate)
        _descend(model.classes, squares[0], np.concatenate(rows), delta, rate)
        _descend(model.classes, squares[0], np.array([BUCKETS]), delta.sum(axis=0, keepdims=True), rate)


def _pack(tables: list[np.ndarray], touched: list[np.ndarray]) -> bytes:
    return b"".join(a.astype(np.float32).tobytes() for a in (*tables, *touched))


def _unpack(blob: bytes, model: Model) -> tuple[list[np.ndarray], list[np.ndarray]]:
    flat, at, out = np.frombuffer(blob, np.float32), 0, []
    for shape in [*(t.shape for t in model.tables), *((len(t),) for t in model.tables)]:
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out[:2], out[2:]


def train(texts: DataFrame, words: Vocabulary, text: str = "text", rounds: int = 2, rate: float = 0.1) -> Model:
    """The model after one pass over all ``texts``, a part of them in each round."""
    spark = texts.sparkSession
    model = Model(words)
    if not words.tokens:
        return model
    tasks = max(2, -(-words.tokens // (TASK_TOKENS * rounds)))
    for part in range(rounds):
        held = spark.sparkContext.broadcast((words, model))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known, start = held.value
            own, used = Model(known), 0
            own.classes, own.members = (t.copy() for t in start.tables)
            squares = [np.zeros_like(t) for t in own.tables]
            for batch in batches:
                for _, place, context in Stream(text_bytes(batch, text), known).chunks():
                    train_on(own, squares, place, context, rate)
                    used += len(place)
            if used:
                touched = [(s > 0).any(axis=1) for s in squares]
                blob = _pack([a - b for a, b in zip(own.tables, start.tables)], touched)
                number = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary())], names=["id", "change"])

        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(0, np.float32)
            for blob in table.column("change"):
                value = np.frombuffer(blob.as_buffer(), np.float32)
                total = total + value if len(total) else value
            return pa.table({"id": table.column("id").slice(0, 1), "change": pa.array([total.tobytes()], pa.binary())})

        some = texts.select(text).where(F.pmod(F.xxhash64(text), F.lit(rounds)) == part)
        changes, left = cut(some.coalesce(tasks).transform(in_batches, scan, "id long, change binary")), tasks
        while left > 4:
            left = -(-left // 8)
            grouped = changes.withColumn("id", F.col("id") % left).groupBy("id")
            changes = cut(grouped.applyInArrow(add, "id long, change binary"))
        sums, touches = [np.zeros_like(t) for t in model.tables], [np.zeros(len(t), np.float32) for t in model.tables]
        for row in changes.toLocalIterator():
            for into, more in zip((*sums, *touches), sum(_unpack(row.change, model), [])):
                into += more
        for weights, change, touch in zip(model.tables, sums, touches):
            weights += change / np.maximum(touch, 1)[:, None]
        held.destroy()
    return model


def score(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the log10 probability of the text by smoothed single counts, ``score`` that by the
    model. A null or empty text is an end by itself. Columns of these names are replaced.
    """
    names = ("row", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    gone = {text, *names}
    own = [f for f in docs.schema if f.name not in gone]
    schema = T.StructType([*own, *T._parse_datatype_string(
        "row long, n_tokens long, n_hot long, n_tail long, log_counts double, head_log_counts double, model double, rare array<binary>, times array<int>"
    )])
    held = docs.sparkSession.sparkContext.broadcast((words, model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = held.value
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            stream = Stream(text_bytes(batch, text), known)
            n = batch.num_rows
            often = np.array([known.counts.get(t, -1) for t in stream.distinct], np.int64)
            log_count = np.where(often >= 0, np.log10(np.maximum(often, 0) + 0.5), 0)
            hot, is_head = often >= 0, stream.place >= 0
            sums = np.zeros((5, n))
            rare, times, lists = [], [], np.zeros(n + 1, np.int64)
            for owner, where, token in stream.groups():
                own_hot, own_head = hot[token], is_head[token]
                log = log_count[token]
                for k, value in enumerate((own_hot, ~own_head, log, np.where(own_head, log, 0))):
                    sums[k] += np.bincount(owner, value, n)
                sums[4] += np.bincount(owner, log_probabilities(weights, stream.place[token], stream.context(where, token)), n)
                pairs, repeats = np.unique(owner[~own_hot] * len(hot) + token[~own_hot], return_counts=True)
                rare.append(pairs % len(hot))
                times.append(repeats)
                lists[1:] += np.bincount(pairs // len(hot), minlength=n)
            ends = pa.array(np.cumsum(lists), pa.int32())
            found = pa.array(stream.distinct, pa.binary()).take(pa.array(np.concatenate([*rare, np.zeros(0, np.int64)])))
            columns = [
                pa.array(np.arange(number, number + n)), pa.array([len(r) for r in stream.rows], pa.int64()),
                *(pa.array(sums[k].astype(np.int64)) for k in (0, 1)), *(pa.array(sums[k]) for k in (2, 3)), pa.array(sums[4] / np.log(10)),
                pa.ListArray.from_arrays(ends, found),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*times, np.zeros(0, np.int64)]), pa.int32())),
            ]
            number += n
            kept = [batch.column(f.name) for f in own]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=schema.names)

    scored = cut(docs.select(*(f.name for f in own), text).transform(in_batches, scan, schema))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("token"), F.col("x.times").alias("times")
    )
    looked = (
        rare.join(counts, "token", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    base = np.log10(words.tokens + 0.5 * (words.distinct + 1))
    tail = np.log10(words.tail_tokens + 0.5 * (words.tail_distinct + 1))
    return scored.drop("rare", "times").join(looked, "row", "left").select(
        *(f.name for f in own), "n_tokens",
        (F.col("n_hot") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(base))).alias("base_score"),
        (F.col("model") + logs - F.col("head_log_counts") - F.col("n_tail") * F.lit(float(tail))).alias("score"),
    )


def fit_and_score(docs: DataFrame, training: Column, text: str = "text", rounds: int = 2) -> DataFrame:
    """Counts and trains on the rows where ``training`` holds, then scores all; see ``score``."""
    learn = docs.where(training).select(text)
    counts = count_tokens(learn, text)
    words = vocabulary(counts)
    return score(docs, counts, words, train(learn, words, text, rounds), text)
