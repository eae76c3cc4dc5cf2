"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces, which a forward pass over its bytes adds up;
a text's log-likelihood is the sum over its words, and the score is the posterior of the best language
under equal priors. Words are runs of letters, lower-cased, each with a space before it.

The probabilities are fitted by expectation-maximisation on the words of a sample of labelled
documents: about ``sample`` of them per language, chosen by a hash of the text, so the table of
distinct words is bounded by it. Each round is a Spark job over that table: a forward and a
backward pass give the expected count of every piece. Scoring covers every word of every text; the
distinct words of an Arrow batch are scored together in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.llm.common import append, in_batches
from scanlake.session import cut

#: Words are scored in stretches of so many bytes, which keeps products of probabilities in range.
STRETCH = 48
#: Each byte of a piece multiplies its probability by this, for the same reason; it is taken out at the end.
GAIN = 64.0
WORD = re.compile(r"[^\W\d_]+")
CELLS = 1 << 20


def words_of(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    spaced = "".join(c if c.isalpha() else " " for c in " ".join(found))
    return spaced.split()


class Pieces:
    """The vocabulary's lower-case pieces of letters as a byte trie with a dense transition table."""

    def __init__(self, tokens: list[bytes], longest: int):
        usable = re.compile(rb" ?[a-z\x80-\xff]+")
        self.pieces = [bytes([b]) for b in range(256)]
        self.pieces += [t for t in sorted(tokens) if 1 < len(t) <= longest and usable.fullmatch(t)]
        used = sorted({b for t in self.pieces[256:] for b in t})
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        nodes: dict[bytes, int] = {b"": 0}
        for t in self.pieces[256:]:
            for k in range(1, len(t) + 1):
                nodes.setdefault(t[:k], len(nodes))
        self.next = np.zeros((len(nodes), len(used) + 1), np.int32)
        for t, node in nodes.items():
            if t:
                self.next[nodes[t[:-1]], self.classes[t[-1]]] = node
        self.piece = np.full(len(nodes), -1, np.int32)
        for k, t in enumerate(self.pieces[256:], 256):
            self.piece[nodes[t]] = k
        self.gain = GAIN ** np.array([len(t) for t in self.pieces], float)

    def matches(self, matrix: np.ndarray, sizes: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Pieces that begin at ``start``: rows of the matrix, end, and which piece."""
        rows = np.flatnonzero(sizes > start)
        yield rows, start + 1, matrix[rows, start]
        node = np.zeros(len(rows), np.int32)
        end = start
        while len(rows):
            node = self.next[node, self.classes[matrix[rows, end]]]
            end += 1
            alive = node > 0
            rows, node = rows[alive], node[alive]
            if end - start > 1:
                is_piece = self.piece[node] >= 0
                if is_piece.any():
                    yield rows[is_piece], end, self.piece[node[is_piece]]
            going = sizes[rows] > end
            rows, node = rows[going], node[going]


def stretches(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Which word each stretch is of, its size, and its bytes."""
    raw = [b" " + w.encode() for w in words]
    if all(len(r) <= STRETCH for r in raw):
        owner = np.arange(len(raw))
    else:
        owner = np.repeat(np.arange(len(raw)), [-(-len(r) // STRETCH) for r in raw])
        raw = [r[k : k + STRETCH] for r in raw for k in range(0, len(r), STRETCH)]
    return owner, np.array([len(r) for r in raw], np.int64), raw


def _groups(sizes: np.ndarray, raw: list[bytes], languages: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of like size as rows of a padded byte matrix."""
    order = np.argsort(sizes, kind="stable")
    step = max(1, CELLS // (STRETCH * languages))
    for at in range(0, len(order), step):
        some = order[at : at + step]
        width = int(sizes[some[-1]])
        yield some, np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in some), np.uint8).reshape(-1, width)


def _forward(pieces: Pieces, matrix: np.ndarray, sizes: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """``alpha[row, end, language]``, scaled by GAIN to the number of bytes."""
    alpha = np.zeros((len(matrix), matrix.shape[1] + 1, scaled.shape[1]))
    alpha[:, 0] = 1
    for start in range(matrix.shape[1]):
        for rows, end, which in pieces.matches(matrix, sizes, start):
            alpha[rows, end] += alpha[rows, start] * scaled[which]
    return alpha


def word_scores(pieces: Pieces, scaled: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log of each word's probability, a column per language."""
    owner, sizes, raw = stretches(words)
    of_stretch = np.zeros((len(raw), scaled.shape[1]))
    for some, matrix in _groups(sizes, raw, scaled.shape[1]):
        own = sizes[some]
        alpha = _forward(pieces, matrix, own, scaled)
        of_stretch[some] = np.log(alpha[np.arange(len(some)), own]) - (own * np.log(GAIN))[:, None]
    if len(raw) == len(words):
        return of_stretch
    total = np.zeros((len(words), scaled.shape[1]))
    np.add.at(total, owner, of_stretch)
    return total


def expected_counts(pieces: Pieces, scaled: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in ``words`` (``counts`` of each) of one language."""
    owner, sizes, raw = stretches(words)
    expected = np.zeros(len(pieces.pieces))
    for some, matrix in _groups(sizes, raw, 1):
        own, n = sizes[some], counts[owner[some]]
        alpha = _forward(pieces, matrix, own, scaled[:, None])[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(some)), own] = 1
        total = alpha[np.arange(len(some)), own]
        for start in reversed(range(matrix.shape[1])):
            found = list(pieces.matches(matrix, own, start))
            for rows, end, which in found:
                beta[rows, start] += scaled[which] * beta[rows, end]
            for rows, end, which in found:
                weight = n[rows] * alpha[rows, start] * scaled[which] * beta[rows, end] / total[rows]
                expected += np.bincount(which, weight, len(expected))
    return expected


def fit(
    labelled: DataFrame, tokens: list[bytes], text: str = "text", label: str = "lang", sample: int = 2000,
    rounds: int = 3, smoothing: float = 0.05, longest: int = 16,
) -> tuple[list[str], np.ndarray, Pieces]:
    """Languages (sorted), the scaled probability of each piece in each language, and the pieces.

    Rows whose label or text is null are left out. Without any, there are no languages.
    """
    spark = labelled.sparkSession
    labelled = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("lang"), F.col(text).alias("text")
    )
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    names = sorted(r.lang for r in sizes.collect())
    pieces = Pieces(tokens, longest)
    if not names:
        return [], np.zeros((len(pieces.pieces), 0)), pieces
    # A row per language, as many as the model itself holds.
    sizes = F.broadcast(sizes)
    part = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    chosen = labelled.join(sizes, "lang").where(part * F.col("n") < sample).select("lang", "text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for word in words_of(value):
                    found[lang, word] = found.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in found], pa.string()) for i in (0, 1)] + [pa.array(list(found.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    counted = chosen.transform(in_batches, count_words, "lang string, word string, n long")
    table = cut(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    probability = np.full((len(pieces.pieces), len(names)), 1 / len(pieces.pieces))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((pieces, probability * pieces.gain[:, None]))

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known, scaled = held.value
            for batch in batches:
                langs = np.array(batch.column("lang").to_pylist(), object)
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for k, name in enumerate(names):
                    rows = np.flatnonzero(langs == name)
                    if len(rows):
                        found = expected_counts(known, scaled[:, k], [words[r] for r in rows], n[rows])
                        some = np.flatnonzero(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), k)), pa.array(some), pa.array(found[some])],
                            names=["lang", "piece", "n"],
                        )

        sums = table.transform(in_batches, expect, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        new = np.full(probability.shape, smoothing)
        for row in sums.collect():
            new[row.piece, row.lang] += row.n
        probability = new / new.sum(axis=0)
        held.destroy()
    return names, probability * pieces.gain[:, None], pieces


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, Pieces], text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language.

    A text that is null or has no letter is ``und`` with score 0, as is any text without a learned
    language. Equal likelihoods go to the first language by name. Columns of these names are replaced.
    """
    gone = {"lang_pred", "score"} | ({text} if drop_text else set())
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scaled, pieces = held.value
        for batch in batches:
            index: dict[str, int] = {}
            rows, sizes = [], []
            for value in batch.column(text):
                words = words_of(value.as_py() or "")
                rows.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
                sizes.append(len(words))
            langs, scores = ["und"] * len(rows), np.zeros(len(rows))
            if index and names:
                of_word = word_scores(pieces, scaled, list(index))
                for k, words in enumerate(rows):
                    if len(words):
                        total = of_word[words].sum(axis=0)
                        best = int(total.argmax())
                        langs[k], scores[k] = names[best], 1 / np.exp(total - total[best]).sum()
            kept = batch.select([c for c in batch.schema.names if c not in gone])
            yield append(kept, lang_pred=pa.array(langs, pa.string()), score=pa.array(scores))

    fields = [f for f in docs.schema if f.name not in gone]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.transform(in_batches, scan, schema)


def keep_identified(docs: DataFrame, model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without those of no language or of a score under ``least``."""
    found = identify(docs, model, text)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*docs.columns)
