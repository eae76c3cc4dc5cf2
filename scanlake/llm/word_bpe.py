"""BPE with word ends: speculate, verify, and merge exactly only what fails.

A word's symbols are its bytes, the last one marked as the word's end. For a batch's distinct words

1. greedy longest matches of the vocabulary are proposed: all positions step through a trie at once,
   then the matches are followed from each word's start;
2. every distinct pair of neighbouring tokens is tested, all pairs at once: the two tokens are undone from
   the border outwards, latest merge first, and the pair is compatible if no merge across the border would
   have come before the one undone;
3. words with an incompatible pair are merged in the exact order of ranks.

A row of tokens is what its symbols are merged to exactly if each token is what its own symbols are
merged to and every two neighbours are compatible: until the first merge across a border, what lies
between borders goes its way by itself. So a long word is merged again only around its incompatible pairs,
and tested again, with twice the surroundings each time until it holds.
"""

from __future__ import annotations

import heapq
import itertools
import json
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scanlake.llm.common import append, in_batches

#: Words held for a task with their ids, characters of texts and symbols of new words that are worked on at once.
CACHE, CHARS, SYMBOLS = 200_000, 2_000_000, 2_000_000
#: Tokens on each side of an incompatible pair that are merged again at first; a word of fewer is merged as a whole.
AROUND = 16
#: Rows of up to so many symbols are merged by scanning them for the least pair, longer ones by a heap.
SCANNED = 256
#: The rank of pairs without a merge.
NEVER = np.int64(1) << 60


@dataclass
class Tokenizer:
    """A vocabulary with its merges, and how texts are split into words."""

    tokens: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    pattern: str
    added: dict[str, int]
    source: str


def read_tokenizer(path: str) -> Tokenizer:
    """A tokenizer file: NFC and lower case, words by a pattern, bytes as characters, merges with a word-end suffix.

    Other normalisers, splits or models are refused.
    """
    with open(path, encoding="utf-8") as file:
        source = file.read()
    told = json.loads(source)
    model, split = told["model"], told["pre_tokenizer"]["pretokenizers"]
    steps = [s["type"] for s in told["normalizer"]["normalizers"]]
    options = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
    if (
        model["type"] != "BPE" or any(model[o] for o in options) or not model["end_of_word_suffix"]
        or steps != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in split] != ["Split", "ByteLevel"]
        or split[0]["behavior"] != "Removed" or not split[0]["invert"] or split[1]["add_prefix_space"] or split[1]["use_regex"]
        or any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in told["added_tokens"])
        or told["decoder"] or told["post_processor"]
    ):
        raise ValueError(f"{path} asks for more than words of merged bytes")
    return Tokenizer(
        model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"], split[0]["pattern"]["Regex"],
        {a["content"]: a["id"] for a in told["added_tokens"]}, source,
    )


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from code point 256 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in itself else next(rest)) for b in range(256)]


class Encoder:
    """Encodes words, given as bytes, in one task."""

    def __init__(self, tokenizer: Tokenizer):
        vocab, suffix = tokenizer.tokens, tokenizer.suffix
        ids = {token: id_ for token, id_ in vocab.items()}
        #: Ids of the 256 bytes, then of the same bytes as a word's last.
        self.symbol = np.array([ids[c + end] for end in ("", suffix) for c in byte_characters()], np.int64)
        size = max(ids.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(tokenizer.merges):
            made = ids[a + b]
            if self.rank[made] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[made], self.left[made], self.right[made] = rank, ids[a], ids[b]
            self.rules[ids[a], ids[b]] = rank, made
        self.size = size
        pairs = np.array([a * size + b for a, b in self.rules], np.int64)
        order = np.argsort(pairs)
        self.pair_keys = pairs[order]
        self.pair_ranks, self.pair_made = np.array(list(self.rules.values()), np.int64)[order].T.copy()
        self._grow_trie(ids, suffix)
        made = np.flatnonzero(self.rank >= 0)
        #: Tokens that their own symbols are not merged to, because another merge comes first.
        self.unsound = np.zeros(size, bool)
        self.unsound[made] = ~self._apart(self.left[made], self.right[made], self.rank[made])
        while True:
            more = self.unsound | (self.unsound[self.left] | self.unsound[self.right])
            if (more == self.unsound).all():
                break
            self.unsound = more

    def _grow_trie(self, ids: dict[str, int], suffix: str) -> None:
        """Children as sorted numbers ``node * 512 + symbol``; ``accepts`` has the token that ends in a node, or -1."""
        value = {c: b for b, c in enumerate(byte_characters())}
        known = set(map(int, self.symbol)) | {int(t) for t in np.flatnonzero(self.rank >= 0)}
        children: dict[int, int] = {}
        accepts, lengths = [-1], {}
        for token, id_ in ids.items():
            if id_ not in known:
                continue
            last = token.endswith(suffix) and len(token) > len(suffix)
            spelt = [value[c] for c in (token[: -len(suffix)] if last else token)]
            if last:
                spelt[-1] += 256
            node = 0
            for s in spelt:
                key = node * 512 + s
                if key not in children:
                    children[key] = len(accepts)
                    accepts.append(-1)
                node = children[key]
            accepts[node] = id_
            lengths[id_] = len(spelt)
        keys = np.fromiter(children, np.int64, len(children))
        order = np.argsort(keys)
        self.child_keys, self.child_nodes = keys[order], np.fromiter(children.values(), np.int64, len(children))[order]
        self.accepts = np.array(accepts, np.int64)
        self.length = np.ones(self.size, np.int64)
        self.length[list(lengths)] = list(lengths.values())

    def _rule(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or ``NEVER``."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The tokens that pairs which have a merge are merged to."""
        return self.pair_made[np.searchsorted(self.pair_keys, a * self.size + b)]

    def _apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether the merges of ``a`` and of ``b``, next to each other, leave their border alone up to rank ``before``.

        ``u`` and ``v`` are the tokens on both sides of the border at some time, ``u_end`` and ``v_end`` the ranks
        by which they were merged away from it. A merge of equal rank goes to the pair further left.
        """
        apart = np.ones(len(a), bool)
        at = np.arange(len(a))
        u, v = a.copy(), b.copy()
        u_end = np.broadcast_to(np.asarray(before, np.int64), a.shape).copy()
        v_end = u_end - 1
        while len(at):
            across = self._rule(u, v)
            bad = (across < u_end) & (across <= v_end)
            apart[at[bad]] = False
            go = ~bad & ((self.rank[u] >= 0) | (self.rank[v] >= 0))
            at, u, v, u_end, v_end = at[go], u[go], v[go], u_end[go], v_end[go]
            undo = self.rank[u] > self.rank[v]
            u_end, v_end = np.where(undo, self.rank[u], u_end), np.where(undo, v_end, self.rank[v])
            u, v = np.where(undo, self.right[u], u), np.where(undo, v, self.left[v])
        return apart

    def _bad_pairs(self, tokens: np.ndarray) -> np.ndarray:
        """For each token but the last whether it and the next aren't compatible, or it isn't sound."""
        pairs, back = np.unique(tokens[:-1] * self.size + tokens[1:], return_inverse=True)
        return ~self._apart(pairs // self.size, pairs % self.size)[back] | self.unsound[tokens[:-1]] | self.unsound[tokens[1:]]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word; of an empty one, none."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        some = sizes > 0
        symbols[ends[some] - 1] += 256
        begins, tokens = self._propose(symbols, starts[some], ends[some])
        word = np.searchsorted(starts[some], begins, "right") - 1
        bad = np.zeros(len(tokens), bool)
        if len(tokens) > 1:
            bad[:-1] = self._bad_pairs(tokens) & (word[:-1] == word[1:])
        bad |= self.unsound[tokens]
        edges = np.searchsorted(word, np.arange(int(some.sum()) + 1))
        failed = np.zeros(int(some.sum()), bool)
        failed[word[bad]] = True
        again = failed & (np.diff(edges) <= 2 * AROUND)
        merged = dict(zip(np.flatnonzero(again).tolist(), self._merge_all(symbols, starts[some][again], ends[some][again])))
        every = tokens.tolist()
        found: list[list[int]] = [[] for _ in words]
        for at, k in enumerate(np.flatnonzero(some).tolist()):
            low, high = int(edges[at]), int(edges[at + 1])
            if at in merged:
                found[k] = merged[at]
            elif failed[at]:
                found[k] = self._settle(symbols[starts[k] : ends[k]], tokens[low:high], bad[low:high])
            else:
                found[k] = every[low:high]
        return found

    def _propose(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and tokens of the greedy longest matches of words that lie behind each other in ``symbols``."""
        best = self.symbol[symbols]
        at, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(at):
            keys = node * 512 + symbols[at + depth]
            found = np.minimum(np.searchsorted(self.child_keys, keys), len(self.child_keys) - 1)
            on = self.child_keys[found] == keys
            at, node, depth = at[on], self.child_nodes[found[on]], depth + 1
            token = self.accepts[node]
            best[at[token >= 0]] = token[token >= 0]
            inside = at + depth < len(symbols)
            at, node = at[inside], node[inside]
        after = np.arange(len(symbols)) + self.length[best]
        reached = np.zeros(len(symbols) + 1, bool)
        here, upto = starts, ends
        while len(here) > 64:
            reached[here] = True
            here = after[here]
            here, upto = here[here < upto], upto[here < upto]
        for begin, end in zip(here.tolist(), upto.tolist()):
            jumps, path = after[begin:end].tolist(), []
            place = begin
            while place < end:
                path.append(place)
                place = jumps[place - begin]
            reached[path] = True
        begins = np.flatnonzero(reached)
        return begins, best[begins]

    def _settle(self, symbols: np.ndarray, tokens: np.ndarray, bad: np.ndarray) -> list[int]:
        """The exact ids of a word from proposed ones, of which the ``bad`` don't go with the next."""
        around = AROUND
        while True:
            if len(tokens) <= 2 * around:
                return self._merge(self.symbol[symbols].tolist())
            upto = np.concatenate([[0], np.cumsum(self.length[tokens])])
            new: list[int] = []
            done, at = 0, 0
            where = np.flatnonzero(bad).tolist()
            while at < len(where):
                low, high = max(done, where[at] + 1 - around), where[at] + 1 + around
                at += 1
                while at < len(where) and where[at] + 1 - around <= high:
                    high = where[at] + 1 + around
                    at += 1
                high = min(high, len(tokens))
                new += tokens[done:low].tolist()
                new += self._merge(self.symbol[symbols[upto[low] : upto[high]]].tolist())
                done = high
            tokens = np.array(new + tokens[done:].tolist(), np.int64)
            bad = np.append(self._bad_pairs(tokens), self.unsound[tokens[-1]]) if len(tokens) > 1 else self.unsound[tokens]
            if not bad.any():
                return tokens.tolist()
            around *= 2

    def _merge_all(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """Merges many words, in all of them at once the leftmost pair of least rank, until there is none."""
        sizes = ends - starts
        word = np.repeat(np.arange(len(sizes)), sizes)
        tokens = self.symbol[symbols[np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]]
        ranks = np.full(len(tokens), NEVER)
        inner = np.flatnonzero(word[:-1] == word[1:])
        ranks[inner] = self._rule(tokens[inner], tokens[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(tokens):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(ranks, first), np.diff(first, append=len(word)))
            over = least == NEVER
            done.append((word[over], tokens[over]))
            at = np.flatnonzero((ranks == least) & ~over)
            if not len(at):
                break
            at = at[np.diff(word[at], prepend=-1) != 0]
            tokens[at] = self._made(tokens[at], tokens[at + 1])
            over[at + 1] = True
            place = np.cumsum(~over) - 1
            at = place[at]
            tokens, word, ranks = tokens[~over], word[~over], ranks[~over]
            ends_here = np.append(word[1:] != word[:-1], True)
            ranks[at] = np.where(ends_here[at], NEVER, self._rule(tokens[at], tokens[np.minimum(at + 1, len(tokens) - 1)]))
            left = at[(at > 0) & (word[at - 1] == word[at])] - 1
            ranks[left] = self._rule(tokens[left], tokens[left + 1])
        words, merged = (np.concatenate(c) for c in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(words, kind="stable")
        upto = np.searchsorted(words[order], np.arange(len(sizes) + 1))
        ids = merged[order].tolist()
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def _merge(self, tokens: list[int]) -> list[int]:
        """Merges the leftmost pair of least rank until there is none."""
        if len(tokens) > SCANNED:
            return self._merge_by_heap(tokens)
        rules, none = self.rules, (sys.maxsize, -1)
        ranks = [rules.get(pair, none)[0] for pair in zip(tokens, tokens[1:])]
        while ranks:
            least = min(ranks)
            if least == sys.maxsize:
                break
            at = ranks.index(least)
            tokens[at : at + 2] = [rules[tokens[at], tokens[at + 1]][1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rules.get((tokens[at - 1], tokens[at]), none)[0]
            if at < len(ranks):
                ranks[at] = rules.get((tokens[at], tokens[at + 1]), none)[0]
        return tokens

    def _merge_by_heap(self, tokens: list[int]) -> list[int]:
        """The same for a long row: pairs wait in a heap, and count only if both tokens are still there."""
        rules, n = self.rules, len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rules[pair][0], at, *pair) for at, pair in enumerate(zip(tokens, tokens[1:])) if pair in rules]
        heapq.heapify(heap)
        while heap:
            _, at, a, b = heapq.heappop(heap)
            other = after[at]
            if tokens[at] != a or other >= n or tokens[other] != b:
                continue
            tokens[at], tokens[other] = rules[a, b][1], -1
            after[at] = beyond = after[other]
            if beyond < n:
                before[beyond] = at
                pair = tokens[at], tokens[beyond]
                if pair in rules:
                    heapq.heappush(heap, (rules[pair][0], at, *pair))
            if before[at] >= 0:
                pair = tokens[before[at]], tokens[at]
                if pair in rules:
                    heapq.heappush(heap, (rules[pair][0], before[at], *pair))
        return [t for t in tokens if t >= 0]


class Splitter:
    """Texts to words (as strings) and the added tokens between them (as ids)."""

    def __init__(self, tokenizer: Tokenizer):
        self.added, self.tokenizer = tokenizer.added, tokenizer
        by_length = sorted(tokenizer.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.find = regex.compile(tokenizer.pattern).findall
        #: Characters met that have a category in this Python's Unicode tables.
        self.assigned: set[str] = set()

    def split(self, text: str) -> list[str | int]:
        if not self.marks or not self.marks.search(text):
            return self._words(text)
        found: list[str | int] = []
        for part in self.marks.split(text):
            if part in self.added:
                found.append(self.added[part])
            elif part:
                found += self._words(part)
        return found

    def _words(self, text: str) -> list[str]:
        """White space needs no step of its own, as no word holds any. Capital sigma has one small form here."""
        if not text.isascii():
            new = set(text) - self.assigned
            self.assigned |= {c for c in new if unicodedata.category(c) != "Cn"}
            if not new <= self.assigned:
                return self._words_of_newer_characters(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def _words_of_newer_characters(self, text: str) -> list[str]:
        """Characters that Python's tables don't know are normalised and split by the library's own tables."""
        from tokenizers import Tokenizer as Library

        if not hasattr(self, "library"):
            self.library = Library.from_str(self.tokenizer.source)
            self.byte = {c: b for b, c in enumerate(byte_characters())}
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in word).decode() for word, _ in words]


class _Words:
    """The ids of the words met last, and the texts made of them."""

    def __init__(self, tokenizer: Tokenizer):
        self.encoder, self.splitter = Encoder(tokenizer), Splitter(tokenizer)
        self._forget()

    def _forget(self) -> None:
        #: Each word's place in ``ends``, which bounds its ids in ``ids``; added tokens stand for themselves.
        self.place: dict[str | int, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str | int]) -> None:
        words = [w for w in new if isinstance(w, str)]
        begin = 0
        while begin < len(words):
            end, size = begin, 0
            while end < len(words) and (end == begin or size < SYMBOLS):
                size += len(words[end])
                end += 1
            some = words[begin:end]
            self._keep(some, self.encoder.encode([w.encode() for w in some]))
            begin = end
        marks = [w for w in new if not isinstance(w, str)]
        self._keep(marks, [[w] for w in marks])

    def _keep(self, words: Sequence[str | int], ids: list[list[int]]) -> None:
        self.place |= zip(words, range(len(self.place), len(self.place) + len(words)))
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([*map(len, ids)], dtype=np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and how many each has."""
        split = [self.splitter.split(t) for t in texts]
        parts = list(itertools.chain.from_iterable(split))
        new = [p for p in dict.fromkeys(parts) if p not in self.place]
        if len(self.place) + len(new) > CACHE and self.place:
            self._forget()
            new = list(dict.fromkeys(parts))
        self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        begins, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begins - upto[:-1], sizes)]
        return ids, np.diff(upto[np.cumsum([0, *map(len, split)])])


def encode(
    docs: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: str = "token_ids", keep: Sequence[str] | None = None
) -> DataFrame:
    """``keep`` columns (all) of ``docs`` with ``ids``, an array of integers: the whole text's tokens.

    Added tokens in a text are found before it is normalised, and none are put in. A null text counts as an
    empty one, which has no ids. A column called ``ids`` is replaced. One row gives one row, so equal rows stay.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != ids]
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or _Words(held.value)
            found = [words.encode(some) for some in _in_portions(batch.column(text))]
            values, sizes = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            yield append(batch.select(keep), **{ids: pa.ListArray.from_arrays(ends, pa.array(values))})

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.transform(in_batches, scan, schema)


def _in_portions(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in turn, some million characters or one text at a time; a null as an empty one."""
    some: list[str] = []
    size = 0
    for value in texts:
        some.append(value.as_py() or "")
        size += len(some[-1])
        if size >= CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def decode(rows: DataFrame, tokenizer: Tokenizer, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids``: the tokens as the vocabulary spells them, joined by spaces.

    Ids that the vocabulary doesn't have, and nulls, are left out, as the library does; of null or no ids the text is
    empty. A column called ``name`` is replaced.
    """
    held = rows.sparkSession.sparkContext.broadcast(tokenizer)
    kept = [f for f in rows.schema if f.name != name]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = None
        for batch in batches:
            spelt = spelt or _spelling(held.value)
            offered, column = len(spelt), batch.column(ids)
            taken = column.flatten().to_numpy(zero_copy_only=False)
            sizes = [0 if n is None else n for n in pc.list_value_length(column).to_pylist()]
            numbers = np.where(np.isnan(taken), -1, taken).astype(np.int64) if taken.dtype.kind == "f" else taken.astype(np.int64)
            out, begin = [], 0
            for size in sizes:
                part = numbers[begin : begin + size].tolist()
                begin += size
                out.append(" ".join([s for i in part if 0 <= i < offered and (s := spelt[i]) is not None]))
            yield append(batch.select([f.name for f in kept]), **{name: pa.array(out, pa.string())})

    return rows.transform(in_batches, scan, T.StructType([*kept, T.StructField(name, T.StringType())]))


def _spelling(tokenizer: Tokenizer) -> list[str | None]:
    every = {**tokenizer.tokens, **tokenizer.added}
    spelt: list[str | None] = [None] * (max(every.values()) + 1)
    for token, id_ in every.items():
        spelt[id_] = token
    return spelt
