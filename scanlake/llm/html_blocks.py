"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks: runs of text between block-level tags. A block's
vector has the hashed names, classes and ids of its tag path, its hashed words, and a few measures.
A bidirectional LSTM in numpy goes over the whole sequence, and a logistic layer on both directions'
states labels each block as main text or not, so every decision sees the whole page.

Nothing labels the pages, so training labels are drawn from what tags and class names say on
a bounded sample of pages, and the sample is multiplied by variants in which wrappers change their
names and menus, notices, forms, comments and adverts of many forms are put in. Training runs once, on
at most ``sample`` pages; labelling runs in the tasks, batched over pages of like length.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.llm.common import append, in_batches

PATH_DIM, WORD_DIM = 256, 24
DIM = 2 * PATH_DIM + WORD_DIM + 6
HIDDEN = 20
CELLS = 12_000

TAG = re.compile(
    r"<(?:!--(?:.*?(?:-->|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)(>|\Z|[\"'].*\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "template", "iframe", "noembed", "noframes", "svg", "math")}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, if it is open above it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADS = frozenset("p h1 h2 h3 h4 h5 h6".split())

#: Tags and parts of class names, ids and roles that mark what is not main text, for training labels.
OTHER_TAGS = frozenset("nav header footer aside form button select option head title noscript dialog menu label legend".split())
OTHER_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal "
    "newsletter subscribe signup login share sharing social menu nav navbar navigation breadcrumb breadcrumbs sidebar side "
    "widget related recommended footer header masthead copyright legal comment comments reply replies disqus respond tags search pagination pager toolbar skip".split()
)


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """Path, text and share of link text of each leaf block of a page, in order.

    White space is single spaces and character references are decoded. Scripts, styles and comments
    give no blocks. Unclosed tags are closed by what must end them; markup that breaks off is left out.
    """
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    linked = 0
    link_depth = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append((tuple(p for _, p in stack), text, min(1.0, linked / len(text))))
        pieces.clear()
        linked = 0

    def text_piece(raw: str) -> None:
        nonlocal linked
        raw = entities.unescape(raw) if "&" in raw else raw
        pieces.append(raw)
        linked += len(raw) if link_depth else 0

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            text_piece(page[at:])
            break
        if begin > at:
            text_piece(page[at:begin])
        found = TAG.match(page, begin)
        if not found:
            text_piece("<")
            at = begin + 1
            continue
        at = found.end()
        if found[2] is None:
            continue
        name, closing = found[2].lower(), bool(found[1])
        if name == "a":
            link_depth = 0 if closing else 1
        if name in INLINE:
            continue
        if name == "br":
            pieces.append("\n")
            continue
        flush()
        if name in VOID:
            continue
        link_depth = 0
        if closing:
            if any(t == name for t, _ in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if stack and stack[-1][0] in HEADS:
            stack.pop()
        while stack and stack[-1][0] in CLOSES.get(name, ()):
            stack.pop()
        if name in RAW and not found[3].endswith("/"):
            end = RAW[name].search(page, at)
            if not end:
                break
            at = page.find(">", end.end()) + 1 or size
            continue
        if not found[3].endswith("/") or name in ("p", "div", "li"):
            stack.append((name, _step(name, found[3])))
    flush()
    return out


def _step(name: str, attributes: str) -> str:
    """A tag with the parts of its class, id and role."""
    if "=" not in attributes:
        return name
    parts = [p for a in ATTRIBUTE.finditer(attributes) for p in re.split(r"[^a-z]+", (a[2] or a[3] or a[4] or "").lower()) if p]
    return " ".join([name, *parts])


def _slot(token: str, dim: int) -> int:
    return zlib.crc32(token.encode()) % dim


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Names anywhere on the path, and the names of its last two steps by themselves."""
    vector = np.zeros(2 * PATH_DIM, np.float32)
    for step in path:
        for token in step.split():
            vector[_slot(token, PATH_DIM)] = 1
    for step in path[-2:]:
        for token in step.split():
            vector[PATH_DIM + _slot(token, PATH_DIM)] = 1
    return vector


def features(blocks: list[tuple[tuple[str, ...], str, float]], paths: dict) -> np.ndarray:
    """A row per block. ``paths`` keeps vectors of paths seen before."""
    x = np.zeros((len(blocks), DIM), np.float32)
    for k, (path, text, linked) in enumerate(blocks):
        known = paths.get(path)
        if known is None:
            if len(paths) > 20_000:
                paths.clear()
            known = paths[path] = path_vector(path)
        x[k, : 2 * PATH_DIM] = known
        words = text.split(" ")
        slots = np.fromiter((zlib.crc32(w.encode()) % WORD_DIM for w in words), np.int64, len(words))
        x[k, 2 * PATH_DIM : -6] = np.bincount(slots, minlength=WORD_DIM) / len(words)
        stops = sum(map(text.count, ".,;!?"))
        x[k, -6:] = np.log1p(len(words)) / 5, linked, stops / len(words), k / len(blocks), text[-1] in ".!?", len(words) < 4
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = (rng.standard_normal((DIM, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.p["h" + d] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.p["b" + d] = np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)
        self.p["o"] = (rng.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States along axis 1 of ``x`` (sequence, step, feature), which ends are padding."""
        n, steps, _ = x.shape
        gates = x @ self.p["x" + d] + self.p["b" + d]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        states, saved = np.empty((n, steps, HIDDEN), np.float32), []
        for t in range(steps):
            g = gates[:, t] + h @ self.p["h" + d]
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            before, c_before = h, c
            c = f * c + i * u
            tanh_c = np.tanh(c)
            h = o * tanh_c
            states[:, t] = h
            if keep:
                saved.append((i, f, o, u, c_before, tanh_c, before))
        return states, saved

    def scores(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Log-odds of main text for each step; padding follows each sequence's end."""
        turned = _turn(sizes, x.shape[1])
        rows = np.arange(len(x))[:, None]
        ahead, saved_f = self._run(x, "f", keep)
        back, saved_b = self._run(x[rows, turned], "b", keep)
        both = np.concatenate([ahead, back[rows, turned]], axis=2)
        return both @ self.p["o"] + self.p["c"], (both, turned, saved_f, saved_b)

    def _back(self, x: np.ndarray, d: str, saved: list, given: np.ndarray, grad: dict) -> None:
        n, steps, _ = x.shape
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        d_gates = np.empty((n, steps, 4 * HIDDEN), np.float32)
        grad["h" + d] = np.zeros_like(self.p["h" + d])
        for t in reversed(range(steps)):
            i, f, o, u, c_before, tanh_c, before = saved[t]
            dh = dh + given[:, t]
            dc = dc + dh * o * (1 - tanh_c**2)
            d_gates[:, t] = np.concatenate(
                [dc * u * i * (1 - i), dc * c_before * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - u**2)], axis=1
            )
            grad["h" + d] += before.T @ d_gates[:, t]
            dh = d_gates[:, t] @ self.p["h" + d].T
            dc = dc * f
        flat = d_gates.reshape(-1, 4 * HIDDEN)
        grad["x" + d] = x.reshape(-1, DIM).T @ flat
        grad["b" + d] = flat.sum(axis=0)

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the steps that aren't padding."""
        z, (both, turned, saved_f, saved_b) = self.scores(x, sizes, keep=True)
        real = np.arange(x.shape[1]) < sizes[:, None]
        dz = np.where(real, 1 / (1 + np.exp(-z)) - y, 0).astype(np.float32) / real.sum()
        grad = {"o": np.einsum("ntk,nt->k", both, dz), "c": np.array([dz.sum()], np.float32)}
        d_both = dz[:, :, None] * self.p["o"]
        rows = np.arange(len(x))[:, None]
        self._back(x, "f", saved_f, d_both[:, :, :HIDDEN], grad)
        self._back(x[rows, turned], "b", saved_b, d_both[rows, turned, HIDDEN:], grad)
        return grad


def _turn(sizes: np.ndarray, steps: int) -> np.ndarray:
    """For each sequence the positions in reverse, with the padding left where it is."""
    t = np.arange(steps)
    return np.where(t < sizes[:, None], sizes[:, None] - 1 - t, t)


def _pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sequences])
    x = np.zeros((len(sequences), sizes.max(), *sequences[0].shape[1:]), np.float32)
    for k, s in enumerate(sequences):
        x[k, : len(s)] = s
    return x, sizes


def _label(path: tuple[str, ...]) -> bool:
    """What tags and names say: main text unless something on the path marks it as other."""
    tokens = [step.split() for step in path]
    return not any(t[0] in OTHER_TAGS or OTHER_NAMES & set(t[1:]) for t in tokens)


MAIN_WRAPPERS = ["article", "main", "div content", "div post", "section article body", "div story", "div entry content", "div main", "div x", "div page text"]
INSERTS = [
    ("header",), ("header", "div logo"), ("header", "nav", "ul", "li"), ("nav", "a"), ("div menu", "ul", "li"), ("div nav bar", "ul", "li"), ("ul menu", "li"),
    ("div ad",), ("div ads",), ("div advert", "p"), ("aside ad",), ("div sponsored", "p"), ("div banner",), ("div promo", "p"), ("ins adsby",),
    ("aside", "p"), ("aside", "ul", "li"), ("aside sidebar", "h3"), ("aside sidebar", "p"), ("div sidebar", "ul", "li"), ("div sidebar", "p"), ("div widget", "p"),
    ("div cookie notice",), ("div cookie", "p"), ("div notice", "p"), ("div consent", "p"), ("div alert",), ("div popup", "p"), ("div newsletter", "p"),
    ("form",), ("form", "p"), ("form", "label"), ("form search",), ("form", "div"), ("form", "button"), ("button",), ("form", "select", "option"),
    ("section comments", "div comment", "p"), ("section comments", "h2"), ("div comments", "div comment", "p"), ("div comment", "p"), ("div comments", "p"),
    ("ol comments", "li comment", "p"), ("ul comments", "li"), ("section comments", "p"), ("section comments", "article comment", "p"),
    ("div share",), ("div social", "ul", "li"), ("div related", "ul", "li"), ("div breadcrumb",), ("nav breadcrumb", "ol", "li"),
    ("footer",), ("footer", "p"), ("footer", "div", "ul", "li"), ("div footer",), ("div copyright",), ("noscript",), ("div header", "h1"), ("header", "h1"), ("dialog", "p"),
]


def _variant(rng: random.Random, blocks: list) -> list:
    """A page like this one with other wrappers and more that isn't main text, with labels."""
    wrapper = rng.choice(MAIN_WRAPPERS)
    out = []
    for path, text, linked in blocks:
        main = _label(path)
        path = tuple(wrapper if main and step.split()[0] in ("article", "main") else step for step in path)
        out.append(((path, text, linked), main))
    inside = [k for k, (_, main) in enumerate(out) if main]
    pool = [text for _, text, _ in blocks]
    for _ in range(rng.randrange(2, 9)):
        path = rng.choice(INSERTS)
        base: tuple[str, ...] = ("html", "body")
        at = rng.randrange(len(out) + 1)
        if inside and rng.random() < 0.5:
            at = rng.choice(inside)
            base = (*base, wrapper)
        text = rng.choice(pool)
        if rng.random() < 0.5:
            text = " ".join(text.split(" ")[: rng.randrange(1, 9)])
        several = rng.randrange(1, 5)
        linked = float(rng.random() < 0.8) if "li" in path or "nav" in path else 0.0
        out[at:at] = [((base + path, text, linked), False)] * several
        inside = [k for k, (_, main) in enumerate(out) if main]
    return out


def train(pages: DataFrame, html: str = "html", sample: int = 200, longest: int = 60_000, variants: int = 4, epochs: int = 10, seed: int = 0) -> Labeller:
    """A labeller fitted to at most ``sample`` pages of up to ``longest`` characters, picked by a hash of the page.

    A share that should hold twice the sample is taken first, so what reaches the driver is bounded, too.
    """
    some = pages.where(F.col(html).isNotNull() & (F.length(html) <= longest)).select(F.col(html).alias("html"))
    share = 2.0 * sample / max(1, some.count())
    few = some.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    chosen = [r.html for r in few.orderBy(F.xxhash64("html"), "html").limit(sample).collect()]
    rng = random.Random(seed)
    paths: dict = {}
    data: list[tuple[np.ndarray, np.ndarray]] = []
    for page in chosen:
        blocks = blocks_of(page)[:400]
        if blocks:
            plain = [(b, _label(b[0])) for b in blocks]
            for pairs in [plain] + [_variant(rng, blocks) for _ in range(variants)]:
                data.append((features([b for b, _ in pairs], paths), np.array([y for _, y in pairs], np.float32)))
    model, m, v, step = Labeller(seed), {}, {}, 0
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda k: (len(data[k][0]) // 8, rng.random()))
        batches = [order[k : k + 32] for k in range(0, len(order), 32)]
        rng.shuffle(batches)
        for batch in batches:
            x, sizes = _pad([data[k][0] for k in batch])
            y, _ = _pad([data[k][1] for k in batch])
            grad, step = model.gradient(x, sizes, y), step + 1
            rate = 0.01 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g in grad.items():
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                model.p[name] -= (rate * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[list], paths: dict) -> list[np.ndarray]:
    """For each page, which of its blocks are main text."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * len(pages[order[upto]]) <= CELLS:
            upto += 1
        some = order[at:upto]
        x, sizes = _pad([features(pages[k], paths) for k in some])
        z, _ = model.scores(x, sizes)
        for row, k in enumerate(some):
            out[k] = z[row, : sizes[row]] > 0
        at = upto
    return out


def extract(pages: DataFrame, model: Labeller, html: str = "html", name: str = "text", drop_html: bool = False) -> DataFrame:
    """``pages`` with ``name``, the main blocks of each page joined by spaces; of a null or empty page, an empty text.

    A column called ``name`` is replaced.
    """
    gone = {name} | ({html} if drop_html else set())
    held = pages.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict = {}
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, 500):
                parsed = [blocks_of(v.as_py() or "") for v in batch.column(html).slice(at, 500)]
                chosen = label(held.value, parsed, paths)
                texts += [" ".join(b[1] for b, main in zip(blocks, which) if main) for blocks, which in zip(parsed, chosen)]
            yield append(batch.select([c for c in batch.schema.names if c not in gone]), **{name: pa.array(texts, pa.string())})

    fields = [f for f in pages.schema if f.name not in gone]
    return pages.transform(in_batches, scan, T.StructType([*fields, T.StructField(name, T.StringType())]))
