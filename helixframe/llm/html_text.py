"""Main text of web pages by a recurrent block labeller.

A page is read into blocks: what lies between the starts and ends of block elements, with character
references decoded and white space made single. Tags are read in the HTML standard's states, in time
linear in the page however malformed it is. Scripts, styles, titles and comments of the markup never
make a block, nor does what stands in elements such as object or select, which are ended by their end
tag, by that of an element around them, or by what they can't hold, and hide nothing if they never end.
Each block has a vector: hashed tags and classes on the path to it, hashed words,
and a few figures. A bidirectional LSTM reads the page's vectors in both directions and gives each
block's probability to be main text, so that the decision depends on the whole page.

The labeller is trained here, with numpy, on made-up pages (html_pages) from a fixed seed; it has
seen no page of the tables. Training takes some seconds on the driver, once in a session.

Defined results: null or empty html, or a page without main text, gives an empty text. Pages of any
length are read whole, those of many blocks by parts, with memory for a figure a block. Equal rows each
get a row; an empty table gives an empty result. Of the columns carried along, one that is named text or
n_chars gives way to the result's; others, of whatever name, don't matter.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, html_pages

PATH_BINS, WORD_BINS, FIGURES, HIDDEN = 512, 32, 8, 24
TRAIN_PAGES, EPOCHS, BATCH, SEED = 5000, 5, 80, 11
#: Blocks that the labeller reads at once.
GROUP_BLOCKS = 6000
#: Elements that stand in a line of text; every other one begins and ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: those that are read up to their end tag whatever looks like markup, and others.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HIDDEN_ELEMENTS = frozenset("template noscript svg math object canvas audio video select".split())
#: Elements that say nothing of where a block stands, and whose tags may be left out.
_FRAME = frozenset(("html", "head", "body"))
#: Start tags that svg and math can't hold, after the HTML standard (fixed values).
_BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main aside nav header footer form".split()
)
#: Elements that end an open paragraph, and siblings that end one another.
_PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}
#: Elements inside one another, beyond which further ones count as siblings.
DEEPEST = 512
#: A comment, declaration or tag, in the HTML standard's states: a quote only opens a value behind an equals sign, and a tag
#: that is never closed goes on to the end of the page. No part gives back what it has read, so that time is linear.
_TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?:>|[^a-zA-Z][^>]*+(?:>|\Z))"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++|(?=>)))?+)*+)(?:>|\Z))",
    re.S,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW | HIDDEN_ELEMENTS}


@lru_cache(200_000)
def _word_bin(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORD_BINS


@lru_cache(20_000)
def _path_bin(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % PATH_BINS


class Path:
    """An open element below others. bits: the hashed words of all of them; equal paths of a page are one object."""

    __slots__ = ("bits", "depth", "last", "below", "_vector")

    def __init__(self, bits: int = 0, depth: int = 0, last: int = -1):
        self.bits, self.depth, self.last = bits, depth, last
        self.below: dict[str, Path] = {}
        self._vector: np.ndarray | None = None

    def child(self, tag: str, told: str) -> Path:
        key = f"{tag} {told}"
        got = self.below.get(key)
        if got is None:
            bits = self.bits
            for word in (tag, *("." + w for w in re.split(r"[^a-z]+", told) if w)):
                bits |= 1 << _path_bin(word) | 1 << _path_bin("again " + word)  # two bins, of which others seldom share both
            got = self.below[key] = Path(bits, self.depth + 1, _path_bin("last " + tag))
        return got

    def vector(self) -> np.ndarray:
        if self._vector is None:
            packed = np.frombuffer(self.bits.to_bytes(PATH_BINS // 8, "little"), np.uint8)
            self._vector = np.unpackbits(packed, bitorder="little").astype(np.float32)
            if self.last >= 0:
                self._vector[self.last] = 1
        return self._vector


class Blocks:
    """A page's blocks: texts, paths, link shares."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.paths: list[Path] = []
        self.links: list[float] = []
        self._parts: list[str] = []
        self._linked = 0
        self._read(page)

    def _close(self, path: Path) -> None:
        if self._parts:
            raw = "".join(self._parts)
            text = " ".join(raw.split())
            if text:
                self.texts.append(text)
                self.paths.append(path)
                self.links.append(min(1.0, self._linked / len(text)))
            self._parts.clear()
            self._linked = 0

    def _read(self, page: str) -> None:
        names: list[str] = []  # open block elements, and the paths to them
        paths = [Path()]
        is_open: Counter[str] = Counter()
        deeper = 0  # open elements beyond DEEPEST
        hidden, inside = "", Counter()  # an element that hides what it holds, and what is open in it
        last_end: dict[str, int] = {}
        in_link, at, end = 0, 0, len(page)

        def ends_after(name: str, place: int) -> bool:
            """Whether the element has an end tag from there on; found once for each name."""
            if name not in last_end:
                last_end[name] = max((m.start() for m in _ENDS[name].finditer(page)), default=-1)
            return last_end[name] >= place

        def pop() -> None:
            is_open[names.pop()] -= 1
            paths.pop()

        while at < end:
            m = _TOKEN.search(page, at)
            to = m.start() if m else end
            if to > at and not hidden:
                piece = page[at:to]
                if "&" in piece:
                    piece = html.unescape(piece)
                self._parts.append(piece)
                if in_link:
                    self._linked += len(piece.strip())
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            name, closing = m[2].lower(), bool(m[1])
            alone = name in VOID or m[3].endswith("/")
            if hidden:
                if closing:
                    if inside[name] > 0:
                        inside[name] -= 1
                        continue
                    if name == hidden or not is_open[name]:
                        hidden = "" if name == hidden else hidden
                        continue
                    hidden = ""  # its parent ends
                elif (hidden in ("svg", "math") and name in _BREAKOUT and not inside["foreignobject"]) or (hidden == "select" and name not in INLINE and name not in ("option", "optgroup", "hr", "script", "template")):
                    hidden = ""  # it can't hold this
                else:
                    if name in RAW:
                        stop = _ENDS[name].search(page, at) if ends_after(name, at) else None
                        at = stop.end() if stop else at
                    elif not alone:
                        inside[name] += 1
                    continue
            if name in RAW and not closing:
                if ends_after(name, at):
                    at = _ENDS[name].search(page, at).end()
                elif name in ("script", "style"):
                    at = end
                self._close(paths[-1])
                continue
            if name in HIDDEN_ELEMENTS:
                if name not in ("svg", "math"):
                    self._close(paths[-1])
                if not closing and not alone and ends_after(name, at):
                    hidden, inside = name, Counter()
                continue
            if name in INLINE:
                if name == "a":
                    in_link = 0 if closing else 1
                elif name in ("br", "td", "th"):
                    self._parts.append(" ")
                continue
            self._close(paths[-1])
            in_link = 0
            if name in _FRAME:
                continue
            if closing:
                if deeper:
                    deeper -= 1
                elif is_open[name]:
                    while names[-1] != name:
                        pop()
                    pop()
                continue
            if not deeper:
                if names and names[-1] == "p":
                    pop()
                for peer in _PEERS.get(name, ()):
                    if names and names[-1] == peer:
                        pop()
            if alone:
                continue
            if len(names) >= DEEPEST:
                deeper += 1
                continue
            told = " ".join(x for found in _NAMES.findall(m[3]) for x in found if x).lower() if m[3] else ""
            names.append(name)
            is_open[name] += 1
            paths.append(paths[-1].child(name, told))
        self._close(paths[-1])


def vectors(blocks: Blocks, first: int = 0, stop: int | None = None) -> np.ndarray:
    """A row for each block from first to stop."""
    n = len(blocks.texts)
    texts, paths = blocks.texts[first:stop], blocks.paths[first:stop]
    out = np.zeros((len(texts), PATH_BINS + WORD_BINS + FIGURES), np.float32)
    bins: list[int] = []
    figures = []
    for i, (text, path) in enumerate(zip(texts, paths, strict=True)):
        out[i, :PATH_BINS] = path.vector()
        words = text.lower().split(" ")
        bins += [_word_bin(w) + i * WORD_BINS for w in words]
        stops = text.count(".") + text.count(",") + text.count(";") + text.count("!") + text.count("?")
        figures.append((len(text), len(words), text[-1] in ".!?:;\"'”»", stops, path.depth))
    counts = np.bincount(bins, minlength=len(texts) * WORD_BINS).reshape(-1, WORD_BINS)
    out[:, PATH_BINS : PATH_BINS + WORD_BINS] = counts / np.sqrt((counts * counts).sum(1, keepdims=True))
    size, words, ended, stops, depth = np.array(figures, float).T
    at = np.arange(first, first + len(texts)) / n
    out[:, PATH_BINS + WORD_BINS :] = np.stack((np.log1p(size) / 8, np.minimum(words, 60) / 60, np.array(blocks.links[first:stop]), ended, stops / words, at, 1 - at, np.minimum(depth, 12) / 12), 1)
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output for each step. Gates in the order input, forget, output, candidate."""

    def __init__(self, size: int, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"out": make(2 * hidden, 1), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": make(size, 4 * hidden), f"h{way}": make(hidden, 4 * hidden), f"b{way}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{way}"][hidden : 2 * hidden] = 1

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, before: tuple | None = None, kept: list | None = None):
        """States of one direction over x (time, batch, size), for which padding leaves the state as it is, and the state at the end.

        before: the state to begin with. kept: where to put what the gradients need.
        """
        h_size, (steps, batch, _) = self.hidden, x.shape
        pre = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        h, c = before or (np.zeros((batch, h_size), np.float32), np.zeros((batch, h_size), np.float32))
        out = np.zeros((steps, batch, h_size), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = pre[t] + h @ self.p[f"h{way}"]
            s = 1 / (1 + np.exp(-a[:, : 3 * h_size]))
            g = np.tanh(a[:, 3 * h_size :])
            i, f, o = s[:, :h_size], s[:, h_size : 2 * h_size], s[:, 2 * h_size :]
            m = mask[t][:, None]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if kept is not None:
                kept.append((t, h, c, i, f, o, g, tanh_c, m))
            h = m * (o * tanh_c) + (1 - m) * h
            c = m * new_c + (1 - m) * c
            out[t] = h
        return out, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, kept: dict[str, list] | None = None):
        """Probabilities and states; kept: lists for both directions where gradients are to follow."""
        both = np.concatenate([self._run(way, x, mask, None, None if kept is None else kept[way])[0] for way in "fb"], 2)
        return 1 / (1 + np.exp(-(both @ self.p["out"] + self.p["bias"])[..., 0])), both

    def of_long(self, part: Callable[[int, int], np.ndarray], n: int, size: int) -> np.ndarray:
        """Probabilities of n steps whose vectors part(first, stop) gives, of which `size` are held at a time."""
        total = np.full(n, self.p["bias"][0], np.float32)
        for way, out in (("f", self.p["out"][: self.hidden]), ("b", self.p["out"][self.hidden :])):
            state = None
            for a in range(0, n, size) if way == "f" else reversed(range(0, n, size)):
                b = min(n, a + size)
                got, state = self._run(way, part(a, b)[:, None], np.ones((b - a, 1), np.float32), state)
                total[a:b] += (got[:, 0] @ out)[:, 0]
        return 1 / (1 + np.exp(-total))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        p, both = self.forward(x, mask, kept)
        d_out = ((p - y) * mask / mask.sum())[..., None].astype(np.float32)
        flat = both.reshape(-1, both.shape[2])
        grad = {"out": flat.T @ d_out.reshape(-1, 1), "bias": d_out.sum((0, 1))}
        d_both = d_out @ self.p["out"].T
        n = self.hidden
        for way, d_way in (("f", d_both[..., :n]), ("b", d_both[..., n:])):
            d_pre = np.zeros((*x.shape[:2], 4 * n), np.float32)
            d_h = np.zeros(d_way.shape[1:], np.float32)
            d_c = np.zeros_like(d_h)
            d_hh = np.zeros_like(self.p[f"h{way}"])
            for t, h, c, i, f, o, g, tanh_c, m in reversed(kept[way]):
                d_h = d_h + d_way[t]
                d_new_h = d_h * m
                d_new_c = d_c * m + d_new_h * o * (1 - tanh_c * tanh_c)
                d_a = np.concatenate((d_new_c * g * i * (1 - i), d_new_c * c * f * (1 - f), d_new_h * tanh_c * o * (1 - o), d_new_c * i * (1 - g * g)), 1)
                d_pre[t] = d_a
                d_hh += h.T @ d_a
                d_h = d_h * (1 - m) + d_a @ self.p[f"h{way}"].T
                d_c = d_c * (1 - m) + d_new_c * f
            grad |= {f"x{way}": x.reshape(-1, x.shape[2]).T @ d_pre.reshape(-1, 4 * n), f"h{way}": d_hh, f"b{way}": d_pre.sum((0, 1))}
        return grad


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x = np.zeros((longest, len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(rows)), np.float32)
    for j, r in enumerate(rows):
        x[: len(r), j] = r
        mask[: len(r), j] = 1
    return x, mask


def labelled_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for page in html_pages.pages(n, seed):
        blocks = Blocks(page)
        y = np.array([t.startswith(html_pages.MARK) for t in blocks.texts], np.float32)
        blocks.texts = [t.replace(html_pages.MARK, "") or "." for t in blocks.texts]
        if len(y):
            out.append((vectors(blocks), y))
    return out


_trained: dict[tuple, Labeller] = {}


def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    key = (pages, epochs, seed)
    if key not in _trained:
        rng = np.random.default_rng(seed)
        data = sorted(labelled_pages(pages, seed), key=lambda d: len(d[0]))
        model = Labeller(PATH_BINS + WORD_BINS + FIGURES, HIDDEN, rng)
        m = {k: np.zeros_like(v) for k, v in model.p.items()}
        v = {k: np.zeros_like(x) for k, x in model.p.items()}
        groups = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
        step = 0
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                x, mask = _padded([d[0] for d in groups[g]])
                y = np.zeros_like(mask)
                for j, (_, own) in enumerate(groups[g]):
                    y[: len(own), j] = own
                # some names of classes are unknown to the labeller: hide a few bins, so that it looks at the rest as well
                x[..., :PATH_BINS] *= rng.random(PATH_BINS) > 0.05
                step += 1
                rate = 0.01 * (0.5 if epoch > epochs // 2 else 1)
                for k, d in model.gradients(x, mask, y).items():
                    d = np.clip(d, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        _trained[key] = model
    return _trained[key]


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    read = [Blocks(p or "") for p in pages]
    texts = [""] * len(pages)

    def put(i: int, p: np.ndarray) -> None:
        texts[i] = "\n".join(t for t, q in zip(read[i].texts, p, strict=False) if q >= 0.5)

    order = sorted((i for i, b in enumerate(read) if b.texts), key=lambda i: len(read[i].texts))
    at = 0
    while at < len(order) and len(read[order[at]].texts) <= GROUP_BLOCKS:  # pages of like length together
        to = at + 1
        while to < len(order) and to - at < 256 and (to + 1 - at) * len(read[order[to]].texts) <= GROUP_BLOCKS:
            to += 1
        group = order[at:to]
        p, _ = model.forward(*_padded([vectors(read[i]) for i in group]))
        for j, i in enumerate(group):
            put(i, p[:, j])
        at = to
    for i in order[at:]:
        put(i, model.of_long(lambda a, b, blocks=read[i]: vectors(blocks, a, b), len(read[i].texts), GROUP_BLOCKS))
    return texts


def extract(pages: DataFrame, carry: list[str]) -> DataFrame:
    """carry, text, n_chars: the main text of html."""
    model = trained()
    carry = [c for c in carry if c not in ("text", "n_chars")]
    kept = [F.col(f"`{c}`") for c in carry]
    frame = pages.select(*[c.alias(f"_carried_{i}") for i, c in enumerate(kept)], F.col("html").cast("string").alias("_html"))
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = main_texts(part.column(part.num_columns - 1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*carry, "text", "n_chars"])

    return frame.mapInArrow(run, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"), ["page_id", "url"])
