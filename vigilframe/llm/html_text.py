"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of the document tree."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.html_pages import labelled_pages

WEIGHTS = 1 << 13
TRAIN_PAGES = 500
EPOCHS = 6
RATE = 0.3
SHRINK = 1e-4

# Elements of HTML that do not end a block, that have no content, whose content is not text, whose
# content is not markup, and that a head holds.
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "template", "noscript", "iframe", "object", "svg", "math", "head", "title", "select", "option", "textarea"))
RAW_TEXT = frozenset(("script", "style", "title", "textarea", "iframe"))
IN_HEAD = frozenset(("base", "head", "html", "link", "meta", "noscript", "script", "style", "template", "title"))
# What an opening element ends, and the elements in which it ends nothing further out.
ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",))}
ENDS_PARAGRAPH = ("p", ("article", "section", "div", "td", "li", "body"))
# Attributes have a bounded number of parts, so that stray quotes cost no more than that for each tag.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]{0,10000}+\"|'[^']{0,10000}+'|[^'\">]++){0,200}+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_OPEN_COMMENT = re.compile(r"<!--.*", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=1 << 16)
def _slot(s: str) -> int:
    h = 2166136261
    for c in s.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % WEIGHTS


@dataclass(frozen=True)
class Path:
    """The ancestors of a block: slots of all their tags and name words, the two nearest marks, and how many they are."""

    slots: frozenset[int] = frozenset()
    near: tuple[str, ...] = ()
    depth: int = 0

    def child(self, mark: str) -> Path:
        """The path one element further in; slots that are known already are shared, so depth alone costs nothing."""
        tag, *words = mark.split(" ")
        own = {_slot("t:" + tag), *(_slot("n:" + w) for w in words)}
        slots = self.slots if own <= self.slots else self.slots | own
        return Path(slots, (*self.near[-1:], mark), min(self.depth + 1, 8))


@dataclass
class Block:
    """A run of text between block borders: its ancestors' marks and how much of it is link text."""

    path: Path
    text: str
    link_chars: int


@dataclass
class _Open:
    name: str
    path: Path
    links: int = 0


@dataclass
class _Tree:
    """Open block elements and the text gathered since the last block border. Every step takes constant time on average."""

    open: list[_Open] = field(default_factory=lambda: [_Open("", Path())])
    places: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    raw: int = 0
    links: int = 0

    def text(self, raw: str) -> None:
        if self.raw and self.open[-1].name == "head" and raw.strip():
            self._pop_to(len(self.open) - 1)
        if self.raw:
            return
        said = html.unescape(raw) if "&" in raw else raw
        self.parts.append(said)
        if self.links:
            self.link_chars += len(said.strip())

    def border(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.blocks.append(Block(self.open[-1].path, " ".join(words), self.link_chars))
            self.parts, self.link_chars = [], 0

    def _pop_to(self, size: int) -> None:
        while len(self.open) > size:
            gone = self.open.pop()
            self.places[gone.name].pop()
            self.raw -= gone.name in RAW
            self.links -= gone.links

    def _nearest(self, name: str) -> int:
        at = self.places.get(name)
        return at[-1] if at else 0

    def start(self, name: str, attributes: str) -> None:
        if self.raw and name not in IN_HEAD and self._nearest("head"):
            self._pop_to(self._nearest("head"))
        if name == "a":
            self.open[-1].links += 1
            self.links += 1
        if name in INLINE:
            return
        self.border()
        ended, within = ENDS.get(name, ENDS_PARAGRAPH)
        at = self._nearest(ended)
        if at and all(at > self._nearest(x) for x in within if x != ended):
            self._pop_to(at)
        if name not in VOID:
            mark = name
            if attributes.strip():
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
                mark = " ".join([name, *sorted({w.lower() for w in _WORD.findall(names)})])
            self.places[name].append(len(self.open))
            self.open.append(_Open(name, self.open[-1].path.child(mark)))
            self.raw += name in RAW

    def end(self, name: str) -> None:
        if name == "a" and self.open[-1].links:
            self.open[-1].links -= 1
            self.links -= 1
        if name in INLINE:
            return
        self.border()
        if self._nearest(name):
            self._pop_to(self._nearest(name))


def leaf_blocks(page: str) -> list[Block]:
    """Blocks in page order; scripts, styles, heads and other elements that are no text have none."""
    tree, at, n = _Tree(), 0, len(page)
    last = page.rfind(">")
    while at < n:
        m = _TAG.search(page, at) if at <= last else _OPEN_COMMENT.search(page, at)
        if m is None:
            tree.text(page[at:])
            break
        if m.start() > at:
            tree.text(page[at : m.start()])
        at = m.end()
        if m.re is _OPEN_COMMENT:
            break
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name = name.lower()
        if m.group(1) or m.group(4):
            tree.end(name)
            continue
        attributes = m.group(3) or m.group(6) or ""
        if name in RAW_TEXT:
            tree.border()
            close = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at) if at <= last else None
            at = close.end() if close else n
            continue
        tree.start(name, attributes)
        if attributes.rstrip().endswith("/") and name not in VOID and name in ("svg", "path", "iframe"):
            tree.end(name)
    tree.border()
    return tree.blocks


def path_features(path: Path) -> list[int]:
    """Slots of the tags and name words of all ancestors, and of those nearest to the text."""
    found = set(path.slots)
    for mark in path.near:
        tag, *words = mark.split(" ")
        found.add(_slot(f"p:{tag}"))
        found.update(_slot("q:" + w) for w in words)
    found.add(_slot(f"depth:{path.depth}"))
    return sorted(found)


def text_key(block: Block) -> tuple[int, ...]:
    """Length, link share, punctuation, digits and marks of the text, in a few classes each."""
    text = block.text
    words = text.count(" ") + 1
    size = words.bit_length() - 1
    linked = min(4, 4 * block.link_chars // len(text))
    marks = text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count(";") + text.count(":")
    return min(10, size), linked, min(4, 10 * marks // words), int(text[-1] in ".!?"), int("©" in text)


def text_features(key: tuple[int, ...]) -> list[int]:
    """Slots of a text's classes."""
    size, linked, marks, ended, sign = key
    return [_slot(f) for f in (f"len:{size}", f"links:{linked}", f"len-links:{size // 2}-{linked > 1}", f"marks:{marks}", f"end:{ended}", f"sign:{sign}")]


class ChainField:
    """Two labels, 0 for the frame and 1 for the main text; weights of label 1 against 0, and of neighbouring labels."""

    def __init__(self) -> None:
        self.weights = np.zeros(WEIGHTS)
        self.moves = np.zeros((2, 2))
        self.paths: dict[Path, float] = {}
        self.texts: dict[tuple[int, ...], float] = {}

    def score(self, block: Block) -> float:
        p = self.paths.get(block.path)
        if p is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            p = self.paths[block.path] = float(self.weights[path_features(block.path)].sum())
        key = text_key(block)
        t = self.texts.get(key)
        if t is None:
            t = self.texts[key] = float(self.weights[text_features(key)].sum())
        return p + t

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the most likely labels of a chain."""
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, a, b = [], 0.0, scores[0]
        for s in scores[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from0, from1))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + s
        label = int(b > a)
        labels = [label]
        for pair in reversed(back):
            label = int(pair[label])
            labels.append(label)
        return labels[::-1]

    def learn(self, features: list[list[int]], truth: list[int], rate: float) -> None:
        """One step up the conditional likelihood of a page: forward and backward sums give expected counts."""
        n = len(features)
        scores = np.array([self.weights[f].sum() for f in features])
        node = np.stack([np.zeros(n), scores], axis=1)
        forward, backward = np.empty((n, 2)), np.zeros((n, 2))
        forward[0] = node[0]
        for t in range(1, n):
            forward[t] = np.logaddexp(forward[t - 1, 0] + self.moves[0], forward[t - 1, 1] + self.moves[1]) + node[t]
        for t in range(n - 2, -1, -1):
            after = backward[t + 1] + node[t + 1]
            backward[t] = np.logaddexp(self.moves[:, 0] + after[0], self.moves[:, 1] + after[1])
        whole = np.logaddexp(*forward[-1])
        p1 = np.exp(forward[:, 1] + backward[:, 1] - whole)
        for f, y, p in zip(features, truth, p1):
            self.weights[f] += rate * (y - p)
        step = np.zeros((2, 2))
        for t in range(1, n):
            step[truth[t - 1], truth[t]] += 1
            step -= np.exp(forward[t - 1][:, None] + self.moves + (node[t] + backward[t])[None, :] - whole)
        self.moves += rate * step / n
        self.weights *= 1 - rate * SHRINK


def train(pages: list[tuple[str, list[str]]], seed: int = 3) -> ChainField:
    """Fit on (html, main text blocks) pages."""
    model, rng = ChainField(), np.random.default_rng(seed)
    chains = []
    for page, gold in pages:
        blocks, wanted = leaf_blocks(page), set(gold)
        if blocks:
            chains.append(([path_features(b.path) + text_features(text_key(b)) for b in blocks], [int(b.text in wanted) for b in blocks]))
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(chains)):
            model.learn(*chains[i], RATE / (1 + epoch))
    return model


def main_text(model: ChainField, page: str | None) -> str:
    blocks = leaf_blocks(page or "")
    labels = model.decode([model.score(b) for b in blocks])
    return " ".join(b.text for b, y in zip(blocks, labels) if y)


def extract_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", train_pages: int = TRAIN_PAGES
) -> DataFrame:
    """Main text of every page, by a field trained on ``train_pages`` labelled pages of many layouts and decoded by Viterbi.

    Returns page_id, url, text, n_chars, a row per row of ``pages``. Null and empty pages, and pages of which no block
    is main text, have an empty text. Markup that never ends is text. Blocks are kept or left out whole, whatever their
    length. Repeated rows get equal texts. Other columns are not read.
    """
    model = train(labelled_pages(train_pages))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(model, p.as_py()) for p in batch.column("t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("t"))
    return read.mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
