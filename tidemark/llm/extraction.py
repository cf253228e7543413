"""Main-text extraction: boosted trees judge the nodes of a page, a tree decoder makes the choices agree.

Each element gets features of its tag, its attribute words and those of the elements above it, the density of
text, links and punctuation under it, its depth and its siblings. The model gives the
probability that the element belongs to the article or holds it. Decoding finds the likeliest set of
kept elements in which nothing is kept under a dropped one.

The model learns from a bounded sample of the pages given (``SAMPLE_PAGES``, each up to ``SAMPLE_CHARS`` characters): elements
inside ``article`` or ``main`` are kept, those inside menus, footers, asides and adverts are not.
Every sample page is also shown in other dress: its containers get other tags and attribute words,
and side matter that the pages may lack (sidebars, notices, forms, reader comments, headers) is
made from texts of other sample pages. Pages are judged as a whole, whatever their length.

Null and empty pages have an empty text. Without sample pages that tell article from rest the
built-in layouts alone teach. Equal pages get equal texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import boosting, dom
from tidemark.llm.common import by_value, require

#: Bounds of the training sample, and dresses of each sample page.
SAMPLE_PAGES = 120
SAMPLE_CHARS = 100_000
DRESSES = 3
TOKENS = 120
ROUNDS, DEPTH = 120, 5
#: Added to the log-odds of being kept: losing a paragraph is worse than keeping a line too much.
KEEP = 1.0
#: Pages whose elements are judged together.
PAGES_AT_ONCE = 64

# Usual forms of a page's parts, as tag and attribute words.
ARTICLE = (
    "article", "main", "article post", "div content", "div post", "div entry content", "div article body", "section story",
    "div main content", "div text", "div", "section", "main content",
)
SIDE = {
    "menu": ("nav", "nav", "div menu", "div nav", "ul menu", "div navbar", "div navigation", "div breadcrumb", "ul nav", "ol breadcrumbs"),
    "header": ("header", "div header", "div masthead", "header site header", "div topbar", "div site header", "div top"),
    "footer": ("footer", "footer", "div footer", "div site footer", "div copyright", "div bottom", "div foot"),
    "sidebar": ("aside", "aside sidebar", "div sidebar", "div widget", "div related", "aside related", "div recent posts", "div side"),
    "notice": ("div notice", "div cookie notice", "div consent", "div alert", "div banner", "div cookie banner", "div gdpr", "div popup",
               "div newsletter", "section notice", "aside notice", "p notice", "div disclaimer", "div message"),
    "advert": ("div ad", "div ad", "div ads", "div advert", "div advertisement", "div sponsor", "div promo", "ins adsbygoogle", "aside ad",
               "div ad slot", "div sponsored", "section promo"),
    "form": ("form", "form", "form login", "form search", "div form", "div search", "div subscribe", "div signup"),
    "comments": ("section comments", "div comments", "div comment list", "ol commentlist", "div disqus thread", "section responses",
                 "div replies", "ul comments", "div discussion", "div reader comments", "section reader comments"),
}
WRAPPERS = ("div wrapper", "div page", "div container", "div", "div row", "div layout", "div main wrapper", "section")


@dataclass
class Model:
    tokens: dict[str, float]
    tags: dict[str, float]
    trees: boosting.Trees


def _element(form: str, parent: dom.Node, keep: bool) -> dom.Node:
    tag, *tokens = form.split()
    node = dom.Node(tag, tuple(tokens), parent)
    node.keep = keep
    return node


class _Dresser:
    """Builds training pages from the blocks of real ones."""

    def __init__(self, texts: list[str], rng: np.random.Generator):
        self.texts, self.rng = texts or ["Some words of text, and more of them."], rng

    def pick(self, options) -> str:
        return options[self.rng.integers(len(options))]

    def say(self, most: int = 400) -> str:
        text = self.pick(self.texts)
        words = text.split()
        begin = self.rng.integers(max(1, len(words) - 3))
        return " ".join(words[begin : begin + 2 + self.rng.integers(max(3, most // 7))])

    def put(self, tag: str, parent: dom.Node, keep: bool, text: str = "") -> dom.Node:
        node = _element(tag, parent, keep)
        if text:
            node.parts.append(text)
        return node

    def side(self, kind: str, parent: dom.Node) -> None:
        rng = self.rng
        box = _element(self.pick(SIDE[kind]), parent, False)
        if kind == "menu" or (kind in ("sidebar", "footer", "header") and rng.random() < 0.5):
            if kind == "sidebar":
                self.put(self.pick(("h2", "h3", "h4")), box, False, self.say(20))
            items = box if box.tag in ("ul", "ol") else self.put("ul", box, False)
            for _ in range(rng.integers(2, 12)):
                self.put("a", self.put("li", items, False), False, self.say(30))
        elif kind == "comments":
            for _ in range(rng.integers(1, 6)):
                form = "li comment" if box.tag in ("ul", "ol") else self.pick(("div comment", "div", "article comment", "div reply", "p", "blockquote"))
                one = _element(form, box, False)
                if one.tag != "p" and rng.random() < 0.8:
                    self.put(self.pick(("b", "span author", "h4")), one, False, self.say(12))
                    for _ in range(rng.integers(1, 3)):
                        self.put("p", one, False, self.say(500))
                else:
                    one.parts.append(self.say(500))
        elif kind == "form":
            for _ in range(rng.integers(1, 4)):
                self.put("label", box, False, self.say(15))
                self.put(self.pick(("input", "textarea", "select")), box, False)
            self.put("button", box, False, self.say(10))
            if rng.random() < 0.5:
                self.put("p", box, False, self.say(150))
        else:
            if rng.random() < 0.3:
                box.parts.append(self.say(200))
            else:
                for _ in range(rng.integers(1, 4)):
                    self.put(self.pick(("p", "p", "span", "div", "a")), box, False, self.say(250))
            if kind in ("notice", "advert") and rng.random() < 0.5:
                self.put(self.pick(("button", "a")), box, False, self.say(10))

    def page(self, article: list[tuple[str, str]]) -> dom.Node:
        """A page around an article given as ``(tag, text)`` blocks."""
        rng = self.rng
        root = dom.Node("html")
        root.keep = True
        body = self.put("body", root, True)
        frame = _element(self.pick(WRAPPERS), body, True) if rng.random() < 0.5 else body
        for kind in ("notice", "header", "menu", "advert", "form", "sidebar"):
            if rng.random() < (0.7 if kind == "menu" else 0.3):
                self.side(kind, frame if rng.random() < 0.7 else body)
        middle = _element(self.pick(WRAPPERS), frame, True) if rng.random() < 0.4 else frame
        main = _element(self.pick(ARTICLE), middle, True)
        if rng.random() < 0.3:
            main = _element(self.pick(ARTICLE), main, True)
        inside = 0.5 if len(article) > 2 else 0.0
        breaks = {int(rng.integers(1, len(article))): self.pick(list(SIDE)) for _ in range(2) if len(article) > 2 and rng.random() < inside}
        for i, (tag, text) in enumerate(article):
            if i in breaks:
                self.side(breaks[i], main)
            if tag == "h1" and rng.random() < 0.2:
                self.put("h1", self.put("header", main, True), True, text)
            elif rng.random() < 0.1:
                for piece in (text[: len(text) // 2], text[len(text) // 2 :]):
                    self.put("li", self.put("ul", main, True), True, piece)
            elif rng.random() < 0.1:
                self.put("p", self.put("blockquote", main, True), True, text)
            else:
                node = self.put(self.pick(("p", "p", "p", "div", "section p")) if tag == "p" and rng.random() < 0.2 else tag, main, True, text)
                if rng.random() < 0.3:
                    self.put(self.pick(("b", "a", "em", "span")), node, True, self.say(30))
        for kind in ("comments", "sidebar", "advert", "form", "notice", "footer", "menu"):
            if rng.random() < (0.8 if kind == "footer" else 0.35):
                self.side(kind, main if kind in ("comments", "form", "advert") and rng.random() < 0.4 else self.pick((middle, frame, body)))
        return root


# Tags and attribute words that label the sample's own elements.
INSIDE = {"article", "main"}
OUTSIDE_TAGS = {"nav", "footer", "aside", "form"}
OUTSIDE_TOKENS = set("ad ads advert advertisement sponsor promo menu nav navbar sidebar comments comment cookie notice banner footer".split())


def _label(root: dom.Node) -> bool:
    """Sets ``keep`` by the page's own marks; false if the page marks no article."""
    nodes = root.nodes()
    found = False
    for node in nodes:
        above = node.parent.keep if node.parent is not None else None
        if node.tag in dom.UNSEEN:
            node.keep = None
        elif above is False or node.tag in OUTSIDE_TAGS or OUTSIDE_TOKENS & set(node.tokens):
            node.keep = False
        elif above is True or node.tag in INSIDE:
            node.keep, found = True, True
        else:
            node.keep = None
    for node in reversed(nodes):
        if node.keep and node.parent is not None and node.parent.keep is None:
            node.parent.keep = True
    return found


def seen(root: dom.Node) -> list[dom.Node]:
    """Elements that can be shown, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, dom.Node) and p.tag not in dom.UNSEEN]
    return out


def _leans(said: Iterable[tuple[str, bool]]) -> dict[str, float]:
    """Log-odds of being kept, for the ``TOKENS`` most frequent words."""
    seen_in = Counter(said)
    words = Counter({w: seen_in[w, True] + seen_in[w, False] for w, _ in seen_in}).most_common(TOKENS)
    return {w: float(np.log((seen_in[w, True] + 0.5) / (seen_in[w, False] + 0.5))) for w, _ in words}


def fit(pages: list[str], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    roots = [dom.parse(p) for p in pages]
    marked = [r for r in roots if _label(r)]
    articles, texts = [], []
    for root in marked:
        parts = []
        for node in seen(root):
            said = " ".join(" ".join(p for p in n.parts if isinstance(p, str)) for n in node.nodes()) if node.tag in ("p", "h1", "h2", "h3", "li") else ""
            if node.keep and said.strip():
                parts.append((node.tag if node.tag != "li" else "p", " ".join(said.split())))
        if parts:
            articles.append(parts)
            texts += [t for _, t in parts]
    # Without pages to learn from, layouts are filled with plain words.
    plain = [("h1", "A heading of some words")] + [("p", "Words of a text, and then some more. " * k) for k in (1, 4, 9)]
    articles = articles or [plain] * 20
    dresser = _Dresser(texts, rng)
    taught = marked + [dresser.page(a) for a in articles for _ in range(DRESSES)]
    known = [n for r in taught for n in seen(r) if n.keep is not None]
    tokens = _leans((t, n.keep) for n in known for t in n.tokens)
    tags = _leans((n.tag, n.keep) for n in known)
    features = dom.Features(tokens, tags)
    x, y = [], []
    for root in taught:
        nodes = seen(root)
        rows = features.of(nodes)
        known = [i for i, n in enumerate(nodes) if n.keep is not None]
        x.append(rows[known])
        y += [nodes[i].keep for i in known]
    return Model(tokens, tags, boosting.fit(np.concatenate(x), np.array(y, float), rounds=ROUNDS, depth=DEPTH))


def decode(nodes: list[dom.Node], keep: np.ndarray) -> set[int]:
    """The likeliest kept elements such that all above a kept one are kept; ids of the nodes."""
    p = np.clip(keep, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log(1 - p)
    place = {id(n): i for i, n in enumerate(nodes)}
    up = [place.get(id(n.parent), -1) for n in nodes]
    for i, n in enumerate(nodes):
        if n.tag in ("html", "body"):
            yes[i], no[i] = 0.0, -np.inf
    dropped, kept = no.copy(), yes.copy()
    for i in range(len(nodes) - 1, 0, -1):
        kept[up[i]] += max(kept[i], dropped[i])
        dropped[up[i]] += dropped[i] if np.isfinite(dropped[i]) else 0.0
    chosen: set[int] = set()
    for i, n in enumerate(nodes):
        if (up[i] < 0 or id(nodes[up[i]]) in chosen) and kept[i] >= dropped[i]:
            chosen.add(id(n))
    return chosen


def extract_pages(model: Model, features: dom.Features, pages: list[str | None]) -> list[str]:
    roots = [dom.parse(p or "") for p in pages]
    lists = [seen(r) for r in roots]
    if not lists:
        return []
    margins = model.trees.margin(np.concatenate([features.of(nodes) for nodes in lists]))
    scores = 1 / (1 + np.exp(-margins - KEEP))
    out, at = [], 0
    for root, nodes in zip(roots, lists):
        chosen = decode(nodes, scores[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(dom.blocks(root, lambda n: id(n) in chosen)))
    return out


def _extract(model: Model, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = dom.Features(model.tokens, model.tags)
        for batch in batches:
            for first in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(first, PAGES_AT_ONCE)
                texts = extract_pages(model, features, part.column(place).to_pylist())
                columns = [c for i, c in enumerate(part.columns) if i != place]
                names = [n for i, n in enumerate(part.schema.names) if i != place]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*names, "text"])

    return run


def train(pages: DataFrame, html: str = "html") -> Model:
    """Fit on the first pages in hash order that fit the bounds."""
    require(pages, html)
    usable = pages.where(F.col(html).isNotNull() & (F.length(html) <= SAMPLE_CHARS)).select(html)
    order = F.xxhash64(F.lit("fit"), html)
    # The first in hash order lie below a share of the hashes; no page beyond it is sent.
    share = min(1.0, 4.0 * SAMPLE_PAGES / max(1, usable.count()))
    sample = usable.where(F.shiftright(order, 1) < F.lit(int((share - 0.5) * 2**63))).orderBy(order, html).limit(SAMPLE_PAGES)
    return fit([r[0] for r in sample.collect()])


def extract(pages: DataFrame, model: Model, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys, text`` for every page."""
    require(pages, html, *keys)
    given = pages.select(*keys, html)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != html) + ", text string"
    return given.mapInArrow(_extract(model, len(keys)), schema)


by_value(__name__)
