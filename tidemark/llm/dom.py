"""A small document tree for messy HTML, its text blocks and the features of its nodes."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

from tidemark.llm.common import by_value

# HTML's element groups.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head script style template title iframe svg datalist".split())
IN_HEAD = set("title meta link base basefont bgsound script style noscript noframes template".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td textarea tfoot th thead tr ul button".split()
)
ENDS_PARAGRAPH = BLOCK - set("body html td th tr tbody thead tfoot caption option legend button select textarea summary".split())
#: A start tag ends these open elements, up to one of the fences.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

#: Tags that are features of their own; others share one.
TAGS = (
    "html body div span p a b strong em i ul ol li h1 h2 h3 h4 table tr td section article main aside nav header footer "
    "form label button input textarea select blockquote pre figure figcaption dl dd dt ins img"
).split()
NUMBERS = 17

#: Signs that end or part sentences.
MARKS = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "tokens", "parent", "parts", "keep")

    def __init__(self, tag: str, tokens: tuple[str, ...] = (), parent: Node | None = None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.parts: list[Node | str] = []
        self.keep: bool | None = None
        if parent is not None:
            parent.parts.append(self)

    def nodes(self) -> list[Node]:
        """This node and all under it, parents first, in page order."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            out.append(node)
            todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
        return out


def tokens_of(attrs: list[tuple[str, str | None]]) -> tuple[str, ...]:
    """Words of class, id and role."""
    said = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
    said = re.sub(r"([a-z])([A-Z])", r"\1 \2", said).lower()
    return tuple(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", said) if t and not t.isdigit()))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.in_head = False

    def close_to(self, tags: set[str], fences: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in fences:
                return

    def leave_head(self) -> None:
        """What cannot stand in a head ends it, as pages may leave out its end tag and the body's start tag."""
        if self.in_head and not any(n.tag == "template" for n in self.open):
            self.close_to({"head"}, {"html"})
            self.in_head = False

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag not in IN_HEAD:
            self.leave_head()
        if tag in ENDS_PARAGRAPH:
            self.close_to({"p"}, {"button", "table", "td", "th"})
        if tag in ENDS:
            self.close_to(*ENDS[tag])
        if tag == "body" and any(n.tag == "body" for n in self.open):
            return
        node = Node(tag, tokens_of(attrs), self.open[-1])
        if tag not in VOID:
            self.open.append(node)
            self.in_head = self.in_head or tag == "head"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag not in BLOCK and self.open[i].tag in BLOCK:
                return  # an inline end tag closes no block

    def handle_data(self, data):
        if self.in_head and self.open[-1].tag == "head" and data.strip():
            self.leave_head()
        parts = self.open[-1].parts
        if parts and isinstance(parts[-1], str):
            parts[-1] += data
        else:
            parts.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    # A tag that the page breaks off in is no text.
    builder.feed(re.sub(r"<(?:[A-Za-z/][^<>]*|!(?:--)?[^<>]*)$", "", html))
    builder.close()
    return builder.root


def blocks(root: Node, kept) -> list[str]:
    """Texts between block borders, of kept nodes alone."""
    out: list[list[str]] = [[]]
    todo: list = [root]
    while todo:
        at = todo.pop()
        if at is None:
            out.append([])
        elif isinstance(at, str):
            out[-1].append(at)
        elif at.tag == "br":
            out[-1].append(" ")
        elif at.tag in BLOCK:
            # A dropped block still parts the texts around it.
            out.append([])
            if kept(at):
                todo.append(None)
                todo += reversed(at.parts)
        elif kept(at):
            todo += reversed(at.parts)
    texts = (" ".join("".join(parts).split()) for parts in out)
    return [t for t in texts if t]


class Features:
    """Turns pages into rows of numbers.

    ``tokens`` and ``tags`` give each attribute word and tag its learned lean to the article. A node
    is told the least and greatest lean of its own words, and of words and tags above it.
    """

    def __init__(self, tokens: dict[str, float], tags: dict[str, float]):
        self.tokens, self.leans = tokens, tags
        self.tags = {t: i for i, t in enumerate(TAGS)}
        self.width = NUMBERS + len(TAGS) + 1 + 6

    def of(self, nodes: list[Node]) -> np.ndarray:
        """A row for each node; ``nodes`` are parents first."""
        place = {id(x): i for i, x in enumerate(nodes)}
        n = len(nodes)
        up = [place.get(id(x.parent), -1) for x in nodes]
        own, letters, marks, depth, rank = ([0] * n for _ in range(5))
        kids: list[list[int]] = [[] for _ in range(n)]
        for i, x in enumerate(nodes):
            text = " ".join([p for p in x.parts if isinstance(p, str)]).strip()
            if text:
                own[i] = len(text)
                letters[i] = sum(map(str.isalpha, text))
                marks[i] = len(MARKS.findall(text))
            if up[i] >= 0:
                depth[i] = depth[up[i]] + 1
                rank[i] = len(kids[up[i]])
                kids[up[i]].append(i)
        whole, signs, linked, inner = own[:], marks[:], [0] * n, [1] * n
        for i in range(n - 1, -1, -1):
            if nodes[i].tag == "a":
                linked[i] = whole[i]
            j = up[i]
            if j >= 0:
                whole[j] += whole[i]
                signs[j] += signs[i]
                linked[j] += linked[i]
                inner[j] += inner[i]
        # Of children: how many have each tag, and their texts' length, once for each parent.
        nothing: Counter[str] = Counter()
        kinds = [Counter([nodes[j].tag for j in group]) if group else nothing for group in kids]
        under = [sum([whole[j] for j in group]) for group in kids]
        size = [len(kids[j]) if j >= 0 else 1 for j in up]
        same = [kinds[j][x.tag] if j >= 0 else 1 for j, x in zip(up, nodes)]
        beside = [under[j] if j >= 0 else whole[i] for i, j in enumerate(up)]
        above = [whole[j] if j >= 0 else whole[0] for j in up]
        told = np.array(
            [depth, own, letters, whole, signs, linked, inner, rank, size, same, beside, above, list(map(len, kids)), [k["p"] for k in kinds]], np.float64
        )
        depth, own, letters, whole, signs, linked, inner, rank, size, same, beside, above, many, paragraphs = told
        total, some = max(1.0, whole[0]), np.maximum(1.0, whole)
        out = np.zeros((n, self.width), np.float32)
        out[:, :NUMBERS] = np.column_stack(
            (
                depth,
                np.log1p(whole),
                np.log1p(own),
                whole / total,
                whole / np.maximum(1.0, above),
                whole / inner,
                linked / some,
                signs / some,
                inner,
                many,
                size,
                rank,
                same / size,
                np.log1p(beside / size),
                (np.cumsum(own) - own) / total,
                letters / np.maximum(1.0, own),
                paragraphs,
            )
        )
        out[np.arange(n), [NUMBERS + self.tags.get(x.tag, len(TAGS)) for x in nodes]] = 1
        # Least and greatest lean of own words, and of words and tags above.
        leans = []
        for i, x in enumerate(nodes):
            mine = [self.tokens[t] for t in x.tokens if t in self.tokens]
            low, high = min(mine, default=0.0), max(mine, default=0.0)
            if up[i] >= 0:
                _, _, a, b, c, d, ua, ub, tag = leans[up[i]]
                leans.append((low, high, min(a, ua), max(b, ub), min(c, tag, 0.0), max(d, tag, 0.0), low, high, self.leans.get(x.tag, 0.0)))
            else:
                leans.append((low, high, 0.0, 0.0, 0.0, 0.0, low, high, self.leans.get(x.tag, 0.0)))
        out[:, -6:] = np.array(leans, np.float64)[:, :6]
        return out


by_value(__name__)
