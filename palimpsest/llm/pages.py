"""Main text of web pages by a tree-structured graphical model of the DOM.

Block elements are the nodes; a box around one single element counts as that
element, so that wrappers of any depth say the same. Each node is content or not; its potential comes
from features of the element (tag, words of class, id and role, amount of own
text, share of text in links, what the boxes above it say, share of the page's text below it), and each parent-child edge has a potential for
the four combinations of their states. Sum-product messages go from the leaves
to the root and back; a node's own text is taken if its marginal is above 0.5.

Weights are those of greatest conditional likelihood on labelled pages (HTML
and the text that belongs to it), found by gradient ascent with the same
messages giving the expectations. ``labelled_pages`` makes the pages that the
registered query trains on: layouts with menus, headers, sidebars, notices,
adverts, forms, comments and several kinds of article markup, and bare pages
of an article alone, under wrappers of several depths.

Text: character references are decoded, white space within a block becomes one
space, blocks stand in page order with an empty line between. Scripts, styles,
templates, frames, comments and what is typed or chosen in forms are never
text; formulas, and what stands in for an object that is not shown, are. ``br``
is white space; elements that HTML closes by itself (p, li, td, ...) are closed
as HTML says. A tag whose quotes do not close before the next tag ends at its
first ``>``. Reading takes time in proportion to the page. Null, empty and
unparsable pages give an empty text. Every row of the input gives one row, also
repeated ones and those without an id; an empty table gives none, and extra
columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.labelled import labelled_pages
from palimpsest.llm.runtime import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea select svg".split())
BLOCK = frozenset(
    "html head body article aside main section nav header footer div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table caption thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset legend address details summary hgroup center dialog title button label".split()
)
#: Boxes that say nothing.
PLAIN = frozenset("#root html body div center section".split())
#: Elements that say something about all that is in them.
TELLING = frozenset("nav header footer aside form article main fieldset dialog address".split())
#: Opening one of these ends an open p.
ENDS_P = BLOCK - frozenset("html head body title button label caption thead tbody tfoot tr td th".split())
#: Opening the key ends the nearest open element of the value, not beyond the bounds.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}, "option": {"option"}, "body": {"head", "title"}}
BOUNDS = frozenset("table ul ol dl article section div body html".split())
P_BOUNDS = frozenset({"table", "td", "th", "button"})
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/><]*)((?:"[^"<]*"|'[^'<]*'|[^>"'<])*)>|<([a-zA-Z][^\s/><]*)([^<>]*)>?|</([a-zA-Z][^\s><]*)[^><]*>?|<[!?][^>]*>|([^<]+|<)""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
WORD = re.compile(r"[a-z]+")

#: Words of class, id and role, by what they say of an element.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc",
    "page": "header masthead topbar footer foot bottom colophon copyright legal branding logo",
    "side": "sidebar side aside rail widget widgets related recommended recommendations complementary more trending popular tags meta",
    "notice": "notice cookie cookies consent gdpr banner alert popup modal overlay warning message toast",
    "advert": "ad ads advert advertisement advertorial sponsor sponsored promo promotion promoted commercial dfp",
    "form": "form search newsletter subscribe subscription signup login register feedback",
    "social": "share sharing social follow like buttons",
    "comment": "comment comments reply replies respond responses discussion disqus thread",
    "main": "article content main post entry story body text prose copy lead",
    "author": "byline author dateline timestamp credit",
}
HINT_OF = {w: kind for kind, words in HINTS.items() for w in words.split()}


@dataclass
class Node:
    tag: str
    parent: int
    hints: tuple[str, ...] = ()
    hidden: bool = False
    #: (order in the page, own text, own text in links) of each run of inline content
    runs: list[list] = field(default_factory=list)
    inside: int = 0


class _Stack:
    """Open elements, and for each name how deep its open ones stand, so that the nearest of some names is found without a walk."""

    def __init__(self):
        self.items: list[tuple[str, int]] = [("#root", 0)]
        self.open: Counter[str] = Counter()
        self.depths: dict[str, list[int]] = {}

    def push(self, tag: str, node: int) -> None:
        self.depths.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, node))
        self.open[tag] += 1

    def close(self, name: str) -> None:
        while True:
            tag, _ = self.items.pop()
            self.open[tag] -= 1
            held = self.depths[tag]
            held.pop()
            if not held:
                del self.depths[tag]
            if tag == name:
                return

    def _deepest(self, names: set[str] | frozenset[str]) -> tuple[int, str | None]:
        few = names if len(names) < len(self.depths) else self.depths
        return max(((self.depths[n][-1], n) for n in few if n in names and n in self.depths), default=(-1, None))

    def nearest(self, names: set[str] | frozenset[str], bounds: frozenset[str]) -> str | None:
        depth, found = self._deepest(names)
        return found if found is not None and depth >= self._deepest(bounds)[0] else None


def _said(attributes: str) -> tuple[tuple[str, ...], bool]:
    """What class, id and role of an element hint at, and whether it is hidden."""
    said, hidden = [], False
    for name, a, b, c, flag in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            said += [HINT_OF[w] for w in WORD.findall(value) if w in HINT_OF]
        elif flag or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return tuple(sorted(set(said))), hidden


def parse(page: str) -> list[Node]:
    """Block elements of a page in document order, the root first."""
    nodes = [Node("#root", -1)]
    stack, order, at, size, fresh = _Stack(), 0, 0, len(page), True
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag, top = m[1] or m[3], stack.items[-1][1]
        runs = nodes[top].runs
        if m[6] is not None:
            if fresh or not runs:
                order += 1
                runs.append([order, [], 0])
                fresh = False
            runs[-1][1].append(m[6])
            if stack.open["a"]:
                runs[-1][2] += len(m[6])
        elif tag is not None:
            tag, attributes = tag.lower(), m[2] if m[1] else m[4]
            if tag in RAW:
                if not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else size
                continue
            if tag in VOID:
                if tag in ("br", "hr") and runs and not fresh:
                    runs[-1][1].append(" ")
                fresh |= tag == "hr"
                continue
            if tag in ENDS_P and stack.nearest({"p"}, P_BOUNDS):
                stack.close("p")
                fresh = True
            if tag in SIBLINGS:
                while (found := stack.nearest(SIBLINGS[tag], BOUNDS - SIBLINGS[tag])) is not None:
                    stack.close(found)
                    fresh = True
            if tag in BLOCK:
                nodes.append(Node(tag, stack.items[-1][1], *_said(attributes)))
                stack.push(tag, len(nodes) - 1)
                fresh = True
            else:
                stack.push(tag, stack.items[-1][1])
        elif m[5] is not None:
            tag = m[5].lower()
            if tag == "br" and runs:
                runs[-1][1].append(" ")
            elif stack.open[tag] and (tag in BLOCK or stack.nearest({tag}, BLOCK)):
                stack.close(tag)
                fresh |= tag in BLOCK
    for node in nodes:
        node.runs = [r for r in ([o, " ".join(entities.unescape("".join(t)).split()), k] for o, t, k in node.runs) if r[1]]
    for i in range(len(nodes) - 1, 0, -1):
        nodes[i].inside += sum(len(r[1]) for r in nodes[i].runs)
        nodes[nodes[i].parent].inside += nodes[i].inside
    return _without_wrappers(nodes)


def _without_wrappers(nodes: list[Node]) -> list[Node]:
    """A box that says nothing, around one single element, is that element; so depth says nothing."""
    children = Counter(n.parent for n in nodes)
    kept, number, passed = [], [0] * len(nodes), {}
    for i, node in enumerate(nodes):
        if i:
            up = passed.pop(node.parent, None) if children[node.parent] == 1 else None
            if up is not None:
                node.hints = tuple(sorted({*node.hints, *up.hints}))
                node.hidden |= up.hidden
                node.parent = up.parent
            else:
                node.parent = number[node.parent]
            if node.tag in PLAIN and not node.runs and children[i] == 1 and not {*node.hints} - {"main"}:
                passed[i] = node
                continue
        number[i] = len(kept)
        kept.append(node)
    return kept


# ---------------------------------------------------------------- model


def features(nodes: list[Node]) -> list[list[str]]:
    name = lambda tag: "box" if tag in PLAIN else tag
    out: list[list[str]] = []
    #: whether an article or main element is in each node, or is it
    holds = [n.tag in ("article", "main") and "comment" not in n.hints for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i]
    #: what the boxes above each node say
    above: list[frozenset[str]] = []
    for node in nodes:
        if node.parent < 0:
            above.append(frozenset())
        else:
            up = nodes[node.parent]
            said = {*up.hints, *([up.tag] if up.tag in TELLING else [])}
            above.append(above[node.parent] | said if said - above[node.parent] else above[node.parent])
        own = sum(len(r[1]) for r in node.runs)
        linked = sum(r[2] for r in node.runs)
        words = sum(r[1].count(" ") + 1 for r in node.runs)
        up = nodes[node.parent].tag if node.parent >= 0 else "#none"
        row = ["bias", f"tag {name(node.tag)}", f"under {name(up)} {name(node.tag)}", f"own {min(4, int(math.log2(words + 1) / 1.5)) if words else 'none'}"]
        row += [f"hint {h}" for h in node.hints] + [f"above {a}" for a in sorted(above[-1])]
        if own and linked > own / 2:
            row += ["linked", "linked long" if words > 4 else "linked short"]
        if node.hidden:
            row.append("hidden")
        if holds[0] and not holds[len(above) - 1] and not above[-1] & {"article", "main"}:
            row.append("beside the article")
        if any(r[1][-1] in ".!?:;\"'”»" for r in node.runs):
            row.append("stop")
        if not own and node.inside:
            row.append(f"share {int(3 * node.inside / nodes[0].inside)}")
        out.append(row)
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    #: log potentials of (parent state, child state)
    edge: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])


def _lse(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(parents: list[int], scores: list[float], edge: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """P(content) of each node, and the expected count of each state pair over the edges.

    ``parents`` come before their children. Messages are log differences, so a
    page of any depth is exact to rounding.
    """
    n = len(parents)
    (e00, e01), (e10, e11) = edge
    below = list(scores)  # log odds of each node from its subtree
    sent = [0.0] * n
    for i in range(n - 1, 0, -1):
        x = below[i]
        sent[i] = _lse(e10, e11 + x) - _lse(e00, e01 + x)
        below[parents[i]] += sent[i]
    odds = list(below)
    pairs = [[0.0, 0.0], [0.0, 0.0]]
    for i in range(1, n):
        p = odds[parents[i]] - sent[i]
        down = _lse(e01, e11 + p) - _lse(e00, e10 + p)
        odds[i] = below[i] + down
        x = below[i]
        four = (e00, e01 + x, e10 + p, e11 + p + x)
        top = max(four)
        mass = [math.exp(v - top) for v in four]
        total = sum(mass)
        for k in range(4):
            pairs[k >> 1][k & 1] += mass[k] / total
    return [1 / (1 + math.exp(-max(-50.0, min(50.0, o)))) for o in odds], pairs


def label(nodes: list[Node], text: str) -> list[int]:
    """States of the nodes of a labelled page: own text in the page's text, or an element most of whose text is."""
    wanted = set(text.split("\n\n"))
    good = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        good[i] += sum(len(r[1]) for r in nodes[i].runs if r[1] in wanted)
        if i:
            good[nodes[i].parent] += good[i]
    out = []
    for i, node in enumerate(nodes):
        own = [r for r in node.runs]
        out.append(int(any(r[1] in wanted for r in own)) if own else int(node.inside > 0 and good[i] > node.inside / 2))
    return out


def train(pages: list[tuple[str, str]], rounds: int = 80, rate: float = 0.25, ridge: float = 1e-3) -> Model:
    """Weights of greatest conditional likelihood (Adam, whole batches)."""
    data = []
    names: dict[str, int] = {}
    for page, text in pages:
        nodes = parse(page)
        rows = [[names.setdefault(f, len(names)) for f in row] for row in features(nodes)]
        data.append((rows, [n.parent for n in nodes], label(nodes, text)))
    size = len(names)
    w, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    count = sum(len(d[0]) for d in data) or 1
    for step in range(1, rounds + 1):
        g = -ridge * w * count
        edge = [[w[size], w[size + 1]], [w[size + 2], w[size + 3]]]
        for rows, parents, states in data:
            p, pairs = marginals(parents, [float(w[r].sum()) for r in rows], edge)
            for row, q, y in zip(rows, p, states, strict=True):
                g[row] += y - q
            for i in range(1, len(parents)):
                g[size + 2 * states[parents[i]] + states[i]] += 1
            g[size:] -= np.ravel(pairs)
        g /= count
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(w[i]) for f, i in names.items()}, [[float(w[size]), float(w[size + 1])], [float(w[size + 2]), float(w[size + 3])]])


@lru_cache(maxsize=1)
def trained() -> Model:
    return train(labelled_pages())


def extract(page: str | None, model: Model) -> str:
    nodes = parse(page or "")
    get = model.weights.get
    p, _ = marginals([n.parent for n in nodes], [sum(get(f, 0.0) for f in row) for row in features(nodes)], model.edge)
    runs = [r for node, q in zip(nodes, p, strict=True) if q > 0.5 for r in node.runs]
    return "\n\n".join(r[1] for r in sorted(runs, key=lambda r: r[0]))


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, model) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``; no shuffle."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(model or trained()), "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
