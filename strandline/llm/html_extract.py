"""Main text of HTML pages by a tree-structured graphical model.

A page's block elements are the nodes of a tree; each is content or not.  A
node has a potential from its features (tag, class and id words, text, links,
ancestors), and each parent and child have a potential for their pair of
states.  Sum-product messages passed once up and once down the tree give exact
marginals; text of nodes that are content with probability 0.5 or more is the
main text.  The weights are trained by gradient ascent on the exact likelihood
of labelled pages, whose expected counts come from the same two passes.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .staging import table

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "noscript", "iframe", "textarea", "title", "xmp", "noembed", "noframes")
UNSEEN = frozenset("script style template noscript iframe title head canvas audio video noembed noframes xmp".split())
#: What may stand in a head; any other tag closes it, as </head> may be left out.
IN_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img ruby rt rp nobr".split())
#: Formulas are text of the block they stand in.
INLINE |= frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation".split())
FOREIGN = frozenset(("svg", "math"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("table ul ol dl select article section div body html".split())

#: Elements nested deeper than this become siblings, as browsers do; no text is lost.
MAX_DEPTH = 512

# a quote opens a quoted value only where a value begins; within names and unquoted values, and if nothing closes it, it is a character
_ATTRIBUTES = re.compile(r"(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++|(?=>)))?+|=)*+")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTR = re.compile(r"(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_LABEL = re.compile(r"data-y=[\"']?([01])")
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
_NAME = re.compile(r"[a-z]+")
_COMMENT_END = re.compile(r"--!?>")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_TOO_LARGE = re.compile(r"&#[0-9]{8,}+;?")


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, however long, give U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_TOO_LARGE.sub("\ufffd", _ZEROS.sub("&#", text)))


@dataclass
class Tree:
    """Block elements of a page in document order; node 0 is the root."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    label: list[int] = field(default_factory=lambda: [-1])
    linked: list[int] = field(default_factory=lambda: [0])
    #: (node, text) of each block of text, in page order.
    blocks: list[tuple[int, str]] = field(default_factory=list)


class _Markup:
    """Where the next piece of markup begins and ends; every character is looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.cdata = page.rfind("]]>")

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """(begin, end, tag, whether it closes, attributes) from ``at`` on; comments and the like have no tag.

        What an unfinished tag or comment opens runs to the end of the page.
        """
        page, n = self.page, len(self.page)
        begin = page.find("<", at)
        while begin >= 0:
            after = page[begin + 1 : begin + 2]
            if after == "!":
                return begin, self._declaration(begin), "", False, ""
            if after == "?":
                return begin, self._beyond(begin), "", False, ""
            if m := _TAG.match(page, begin):
                rest = _ATTRIBUTES.match(page, m.end())
                end = rest.end()
                return begin, min(end + 1, n), m.group(1).lower() if end < n else "", after == "/", rest.group()
            if after == "/" and page[begin + 2 : begin + 3].strip():
                return begin, self._beyond(begin), "", False, ""
            begin = page.find("<", begin + 1)
        return n, n, "", False, ""

    def _beyond(self, begin: int) -> int:
        end = self.page.find(">", begin)
        return end + 1 if end >= 0 else len(self.page)

    def _declaration(self, begin: int) -> int:
        page = self.page
        if page.startswith("<!--", begin):
            if page.startswith((">", "->"), begin + 4):
                return self._beyond(begin)
            m = _COMMENT_END.search(page, begin + 4)
            return m.end() if m else len(page)
        if self.cdata > begin and page.startswith("<![CDATA[", begin):
            return page.find("]]>", begin) + 3
        return self._beyond(begin)


class _Open:
    """Open elements; looking one up by name costs the same however many are open."""

    def __init__(self) -> None:
        self.names = ["#root"]
        self.nodes = [0]  # the node that an element's text goes to
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in SCOPES:
            self.scopes.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def pop(self) -> str:
        name = self.names.pop()
        self.nodes.pop()
        self.places[name].pop()
        if name in SCOPES:
            self.scopes.pop()
        return name

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name, 0 if there is none."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def last_in_scope(self, names: tuple[str, ...]) -> int:
        place = max(map(self.last, names))
        return place if place > (self.scopes[-1] if self.scopes else 0) else 0


def parse(page: str, *, labels: bool = False) -> Tree:
    """A forgiving parser, linear in the page: any text gives a tree, unclosed and stray tags included.

    ``labels`` reads the labels of training pages; no other page is asked for them.
    """
    tree = Tree()
    stack = _Open()
    unseen = links = foreign = 0
    piece: list[str] = []
    owner = 0

    def flush() -> None:
        nonlocal piece
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                tree.blocks.append((owner, text))
            piece = []

    def text_at(raw: str) -> None:
        nonlocal owner
        if stack.names[-1] == "head" and raw.strip():
            close(len(stack.names) - 1)
        if raw and not unseen:
            node = stack.nodes[-1]
            if node != owner:
                flush()
                owner = node
            text = decoded(raw)
            piece.append(text)
            if links:
                tree.linked[node] += len(text)

    def close(to: int) -> None:
        """Closes what has been opened from a place on; 0 closes nothing."""
        nonlocal unseen, links, foreign
        while to and len(stack.names) > to:
            name = stack.pop()
            unseen -= name in UNSEEN
            links -= name == "a"
            foreign -= name in FOREIGN
            if name not in INLINE:
                flush()

    markup = _Markup(page)
    at, n = 0, len(page)
    while at < n:
        begin, end, name, closes, attributes = markup.next(at)
        text_at(page[at:begin])
        at = end
        if not name:
            continue
        if closes:
            if name == "p" and not stack.last("p"):
                flush()
            close(stack.last(name))
            continue
        if name not in IN_HEAD:
            close(stack.last("head"))
        if name in CLOSES_P:
            close(stack.last_in_scope(("p",)))
        if name in SIBLINGS:
            close(stack.last_in_scope(SIBLINGS[name]))
        if name == "br":
            text_at(" ")
            continue
        if name == "hr":
            flush()
            continue
        empty = attributes.endswith("/")
        if name in VOID or (empty and foreign):
            continue
        parent = stack.nodes[-1]
        if name in INLINE:
            node = parent
            links += name == "a"
        else:
            flush()
            found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)}
            words = _NAME.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower())
            if tree.depth[parent] >= MAX_DEPTH:
                parent = tree.parent[parent]
            tree.parent.append(parent)
            tree.depth.append(tree.depth[parent] + 1)
            tree.tag.append(name)
            tree.names.append(tuple(dict.fromkeys(words)))
            label = _LABEL.search(attributes) if labels else None
            tree.label.append(int(label.group(1)) if label else -1)
            tree.linked.append(0)
            node = owner = len(tree.tag) - 1
        stack.push(name, node)
        unseen += name in UNSEEN
        foreign += name in FOREIGN
        if name in _RAW_END and not empty:
            stop = _RAW_END[name].search(page, at)
            text_at(page[at : stop.start()] if stop else page[at:])
            at = stop.end() if stop else n
            close(len(stack.names) - 1)
    flush()
    return tree


def _size(chars: int) -> int:
    """0 without text of its own, 1 with a little, 2 with a sentence or more."""
    return (chars > 0) + (chars >= 60)


def features(tree: Tree) -> list[list[str]]:
    """Names of the features that hold at each node."""
    n = len(tree.tag)
    own, below = [0] * n, [0] * n
    for node, text in tree.blocks:
        own[node] += len(text)
    total = own[:]
    linked = tree.linked[:]
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        total[p] += total[k]
        linked[p] += linked[k]
        below[p] += tree.tag[k] == "p"
    out = []
    for k in range(n):
        p = tree.parent[k]
        ptag = tree.tag[p] if p >= 0 else "#none"
        got = ["bias", f"t:{tree.tag[k]}", f"pt:{ptag}>{tree.tag[k]}", f"own:{_size(own[k])}", f"link:{int(4 * min(1, linked[k] / total[k])) if total[k] else -1}", f"p:{min(below[k], 2)}"]
        got += [f"c:{w}" for w in tree.names[k]]
        got += [f"c5:{w[:5]}" for w in tree.names[k]]
        out.append(got)
    return out


EDGE_TAGS = ("p", "li", "div", "section", "h1", "h2", "h3", "ul", "ol", "nav", "aside", "form", "footer", "header", "table")


@dataclass
class Forest:
    """Trees of many pages in one set of arrays."""

    parent: np.ndarray
    edge: np.ndarray  # kind of the edge to the parent
    levels: list[np.ndarray]  # nodes by depth
    node: np.ndarray  # feature incidence: node and feature
    feature: np.ndarray


@dataclass
class Model:
    vocabulary: dict[str, int]
    weight: np.ndarray
    pair: np.ndarray  # [edge kind, parent state, child state]

    def forest(self, trees: list[Tree], grow: bool = False) -> Forest:
        parent, depth, edge, node, feature = [], [], [], [], []
        base = 0
        for tree in trees:
            for k, names in enumerate(features(tree)):
                for f in names:
                    i = self.vocabulary.setdefault(f, len(self.vocabulary)) if grow else self.vocabulary.get(f)
                    if i is not None:
                        node.append(base + k)
                        feature.append(i)
            parent += [p + base if p >= 0 else -1 for p in tree.parent]
            depth += tree.depth
            edge += [EDGE_TAGS.index(t) + 1 if t in EDGE_TAGS else 0 for t in tree.tag]
            base += len(tree.tag)
        d = np.array(depth)
        order = np.argsort(d, kind="stable")
        cuts = np.searchsorted(d[order], np.arange(d.max() + 2)) if len(d) else np.zeros(1, int)
        return Forest(np.array(parent), np.array(edge), [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.array(node, np.int64), np.array(feature, np.int64))

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of nodes (state 1) and of edges, and the log partition function, by one pass up and one down."""
        n = len(f.parent)
        score = np.zeros((n, 2))
        score[:, 1] = np.bincount(f.node, self.weight[f.feature], n)
        up = score.copy()  # own potential and messages from children
        to_parent = np.zeros((n, 2))
        for nodes in reversed(f.levels[1:]):
            to_parent[nodes] = np.logaddexp.reduce(self.pair[f.edge[nodes]] + up[nodes][:, None, :], axis=2)
            np.add.at(up, f.parent[nodes], to_parent[nodes])
        roots = f.levels[0] if f.levels else np.zeros(0, int)
        log_z = float(np.logaddexp.reduce(up[roots], axis=1).sum())
        down = np.zeros((n, 2))  # message from the parent
        edges = np.zeros((n, 2, 2))
        for nodes in f.levels[1:]:
            p = f.parent[nodes]
            rest = up[p] + down[p] - to_parent[nodes]  # parent without this child
            joint = rest[:, :, None] + self.pair[f.edge[nodes]]
            down[nodes] = np.logaddexp.reduce(joint, axis=1)
            joint += up[nodes][:, None, :]
            joint -= np.logaddexp.reduce(joint.reshape(len(nodes), 4), axis=1)[:, None, None]
            edges[nodes] = np.exp(joint)
        belief = up + down
        return np.exp(belief[:, 1] - np.logaddexp.reduce(belief, axis=1)), edges, log_z

    def extract(self, pages: list[str]) -> list[str]:
        """The main text of each page."""
        trees = [parse(p) for p in pages]
        if not trees:
            return []
        marginal, _, _ = self.messages(self.forest(trees))
        out, base = [], 0
        for tree in trees:
            out.append(" ".join(text for node, text in tree.blocks if marginal[base + node] >= 0.5))
            base += len(tree.tag)
        return out


def train(trees: list[Tree], steps: int = 200, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Gradient ascent (Adam) on the likelihood of labelled trees; a node without label has its parent's."""
    model = Model({}, np.zeros(0), np.zeros((len(EDGE_TAGS) + 1, 2, 2)))
    forest = model.forest(trees, grow=True)
    model.weight = np.zeros(len(model.vocabulary))
    label = np.concatenate([t.label for t in trees])
    for nodes in forest.levels:
        bare = nodes[label[nodes] < 0]
        p = forest.parent[bare]
        label[bare] = np.where(p >= 0, label[np.maximum(p, 0)], 0)
    inner = np.concatenate(forest.levels[1:])
    n, kinds = len(label), len(model.pair)
    seen_w = np.bincount(forest.feature, label[forest.node], len(model.weight))
    seen_p = np.zeros_like(model.pair)
    np.add.at(seen_p, (forest.edge[inner], label[forest.parent[inner]], label[inner]), 1)
    moments = [np.zeros_like(x) for x in (model.weight, model.weight, model.pair, model.pair)]
    for step in range(1, steps + 1):
        marginal, edges, _ = model.messages(forest)
        want_w = np.bincount(forest.feature, marginal[forest.node], len(model.weight))
        want_p = np.zeros((kinds, 2, 2))
        np.add.at(want_p, forest.edge[inner], edges[inner])
        for k, (grad, value) in enumerate((((seen_w - want_w) / n - ridge * model.weight, model.weight), ((seen_p - want_p) / n - ridge * model.pair, model.pair))):
            m, s = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    """A model trained on the labelled pages of html_samples."""
    from .html_samples import labelled_pages

    return train([parse(p, labels=True) for p in labelled_pages()])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``.

    Null html counts as empty and gives the empty text.  Blocks of content are
    joined by one space in page order, white space inside a block is one space,
    character references are decoded; nothing is cut off, however long.
    Repeated rows repeat, missing ids and urls stay missing, extra columns are
    ignored, an empty table gives an empty table.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.sub_batches(batches, "html", 2 << 20):
            texts = model.extract(tk.clean(batch.column(2)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
