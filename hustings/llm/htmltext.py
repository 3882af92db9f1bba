"""HTML extraction: a tree-structured graphical model over the DOM.

Every element and every run of text is a binary variable, content or not. A variable has a log-linear potential of its
own features, and each parent and child share a potential by the kind of the child. Sum-product messages upward
and downward give exact marginals; runs of text with a marginal of one half or more are kept. The weights are
trained from labelled pages by html_train.py.
"""

from __future__ import annotations

import json
import math
import pkgutil
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WEIGHTS = Path(__file__).with_name("html_weights.json")
#: Fixed values of HTML: elements without end, elements that start a block, elements that end an open one of a kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend li option summary tbody td tfoot th thead title tr noscript template select textarea".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("article aside body div dl fieldset form html main nav ol section table td th ul".split())
NEVER = frozenset("script style template noscript svg iframe object canvas head title textarea select button option math audio video".split())
#: Words of class, id and role names, by what they say about an element.
HINTS = {
    "ad": "ad ads adv advert advertisement adverts banner sponsor sponsored promo promotion promoted",
    "nav": "nav navigation navbar menu menus breadcrumb breadcrumbs pager pagination toc tabs toolbar skip",
    "head": "header masthead logo branding topbar site",
    "foot": "footer foot colophon copyright legal",
    "side": "sidebar aside widget rail related recommended trending popular more teaser",
    "note": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup overlay paywall toast",
    "share": "share sharing social follow tags tag meta byline",
    "talk": "comment comments disqus discussion reply replies respond thread reviews",
    "form": "form search login contact",
    "main": "article content main post entry story body text prose markdown",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
_WORD = re.compile(r"[a-z]+")


class Tree(HTMLParser):
    """A page as arrays in page order: parent, tag ('' for text), features, block number and text of each node."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.features, self.text, self.block_of = [-1], ["#root"], [["bias", "tag:#root"]], [""], [0]
        self.stack, self.open = [0], {}
        self.block = 0
        self.links = 0
        self.feed(html)
        self.close()

    def _add(self, tag: str, features: list[str], text: str = "") -> int:
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.features.append(features)
        self.text.append(text)
        self.block_of.append(self.block)
        return len(self.tag) - 1

    def _pop(self) -> str:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        self.links -= tag == "a"
        self.block += tag in BLOCKS
        return tag

    def _close_open(self, kinds: tuple[str, ...]) -> None:
        """Ends the innermost open elements of these kinds that lie within the scope of the current one."""
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[at]]
            if tag in kinds:
                while len(self.stack) > at:
                    self._pop()
                return
            if tag in SCOPES and tag not in kinds:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CLOSES_P and self.open.get("p"):
            self._close_open(("p",))
        if tag in CLOSED_BY:
            self._close_open(CLOSED_BY[tag])
        self.block += tag in BLOCKS
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label"))
        hints = {_HINT[w] for w in _WORD.findall(names.lower()) if w in _HINT} if names else ()
        hidden = any(k == "hidden" or k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs)
        node = self._add(tag, ["bias", "tag:" + tag, *["hint:" + h for h in sorted(hints)], *["hidden"] * hidden])
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            while self._pop() != tag:
                pass
        elif tag == "p" or tag == "br":
            self.block += tag == "p"

    def handle_data(self, data: str) -> None:
        if self.tag[self.stack[-1]] in NEVER:
            return
        if self.tag[-1] == "" and self.parent[-1] == self.stack[-1] and self.block_of[-1] == self.block:
            self.text[-1] += data
        else:
            self._add("", [], data)

    def describe(self) -> None:
        """Gives runs of text their features, when they are whole."""
        linked = [False] * len(self.tag)
        for k, tag in enumerate(self.tag):
            up = self.parent[k]
            linked[k] = tag == "a" or (up >= 0 and linked[up])
            if tag == "" and not self.features[k]:
                text = self.text[k].strip()
                n = len(text)
                marks = sum(text.count(c) for c in ".,;!?")
                self.features[k] = ["text", f"size:{min(n.bit_length(), 9)}", f"marks:{min(marks, 4)}", *["linked"] * linked[k], *["copyright"] * ("©" in text), f"under:{self.tag[up]}"]


class Model:
    """Weights by feature, and log potentials of (parent, child) by whether the child is text, inline or a block."""

    def __init__(self, weights: dict[str, float], edges: list[list[float]]):
        self.weights, self.edges = weights, edges

    def marginals(self, tree: Tree) -> list[float]:
        return marginals(tree.parent, [sum(map(self.weights.get, f, [0.0] * len(f))) for f in tree.features], [kind(t) for t in tree.tag], self.edges)


def kind(tag: str) -> int:
    """The edge kind of a child: text, inline, block."""
    return 0 if tag == "" else 2 if tag in BLOCKS else 1


def _soft(x: float) -> float:
    """log(1 + exp(x))."""
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def messages(parent: list[int], own: list[float], kinds: list[int], edges: list[list[float]]) -> tuple[list[float], list[float]]:
    """(belief, up): log odds of each node by all messages, and each node's upward message; children follow parents."""
    n = len(parent)
    total, up = list(own), [0.0] * n
    for k in range(n - 1, 0, -1):
        a, b, c, d = edges[kinds[k]]  # potentials of (0, 0), (0, 1), (1, 0), (1, 1)
        s = total[k]
        up[k] = c - a + _soft(s + d - c) - _soft(s + b - a)
        total[parent[k]] += up[k]
    for k in range(1, n):
        a, b, c, d = edges[kinds[k]]
        rest = total[parent[k]] - up[k]
        total[k] += b - a + _soft(rest + d - b) - _soft(rest + c - a)
    return total, up


def marginals(parent: list[int], own: list[float], kinds: list[int], edges: list[list[float]]) -> list[float]:
    """The probability that each node is content."""
    return [1 / (1 + math.exp(-max(-40.0, min(40.0, x)))) for x in messages(parent, own, kinds, edges)[0]]


def load() -> Model:
    got = json.loads(pkgutil.get_data(__package__, WEIGHTS.name))
    return Model(got["weights"], got["edges"])


def main_text(model: Model, html: str | None) -> str:
    """The main text: kept runs by block, white space in a block as one space, blocks joined by line ends."""
    if not html:
        return ""
    tree = Tree(html)
    tree.describe()
    blocks: dict[int, list[str]] = {}
    for k, p in enumerate(model.marginals(tree)):
        if tree.tag[k] == "" and p >= 0.5:
            blocks.setdefault(tree.block_of[k], []).append(tree.text[k])
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row, from the whole html.

    A null or empty html has an empty text. Broken markup is read as far as it goes: unclosed elements end with
    their parents. Nesting of any depth is read without recursion. Repeated rows and null ids are read like any;
    other columns aren't. One pass, no shuffle.
    """
    common.session(pages.sparkSession)
    base = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("t"))
    types = base.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for whole in batches:
            for b in common.pieces(whole, "t", 8 << 20):
                found = [main_text(model, t) for t in b.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("i"), b.column("u"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["i", "u", "text", "n_chars"])

    out = base.mapInArrow(run, f"i {types['i'].dataType.simpleString()}, u {types['u'].dataType.simpleString()}, text string, n_chars long")
    return out.withColumnsRenamed({"i": id_col, "u": url_col})
