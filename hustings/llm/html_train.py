"""Trains the HTML model from labelled pages: python -m hustings.llm.html_train.

Labelled pages are written by a seeded generator in several templates, with and without telling names. The labels of
their runs of text and elements are known as they are written. Weights and edge potentials follow the gradient of the
log likelihood: observed minus expected counts, the expected ones by the model's own messages.
"""

from __future__ import annotations

import html
import json
import math
import random
from collections import defaultdict

from .htmltext import WEIGHTS, Tree, kind, messages

YES, NO = "\x01", "\x02"


class Writer:
    """Markup whose runs of text carry their label as their first character."""

    def __init__(self, r: random.Random):
        self.r, self.out = r, []

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        return html.escape(" ".join("".join(self.r.choice("aeiourstnlmdé") for _ in range(self.r.randint(2, 9))) + self.r.choice(("", "", "", "", ",", ".")) for _ in range(n)))

    def text(self, good: bool, low: int, high: int) -> str:
        return (YES if good else NO) + self.words(low, high)

    def sentence(self, good: bool, low: int = 8, high: int = 60) -> str:
        body = self.text(good, low, high)
        if good and self.r.random() < 0.3:
            mark = self.r.choice(("b", "em", "i", "code", "span", "strong"))
            body += f" <{mark}>{self.text(True, 1, 4)}</{mark}> {self.text(True, 2, 10)}"
        if good and self.r.random() < 0.25:
            body += f' <a href="/x">{self.text(True, 1, 4)}</a> {self.text(True, 3, 12)}'
        return body + "."

    def named(self, names: str) -> str:
        x = self.r.random()
        name = self.r.choice(names.split())
        return f' class="{name}"' if x < 0.45 else f' id="{name}"' if x < 0.65 else f' class="x{self.r.randint(1, 99)} {name}-box"' if x < 0.85 else ""

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{self.text(False, 1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def boiler(self) -> str:
        r, tag = self.r, self.r.choice(("div", "section", "aside"))
        return r.choice((
            lambda: f"<nav{self.named('menu nav main-nav')}>{self.links(r.randint(2, 8))}</nav>",
            lambda: f'<div class="{r.choice(("nav", "menu", "breadcrumb", "pagination"))}">{self.links(r.randint(2, 6))}</div>',
            lambda: f'<{tag} class="{r.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner"))}">{self.wrap(self.sentence(False, 3, 25))}</{tag}>',
            lambda: f'<{tag} id="{r.choice(("cookie-notice", "consent", "newsletter", "alert", "popup"))}">{self.wrap(self.sentence(False, 4, 25))}<button>{self.text(False, 1, 2)}</button></{tag}>',
            lambda: f"<aside{self.named('sidebar widget related')}><h3>{self.text(False, 1, 4)}</h3>{self.wrap(self.sentence(False, 4, 30))}{self.links(r.randint(0, 5))}</aside>",
            lambda: f'<div class="{r.choice(("sidebar", "related", "widget", "recommended"))}"><h3>{self.text(False, 1, 4)}</h3><p>{self.sentence(False, 4, 30)}</p></div>',
            lambda: f'<form action="/s"><label>{self.text(False, 1, 4)}</label><input name="q"><p>{self.sentence(False, 3, 12)}</p><button>{self.text(False, 1, 2)}</button></form>',
            lambda: f'<div class="{r.choice(("share", "social", "tags"))}">{self.text(False, 1, 3)} <a href="/t">{self.text(False, 1, 2)}</a></div>',
            lambda: f"<script>var x={r.randint(1, 9)};</script><style>p{{margin:0}}</style><!-- {self.words(1, 4)} -->",
        ))()

    def wrap(self, x: str) -> str:
        return self.r.choice((x, f"<p>{x}</p>", f"<div>{x}</div>", f"<span>{x}</span>"))

    def comments(self) -> str:
        tag = self.r.choice(("section", "div", "ol"))
        item = "li" if tag == "ol" else "div"
        name = self.r.choice(("comments", "comment-list", "discussion", "replies", "disqus_thread"))
        return f'<{tag} {self.r.choice(("id", "class"))}="{name}">' + "".join(f'<{item} class="comment">{self.text(False, 1, 2)}<p>{self.sentence(False, 4, 40)}</p></{item}>' for _ in range(self.r.randint(1, 4))) + f"</{tag}>"

    def piece(self) -> str:
        r = self.r
        return r.choice((
            *[lambda: f"<p>{self.sentence(True)}</p>"] * 8, lambda: f"<p><b>{self.sentence(True)}<br>", lambda: f"<p>{self.text(True, 1, 4)}</p>", lambda: f"<h{r.randint(2, 4)}>{self.text(True, 1, 8)}</h2>",
            lambda: "<ul>" + "".join(f"<li>{self.sentence(True, 2, 15)}</li>" for _ in range(r.randint(1, 4))) + "</ul>", lambda: f"<blockquote><p>{self.sentence(True)}</p></blockquote>",
            lambda: f"<pre>{self.text(True, 3, 20)}</pre>", lambda: f"<table><tr><th>{self.text(True, 1, 2)}</th><td>{self.text(True, 1, 4)}</td></tr></table>", lambda: f"<figure><img src=x><figcaption>{self.text(True, 2, 9)}</figcaption></figure>",
            lambda: f"<div>{self.sentence(True)}</div>",
        ))()

    def page(self) -> str:
        r = self.r
        tag, names = r.choice((("article", ""), ("article", "post entry"), ("main", "content"), ("div", "content article post entry-content story"), ("section", "article-body content"), ("article", "")))
        body = [f"<h1>{self.text(True, 2, 12)}</h1>"] + [self.piece() for _ in range(r.randint(1, 12))]
        for _ in range(r.choice((0, 0, 1, 2))):
            body.insert(r.randint(1, len(body)), self.boiler())
        if r.random() < 0.15:
            body.append(self.comments())
        if tag == "article" and r.random() < 0.3:
            body[0] = f"<header>{body[0]}</header>"
        main = f"<{tag}{self.named(names) if names else ''}>{''.join(body)}</{tag}>"
        if r.random() < 0.3:
            main = f"<main>{main}</main>" if tag != "main" else f"<div>{main}</div>"
        top = [f"<header{self.named('header masthead')}>{self.wrap(self.text(False, 1, 6))}{r.choice(('', self.links(3)))}</header>"] * (r.random() < 0.5) + [self.boiler() for _ in range(r.randint(0, 3))]
        end = [self.boiler() for _ in range(r.randint(0, 3))] + [self.comments()] * (r.random() < 0.35)
        end += [f"<footer{self.named('footer')}>{NO}&copy; {self.words(1, 4)} &middot; {self.words(3, 20)}{r.choice(('', self.links(3)))}</footer>"] * (r.random() < 0.7)
        shell = f'<div class="{r.choice(("wrapper", "page", "container", "c1"))}">' if r.random() < 0.5 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style></head><body>{shell}{''.join(top)}{main}{''.join(end)}{'</div>' * bool(shell)}{r.choice(('</body></html>', ''))}"


def labelled(seed: int) -> tuple[Tree, list[int | None]]:
    """A page's tree and the label of each node: of text as written, of an element the majority of the text in it."""
    tree = Tree(Writer(random.Random(seed)).page())
    n = len(tree.tag)
    label: list[int | None] = [None] * n
    votes = [[0, 0] for _ in range(n)]
    for k in range(n - 1, -1, -1):
        if tree.tag[k] == "":
            good = YES in tree.text[k]
            if good or NO in tree.text[k]:
                label[k] = int(good)
                votes[k][int(good)] = len(tree.text[k])
                tree.text[k] = tree.text[k].replace(YES, "").replace(NO, "")
            else:
                label[k] = None
        elif sum(votes[k]):
            label[k] = int(votes[k][1] >= votes[k][0])
        else:
            label[k] = 0
        if k:
            votes[tree.parent[k]][0] += votes[k][0]
            votes[tree.parent[k]][1] += votes[k][1]
    for k in range(n):
        if label[k] is None:
            label[k] = label[tree.parent[k]]
    tree.describe()
    return tree, label


def _pairs(tree: Tree, own: list[float], edges: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Marginals of nodes and expected counts of (parent, child) values by edge kind."""
    kinds = [kind(t) for t in tree.tag]
    belief, up = messages(tree.parent, own, kinds, edges)
    expected = [[0.0] * 4 for _ in edges]
    low = [0.0] * len(belief)
    for k in range(1, len(belief)):
        a, b, c, d = edges[kinds[k]]
        rest = belief[tree.parent[k]] - up[k]
        down = b - a + math.log1p(math.exp(min(40, rest + d - b))) - math.log1p(math.exp(min(40, rest + c - a)))
        s = belief[k] - down
        z = [a, b + s, c + rest, d + rest + s]
        high = max(z)
        w = [math.exp(x - high) for x in z]
        for j in range(4):
            expected[kinds[k]][j] += w[j] / sum(w)
    low = [1 / (1 + math.exp(-max(-40, min(40, x)))) for x in belief]
    return low, expected


def train(pages: int = 400, rounds: int = 12, rate: float = 0.3, ridge: float = 1e-4) -> tuple[dict[str, float], list[list[float]]]:
    """Weights by feature and edge potentials, by AdaGrad over pages."""
    weights, seen = defaultdict(float), defaultdict(lambda: 1e-2)
    edges, seen_edges = [[0.5, 0.0, 0.0, 0.5] for _ in range(3)], [[1e-2] * 4 for _ in range(3)]
    data = [labelled(s) for s in range(pages)]
    for step in range(rounds):
        for tree, label in data:
            own = [sum(weights[f] for f in fs) for fs in tree.features]
            marginal, expected = _pairs(tree, own, edges)
            grad = defaultdict(float)
            for fs, y, p in zip(tree.features, label, marginal):
                for f in fs:
                    grad[f] += y - p
            for f, g in grad.items():
                g -= ridge * weights[f] * len(data)
                seen[f] += g * g
                weights[f] += rate * g / math.sqrt(seen[f])
            observed = [[0.0] * 4 for _ in edges]
            for k in range(1, len(label)):
                observed[kind(tree.tag[k])][2 * label[tree.parent[k]] + label[k]] += 1
            for i in range(3):
                for j in range(4):
                    g = observed[i][j] - expected[i][j]
                    seen_edges[i][j] += g * g
                    edges[i][j] += rate * g / math.sqrt(seen_edges[i][j])
        if step % 4 == 3:
            print(step + 1, *errors(weights, edges, range(10_000, 10_100)), flush=True)
    return dict(weights), edges


def errors(weights: dict[str, float], edges: list[list[float]], seeds) -> tuple[int, int]:
    """(wrong, all) runs of text on other pages."""
    wrong = total = 0
    for s in seeds:
        tree, label = labelled(s)
        belief, _ = messages(tree.parent, [sum(weights.get(f, 0.0) for f in fs) for fs in tree.features], [kind(t) for t in tree.tag], edges)
        for k, x in enumerate(belief):
            if tree.tag[k] == "" and tree.text[k].strip():
                total += 1
                wrong += (x >= 0) != bool(label[k])
    return wrong, total


if __name__ == "__main__":
    w, e = train()
    WEIGHTS.write_text(json.dumps({"weights": {k: round(v, 5) for k, v in sorted(w.items())}, "edges": [[round(x, 5) for x in row] for row in e]}, indent=0))
