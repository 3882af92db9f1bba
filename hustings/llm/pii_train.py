"""Trains the PII network in numpy from labelled spans: python -m hustings.llm.pii_train.

Labelled texts are written by a seeded generator: invented words in several scripts and layouts, with spans of the
four kinds in plain and in unusual forms (spelt-out addresses, dotted and bracketed numbers), and look-alikes that
are no personal data: hashes, keys, dates, prices, versions, license lines, words that hold or stand beside "at" and
"dot". Plain stochastic gradients with Adam, one seed.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np

from .pii import KINDS, N_CLASSES, WEIGHTS, classes, luhn


_SMALL = "at in of on it as dot that the is a to and an or not hat ration".split()


#: Letter groups that words of several languages repeat.
_GROUPS = "the at dot er on an re he in ed nd ha en es of or nt ea ti to it st io le is ou ar as de rt ve tion ing und sch que ent del ble".split()


def _word(r: random.Random) -> str:
    if (x := r.random()) < 0.25:
        return r.choice(_SMALL)
    if x < 0.65:
        w = "".join(r.choice(_GROUPS) for _ in range(r.randint(1, 5)))
        return w.capitalize() if r.random() < 0.15 else w
    w = "".join(r.choice("aeioubcdfghlmnprstvwéüñß") for _ in range(r.randint(1, 9)))
    return r.choice((w, w, w.capitalize(), w.upper()))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _name(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))


def _email(r: random.Random) -> str:
    name = _name(r) + r.choice(("", "." + _name(r), "_" + _name(r), "." + _digits(r, 2), "+" + _name(r)))
    host, end = _name(r) + r.choice(("", _digits(r, 1))), r.choice(("com", "org", "net", "de", "example.com"))
    at, dot = r.choice((("@", "."),) * 4 + ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", ".")))
    return name + at + host + dot + end


def _ip(r: random.Random) -> str:
    dot = r.choice((".",) * 4 + ("[.]", " . ", " dot "))
    return dot.join(str(r.randint(0, 255)) for _ in range(4))


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _digits(r, r.choice((14, 14, 14, 13, 11)))
    number = next(body + d for d in "0123456789" if luhn(body + d))
    gap = r.choice(("", "", " ", "-", "."))
    return gap.join(number[i : i + 4] for i in range(0, len(number), 4))


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{r.randint(20, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"00{r.randint(20, 99)} {a} {b}{c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}", f"+{r.randint(20, 99)}{a}{b}{c}"))


def _other(r: random.Random) -> str:
    number = _digits(r, r.choice((12, 14, 15, 16)))
    return r.choice((
        "password=" + "".join(r.choice("0123456789abcdef") for _ in range(18)), 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"',
        "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        f"Version {r.randint(0, 9)}.{r.randint(0, 20)}.", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"${r.randint(1, 9999)}.{r.randint(0, 99):02d}", _digits(r, r.randint(1, 8)), "@" + _name(r),
        f"{r.randint(0, 23)}:{r.randint(0, 59):02d}", _word(r) + " at " + _word(r), _word(r) + " at " + _word(r) + " to " + _word(r), _word(r) + " dot " + _word(r), f"Public License, version {r.randint(1, 4)}.",
        _word(r) + r.choice(("***", "&&&", "###", "!!!")), f"{_word(r)} at {r.randint(1, 12)} to {r.randint(1, 12)}.", ".".join(_digits(r, r.randint(1, 4)) for _ in range(r.choice((2, 3, 5)))), number if not luhn(number) else number[:-1] + str((int(number[-1]) + 1) % 10), f"({r.randint(1, 99)})", f"{_digits(r, 3)} {_digits(r, 3)}",
    ))


_MAKE = (_email, _ip, _card, _phone)


def sample(r: random.Random, length: int) -> tuple[str, list[tuple[int, int, int]]]:
    """A text of about so many code points and its spans (start, kind, end)."""
    text, spans = "", []
    dense = r.random() < 0.7
    sep = r.choice((" ", " ", " ", "  ", " | ", ", "))
    while len(text) < length:
        x = r.random()
        if dense and x < 0.08:
            kind = r.randrange(4)
            value = _MAKE[kind](r)
            spans.append((len(text), kind, len(text) + len(value)))
        elif x < 0.14:
            value = _other(r)
        else:
            value = _word(r)
        text += value + r.choice(("", "", "", "", ",", ".", "!!", ".\n")) + sep
    return text, spans


def batch(r: random.Random, rows: int, time: int) -> tuple[np.ndarray, np.ndarray]:
    """Class indices and tags (time, rows), cut anywhere."""
    x, y = np.zeros((time, rows), np.uint8), np.zeros((time, rows), np.uint8)
    for k in range(rows):
        text, spans = sample(r, time + 80)
        tags = np.zeros(len(text), np.uint8)
        for s, kind, e in spans:
            tags[s:e] = kind + 1
        cut = r.randint(0, len(text) - time)
        x[:, k], y[:, k] = classes(text)[cut : cut + time], tags[cut : cut + time]
    return x, y


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    high = x.max(axis, keepdims=True)
    return (high + np.log(np.exp(x - high).sum(axis, keepdims=True))).squeeze(axis)


def crf(e: np.ndarray, move: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of tags y under emissions e (time, rows, tags) and moves; gradients of both."""
    time, rows, k = e.shape
    ahead = np.empty_like(e)
    ahead[0] = e[0]
    for t in range(1, time):
        ahead[t] = _logsum(ahead[t - 1][:, :, None] + move, 1) + e[t]
    back = np.zeros_like(e)
    for t in range(time - 2, -1, -1):
        back[t] = _logsum(move + (e[t + 1] + back[t + 1])[:, None, :], 2)
    total = _logsum(ahead[-1], 1)
    de = np.exp(ahead + back - total[:, None])
    pair = np.exp(ahead[:-1, :, :, None] + move + (e[1:] + back[1:])[:, :, None, :] - total[:, None, None])
    dmove = pair.sum((0, 1))
    np.add.at(dmove, (y[:-1].ravel(), y[1:].ravel()), -1)
    grid = np.ogrid[:time, :rows]
    loss = (total - e[grid[0], grid[1], y].sum(0) - move[y[:-1], y[1:]].sum(0)).sum()
    de[grid[0], grid[1], y] -= 1
    n = time * rows
    return loss / n, de / n, dmove / n


def _forward(p: dict, x: np.ndarray, side: str) -> list:
    h = p["uf"].shape[0]
    last = cell = np.zeros((x.shape[1], h))
    trail = []
    for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
        g = np.tanh(p["x" + side][x[t]] + last @ p["u" + side])
        s = (g[:, : 3 * h] + 1) / 2
        i, o, f, c = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], g[:, 3 * h :]
        now = f * cell + i * c
        th = np.tanh(now)
        trail.append((t, last, cell, g, i, o, f, c, th))
        last, cell = o * th, now
    return trail


def _backward(p: dict, x: np.ndarray, side: str, trail: list, dh_out: np.ndarray, grad: dict) -> None:
    h = p["uf"].shape[0]
    dh, dc = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
    for t, last, cell, g, i, o, f, c, th in reversed(trail):
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - th * th)
        ds = np.hstack([dc * c, dh * th, dc * cell]) / 2
        dg = np.hstack([ds, dc * i]) * (1 - g * g)
        np.add.at(grad["x" + side], x[t], dg)
        grad["u" + side] += last.T @ dg
        dh, dc = dg @ p["u" + side].T, dc * f


def start(hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = len(KINDS) + 1
    p = {}
    for side in "fb":
        p["x" + side] = rng.standard_normal((N_CLASSES, 4 * hidden)) * 0.3
        p["x" + side][:, 2 * hidden : 3 * hidden] += 0.7
        p["u" + side] = rng.standard_normal((hidden, 4 * hidden)) * 0.3
        p["e" + side] = rng.standard_normal((hidden, k)) * 0.3
    p["e0"], p["move"] = np.zeros(k), np.eye(k) * 2.0
    p["e0"][0] = 1.0
    return p


def train(hidden: int = 8, steps: int = 3_000, rows: int = 96, time: int = 96, rate: float = 0.015, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights after so many steps."""
    r = random.Random(seed)
    p = start(hidden, seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, y = batch(r, rows, time)
        trails = {s: _forward(p, x, s) for s in "fb"}
        states = {s: np.empty((time, rows, hidden)) for s in "fb"}
        for s in "fb":
            for t, _, _, _, _, o, _, _, th in trails[s]:
                states[s][t] = o * th
        e = states["f"] @ p["ef"] + states["b"] @ p["eb"] + p["e0"]
        loss, de, dmove = crf(e, p["move"], y)
        grad = {k: np.zeros_like(a) for k, a in p.items()}
        grad["move"], grad["e0"] = dmove, de.sum((0, 1))
        for s in "fb":
            grad["e" + s] = np.einsum("trh,trk->hk", states[s], de)
            _backward(p, x, s, trails[s], de @ p["e" + s].T, grad)
        norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
        lr = rate * min(1.0, step / 50) * (1 - step / (steps + 1))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / norm)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        if step % 100 == 0:
            print(step, round(float(loss), 5), flush=True)
    return p


def accuracy(weights: dict[str, np.ndarray], texts: int = 300, seed: int = 99) -> tuple[float, float]:
    """Precision and recall of exact spans on texts that training didn't see."""
    from .pii import LEAST, Network, spans_of, tag_texts

    r = random.Random(seed)
    cases: Sequence = [sample(r, 400) for _ in range(texts)]
    hit = found = truth = 0
    for (_, spans), (tags, sure) in zip(cases, tag_texts(Network(weights), [t for t, _ in cases])):
        got = {s for s in spans_of(tags) if sure[s[0] : s[2]].min() >= LEAST}
        hit += len(got & set(spans))
        found += len(got)
        truth += len(spans)
    return hit / max(found, 1), hit / max(truth, 1)


if __name__ == "__main__":
    got = train()
    print(accuracy(got))
    np.savez_compressed(WEIGHTS, **{k: a.astype(np.float32) for k, a in got.items()})
