"""Personal data: a character-level bidirectional LSTM with CRF transitions, beside fixed patterns.

The network reads overlapping windows of a whole text; its tags are decoded by Viterbi in each window and reconciled
over the text: where windows overlap, each half of the overlap follows the window it lies deeper in, and spans that
cross a seam are joined. The network decides: a span is added where the CRF's marginal probability of its kind is
`least` or more at each of its characters. Only what can be computed is checked after that: the checksum of a card,
the range of an address' parts. It is trained in numpy from labelled spans by pii_train; pii_weights.npz holds what
that gave.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
WINDOW, OVERLAP = 256, 64
#: Windows that one step of the network takes together.
ROWS = 2_048
#: The marginal probability that each character of an added span needs.
LEAST = 0.9
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

# ---- Fixed patterns ---------------------------------------------------------------------------------------------

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether digits pass the checksum of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, from each @ outwards, so runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            free = host.end()
        at = text.find("@", max(at + 1, free))


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all fixed patterns; a match that fails its test is dropped and isn't tried again."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- The network ------------------------------------------------------------------------------------------------

#: Character classes: 10 digits, letters in 8 groups (those of "at" and "dot" alone), the marks of the patterns, white
#: space, other ASCII, others.
_MARKS = "@.-_+%() :/,;=\"'\n[]"
_LETTERS = "aodt"
_FIRST_MARK = 18
_SPACE_CLASS, _ASCII_CLASS, _OTHER_CLASS, _PAD = (_FIRST_MARK + len(_MARKS) + k for k in range(4))
N_CLASSES = _PAD + 1


def _class(code: int) -> int:
    c = chr(code)
    if c.isdigit():
        return code - 48
    if c in _MARKS:
        return _FIRST_MARK + _MARKS.index(c)
    if c in _LETTERS:
        return 10 + _LETTERS.index(c)
    if c.isalpha():
        return 14 + 2 * c.isupper() + (c.lower() in "aeiou")
    return _SPACE_CLASS if c.isspace() else _ASCII_CLASS


_CLASSES = np.full(256, _OTHER_CLASS, np.uint8)
_CLASSES[:128] = [_class(k) for k in range(128)]


def classes(text: str) -> np.ndarray:
    """The class of each code point; those beyond Latin-1 share one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes), _OTHER_CLASS, np.uint8)
    low = codes < 256
    out[low] = _CLASSES[codes[low]]
    return out


class Network:
    """Weights and inference; gates are in the order input, output, forget, candidate, sigmoids by tanh of half."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}
        self.hidden = self.w["uf"].shape[0]

    def states(self, x: np.ndarray, side: str, over: Sequence[int] = ()) -> np.ndarray:
        """(time, hidden, rows) states of class indices (time, rows), read forward for side f or backward for b. The
        first over[t] rows have ended before t, so what stands there changes no state within a row."""
        time, rows = x.shape
        h = self.hidden
        u = np.ascontiguousarray(self.w["u" + side].T)
        table = np.ascontiguousarray(self.w["x" + side].T)
        out = np.empty((time, h, rows), np.float32)
        g, cell = np.empty((4 * h, rows), np.float32), np.zeros((h, rows), np.float32)
        fed, tmp = np.empty((4 * h, rows), np.float32), np.empty((h, rows), np.float32)
        last = np.zeros((h, rows), np.float32)
        for t in range(time) if side == "f" else range(time - 1, -1, -1):
            np.take(table, x[t], axis=1, out=fed, mode="clip")
            np.dot(u, last, out=g)
            g += fed
            np.tanh(g, out=g)
            gates = g[: 3 * h]
            gates *= 0.5
            gates += 0.5
            cell *= g[2 * h : 3 * h]
            np.multiply(g[:h], g[3 * h :], out=tmp)
            cell += tmp
            last = out[t]
            np.tanh(cell, out=last)
            last *= g[h : 2 * h]
            if over and over[t]:
                last[:, : over[t]] = cell[:, : over[t]] = 0
        return out

    def emissions(self, x: np.ndarray, over: Sequence[int] = ()) -> np.ndarray:
        """(time, tags, rows) scores of each tag for class indices (time, rows)."""
        e = np.matmul(self.w["ef"].T, self.states(x, "f", over))
        e += np.matmul(self.w["eb"].T, self.states(x, "b", over))
        e += self.w["e0"][None, :, None]
        return e

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """(time, tags, rows) probabilities of each tag under the CRF, by messages forward and backward."""
        move = np.exp(self.w["move"].astype(np.float64))
        local = np.exp(e.astype(np.float64) - e.max(1, keepdims=True))
        ahead, back = np.empty_like(local), np.ones_like(local)
        for t in range(len(e)):
            ahead[t] = local[t] * (move.T @ ahead[t - 1] if t else 1.0)
            ahead[t] /= ahead[t].sum(0)
        for t in range(len(e) - 2, -1, -1):
            back[t] = move @ (local[t + 1] * back[t + 1])
            back[t] /= back[t].sum(0)
        both = ahead * back
        return both / both.sum(1, keepdims=True)

    def tags(self, x: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The best tag sequence of each column of class indices (time, rows), and the tags' marginal probabilities in
        those columns that hold any span, 1 elsewhere. A column's result depends on its first `lengths` indices alone;
        lengths ascend."""
        lengths = np.full(x.shape[1], len(x)) if lengths is None else lengths
        over = np.searchsorted(lengths, np.arange(len(x)), side="right").tolist()
        e = self.emissions(x, over)
        move = self.w["move"]
        time, k, rows = e.shape
        back = np.empty((time, k, rows), np.uint8)
        best = e[0].copy()
        for t in range(1, time):
            now = best[0] + move[0][:, None]
            where = back[t]
            where[:] = 0
            for j in range(1, k):
                with_j = best[j] + move[j][:, None]
                better = with_j > now
                np.maximum(now, with_j, out=now)
                where[better] = j
            now += e[t]
            if over[t]:
                now[:, : over[t]], where[:, : over[t]] = best[:, : over[t]], np.arange(k, dtype=np.uint8)[:, None]
            best = now
        out = np.empty((time, rows), np.uint8)
        at = best.argmax(0).astype(np.uint8)
        every = np.arange(rows)
        for t in range(time - 1, -1, -1):
            out[t] = at
            at = back[t, at, every]
        sure = np.ones((time, rows), np.float32)
        some = np.flatnonzero(out.any(0))
        for n in np.unique(lengths[some]).tolist():
            own = some[lengths[some] == n]
            sure[:n, own] = np.take_along_axis(self.marginals(e[:n][:, :, own]), out[:n][:, None, own], 1)[:, 0]
        return out, sure


def load() -> Network:
    import io
    import pkgutil

    with np.load(io.BytesIO(pkgutil.get_data(__package__, WEIGHTS.name))) as f:
        return Network(dict(f))


def tag_texts(network: Network, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The tag of each code point of each text and its probability, from overlapping windows reconciled over the whole
    text."""
    coded = [classes(t) for t in texts]
    step = WINDOW - OVERLAP
    spots, pieces = [], []
    for i, c in enumerate(coded):
        for s in range(0, max(1, len(c) - OVERLAP), step):
            part = c[s : s + WINDOW]
            if len(part):
                spots.append((i, s, len(part)))
                pieces.append(part)
    out = [(np.zeros(len(c), np.uint8), np.ones(len(c), np.float32)) for c in coded]
    order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
    for a in range(0, len(order), ROWS):
        own = order[a : a + ROWS]
        longest = len(pieces[own[-1]])
        x = np.full((len(own), longest), _PAD, np.uint8)
        for r, k in enumerate(own):
            x[r, : len(pieces[k])] = pieces[k]
        same, back = np.unique(x, axis=0, return_inverse=True) if len(own) > 1 and (x[0] == x[-1]).all() else (x, np.arange(len(own)))
        lengths = np.array([len(pieces[k]) for k in own]) if len(same) == len(own) else np.full(len(same), longest)
        tags, sure = (a.T[back.ravel()] for a in network.tags(np.ascontiguousarray(same.T), lengths))
        for r, k in enumerate(own):
            i, s, n = spots[k]
            lo = s + (OVERLAP // 2 if s else 0)
            hi = s + n - (OVERLAP // 2 if s + n < len(out[i][0]) else 0)
            out[i][0][lo:hi], out[i][1][lo:hi] = tags[r, lo - s : hi - s], sure[r, lo - s : hi - s]
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs of tags 1 and up."""
    if not tags.any():
        return []
    cut = np.flatnonzero(np.diff(tags)) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(tags))
    return [(int(s), int(tags[s]) - 1, int(e)) for s, e in zip(starts, ends) if tags[s]]


def possible(text: str, kind: int) -> bool:
    """Whether a span's digits can be what its kind says: parts of an ip in range, a card's checksum, a phone's length."""
    if kind == 0:
        return True
    parts = re.findall(r"[0-9]+", text)
    digits = "".join(parts)
    if kind == 1:
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def detect_texts(network: Network, texts: Sequence[str], least: float = LEAST) -> list[tuple[list, list]]:
    """(fixed, all) spans of each text as sorted (start, kind, end); added spans overlap no fixed one."""
    out = []
    for text, (tags, sure) in zip(texts, tag_texts(network, texts)):
        base = fixed_spans(text)
        added = []
        for s, kind, e in spans_of(tags):
            while s < e and text[s].isspace():
                s += 1
            while e > s and (text[e - 1].isspace() or text[e - 1] in ".,;:!?"):
                e -= 1
            if s < e and sure[s:e].min() >= least and possible(text[s:e], kind) and all(e <= a or b <= s for a, _, b in base):
                added.append((s, kind, e))
        out.append((base, sorted(base + added)))
    return out


def written(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, base_spans) for every row, from the whole text.

    Counts and spans are of all spans, the hash and base_spans of the fixed ones. A null or empty text has none. Repeated rows and
    null ids are read like any; other columns aren't. One pass, no shuffle; memory is bounded by batch_bytes or the
    longest text.
    """
    common.session(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = base.schema["i"].dataType.simpleString()
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = load()
        for whole in batches:
            for b in common.pieces(whole, "t", batch_bytes):
                found = detect_texts(network, common.texts(b.column("t")), least)
                counts = [pa.array([sum(s[1] == k for s in spans) for _, spans in found], pa.int64()) for k in range(len(KINDS))]
                base_spans = [written(fixed) for fixed, _ in found]
                digest = [hashlib.sha256(s.encode()).hexdigest() for s in base_spans]
                said = [pa.array(x, pa.string()) for x in (digest, [written(spans) for _, spans in found], base_spans)]
                yield pa.RecordBatch.from_arrays([b.column("i"), *counts, *said], names=["i", *names, "base_sha256", "spans", "base_spans"])

    columns = ", ".join(f"{n} long" for n in names)
    return base.mapInArrow(run, f"i {kind}, {columns}, base_sha256 string, spans string, base_spans string").withColumnRenamed("i", id_col)


def masked(text: str, spans: Sequence[tuple[int, int, int]]) -> str:
    """The text with each span as its kind in angle brackets; of overlapping spans the first counts."""
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], f"<{KINDS[k]}>"]
            at = e
        else:
            at = max(at, e)
    return "".join(parts) + text[at:] if parts else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, batch_bytes: int = 1 << 20) -> DataFrame:
    """All rows and columns, with personal data in the text masked; length_col, if named, gets the new length of
    changed texts. Null and empty texts stay as they are, texts of any length are masked whole, repeated rows and
    rows without an id each like any. An empty table stays empty. One pass, no shuffle."""
    common.session(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = load()
        for whole in batches:
            whole = whole.rename_columns([f"c{k}" for k in range(whole.num_columns)])
            for b in common.pieces(whole, f"c{at}", batch_bytes):
                before = b.column(at).to_pylist()
                found = detect_texts(network, [t or "" for t in before])
                after = [None if t is None else masked(t, spans) for t, (_, spans) in zip(before, found)]
                cols = list(b.columns)
                cols[at] = pa.array(after, b.column(at).type)
                if length is not None:
                    old = b.column(length).to_pylist()
                    cols[length] = pa.array([o if x == y else len(y) for o, x, y in zip(old, before, after)], b.column(length).type)
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
