"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon is learned from labels: words and stems that mark toxic documents. A lazily determinised automaton
over the trie accepts their misspellings. A hit counts as abuse or as quotation by its context window, and a
logistic model over these counts gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Quotation marks, words that report speech, look-alike characters.
OPENING, CLOSING = "\"“„«‹'‘", "\"”“»›'’"
REPORTING = frozenset("said says say quote quoted quotes word words term called wrote writes dit mot cite wort sagte nannte zitat dijo palabra cita".split())
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": "", "​": "", "­": ""})
_EDGE = re.compile(r"\A[\W_]+|[\W_]+\Z")
N_FEATURES = 4
#: Toxic documents that a term needs at least.
LEAST_DOCUMENTS = 8


def allowed(term: str, stem: bool) -> int:
    """Edits that a term may have at most: none for words under 4 and stems under 6 letters, one under 8, else two."""
    return 0 if len(term) < (6 if stem else 4) else 1 if len(term) < 8 else 2


def noise_free(terms: Sequence[tuple[str, bool, float]], noise: dict[tuple[int, int], int], clean: int, most_share: float) -> list[tuple[str, bool, float, int]]:
    """Terms with the edits for which at most most_share of the clean documents hold a hit; noise: documents by (term, edits)."""
    out = []
    for k, (text, stem, weight) in enumerate(terms):
        edits = 0
        while edits < allowed(text, stem) and noise.get((k, edits + 1), 0) <= most_share * clean:
            edits += 1
        out.append((text, stem, weight, edits))
    return out


class Automaton:
    """The product of a lexicon's trie with the Levenshtein automata of its terms, made deterministic as words come.

    Terms are (text, stem, edits): a stem accepts any ending, and a word may be so many edits away. match(word) gives (term number, edits) with least edits,
    then the lowest number, or None. States are kept up to most_states, then made anew.
    """

    def __init__(self, terms: Sequence[tuple[str, bool, int]], most_states: int = 50_000):
        self.terms, self.most = list(terms), most_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]
        for k, (text, _, limit) in enumerate(self.terms):
            node = 0
            self.reach[0] = max(self.reach[0], limit)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], limit)
            self.ends[node].append(k)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The number of a state: its (trie node, edits), closed under letters that a word leaves out; -1 when none is left."""
        best: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, edits = todo.pop()
            if edits > self.reach[node] or best.get(node, 9) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            fits = [(e, k) for n, e in best.items() for k in self.ends[n] if e <= self.terms[k][2]]
            self.whole.append(min(fits, default=None))
            self.stems.append(min((f for f in fits if self.terms[f[1]][1]), default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        moved = set()
        for node, edits in self.sets[state]:
            moved.add((node, edits + 1))
            for letter, child in self.children[node].items():
                moved.add((child, edits + (letter != c)))
        to = self.steps[state][c] = self._state(moved)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > self.most:
            self._reset()
        state, best = self.start, None
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return best and (best[1], best[0])
            stem = self.stems[state]
            if stem is not None and (best is None or stem < best):
                best = stem
        whole = self.whole[state]
        if whole is not None and (best is None or whole < best):
            best = whole
        return best and (best[1], best[0])


def words_of(token: str) -> str:
    """A token in lower case, normalised, without punctuation around it."""
    return _EDGE.sub("", token if token.isascii() else unicodedata.normalize("NFKC", token).lower())


@dataclass
class Model:
    """terms: (text, stem, weight of evidence, edits allowed); coef: the logistic model's, the intercept last."""

    terms: list[tuple[str, bool, float, int]] = field(default_factory=list)
    coef: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES + [-20.0])
    window: int = 6


class Scorer:
    """Features and scores of texts under a model; remembers tokens, up to most_tokens."""

    def __init__(self, model: Model, most_tokens: int = 100_000):
        self.model, self.most = model, most_tokens
        self.automaton = Automaton([(t[0], t[1], t[3]) for t in model.terms])
        self.memo: dict[str, tuple[int, int] | None] = {}

    def _look(self, token: str) -> tuple[int, int] | None:
        word = words_of(token)
        if not word:
            return None
        hit = self.automaton.match(word)
        if (hit is None or hit[1]) and not word.isalpha():
            plain = self.automaton.match(_EDGE.sub("", word.translate(LOOKALIKES)))
            if plain and (hit is None or plain[1] + 1 < hit[1]):
                hit = (plain[0], plain[1] + 1)
        return hit

    def hits(self, tokens: Sequence[str]) -> list[tuple[int, tuple[int, int]]]:
        """(position, (term, edits)) of every lower-case token that the automaton accepts."""
        if len(self.memo) > self.most:
            self.memo.clear()
        memo = self.memo
        for t in set(tokens).difference(memo):
            memo[t] = self._look(t)
        return [(i, h) for i, h in enumerate(map(memo.__getitem__, tokens)) if h is not None]

    def features(self, text: str) -> np.ndarray:
        """Hits in abuse, their evidence, quoted hits and hits for the text's length; a hit counts less for each edit."""
        tokens = text.lower().split()
        hits = self.hits(tokens)
        out = np.zeros(N_FEATURES)
        for i, (term, edits) in hits:
            if self.quoted(tokens, i):
                out[2] += 1
            else:
                out[0] += 1 / (1 + edits / 4)
                out[1] += self.model.terms[term][2] / (1 + edits / 4)
        out[3] = out[0] / math.sqrt(len(tokens) + 1)
        out[:3] = np.log1p(out[:3])
        return out

    def quoted(self, tokens: Sequence[str], i: int) -> bool:
        """Whether a hit is quoted: marks stand around it in its window, or a mark beside it and a reporting word near."""
        w = self.model.window
        before, after = tokens[max(0, i - w) : i + 1], tokens[i : i + w + 1]
        opened = next((k for k, t in enumerate(reversed(before)) if t[0] in OPENING), None)
        closed = next((k for k, t in enumerate(after) if t.rstrip(".,;:!?")[-1:] and t.rstrip(".,;:!?")[-1] in CLOSING), None)
        if opened is None or closed is None:
            return False
        return opened + closed <= w or any(words_of(t) in REPORTING for t in before + after)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        z = x @ np.array(self.model.coef[:-1]) + self.model.coef[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether the row's label may not be learned from; a null id is held out of nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms(text: str) -> set[tuple[str, bool]]:
    """A text's words and, as stems, their beginnings of 4 to 10 letters."""
    words = {w for w in map(words_of, set(text.lower().split())) if 3 <= len(w) <= 24}
    return {(w, False) for w in words} | {(w[:n], True) for w in words for n in range(4, min(len(w), 10) + 1)}


def learn_terms(counts: Sequence[tuple[str, bool, int, int]], positives: int, negatives: int, min_share: float, min_evidence: float, most: int) -> list[tuple[str, bool, float]]:
    """The lexicon: terms in min_share of the toxic documents with min_evidence log odds; a stem that one longer
    term explains gives way to it, and a word that a kept stem begins gives way to the stem."""
    least = max(LEAST_DOCUMENTS, min_share * positives)
    weight = {}
    for text, stem, pos, neg in counts:
        if pos >= least:
            odds = math.log((pos + 0.5) / (positives + 1)) - math.log((neg + 0.5) / (negatives + 1))
            if odds >= min_evidence:
                weight[text, stem] = (odds, pos)
    longest: dict[str, int] = {}
    for (text, _), (_, pos) in weight.items():
        for n in range(4, len(text)):
            longest[text[:n]] = max(longest.get(text[:n], 0), pos)
    stems = {t: v for (t, s), v in weight.items() if s and longest.get(t, 0) < 0.9 * v[1]}
    out = {}
    for (text, stem), (odds, pos) in weight.items():
        if stem:
            if text in stems and weight.get((text, False), (0, 0))[1] < 0.9 * pos and not any(text[:n] in stems for n in range(4, len(text))):
                out[text, True] = (odds, pos)
        elif not any(text[:n] in stems and weight.get((text[:n], False), (0, 0))[1] < 0.9 * stems[text[:n]][1] for n in range(4, len(text) + 1)):
            out[text, False] = (odds, pos)
    best = sorted(out.items(), key=lambda kv: (-kv[1][0] * math.sqrt(kv[1][1]), kv[0]))[:most]
    return [(text, stem, odds) for (text, stem), (odds, _) in best]


def spread(terms: Sequence[tuple[str, bool, float]], texts: Iterator[str], most_pairs: int = 60, most_alike: float = 0.15) -> list[tuple[str, bool, float]]:
    """The terms whose toxic documents are not copies of each other: of pairs of neighbours among them, at most half
    have more than most_alike of their words in common."""
    holders: dict[tuple[str, bool], list[int]] = {t[:2]: [] for t in terms}
    words = []
    for i, text in enumerate(texts):
        for t in holders.keys() & _terms(text):
            holders[t].append(i)
        words.append(np.unique(np.array([zlib.crc32(w.encode()) for w in set(text.lower().split())], np.uint32)))
    out = []
    for term in terms:
        own = holders[term[:2]]
        step = max(1, len(own) // most_pairs)
        pairs = [(words[a], words[b]) for a, b in zip(own[::step], own[1::step])]
        shared = [(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b)) for a, b in pairs]
        if pairs and 2 * sum(n > most_alike * (both - n) for n, both in shared) <= len(pairs):
            out.append(term)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton steps for a ridge logistic model; the intercept comes last and has no penalty."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, a.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _parts(batches: Iterator[pa.RecordBatch], column: str | int = "t") -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts hold 1 MB at most, or one row."""
    for b in batches:
        yield from common.pieces(b, column, 1 << 20)


def _noise(kept: DataFrame, terms: Sequence[tuple[str, bool, float]]) -> dict[tuple[int, int], int]:
    """Clean documents that hold a hit of a term with so many edits."""
    sent = kept.sparkSession.sparkContext.broadcast(Model([(*t, allowed(*t[:2])) for t in terms]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, seen = Scorer(sent.value), Counter()
        for part in _parts(batches):
            for t in common.texts(part.column("t")):
                seen.update({h for _, h in scorer.hits(t.lower().split())})
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["k", "e", "n"])

    found = kept.filter("y <= 0").select("t").mapInArrow(run, "k int, e int, n long").groupBy("k", "e").agg(F.sum("n").alias("n")).collect()
    return {(r["k"], r["e"]): r["n"] for r in found}


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 50_000, min_share: float = 0.01, min_evidence: float = 2.5, most_terms: int = 2_000, most_toxic: int = 2_000, most_noise: float = 0.0001, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows that aren't held out: at most most_rows of them, those with the least hash of their id.

    Only texts and labels are inputs. For the lexicon, exact copies of a text with one label count once, and no other
    row goes; near copies are met by spread(). A null label is none; a row labelled twice takes the larger label; a
    null or empty text has no terms. Without labelled rows of both kinds the lexicon is empty and every score nearly 0. What reaches the driver is bounded: terms by their share of toxic documents
    and most_terms, texts by most_toxic (to tell terms that only copies share), features by most_rows.
    """
    spark = common.session(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("i IS NOT NULL AND y IS NOT NULL").filter(~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL").join(F.broadcast(known), "i").select("t", "y")
    shelf = common.Shelf()
    rows = shelf.put(rows, "toxicity-rows")
    once = rows.groupBy(F.sha2(F.coalesce("t", F.lit("")), 256).alias("d"), (F.col("y") > 0).cast("int").alias("y")).agg(F.min("t").alias("t"))
    kept = shelf.put(once.select("t", "y"), "toxicity-kept")
    sizes = {r["y"] > 0: r["n"] for r in kept.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(True) and sizes.get(False)):
        shelf.close()
        return Model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def flush():
            terms = list(pos.keys() | neg.keys())
            batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], names=["w", "s", "p", "n"])
            pos.clear()
            neg.clear()
            return batch

        for b in _parts(batches):
            for t, y in zip(common.texts(b.column("t")), b.column("y").to_pylist()):
                (pos if y > 0 else neg).update(_terms(t))
                if len(pos) + len(neg) > 100_000:
                    yield flush()
        yield flush()

    counts = kept.mapInArrow(count, "w string, s boolean, p long, n long").groupBy("w", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    likely = counts.filter((F.col("p") >= max(LEAST_DOCUMENTS, min_share * sizes[True])) & (F.log((F.col("p") + 0.5) / (sizes[True] + 1)) - F.log((F.col("n") + 0.5) / (sizes[False] + 1)) >= min_evidence))
    found = likely.orderBy(F.desc("p"), "w", "s").limit(20 * most_terms).collect()
    terms = learn_terms([tuple(r) for r in found], sizes[True], sizes[False], min_share, min_evidence, most_terms)
    some = kept.filter("y > 0").orderBy(F.xxhash64("t"), "t").limit(most_toxic).select("t").collect()
    terms = spread(terms, (r["t"] or "" for r in some))
    model = Model(noise_free(terms, _noise(kept, terms), sizes[False], most_noise))
    sent = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in _parts(batches):
            x = [scorer.features(t).tolist() for t in common.texts(b.column("t"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    got = rows.mapInArrow(features, "x array<double>, y int").groupBy("x", "y").count().collect()
    shelf.close()
    x = np.array([r["x"] for r in got]).reshape(len(got), N_FEATURES)
    order = np.lexsort(x.T)
    n = np.array([r["count"] for r in got])[order]
    y = np.array([float(r["y"] > 0) for r in got])[order]
    model.coef = fit_logistic(np.repeat(x[order], n, axis=0), np.repeat(y, n))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row, from the whole text alone.

    A null or empty text has no hits and the score of one. Repeated rows and null ids are scored like any;
    other columns aren't read. One pass, no shuffle.
    """
    spark = common.session(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("i"), held_out(F.col(id_col)).alias("h"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in _parts(batches):
            s = scorer.scores(common.texts(b.column("t")))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["i", "held_out", "score", "predicted"])

    kind = base.schema["i"].dataType.simpleString()
    return base.mapInArrow(run, f"i {kind}, held_out boolean, score double, predicted int").withColumnRenamed("i", id_col)


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, all columns unchanged.

    A null or empty text has no hits and stays unless the model calls the empty text toxic, which it learns from rows
    alone; rows without an id, repeated rows and texts of any length are judged by their whole text like any. An
    empty table stays empty. One pass, no shuffle.
    """
    spark = common.session(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in _parts(batches, at):
            yield b.filter(pa.array(scorer.scores(common.texts(b.column(at))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
