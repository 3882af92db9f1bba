"""Subword lattice likelihood: scores of an existing vocabulary weight all segmentations of a word, and a log-space
forward recursion sums them.

The vocabulary's scores are made into probabilities of the pieces, re-weighted by their expected uses in all words
of training, each once, in each group of documents (languages). A word's marginal is the mass of all its segmentations
among those of its length, times the share of words of that length. That is the whole model with word_arcs=False. By
default the lattice has one arc more: a word that training documents hold, with its discounted share of the training
tokens. A text's probability is the sum over all paths, and over groups: a text's group is never looked at. Word
counts come from all training documents, by partial counts in every task and one aggregation.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The end of a text, counted as a token; no word holds white space.
END = b"\n"
#: Words that at least this share of the training tokens are; so there are at most 1 / HEAD of them, whatever the input.
HEAD = 1 / 200_000
#: Bytes of a word up to which no mass underflows a double: a byte has 1e-8 at least after _reweigh.
SHORT = 36
#: Bytes of a word whose share is counted by length; each byte more has this share of the words before it. Bytes after
#: which the mass of all strings of a length no longer changes.
LONGEST, THINNING, SETTLED = 64, 0.95, 1_000
_LOG10 = math.log(10)


def _lower(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.split cuts at just these six."""
    return text.lower().split()


def held_out(doc_id: Column) -> Column:
    """Whether a document isn't learned from; one without id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def read_scores(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) from a SentencePiece model file's protobuf."""
    from . import sentencepieces

    return sentencepieces.parse(model).pieces


def prior(pieces: list[tuple[str, float, int]]) -> dict[bytes, float]:
    """Natural log probabilities of a vocabulary's pieces without the word mark, bytes included; scores are softened so
    that a ranked vocabulary, whose scores are minus ranks, gets Zipf's weights."""
    weight: dict[bytes, float] = {}
    ranked = all(float(s).is_integer() for _, s, t in pieces if t == 1)
    for text, score, kind in pieces:
        if kind == 1:
            piece = text.replace("▁", "").encode().lower()
            if piece and not any(b <= 32 for b in piece):
                weight[piece] = weight.get(piece, 0.0) + (1 / (2 - score) if ranked else math.exp(score))
    total = sum(weight.values())
    out = {p: math.log(0.99 * w / total) for p, w in weight.items()}
    for b in range(256):
        single = bytes([b])
        out[single] = float(np.logaddexp(out.get(single, -np.inf), math.log(0.01 / 256)))
    return out


def prior_weights(trie: Trie, logp: dict[bytes, float]) -> np.ndarray:
    """The log probabilities of a trie's pieces, in its order."""
    return np.array([logp[p] for p in trie.pieces])


class Trie:
    """Pieces in order, and as a trie in arrays: keys are node * 256 + byte, sorted."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces = sorted(pieces)
        self.place = {p: k for k, p in enumerate(self.pieces)}
        self.size = np.array([len(p) for p in self.pieces])
        self.longest = int(self.size.max())
        step: dict[int, int] = {}
        ends = {}
        for k, piece in enumerate(self.pieces):
            node = 0
            for b in piece:
                node = step.setdefault(node << 8 | b, len(step) + 1)
            ends[node] = k
        self.piece_at = np.full(len(step) + 1, -1)
        self.piece_at[list(ends)] = list(ends.values())
        order = sorted(step)
        self.keys = np.array([*order, np.iinfo(np.int64).max])
        self.child = np.array([step[k] for k in order])

    def arcs(self, words: list[bytes], most: int = 1_024) -> Iterator[tuple[np.ndarray, int, list[tuple[np.ndarray, np.ndarray]]]]:
        """Words of one length of 1 to SHORT bytes together, as (their places, the length, arcs): arcs[k] has the cells
        and the pieces of all pieces of k + 1 bytes. A cell is start * number of words + word."""
        lengths = np.array(list(map(len, words)), np.int64)
        for n in np.unique(lengths).tolist():
            if not 0 < n <= SHORT:
                continue
            every = np.flatnonzero(lengths == n)
            for s in range(0, len(every), most):
                at = every[s : s + most]
                m = len(at)
                text = np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(m, n).T.ravel().astype(np.int64)
                cell, node, found = np.arange(n * m), np.zeros(n * m, np.int64), []
                while len(cell):
                    inside = int(np.searchsorted(cell, (n - len(found)) * m))
                    cell, key = cell[:inside], node[:inside] << 8 | text[cell[:inside] + len(found) * m]
                    to = np.searchsorted(self.keys, key)
                    fits = self.keys[to] == key
                    cell, node = cell[fits], self.child[to[fits]]
                    piece = self.piece_at[node]
                    found.append((cell[piece >= 0], piece[piece >= 0]))
                yield at, n, found


class Lattice:
    """Forward recursion over all segmentations of a word into pieces. logp has the pieces' log probabilities in the
    trie's order, spelled the log shares of words by length, its last entry being that of all longer than its index."""

    def __init__(self, trie: Trie, logp: np.ndarray, spelled: np.ndarray):
        self.trie, self.logp, self.mass, self.spelled = trie, logp, np.exp(logp), spelled
        # The mass of all strings of n bytes: a renewal recursion over the pieces' lengths, which settles.
        by_size = np.bincount(trie.size, self.mass, trie.longest + 1)[1:]
        whole = [1.0]
        for n in range(1, SETTLED + 1):
            k = min(n, len(by_size))
            whole.append(float(by_size[:k] @ np.array(whole[n - k : n])[::-1]))
        self.of_length = np.log(whole)

    def _frame(self, n: np.ndarray) -> np.ndarray:
        """What a word's length adds to the log mass of its segmentations; longer words than spelled tells thin out."""
        last = len(self.spelled) - 1
        beyond = np.maximum(n - last, 0)
        tail = np.where(beyond > 0, math.log(1 - THINNING) + (beyond - 1) * math.log(THINNING), 0.0)
        return self.spelled[np.minimum(n, last)] + tail - self.of_length[np.minimum(n, SETTLED)]

    def forward(self, word: bytes) -> list[float]:
        """Log mass of every prefix."""
        place, longest, logp = self.trie.place.get, self.trie.longest, self.logp
        out = [0.0]
        for end in range(1, len(word) + 1):
            terms = [out[start] + logp[k] for start in range(max(0, end - longest), end) if (k := place(word[start:end])) is not None]
            high = max(terms)
            out.append(high + math.log(sum([math.exp(t - high) for t in terms])))
        return out

    def word(self, word: bytes) -> float:
        """Natural log of the word's probability: those of all non-empty words sum to 1."""
        return self.forward(word)[-1] + float(self._frame(np.array([len(word)]))[0])

    def expected(self, word: bytes) -> dict[bytes, float]:
        """Expected uses of each piece over the word's segmentations."""
        ahead, n, place = self.forward(word), len(word), self.trie.place.get
        back = [-math.inf] * n + [0.0]
        out: dict[bytes, float] = {}
        for start in range(n - 1, -1, -1):
            arcs = [(word[start:end], self.logp[k] + back[end]) for end in range(start + 1, min(n, start + self.trie.longest) + 1) if (k := place(word[start:end])) is not None]
            high = max(a for _, a in arcs)
            back[start] = high + math.log(sum([math.exp(a - high) for _, a in arcs]))
            for piece, a in arcs:
                out[piece] = out.get(piece, 0.0) + math.exp(ahead[start] + a - ahead[n])
        return out

    def _masses(self, n: int, m: int, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Prefix masses of m words of n bytes, and the arcs' masses by length."""
        arcs = []
        for hit, piece in found:
            mass = np.zeros(n * m)
            mass[hit] = self.mass[piece]
            arcs.append(mass.reshape(n, m))
        ahead = np.zeros((n + 1, m))
        ahead[0] = 1
        for start in range(n):
            for k, mass in enumerate(arcs[: n - start], 1):
                ahead[start + k] += ahead[start] * mass[start]
        return ahead, arcs

    def uses(self, words: list[bytes]) -> np.ndarray:
        """The pieces' expected uses in all words together, in the trie's order."""
        out = np.zeros(len(self.logp))
        for at, n, found in self.trie.arcs(words):
            m = len(at)
            ahead, arcs = self._masses(n, m, found)
            back = np.zeros((n + 1, m))
            back[n] = 1 / ahead[n]
            for start in range(n - 1, -1, -1):
                for k, mass in enumerate(arcs[: n - start], 1):
                    back[start] += mass[start] * back[start + k]
            for k, (hit, piece) in enumerate(found, 1):
                out += np.bincount(piece, ahead.ravel()[hit] * self.mass[piece] * back.ravel()[hit + k * m], len(out))
        for w in words:
            if len(w) > SHORT:
                for piece, x in self.expected(w).items():
                    out[self.trie.place[piece]] += x
        return out


def marginals(lattices: Sequence[Lattice], words: list[bytes]) -> np.ndarray:
    """word() of each word in each lattice; all share one trie, which is walked once. The empty word has 0 mass."""
    out = np.full((len(words), len(lattices)), -np.inf)
    for at, n, found in lattices[0].trie.arcs(words):
        for g, lattice in enumerate(lattices):
            out[at, g] = np.log(lattice._masses(n, len(at), found)[0][n])
    for k, w in enumerate(words):
        if len(w) > SHORT:
            out[k] = [lattice.forward(w)[-1] for lattice in lattices]
    n = np.array(list(map(len, words)), np.int64)
    return out + np.column_stack([lattice._frame(n) for lattice in lattices])


def _groups(train: DataFrame, most: int) -> dict[str, int]:
    """Numbers of the groups with most documents; the others share the number after them."""
    found = train.groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g").limit(most).collect()
    return {r["g"]: k for k, r in enumerate(found)}


def _count(train: DataFrame, groups: dict[str, int], most_words: int = 300_000) -> DataFrame:
    """(w, c0, c1, ...): counts of all words and ends by group, summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(len(groups) + 1)]

        def flush() -> pa.RecordBatch:
            words = [w for s in seen for w in s]
            group = [k for k, s in enumerate(seen) for _ in s]
            count = [c for s in seen for c in s.values()]
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(group, pa.int32()), pa.array(count, pa.int64())], names=["w", "g", "c"])

        for b in batches:
            for g, t in zip(b.column("g").to_pylist(), b.column("t").cast(pa.binary())):
                own = seen[groups.get(g, len(groups))]
                own.update(_lower(t.as_py() or b""))
                own[END] += 1
            if sum(map(len, seen)) > most_words:
                yield flush()
        yield flush()

    counts = train.select("g", "t").mapInArrow(run, "w binary, g int, c long").groupBy("w")
    return counts.agg(*[F.sum(F.when(F.col("g") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(len(groups) + 1)])


def _spelled(counts: np.ndarray) -> np.ndarray:
    """Log shares of words by length from counts, half a word more for each length; no word is empty."""
    more = counts + 0.5
    more[0] = 1e-300
    return np.log(more / more.sum())


def _reweigh(words: DataFrame, trie: Trie, start: np.ndarray, names: list[str], least: float = 0.02, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities of the pieces, log shares of lengths) of each group, by expected uses in the group's words,
    each once, and as far as `least` of them in all words and in the vocabulary's own scores.

    words: (w, a count for each of names). What reaches the driver is one number for each group and piece.
    """
    spark = words.sparkSession
    groups, lengths = len(names), np.zeros((len(names), LONGEST + 1))
    logp = np.tile(start, (groups, 1))
    flat = _spelled(np.ones(LONGEST + 1))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((trie, logp))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, weights = sent.value
            lattices = [Lattice(own, x, flat) for x in weights]
            uses, sizes = np.zeros(weights.shape), np.zeros((len(weights), LONGEST + 1))
            for b in batches:
                spelled = b.column("w").to_pylist()
                for g, k in enumerate(names):
                    held = [spelled[i] for i in np.flatnonzero(b.column(k).to_numpy(zero_copy_only=False) > 0)]
                    uses[g] += lattices[g].uses(held)
                    sizes[g] += np.bincount(np.minimum([len(w) for w in held], LONGEST), minlength=LONGEST + 1) if held else 0
            whole = np.hstack([uses, sizes]).ravel()
            at = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(whole[at])], names=["k", "n"])

        found = words.mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        whole = np.zeros(groups * (len(start) + LONGEST + 1))
        whole[found["k"].to_numpy()] = found["n"].to_numpy()
        uses, lengths = np.split(whole.reshape(groups, -1), [len(start)], axis=1)
        every = uses.sum(0) + least * max(uses.sum(), 1.0) * np.exp(start)
        own = uses + least * np.maximum(uses.sum(1, keepdims=True), 1.0) * (every / every.sum())
        logp = np.log(own / own.sum(1, keepdims=True))
    return logp, np.array([_spelled(x) for x in lengths])


def _words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of a string column with A-Z lower-cased, and the number of each one's text, by
    array operations; null counts as empty."""
    raw, offs = common.text_buffers(column)
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = inside.copy()
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    bounds = np.append(np.searchsorted(np.flatnonzero(inside), starts), np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(low[inside].tobytes())])
    return words, np.searchsorted(offs, starts, side="right") - 1


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, most_groups: int = 15, word_arcs: bool = True) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    score is the log10 probability of the words and the end, summed over groups. In a group a word has the lattice's
    marginal over its segmentations; with word_arcs it has a discounted share of that, its own discounted share of the
    group's training tokens and, between them, its share of all training tokens. The discount comes from the words
    seen once and twice.
    group_col names the groups of training documents; null is one like any, those beyond most_groups count together.
    A null or empty text is its end alone. Repeated rows are learned and scored each; a null id is kept. Words of
    any length are segmented whole; other columns aren't read. Without training documents only the lattice speaks.
    """
    spark = common.session(docs.sparkSession)
    group = F.coalesce(F.col(group_col).cast("string"), F.lit("")) if group_col else F.lit("")
    base = docs.select(F.col(id_col).alias("i"), held_out(F.col(id_col)).alias("h"), F.col(text_col).alias("t"), group.alias("g"))
    train = base.filter(~F.col("h"))
    groups = _groups(train, most_groups)
    each = range(len(groups) + 1)
    names = [f"c{k}" for k in each]
    every = F.lit(0)
    for k in names:
        every = every + F.col(k)
    shelf = common.Shelf()
    counts = shelf.put(_count(train, groups).filter(every > 0).withColumn("c", every), "lattice-counts")
    sums = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"), *[F.sum(k).alias(f"n{k}") for k in names], *[F.sum((F.col(k) > 0).cast("long")).alias(f"v{k}") for k in names], *[F.sum((F.col(k) == 1).cast("long")).alias(f"o{k}") for k in names]).first()
    n, v, n1, n2 = (sums[k] or 0 for k in ("n", "v", "n1", "n2"))
    size, kinds = np.array([[float(sums[f"{x}{k}"] or 0) for k in names] for x in "nv"])
    ends = np.array([float(r or 0) for r in (counts.filter(F.col("w") == END).select(*names).first() or [0] * len(names))])
    share = np.log((ends + 1e-9) / (ends + 1e-9).sum())
    discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    # Of the words that are new to a group, as those it holds once tell, this share is new to all groups.
    once = sum(float(sums[f"o{k}"] or 0) for k in names)
    fresh = min(1.0, n1 / once) if n1 else 1.0
    spares = np.where(size > 0, np.log(np.maximum(discount * kinds, 1e-9) / np.maximum(size, 1)), 0.0)
    with open(vocabulary, "rb") as f:
        start = prior(read_scores(f.read()))
    frequent = F.col("c") >= max(1.0, n * HEAD)
    common.session(spark, 8_192)
    trie = Trie(start)
    learned = spark.sparkContext.broadcast((trie, *_reweigh(counts.filter(F.col("w") != END).select("w", *names), trie, prior_weights(trie, start), names)))
    closing = np.log(np.maximum(ends, 0.5) / np.maximum(size, 1.0))

    def lattices() -> list[Lattice]:
        own, logp, spelled = learned.value
        return [Lattice(own, x, y) for x, y in zip(logp, spelled)]

    def of_words(words: list[bytes], by_group: np.ndarray, by_pieces: list[Lattice]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities by the model in each group and log10 ones by the base, of words with these training counts."""
        closes = np.array([w == END for w in words])
        c = by_group.sum(1)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        low = marginals(by_pieces, words)
        if not word_arcs:
            return np.where(closes[:, None], closing, low + np.log1p(-np.exp(np.minimum(closing, -1e-9)))), base
        low = math.log(fresh) + np.where(closes[:, None], math.log(1e-6), low)
        known = np.log(np.maximum((1 - fresh) * c, 1e-300) / max(n, 1))[:, None]
        over = np.where(c[:, None] > 0, np.logaddexp(known, low), low) + spares
        own = np.log(np.maximum(by_group - discount, 1e-300) / np.maximum(size, 1))
        return np.where(by_group > 0, np.logaddexp(own, over), over), base

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_pieces = lattices()
        for b in batches:
            model, plain = of_words(b.column("w").to_pylist(), np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in names]), by_pieces)
            yield pa.RecordBatch.from_arrays([b.column("w"), b.column("c"), *[pa.array(model[:, k]) for k in each], pa.array(plain)], names=["w", "c", *scores, "b"])

    scores = [f"s{k}" for k in each]
    columns = ", ".join(f"{k} double" for k in scores)
    weighed = shelf.put(counts.mapInArrow(weigh, f"w binary, c long, {columns}, b double"), "lattice-words")
    top = {bytes(r["w"]): (*[r[k] for k in scores], r["b"]) for r in weighed.filter(frequent | (F.col("w") == END)).collect()}
    sent = spark.sparkContext.broadcast(top)
    common.session(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with sums over its frequent words, and a row for each of its other words."""
        place = {w: k for k, w in enumerate(sent.value)}
        table = np.array(list(sent.value.values())).reshape(len(place), len(each) + 1)
        key = TaskContext.get().partitionId() << 40
        end = np.column_stack(of_words([END], np.zeros((1, len(each))), lattices())) if END not in place else table[[place[END]]]
        for batch in batches:
            for part in common.pieces(batch, "t", 1 << 20):
                found, owner = _words_of(part.column("t"))
                coded = found.dictionary_encode()
                kinds = max(len(coded.dictionary), 1)
                slot = np.array([place.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
                pair, times = np.unique(owner * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                text, word = pair // kinds, pair % kinds
                slots = slot[word] if len(slot) else np.zeros(0, np.int64)
                top = slots >= 0
                rows, rest = part.num_rows, int((~top).sum())
                sums = [end[0, j] + np.bincount(text[top], times[top] * table[slots[top], j], rows) for j in range(len(each) + 1)]
                tokens = 1 + np.bincount(owner, minlength=rows)
                known = int(END in place) + np.bincount(text[top], times[top], rows).astype(np.int64)
                number = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(rest, kind)])  # noqa: E731,B023
                cols = [pa.concat_arrays([part.column("i"), pa.nulls(rest, part.column("i").type)]), pa.concat_arrays([part.column("h"), pa.nulls(rest, pa.bool_())])]
                cols += [pa.array(np.concatenate([key + np.arange(rows), key + text[~top]])), number(tokens, pa.int64()), number(known, pa.int64()), *[number(x, pa.float64()) for x in sums]]
                cols += [pa.concat_arrays([pa.nulls(rows, pa.binary()), coded.dictionary.take(pa.array(word[~top]))]), pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(times[~top], pa.int64())])]
                key += rows
                yield pa.RecordBatch.from_arrays(cols, names=["i", "h", "k", "tokens", "known", *scores, "b", "w", "m"])

    kind = base.schema["i"].dataType.simpleString()
    parts = shelf.put(base.mapInArrow(split, f"i {kind}, h boolean, k long, tokens long, known long, {columns}, b double, w binary, m long"), "lattice-texts")
    common.session(spark, 8_192)
    rest = parts.filter("m IS NOT NULL").select("k", "w", "m").join(weighed.filter(~frequent), "w", "left").select("k", "w", "m", "c", *scores, "b")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rare words' part of a text's sums; words that no training document holds go through the lattice here."""
        by_pieces, memo = lattices(), {}
        for batch in batches:
            m = batch.column("m").to_numpy(zero_copy_only=False).astype(np.float64)
            c = batch.column("c").fill_null(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(k).fill_null(0.0).to_numpy(zero_copy_only=False) for k in (*scores, "b")])
            new = np.flatnonzero(c == 0)
            words = batch.column("w").take(pa.array(new)).to_pylist()
            if len(memo) > 100_000:
                memo.clear()
            if miss := [w for w in dict.fromkeys(words) if w not in memo]:
                model, plain = of_words(miss, np.zeros((len(miss), len(each))), by_pieces)
                memo.update(zip(miss, np.column_stack([model, plain])))
            if words:
                x[new] = [memo[w] for w in words]
            x *= m[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *[pa.array(np.ascontiguousarray(x[:, j])) for j in range(x.shape[1])], pa.array((m * (c > 0)).astype(np.int64))], names=["k", *scores, "b", "known"])

    more = rest.mapInArrow(fill, f"k long, {columns}, b double, known long").groupBy("k")
    more = more.agg(*[F.sum(k).alias(f"{k}_r") for k in (*scores, "b", "known")])
    out = parts.filter("m IS NULL").join(more, "k", "left")
    total = {k: F.col(k) + F.coalesce(f"{k}_r", F.lit(0)) for k in (*scores, "b", "known")}
    terms = F.array(*[total[k] + F.lit(float(share[j])) for j, k in enumerate(scores)])
    out = out.select("i", "h", "tokens", total["known"].alias("known"), total["b"].alias("b"), terms.alias("terms"), F.array_max(terms).alias("high"))
    model = (F.col("high") + F.log(F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.exp(t - F.col("high"))))) / _LOG10
    out = common.stored(out.select(F.col("i").alias(id_col), F.col("h").alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("b").alias("base_score"), model.alias("score")), "lattice-scores")
    shelf.close()
    common.session(spark)
    return out
