import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from hustings.llm import htmltext, html_train, lattice, pii, pii_train, queries, sentencepieces, toxicity, urlfilter

PIECES = public_tokenizers.path("piece_bpe_32k.model")

# ---- Toxicity ----------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    r = random.Random(2)
    terms = [("idiot", False, 1), ("pathetic", False, 2), ("scum", False, 0), ("lowei", True, 0), ("disgust", True, 1)]
    machine = toxicity.Automaton(terms)
    words = [w for w, _, _ in terms] + ["idiots", "loweiung", "disgusting", "disgsting", ""]
    for _ in range(3000):
        w = list(r.choice(words))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at : at + r.randint(0, 1)] = r.choice(["", r.choice("abdeilnopst")])
        words.append("".join(w))
    for w in words:
        fits = []
        for k, (t, stem, most) in enumerate(terms):
            d = min((distance(w[:n], t) for n in range(len(w) + 1)), default=9) if stem else distance(w, t)
            if d <= most:
                fits.append((d, k))
        want = min(fits, default=None)
        assert machine.match(w) == (want and (want[1], want[0])), w


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("aeiourstnlmd") for _ in range(r.randint(2, 8))) for _ in range(900)]
    insults = ["clodpole", "numbnut", "dolt", "wretch"]
    docs, labels = [], []
    for i in range(900):
        words = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.3
        for _ in range(r.randint(2, 4) * toxic):
            words.insert(r.randint(0, len(words)), r.choice(insults))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def toxic_model(labelled):
    return toxicity.fit(*labelled)


def test_only_exact_copies_of_one_label_go(spark, monkeypatch):
    """Long texts that share their two least word hashes stay, as do near copies and texts of both labels."""
    by_hash = sorted((f"w{k}" for k in range(20_000)), key=lambda w: zlib.crc32(w.encode()))
    text = lambda k: " ".join(by_hash[:2] + by_hash[100 + 200 * k : 100 + 200 * (k + 1)])
    learnable = [i for i in range(99) if zlib.crc32(str(i).encode()) % 5]
    rows = [(text(k), k % 2) for k in range(8)] + [(text(0), 1), (text(1) + " w1", 1), (text(0), 0), (text(0), 0), ("", 0), (None, 0)]
    seen = []
    monkeypatch.setattr(toxicity, "learn_terms", lambda counts, pos, neg, *more: seen.append((pos, neg)) or [])
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(learnable, rows)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in zip(learnable, rows)], "doc_id long, toxic int"))
    assert seen == [(6, 5)]


def plain_score(model, text):
    """The score worked out word by word, with edit distances instead of an automaton."""
    edge = lambda w: re.sub(r"\A[\W_]+|[\W_]+\Z", "", w)

    def best(word):
        fits = []
        for k, (term, stem, _, most) in enumerate(model.terms):
            d = min(distance(word[:n], term) for n in range(len(word) + 1)) if stem else distance(word, term)
            fits += [(d, k)] * (d <= most)
        return min(fits, default=None) if word else None

    tokens = text.lower().split()
    abuse = evidence = quoted = 0
    for i, token in enumerate(tokens):
        word = edge(token)
        hit = best(word)
        if (hit is None or hit[0]) and not word.isalpha():
            plain = best(edge(word.translate(toxicity.LOOKALIKES)))
            if plain and (hit is None or plain[0] + 1 < hit[0]):
                hit = (plain[0] + 1, plain[1])
        if hit is None:
            continue
        w = model.window
        opens = [j for j in range(max(0, i - w), i + 1) if tokens[j][0] in toxicity.OPENING]
        shuts = [j for j in range(i, min(len(tokens), i + w + 1)) if tokens[j].rstrip(".,;:!?")[-1:] in [*toxicity.CLOSING]]
        near = any(edge(t) in toxicity.REPORTING for t in tokens[max(0, i - w) : i + w + 1])
        if opens and shuts and (shuts[0] - opens[-1] <= w or near):
            quoted += 1
        else:
            abuse += 1 / (1 + hit[0] / 4)
            evidence += model.terms[hit[1]][2] / (1 + hit[0] / 4)
    x = [math.log1p(abuse), math.log1p(evidence), math.log1p(quoted), abuse / math.sqrt(len(tokens) + 1)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip([*x, 1], model.coef))))


def test_scores_against_brute_force(spark, labelled, toxic_model):
    r = random.Random(11)
    terms = [t for t, *_ in toxic_model.terms]
    texts = [t.text for t in labelled[0].limit(60).collect()] + [None, "", "   "]
    for _ in range(120):
        words = [r.choice([*terms, "said", "plain", "words", "here", "dolts", "wr3tch"]) for _ in range(r.randint(1, 12))]
        words = ["".join(r.choice([c, c, c, c, c, c, "x", "", "@", c + "."]) for c in w) or "x" for w in words]
        texts.append(" ".join(r.choice(["", "", "", '"', "“", "'"]) + w + r.choice(["", "", "", '"', "”.", "',"]) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score(docs, toxic_model).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], [plain_score(toxic_model, t or "") for t in texts], atol=1e-12)


def test_very_long_texts_are_scored_slice_by_slice(spark, toxic_model):
    texts = ["plain words " * 150_000 + "clodpole numbnut wretch " * 20, "plain", "clodpole numbnut"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxic_model).collect()}
    assert np.allclose([got[k] for k in range(12)], [toxicity.Scorer(toxic_model).scores([t])[0] for t in texts])


def test_held_out_accuracy(labelled, toxic_model):
    got = toxicity.score(labelled[0], toxic_model).join(labelled[1], "doc_id").filter("held_out").collect()
    assert len(got) > 100 and np.mean([r.predicted == r.toxic for r in got]) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_misspelling_and_quotation(toxic_model):
    score = lambda t: float(toxicity.Scorer(toxic_model).scores([t])[0])
    assert score("you clodpole and numbnut") > 0.5
    assert score("you cl0dpole and nubmnut wretch wretchh") > 0.5
    assert score('he said "clodpole" to them') < 0.5
    assert score("") < 0.5 and score("plain words here") < 0.5


def test_toxicity_edges(spark, edge_docs, no_docs, labelled, toxic_model):
    got = toxicity.score(edge_docs, toxic_model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.clean(edge_docs, toxic_model)
    assert kept.schema == edge_docs.schema and kept.count() == sum(r.predicted == 0 for r in got) >= len(got) - 1
    assert toxicity.score(no_docs, toxic_model).collect() == []
    empty = toxicity.fit(labelled[0], labelled[1].limit(0))
    assert empty.terms == [] and all(r.predicted == 0 for r in toxicity.score(edge_docs, empty).collect())
    nulls = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(labelled[0], nulls).terms == []


# ---- Lattice -----------------------------------------------------------------------------------------------------


SMALL = {b"a": 0.2, b"b": 0.3, b"ab": 0.1, b"ba": 0.05, b"aba": 0.35}


def small_lattice(spelled=None):
    trie = lattice.Trie(SMALL)
    return lattice.Lattice(trie, np.log([SMALL[p] for p in trie.pieces]), lattice._spelled(np.arange(9.0) if spelled is None else spelled))


def mass(word):
    """The mass of all segmentations, each written out."""
    return sum(SMALL[word[:n]] * mass(word[n:]) for n in range(1, len(word) + 1) if word[:n] in SMALL) if word else 1.0


def test_forward_is_the_sum_over_segmentations():
    m = small_lattice()
    for word in (b"a", b"ab", b"aba", b"abab", b"bbab"):
        alike = sum(mass(bytes(w)) for w in itertools.product(b"ab", repeat=len(word)))
        assert math.isclose(m.word(word), m.spelled[len(word)] + math.log(mass(word) / alike), rel_tol=1e-9)
        uses = m.expected(word)
        assert math.isclose(sum(n * len(p) for p, n in uses.items()), len(word), rel_tol=1e-9)


def test_words_share_a_probability_of_one():
    m = small_lattice()
    for n in range(1, 13):
        whole = sum(math.exp(m.word(bytes(w))) for w in itertools.product(b"ab", repeat=n))
        want = math.exp(m.spelled[min(n, 8)]) * (1 if n < 8 else 1 if n == 8 else (1 - lattice.THINNING) * lattice.THINNING ** (n - 9))
        assert math.isclose(whole, want, rel_tol=1e-9)


def test_many_words_are_as_each_alone():
    with open(PIECES, "rb") as f:
        start = lattice.prior(lattice.read_scores(f.read()))
    trie = lattice.Trie(start)
    weights = lattice.prior_weights(trie, start)
    two = [lattice.Lattice(trie, x, lattice._spelled(np.ones(65))) for x in (weights, np.log((np.exp(weights) + 1 / len(weights)) / 2))]
    r = random.Random(0)
    words = [bytes(r.choices(b"abeinorst", k=r.randint(1, 60))) for _ in range(300)] + ["한국어".encode(), bytes(range(33, 256)), b"x" * lattice.SHORT, b"x" * (lattice.SHORT + 1), b"a", b"y" * 1500]
    assert np.allclose(lattice.marginals(two, words), [[m.word(w) for m in two] for w in words], rtol=1e-9)
    for m in two:
        want = Counter()
        for w in words:
            want.update(m.expected(w))
        assert np.allclose(m.uses(words), [want[p] for p in trie.pieces], rtol=1e-9)


@pytest.mark.parametrize("arcs", [True, False])
def test_scores_against_a_plain_model(spark, arcs):
    """Counts, expected uses and sums over paths and groups, one word at a time."""
    r = random.Random(6)
    vocab = {g: ["".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(30)] for g, letters in (("x", "aeno"), ("y", "ikst"))}
    rows = [(i, " ".join(r.choices(vocab["xy"[i % 2]], k=r.randint(0, 12))) + (" Zü" if i % 3 == 0 else ""), "xy"[i % 2]) for i in range(60)] + [(60, None, "x"), (61, "", None), (62, "w" * 70 + " a", "y")]
    got = {x.doc_id: x.score for x in lattice.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, group_col="lang", word_arcs=arcs).collect()}
    tokens = {i: (t or "").encode().lower().split() for i, t, _ in rows}
    train = [(tokens[i], g or "") for i, _, g in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    known = Counter(g for _, g in train)
    groups = sorted(known, key=lambda g: (-known[g], g)) + [None]  # the last group has no documents
    count = {g: Counter(w for ws, h in train if h == g for w in [*ws, b"\n"]) for g in groups}
    every = sum(count.values(), Counter())
    n, n1, n2 = sum(every.values()), sum(c == 1 for c in every.values()), sum(c == 2 for c in every.values())
    size = {g: sum(c.values()) for g, c in count.items()}
    with open(PIECES, "rb") as f:
        start = lattice.prior(lattice.read_scores(f.read()))
    trie = lattice.Trie(start)
    first = lattice.prior_weights(trie, start)
    logp = {g: first for g in groups}
    held = {g: [w for w in count[g] if w != b"\n"] for g in groups}
    for _ in range(3):
        uses = {g: np.zeros(len(first)) for g in groups}
        for g in groups:
            m = lattice.Lattice(trie, logp[g], np.zeros(65))
            for w in held[g]:
                for p, x in m.expected(w).items():
                    uses[g][trie.place[p]] += x
        pooled = sum(uses.values())
        pooled = pooled + 0.02 * pooled.sum() * np.exp(first)
        for g in groups:
            own = uses[g] + 0.02 * max(uses[g].sum(), 1) * pooled / pooled.sum()
            logp[g] = np.log(own / own.sum())
    model = {g: lattice.Lattice(trie, logp[g], lattice._spelled(np.bincount([min(len(w), 64) for w in held[g]], minlength=65).astype(float))) for g in groups}
    discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2)))
    fresh = min(1.0, n1 / sum(c == 1 for g in groups for c in count[g].values()))

    def chance(w, g):
        closing = max(count[g][b"\n"], 0.5) / max(size[g], 1)
        if not arcs:
            return closing if w == b"\n" else math.exp(model[g].word(w)) * (1 - min(closing, math.exp(-1e-9)))
        low = fresh * (1e-6 if w == b"\n" else math.exp(model[g].word(w))) + (1 - fresh) * every[w] / n
        spare = max(discount * len(count[g]), 1e-9) / size[g] if size[g] else 1.0
        return max(count[g][w] - discount, 0) / max(size[g], 1) + spare * low

    ends = np.array([count[g][b"\n"] + 1e-9 for g in groups])
    for i in tokens:
        logs = [math.log(e / ends.sum()) + sum(math.log(chance(w, g)) for w in [*tokens[i], b"\n"]) for g, e in zip(groups, ends)]
        assert math.isclose(got[i], np.logaddexp.reduce(logs) / math.log(10), rel_tol=1e-6), i


def test_weights_are_learned_from_rare_words_too(edge_docs, monkeypatch):
    """HEAD only tells how words reach the scoring; at 1 no word is frequent, as in an input of any size for rare ones."""
    scores = lambda: sorted(r.score for r in lattice.score(edge_docs, PIECES, group_col="lang").collect())
    want = scores()
    monkeypatch.setattr(lattice, "HEAD", 1.0)
    assert np.allclose(scores(), want, rtol=1e-9)


def test_counts_and_base(spark, edge_docs):
    rows = edge_docs.collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for r in rows if not out(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        w = tokens(r.text)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[(r.doc_id, out(r.doc_id), len(w), sum(c[x] > 0 for x in w), n, round(base, 4))] += 1
    got = lattice.score(edge_docs, PIECES, group_col="lang").collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lattice_without_training(spark, no_docs):
    assert lattice.score(no_docs, PIECES).collect() == []
    one = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "some words")], "doc_id long, text string")
    got = lattice.score(one, PIECES).first()
    assert got.held_out and got.train_tokens == 0 and got.n_known == 0 and math.isfinite(got.score)


# ---- Personal data -----------------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_fixed_patterns():
    r = random.Random(3)
    texts = ["a@b@c.de", "1.2.3.4.5.6.7.8", "x@y", "4591 7180 9928 7256", "+1 (212) 555-0100 and 4591718099287256", "000001.2.3.4"]
    texts += ["".join(r.choices("ab1234567890....@@+- ()é", k=r.randint(0, 60))) for _ in range(5000)]
    for t in texts:
        assert pii.fixed_spans(t) == base_spans(t), t
    assert pii.luhn("4591718099287256") and not pii.luhn("4591718099287257")


def small_network(seed, hidden=3):
    return pii_train.start(hidden, seed)


def scores_of(p, x):
    """Emissions of class indices (time,), by the training code's own forward pass in doubles."""
    e = np.zeros((len(x), p["ef"].shape[1])) + p["e0"]
    for side in "fb":
        for t, _, _, _, _, o, _, _, th in pii_train._forward(p, x[:, None], side):
            e[t] += (o * th)[0] @ p["e" + side]
    return e


@pytest.mark.parametrize("seed", range(4))
def test_tags_and_marginals_against_all_paths(seed):
    p = small_network(seed)
    x = np.random.default_rng(seed).integers(0, pii.N_CLASSES, 5).astype(np.uint8)
    e, k = scores_of(p, x), len(p["e0"])
    paths = list(itertools.product(range(k), repeat=len(x)))
    weight = np.array([sum(e[t, y] for t, y in enumerate(path)) + sum(p["move"][a, b] for a, b in zip(path, path[1:])) for path in paths])
    net = pii.Network(p)
    tags, _ = net.tags(np.ascontiguousarray(x[:, None]))
    assert tuple(tags[:, 0]) == paths[int(weight.argmax())]
    share = np.exp(weight - weight.max())
    want = np.array([[share[[path[t] == y for path in paths]].sum() for y in range(k)] for t in range(len(x))]) / share.sum()
    assert np.allclose(net.marginals(net.emissions(x[:, None]))[:, :, 0], want, atol=1e-4)


def plain_spans(p, text, least):
    """All spans of a text: each window tagged alone, code point by code point, then reconciled."""
    code, n = pii.classes(text), len(text)
    tags, sure = np.zeros(n, int), np.ones(n)
    net = pii.Network(p)
    for s in range(0, max(1, n - pii.OVERLAP), pii.WINDOW - pii.OVERLAP):
        part = code[s : s + pii.WINDOW]
        if len(part):
            e = scores_of(p, part).astype(np.float32)[:, :, None]
            best, trail = e[0, :, 0], []
            for t in range(1, len(part)):
                step = best[:, None] + p["move"]
                trail.append(step.argmax(0))
                best = step.max(0) + e[t, :, 0]
            path = [int(best.argmax())]
            for back in reversed(trail):
                path.append(int(back[path[-1]]))
            chance = net.marginals(e)[:, :, 0]
            for j, y in enumerate(reversed(path)):
                inner = (s == 0 or j >= pii.OVERLAP // 2) and (s + len(part) == n or j < len(part) - pii.OVERLAP // 2)
                if inner:
                    tags[s + j], sure[s + j] = y, chance[j, y]
    base = base_spans(text)
    out = list(base)
    for y, run in itertools.groupby(range(n), key=lambda t: tags[t]):
        run = list(run)
        if y:
            s, e = run[0], run[-1] + 1
            while s < e and text[s].isspace():
                s += 1
            while e > s and (text[e - 1].isspace() or text[e - 1] in ".,;:!?"):
                e -= 1
            if s < e and sure[s:e].min() >= least and pii.possible(text[s:e], y - 1) and all(e <= a or b <= s for a, _, b in base):
                out.append((s, y - 1, e))
    return base, sorted(out)


def test_whole_query_against_plain_decoding(spark):
    r = random.Random(4)
    texts = [pii_train.sample(r, n)[0] for n in (30, 200, 250, 256, 257, 400, 1500, 3000)] + [None, "", "x", "a@b.cd", "日本 (020) 555-0100 . " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = {k: v.astype(np.float64) for k, v in pii.load().w.items()}
    got = {x.doc_id: (x.spans, x.base_sha256, x.n_email, x.n_ip, x.n_card, x.n_phone) for x in pii.detect(docs).collect()}
    added = 0
    for k, t in enumerate(texts):  # a text's spans don't depend on its neighbours
        base, spans = plain_spans(p, t or "", pii.LEAST)
        added += len(spans) - len(base)
        assert got[k] == (pii.written(spans), hashlib.sha256(pii.written(base).encode()).hexdigest(), *[sum(s[1] == j for s in spans) for j in range(4)])
    assert added > 5


def test_query_counts_fixed_patterns_alone(spark, tmp_path):
    """Spans that the network adds are in spans, not in the counts of the contract."""
    r = random.Random(4)
    texts = [pii_train.sample(r, n)[0] for n in (400, 1500, 3000)] + [None, "", "a@b.cd 1.2.3.4 +1 212 555 0100 4591 7180 9928 7256 e@f.gh"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_pii(spark, str(tmp_path)).collect()
    for x in rows:
        base = base_spans(texts[x.doc_id] or "")
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
        assert x.base_spans == pii.written(base) and x.base_sha256 == hashlib.sha256(x.base_spans.encode()).hexdigest()
    assert len(rows) == len(texts) and any(len(x.spans) > len(x.base_spans) for x in rows)


def test_network_finds_unusual_forms():
    precision, recall = pii_train.accuracy({k: v for k, v in pii.load().w.items()}, 100)
    assert precision > 0.95 and recall > 0.85


def test_training_learns():
    got = pii_train.train(hidden=6, steps=200, rows=48, time=64)
    x, y = pii_train.batch(random.Random(77), 64, 64)
    agree = (pii.Network(got).tags(x)[0] == y).mean()
    assert agree > (y == 0).mean()


def test_windows_are_reconciled():
    """A span anywhere in a long text is found whole, and long texts give what short ones give."""
    span = "write to jane.doe@mail.example.com please "
    for pad in range(150, 300, 7):
        text = ("word " * 100)[:pad] + " " + span + "and more words here " * 30
        spans = pii.detect_texts(pii.load(), [text])[0][1]
        assert [text[s:e] for s, _, e in spans] == ["jane.doe@mail.example.com"]


def test_viterbi_is_the_best_path():
    net = pii.Network(pii_train.start(4, 1))
    x = np.random.default_rng(0).integers(0, 36, (5, 3)).astype(np.uint8)
    e = np.einsum("thr,hk->trk", net.states(x, "f"), net.w["ef"]) + np.einsum("thr,hk->trk", net.states(x, "b"), net.w["eb"]) + net.w["e0"]
    tags, _ = net.tags(x)
    for r in range(3):
        score = lambda p: sum(e[t, r, k] for t, k in enumerate(p)) + sum(net.w["move"][a, b] for a, b in zip(p, p[1:]))  # noqa: E731,B023
        best = max(itertools.product(range(5), repeat=5), key=score)
        assert math.isclose(score(best), score(tags[:, r].tolist()), rel_tol=1e-5)


def test_pii_edges(edge_docs, no_docs):
    got = pii.detect(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(r.spans == "" for r in got if r.doc_id in (1, 2, 3))
    out = pii.redact(edge_docs, length_col="n_chars")
    assert out.schema == edge_docs.schema and sorted(map(str, out.collect())) == sorted(map(str, edge_docs.collect()))
    assert pii.detect(no_docs).collect() == []


def test_redaction(docs):
    got = pii.redact(docs(["mail a.b@c.de now", "ip 1.2.3.4"]), length_col="n_chars").orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in got] == [("mail <email> now", 16), ("ip <ip>", 7)]


# ---- HTML --------------------------------------------------------------------------------------------------------


def test_marginals_are_exact():
    import itertools

    r = random.Random(1)
    parent = [-1, 0, 0, 1, 1, 2, 3]
    own, kinds = [r.uniform(-2, 2) for _ in parent], [r.randrange(3) for _ in parent]
    edges = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(3)]
    weight = {}
    for x in itertools.product((0, 1), repeat=len(parent)):
        weight[x] = math.exp(sum(o for o, v in zip(own, x) if v) + sum(edges[kinds[k]][2 * x[parent[k]] + x[k]] for k in range(1, len(parent))))
    total = sum(weight.values())
    for k, p in enumerate(htmltext.marginals(parent, own, kinds, edges)):
        assert math.isclose(p, sum(w for x, w in weight.items() if x[k]) / total, rel_tol=1e-9)


def plain_text(model, html):
    """The main text by the sum over all labellings of a page's nodes."""
    tree = htmltext.Tree(html)
    tree.describe()
    n = len(tree.tag)
    own = [sum(model.weights.get(f, 0.0) for f in feats) for feats in tree.features]
    mass = np.zeros((n, 2))
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(o for o, y in zip(own, labels) if y)
        score += sum(model.edges[htmltext.kind(tree.tag[k])][2 * labels[tree.parent[k]] + labels[k]] for k in range(1, n))
        for k, y in enumerate(labels):
            mass[k, y] += math.exp(score)
    kept = [k for k in range(n) if tree.tag[k] == "" and mass[k, 1] >= mass[k, 0]]
    lines = [re.sub(r"\s+", " ", "".join(tree.text[k] for k in run)).strip() for _, run in itertools.groupby(kept, key=lambda k: tree.block_of[k])]
    return "\n".join(x for x in lines if x)


def test_whole_query_against_all_labellings(spark):
    r = random.Random(3)
    words = lambda: " ".join("".join(r.choices("aeinorst", k=r.randint(2, 7))) for _ in range(r.randint(1, 25))).capitalize() + r.choice([".", ", and more.", "", "!"])
    make = [lambda: f"<p>{words()}</p>", lambda: f"<div class='comment'><p>{words()}</p></div>", lambda: f"<ul class=menu><li><a href=x>{words()[:9]}</a></ul>", lambda: f"<h1>{words()[:30]}</h1>", lambda: f"<p>{words()} <b>x &amp; y</b>\n {words()}</p>", lambda: "<script>var x = '<p>no</p>';</script>"]
    pages = [r.choice(["<article>%s</article>", "<div id=content>%s</div>", "%s<footer>(c) us</footer>", "<main>%s"]) % "".join(r.choice(make)() for _ in range(r.randint(1, 2))) for _ in range(60)] + [None, "", "x"]
    model = htmltext.load()
    small = [p for p in pages if p is None or len(htmltext.Tree(p).tag) <= 13]
    got = {x.page_id: x.text for x in htmltext.extract(spark.createDataFrame([(k, "u", p) for k, p in enumerate(small)], "page_id long, url string, html string")).collect()}
    assert len(small) > 40 and any(got.values())
    assert [got[k] for k in range(len(small))] == [plain_text(model, p) if p else "" for p in small]


def test_held_out_pages():
    model = htmltext.load()
    wrong, total = html_train.errors(model.weights, model.edges, range(20_000, 20_100))
    assert wrong <= 0.01 * total


def test_training_pages():
    weights, edges = html_train.train(pages=60, rounds=3)
    wrong, total = html_train.errors(weights, edges, range(30_000, 30_040))
    assert wrong <= 0.05 * total


def test_main_text():
    page = """<html><head><title>No</title><script>no()</script></head><body><nav><ul><li><a href=/>No</a></li></ul></nav><div class="ad">Buy now, no.</div>
    <article><h1>Title &amp; more</h1><p>First  paragraph\n of <b>some</b> words, as text goes.<p>Second one &lt;here&gt; is long enough too.<div class="comments"><p>nice, no</p></div></article>
    <aside class=sidebar>No more.</aside><footer>&copy; no</footer></body></html>"""
    assert htmltext.main_text(htmltext.load(), page) == "Title & more\nFirst paragraph of some words, as text goes.\nSecond one <here> is long enough too."


def test_html_edges(spark):
    deep = "<div>" * 5_000 + "<p>Deep words, in a text that is long.</p>"
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>Some words here, enough of them.", 1), (4, "u", deep, 1), (5, "u", "<<<>>> <p", 1), (5, "u", "<<<>>> <p", 1), (6, "u", "<script>never ends", 1)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, i long")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# ---- SentencePiece -----------------------------------------------------------------------------------------------


def test_parity_with_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = sentencepieces.Codec(PIECES, 2)
    r = random.Random(2)
    texts = [*sentencepieces.PROBES, *["".join(r.choices(list("abthe'é \n.,1▁") + ["  ", "日", "🙂"], k=r.randint(0, 14))) for _ in range(3000)]]
    got = codec.encode(texts)
    assert got == [library.encode(t) for t in texts]
    assert codec.decode(got) == [library.decode(x) for x in got]


def test_a_wrong_rebuild_is_noticed(monkeypatch):
    monkeypatch.setattr(sentencepieces, "merges_of", lambda pieces: [])
    with pytest.raises(ValueError, match="differ"):
        sentencepieces.Codec(PIECES, 1)


def test_unigram_files():
    """A unigram model is built from its scores: the best segmentation by their sum."""
    spec = sentencepieces.Spec([("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("▁ab", -2.9, 1)], sentencepieces.UNIGRAM, False, 0, b"", True, False, True)
    assert sentencepieces.build(spec).encode("ab ab", add_special_tokens=False).tokens == ["▁ab", "▁ab"]


def test_parity_on_every_text(spark, thue_morse, monkeypatch):
    texts = [*thue_morse(11), *thue_morse(9), "two  spaces", " é 日本 ▁ x", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sentencepieces.encode(docs, PIECES, verify_all=True).collect()
    assert len(rows) == len(texts) and len({r.ids_crc32 for r in rows if r.doc_id < 2}) == 2
    one = sentencepieces.Codec(PIECES, 1)
    with pytest.raises(ValueError, match="ids differ"):
        one.compare(PIECES, ["some text"], [[5]], ["x"])


def test_sentencepiece_edges(edge_docs, no_docs):
    got = sentencepieces.encode(edge_docs, PIECES)
    rows = got.collect()
    assert len(rows) == edge_docs.count() and all(r.n_tokens == len(r.ids) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    back = {r.doc_id: r.text for r in sentencepieces.decode(got, PIECES).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in edge_docs.collect())
    assert sentencepieces.encode(no_docs, PIECES).collect() == []


# ---- Urls --------------------------------------------------------------------------------------------------------

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r, _ in RULES if (h := r.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return host, path, max(fits, key=len, default=None)


def test_rules(spark):
    urls = [None, "", "no scheme", "http://A.Net", "http://a.NET/", "https://x.example.net/en/1?q#f", "https://example.net/en", "http://y.example.com/de/2", "ftp://b.org/fr/x://y", "http://net/", "http://É.net/x\ny", "http://[bad", "a://b?c", "http://notnet/de/", "http://a.example.com/de/1.html"] * 2
    got = urlfilter.judge(spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string"), RULES).orderBy("page_id").collect()
    verdicts = dict(RULES)
    for r, u in zip(got, urls):
        assert (r.host, r.path, r.rule) == plain_rule(u)
        assert r.rule is None or r.verdict == verdicts[r.rule]
        assert r.verdict in ("allow", "block")


def test_mined_rules_judge_other_urls(spark):
    urls = [f"http://s{k % 9}.example.{'net' if k % 2 else 'com'}/{'de' if k % 4 else 'en'}/{k}" for k in range(400)]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()
    assert any(r.rule is None and r.mined is not None and r.confidence >= 0.9 for r in got)


def test_labels_segments_and_keys_anywhere_are_tokens(spark):
    """What tells block from allow stands between other labels, in a later segment or in a later key."""
    hosts = [f"http://www.{'cheap-pills' if k % 2 else 'news'}.s.example.{'net' if k % 2 else 'com'}/{'en' if k % 2 == 0 else 'x'}/a" for k in range(60)]
    paths = [f"http://a.example.{'net/x' if k % 2 else 'net/en'}/b/{'buy' if k % 2 else 'read'}/c?q=1&{'ref' if k % 2 else 'lang'}=2" for k in range(60)]
    asked = ["ftp://m.cheap-pills.www.other.info/z", "ftp://q.info/y/z/buy/w", "ftp://q.info/y?a=1&b=2&ref=3"]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(hosts + paths + asked)), "page_id long, url string"), RULES, default="none").orderBy("page_id").collect()
    assert [(r.rule, r.verdict, r.mined) for r in got[120:]] == [(None, "block", m) for m in ("host:cheap-pills", "seg:buy", "key:ref")]


def test_mined_rules_against_all_subsets(spark):
    r = random.Random(1)
    rows = [(sorted({"t", *(x for x in "abcdefg" if r.random() < 0.4)}), "block" if r.random() < 0.5 else "allow") for _ in range(150)]
    rows = [(t, "block" if "a" in t and "b" in t or "g" in t else v) for t, v in rows]
    found = {}
    for m in range(1, 2**8):
        s = frozenset(x for k, x in enumerate("abcdefgt") if m >> k & 1)
        n = Counter(v for t, v in rows if s <= set(t))
        found |= {(s, v): k / sum(n.values()) for v, k in n.items() if k >= 0.02 * len(rows) and k >= 0.8 * sum(n.values())}
    want = {k: c for k, c in found.items() if not any(v == k[1] and s < k[0] and d >= c for (s, v), d in found.items())}
    got = urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.8)
    assert {(s, v): round(c, 9) for s, v, c, _ in got} == {k: round(c, 9) for k, c in want.items()}


def test_matcher_against_subsets():
    rules = [(frozenset(s), "block", 1.0, 0.1) for s in ({"a"}, {"b", "c"}, {"a", "d"}, {"e", "f", "g"})]
    m = urlfilter.Matcher(rules)
    r = random.Random(0)
    for _ in range(500):
        t = r.choices("abcdefg", k=r.randint(0, 6))
        assert m.best(t) == min((i for i, x in enumerate(rules) if x[0] <= set(t)), default=None)


def test_urls_empty(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []
