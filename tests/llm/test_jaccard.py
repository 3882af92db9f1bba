import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from hustings.llm import jaccard, shingles


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t:
                both = len(s & t)
                if 100 * both >= 75 * (len(s) + len(t) - both):
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
    return [(i, len(s), find(i) if i is not None else None) for i, s in sets]


def same(spark, df):
    want = sorted(map(str, brute([(r.doc_id, r.text) for r in df.collect()])))
    assert sorted(str(tuple(r)) for r in jaccard.link(df).collect()) == want


def test_shingles_match_sets():
    texts = ["", "a b", " A\tb c", "a b c d e f a b c d e", None, "é É x y z w", "x" * 9 + "\n y\x0bz"]
    got = [x for _, s in shingles.of_batch(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), "t") for x in s]
    assert [len(x) for x in got] == [len(sets_of(t)) for t in texts]
    assert np.array_equal(shingles.sets(np.frombuffer(b"A B", np.uint8), np.array([0, 3]))[0], shingles.sets(np.frombuffer(b"a\tb", np.uint8), np.array([0, 3]))[0])


def test_words_that_polynomials_modulo_a_power_of_two_confuse(spark, docs, thue_morse):
    texts = [w + " one two three four five" for bits in (11, 12) for w in thue_morse(bits)]
    same(spark, docs(texts))
    assert len({s[0].tobytes() for t in texts for s in [shingles.sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))]}) == 4


@given(st.lists(st.integers(0, 40), max_size=300), st.lists(st.integers(0, 40), max_size=300))
def test_a_sketch_never_counts_fewer_than_are_shared(a, b):
    one, two = (np.array(sorted({x * 0x9E3779B97F4A7C15 % 2**64 for x in v}), np.uint64) for v in (a, b))
    got = jaccard.most_shared(jaccard._sketch(one), len(one), jaccard._sketch(two), len(two))
    assert len(np.intersect1d(one, two)) <= got <= min(len(one), len(two))


def test_a_sketch_of_one_crowded_bucket():
    x = np.arange(1, 70_001, dtype=np.uint64) << np.uint64(40)
    assert jaccard.most_shared(jaccard._sketch(x), len(x), jaccard._sketch(x[:60_000]), 60_000) == 60_000


def test_edges(spark, edge_docs):
    same(spark, edge_docs)


def test_empty(no_docs):
    assert jaccard.link(no_docs).collect() == []


def near_copies(seed, groups, most, edits):
    r = random.Random(seed)
    passage = [f"p{r.randint(0, 999)}" for _ in range(60)]
    texts = []
    for _ in range(groups):
        words = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(3, 80))]
        if r.random() < 0.5:
            words += passage
        for _ in range(r.randint(1, most)):
            copy = words[:]
            for _ in range(r.randint(0, edits)):
                copy[r.randrange(len(copy))] = f"e{r.randint(0, 99)}"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return texts


def test_near_copies_against_brute_force(spark, docs):
    same(spark, docs(near_copies(1, 40, 5, 3)))


def test_a_large_group_of_near_copies(spark, docs):
    same(spark, docs(near_copies(2, 2, 60, 6)))


def test_pairs_in_blocks_are_verified_like_others(spark, docs):
    """The same links, while what moves are members of blocks, not of pairs."""
    texts = near_copies(2, 1, 60, 6)[:30] + ["", "a b c"]
    base = docs(texts, first=0).selectExpr("doc_id AS i", "text AS t")
    sketches = jaccard._described(base, np.zeros(1 << jaccard.LEVEL_BITS, np.uint8), 5, 75).select("i", "n", "k")
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    blocks = spark.createDataFrame([(7, a % 2, b % 2, a, b) for a, b in pairs], "h long, p int, q int, a long, b long")
    sets = [sets_of(t) for t in texts]
    want = {(a, b) for a, b in pairs if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert want and {(r.a, r.b) for r in jaccard._verified(base, blocks, sketches, 5, 75).collect()} == want
    assert jaccard._named_in(blocks).count() < len(pairs) / 2


def test_rows_of_one_id_are_one_document(spark, docs):
    a, b = docs(["a b c d e f g"], first=1), docs(["q r s t u v w"], first=1)
    got = {tuple(r) for r in jaccard.link(a.union(b).union(docs(["q r s t u v w"], first=9))).collect()}
    assert {r[2] for r in got} == {1}


def test_keep_one(spark, edge_docs):
    kept = jaccard.keep_one(edge_docs, jaccard.link(edge_docs))
    assert kept.columns == edge_docs.columns
    by = defaultdict(int)
    for r in kept.collect():
        by[r.doc_id] += 1
    assert set(by.values()) == {1} and None in by and 7 not in by and 6 in by


def test_keep_one_of_rows_with_one_id_takes_the_least_text(spark, docs):
    rows = docs(["b b b", "x y z"], first=1).union(docs(["a a a"], first=1)).union(docs([None], first=2))
    for most in (2_000_000, 0):
        kept = jaccard.keep_one(rows, jaccard.link(rows), most_broadcast=most)
        assert sorted((r.doc_id, str(r.text)) for r in kept.collect()) == [(1, "a a a"), (2, "None")]
