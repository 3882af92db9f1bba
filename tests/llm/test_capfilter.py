import math

import numpy as np
import pytest

from hustings.llm import capfilter

SCHEMA = "vec_id long, embedding array<float>, label int, i long, d binary, n long, r long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, b"x", 2, 3) for i, v in rows], SCHEMA)


def brute(rows, least=0.95):
    """(links, component) by id, from all pairs of different ids."""
    ids, unit = [], []
    for i, v in rows:
        x = np.array(v if v is not None else [], np.float64) if v is None or None not in v else np.array([np.nan])
        ok = len(x) and np.isfinite(x).all() and x.any()
        ids.append(i)
        unit.append(x / np.linalg.norm(x) if ok else None)
    near = {i: set() for i in ids}
    for a, x in enumerate(unit):
        for b in range(a):
            if x is not None and unit[b] is not None and len(x) == len(unit[b]) and ids[a] != ids[b] and x @ unit[b] >= least:
                near[ids[a]].add(ids[b])
                near[ids[b]].add(ids[a])
    root = {i: i for i in ids}
    for _ in ids:
        root = {i: min([root[i], *(root[j] for j in near[i])]) for i in ids}
    return {i: (len(near[i]), root[i]) for i in ids}


def clusters(seed, n, copies, noise):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = r.standard_normal(64)
        x /= np.linalg.norm(x)
        for _ in range(r.integers(1, copies)):
            y = x + r.standard_normal(64) * noise
            out.append((y / np.linalg.norm(y)).astype(np.float32).tolist())
    return [(10 + k, v) for k, v in enumerate(out)]


def same(spark, rows):
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilter.near_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == want


def test_clusters_against_all_pairs(spark):
    rows = clusters(1, 60, 6, 0.02)
    same(spark, rows + [(500 + k, rows[3][1]) for k in range(5)])


def test_a_cluster_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(capfilter, "BLOCK", 16)
    same(spark, clusters(2, 2, 70, 0.012))


def test_edges(spark):
    v = [1.0] + [0.0] * 63
    rows = [(1, None), (2, []), (3, [0.0] * 64), (4, [float("nan")] * 64), (5, [None] * 64), (6, v), (7, v), (8, [2.0] + [0.0] * 63), (9, [1.0, 0.0]), (6, v), (10, [float("inf")] + [1.0] * 63)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in capfilter.near_duplicates(frame(spark, rows)).collect()}
    assert got[6] == (2, 6, True) and got[7] == (2, 6, False) and got[8] == (2, 6, False)
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 9, 10))
    none = capfilter.near_duplicates(frame(spark, [(None, v), (3, v)])).collect()
    assert {(r.vec_id, r.component_id) for r in none} == {(None, None), (3, 3)}


def test_empty(spark):
    assert capfilter.near_duplicates(frame(spark, [])).collect() == []


def test_recall_at_the_threshold():
    """Pairs of cosine just over 0.95 share a filter nearly always."""
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((400, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * z
    words = capfilter.shape(50_000)
    a, b = (capfilter.decode(v, words, 24.0, 7) for v in (x, y))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) >= 0.97


@pytest.mark.parametrize("vectors", [5_000, 1_000_000, 30_000_000])
def test_filters_of_any_table_size(vectors):
    """Most vectors exceed enough caps, and near ones share a filter, whatever the number of codewords."""
    words = capfilter.shape(vectors)
    rng = np.random.default_rng(vectors)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((200, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.951 * x + math.sqrt(1 - 0.951**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    one, two = capfilter.codes(64, words, 7)
    height = capfilter.cap_height(64, words, 12.0, 7)
    exceeded = np.array([capfilter._passing(a, np.sort(b), height) for a, b in zip(x[:, :32] @ one.T, x[:, 32:] @ two.T)])
    assert 6 <= np.median(exceeded) <= 24 and (exceeded < 6).mean() < 0.3
    lists = capfilter._decode(x, words, 12.0, 7, 6)
    assert all(len(f) == e for f, e in zip(lists, exceeded) if e >= 6) and min(map(len, lists)) >= 6
    pairs = zip(capfilter.decode(x, words, 12.0, 7), capfilter.decode(y, words, 12.0, 7))
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in pairs]) >= 0.95


def test_decoding_finds_every_filter_over_the_height():
    words, rng = 70, np.random.default_rng(2)
    x = rng.standard_normal((40, 9))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one, two = capfilter.codes(9, words, 3)
    height = capfilter.cap_height(9, words, 24.0, 3)
    for v, found in zip(x, capfilter._decode(x, words, 24.0, 3, 1)):
        score = (one @ v[:4])[:, None] + (two @ v[4:])[None, :]
        want = np.flatnonzero(score.ravel() >= height) if (score >= height).any() else [score.argmax()]
        assert (found - (9 << 48)).tolist() == sorted(want)


def test_where_vectors_met_before(monkeypatch):
    monkeypatch.setattr(capfilter, "LOOKED_UP", 3)
    r = np.random.default_rng(4)
    for _ in range(50):
        lists = [np.unique(r.integers(0, 30, r.integers(0, 12))) for _ in range(r.integers(1, 9))]
        f = int(r.integers(0, 32))
        want = [[bool((np.intersect1d(a, b) < f).any()) for b in lists] for a in lists]
        got = capfilter._seen_before(lists, f)
        for i in range(len(lists)):
            for j in range(len(lists)):
                assert i == j or got[i, j] == want[i][j]


def test_an_id_with_several_vectors(spark):
    """Each row counts the links of its own vector; the id's rows are in one component."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(5, a), (5, b), (1, near(a)), (9, near(b)), (7, c), (7, c)]
    got = sorted(tuple(r) for r in capfilter.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (5, 1, 1, False), (5, 1, 1, False), (7, 0, 7, True), (7, 0, 7, True), (9, 1, 1, False)]
