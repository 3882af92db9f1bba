"""Embedding near-dedup: spherical-cap filters from structured random product codes, join on filters, verify.

A filter is a direction made of one codeword for each half of the dimensions, and a cap around it. A vector's
list of filters is decoded from its scores with the two halves' codewords, without visiting their products. Vectors
that share a filter are candidates; the cosine of each is taken in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors of a filter that one step compares with each other, at most; larger filters are cut into blocks.
BLOCK = 1_024
#: Filters that a step looks up at once when it asks where its vectors met before.
LOOKED_UP = 4_096


@lru_cache(maxsize=8)
def codes(dim: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of unit length for the two halves of the dimensions."""
    rng = np.random.default_rng([seed, dim, words])
    out = []
    for d in (dim // 2, dim - dim // 2):
        c = rng.standard_normal((words, max(d, 1)))[:, :d]
        out.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) if d else np.zeros((words, 0)))
    return out[0], out[1]


@lru_cache(maxsize=8)
def turn(dim: int, seed: int) -> np.ndarray:
    """A random rotation, so that no vector's two halves are special."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, 2]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def shape(vectors: int, filters_per_vector: float = 32.0) -> int:
    """Codewords in a half, so that there are filters_per_vector filters for each vector and a filter's share of them stays small."""
    return max(64, math.ceil(math.sqrt(filters_per_vector * max(vectors, 1))))


def _passing(a: np.ndarray, b: np.ndarray, height: float) -> int:
    """How many sums of a value of a and one of b reach the height; b ascending."""
    return int((len(b) - np.searchsorted(b, height - a)).sum())


@lru_cache(maxsize=32)
def cap_height(dim: int, words: int, per_vector: float, seed: int, directions: int = 65) -> float:
    """The height that per_vector filters exceed for the median of some random directions: a quantile of their own
    scores with all filters, found by halving an interval. No product of codewords is made."""
    one, two = codes(dim, words, seed)
    x = np.random.default_rng([seed, dim, words, 1]).standard_normal((directions, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = x[:, : dim // 2] @ one.T, np.sort(x[:, dim // 2 :] @ two.T, axis=1)
    heights = []
    for p, q in zip(a, b):
        low, high = p.min() + q[0], p.max() + q[-1]
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if _passing(p, q, middle) > per_vector else (low, middle)
        heights.append(high)
    return float(np.median(heights))


def decode(unit: np.ndarray, words: int, per_vector: float, seed: int, least: int = 6, tables: int = 2) -> list[np.ndarray]:
    """The filters of each unit vector in all tables, ascending; tables have codes of their own."""
    unit = unit @ turn(unit.shape[1], seed)
    parts = [_decode(unit, words, per_vector, seed + k, least) for k in range(tables)]
    return [np.concatenate([x + (k << 44) for k, x in enumerate(own)]) for own in zip(*parts)]


def _decode(unit: np.ndarray, words: int, per_vector: float, seed: int, least: int) -> list[np.ndarray]:
    """For each unit vector all filters whose score exceeds the cap's height, ascending; a vector that lies far from
    the codewords, with fewer than `least`, takes its best ones instead."""
    n, dim = unit.shape
    one, two = codes(dim, words, seed)
    half = dim // 2
    a, b = unit[:, :half] @ one.T, unit[:, half:] @ two.T
    height = cap_height(dim, words, per_vector, seed)
    most_a, most_b = a.max(1), b.max(1)
    out = []
    for k in range(n):
        i, j = np.flatnonzero(a[k] >= height - most_b[k]), np.flatnonzero(b[k] >= height - most_a[k])
        total = a[k][i][:, None] + b[k][j][None, :]
        x, y = np.nonzero(total >= height)
        if len(x) < least:
            i, j = np.argpartition(a[k], -least)[-least:], np.argpartition(b[k], -least)[-least:]
            total = (a[k][i][:, None] + b[k][j][None, :]).ravel()
            top = np.argpartition(total, -least)[-least:]
            x, y = top // least, top % least
        out.append(np.sort(i[x].astype(np.int64) * words + j[y] + (dim << 48)))
    return out


def _seen_before(lists: list[np.ndarray], f: int) -> np.ndarray:
    """Which pairs of vectors share a filter below f, and so were compared there. So many filters are looked up at once
    that the step's memory is bounded by its vectors."""
    lower = [x[x < f] for x in lists]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lower])
    _, at, times = np.unique(np.concatenate(lower), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    rows, at = rows[shared], np.searchsorted(np.flatnonzero(times > 1), at[shared])
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    met = np.zeros((len(lists), len(lists)), np.float32)
    for s in range(0, int(at[-1]) + 1 if len(at) else 0, LOOKED_UP):
        part = slice(*np.searchsorted(at, (s, s + LOOKED_UP)))
        has = np.zeros((len(lists), LOOKED_UP), np.float32)
        has[rows[part], at[part] - s] = 1
        met += has @ has.T
    return met > 0


def _labels(links: np.ndarray) -> np.ndarray:
    """The first position that each position of a symmetric matrix reaches."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(links)).min(1)
        low = np.minimum(label, low)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(ids: np.ndarray, size: np.ndarray, vec: np.ndarray, lists: list[np.ndarray], f: int, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(linked sizes of each vector, edge ends a and b) within one step of a filter. side: the block of each vector;
    with two blocks only pairs across are compared."""
    cosine = vec @ vec.T
    fits = cosine >= least
    if side.min() != side.max():
        fits &= side[:, None] != side[None, :]
    np.fill_diagonal(fits, False)
    if fits.any():
        fits &= ~_seen_before(lists, f)
    label = _labels(fits)
    other = np.flatnonzero(label != np.arange(len(ids)))
    return fits @ size, ids[other], ids[label[other]]


def links(reps: DataFrame, least: float, per_vector: float, words: int, seed: int) -> DataFrame:
    """From classes (r, m, v): rows (r, n, a, b) that each hold a part of the linked vectors' count, or an edge."""
    spark = common.session(reps.sparkSession, 4_096)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.frombuffer(x, np.float64) for x in b.column("v").to_pylist()]
            lists: list = [None] * len(raw)
            for dim in {len(x) for x in raw}:
                own = [k for k, x in enumerate(raw) if len(x) == dim]
                for s in range(0, len(own), 512):
                    for k, x in zip(own[s : s + 512], decode(np.array([raw[i] for i in own[s : s + 512]]), words, per_vector, seed)):
                        lists[k] = x
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("m"), b.column("v"), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], names=["r", "m", "v", "fs"])

    shelf = common.Shelf()
    lists = shelf.put(reps.mapInArrow(expand, "r long, m long, v binary, fs array<long>"), "cap-lists")
    spots = lists.select("r", F.explode("fs").alias("f"))
    counts = spots.groupBy("f").agg(F.count("*").alias("k")).filter("k > 1")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    spots = spots.join(counts, "f").withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("r"), F.col("nb")).cast("int"))
    spots = spots.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spots = spots.select("r", "f", "own", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"))
    steps = spots.join(lists, "r").repartition("f", "x", "y").sortWithinPartitions("f", "x", "y", "own", "r").select("f", "x", "y", "own", "r", "m", "v", "fs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def step(rows: list) -> list[tuple]:
            dims = [len(r[3]) for r in rows]
            ids, size = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float64)
            vec = np.frombuffer(b"".join(r[3] for r in rows)).reshape(len(rows), dims[0] // 8)
            counts, a, b = _compare(ids, size, vec, [np.array(r[4], np.int64) for r in rows], key[0], np.array([r[0] for r in rows]), least)
            some = np.flatnonzero(counts)
            return [(int(ids[k]), int(counts[k]), None, None) for k in some] + [(None, None, int(p), int(q)) for p, q in zip(a, b)]

        def batch(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["r", "n", "a", "b"])

        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in ("f", "x", "y", "own", "r", "m", "v", "fs")]
            for f, x, y, *row in zip(*columns):
                if (f, x, y) != key:
                    if len(held) > 1:
                        out += step(held)
                    held, key = [], (f, x, y)
                held.append(row)
            yield batch(out)
        if len(held) > 1:
            yield batch(step(held))

    out = common.stored(steps.mapInArrow(run, "r long, n long, a long, b long"), "cap-links")
    shelf.close()
    return out


def near_duplicates(table: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", per_vector: float = 12.0, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: vectors link when their cosine is `least` or more.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
    different lengths with each other. Equal vectors are one class and are compared once; n_links counts all
    their ids. A row that repeats an id and its vector adds nothing. Of an id with several vectors each row counts the
    links of its own vector, the id's other vectors being like any other's, and the id's rows are in one component. A
    row without id has nulls. Other columns aren't read. Every vector is indexed; recall of links comes from the number
    of filters per vector. An empty table gives no rows.
    """
    common.session(table.sparkSession, 4_096)
    shelf = common.Shelf()
    base = table.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("e"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, units = [], []
            for e in b.column("e"):
                x = e.values.to_numpy(zero_copy_only=False) if e.is_valid else np.zeros(0)
                norm = float(np.sqrt((x / (peak := np.abs(x).max())) @ (x / peak)) * peak) if len(x) and np.isfinite(x).all() and x.any() else 0.0
                good = 0 < norm < math.inf
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if good else None)
                units.append((x / norm).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["i", "d", "v"])

    rows = shelf.put(base.mapInArrow(read, "i long, d binary, v binary"), "cap-vectors")
    ids = rows.select("i", "d").filter("i IS NOT NULL AND d IS NOT NULL").distinct()
    classes = ids.groupBy("d").agg(F.min("i").alias("r"), F.count("*").alias("m"))
    classes = shelf.put(classes.withColumn("q", F.monotonically_increasing_id()), "cap-classes")
    firsts = classes.join(rows.withColumnRenamed("i", "r"), ["d", "r"]).dropDuplicates(["q"]).select(F.col("q").alias("r"), "m", "v")
    found = shelf.take(links(firsts, least, per_vector, shape(classes.count()), seed))
    edges = found.filter("a IS NOT NULL").select("a", "b")
    for end in "ab":
        edges = edges.join(classes.select(F.col("q").alias(end), F.col("r").alias(f"r{end}")), end)
    several = ids.groupBy("i").agg(F.count("*").alias("k")).filter("k > 1").select("i")
    own = ids.join(several, "i").join(classes.select("d", "r"), "d").select(F.col("i").alias("a"), F.col("r").alias("b"))
    root = shelf.take(common.components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(own), "cap-components"))
    count = found.filter("r IS NOT NULL").groupBy(F.col("r").alias("q")).agg(F.sum("n").alias("n"))
    placed = classes.join(count, "q", "left").join(root.withColumnRenamed("id", "r"), "r", "left")
    placed = placed.select("d", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("root", "r").alias("c"))
    out = rows.select("i", "d").join(placed, "d", "left")
    component = F.when(F.col("i").isNotNull(), F.coalesce("c", "i"))
    out = out.select(F.col("i").alias(id_col), F.when(F.col("i").isNotNull(), F.coalesce("n", F.lit(0))).alias("n_links"), component.alias("component_id"), (F.col("i") == component).alias("kept"))
    out = common.stored(out, "cap-result")
    shelf.close()
    common.session(table.sparkSession)
    return out
