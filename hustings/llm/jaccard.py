"""N-gram Jaccard join: grouped prefix join over word shingles, for classes of near duplicates.

Documents with the same shingles are one class, represented by the least id. Classes with the same prefix and
size are one group; prefixes are joined between groups, pairs of groups that pass the size and position filters
are expanded to their members, and members are verified on whole sets. As only classes of linked documents are
asked for, each inverted list first proposes a chain and a star, and then one member of its largest component to
each of the others; what these link is verified once, and then only pairs in different components are still
candidates, all of which are verified. So a group of m near copies costs about m verifications, not m * m, and no
link between components is lost. Before whole sets are compared, counts of their shingles by bucket bound the number
of shared ones from above; most pairs end there, and only the texts of the others move. Members that stay in different
components are verified in blocks of their list, so what moves are members of blocks, not members of pairs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, shingles

#: Hash buckets of the frequency levels that order shingles, fixed whatever the input.
LEVEL_BITS = 21
#: Shingles whose repeats a task counts together.
CHUNK = 2_000_000
#: Spots of the bitmap that tells candidates' texts from others.
BITMAP_BITS = 23
#: Pairs in an Arrow batch that carries both their texts, and bytes of the first texts that are compared in one step.
PAIR_ROWS, PAIR_BYTES = 64, 1 << 20
#: Members from which a list is long, and long lists of a document that are kept beside each of its rows, at most;
#: documents on more of them make their pairs on every list.
LONG_LIST, MOST_LISTS = 256, 512
#: Members of a list in a block; what is left is verified between two blocks at a time.
BLOCK = 128
#: The columns of a pair that name its list and its two blocks there.
SPOT = ("h", "p", "q")


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _levels(docs: DataFrame, size: int) -> np.ndarray:
    """Frequency levels by hash bucket, over all documents: 0 for rare shingles, else twice the log of the count.

    A task counts the shingles of the different sets in each run of CHUNK shingles and passes on those that repeat
    there, so every shingle in more documents than there are runs is found. Any table of levels gives one order for
    all documents, and so a correct join; levels only keep frequent shingles out of prefixes.
    """

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            x = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            seen.clear()
            x.sort()
            again, more = np.unique(x[1:][x[1:] == x[:-1]], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(again.view(np.int64)), pa.array(more + 1, pa.int64())], names=["h", "c"])

        for b in batches:
            for _, found in shingles.of_batch(b, "t", size):
                for x in found:
                    d = _digest(x)
                    if len(x) and d not in seen:
                        seen.add(d)
                        held.append(x)
                        total += len(x)
                if total >= CHUNK:
                    yield flush()
                    total = 0
        yield flush()

    counts = docs.select("t").mapInArrow(repeats, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c >= 4")
    level = F.least(F.lit(120), (2 * F.log2("c")).cast("int"))
    buckets = counts.groupBy(F.col("h").bitwiseAND((1 << LEVEL_BITS) - 1).cast("int").alias("b")).agg(F.max(level).cast("byte").alias("l"))
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    got = buckets.toArrow()
    out[got["b"].to_numpy()] = got["l"].to_numpy()
    return out


def _prefix(x: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in order of level and hash, one of which any set that links with x has in its own prefix."""
    level = levels[(x & np.uint64(len(levels) - 1)).astype(np.int64)]
    keep = len(x) - -(-percent * len(x) // 100) + 1
    return x[np.lexsort((x, level))[:keep]] if level.any() else x[:keep]


def _buckets(n: int) -> int:
    """Buckets of the sketch of n shingles: a power of two, n / 4 to n / 2 of them."""
    return max(16, 1 << max(n.bit_length() - 2, 0))


def _sketch(x: np.ndarray) -> bytes:
    """Counts of a set's shingles by bucket, in as few bytes each as the largest needs."""
    size = _buckets(len(x))
    counts = np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(next(t for t in ("u1", "u2", "u4") if counts.max() < 1 << 8 * np.dtype(t).itemsize)).tobytes()


def _counts(sketch: bytes, n: int) -> np.ndarray:
    size = _buckets(n)
    return np.frombuffer(sketch, f"u{len(sketch) // size}").astype(np.int64)


def most_shared(a: bytes, n: int, b: bytes, m: int) -> int:
    """An upper bound of the shingles that two sets of n and m share, from their sketches."""
    x, y = _counts(a, n), _counts(b, m)
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, size).sum(0), y.reshape(-1, size).sum(0)).sum())


def _described(docs: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """(i, n, d, p, k, x) of every document: set size, digest of the set, digest of size and prefix, sketch, prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    kind = docs.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in shingles.of_batch(b, "t", size):
                prefixes = [_prefix(x, sent.value, percent) for x in found]
                keys = [_digest(np.append(p, np.uint64(len(x)))) for p, x in zip(prefixes, found)]
                blobs = [[_digest(x) for x in found], keys, [_sketch(x) for x in found], [p.tobytes() for p in prefixes]]
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array([len(x) for x in found], pa.int64()), *[pa.array(c, pa.binary()) for c in blobs]], names=["i", "n", "d", "p", "k", "x"])

    return docs.mapInArrow(run, f"i {kind}, n long, d binary, p binary, k binary, x binary")


def _lists(leaders: DataFrame, percent: int) -> DataFrame:
    """From leaders (g, n, x, m): the inverted lists with two groups or more, as rows (h, g, n, pos, a, b).

    A row's pair (a, b) is null or proposes a pair of groups: with its neighbour in order of size, or with the
    first of the list. Lists of two or three groups of one member each have no other pairs, so only their pairs are
    rows. A list streams through its task in order; none is held.
    """

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [np.frombuffer(x, np.int64) for x in b.column("x").to_pylist()]
            count = np.array([len(x) for x in xs], np.int64)
            row = np.repeat(np.arange(len(xs)), count)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            for s in range(0, len(row), common.NARROW_ROWS):
                e = slice(s, s + common.NARROW_ROWS)
                take = pa.array(row[e])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)[e]), b.column("g").take(take), b.column("n").take(take).cast(pa.int32()), pa.array(pos[e].astype(np.int32)), b.column("m").take(take)], names=["h", "g", "n", "pos", "m"])

    rows = leaders.mapInArrow(postings, "h long, g long, n int, pos int, m boolean")
    rows = rows.repartition("h").sortWithinPartitions("h", "n", "g")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros((0, 5), np.int64)  # the first and the last row of the list that is under way
        waiting = np.zeros((0, 5), np.int64)  # the last row, while it is alone in its list
        for b in batches:
            now = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "g", "n", "pos", "m")])
            if not len(now):
                continue
            x = np.vstack([carry, now])
            new = np.ones(len(x), bool)
            new[1:] = x[1:, 0] != x[:-1, 0]
            first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            prev = np.maximum(np.arange(len(x)) - 1, 0)
            multi = ~new
            multi[:-1] |= ~new[1:]
            fresh = np.arange(len(x)) >= len(carry)
            if len(waiting) and len(x) > len(carry) and x[len(carry), 0] == waiting[0, 0]:
                fresh[len(carry) - 1] = True  # the row that waited has company now
            alone = new[-1]
            out = []
            for other in (first, prev):
                fits = multi & fresh & ~new & _close(x[other], x, percent)
                if other is prev:
                    fits &= prev != first
                out.append((np.flatnonzero(fits), other[fits]))
            # Lists that the batch may not hold whole, long ones and those with a group of several members stay.
            run = np.cumsum(new) - 1
            needed = (np.bincount(run) > 3) | (np.bincount(run, weights=x[:, 4]) > 0)
            needed[-1] = True
            needed[0] |= len(carry) > 0
            keep = np.flatnonzero(multi & fresh & needed[run])
            paired = np.concatenate([o[0] for o in out])
            mates = np.concatenate([o[1] for o in out])
            a = np.concatenate([np.full(len(keep), -1), np.minimum(x[paired, 1], x[mates, 1])])
            z = np.concatenate([np.full(len(keep), -1), np.maximum(x[paired, 1], x[mates, 1])])
            base = np.concatenate([keep, paired])
            if len(base):
                none = np.concatenate([np.ones(len(keep), bool), np.zeros(len(paired), bool)])
                cols = [pa.array(x[base, 0]), pa.array(x[base, 1]), pa.array(x[base, 2].astype(np.int32)), pa.array(x[base, 3].astype(np.int32)), pa.array(a, mask=none), pa.array(z, mask=none)]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "g", "n", "pos", "a", "b"])
            waiting = x[-1:] if alone else np.zeros((0, 5), np.int64)
            carry = x[-1:] if alone else np.vstack([x[first[-1]], x[-1]])

    return rows.mapInArrow(pairs, "h long, g long, n int, pos int, a long, b long")


def _fits(n: str, pos: str, other_n: str, other_pos: str, percent: int) -> Column:
    """Size and position filter on columns."""
    most = 1 + F.least(F.col(n) - F.col(pos) - 1, F.col(other_n) - F.col(other_pos) - 1)
    return (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)) & ((100 + percent) * most >= percent * (F.col(n) + F.col(other_n)))


def _close(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    """Size and position filter on rows (h, g, n, pos), the first no larger than the second."""
    ns, nl = small[:, 2], large[:, 2]
    most = 1 + np.minimum(ns - small[:, 3] - 1, nl - large[:, 3] - 1)
    return (100 * ns >= percent * nl) & ((100 + percent) * most >= percent * (ns + nl))


def _spot(i: Column) -> Column:
    return F.pmod(F.xxhash64(i), F.lit(1 << BITMAP_BITS)) + 1


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the spots of all ids, so that texts of other documents stay where they are."""
    spot = _spot(F.col("i"))
    parts = ids.groupBy(F.bitmap_bucket_number(spot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m"))
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in parts.collect():  # bucket k holds spots (k - 1) * 32768 + 1 and on
        start = (r["k"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def _links(n: int, m: int, shared: int, percent: int) -> bool:
    return shared > 0 and 100 * shared >= percent * (n + m - shared)


def _named_in(pairs: DataFrame) -> DataFrame:
    """(h, p, q, i): the documents that the pairs (h, p, q, a, b) of each two blocks name, once each."""
    return pairs.select(*SPOT, F.col("a").alias("i")).union(pairs.select(*SPOT, "b")).distinct()


def _in_blocks(pairs: DataFrame, rows: DataFrame, value: Callable, links: Callable, percent: int) -> DataFrame:
    """The pairs (h, p, q, a, b) of which some values link. A row (i, ...) moves once for two blocks that need it, not
    for each pair; value gives (i, size, value) of such rows, links the shared elements of two sizes and values at most."""

    def run(these: pa.Table, held: pa.Table) -> pa.Table:
        own = defaultdict(list)
        for b in held.to_batches():
            for i, n, x in value(b):
                if n:
                    own[i].append((n, x))
        a, b = these["a"].to_pylist(), these["b"].to_pylist()
        keep = [any(_links(n, m, links(x, n, y, m), percent) for n, x in own[i] for m, y in own[j]) for i, j in zip(a, b)]
        return these.select([*SPOT, "a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = _named_in(pairs).join(rows.hint("merge"), "i").withColumnsRenamed({k: f"_{k}" for k in SPOT})
    return pairs.groupBy(*SPOT).cogroup(held.groupBy(*[f"_{k}" for k in SPOT])).applyInArrow(run, "h long, p int, q int, a long, b long")


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link; sketches: (i, n, k), of stored tables both."""
    if "h" in pairs.columns:
        def value(b: pa.RecordBatch) -> Iterator[tuple]:
            return zip(*(b.column(c).to_pylist() for c in ("i", "n", "k")))

        return _in_blocks(pairs, sketches, value, most_shared, percent)
    left, right = (sketches.select(F.col("i").alias(s), F.struct("n", "k").alias(f"k{s}")).hint("merge") for s in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ka.n", "ka.k", F.col("kb.n").alias("m"), F.col("kb.k").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k, m, j = (b.column(c).to_pylist() for c in ("n", "k", "m", "j"))
            keep = [x > 0 < y and _links(x, y, most_shared(s, x, t, y), percent) for x, s, y, t in zip(n, k, m, j)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets link, as a stored table; pairs must be one too. Pairs (h, p, q, a, b) are
    verified in blocks."""
    blocks = "h" in pairs.columns
    spark = common.session(docs.sparkSession)
    shelf = common.Shelf()
    pairs = shelf.put(_plausible(pairs, sketches, percent), "jaccard-plausible")
    ids = pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct()
    sent = spark.sparkContext.broadcast(_bitmap(ids))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spot = b.column("k").to_numpy(zero_copy_only=False) - 1
            yield b.select(["i", "t"]).filter(pa.array((sent.value[spot >> 3] >> (spot & 7)) & 1 == 1))

    texts = shelf.put(docs.withColumn("k", _spot(F.col("i"))).mapInArrow(some, "i long, t string"), "jaccard-texts")
    left, right = (texts.select(F.col("i").alias(k), F.col("t").alias(f"t{k}")).hint("merge") for k in "ab")

    def value(b: pa.RecordBatch) -> Iterator[tuple]:
        for part, found in shingles.of_batch(b, "t", size):
            yield from zip(part.column("i").to_pylist(), map(len, found), found)

    def shared(x: np.ndarray, n: int, y: np.ndarray, m: int) -> int:
        return len(np.intersect1d(x, y, assume_unique=True))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.pieces(b, "ta", PAIR_BYTES):
                keep = []
                for (_, xs), (_, ys) in zip(shingles.of_batch(part, "ta", size, 1 << 62), shingles.of_batch(part, "tb", size, 1 << 62)):
                    keep += [_links(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent) for x, y in zip(xs, ys)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    if blocks:
        out = common.stored(_in_blocks(pairs, texts, value, shared, percent).select("a", "b"), "jaccard-links")
    else:
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        common.session(spark, PAIR_ROWS)
        out = common.stored(both.mapInArrow(check, "a long, b long").distinct(), "jaccard-links")
        common.session(spark)
    shelf.close()
    common.tidy(spark)
    return out


def _named(root: DataFrame) -> DataFrame:
    return root.withColumnRenamed("id", "x")


def _mixed(spots: DataFrame) -> DataFrame:
    """(h, top, m, s, t) of the lists with several components: the largest, the members' count and their signature."""
    per = spots.groupBy("h", "c").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("x")).alias("s"), F.bit_xor(F.xxhash64("x", F.lit(7))).alias("t"))
    lists = per.groupBy("h").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("cs"), F.sum("k").alias("m"), F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t"))
    return lists.filter("cs > 1").select("h", F.col("top.c").alias("top"), "m", "s", "t")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) for every row: documents link when 100 * shared >= percent * all shingles.

    Sets are of distinct shingles of `size` words, of the whole sequence where there are fewer. A null or empty
    text and one without words has no shingles, links with nothing and is its own component. Rows with one id
    count as one document; a row without id has a null component. Texts of any length are taken whole; other
    columns aren't read.
    """
    spark = common.session(docs.sparkSession)
    shelf = common.Shelf()
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    known = base.filter("i IS NOT NULL")
    wide = shelf.put(_described(base, _levels(base, size), size, percent), "jaccard-prefixes")
    all_rows = shelf.put(wide.select("i", "n", "d", "p", "k"), "jaccard-documents")
    rows = all_rows.filter("i IS NOT NULL AND n > 0")
    sketches = rows.select("i", "n", "k")

    reps = shelf.put(rows.groupBy("d").agg(F.min("i").alias("r"), F.first("n").alias("n"), F.first("p").alias("p")), "jaccard-classes")
    groups = reps.groupBy("p").agg(F.min("r").alias("g"), F.count("*").alias("m"))
    members = shelf.put(reps.join(groups, "p").select("g", F.col("r").alias("x"), F.col("n").cast("int").alias("n"), "m", "p"), "jaccard-groups")

    # Rows that repeat an id and its text are leaders twice; their list rows are the same document's.
    first_of = members.filter("g = x").select("p", "g", (F.col("m") > 1).alias("m")).distinct()
    leaders = shelf.put(wide.select("i", "n", "p", "x").filter("n > 0").join(first_of, "p").filter("i = g").select("g", "n", "x", "m"), "jaccard-leaders")
    shelf.drop(wide)
    common.tidy(spark)
    common.session(spark, 4_096)
    lists = shelf.put(_lists(leaders, percent), "jaccard-lists")
    common.session(spark)
    shelf.drop(leaders)
    common.tidy(spark)

    # What chains and stars propose.
    proposed = lists.filter("a < b").select("a", "b").union(members.filter("x <> g").select(F.col("g").alias("a"), F.col("x").alias("b"))).distinct()
    proposed = shelf.put(proposed, "jaccard-proposed")
    first = shelf.take(_verified(known, proposed, sketches, size, percent))
    same_id = rows.select("i", "d").distinct().groupBy("i").agg(F.count("*").alias("k")).filter("k > 1").select("i")
    twice = rows.select("i", "d").join(same_id, "i").join(reps.select("d", "r"), "d").select(F.col("i").alias("a"), F.col("r").alias("b"))
    links = first.union(twice)
    root = shelf.take(common.components(links, "jaccard-roots"))
    common.tidy(spark)

    # What is left: members of different components that share a list or a group.
    placed = shelf.put(members.join(_named(root), "x", "left").select("g", "x", "n", "m", F.coalesce("root", "x").alias("c")), "jaccard-placed")
    on_lists = lists.filter("a IS NULL").select("h", "g", "pos").join(placed.select("g", "x", "n", "c"), "g").select("h", "x", "n", "pos", "c")
    in_groups = placed.filter("m > 1").select(F.xxhash64("g").alias("h"), "x", "n", F.lit(0).alias("pos"), "c")
    every = shelf.put(on_lists.union(in_groups), "jaccard-all-spots")
    shelf.drop(lists)
    # Both sides are stored tables, so a hot list is split between tasks while the query runs.
    mixed = shelf.put(_mixed(every), "jaccard-mixed-lists")
    joined = shelf.put(every.join(mixed.hint("merge"), "h").select(F.xxhash64("m", "s", "t").alias("h"), "x", "pos", "n", "c", "top", "m"), "jaccard-mixed-spots")
    # Lists with the same members count as one, on which each has its first position.
    spots = shelf.put(joined.groupBy("h", "x").agg(F.min("pos").alias("pos"), *[F.first(k).alias(k) for k in ("n", "c", "top", "m")]), "jaccard-mixed")
    shelf.drop(every, mixed, joined)
    common.tidy(spark)

    # Each member outside its list's largest component is tried with one member of it, another one in every list.
    pick = shelf.put(spots.filter("c = top").groupBy("h").agg(F.min_by(F.struct("x", "n", "pos"), F.xxhash64("x", "h")).alias("p")), "jaccard-picks")
    outside = spots.filter("c <> top").join(pick.hint("merge"), "h").filter(_fits("n", "pos", "p.n", "p.pos", percent))
    tried = outside.select(F.least("x", "p.x").alias("a"), F.greatest("x", "p.x").alias("b")).distinct().join(proposed, ["a", "b"], "left_anti")
    tried = shelf.put(tried, "jaccard-tried")
    if tried.take(1):
        links = links.union(shelf.take(_verified(known, tried, sketches, size, percent)))
        root = shelf.take(common.components(links, "jaccard-roots"))
        again = shelf.put(spots.drop("c", "top", "m").join(_named(root), "x", "left").withColumn("c", F.coalesce("root", "x")).drop("root"), "jaccard-again")
        mixed = shelf.put(_mixed(again).select("h", "top", "m"), "jaccard-mixed-lists")
        shelf.drop(spots)
        spots = shelf.put(again.join(mixed.hint("merge"), "h"), "jaccard-mixed")
        shelf.drop(again, mixed)
        common.tidy(spark)

    # All the rest is verified. On long lists a pair is made only on the first, in the order of shingles, that both are on.
    own = spots.filter(F.col("m") >= LONG_LIST).groupBy("x").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda s: s["h"]).alias("hs"))
    spots = shelf.put(spots.join(own, "x", "left").withColumn("hs", F.when((F.col("m") >= LONG_LIST) & (F.size("hs") <= MOST_LISTS), F.col("hs"))), "jaccard-spots")
    a, b = spots.filter("c <> top").alias("a"), spots.alias("b")
    both = (F.col("a.h") == F.col("b.h")) & (F.col("a.c") != F.col("b.c")) & ((F.col("b.c") == F.col("b.top")) | (F.col("a.x") < F.col("b.x")))
    here = F.coalesce(F.array_intersect("a.hs", "b.hs")[0] == F.col("a.h"), F.lit(True))
    rest = a.join(b, both & _fits("a.n", "a.pos", "b.n", "b.pos", percent) & here).select(F.least("a.x", "b.x").alias("a"), F.greatest("a.x", "b.x").alias("b"), F.struct("a.m", "a.h").alias("s"))
    rest = rest.groupBy("a", "b").agg(F.max("s").alias("s"))  # of a pair's lists, the longest
    block = [F.pmod(F.xxhash64(k), F.ceil(F.col("s.m") / BLOCK)).cast("int").alias(s) for k, s in zip("ab", SPOT[1:])]
    rest = rest.select(F.col("s.h").alias("h"), *block, "a", "b")
    rest = shelf.put(rest.join(proposed.union(tried), ["a", "b"], "left_anti"), "jaccard-rest")
    if rest.take(1):
        root = shelf.take(common.components(links.union(shelf.take(_verified(known, rest, sketches, size, percent))), "jaccard-components"))

    with_rep = all_rows.select("i", "n", "d").join(reps.select("d", "r"), "d", "left")
    out = with_rep.join(root.withColumnRenamed("id", "r"), "r", "left")
    whole = F.when((F.col("n") == 0) | F.col("i").isNull(), F.col("i")).otherwise(F.coalesce("root", "r"))
    out = common.stored(out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), whole.alias("component_id")), "jaccard-result")
    shelf.close()
    return out


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 2_000_000) -> DataFrame:
    """The documents that stand for their component, all columns unchanged; found: link()'s rows, as a stored table.

    Of rows with one id, the one with the least text stays, a null text being least; of equal texts any one. Rows
    without an id stay; an empty table stays empty. The ids that go are broadcast up to most_broadcast of them, and
    joined by a shuffle beyond.
    """
    per_id = found.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(id_col) == F.col("component_id")).cast("int")).alias("_stays"), F.count("*").alias("_n"))
    per_id = common.stored(per_id.filter("_stays = 0 OR _n > 1"), "jaccard-going")
    own = F.col(id_col).cast("long")
    count = per_id.count()
    going = per_id.select("_id")
    out = docs.join(F.broadcast(going) if count <= most_broadcast else going, own == F.col("_id"), "left_anti")
    if per_id.filter("_stays = 1").take(1):
        several = docs.join(per_id.filter("_stays = 1").select("_id"), own == F.col("_id"))
        row = F.struct(*docs.columns)
        least = several.select("_id", F.struct(F.col(text_col).isNotNull(), F.col(text_col)).alias("_t"), row.alias("_row")).groupBy("_id").agg(F.min_by("_row", "_t").alias("_row"))
        out = out.unionByName(least.select("_row.*"))
    return out
