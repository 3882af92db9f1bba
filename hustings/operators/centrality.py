"""Centrality and communities of graphs whose arcs fit a worker; nothing is sampled.

Strength and degree are aggregates. Paths are counted source by source: sources are dealt over tasks, each with the
whole adjacency as three arrays of 24 bytes an edge, and their partial sums are added up. Eigenvectors take one pass
after the other over these arrays on the driver, and so do communities, which refuse graphs beyond MOST_EDGES.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hustings.plans.session import ship

from .network import ego, symmetric

#: Edges that communities take.
MOST_EDGES = 5_000_000
#: Sources whose paths are counted together, and their nodes in all, which bounds a worker's memory; on graphs of few
#: edges fewer, so what is looked up stays near the processor.
TOGETHER, ROOM, FEW = 128, 6_000_000, 700_000


def _strings(x: Sequence[str] | pa.ChunkedArray) -> pa.Array:
    x = x if isinstance(x, pa.ChunkedArray) else pa.chunked_array([pa.array(list(x), pa.string())])
    return x.cast(pa.large_string()).combine_chunks()


class Graph:
    """Names in order; node v's neighbours and weights are near[at[v] : at[v + 1]] and weight[at[v] : at[v + 1]]."""

    def __init__(self, src: Sequence[str], dst: Sequence[str], weight: Sequence[float], nodes: Sequence[str] = ()):
        src, dst, nodes = (_strings(x) for x in (src, dst, nodes))
        names = pc.unique(pa.concat_arrays([pc.unique(x) for x in (src, dst, nodes)]))
        names = names.take(pc.sort_indices(names))
        self.names: list[str] = names.to_pylist()
        a, b = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False) for x in (src, dst))
        w = np.asarray(weight, np.float64)
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((target, source))
        self.near, self.weight = target[order], np.concatenate([w, w])[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=len(self.names)))]).astype(np.int64)

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.names)), np.diff(self.at))


class Sums:
    """Sums over all neighbours of arcs of one length. Rows of near numbers lie in blocks of like degree, filled up with n."""

    def __init__(self, at: np.ndarray, near: np.ndarray):
        n, degree = len(at) - 1, np.diff(at)
        rows = np.argsort(degree, kind="stable")
        rows = rows[degree[rows] > 0]
        deg = degree[rows]
        self.n, self.width, self.blocks, k = n, int(deg.max(initial=0)), [], 0
        self.block, self.row = np.zeros(n, np.int32), np.zeros(n, np.int32)
        while k < len(rows):
            end = int(np.searchsorted(deg, deg[k] + deg[k] // 8, "right"))
            r, d, wide = rows[k:end], deg[k:end], int(deg[end - 1])
            held = np.full((end - k, wide), n, np.int32)
            held[np.arange(wide) < d[:, None]] = near[np.repeat(at[r] - np.cumsum(d) + d, d) + np.arange(d.sum())]
            self.block[r], self.row[r] = len(self.blocks) + 1, np.arange(end - k)
            self.blocks.append((r, held))
            k = end

    def push(self, x: np.ndarray, step: int = 2000) -> np.ndarray:
        """For each node the sum of its neighbours' rows of x, which has a last row of zeros."""
        y = np.zeros((self.n, x.shape[1]), x.dtype)
        for rows, held in self.blocks:
            if len(rows) < 32:
                for r, near in zip(rows, held):
                    y[r] = x[near].sum(axis=0, dtype=x.dtype)
                continue
            for i in range(0, len(rows), step):
                to = held[i : i + step].T.astype(np.intp, order="C")
                total = np.zeros((to.shape[1], x.shape[1]), x.dtype)
                one = np.empty_like(total)
                for near in to:
                    np.take(x, near, axis=0, out=one, mode="clip")
                    total += one
                y[rows[i : i + step]] = total
        return y

    def pull(self, nodes: np.ndarray, x: np.ndarray, room: int = 25_000) -> np.ndarray:
        """For some nodes the sum of their neighbours' x, which has a zero at its end."""
        out, block = np.zeros(len(nodes)), self.block[nodes]
        for k, (_, held) in enumerate(self.blocks, 1):
            mine = np.flatnonzero(block == k)
            rows, step = self.row[nodes[mine]], max(1, room // held.shape[1])
            for i in range(0, len(mine), step):
                out[mine[i : i + step]] = x.take(held.take(rows[i : i + step], axis=0, mode="clip").astype(np.intp), mode="clip").sum(axis=1)
        return out


class Arcs:
    """A graph's arcs for from_sources: their lengths, the least of each node and of all, the sizes of components.

    Lengths that many arcs share are the usual ones; the other arcs are the rest.
    """

    def __init__(self, g: Graph, weighted: bool):
        n = len(g.names)
        self.at, self.near = g.at, g.near
        with np.errstate(divide="ignore"):
            values, code = np.unique(g.weight, return_inverse=True) if weighted else (np.ones(1), np.zeros(len(g.near), np.int64))
            self.values = 1 / values
        self.code = code.astype(np.min_scalar_type(len(values)))
        some, self.least = np.flatnonzero(np.diff(g.at)), np.ones(n)
        if len(some):
            self.least[some] = np.minimum.reduceat(self.values[self.code], g.at[some])
        self.shortest = float(self.values.min(initial=np.inf)) if len(g.near) else 1.0
        many = np.bincount(self.code, minlength=len(values))
        self.usual = np.flatnonzero((many >= max(len(g.near) // 20, n // 4)) & (self.values < np.inf))
        self.least_usual = float(self.values[self.usual].min(initial=np.inf))
        self.size = _sizes(g)

    def only(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of each node's arcs among those kept, and these."""
        return np.concatenate([[0], np.cumsum(keep)])[self.at], np.flatnonzero(keep)

    @cached_property
    def sums(self) -> list[tuple[float, Sums]]:
        """By usual length; made in the worker, where a graph needs it."""
        out = []
        for k in self.usual:
            at, arcs = self.only(self.code == k)
            out.append((float(self.values[k]), Sums(at, self.near[arcs])))
        return out

    @cached_property
    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        return self.only(~np.isin(self.code, self.usual))


def _sizes(g: Graph) -> np.ndarray:
    """The size of each node's component: the least numbers of neighbours are taken over until none changes."""
    n = len(g.names)
    label, some = np.arange(n), np.flatnonzero(np.diff(g.at))
    while len(some):
        least = label.copy()
        least[some] = np.minimum(label[some], np.minimum.reduceat(label[g.near], g.at[some]))
        now = least.copy()
        np.minimum.at(now, label, least)
        while (now[now] != now).any():
            now = now[now]
        if (now == label).all():
            break
        label = now
    return np.bincount(label, minlength=n)[label] if n else label


def whole(edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
    """The graph on the driver, however large; it needs some 200 bytes an edge there for a time."""
    rows = edges.select("src", "dst", F.col("weight").cast("double")).toArrow()
    extra = nodes.toArrow().column(0) if nodes is not None else ()
    return Graph(rows["src"], rows["dst"], rows["weight"].to_numpy(), extra)


def collected(edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
    """The graph on the driver; ValueError beyond MOST_EDGES."""
    if max(df.limit(MOST_EDGES + 1).count() for df in (edges, nodes) if df is not None) > MOST_EDGES:
        raise ValueError(f"the graph has more than {MOST_EDGES} edges or nodes")
    return whole(edges, nodes)


def strength(edges: DataFrame) -> DataFrame:
    """(node, degree, strength, degree_centrality, mean_strength); the last two over n - 1."""
    by = symmetric(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    others = by.agg(F.count("*")).scalar() - 1
    return by.withColumns({"degree_centrality": F.try_divide(F.col("degree").cast("double"), others), "mean_strength": F.try_divide(F.col("strength").cast("double"), others)})


def _spread(at: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All arcs from some nodes: (which of the nodes, place of the arc)."""
    count = at[nodes + 1] - at[nodes]
    return np.repeat(np.arange(len(nodes), dtype=np.int32), count), np.arange(count.sum()) + np.repeat(at[nodes] - (np.cumsum(count) - count), count)


def from_source(g: Arcs, s: int) -> tuple[np.ndarray, float, int]:
    """Brandes' dependencies of one source, the sum of distances from it and the nodes reached."""
    share, far, reached = from_sources(g, np.array([s]))
    return share[0], float(far[0]), int(reached[0])


def from_sources(g: Arcs, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brandes' dependencies of some sources, a row each, the sums of distances from them and the nodes reached.

    Nodes are settled by bands of distance that are as wide as the shortest arc, so no node of a band lies on a path to
    another; without weights a band is a level of the breadth-first search. The sources go through the bands together.
    Where nodes at one distance have many arcs of a usual length, paths over these are counted by sums over all
    neighbours, whole numbers in the narrowest type that holds them; other arcs are followed one by one. Once a
    component is reached, nodes whose arcs are all too long to matter are passed over.
    """
    n, k = len(g.at) - 1, len(sources)
    first, even = np.arange(k) * n + sources, len(g.values) == 1
    dist, paths, opened = np.full(k * n, np.inf), np.zeros(k * n), np.zeros(k * n, bool)
    dist[first], paths[first] = 0.0, 1.0
    dists, counts, degree = dist.reshape(k, n), paths.reshape(k, n), np.diff(g.at)
    reached, size, limit = np.ones(k, np.int64), g.size[sources], np.full(k, np.inf)
    bands, ahead, turn, mark = [], first, 0, np.empty(k * n, np.int64)

    def matters(e: np.ndarray) -> np.ndarray:
        return e[dist[e] + g.least[e % n] <= limit[e // n] + 1e-12 * np.maximum(1.0, dist[e])]

    def limits(some: np.ndarray) -> None:
        for b in some:
            limit[b] = dists[b].max(where=dists[b] < np.inf, initial=0.0)

    while len(ahead):
        turn += 1
        d = dist[ahead]
        slack = 1e-12 * max(1.0, d.max())
        near = (d < d.min() + g.shortest - slack) | (d == d.min())
        at, ahead = ahead[near], ahead[~near]
        opened[at] = False
        at = matters(at)
        if not len(at):
            continue
        band, fresh = [], []
        d, arcs = dist[at], degree[at % n]
        some = d + g.least_usual > limit[at // n] + slack
        if len(g.usual) and _pays(g, arcs.sum(), k):
            late = some.copy()
            for v in np.unique(d[:: len(d) // 64 + 1]):
                same = (d == v) & ~late
                if _pays(g, arcs[same].sum(), k):
                    some |= same
                    flag = np.zeros(k * n, bool)
                    flag[at[same]] = True
                    nodes = [np.flatnonzero(x) for x in flag.reshape(k, n)]
                    held = np.zeros((n + 1, k), _narrow(paths[at[same]].max(), max(x.width for _, x in g.sums)))
                    for b, own in enumerate(nodes):
                        held[own, b] = counts[b][own]
                    for length, sums in g.sums:
                        band.append((v + length, sums, nodes, slack))
                        for b, new in enumerate(_met(dists, counts, reached, sums.push(held), v + length, slack)):
                            if reached[b] == size[b]:
                                limits([b])
                                if v + length + g.shortest > limit[b] + slack:
                                    continue
                            new = matters(np.flatnonzero(new) + b * n)
                            new = new[~opened[new]]
                            opened[new] = True
                            fresh.append(new)
        for e, (places, chosen) in ((at[~some], (g.at, None)), (at[some], g.rest if some.any() else (g.at, None))):
            if not len(e):
                continue
            which, arc = _spread(places, e % n)
            arc = arc if chosen is None else chosen[arc]
            to = (e - e % n)[which] + g.near[arc]
            cand = dist[e][which] + (g.values[0] if even else g.values[g.code[arc]])
            fits = (cand <= dist[to] + slack) & (cand < np.inf)
            which, to, cand = which[fits], to[fits], cand[fits]
            before = dist[to]
            if even:
                dist[to] = cand
                better = before == np.inf
            else:
                np.minimum.at(dist, to, cand)
                better = dist[to] < before - slack
                paths[to[better]] = 0
            new = np.flatnonzero(better & ~opened[to])
            mark[to[new]] = new
            new = new[mark[to[new]] == new]
            reached += np.bincount(to[new[before[new] == np.inf]] // n, minlength=k)
            opened[to[new]] = True
            fresh.append(to[new])
            if not even:
                good = cand <= dist[to] + slack
                which, to, cand = which[good], to[good], cand[good]
            np.add.at(paths, to, paths[e][which])
            band.append((e, which, to.astype(np.int32) if k * n < 1 << 31 else to, cand, slack))
        bands.append(band)
        ahead = np.concatenate([ahead, *fresh])
        done = reached == size
        if (now := np.flatnonzero(done if turn % 16 == 0 else done & (limit == np.inf))).size:
            limits(now)
            kept = matters(ahead)
            if len(kept) < len(ahead):
                opened[ahead] = False
                opened[kept] = True
                ahead = kept
    share = np.zeros(k * n)
    shares = share.reshape(k, n)
    for band in reversed(bands):
        for part in band:
            if len(part) == 4:
                cand, sums, nodes, slack = part
                for b, own in enumerate(nodes):
                    if len(own):
                        x = np.zeros(n + 1)
                        np.divide(1 + shares[b], counts[b], out=x[:n], where=(cand <= dists[b] + slack) & (dists[b] < np.inf))
                        shares[b][own] += counts[b][own] * sums.pull(own, x)
            else:
                e, which, to, cand, slack = part
                if not even:
                    last = cand <= dist[to] + slack
                    which, to = which[last], to[last]
                share[e] += paths[e] * np.bincount(which, (1 + share[to]) / paths[to], len(e))
    share[first] = 0
    return shares, dists.sum(axis=1, where=dists < np.inf), reached


def _pays(g: Arcs, arcs: int, k: int) -> bool:
    """Whether sums over all neighbours of k sources cost less than following some arcs one by one."""
    return 400 * int(arcs) > k * (len(g.near) + 200 * len(g.least))


def _narrow(most: float, width: int) -> type:
    """A type in which sums of `width` whole numbers up to `most` are exact, as far as doubles are."""
    return np.uint16 if most * width < 1 << 16 else np.float32 if most * width < 1 << 24 else np.float64


def _met(dists: np.ndarray, counts: np.ndarray, reached: np.ndarray, sums: np.ndarray, cand: float, slack: float) -> Iterator[np.ndarray]:
    """Takes the paths that end at a distance into each source's distances and counts; which nodes came nearer, by source."""
    for b, (dist, count) in enumerate(zip(dists, counts)):
        more = sums[:, b].astype(np.float64)
        fits = (more > 0) & (cand <= dist + slack)
        new = fits & (cand < dist - slack)
        reached[b] += np.count_nonzero(new & (dist == np.inf))
        np.copyto(count, 0, where=new)
        np.add(count, more, out=count, where=fits)
        np.minimum(dist, cand, out=dist, where=fits)
        yield new


def paths(edges: DataFrame, weighted: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """(node, betweenness, closeness), normalised; closeness is scaled by the share of nodes reached; distance is 1 / weight."""
    return _paths(edges.sparkSession, whole(edges, nodes), weighted)


def _paths(spark: SparkSession, graph: Graph, weighted: bool) -> DataFrame:
    ship(spark)
    n, tasks = len(graph.names), 4 * spark.sparkContext.defaultParallelism
    sent = spark.sparkContext.broadcast(Arcs(graph, weighted))

    most = max(1, min(TOGETHER, (ROOM if len(graph.near) > 16 * n else FEW) // max(n, 1), -(-n // tasks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        total, ids, close = np.zeros(n), [], []
        for b in batches:
            given = b.column("id").to_numpy()
            for i in range(0, len(given), most):
                share, far, reached = from_sources(g, given[i : i + most])
                total += share.sum(axis=0)
                ids += given[i : i + most].tolist()
                close += [(r - 1) / f * (r - 1) / (n - 1) if f > 0 and n > 1 else 0.0 for f, r in zip(far.tolist(), reached.tolist())]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(ids, np.int64), some])), pa.array(np.concatenate([np.zeros(len(ids)), total[some]])), pa.array(close + [0.0] * len(some), pa.float64())], names=["id", "b", "c"])

    found = spark.range(0, n, 1, max(1, min(tasks, n))).mapInArrow(run, "id long, b double, c double").groupBy("id").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return found.join(_numbered(spark, graph), "id").select("node", (F.col("b") * scale).alias("betweenness"), F.col("c").alias("closeness"))


def _numbered(spark: SparkSession, graph: Graph) -> DataFrame:
    n = len(graph.names)
    return spark.createDataFrame(pa.table({"id": pa.array(range(n), pa.int64()), "node": pa.array(graph.names, pa.string())}))


def eigenvector(edges: DataFrame, weighted: bool = False, rounds: int = 200, settled: float = 1e-12) -> DataFrame:
    """(node, eigenvector): power iteration on A + 1 from equal values, unit length, so all are non-negative. On a graph
    of several components the one of largest eigenvalue prevails. It ends after `rounds` rounds, or when none of its
    values moves by `settled`; with 0 every round is taken."""
    return _eigenvector(edges.sparkSession, whole(edges), weighted, rounds, settled)


def _eigenvector(spark: SparkSession, g: Graph, weighted: bool, rounds: int = 200, settled: float = 1e-12) -> DataFrame:
    n = len(g.names)
    x, weight = np.full(n, 1.0), g.weight if weighted else np.ones(len(g.weight))
    for _ in range(rounds if n else 0):
        now = x + np.bincount(g.owner, weight * x[g.near], n)
        now /= np.linalg.norm(now)
        if np.abs(now - x).max() < settled:
            break
        x = now
    return spark.createDataFrame(pa.table({"node": pa.array(g.names, pa.string()), "eigenvector": pa.array(x, pa.float64())}))


def ranks(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Adds <metric>_rank, largest first, equal values sharing the smaller rank. A rank needs one order over all rows,
    which takes one task: the table has a row for each node of a graph that fits a worker."""
    return table.withColumns({f"{m}_rank": F.rank().over(Window.orderBy(F.desc(m))).cast("long") for m in metrics})


#: The metrics of centrality_table that are ranked.
METRICS = ("degree_centrality", "strength", "betweenness", "weighted_betweenness", "closeness", "weighted_closeness", "eigenvector", "weighted_eigenvector")


def centrality_table(edges: DataFrame, nodes: DataFrame, node: str = "node", order: Sequence[Column] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """nodes with all metrics and their ranks, or with those of `metrics`; weighted betweenness, strength and `order` first.
    Nodes without an edge have zeros. The graph is collected once; edges should be a stored table."""
    spark, named = edges.sparkSession, nodes.withColumnRenamed(node, "node")
    out, graph = named.join(strength(edges), "node", "left"), whole(edges, named.select("node"))
    linked = whole(edges) if {"eigenvector", "weighted_eigenvector"} & {*metrics} else None
    for weighted, name in ((False, ""), (True, "weighted_")):
        out = out.join(_paths(spark, graph, weighted).withColumnsRenamed({"betweenness": f"{name}betweenness", "closeness": f"{name}closeness"}), "node", "left")
        if f"{name}eigenvector" in metrics:
            out = out.join(_eigenvector(spark, linked, weighted).withColumnRenamed("eigenvector", f"{name}eigenvector"), "node", "left")
    out = out.na.fill(0, ["degree", *metrics, "mean_strength"])
    return ranks(out, metrics).orderBy(F.desc("weighted_betweenness"), F.desc("strength"), *order, "node")


def ego_networks(edges: DataFrame, table: DataFrame, metrics: Sequence[str] = METRICS, n: int = 12) -> DataFrame:
    """(metric, centre, src, dst, weight): the ego network of each metric's first node, the least of equal ones."""
    firsts = table.agg(*[F.min_by("node", F.struct(-F.col(m), F.col("node"))).alias(m) for m in metrics]).first().asDict()
    whole = None
    for m, centre in firsts.items():
        if centre is not None:
            one = ego(edges, centre, n).select(F.lit(m).alias("metric"), F.lit(centre).alias("centre"), "src", "dst", "weight")
            whole = one if whole is None else whole.unionByName(one)
    return edges.select(F.lit("").alias("metric"), F.lit("").alias("centre"), "src", "dst", "weight").limit(0) if whole is None else whole


def speaker_nodes(edges: DataFrame, speakers: DataFrame, speaker: str, *attributes: str) -> DataFrame:
    """(id, attributes, degree, strength): the speakers that an edge touches, as a node table beside an edge table."""
    return speakers.select(F.col(speaker).alias("id"), *attributes).join(strength(edges).select(F.col("node").alias("id"), "degree", "strength"), "id")


def modularity(g: Graph, label: Sequence[int], resolution: float = 1.0) -> float:
    label, two_m = np.asarray(label, np.int64), g.weight.sum()
    if not two_m:
        return 0.0
    inside = g.weight[label[g.owner] == label[g.near]].sum()
    sums = np.bincount(label[g.owner], g.weight)
    return float(inside / two_m - resolution * (sums * sums).sum() / two_m**2)


def louvain(g: Graph, resolution: float = 1.0) -> list[int]:
    """A label for each node: nodes in order move to the neighbouring community of best gain, the smaller on ties,
    then communities become nodes, until nothing moves."""
    near = [dict() for _ in g.names]
    for v, u, w in zip(g.owner.tolist(), g.near.tolist(), g.weight.tolist()):
        near[v][u] = near[v].get(u, 0.0) + w
    two_m = sum(sum(d.values()) for d in near)
    label = list(range(len(near)))
    while two_m:
        own = list(range(len(near)))
        degree = [sum(d.values()) for d in near]
        total = degree[:]
        moved = True
        any_move = False
        while moved:
            moved = False
            for v in range(len(near)):
                to: dict[int, float] = {own[v]: 0.0}
                for u, w in near[v].items():
                    if u != v:
                        to[own[u]] = to.get(own[u], 0.0) + w
                total[own[v]] -= degree[v]
                best = max(sorted(to), key=lambda c: (round(to[c] - resolution * total[c] * degree[v] / two_m, 12), c == own[v]))
                if best != own[v]:
                    moved = any_move = True
                own[v] = best
                total[best] += degree[v]
        if not any_move:
            break
        number = {c: k for k, c in enumerate(sorted(set(own)))}
        label = [number[own[x]] for x in label]
        merged = [dict() for _ in number]
        for v, d in enumerate(near):
            a = merged[number[own[v]]]
            for u, w in d.items():
                b = number[own[u]]
                a[b] = a.get(b, 0.0) + w
        near = merged
    return label


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community, size): numbered from 1 by size, then by least member."""
    g = collected(edges)
    groups: dict[int, list[str]] = {}
    for name, k in zip(g.names, louvain(g, resolution)):
        groups.setdefault(k, []).append(name)
    order = sorted(groups.values(), key=lambda m: (-len(m), min(m)))
    rows = [(name, k, len(m)) for k, m in enumerate(order, 1) for name in m]
    return edges.sparkSession.createDataFrame(rows, "node string, community int, size int")


def community_summary(found: DataFrame, edges: DataFrame, members: int = 3) -> DataFrame:
    """(community, size, members): communities() with the strongest members of each, the least name first on ties."""
    by = found.join(strength(edges).select("node", "strength"), "node", "left").withColumn("strength", F.coalesce("strength", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("strength"), "node"))
    best = by.withColumn("_r", rank).filter(F.col("_r") <= members)
    return best.groupBy("community", "size").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "node"))), lambda x: x["node"]), "; ").alias("members"))
