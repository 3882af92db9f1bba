import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.operators import agreement, centrality, network, roster, rollups, series
from hustings.plans import value_queries
from hustings.sources import documents, sinks, tables
from hustings.streaming import landing


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


PATH = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 2.0)]


def test_paths_on_a_line(spark):
    got = {r.node: r for r in centrality.paths(edges(spark, PATH)).collect()}
    assert got["b"].betweenness == pytest.approx(2 / 3) and got["a"].betweenness == 0
    assert got["a"].closeness == pytest.approx(3 / 6) and got["b"].closeness == pytest.approx(3 / 4)
    weighted = {r.node: r for r in centrality.paths(edges(spark, PATH), weighted=True).collect()}
    assert weighted["d"].closeness == pytest.approx(3 / (0.5 + 1.5 + 2.5))


def test_ties_and_isolated_nodes(spark):
    square = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 1.0)]
    lone = spark.createDataFrame([("z",)], "node string")
    got = {r.node: r for r in centrality.paths(edges(spark, square), nodes=lone).collect()}
    assert all(got[n].betweenness == pytest.approx(0.5 * 2 / (4 * 3)) for n in "abcd") and got["z"].closeness == 0
    assert got["a"].closeness == pytest.approx(3 / 4 * 3 / 4)
    assert centrality.paths(edges(spark, [])).collect() == []


def test_eigenvector_of_a_star(spark):
    got = {r.node: r.eigenvector for r in centrality.eigenvector(edges(spark, [("h", x, 1.0) for x in "abcd"])).collect()}
    assert got["h"] == pytest.approx(2 * got["a"], rel=1e-6)


def test_communities(spark):
    two = [(x, y, 5.0) for g in ("abc", "def") for i, x in enumerate(g) for y in g[i + 1 :]] + [("c", "d", 1.0)]
    got = {r.node: r.community for r in centrality.communities(edges(spark, two)).collect()}
    assert [got[n] for n in "abcdef"] == [1, 1, 1, 2, 2, 2]
    g = centrality.Graph(*zip(*two))
    assert centrality.modularity(g, centrality.louvain(g)) > 0.3 and centrality.louvain(centrality.Graph([], [], [])) == []
    sizes = {r.community: (r["size"], r.members) for r in centrality.community_summary(centrality.communities(edges(spark, two)), edges(spark, two)).collect()}
    assert sizes == {1: (3, "c; a; b"), 2: (3, "d; e; f")}


def test_eigenvector_takes_as_many_rounds_as_its_sql(spark, tmp_path):
    """On a long chain power iteration settles late: the query's values are those of its SQL's rounds."""
    import datetime

    import duckdb

    from hustings.plans import catalog

    day = datetime.datetime(2024, 1, 1)
    steps = [u for k in range(40) for u in (k, k + 1, k, k + 1)]
    rows = [(i, day + datetime.timedelta(seconds=i), u, "view") for i, u in enumerate(steps)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(catalog.oracle_sql()["eigenvector"]).fetchall())
    got = {r.node: r.eigenvector for r in catalog.queries()["eigenvector"](spark, str(tmp_path)).collect()}
    assert len(want) == 41 and got == pytest.approx(want, abs=1e-9)


def test_too_large_a_graph_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(centrality, "MOST_EDGES", 2)
    with pytest.raises(ValueError, match="more than"):
        centrality.collected(edges(spark, PATH))


def test_centrality_table_takes_any_number_of_edges(spark, monkeypatch):
    monkeypatch.setattr(centrality, "MOST_EDGES", 2)
    got = {r.node: r for r in centrality.centrality_table(edges(spark, PATH), spark.createDataFrame([(x,) for x in "abcdz"], "node string")).collect()}
    assert got["b"].betweenness == pytest.approx(4 / (4 * 3)) and got["z"].closeness == 0 and got["b"].betweenness_rank == 1
    assert got["d"].weighted_closeness == pytest.approx(3 / (0.5 + 1.5 + 2.5) * 3 / 4)


@pytest.mark.parametrize("weighted", [False, True])
def test_dependencies_against_path_by_path_counts(weighted):
    """Betweenness from distances and path counts of all pairs by Floyd and Warshall, on graphs of several components with ties."""
    import itertools
    import random
    from fractions import Fraction

    rng = random.Random(5)
    for n in (2, 7, 12, 20):
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.25 and (p[0] < n // 3) == (p[1] < n // 3)]
        g = centrality.Graph([f"{a:02}" for a, _ in pairs], [f"{b:02}" for _, b in pairs], [rng.choice([1, 2, 2, 3, 6]) for _ in pairs], [f"{v:02}" for v in range(n)])
        far = [[Fraction(0) if u == v else None for v in range(n)] for u in range(n)]
        for u, v, w in zip(g.owner.tolist(), g.near.tolist(), g.weight.tolist()):
            far[u][v] = Fraction(1, int(w)) if weighted else Fraction(1)
        arc = [row[:] for row in far]
        for k, u, v in itertools.product(range(n), repeat=3):
            if far[u][k] is not None and far[k][v] is not None and (far[u][v] is None or far[u][k] + far[k][v] < far[u][v]):
                far[u][v] = far[u][k] + far[k][v]
        arcs = centrality.Arcs(g, weighted)
        for s in range(n):
            reach = sorted((v for v in range(n) if far[s][v] is not None), key=lambda v: far[s][v])
            count, share = {s: 1}, [Fraction(0)] * n
            before = {v: [u for u in reach if u != v and arc[u][v] is not None and far[s][u] + arc[u][v] == far[s][v]] for v in reach}
            for v in reach[1:]:
                count[v] = sum(count[u] for u in before[v])
            for v in reversed(reach[1:]):
                for u in before[v]:
                    share[u] += Fraction(count[u], count[v]) * (1 + share[v])
            share[s] = Fraction(0)
            got = centrality.from_source(arcs, s)
            assert got[0].tolist() == pytest.approx([float(x) for x in share]) and got[2] == len(reach)
            assert got[1] == pytest.approx(float(sum(far[s][v] for v in reach)))


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("sums", [False, True])
def test_paths_of_many_sources_at_once(monkeypatch, weighted, sums):
    """All sources together give what each gives alone, whether arcs are followed one by one or summed over all neighbours."""
    import random

    rng = random.Random(3)
    for n, p in ((1, 0.5), (9, 0.3), (40, 0.1), (60, 0.5)):
        pairs = [(u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < p and (u < n // 4) == (v < n // 4)]
        g = centrality.Graph([f"{a:02}" for a, _ in pairs], [f"{b:02}" for _, b in pairs], [rng.choice([1, 1, 1, 2, 2, 3, 7]) for _ in pairs], [f"{v:02}" for v in range(n)])
        arcs = centrality.Arcs(g, weighted)
        monkeypatch.setattr(centrality, "_pays", lambda *_: False)
        alone = [centrality.from_source(arcs, s) for s in range(n)]
        monkeypatch.setattr(centrality, "_pays", lambda g, arcs, k: sums and arcs > 0)
        share, far, reached = centrality.from_sources(arcs, np.arange(n))
        assert [r for _, _, r in alone] == reached.tolist() == arcs.size.tolist()
        assert far.tolist() == pytest.approx([f for _, f, _ in alone]) and share == pytest.approx(np.array([x for x, _, _ in alone]))


def test_sums_over_neighbours_are_exact():
    """Blocks of like degree, a node of very many arcs and one of none; whole numbers stay exact in the type chosen for them."""
    near = [[1, 2], [0], list(range(1000)), [], *[[2, k] for k in range(100)]]
    at = np.cumsum([0, *map(len, near)])
    sums = centrality.Sums(np.append(at, np.full(1000 - len(near), at[-1])), np.concatenate(near).astype(np.int32))
    for most in (60, 10_000, 10**6, 10**12):
        x = np.append(np.random.default_rng(1).integers(most // 2, most, 1000), 0).astype(np.float64)
        want = [float(sum(int(x[v]) for v in row)) for row in near]
        held = np.stack([x, x[::-1]], 1)
        held[-1] = 0
        assert sums.push(held.astype(centrality._narrow(most, 1000)))[: len(near), 0].tolist() == want
        assert sums.pull(np.arange(len(near)), x).tolist() == want


def test_adjacency(spark):
    rows = [(1, k, s) for k, s in enumerate(["a", "b", "", "b", "a", None, "c"])] + [(2, 0, "c"), (2, 1, "a")]
    got = network.adjacency(spark.createDataFrame(rows, "m int, k int, s string"), ["m"], ["k"], "s").collect()
    assert {(r.src, r.dst, r.weight) for r in got} == {("a", "b", 2), ("a", "c", 2)}


def test_cosine_of_zero(spark):
    assert spark.range(1).select(network.cosine(F.array(F.lit(0)), F.array(F.lit(1))), network.cosine(F.array(F.lit(3), F.lit(4)), F.array(F.lit(6), F.lit(8)))).first() == (None, 1.0)


def test_surge_windows(spark):
    rows = [("A", k, float(v)) for k, v in enumerate([1, 2, 3, 4, 50])] + [("B", k, float(v)) for k, v in enumerate([1, 2, 3])]
    table = spark.createDataFrame(rows, "t string, s int, n double")
    mean = lambda across: [r.n_mean for r in series.surge(table, ["s"], ["n"], ["t"], across=across).orderBy("t", "s").collect()]
    assert mean(True) == [None, None, None, 2.0, 2.5, 2.5, 2.5, 2.5]
    assert mean(False) == [None, None, None, 2.0, 2.5, None, None, None]
    assert [r.n_surge for r in series.surge(table, ["s"], ["n"], ["t"]).orderBy("t", "s").collect()][4]


def test_roster_duplicates(spark):
    rows = spark.createDataFrame([(1, "kim", "X", 1), (1, "kim", "Y", 2), (1, "lee", None, 3)], "t int, name string, Party string, o int")
    party = lambda how, **kw: {r.name: r.Party for r in roster.one_per_name(rows, ["t", "name"], ["o"], how, **kw).collect()}
    assert party("first")["kim"] == "X" and party("last")["kim"] == "Y"
    assert party("merge", attributes=["Party"]) == {"kim": "동명이인(확인필요): X / Y", "lee": ""}
    with pytest.raises(ValueError):
        party("other")


def test_name_inside_takes_the_longest(spark):
    names = spark.createDataFrame([(1, "의장 이승만 박사"), (1, "nobody"), (2, "이승만"), (1, None), (1, "x" * 60 + "이승")], "t int, n string")
    people = spark.createDataFrame([(1, "이승", 2), (1, "이승만", 3), (1, "승만", 1)], "t int, m string, o int")
    assert {(r.t, r.n, r.m) for r in roster.inside(names, people, "t", "n", "m", "o").collect()} == {(1, "의장 이승만 박사", "이승만"), (1, "x" * 60 + "이승", "이승")}


def test_fill_blanks(spark):
    rows = spark.createDataFrame([(1, " "), (2, "b"), (3, None)], "k int, c string")
    src = spark.createDataFrame([(1, "A"), (2, "B")], "k int, c string")
    assert {r.k: r.c for r in roster.fill_blanks(rows, src, ["k"], ["c"]).collect()} == {1: "A", 2: "b", 3: None}


def test_insight_needs_support(spark):
    rows = spark.createDataFrame([("rare", 1, 0.9), ("big", 200, 0.5), ("other", 99, 0.4)], "k string, total long, share double")
    assert rollups.insight(rows, F.col("share"), "k").first().k == "big"


def test_kappa_edges(spark):
    rows = spark.createDataFrame([("x", "x"), ("x", "x"), (None, "y"), ("", "y")], "a string, b string")
    got = agreement.kappa(rows, "a", "b").first()
    assert (got.n, got.agreement, got.kappa) == (2, 1.0, None)
    assert agreement.kappa(rows.limit(0), "a", "b").collect() == []
    assert agreement.agreement(rows, "a", "b").first().agreement == 0.5
    assert agreement.annotators(["Annotator_1", "어노테이터2", "text"]) == ["Annotator_1", "어노테이터2"] and agreement.first_present(["b", "c"], ["a", "c", "b"]) == "c"


def test_rosters(spark, tmp_path):
    (tmp_path / "제1대국회_명단.csv").write_bytes("﻿설명,,\n번호,대수,의원명,소속위원회,정당\n1,1,이 승만,외무,자유당\n2,,허정,,\n".encode())
    (tmp_path / "제2대국회_명단.csv").write_bytes("1,2,조 순,위원회,민주당,서울,남,1,보선\n".encode("cp949"))
    got = {(r.Assembly_Num, r.Speaker): r.Party for r in tables.rosters(spark, str(tmp_path)).collect()}
    assert got == {(1, "이승만"): "자유당", (1, "허정"): None, (2, "조순"): "민주당"}
    assert tables.first_file(spark, str(tmp_path), "제2").endswith(".csv")
    with pytest.raises(FileNotFoundError):
        tables.first_file(spark, str(tmp_path), "없음")


def test_csv_of_long_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿Title,Content\nt,"a ""b""\nc"\n', encoding="utf-8")
    got = tables.minutes(spark, str(tmp_path / "m.csv"))
    assert got.columns == ["Title", "Content"] and got.first().Content == 'a "b"\nc'


def record(tag, body):
    size = len(body)
    return struct.pack("<I", tag | min(size, 0xFFF) << 20) + (struct.pack("<I", size) if size >= 0xFFF else b"") + body


def compound(streams):
    """A compound file of sectors of 512 bytes whose streams are all as long as its cutoff or longer."""
    names = ["Root Entry", *streams]
    sectors, fat, entries = [], [], []

    def add(data):
        first, n = len(sectors), max(1, -(-len(data) // 512))
        for k in range(n):
            sectors.append(data[512 * k : 512 * (k + 1)].ljust(512, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else 0xFFFFFFFE)
        return first

    def entry(name, kind, left, right, child, start, size):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + struct.pack("<III", left, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    none = 0xFFFFFFFF
    body = [n for n in streams if "/" in n]
    top = [n for n in streams if "/" not in n]
    order = ["Root Entry", *top, "BodyText", *body]
    at = {n: k for k, n in enumerate(order)}
    starts = {n: add(streams[n]) for n in streams}
    for n in order:
        if n == "Root Entry":
            entries.append(entry(n, 5, none, none, at[top[0]], 0xFFFFFFFE, 0))
        elif n == "BodyText":
            entries.append(entry(n, 1, none, none, at[body[0]], 0, 0))
        else:
            same = body if n in body else [*top, "BodyText"]
            nxt = same[same.index(n) + 1] if same.index(n) + 1 < len(same) else None
            entries.append(entry(n.split("/")[-1], 2, none, at[nxt] if nxt else none, none, starts[n], len(streams[n])))
    directory = add(b"".join(entries))
    fat_at = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack("<128I", *(fat + [none] * (128 - len(fat)))))
    head = documents.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, directory, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", fat_at, *[none] * 108) + b"".join(sectors)


def hwp_file(text, packed=True, cut=0):
    units = text.encode("utf-16-le") + struct.pack("<8H", 9, 0, 0, 0, 0, 0, 0, 9) + "끝".encode("utf-16-le") + struct.pack("<H", 13)
    section = record(66, b"x" * 5000) + record(documents.PARA_TEXT, units)
    section = section[: len(section) - cut]
    body = section
    if packed:
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        body = c.compress(section) + c.flush()
    head = bytes(36) + bytes([int(packed)]) + bytes(219)
    return compound({"FileHeader": head, "BodyText/Section0": body, "BodyText/Section1": body})


@pytest.mark.parametrize("packed", [True, False])
def test_hwp(packed):
    status, text, error = documents.hwp(hwp_file("의장 말씀", packed))
    assert (status, error) == (documents.OK, None) and text.split("\n")[0] == "의장 말씀\t끝"


def test_hwp_damage():
    status, text, error = documents.hwp(hwp_file("의장 말씀", False, cut=4))
    assert status == documents.PARTIAL and text.startswith("의장 말씀") and "truncated" in error
    assert documents.hwp(b"no document")[0] == documents.FAILED and documents.hwp(b"")[0] == documents.FAILED


def test_landing_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "회의 (1949.01.10.).hwp").write_bytes(hwp_file("의장 말씀"))
    (inbox / "나쁨.hwp").write_bytes(b"xx")
    places = [str(tmp_path / n) for n in ("out", "failed", "checkpoint")]
    for _ in range(2):  # a restart reads nothing again
        landing.ingest(spark, str(inbox), *places).awaitTermination()
    got = spark.read.parquet(places[0]).collect()
    assert [(r.Title, r.Date, r.Content.split("\n")[0]) for r in got] == [("회의", "1949-01-10", "의장 말씀 끝")]
    assert spark.read.parquet(places[1]).first().Status == documents.FAILED


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A & <b>", 3, "#ff0000"), ("b", "B", None, None)], "id string, label string, n int, colour string")
    sinks.gexf(nodes, spark.createDataFrame([("a", "b", None)], "src string, dst string, weight double"), str(tmp_path / "g.gexf"), "colour")
    import xml.etree.ElementTree as ET

    root = ET.parse(tmp_path / "g.gexf").getroot()
    assert len(root.findall(".//{*}node")) == 2 and root.find(".//{*}edge").get("weight") == "0.0" and root.find(".//{*}color").get("r") == "255"
    sinks.json_file(spark.createDataFrame([(1, "말")], "a int, b string"), str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 1, "b": "말"}
    sinks.csv_file(nodes.select("id", "label"), str(tmp_path / "x.csv"), "id")
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfid,label")
    sinks.svg_timeline(spark.createDataFrame([(1950, "p", 2.0, "<t>"), (1951, "q", None, "u")], "x int, y string, s double, l string"), str(tmp_path / "t.svg"), "x", "y", "s", "l")
    assert len(ET.parse(tmp_path / "t.svg").getroot().findall("{*}circle")) == 2
    for n in (1, 2):
        sinks.swap(spark.range(n), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2 and spark.read.parquet(str(tmp_path / "table.bak")).count() == 1


def test_roster_join_all_keeps_the_whole_roster_and_unmatched_speakers(spark, tmp_path):
    spark.createDataFrame([(k, f"P{k}") for k in range(1, 7)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k, 1.0) for k in range(1, 9)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_custkey: (r.Party, r.Speaker_Type) for r in value_queries.roster_join_all(spark, str(tmp_path)).collect()}
    assert got == {k: (f"P{k}", "의원") if k < 7 else ("미상/직책자", "미상/직책자") for k in range(1, 9)}
