"""Speech networks as edge tables: undirected edges have src < dst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hustings.functions import text as tx


def _pair(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")


def adjacency(speeches: DataFrame, meeting: Sequence[str], order: Sequence[str], speaker: str, by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """(by, src, dst, weight): how often two named speakers follow each other in a meeting. Nameless rows are passed over."""
    named = speeches.filter(F.coalesce(F.col(speaker).cast("string"), F.lit("")) != "")
    w = Window.partitionBy(*meeting).orderBy(*order)
    turns = named.withColumn("_prev", F.lag(speaker).over(w)).filter(F.col("_prev") != F.col(speaker))
    return turns.groupBy(*by, *_pair("_prev", speaker)).agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def flow(speeches: DataFrame, meeting: str, order: Sequence[str], speaker: str, shown: Sequence[str], examples: int = 3) -> DataFrame:
    """adjacency over the whole period, with the first examples of each edge as JSON. No edge gathers all its turns: the
    first ones are chosen by rank before they are collected."""
    named = speeches.filter(F.coalesce(F.col(speaker).cast("string"), F.lit("")) != "")
    w = Window.partitionBy(meeting).orderBy(*order)
    turns = named.withColumn("_prev", F.lag(speaker).over(w)).filter(F.col("_prev") != F.col(speaker)).select(*_pair("_prev", speaker), meeting, *order, *[c for c in shown if c not in (meeting, *order)])
    edges = turns.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy(meeting, *order))
    first = turns.withColumn("_r", rank).filter(F.col("_r") <= examples)
    some = first.groupBy("src", "dst").agg(F.sort_array(F.collect_list(F.struct("_r", F.struct(*shown).alias("e")))).alias("l"))
    return edges.join(some.select("src", "dst", F.to_json(F.transform("l", lambda x: x["e"])).alias("examples")), ["src", "dst"])


def cooccurrence(rows: DataFrame, unit: Sequence[str], value: str, least: int = 1, most_frequent: int | None = None) -> DataFrame:
    """(src, dst, weight): in how many units two values occur together; with most_frequent only among the values that
    the most units hold. A unit holds few different values, as a lexicon is small."""
    once = rows.select(*unit, value).distinct()
    if most_frequent is not None:
        best = once.groupBy(value).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), value).limit(most_frequent)
        once = once.join(F.broadcast(best.select(value)), value, "left_semi").select(*unit, value)
    sets = once.groupBy(*unit).agg(F.sort_array(F.collect_set(value)).alias("s")).filter(F.size("s") > 1)
    one = sets.select("s", F.posexplode("s").alias("i", "src"))
    pairs = one.select("src", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def symmetric(edges: DataFrame) -> DataFrame:
    """(node, other, weight) in both directions."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").union(edges.select("dst", "src", "weight"))


def top_subgraph(edges: DataFrame, nodes: DataFrame, node: str, n: int, *order: Column) -> DataFrame:
    """Edges among the first n nodes."""
    keep = nodes.orderBy(*order).limit(n).select(F.col(node).alias("k"))
    return edges.join(F.broadcast(keep), F.col("src") == F.col("k"), "left_semi").join(F.broadcast(keep), F.col("dst") == F.col("k"), "left_semi")


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def stance_nodes(rows: DataFrame, term: str, session: str, party: str, keywords: Sequence[str], chars: str, least: int = 2000) -> DataFrame:
    """(term, session, party, chars, v): keywords per 1000 characters, of parties with enough of them in a session."""
    by = rows.groupBy(F.col(term).alias("term"), F.col(session).alias("session"), F.col(party).alias("party")).agg(F.sum(chars).alias("chars"), *[F.sum(k).alias(k) for k in keywords])
    return by.filter(F.col("chars") >= least).withColumn("v", F.array(*[F.col(k) * 1000.0 / F.col("chars") for k in keywords])).select("term", "session", "party", "chars", "v")


def stance_within(nodes: DataFrame, digits: int = 4) -> DataFrame:
    """Similar stances of two parties in a session; pairs without a defined cosine go."""
    a, b = (nodes.select("term", "session", F.col("party").alias(p), F.col("v").alias(f"v{p}")) for p in ("src", "dst"))
    pairs = a.join(b, ["term", "session"]).filter("src < dst").withColumn("weight", F.round(cosine(F.col("vsrc"), F.col("vdst")), digits))
    return pairs.filter("weight IS NOT NULL").select("term", "session", "src", "dst", "weight")


def stance_over_time(nodes: DataFrame, digits: int = 4) -> DataFrame:
    """A party's consecutive sessions; the weight is null where undefined."""
    w = Window.partitionBy("term", "party").orderBy("session")
    steps = nodes.withColumns({"to_session": F.lead("session").over(w), "_v": F.lead("v").over(w)}).filter("to_session IS NOT NULL")
    return steps.select("term", "party", F.col("session").alias("from_session"), "to_session", F.round(cosine(F.col("v"), F.col("_v")), digits).alias("weight"))


def ego(edges: DataFrame, centre: str, n: int = 12) -> DataFrame:
    """Edges among a node and its n strongest neighbours."""
    near = symmetric(edges).filter(F.col("node") == F.lit(centre)).orderBy(F.desc("weight"), "other").limit(n).select(F.col("other").alias("k"))
    keep = F.broadcast(near.union(near.sparkSession.createDataFrame([(centre,)], near.schema)))
    return edges.join(keep, F.col("src") == F.col("k"), "left_semi").join(keep, F.col("dst") == F.col("k"), "left_semi")


def timeline(speeches: DataFrame, meeting: Sequence[str], order: Sequence[str], speaker: str, year: str, edges: DataFrame, n: int = 35) -> DataFrame:
    """Yearly adjacency among the n speakers of highest degree, others being passed over."""
    best = symmetric(edges).groupBy("node").agg(F.count("*").alias("d")).orderBy(F.desc("d"), "node").limit(n).select(F.col("node").alias(speaker))
    return adjacency(speeches.join(F.broadcast(best), speaker, "left_semi"), meeting, order, speaker, by=[year])


def party_speakers(rows: DataFrame, party: str, speaker: str, n: int = 6) -> DataFrame:
    """(src, dst, weight): each party's n speakers with most speeches."""
    by = rows.groupBy(F.col(party).alias("src"), F.col(speaker).alias("dst")).agg(F.count("*").alias("weight"))
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return by.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def knowledge_graph(speeches: DataFrame, speaker: str, key: str, order: Sequence[str], families: str, keywords: str, attributes: Sequence[str], speakers: int = 35, events: int = 120, words: int = 25) -> DataFrame:
    """(src, relation, dst): speakers and their attributes; the first related speeches, their speakers, families and
    keywords. families and keywords are arrays; a speech is related if it has any."""
    related = speeches.filter((F.size(families) > 0) & (F.coalesce(F.col(speaker), F.lit("")) != ""))
    best = related.groupBy(speaker).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), speaker).limit(speakers).select(speaker)
    own = related.join(F.broadcast(best), speaker, "left_semi")
    chosen = own.orderBy(*order, key).limit(events)
    top = related.select(F.explode(F.array_distinct(keywords)).alias("w")).groupBy("w").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "w").limit(words).select("w")
    out = [own.filter(tx.strip(F.col(a).cast("string")) != "").select(F.col(speaker).alias("src"), F.lit(a).alias("relation"), F.col(a).cast("string").alias("dst")) for a in attributes]
    out.append(chosen.select(F.col(key).cast("string").alias("src"), F.lit("speaker").alias("relation"), F.col(speaker).alias("dst")))
    out.append(chosen.select(F.col(key).cast("string").alias("src"), F.lit("family").alias("relation"), F.explode(families).alias("dst")))
    held = chosen.select(F.col(key).cast("string").alias("src"), F.lit("keyword").alias("relation"), F.explode(keywords).alias("dst"))
    out.append(held.join(F.broadcast(top), F.col("dst") == F.col("w"), "left_semi"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


def validation(speeches: DataFrame, meeting: str, seq: str, speaker: str, attributes: Sequence[str]) -> DataFrame:
    """(item, n): rows that share their meeting and number, and speakers with several values of an attribute."""
    same = speeches.groupBy(meeting, seq).agg(F.count("*").alias("k")).filter("k > 1").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).select(F.lit("duplicate_rows").alias("item"), "n")
    for a in attributes:
        given = speeches.filter(F.coalesce(tx.strip(F.col(a).cast("string")), F.lit("")) != "")
        many = given.groupBy(speaker).agg(F.countDistinct(a).alias("k")).filter("k > 1").agg(F.count("*").alias("n"))
        same = same.union(many.select(F.lit(f"speakers_with_several_{a}").alias("item"), "n"))
    return same
