"""Rollups by keys, with rates, shares, presence, pivots and insights. All aggregate on the map side first."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from hustings.functions import lexicons as lx
from hustings.functions import text as tx


def measures(keywords: Sequence[str], chars: str = "Speech_Chars", others: Sequence[str] = ("Discourse_Development", "Discourse_Boundary", "Keyword_Total")) -> list[Column]:
    """Sums of keywords, subtotals and characters, and the count of speeches."""
    return [F.sum(k).alias(k) for k in (*keywords, *others)] + [F.count("*").alias("Speeches"), F.sum(chars).alias("Chars")]


def distinct(c: str) -> Column:
    """Distinct values, null being one."""
    return F.countDistinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def joined(c: str, sep: str = "; ") -> Column:
    """Sorted distinct values as one string, blanks left out."""
    return F.array_join(F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))), sep)


def rollup(rows: DataFrame, keys: Sequence[str], *aggs: Column, where: Column | None = None) -> DataFrame:
    """Aggregates by keys; `where` filters the rows first."""
    return (rows if where is None else rows.filter(where)).groupBy(*keys).agg(*aggs)


def most_frequent(c: str, among: Column | None = None) -> Column:
    """The most frequent value that isn't null, the smallest of equally frequent ones; `among` chooses the rows."""
    value = F.col(c) if among is None else F.when(among, F.col(c))
    return F.mode(value, True)


def speaker_summary(rows: DataFrame, keys: Sequence[str] = ("Assembly_Num", "Speaker"), keywords: Sequence[str] = (), others: Sequence[str] = ("Discourse_Development", "Discourse_Boundary", "Keyword_Total"), chars: str = "Speech_Chars") -> DataFrame:
    """One row for each named speaker of a term: the modes of party, type, title and source, all role groups, sessions,
    first and last date, sums and rates. A speaker without a party or title has null there."""
    return rates(rollup(
        rows, keys, most_frequent("Party").alias("Party"), most_frequent("Speaker_Type").alias("Speaker_Type"), most_frequent("Title_Role", F.col("Title_Role") != "").alias("Primary_Role"),
        joined("Role_Group").alias("Role_Groups"), most_frequent("Speaker_Source").alias("Speaker_Source"), distinct("Session_No").alias("Active_Sessions"),
        F.min("Date").alias("First_Speech_Date"), F.max("Date").alias("Last_Speech_Date"), *measures(keywords, chars, others), where=F.col(keys[-1]) != "",
    ), over=keys[:1])


def nonparty_summary(rows: DataFrame, keys: Sequence[str] = ("Assembly_Num", "Role_Group", "Speaker"), keywords: Sequence[str] = (), others: Sequence[str] = ("Discourse_Development", "Discourse_Boundary", "Keyword_Total"), chars: str = "Speech_Chars", member: str = lx.MEMBER) -> DataFrame:
    """Named speakers that are no members, by role group, with their most frequent title."""
    where = (F.col("Speaker_Type") != member) & (F.col(keys[-1]) != "")
    return rates(rollup(rows, keys, most_frequent("Title_Role").alias("Primary_Role"), *measures(keywords, chars, others), where=where), over=keys[:1])


def year_summary(rows: DataFrame, year: str = "Year", speaker: str = "Speaker", keywords: Sequence[str] = (), others: Sequence[str] = ("Discourse_Development", "Discourse_Boundary", "Keyword_Total"), chars: str = "Speech_Chars") -> DataFrame:
    """Sums and rates by year, its distinct speakers, and the boundary's share of both discourses, null without any."""
    out = rates(rollup(rows, [year], distinct(speaker).alias("Distinct_Speakers"), *measures(keywords, chars, others)))
    development, boundary = others[0], others[1]
    return out.withColumn("Boundary_Ratio", F.round(F.try_divide(F.col(boundary).cast("double"), F.col(development) + F.col(boundary)), 4))


def rates(table: DataFrame, over: Sequence[str] | None = None, chars: str = "Chars", of: Mapping[str, str] | None = None, per: int = 1000, digits: int = 3) -> DataFrame:
    """Adds a rate per so many characters for each of `of` (new name -> column), null without characters, and with
    `over` the Share_of_Chars among rows of its keys."""
    of = of or {"Total_per_1k": "Keyword_Total", "Dev_per_1k": "Discourse_Development", "Bnd_per_1k": "Discourse_Boundary"}
    table = table.withColumns({n: F.round(F.try_divide(F.col(c) * F.lit(float(per)), F.col(chars)), digits) for n, c in of.items()})
    if over is not None:
        table = table.withColumn("Share_of_Chars", F.round(F.try_divide(F.col(chars).cast("double"), F.sum(chars).over(Window.partitionBy(*over))), 5))
    return table


def presence(rows: DataFrame, who: Sequence[str], session: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """For each of who, in how many sessions each keyword occurs."""
    by_session = rows.groupBy(*who, *session).agg(*[F.sum(k).alias(k) for k in keywords])
    return by_session.groupBy(*who).agg(*[F.sum((F.col(k) > 0).cast("long")).alias(f"{k}_sessions") for k in keywords], F.count("*").alias("sessions"))


def per_words(table: DataFrame, keywords: Sequence[str], words: str, per: int = 10_000, digits: int = 2) -> DataFrame:
    return table.withColumns({f"{k}_per_{per}": F.round(F.try_divide(F.col(k) * F.lit(float(per)), F.col(words)), digits) for k in keywords})


def per_head(table: DataFrame, columns: Sequence[str], head: str, name: str) -> DataFrame:
    """Adds the sum of some columns for each speech or speaker, null without any."""
    return table.withColumn(name, F.try_divide(tx.total(*[F.col(c) for c in columns]).cast("double"), F.col(head)))


def per_member(parties: DataFrame, members: DataFrame, on: Sequence[str], keywords: Sequence[str], words: str, per: int = 10_000, digits: int = 2) -> DataFrame:
    """Party sums with their members (0 where the roster has none), keywords per so many words and per member, 0 where
    there are no words or members."""
    out = parties.join(members, list(on), "left").withColumn("members", F.coalesce("members", F.lit(0)))
    ratio = lambda k, by, times: F.round(F.coalesce(F.try_divide(F.col(k) * F.lit(float(times)), F.col(by)), F.lit(0.0)), digits)
    return out.withColumns({f"{k}_per_{per}": ratio(k, words, per) for k in keywords} | {f"{k}_per_member": ratio(k, "members", 1) for k in keywords})


def class_counts(rows: DataFrame, keys: Sequence[str], label: str, classes: Sequence[str], total: str = "total") -> DataFrame:
    """Rows by class for each key, the total, the related ones (all but the last class) and each class in percent of all."""
    out = rows.groupBy(*keys).agg(F.count("*").alias(total), *[F.sum((F.col(label) == c).cast("long")).alias(c) for c in classes])
    related = sum((F.col(c) for c in classes[1:-1]), F.col(classes[0]))
    return out.withColumn("related", related).withColumns({f"{c}_pct": F.round(100.0 * F.col(c) / F.col(total), 4) for c in classes})


def group_stats(rows: DataFrame, dimension: str, label: str, classes: Sequence[str], unknown: str) -> DataFrame:
    """class_counts by a dimension whose blanks have a name."""
    return class_counts(rows.withColumn(dimension, tx.blank_to(F.col(dimension), F.lit(unknown))), [dimension], label, classes)


def pivot(rows: DataFrame, keys: Sequence[str], across: str, values: Sequence, agg: Column) -> DataFrame:
    """A dense table: a column for each value, 0 where there is nothing."""
    return rows.groupBy(*keys).pivot(across, list(values)).agg(agg).na.fill(0)


def top(table: DataFrame, n: int, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """The first n rows, of each of `by` if there are any. The order must be total to be repeatable."""
    if not by:
        return table.orderBy(*order).limit(n)
    return table.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def top_by_period(exploded: DataFrame, value: str, period: str, unit: Sequence[str], n: int = 25) -> DataFrame:
    """(value, period, units): in how many units each of the n most frequent values occurs, by period."""
    once = exploded.select(value, period, *unit).distinct()
    best = once.groupBy(value).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), value).limit(n)
    return once.join(F.broadcast(best.select(value)), value, "left_semi").groupBy(value, period).agg(F.count("*").alias("units"))


def row_share(table: DataFrame, by: Sequence[str], count: str, name: str = "share", scale: float = 100.0) -> DataFrame:
    """Each count in parts of its rows' sum."""
    return table.withColumn(name, F.try_divide(F.col(count) * F.lit(scale), F.sum(count).over(Window.partitionBy(*by))))


def values_of(frame: DataFrame, column: str, most: int = 10_000) -> list:
    """The distinct non-null values of a small dimension in order; ValueError beyond `most` of them."""
    found = [r[0] for r in frame.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


def dense(table: DataFrame, axes: Sequence[tuple[str, Sequence]], count: str, most: int = 1_000_000) -> DataFrame:
    """Every combination of the axes' values, with 0 where table has none. Axes are value lists; ValueError beyond `most`
    combinations."""
    if math.prod(len(v) for _, v in axes) > most:
        raise ValueError(f"more than {most} combinations")
    spine = table.sparkSession.range(1).drop("id")
    for name, values in axes:
        kind = table.schema[name].dataType
        spine = spine.select("*", F.explode(F.array(*[F.lit(v) for v in values]).cast(ArrayType(kind))).alias(name))
    return spine.join(table, [n for n, _ in axes], "left").na.fill(0, [count])


def insight(table: DataFrame, by: Column, *tie: str, total: str = "total", floor: int = 3, share: float = 0.03) -> DataFrame:
    """The row with the largest `by` among those with support: a total of max(floor, share of all), or all rows if none has."""
    least = F.greatest(F.lit(floor), F.floor(table.agg(F.sum(total)).scalar() * F.lit(share)))
    supported = table.withColumn("_ok", (F.col(total) >= least).cast("int"))
    return supported.orderBy(F.desc("_ok"), by.desc(), *tie).limit(1).drop("_ok")


def insights(tables: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(name, item, value): of each named table (frame, item column, value column) the item of largest value, the first
    in order on ties. One row for each table that has any; rows without a value count for nothing."""
    whole = None
    for name, (frame, item, value) in tables.items():
        best = frame.filter(F.col(value).isNotNull()).agg(F.max(F.col(value).cast("double")).alias("value"), F.min_by(F.col(item).cast("string"), F.struct(-F.col(value).cast("double"), F.col(item).cast("string"))).alias("item"))
        one = best.filter("value IS NOT NULL").select(F.lit(name).alias("name"), "item", "value")
        whole = one if whole is None else whole.unionByName(one)
    return whole


def document_frequency(hits: DataFrame, words: str = "words") -> DataFrame:
    """(keyword, texts): in how many texts each keyword occurs, from keywords.hits()."""
    return hits.select(F.explode(F.array_distinct(words)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("texts"))


def family_profile(hits: DataFrame, who: str, families: Sequence[str], most: int, held: str = "families") -> DataFrame:
    """(who, family, count, rate): for the `most` of who with most texts, texts that hold a family and their percentage."""
    by = hits.filter(F.coalesce(F.col(who).cast("string"), F.lit("")) != "").groupBy(who)
    wide = by.agg(F.count("*").alias("_n"), *[F.sum(F.array_contains(held, f).cast("long")).alias(f"_{k}") for k, f in enumerate(families)])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"_{k}").alias("count")) for k, f in enumerate(families)])).alias("r")
    return wide.orderBy(F.desc("_n"), who).limit(most).select(who, "_n", rows).select(who, "r.family", "r.count", F.round(100.0 * F.col("r.count") / F.col("_n"), 4).alias("rate"))


def leading(rows: DataFrame, who: str, period: str, most: int = 15) -> DataFrame:
    """(who, period, n) of the `most` of who with most rows."""
    named = rows.filter(F.coalesce(F.col(who).cast("string"), F.lit("")) != "")
    best = named.groupBy(who).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), who).limit(most)
    return named.join(F.broadcast(best.select(who)), who, "left_semi").groupBy(who, period).agg(F.count("*").alias("n"))


def party_base(hits: DataFrame, party: str, speaker: str, families: Sequence[str], most: int = 12, held: str = "families") -> DataFrame:
    """The parties with most texts of named speakers: texts, related ones and their percentage, and texts by family."""
    named = hits.filter((F.coalesce(tx.strip(F.col(party)), F.lit("")) != "") & (F.coalesce(F.col(speaker).cast("string"), F.lit("")) != ""))
    by = named.groupBy(party).agg(F.count("*").alias("total"), F.sum((F.size(held) > 0).cast("long")).alias("related"), *[F.sum(F.array_contains(held, f).cast("long")).alias(f) for f in families])
    return by.withColumn("related_pct", F.round(100.0 * F.col("related") / F.col("total"), 4)).orderBy(F.desc("total"), party).limit(most)


def party_cube(hits: DataFrame, parties: Sequence[str], party: str, period: str, families: Sequence[str], held: str = "families") -> DataFrame:
    """(party, family, period, n): every combination of the parties, the families and the periods that the parties speak in."""
    own = hits.filter(F.col(party).isin(list(parties)))
    counts = own.select(party, period, F.explode(F.array_distinct(held)).alias("family")).groupBy(party, "family", period).agg(F.count("*").alias("n"))
    return dense(counts, [(party, list(parties)), ("family", list(families)), (period, values_of(own, period))], "n")


def missing(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing): nulls and blanks."""
    one = rows.agg(*[F.sum(F.when(F.coalesce(tx.strip(F.col(c).cast("string")), F.lit("")) == "", 1).otherwise(0)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("r")).select("r.*")
