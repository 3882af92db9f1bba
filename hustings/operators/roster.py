"""Rosters: duplicates, equi-joins, and names inside longer names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hustings.functions import lexicons as lx
from hustings.functions import text as tx


def one_per_name(roster: DataFrame, key: Sequence[str], order: Sequence[str], on_duplicate: str = "first", attributes: Sequence[str] = (), party: str = "Party") -> DataFrame:
    """One row for each key: the first or the last in order, or, merged, the attributes of all where parties differ."""
    if on_duplicate in ("first", "last"):
        w = Window.partitionBy(*key).orderBy(*[F.asc(c) if on_duplicate == "first" else F.desc(c) for c in order])
        return roster.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    if on_duplicate != "merge":
        raise ValueError(on_duplicate)
    sets = {c: F.sort_array(F.collect_set(F.coalesce(c, F.lit("")))) for c in attributes}
    grouped = roster.groupBy(*key).agg(F.countDistinct(party).alias("n_dup"), *[s.alias(c) for c, s in sets.items()])
    merged = {c: F.when(F.col("n_dup") > 1, F.concat(F.lit(lx.HOMONYM), F.array_join(c, " / "))).otherwise(F.col(c)[0]) for c in attributes}
    return grouped.select(*key, "n_dup", *[m.alias(c) for c, m in merged.items()])


def join_roster(speeches: DataFrame, roster: DataFrame, key: Sequence[str] = ("Speaker", "Assembly_Num"), party: str = "Party", unknown: str = lx.UNKNOWN_OR_OFFICER) -> DataFrame:
    """Left join; adds Speaker_Type from the party as the roster has it, then names missing parties. Spark broadcasts
    the roster when its size allows."""
    out = speeches.join(roster, list(key), "left")
    return out.withColumns({"Speaker_Type": F.when(F.col(party).isNotNull(), lx.MEMBER).otherwise(lx.UNKNOWN_OR_OFFICER), party: F.coalesce(party, F.lit(unknown))})


def inside(names: DataFrame, roster: DataFrame, group: str, name: str, member: str, order: str, most_letters: int = 40) -> DataFrame:
    """(group, name, member): the longest roster name that a name contains, of the same group; ties take the first in order.

    Works on distinct names: each gives its substrings, which meet the roster in an equi-join, so no group pairs all
    names with all members. Names beyond most_letters are compared with `contains`, within their group.
    """
    own = names.select(group, name).filter(F.col(name).isNotNull()).distinct().withColumn("_bare", tx.bare(F.col(name)))
    who = roster.groupBy(group, member).agg(F.min(order).alias("_o")).filter(F.char_length(member) > 0)
    n = F.char_length("_bare")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda a: F.transform(F.sequence(a, F.greatest(n, F.lit(1))), lambda b: F.col("_bare").substr(a, b - a + 1))))
    short = own.filter(n <= most_letters).withColumn("_part", F.explode(F.array_distinct(spans)))
    hits = short.join(who.withColumnRenamed(member, "_part").withColumn(member, F.col("_part")), [group, "_part"]).select(group, name, member, "_o")
    long = own.filter(n > most_letters).join(who, group).filter(F.contains("_bare", member)).select(group, name, member, "_o")
    w = Window.partitionBy(group, name).orderBy(F.desc(F.char_length(member)), "_o", member)
    return hits.union(long).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(group, name, member)


def fill_blanks(rows: DataFrame, source: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Blank cells from the source's row of the same key; other cells stay."""
    src = source.select(*key, *[F.col(c).alias(f"_src_{c}") for c in columns])
    out = rows.join(src, list(key), "left")
    return out.withColumns({c: tx.blank_to(F.col(c), F.coalesce(f"_src_{c}", F.col(c))) for c in columns}).drop(*[f"_src_{c}" for c in columns])


def member_counts(roster: DataFrame, party: str = "Party", member: str = "Speaker") -> DataFrame:
    return roster.groupBy(party).agg(F.countDistinct(member).alias("members"))
