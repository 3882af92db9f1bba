"""Speech headers: titles by a grammar, names by a gazetteer that the data can extend."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hustings.functions import lexicons as lx
from hustings.functions import text as tx

TITLE = f"(?:(?:{'|'.join(lx.TITLE_CORE)})(?:{'|'.join(lx.TITLE_SUFFIX)})?)"
# What may stand between and after the parts of a header.
SEPARATOR = r"[\s,.·․‧・:：]*"
BRACKETS = r"(?:\([^)]{0,30}\))?"
BOUND = r"(?:[\s,.·、，]+|\z)"
GENERIC = r"[가-힣]{2,4}"
GUESS_AFTER_TITLE = rf"^({GENERIC}){BRACKETS}(?:[\s,.·]+|\z)"
GUESS_BEFORE_TITLE = rf"^({GENERIC}){BRACKETS}[\s,·]*({TITLE}){BRACKETS}{BOUND}"
#: Stands between the parts of a parsed header; no header begins with it.
_MARK = "\x01"


def _branches(node: dict) -> str:
    """A pattern for what may follow a node of the names' trie, the longest name first."""
    more = "|".join(re.escape(ch) + _branches(child) for ch, child in sorted(node.items()) if ch)
    if not more:
        return ""
    return rf"(?:\s*(?:{more}))" + ("?" if "" in node else "")


def names_pattern(names: Iterable[str]) -> str:
    """Any of the names, longest first, with white space between letters or not; nothing when there are none.

    Names that begin alike share their beginning, so a name is looked for letter by letter however many there are.
    """
    root: dict = {}
    for name in names:
        if name and len(name) >= 2:
            node = root
            for ch in name:
                node = node.setdefault(ch, {})
            node[""] = {}
    return "(?:" + "|".join(re.escape(ch) + _branches(child) for ch, child in sorted(root.items())) + ")" if root else r"(?!)"


def parse(rows: DataFrame, names: Iterable[str], chunk: str = "Speech_Chunk") -> DataFrame:
    """Adds Title_Role, Speaker and Speech: title and known name in either order, title alone, or known name alone.

    One pass over the whole chunk takes it apart, whatever stands between the parts; a chunk whose title is also a
    known name has both. A null chunk gives nulls in Speech and '' elsewhere.
    """
    name, part = names_pattern(names), BRACKETS + BOUND
    header = f"^(?:({TITLE}){BRACKETS}{SEPARATOR}({name}){part}|({name}){BRACKETS}{SEPARATOR}({TITLE}){part}|({TITLE}){part}|({name}){part})"
    c = F.col(chunk)
    apart = F.split(tx.replace(c, header + r"([\s\S]*)", rf"{_MARK}$1$4$5{_MARK}$2$3$6{_MARK}$7"), _MARK, 4)
    out = rows.withColumn("_parts", F.when(~c.startswith(_MARK), apart)).withColumn("_parts", F.when(F.size("_parts") == 4, F.col("_parts")))
    title, who = (F.coalesce(F.col("_parts")[k], F.lit("")) for k in (1, 2))
    alone = F.when((title != "") & (who == ""), F.coalesce(tx.extract(c, f"^({name}){part}"), F.lit(""))).otherwise(who)
    return out.withColumns({"Title_Role": title, "Speaker": tx.replace(alone, r"\s+"), "Speech": tx.strip(F.when(F.col("_parts").isNotNull(), F.col("_parts")[3]).otherwise(c))}).drop("_parts")


def guess(rows: DataFrame) -> DataFrame:
    """Names that nobody listed: after a title, or before one. Adds _fallback_used; stop words are no names."""
    stop = list(lx.STOPWORDS)
    speech, role, who = F.col("Speech"), F.col("Title_Role"), F.col("Speaker")
    found = tx.extract(speech, GUESS_AFTER_TITLE)
    after = (role != "") & (who == "") & found.isNotNull() & ~found.isin(stop)
    rows = rows.withColumns({
        "Speaker": F.when(after, found).otherwise(who), "Speech": F.when(after, tx.strip(tx.replace(speech, GUESS_AFTER_TITLE))).otherwise(speech),
        "_fallback_used": F.coalesce(after, F.lit(False)),
    })
    found, title = tx.extract(speech, GUESS_BEFORE_TITLE), tx.extract(speech, GUESS_BEFORE_TITLE, 2)
    before = (role == "") & (who == "") & found.isNotNull() & ~found.isin(stop)
    return rows.withColumns({
        "Speaker": F.when(before, found).otherwise(who), "Title_Role": F.when(before, title).otherwise(role),
        "Speech": F.when(before, tx.strip(tx.replace(speech, GUESS_BEFORE_TITLE))).otherwise(speech), "_fallback_used": F.col("_fallback_used") | F.coalesce(before, F.lit(False)),
    })


def flag_residual(rows: DataFrame) -> DataFrame:
    """Adds Residual_Header_Flag: what is left still begins like a header."""
    end = r"(?:[\s,.·(]|\z)"
    return rows.withColumn("Residual_Header_Flag", tx.has(F.col("Speech"), f"^{TITLE}{end}") | tx.has(F.col("Speech"), rf"^[가-힣]{{2,4}}\s*{TITLE}{end}"))


def candidates(rows: DataFrame, term: str = "Assembly_Num") -> DataFrame:
    """(term, role, residual, n): first five characters after a title of speeches without a name."""
    speech, parsed = F.col("Speech"), F.col("Title_Role") != ""
    role = F.when(parsed, F.col("Title_Role")).otherwise(F.coalesce(tx.extract(speech, f"^({TITLE})"), F.lit("")))
    rest = F.when(parsed, speech).otherwise(tx.replace(speech, f"^{TITLE}"))
    found = rows.filter("Speaker = ''").select(F.col(term).alias("term"), role.alias("role"), F.substring(tx.replace(rest, r"\s+"), 1, 5).alias("residual"))
    return found.filter("role <> '' AND residual <> ''").groupBy("term", "role", "residual").agg(F.count("*").alias("n"))


def learn(counts: DataFrame, min_count: int = 3, min_share: float = 0.03, concentration: float = 0.7) -> DataFrame:
    """(term, role, name, n, distinct_residuals) from candidates: beginnings of two letters that are frequent within
    their role, grown by the next letter while one letter prevails; ties take the smaller letter."""
    keys = ["term", "role"]
    whole = counts.withColumn("all", F.sum("n").over(Window.partitionBy(*keys))).withColumn("p2", F.substring("residual", 1, 2))
    starts = whole.filter(F.char_length("residual") >= 2).groupBy(*keys, "p2").agg(F.sum("n").alias("n2"), F.countDistinct("residual").alias("distinct_residuals"), F.first("all").alias("all"))
    starts = starts.filter((F.col("n2") >= min_count) & (F.col("n2") / F.col("all") >= min_share) & F.col("p2").rlike("^[가-힣]{2}$"))
    now = starts.withColumn("name", F.col("p2"))
    for size in (2, 3):
        longer = whole.select(*keys, "p2", "residual", "n").join(now.select(*keys, "p2", "name"), [*keys, "p2"])
        longer = longer.filter((F.char_length("name") == size) & (F.char_length("residual") > size) & F.col("residual").startswith(F.col("name")))
        nexts = longer.groupBy(*keys, "p2", F.substring("residual", size + 1, 1).alias("ch")).agg(F.sum("n").alias("k"))
        w = Window.partitionBy(*keys, "p2")
        top = nexts.withColumn("share", F.col("k") / F.sum("k").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("k"), "ch")))
        top = top.filter((F.col("r") == 1) & (F.col("share") >= concentration) & F.col("ch").rlike("^[가-힣]$"))
        if size == 3:
            top = top.filter(F.col("p2").isin(list(lx.COMPOUND_SURNAMES)))
        now = now.join(top.select(*keys, "p2", "ch"), [*keys, "p2"], "left").withColumn("name", F.concat("name", F.coalesce("ch", F.lit("")))).drop("ch")
    return now.filter(~F.col("name").isin(list(lx.STOPWORDS))).select(*keys, "name", F.col("n2").alias("n"), "distinct_residuals")


def ledger(chunks: DataFrame, roster_names: Iterable[str], extra_names: Iterable[str] = (), most_names: int = 20_000) -> DataFrame:
    """Both passes: parse by the known names, learn more, parse again, guess, flag; adds Speaker_Source and Role_Group.

    The gazetteer becomes a pattern on the driver; more than most_names learned ones are an error, not a cut.
    """
    known, extra = set(roster_names), set(extra_names)
    learned = {r["name"] for r in learn(candidates(parse(chunks, known | extra))).select("name").distinct().limit(most_names + 1).collect()}
    if len(learned) > most_names:
        raise ValueError(f"more than {most_names} names were learned")
    rows = flag_residual(guess(parse(chunks, known | extra | learned)))
    who = F.col("Speaker")
    source = F.when(who == "", "none").when(F.col("_fallback_used"), "fallback").when(who.isin(sorted(known)), "member").when(who.isin(sorted(learned | extra)), "learned").otherwise("fallback")
    return rows.withColumns({"Speaker_Source": source, "Role_Group": tx.role_group(F.col("Title_Role"))})


def diagnostics(rows: DataFrame) -> DataFrame:
    """Counts of all, named, unmatched, title-only and flagged rows."""
    part = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.agg(
        F.count("*").alias("speeches"), part(F.col("Speaker") != "").alias("named"), part((F.col("Speaker") == "") & (F.col("Title_Role") == "")).alias("unmatched"),
        part((F.col("Speaker") == "") & (F.col("Title_Role") != "")).alias("title_only"), part(F.col("Residual_Header_Flag")).alias("residual"),
    )


def source_shares(rows: DataFrame, source: str = "Speaker_Source", digits: int = 2) -> DataFrame:
    """(source, speeches, percent) of the places that speakers' names come from."""
    every = rows.agg(F.count("*")).scalar()
    return rows.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("speeches")).withColumn("percent", F.round(100.0 * F.col("speeches") / every, digits))


def join_diagnostics(rows: DataFrame, speaker: str = "Speaker", party: str = "Party", title: str = "Title_Role", chunk: str = "Speech_Chunk", unknown: str = lx.UNKNOWN_OR_OFFICER) -> DataFrame:
    """One row: named rows, those of them without a party in the roster, rows with a title alone, and named rows whose
    name was written with white space between its letters."""
    part = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    named = F.coalesce(F.col(speaker), F.lit("")) != ""
    whole = F.contains(F.col(chunk), F.col(speaker))
    return rows.agg(
        part(named).alias("named"), part(named & (F.coalesce(F.col(party), F.lit(unknown)) == unknown)).alias("without_party"),
        part(~named & (F.coalesce(F.col(title), F.lit("")) != "")).alias("title_only"), part(named & ~whole).alias("spaced_names"),
    )
