"""Minutes into speaker turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hustings.functions import lexicons as lx
from hustings.functions import text as tx


def chunks(docs: DataFrame, title: str = "Title", content: str = "Content", order: str | None = None, mark: str = lx.TURN_MARK, titles_differ: bool = False) -> DataFrame:
    """One row for each non-blank stretch between marks, as Speech_Chunk, numbered from 1 within its title by order
    of document and place; documents of one title share the numbers.

    A document is cut and numbered within its row. Only what earlier documents of its title count is added by a window,
    over documents; where titles_differ says that no two share one, nothing is shuffled.
    """
    own = F.filter(F.transform(F.split(content, mark), lambda x: tx.strip(x)), lambda x: x != "")
    rows = docs.withColumn("_own", own).drop(content).filter(F.size("_own") > 0)
    if titles_differ:
        rows = rows.withColumn("_before", F.lit(0))
    else:
        before = Window.partitionBy(title).orderBy(order or title).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_before", F.coalesce(F.sum(F.size("_own")).over(before), F.lit(0)))
    names = [c for c in rows.columns if c not in ("_own", "_before")]
    rows = rows.select(*names, "_before", F.posexplode("_own").alias("_pos", "Speech_Chunk"))
    return rows.select(*names, "Speech_Chunk", (F.col("_before") + F.col("_pos") + 1).cast("int").alias("Speech_Seq"))


def segments(docs: DataFrame, key: list[str], content: str = "Content", mark: str = lx.TURN_MARK) -> DataFrame:
    """(key, seq, type, speaker, content): turns, agenda items and other lines of each row, in order.

    A line with the mark opens a turn; a bracketed line and a numbered agenda item are rows of their own and end it;
    other lines continue an open turn and are rows of their own elsewhere. The speaker is the first two words. A null
    or blank document has no rows. All is done within the document's row, without a shuffle: lines get a letter for
    their kind, a turn runs to the next line that isn't plain.
    """

    def lettered(line: Column) -> Column:
        kind = F.when(line.startswith(mark), "T").when(tx.has(line, r"^\(.*\)\z"), "N").when(tx.has(line, r"^\d+[.)]\s*\S"), "I").otherwise("P")
        return F.concat(kind, line)

    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: tx.strip(x)), lambda x: x != "")
    runs = F.split(F.array_join(F.transform(lines, lettered), "\n"), "\n(?=[TNI])")
    rows = F.flatten(F.transform(runs, lambda r: F.when(r.startswith("T"), F.array(r)).otherwise(F.split(r, "\n"))))
    out = docs.select(*key, F.posexplode(F.filter(rows, lambda r: r != "")).alias("_pos", "_row"))
    kind, body = F.substring("_row", 1, 1), F.substring("_row", 2, 1_000_000_000)
    # A turn's lines: the first has the mark and the speaker, the others keep their letter in front.
    parts = F.split(body, "\nP")
    words = F.split(tx.strip(F.substring(parts[0], len(mark) + 1, 1_000_000_000)), " ", 3)
    said = F.concat(F.array(F.coalesce(F.try_element_at(words, F.lit(3)), F.lit(""))), F.slice(parts, 2, F.size(parts)))
    text = F.when(kind == "T", F.array_join(F.filter(said, lambda p: p != ""), " ")).when(kind == "N", tx.replace(body, r"^\(\s*|\s*\)\z")).otherwise(body)
    name = F.when(kind == "T", lx.SPEECH).when(kind == "I", lx.AGENDA).otherwise(lx.OTHER)
    speaker = F.when(kind == "T", F.array_join(F.slice(words, 1, 2), " ")).otherwise("")
    return out.select(*key, (F.col("_pos") + 1).alias("seq"), name.alias("type"), speaker.alias("speaker"), text.alias("content"))


def in_period(speeches: DataFrame, first: str | None, last: str | None, date: str = "Date") -> DataFrame:
    """Rows whose ISO date lies in the period, ends included; blank and impossible dates go."""
    d = F.try_to_date(F.col(date), "yyyy-MM-dd")
    keep = d.isNotNull()
    if first:
        keep = keep & (d >= F.lit(first).cast("date"))
    if last:
        keep = keep & (d <= F.lit(last).cast("date"))
    return speeches.filter(keep)


def until(speeches: DataFrame, last: str, date: str = "Date") -> DataFrame:
    """Rows whose date, as a title writes it with zeros, isn't after `last` in order of letters; rows without one go."""
    return speeches.filter(F.col(date) <= F.lit(last))


def in_order(speeches: DataFrame, date: str = "Date", title: str = "Title", seq: str = "Seq") -> DataFrame:
    """Sorted by date, title and number; rows without a date last, numbers that are none as 0."""
    d = F.try_to_date(F.col(date), "yyyy-MM-dd")
    return speeches.orderBy(d.isNull(), d, title, F.coalesce(F.col(seq).cast("string").try_cast("int"), F.lit(0)))
