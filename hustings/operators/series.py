"""Time series over sessions and months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def surge(table: DataFrame, order: Sequence[str], columns: Sequence[str], by: Sequence[str] = (), window: int = 5, least: int = 3, sigma: float = 2.0, across: bool = False) -> DataFrame:
    """Adds _prev, _mean, _std and _surge for each column: is a value over mean + sigma * std of the values before it?

    The value before is its own group's. With `across` the window of means runs over the whole table in order of
    (by, order), across groups, which takes one task: a table of sessions is small. Else it stays in the group.
    """
    inside = Window.partitionBy(*by).orderBy(*order)
    run = (Window.partitionBy() if across else Window.partitionBy(*by)).orderBy(*by, *order).rowsBetween(1 - window, 0)
    for c in columns:
        p = f"{c}_prev"
        table = table.withColumn(p, F.lag(c).over(inside))
        enough = F.count(p).over(run) >= least
        table = table.withColumns({f"{c}_mean": F.when(enough, F.avg(p).over(run)), f"{c}_std": F.when(enough, F.stddev_samp(p).over(run))})
        table = table.withColumn(f"{c}_surge", F.coalesce(F.col(c) > F.col(f"{c}_mean") + sigma * F.col(f"{c}_std"), F.lit(False)))
    return table


def month(table: DataFrame, date: str, name: str = "month") -> DataFrame:
    return table.withColumn(name, F.date_format(date, "yyyy-MM"))


def density(counts: DataFrame, totals: DataFrame, by: str, count: str, total: str, per: int = 1000, digits: int = 3) -> DataFrame:
    """Counts per so many of the totals of their period."""
    return counts.join(totals.select(by, total), by).withColumn(f"{count}_per_{per}", F.round(F.try_divide(F.col(count) * F.lit(float(per)), F.col(total)), digits))
