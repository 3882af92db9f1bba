"""Annotation: label distributions, agreement between annotators, and models against gold."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of annotators' columns.
ANNOTATORS = re.compile(r"^(Annotator[_ ]?\w+|어노테이터|라벨러|annotator)")


def first_present(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def annotators(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if ANNOTATORS.match(c)]


def distribution(rows: DataFrame, label: str, blank: str = "미라벨") -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.trim(F.col(label).cast("string")), F.lit("")), F.lit(blank)).alias("label")).agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, y, n) over rows where both are given."""
    x, y = (F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in (a, b))
    return rows.select(*by, x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL").groupBy(*by, "x", "y").agg(F.count("*").alias("n"))


def kappa(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, agreement, kappa): Cohen's; null where chance agreement is 1."""
    cells = confusion(rows, a, b, by)
    on = list(by) or ["_one"]
    cells = cells if by else cells.withColumn("_one", F.lit(1))
    both = cells.groupBy(*on).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left, right = (cells.groupBy(*on, F.col(s).alias("v")).agg(F.sum("n").alias(f"n{s}")) for s in "xy")
    chance = left.join(right, [*on, "v"]).groupBy(*on).agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("c"))
    out = both.join(chance, on, "left").withColumn("agreement", F.col("same") / F.col("n"))
    pe = F.coalesce("c", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return out.select(*by, "n", "agreement", F.when(F.abs(1 - pe) >= 1e-12, (F.col("agreement") - pe) / (1 - pe)).alias("kappa"))


def kappa_pairs(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, n, agreement, kappa) for every pair of annotators' columns; pairs without common labels have no row."""
    whole = None
    for a, b in combinations(columns, 2):
        one = kappa(rows, a, b, by).select(F.lit(a).alias("a"), F.lit(b).alias("b"), *by, "n", "agreement", "kappa")
        whole = one if whole is None else whole.unionByName(one)
    if whole is None:
        raise ValueError("two annotators are needed")
    return whole


def mean_kappa(pairs: DataFrame, by: str) -> DataFrame:
    """(by, pairs, kappa): the mean over pairs whose kappa is defined."""
    return pairs.groupBy(by).agg(F.count("kappa").alias("pairs"), F.avg("kappa").alias("kappa"))


def disagreements(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The rows, whole, whose two labels differ; a blank label differs from any other."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.filter(blank(a) != blank(b))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The share of rows with equal values, blanks being values too."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.agg(F.avg((blank(a) == blank(b)).cast("double")).alias("agreement"))


def scores(rows: DataFrame, gold: str, model: str) -> DataFrame:
    """(n, accuracy, macro_f1); labels are those of either side, an undefined F1 is 0."""
    cells = confusion(rows, gold, model)
    per = cells.select(F.col("x").alias("v"), "n", (F.col("x") == F.col("y")).alias("hit"), F.lit(1).alias("g"), F.lit(0).alias("m"))
    per = per.union(cells.select(F.col("y").alias("v"), "n", (F.col("x") == F.col("y")).alias("hit"), F.lit(0).alias("g"), F.lit(1).alias("m")))
    by = per.groupBy("v").agg(F.sum(F.col("n") * F.col("g") * F.col("hit").cast("int")).alias("tp"), F.sum(F.col("n") * F.col("g")).alias("gold"), F.sum(F.col("n") * F.col("m")).alias("model"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("gold") + F.col("model")), F.lit(0.0))
    return by.agg(F.sum("gold").alias("n"), F.try_divide(F.sum("tp").cast("double"), F.sum("gold")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def histogram(rows: DataFrame, value: str, bins: int = 10, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, n) of numeric values, the top value in the last bin; texts that are no numbers go."""
    v = F.col(value).cast("string").try_cast("double")
    return rows.filter(v.isNotNull()).groupBy(F.least(F.width_bucket(v, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
