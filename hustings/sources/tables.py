"""Readers of minutes and rosters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.functions import lexicons as lx
from hustings.functions import text as tx

# Places of a roster's columns where it has no header (from 0), and encodings in order of trial.
PLACES = {"Speaker": 2, "Party": 4, "Region": 5, "Gender": 6, "Election_Count": 7, "Election_Method": 8}
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr")


def minutes(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV of documents: quoted fields over several lines, of any length; without byte order mark in its header."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).option("mode", "PERMISSIVE")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def first_file(spark: SparkSession, folder: str, prefix: str) -> str:
    """The first file of a folder by a prefix; FileNotFoundError when there is none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(folder).agg(F.min("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"{folder}/{prefix}*")
    return found


def decoded(content: bytes) -> str:
    """Text in the first of ENCODINGS that fits."""
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding")


def roster_rows(text: str, term: int | None) -> list[tuple]:
    """Rows of one roster file, in ROSTER_COLUMNS: its header is searched for among its lines; without one, columns are
    taken by their places. Names lose white space."""
    import csv
    import io

    lines = list(csv.reader(io.StringIO(text)))
    known = {**lx.ROSTER_NAMES, **{c: c for c in lx.ROSTER_COLUMNS}}
    place, start = {}, 0
    for k, line in enumerate(lines):
        here = {known[c.strip()]: j for j, c in reversed(list(enumerate(line))) if c.strip() in known}
        if {"Speaker", "Party"} <= here.keys():
            place, start = here, k + 1
            break
    place = place or PLACES
    out = []
    for line in lines[start:]:
        cell = lambda c: line[place[c]].strip() or None if c in place and place[c] < len(line) else None  # noqa: E731,B023
        name = "".join((cell("Speaker") or "").split())
        if name:
            own = cell("Assembly_Num")
            out.append((int(own) if own and own.isdigit() else term, name, *[cell(c) for c in lx.ROSTER_COLUMNS[2:]]))
    return out


def rosters(spark: SparkSession, folder: str, pattern: str = "*.csv", term_pattern: str = r"(\d+)") -> DataFrame:
    """All roster files of a folder: ROSTER_COLUMNS, file_order and row_no. The term is a column or in the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    schema = "array<struct<" + ",".join(["Assembly_Num:int", *[f"{c}:string" for c in lx.ROSTER_COLUMNS[1:]]]) + ">>"

    @F.udf(schema)
    def parse(content, term):
        return roster_rows(decoded(bytes(content)), term)

    term = F.coalesce(tx.term_of_text(name), tx.extract(name, term_pattern).try_cast("int"))
    rows = files.select(name.alias("file_order"), F.posexplode(parse("content", term)).alias("row_no", "r"))
    return rows.select("r.*", "file_order", "row_no")


def officers(spark: SparkSession, path: str | None) -> DataFrame:
    """The optional list of officers (Assembly_Num, Title_Role, Speaker); empty without a path."""
    schema = "Assembly_Num int, Title_Role string, Speaker string"
    return spark.read.option("header", True).schema(schema).csv(path) if path else spark.createDataFrame([], schema)


def padded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that are missing added, and nulls as blanks, as rows that are too short read."""
    return df.withColumns({c: F.lit("") for c in columns if c not in df.columns}).na.fill("")
