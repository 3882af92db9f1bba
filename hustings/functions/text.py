"""Text functions on columns. Patterns see all of Unicode, as (?U) says; a missing match is null, never ''."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicons as lx


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, "(?U)" + pattern, group), F.lit(""))


def replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, "(?U)" + pattern, by)


def has(c: Column, pattern: str) -> Column:
    return c.rlike("(?U)" + pattern)


def count(c: Column, pattern: str) -> Column:
    """Non-overlapping matches; null for null."""
    return F.regexp_count(c, F.lit("(?U)" + pattern))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return replace(c, r"^\s+|\s+\z")


def squeeze(c: Column) -> Column:
    """Runs of two or more white spaces as one space, ends stripped."""
    return strip(replace(c, r"\s{2,}", " "))


def blank_to(c: Column, other: Column) -> Column:
    """c, or `other` where c is null or white space."""
    return F.coalesce(F.when(strip(c) != "", c), other)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def total(*cs: Column) -> Column:
    """Sum across columns, null as 0."""
    out = F.lit(0)
    for c in cs:
        out = out + or_zero(c)
    return out


def _form(form: str):
    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normal


def nfc(c: Column) -> Column:
    """Unicode normal form C; Spark has no built-in."""
    return _form("NFC")(c)


def nfkc(c: Column) -> Column:
    """Unicode normal form KC."""
    return _form("NFKC")(c)


def bare(c: Column) -> Column:
    """For literal matching: without byte order marks, zero-width spaces and any white space."""
    return replace(c, r"[﻿​\s]+")


def person(c: Column) -> Column:
    """A name as a key: normal form C, then bare."""
    return bare(nfc(c))


def readable(c: Column, compose: bool = True) -> Column:
    """For counting keywords: line ends and tabs as spaces, long rules gone, spelt-out Latin letters joined, squeezed."""
    c = replace(replace(c, r"[\r\n\t]+", " "), "-{3,}|_{3,}", " ")
    for _ in range(4):
        c = replace(c, r"\b([A-Za-z])\s+([A-Za-z]\b)", "$1$2")
    c = squeeze(c)
    return nfkc(c) if compose else c


def modern(c: Column) -> Column:
    """Old spellings as they are written now."""
    for old, new in lx.LEGACY_SPELLING:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def historical(c: Column) -> Column:
    """Early minutes made readable: odd spaces, marks, split words, and particles apart from their words."""
    c = replace(c, r"[\xA0​\r\n\t]+", " ")
    c = replace(replace(c, lx.TURN_MARK + r"\s*", lx.TURN_MARK + " "), r"\s*․\s*", "․")
    for word in lx.SPLIT_WORDS:
        c = replace(c, r"\b" + r"\s+".join(word) + r"\b", word)
    for _ in range(3):
        c = replace(c, rf"\s+({lx.PARTICLES})", "$1")
    return squeeze(c)


def tidy(c: Column) -> Column:
    """The shorter cleaning."""
    return squeeze(replace(replace(c, r"[\xA0​\r\n\t]+", " "), rf"\s+({lx.SHORT_PARTICLES})", "$1"))


def paragraph(c: Column) -> Column:
    """NUL, CR and lone surrogates gone, white space within lines as one space, blank lines dropped."""
    lines = F.split(replace(c, r"[\x00\r\x{D800}-\x{DFFF}]"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: strip(replace(x, r"\s+", " "))), lambda x: x != ""), "\n")


def spaced(keyword: str) -> str:
    """A pattern for a keyword with white space between its characters or not."""
    return r"\s*".join(re.escape(ch) for ch in keyword)


# ---- Titles and dates -------------------------------------------------------------------------------------------


def term(title: Column, most: int = 4) -> Column:
    """The term number in front of a title, 1 to most, else null."""
    n = extract(title, r"^제(\d+)대국회").try_cast("int")
    return F.when(n.between(1, most), n)


def term_name(title: Column) -> Column:
    """제헌 for the first term, 제n대 for others, '' for none."""
    n = extract(title, r"제(\d+)대국회").try_cast("int")
    return F.when(n == 1, F.lit("제헌")).when(n.isNotNull(), F.concat(F.lit("제"), n.cast("string"), F.lit("대"))).otherwise("")


def term_of_text(c: Column) -> Column:
    """A term number written anywhere, in the founding assembly's name or as an ordinal."""
    c = nfc(c)
    return F.when(c.contains("제헌국회"), F.lit(1)).otherwise(F.coalesce(extract(c, r"제\s*(\d+)\s*대\s*국회"), extract(c, r"(?<!\d)(\d+)\s*대\s*국회")).try_cast("int"))


def title_parts(title: Column) -> dict[str, Column]:
    """Session number and type, sitting number and meeting body."""
    return {
        "Session_No": extract(title, r"제(\d+)회").try_cast("int"), "Session_Type": extract(title, r"제\d+회\(([^)]+)\)"),
        "Sitting_No": extract(title, r"제(\d+)차").try_cast("int"), "Meeting_Body": strip(extract(title, r"제\d+차\s*([^(]+)")),
    }


def title_date(title: Column) -> Column:
    """The date as the title writes it, (1949.01.10.), without brackets."""
    return extract(title, r"\((\d{4}\.\d{2}\.\d{2}\.)\)")


def day(c: Column) -> Column:
    """A date from 1949.1.10. or 1949.01.10, else null."""
    return F.try_to_timestamp(F.regexp_replace(c, r"\.\s*\z", ""), F.lit("yyyy.M.d")).cast("date")


def file_title_date(name: Column) -> tuple[Column, Column]:
    """(title, ISO date) of a file name: the date in brackets or between underscores, or the last one of any form; an
    impossible date leaves '' and the whole base name."""
    base = replace(name, r"\.[^.]*\z")
    y, m, d = (F.coalesce(*[extract(base, p, g) for p in (r"\((\d{4})\.(\d{1,2})\.(\d{1,2})\.?\)", r"_(\d{4})_(\d{1,2})_(\d{1,2})__?\z", r".*(\d{4})[._-](\d{1,2})[._-](\d{1,2})")]) for g in (1, 2, 3))
    iso = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd").cast("string")
    cut = replace(base, r"[\s_]*\(?\d{4}[._-]\d{1,2}[._-]\d{1,2}[._]*\)?[\s_]*\z")
    title = strip(replace(replace(cut, r"[_\s]+\z"), r"\s+", " "))
    return F.when(iso.isNull(), base).otherwise(title), F.coalesce(iso, F.lit(""))


def attachment_name(header: Column) -> Column:
    """The file name of a Content-Disposition header: the encoded one, percent signs resolved, else the plain one."""
    plain = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    encoded = extract(header, r"(?i)filename\*=UTF-8''([^;]+)")
    return F.coalesce(plain(encoded), plain(extract(header, r'(?i)filename="?([^";]+)"?')))


def safe_name(c: Column) -> Column:
    """A text as a file name: each run of signs that file systems keep for themselves as one underscore."""
    return F.regexp_replace(c, r'[\\/:*?"<>|]+', "_")


def speech_id(term_no: Column, date: Column, session: Column, sitting: Column, seq: Column) -> Column:
    """term-date-S000-M000-0000; null without a term or number, zeros for a missing date, session or sitting."""
    pad = lambda c, n: F.format_string(f"%0{n}d", c.cast("long"))
    return F.when(seq.isNotNull(), F.concat(term_no.cast("string"), F.lit("-"), F.coalesce(date.cast("string"), F.lit("0000-00-00")), F.lit("-S"), pad(or_zero(session), 3), F.lit("-M"), pad(or_zero(sitting), 3), F.lit("-"), pad(seq, 4)))


def role_group(role: Column) -> Column:
    """The group of a title, the first that fits."""
    out = F.when(role == "", F.lit(lx.UNKNOWN))
    for pattern, name in lx.ROLE_GROUPS:
        out = out.when(has(role, pattern), F.lit(name))
    return out.otherwise(lx.OTHER)
