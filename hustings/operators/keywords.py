"""Keyword counts and discourse classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.functions import lexicons as lx
from hustings.functions import text as tx


def plain_counts(rows: DataFrame, keywords: Sequence[str], content: str = "Content") -> DataFrame:
    """One column for each keyword: its matches as a pattern in the content, null as 0."""
    return rows.withColumns({k: tx.or_zero(tx.count(F.col(content), k)) for k in keywords})


def ledger_counts(rows: DataFrame, groups: Mapping[str, tuple[str, Sequence[str]]] = lx.LEDGER, speech: str = "Speech", compose: bool = True) -> DataFrame:
    """Loose counts by column, Keyword_Total, Discourse_* subtotals, and Keyword_Spaced_Extra: loose less strict."""
    rows = rows.withColumn("_text", tx.modern(tx.readable(F.col(speech), compose)))
    t = F.col("_text")
    loose = {name: tx.total(*[tx.count(t, tx.spaced(w)) for w in words]) for name, (_, words) in groups.items()}
    strict = tx.total(*[F.regexp_count(t, F.lit(w)) for _, words in groups.values() for w in words])
    rows = rows.withColumns({**loose, "_strict": strict})
    sums = {"Keyword_Total": tx.total(*[F.col(n) for n in groups])}
    for d in dict.fromkeys(d for d, _ in groups.values()):
        sums[f"Discourse_{d.capitalize()}"] = tx.total(*[F.col(n) for n, (g, _) in groups.items() if g == d])
    rows = rows.withColumns(sums)
    return rows.withColumn("Keyword_Spaced_Extra", F.col("Keyword_Total") - F.col("_strict")).drop("_text", "_strict")


def found_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords that a text holds, in the lexicon's order; a term inside a longer one counts too."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords]))


def hits(rows: DataFrame, keep: Sequence[str], lexicon: Mapping[str, Mapping[str, Sequence[str]]] = lx.TAGGER, content: str = "Content") -> DataFrame:
    """(keep, words, families): the keywords and the families that a text holds, as arrays in the lexicon's order. Every
    text is read once; what is counted by keyword or family afterwards needs no text."""
    families = {f: ks for fs in lexicon.values() for f, ks in fs.items()}
    bare = rows.select(*keep, tx.bare(F.coalesce(F.col(content), F.lit(""))).alias("_bare"))
    found = bare.select(*keep, F.struct(*[found_keywords(F.col("_bare"), ks).alias(f"f{k}") for k, ks in enumerate(families.values())]).alias("_hits"))
    each = [F.col(f"_hits.f{k}") for k in range(len(families))]
    names = F.array_compact(F.array(*[F.when(F.size(e) > 0, F.lit(f)) for e, f in zip(each, families)]))
    return found.select(*keep, F.concat(*each).alias("words"), names.alias("families"))


def tag(rows: DataFrame, lexicon: Mapping[str, Mapping[str, Sequence[str]]] = lx.TAGGER, content: str = "Content", sep: str = "; ") -> DataFrame:
    """For each discourse d: d담론 (예 or 아니오), d계열, d키워드, d키워드수; and 담론분류."""
    rows = rows.withColumn("_bare", tx.bare(F.coalesce(F.col(content), F.lit(""))))
    each = {(d, f): found_keywords(F.col("_bare"), ks) for d, families in lexicon.items() for f, ks in families.items()}
    names = {key: f"_hits_{k}" for k, key in enumerate(each)}
    rows = rows.withColumns({names[key]: c for key, c in each.items()}).drop("_bare")
    made, hit = {}, []
    for d, families in lexicon.items():
        words = F.concat(*[F.col(names[d, f]) for f in families])
        per = [F.when(F.size(names[d, f]) > 0, F.lit(f)) for f in families]
        made |= {f"{d}담론": F.when(F.size(words) > 0, "예").otherwise("아니오"), f"{d}계열": F.array_join(F.array_compact(F.array(*per)), sep), f"{d}키워드": F.array_join(words, sep), f"{d}키워드수": F.size(words).cast("string")}
        hit.append((d, F.size(words) > 0))
    (a, in_a), (b, in_b) = hit
    made["담론분류"] = exclusive(in_a, in_b, (a, b, f"{a}+{b}", lx.CLASSES[3]))
    return rows.withColumns(made).drop(*names.values())


def exclusive(first: Column, second: Column, names: Sequence[str] = lx.CLASSES) -> Column:
    """One of four classes: first only, second only, both, none."""
    return F.when(first & second, names[2]).when(first, names[0]).when(second, names[1]).otherwise(names[3])


def values(multi: Column, sep: str = ";") -> Column:
    """A joined multi-value as a list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(multi, F.lit("")), sep), lambda x: tx.strip(x)), lambda x: x != "")
