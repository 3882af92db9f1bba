"""Queries of summary tables: orders stand for speeches, their customers for speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import agreement, keywords, rollups

from .catalog import register, table
from .graph_queries import _FOUND, _hits
from .storage import finished
from .text_queries import LEXICON

#: Speeches: a year is a term, a month a session; one customer in fifty has no name, the lowest priority no title.
_SPEECHES = """(SELECT CAST(year(o_orderdate) AS INT) AS Assembly_Num, CASE WHEN o_custkey % 50 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS Speaker, c_mktsegment AS Party, CASE WHEN c_nationkey % 3 = 0 THEN '의원' ELSE '미상/직책자' END AS Speaker_Type,
CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE o_orderpriority END AS Title_Role, o_orderstatus AS Role_Group, CASE WHEN o_orderkey % 4 = 0 THEN 'member' ELSE 'learned' END AS Speaker_Source, CAST(month(o_orderdate) AS INT) AS Session_No, strftime(o_orderdate, '%Y-%m-%d') AS "Date",
CAST(o_totalprice > 200000 AS INT) AS d, CAST(o_orderstatus = 'F' AS INT) AS b, length(o_orderpriority) * 10 AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
_SUMS = "CAST(sum(d) AS BIGINT) AS Discourse_Development, CAST(sum(b) AS BIGINT) AS Discourse_Boundary, CAST(sum(d + b) AS BIGINT) AS Keyword_Total, count(*) AS Speeches, CAST(sum(n) AS BIGINT) AS Chars"
_RATES = ", ".join(f"round({c} * 1000.0::DOUBLE / nullif(Chars, 0), 3) AS {n}" for n, c in (("Total_per_1k", "Keyword_Total"), ("Dev_per_1k", "Discourse_Development"), ("Bnd_per_1k", "Discourse_Boundary")))
_SHARE = "round(Chars::DOUBLE / sum(Chars) OVER (PARTITION BY Assembly_Num), 5) AS Share_of_Chars"


def _mode(column: str, keys: str, where: str = "TRUE") -> str:
    return f"(SELECT {keys}, arg_min(v, (-k, v)) AS v FROM (SELECT {keys}, {column} AS v, count(*) AS k FROM s WHERE {column} IS NOT NULL AND {where} GROUP BY ALL) GROUP BY ALL)"


def _speeches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    d, b = (F.col("o_totalprice") > 200000).cast("int"), (F.col("o_orderstatus") == "F").cast("int")
    return rows.select(
        F.year("o_orderdate").alias("Assembly_Num"), F.when(F.col("o_custkey") % 50 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("Speaker"), F.col("c_mktsegment").alias("Party"),
        F.when(F.col("c_nationkey") % 3 == 0, "의원").otherwise("미상/직책자").alias("Speaker_Type"), F.when(F.col("o_orderpriority").startswith("5"), "").otherwise(F.col("o_orderpriority")).alias("Title_Role"),
        F.col("o_orderstatus").alias("Role_Group"), F.when(F.col("o_orderkey") % 4 == 0, "member").otherwise("learned").alias("Speaker_Source"), F.month("o_orderdate").alias("Session_No"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), d.alias("Discourse_Development"), b.alias("Discourse_Boundary"), (d + b).alias("Keyword_Total"), (F.char_length("o_orderpriority") * 10).alias("Speech_Chars"),
    )


_KEYS = "Assembly_Num, Speaker"


@register("speaker_summary", f"""WITH s AS (SELECT * FROM {_SPEECHES} WHERE Speaker <> ''), t AS (SELECT {_KEYS}, array_to_string(list_sort(list_distinct(list(Role_Group))), '; ') AS Role_Groups, count(DISTINCT Session_No) AS Active_Sessions, min("Date") AS First_Speech_Date, max("Date") AS Last_Speech_Date, {_SUMS} FROM s GROUP BY ALL)
SELECT t.*, p.v AS Party, y.v AS Speaker_Type, r.v AS Primary_Role, o.v AS Speaker_Source, {_RATES}, {_SHARE} FROM t LEFT JOIN {_mode("Party", _KEYS)} p USING ({_KEYS}) LEFT JOIN {_mode("Speaker_Type", _KEYS)} y USING ({_KEYS}) LEFT JOIN {_mode("Title_Role", _KEYS, "Title_Role <> ''")} r USING ({_KEYS}) LEFT JOIN {_mode("Speaker_Source", _KEYS)} o USING ({_KEYS})""")
def speaker_summary(spark, sf_dir):
    return rollups.speaker_summary(_speeches(spark, sf_dir))


_NONPARTY = "Assembly_Num, Role_Group, Speaker"


@register("nonparty_summary", f"WITH s AS (SELECT * FROM {_SPEECHES} WHERE Speaker_Type <> '의원' AND Speaker <> ''), t AS (SELECT {_NONPARTY}, {_SUMS} FROM s GROUP BY ALL) SELECT t.*, r.v AS Primary_Role, {_RATES}, {_SHARE} FROM t LEFT JOIN {_mode('Title_Role', _NONPARTY)} r USING ({_NONPARTY})")
def nonparty_summary(spark, sf_dir):
    return rollups.nonparty_summary(_speeches(spark, sf_dir))


@register("year_summary", f"SELECT *, {_RATES}, round(Discourse_Boundary::DOUBLE / nullif(Discourse_Development + Discourse_Boundary, 0), 4) AS Boundary_Ratio FROM (SELECT Assembly_Num AS Year, count(DISTINCT Speaker) AS Distinct_Speakers, {_SUMS} FROM {_SPEECHES} GROUP BY 1)")
def year_summary(spark, sf_dir):
    return rollups.year_summary(_speeches(spark, sf_dir).withColumnRenamed("Assembly_Num", "Year"))


@register("party_per_member", "WITH p AS (SELECT c_nationkey AS party, count(*) FILTER (o_orderstatus = 'F') AS labour, CAST(sum(length(o_orderpriority)) AS BIGINT) AS words FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), m AS (SELECT c_nationkey AS party, count(DISTINCT c_custkey) AS members FROM customer WHERE c_acctbal > 0 GROUP BY 1) SELECT party, labour, words, coalesce(members, 0) AS members, round(coalesce(labour * 10000.0::DOUBLE / nullif(words, 0), 0), 2) AS labour_per_10000, round(coalesce(labour::DOUBLE / nullif(members, 0), 0), 2) AS labour_per_member FROM p LEFT JOIN m USING (party)")
def party_per_member(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    rows = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    parties = rows.groupBy(F.col("c_nationkey").alias("party")).agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("labour"), F.sum(F.char_length("o_orderpriority")).alias("words"))
    members = people.filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("party")).agg(F.countDistinct("c_custkey").alias("members"))
    return rollups.per_member(parties, members, ["party"], ["labour"], "words")


_FAMILIES = [f for fs in LEXICON.values() for f in fs]
_HELD = f"(SELECT DISTINCT doc_id, f FROM ({_FOUND}))"


@register("document_frequency", f"SELECT k AS keyword, count(DISTINCT doc_id) AS texts FROM ({_FOUND}) GROUP BY 1")
def document_frequency(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return finished(rollups.document_frequency(hits), "document-frequency", hits)


_FAMILY_LIST = ", ".join(f"('{f}')" for f in _FAMILIES)


@register("family_profile", f"WITH t AS (SELECT source, count(*) AS n FROM documents WHERE coalesce(source, '') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4), c AS (SELECT source, f, count(*) AS k FROM documents JOIN {_HELD} USING (doc_id) GROUP BY 1, 2) SELECT t.source, v.f AS family, coalesce(k, 0) AS count, round(100.0::DOUBLE * coalesce(k, 0) / n, 4) AS rate FROM t CROSS JOIN (VALUES {_FAMILY_LIST}) v(f) LEFT JOIN c ON c.source = t.source AND c.f = v.f")
def family_profile(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return finished(rollups.family_profile(hits, "source", _FAMILIES, 4), "family-profile", hits)


@register("speaker_months", "WITH b AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15) SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM b) GROUP BY 1, 2")
def speaker_months(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rollups.leading(rows, "o_custkey", "month")


@register("party_base", f"SELECT lang, count(*) AS total, count(*) FILTER (len(l) > 0) AS related, {', '.join(f'count(*) FILTER (list_contains(l, {chr(39)}{f}{chr(39)})) AS {f}' for f in _FAMILIES)}, round(100.0::DOUBLE * count(*) FILTER (len(l) > 0) / count(*), 4) AS related_pct FROM (SELECT lang, source, coalesce(l, []) AS l FROM documents LEFT JOIN (SELECT doc_id, list(f) AS l FROM {_HELD} GROUP BY 1) USING (doc_id)) WHERE trim(coalesce(lang, '')) <> '' AND coalesce(source, '') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def party_base(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return finished(rollups.party_base(hits, "lang", "source", _FAMILIES), "party-base", hits)


_PARTIES = ["en", "fr"]


@register("party_cube", f"WITH d AS (SELECT * FROM documents WHERE lang IN ('en', 'fr')), c AS (SELECT lang, f, source, count(*) AS n FROM d JOIN {_HELD} USING (doc_id) GROUP BY 1, 2, 3) SELECT p.lang, v.f AS family, s.source, coalesce(n, 0) AS n FROM (VALUES ('en'), ('fr')) p(lang) CROSS JOIN (VALUES {_FAMILY_LIST}) v(f) CROSS JOIN (SELECT DISTINCT source FROM d WHERE source IS NOT NULL) s LEFT JOIN c ON c.lang = p.lang AND c.f = v.f AND c.source = s.source")
def party_cube(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return finished(rollups.party_cube(hits, _PARTIES, "lang", "source", _FAMILIES), "party-cube", hits)


@register("insights", """WITH t AS (SELECT 'status' AS name, o_orderstatus AS item, count(*)::DOUBLE AS value FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, round(avg((o_totalprice > 250000)::INT), 6) FROM orders GROUP BY 2 UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), count(*)::DOUBLE FROM orders GROUP BY 2)
SELECT name, arg_min(item, (-value, item)) AS item, max(value) AS value FROM t GROUP BY name""")
def insights(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    by = lambda c, agg: rows.groupBy(c).agg(agg.alias("v"))
    high = F.round(F.avg((F.col("o_totalprice") > 250000).cast("int")), 6)
    return rollups.insights({"status": (by("o_orderstatus", F.count("*")), "o_orderstatus", "v"), "priority": (by("o_orderpriority", high), "o_orderpriority", "v"), "month": (by("month", F.count("*")), "month", "v")})


@register("source_shares", f"SELECT Speaker_Source AS source, count(*) AS speeches, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percent FROM {_SPEECHES} GROUP BY 1")
def source_shares(spark, sf_dir):
    from hustings.operators import headers

    return headers.source_shares(_speeches(spark, sf_dir))


_ANNOTATED = "(SELECT lang AS month, CAST(quality AS VARCHAR) AS Annotator_1, CAST(toxic AS VARCHAR) AS Annotator_2, CAST(doc_id % 2 AS VARCHAR) AS Annotator_3 FROM labels JOIN documents USING (doc_id))"


def _annotated(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select(F.col("lang").alias("month"), F.col("quality").cast("string").alias("Annotator_1"), F.col("toxic").cast("string").alias("Annotator_2"), (F.col("doc_id") % 2).cast("string").alias("Annotator_3"))


def _pairs_sql() -> str:
    pairs = " UNION ALL ".join(f"SELECT month, 'Annotator_{a}' AS a, 'Annotator_{b}' AS b, Annotator_{a} AS x, Annotator_{b} AS y FROM {_ANNOTATED} WHERE Annotator_{a} IS NOT NULL AND Annotator_{b} IS NOT NULL" for a, b in ((1, 2), (1, 3), (2, 3)))
    return f"""WITH r AS ({pairs}), t AS (SELECT month, a, b, count(*) AS n, avg((x = y)::INT) AS agreement FROM r GROUP BY 1, 2, 3),
e AS (SELECT month, a, b, sum(k::DOUBLE * m) AS p FROM (SELECT month, a, b, x AS v, count(*) AS k FROM r GROUP BY 1, 2, 3, 4) JOIN (SELECT month, a, b, y AS v, count(*) AS m FROM r GROUP BY 1, 2, 3, 4) USING (month, a, b, v) GROUP BY 1, 2, 3)
SELECT month, a, b, n, round(agreement, 6) AS agreement, CASE WHEN abs(1 - coalesce(p, 0) / (n::DOUBLE * n)) >= 1e-12 THEN round((agreement - coalesce(p, 0) / (n::DOUBLE * n)) / (1 - coalesce(p, 0) / (n::DOUBLE * n)), 6) END AS kappa FROM t LEFT JOIN e USING (month, a, b)"""


def _kappas(spark, sf_dir):
    rows = _annotated(spark, sf_dir)
    return agreement.kappa_pairs(rows, agreement.annotators(rows.columns), ["month"])


@register("kappa_pairs", _pairs_sql())
def kappa_pairs(spark, sf_dir):
    return _kappas(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("agreement", "kappa")})


@register("kappa_by_month", f"SELECT month, count(kappa) AS pairs, round(avg(kappa), 4) AS kappa FROM ({_pairs_sql()}) GROUP BY 1")
def kappa_by_month(spark, sf_dir):
    return agreement.mean_kappa(_kappas(spark, sf_dir), "month").withColumn("kappa", F.round("kappa", 4))


@register("disagreements", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(CAST(quality AS VARCHAR), '') <> coalesce(CAST(toxic AS VARCHAR), '')")
def disagreements(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return agreement.disagreements(rows, "quality", "toxic").select("doc_id", "quality", "toxic")
