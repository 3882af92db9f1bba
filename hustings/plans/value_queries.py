"""Queries of rollups, series, rosters and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import agreement, keywords, rollups, roster, series

from .catalog import register, table

PRIORITY = "o_orderpriority"


_KW = {"the": "kw_the", "que": "kw_que", "der": "kw_der"}


def _ledger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = keywords.plain_counts(docs, list(_KW), "text").withColumnsRenamed(_KW)
    return rows.withColumns({"Keyword_Total": sum((F.col(c) for c in list(_KW.values())[1:]), F.col("kw_the")), "Discourse_Development": F.col("kw_the"), "Discourse_Boundary": F.col("kw_que") + F.col("kw_der"), "Speech_Chars": F.col("n_chars")}).drop("text")


_LEDGER = "(SELECT *, kw_the + kw_que + kw_der AS tot FROM (SELECT doc_id, lang, source, n_chars, " + ", ".join(f"len(regexp_extract_all(text, '{k}')) AS {c}" for k, c in _KW.items()) + " FROM documents))"
_SUMS = "CAST(sum(kw_the) AS BIGINT) AS kw_the, CAST(sum(kw_que) AS BIGINT) AS kw_que, CAST(sum(kw_der) AS BIGINT) AS kw_der, CAST(sum(kw_the) AS BIGINT) AS Discourse_Development, CAST(sum(kw_que + kw_der) AS BIGINT) AS Discourse_Boundary, CAST(sum(tot) AS BIGINT) AS Keyword_Total, count(*) AS Speeches, CAST(sum(n_chars) AS BIGINT) AS Chars"
_RATES = ", ".join(f"round({c} * 1000.0::DOUBLE / nullif(Chars, 0), 3) AS {n}" for n, c in (("Total_per_1k", "Keyword_Total"), ("Dev_per_1k", "Discourse_Development"), ("Bnd_per_1k", "Discourse_Boundary")))


@register("speaker_rollup", f"SELECT *, {_RATES}, round(Chars::DOUBLE / sum(Chars) OVER (PARTITION BY lang), 5) AS Share_of_Chars FROM (SELECT lang, source, {_SUMS} FROM {_LEDGER} GROUP BY lang, source)")
def speaker_rollup(spark, sf_dir):
    rows = rollups.rollup(_ledger(spark, sf_dir), ["lang", "source"], *rollups.measures(list(_KW.values())))
    return rollups.rates(rows, ["lang"])


@register("party_rollup", "SELECT n_name AS party, count(*) AS Speeches, count(DISTINCT c_custkey) AS Distinct_Speakers, round(count(*)::DOUBLE / count(DISTINCT c_custkey), 2) AS Speeches_Per_Speaker FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def party_rollup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    out = rollups.rollup(rows.withColumnRenamed("n_name", "party"), ["party"], F.count("*").alias("Speeches"), F.countDistinct("c_custkey").alias("Distinct_Speakers"))
    return out.withColumn("Speeches_Per_Speaker", F.round(F.col("Speeches") / F.col("Distinct_Speakers"), 2))


@register("session_rollup", "SELECT strftime(ts, '%Y-%m-%d') AS session, count(*) AS speeches, count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS speakers, array_to_string(list_sort(list_distinct(list(event_type))), '; ') AS kinds, strftime(min(ts), '%H:%M') AS starts, strftime(max(ts), '%H:%M') AS ends FROM events GROUP BY 1")
def session_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("session", F.date_format("ts", "yyyy-MM-dd"))
    return rollups.rollup(rows, ["session"], F.count("*").alias("speeches"), rollups.distinct("user_id").alias("speakers"), rollups.joined("event_type").alias("kinds"), F.date_format(F.min("ts"), "HH:mm").alias("starts"), F.date_format(F.max("ts"), "HH:mm").alias("ends"))


@register("session_presence", f"SELECT lang, CAST(sum((a > 0)::INT) AS BIGINT) AS kw_the_sessions, CAST(sum((b > 0)::INT) AS BIGINT) AS kw_que_sessions, count(*) AS sessions FROM (SELECT lang, source, sum(kw_the) AS a, sum(kw_que) AS b FROM {_LEDGER} GROUP BY lang, source) GROUP BY lang")
def session_presence(spark, sf_dir):
    return rollups.presence(_ledger(spark, sf_dir), ["lang"], ["source"], ["kw_the", "kw_que"])


@register("per_10k_words", f"SELECT source, CAST(sum(kw_the) AS BIGINT) AS kw_the, CAST(sum(w) AS BIGINT) AS words, round(sum(kw_the) * 10000.0::DOUBLE / sum(w), 2) AS kw_the_per_10000 FROM (SELECT l.*, len(string_split(d.text, ' ')) AS w FROM {_LEDGER} l JOIN documents d USING (doc_id)) GROUP BY source")
def per_10k_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("source", F.regexp_count("text", F.lit("the")).alias("k"), F.size(F.split("text", " ")).alias("w")).groupBy("source").agg(F.sum("k").alias("kw_the"), F.sum("w").alias("words"))
    return rollups.per_words(rows, ["kw_the"], "words")


@register("class_crosstab", "SELECT coalesce(nullif(trim(o_orderpriority), ''), '미상') AS o_orderpriority, count(*) AS total, count(*) FILTER (o_totalprice > 250000) AS high, count(*) FILTER (NOT o_totalprice > 250000) AS low, count(*) FILTER (o_totalprice > 250000) AS related, round(100.0 * count(*) FILTER (o_totalprice > 250000)::DOUBLE / count(*), 4) AS high_pct, round(100.0 * count(*) FILTER (NOT o_totalprice > 250000)::DOUBLE / count(*), 4) AS low_pct FROM orders GROUP BY 1")
def class_crosstab(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("half", F.when(F.col("o_totalprice") > 250000, "high").otherwise("low"))
    return rollups.group_stats(rows, PRIORITY, "half", ["high", "low"], "미상")


@register("month_pivot", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def month_pivot(spark, sf_dir):
    return rollups.pivot(series.month(table(spark, sf_dir, "orders"), "o_orderdate"), ["month"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))


@register("keyword_months", "WITH o AS (SELECT DISTINCT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, o_custkey FROM orders), b AS (SELECT o_orderpriority FROM o GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) SELECT o_orderpriority, month, count(*) AS units, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM o WHERE o_orderpriority IN (SELECT o_orderpriority FROM b) GROUP BY 1, 2")
def keyword_months(spark, sf_dir):
    rows = series.month(table(spark, sf_dir, "orders"), "o_orderdate")
    out = rollups.row_share(rollups.top_by_period(rows, PRIORITY, "month", ["o_custkey"], 3), [PRIORITY], "units")
    return out.withColumn("share", F.round("share", 6))


@register("family_density", "WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS total FROM orders GROUP BY 1), c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) SELECT month, o_orderstatus, n, total, round(n * 1000.0::DOUBLE / total, 3) AS n_per_1000 FROM c JOIN t USING (month)")
def family_density(spark, sf_dir):
    rows = series.month(table(spark, sf_dir, "orders"), "o_orderdate")
    counts = rows.groupBy("month", "o_orderstatus").agg(F.count("*").alias("n"))
    return series.density(counts, rows.groupBy("month").agg(F.count("*").alias("total")), "month", "n", "total").select("month", "o_orderstatus", "n", "total", "n_per_1000")


@register("dense_cube", "SELECT s.o_orderstatus, p.o_orderpriority, y.year, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) y LEFT JOIN (SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1, 2, 3) c ON c.o_orderstatus = s.o_orderstatus AND c.o_orderpriority = p.o_orderpriority AND c.year = y.year")
def dense_cube(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    axes = ["o_orderstatus", PRIORITY, "year"]
    return rollups.dense(rows.groupBy(*axes).agg(F.count("*").alias("n")), [(a, rollups.values_of(rows, a)) for a in axes], "n")


@register("modal_attributes", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def modal_attributes(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    best = rows.groupBy("user_id").agg(F.mode("event_type", True).alias("event_type"))
    return best.join(rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id", "event_type"])


@register("overall_summary", "SELECT count(*) AS rows, count(DISTINCT user_id) AS speakers, count(DISTINCT CAST(ts AS DATE)) AS meetings, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events")
def overall_summary(spark, sf_dir):
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("speakers"), F.countDistinct(day).alias("meetings"), F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"))


@register("insight_top_share", "WITH t AS (SELECT o_orderpriority, count(*) AS total, round(avg((o_totalprice > 250000)::INT), 6) AS share FROM orders GROUP BY 1), s AS (SELECT *, (total >= greatest(3, floor(sum(total) OVER () * 0.03)))::INT AS ok FROM t) SELECT o_orderpriority, total, share FROM s ORDER BY ok DESC, share DESC, o_orderpriority LIMIT 1")
def insight_top_share(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(PRIORITY).agg(F.count("*").alias("total"), F.round(F.avg((F.col("o_totalprice") > 250000).cast("int")), 6).alias("share"))
    return rollups.insight(rows, F.col("share"), PRIORITY)


@register("missing_values", "SELECT 'lang' AS \"column\", count(*) FILTER (coalesce(trim(lang), '') = '') AS missing FROM documents UNION ALL SELECT 'source', count(*) FILTER (coalesce(trim(source), '') = '') FROM documents UNION ALL SELECT 'text', count(*) FILTER (coalesce(trim(text), '') = '') FROM documents")
def missing_values(spark, sf_dir):
    return rollups.missing(table(spark, sf_dir, "documents"), ["lang", "source", "text"])


@register("top_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 6")
def top_per_group(spark, sf_dir):
    return rollups.top(table(spark, sf_dir, "customer"), 6, F.desc("c_acctbal"), F.asc("c_custkey"), by=["c_nationkey"]).select("c_nationkey", "c_custkey", "c_acctbal")


_MONTHLY = "(SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2)"


def _surge_sql(part: str) -> str:
    over = f"({part} ORDER BY o_orderstatus, month ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    return f"WITH p AS (SELECT *, lag(n) OVER (PARTITION BY o_orderstatus ORDER BY month) AS n_prev FROM {_MONTHLY}), m AS (SELECT *, CASE WHEN count(n_prev) OVER {over} >= 3 THEN avg(n_prev) OVER {over} END AS mean, CASE WHEN count(n_prev) OVER {over} >= 3 THEN stddev_samp(n_prev) OVER {over} END AS sd FROM p) SELECT o_orderstatus, month, n, n_prev, round(mean, 6) AS n_mean, round(sd, 6) AS n_std, coalesce(n > mean + 2 * sd, false) AS n_surge FROM m"


def _surge(spark, sf_dir, across):
    rows = series.month(table(spark, sf_dir, "orders"), "o_orderdate").groupBy("o_orderstatus", "month").agg(F.count("*").cast("double").alias("n"))
    out = series.surge(rows, ["month"], ["n"], by=["o_orderstatus"], across=across)
    return out.withColumns({"n_mean": F.round("n_mean", 6), "n_std": F.round("n_std", 6)})


@register("surge_by_group", _surge_sql("PARTITION BY o_orderstatus"))
def surge_by_group(spark, sf_dir):
    return _surge(spark, sf_dir, False)


@register("surge_across_groups", _surge_sql(""))
def surge_across_groups(spark, sf_dir):
    return _surge(spark, sf_dir, True)


@register("roster_first", "SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1")
def roster_first(spark, sf_dir):
    return roster.one_per_name(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], ["c_custkey"]).select("c_nationkey", "c_mktsegment", "c_custkey")


@register("roster_merge", "SELECT c_nationkey, n_dup, CASE WHEN n_dup > 1 THEN '동명이인(확인필요): ' || array_to_string(l, ' / ') ELSE l[1] END AS c_mktsegment FROM (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_dup, list_sort(list_distinct(list(coalesce(c_mktsegment, '')))) AS l FROM customer GROUP BY 1)")
def roster_merge(spark, sf_dir):
    return roster.one_per_name(table(spark, sf_dir, "customer"), ["c_nationkey"], [], "merge", ["c_mktsegment"], "c_mktsegment")


@register("roster_join", "SELECT o_orderkey, o_custkey, o_totalprice, coalesce(c_mktsegment, '미상/직책자') AS Party, CASE WHEN c_mktsegment IS NOT NULL THEN '의원' ELSE '미상/직책자' END AS Speaker_Type FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def roster_join(spark, sf_dir):
    people = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("Party"))
    return roster.join_roster(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), people, ["o_custkey"])


@register("roster_join_all", "SELECT o_orderkey, o_custkey, o_totalprice, coalesce(c_mktsegment, '미상/직책자') AS Party, CASE WHEN c_mktsegment IS NOT NULL THEN '의원' ELSE '미상/직책자' END AS Speaker_Type FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def roster_join_all(spark, sf_dir):
    """The join with the whole roster."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("Party"))
    return roster.join_roster(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), people, ["o_custkey"])


@register("name_inside", "WITH r AS (SELECT 'N' || n_nationkey AS m, n_nationkey AS o FROM nation), d AS (SELECT DISTINCT c_nationkey % 2 AS g, 'XN' || c_nationkey || 'Z' AS name FROM customer) SELECT g, name, m AS member FROM (SELECT g, name, m, row_number() OVER (PARTITION BY g, name ORDER BY length(m) DESC, o, m) AS k FROM d JOIN r ON contains(name, m)) WHERE k = 1")
def name_inside(spark, sf_dir):
    """Names inside longer names: N1 is inside XN12Z too, and the longest wins."""
    names = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 2).alias("g"), F.concat(F.lit("XN"), F.col("c_nationkey").cast("string"), F.lit("Z")).alias("name"))
    people = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("member"), F.col("n_nationkey").alias("o"), F.explode(F.array(F.lit(0), F.lit(1))).alias("g"))
    return roster.inside(names, people, "g", "name", "member", "o")


@register("fill_blanks", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def fill_blanks(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise(F.col("s_name")).alias("s_name"))
    src = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_name"))
    return roster.fill_blanks(rows, src, ["s_nationkey"], ["s_name"]).select("s_suppkey", "s_name")


@register("member_counts", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS members FROM customer GROUP BY 1")
def member_counts(spark, sf_dir):
    return roster.member_counts(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


_KAPPA = "WITH c AS (SELECT lang, quality AS x, toxic AS y, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT lang, sum(n) AS n, sum(CASE WHEN x = y THEN n ELSE 0 END) AS s FROM c GROUP BY 1), l AS (SELECT lang, x AS v, sum(n) AS a FROM c GROUP BY 1, 2), r AS (SELECT lang, y AS v, sum(n) AS b FROM c GROUP BY 1, 2), e AS (SELECT lang, sum(a::DOUBLE * b) AS p FROM l JOIN r USING (lang, v) GROUP BY 1) SELECT lang, CAST(n AS BIGINT) AS n, round(s::DOUBLE / n, 6) AS agreement, CASE WHEN abs(1 - coalesce(p, 0) / (n::DOUBLE * n)) >= 1e-12 THEN round((s::DOUBLE / n - coalesce(p, 0) / (n::DOUBLE * n)) / (1 - coalesce(p, 0) / (n::DOUBLE * n)), 6) END AS kappa FROM t LEFT JOIN e USING (lang)"


@register("kappa_by_group", _KAPPA)
def kappa_by_group(spark, sf_dir):
    out = agreement.kappa(_labels(spark, sf_dir), "quality", "toxic", ["lang"])
    return out.withColumns({"agreement": F.round("agreement", 6), "kappa": F.round("kappa", 6)})


@register("macro_f1", "WITH c AS (SELECT quality AS g, toxic AS m FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), v AS (SELECT DISTINCT g AS v FROM c UNION SELECT DISTINCT m FROM c), s AS (SELECT v, count(*) FILTER (g = v AND m = v) AS tp, count(*) FILTER (g = v) AS gold, count(*) FILTER (m = v) AS model FROM v CROSS JOIN c GROUP BY v) SELECT CAST(sum(gold) AS BIGINT) AS n, round(sum(tp)::DOUBLE / sum(gold), 6) AS accuracy, round(avg(coalesce(2.0::DOUBLE * tp / nullif(gold + model, 0), 0)), 6) AS macro_f1 FROM s")
def macro_f1(spark, sf_dir):
    out = agreement.scores(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.withColumns({"accuracy": F.round("accuracy", 6), "macro_f1": F.round("macro_f1", 6)})


@register("label_confusion", "SELECT CAST(quality AS VARCHAR) AS x, CAST(toxic AS VARCHAR) AS y, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2")
def label_confusion(spark, sf_dir):
    return agreement.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@register("label_distribution", "SELECT coalesce(CAST(toxic AS VARCHAR), '미라벨') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def label_distribution(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return agreement.distribution(rows, "toxic")


@register("pairwise_agreement", "SELECT round(avg((coalesce(CAST(quality AS VARCHAR), '') = coalesce(CAST(toxic AS VARCHAR), ''))::INT), 6) AS agreement FROM documents LEFT JOIN labels USING (doc_id)")
def pairwise_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return agreement.agreement(rows, "quality", "toxic").select(F.round("agreement", 6).alias("agreement"))


@register("confidence_histogram", "SELECT CAST(floor((l_quantity - 0.5) / 5) AS INT) + 1 AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return agreement.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 10, 0.5, 50.5)
