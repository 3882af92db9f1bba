"""Queries of text operators: keywords, classes, turns, titles, headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import text as tx
from hustings.operators import headers, keywords, rollups, turns

from .catalog import register, table

#: A small lexicon for the driver tables: discourse -> family -> keywords.
LEXICON = {"grow": {"article": ["the", "and"], "ending": ["ing", "tion"]}, "edge": {"romance": ["que", "ent"], "german": ["der", "sch"]}}
#: The same as ledger groups, column -> (discourse, synonyms).
GROUPS = {"Article": ("grow", ["the", "and"]), "Ending": ("grow", ["ing"]), "Romance": ("edge", ["que", "ent"]), "German": ("edge", ["der"])}
CLASSES = ("grow", "edge", "grow+edge", "미분류")

_BARE = "regexp_replace(coalesce(text, ''), '[\\s\\x{FEFF}\\x{200B}\\x{00A0}]+', '', 'g')"


def _hit(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(b, '{w}')" for w in words) + ")"


_ALL = {d: [w for ws in f.values() for w in ws] for d, f in LEXICON.items()}
_TAGGED = f"SELECT *, {_BARE} AS b FROM "
_CLASS = f"CASE WHEN {_hit(_ALL['grow'])} AND {_hit(_ALL['edge'])} THEN 'grow+edge' WHEN {_hit(_ALL['grow'])} THEN 'grow' WHEN {_hit(_ALL['edge'])} THEN 'edge' ELSE '미분류' END"


def _listed(words: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(b, '{w}') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL), '; ')"


def _families(families: dict[str, list[str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_hit(ws)} THEN '{f}' END" for f, ws in families.items()) + "], lambda x: x IS NOT NULL), '; ')"


def _tag_sql() -> str:
    cols = []
    for d, fs in LEXICON.items():
        cols += [f"CASE WHEN {_hit(_ALL[d])} THEN '예' ELSE '아니오' END AS {d}담론", f"{_families(fs)} AS {d}계열", f"{_listed(_ALL[d])} AS {d}키워드", f"CAST({' + '.join(f'CAST(contains(b, {w!r}) AS INT)' for w in _ALL[d])} AS VARCHAR) AS {d}키워드수"]
    return f"SELECT doc_id, {', '.join(cols)}, {_CLASS} AS 담론분류 FROM ({_TAGGED} documents)"


@register("tagger", _tag_sql())
def tagger(spark, sf_dir):
    made = keywords.tag(table(spark, sf_dir, "documents"), LEXICON, "text")
    return made.drop("text", "lang", "source", "n_chars")


_PCT = ", ".join(f"round(100.0 * CAST(count(*) FILTER (c = '{c}') AS DOUBLE) / count(*), 4) AS \"{c}_pct\"" for c in CLASSES)
_COUNTS = ", ".join(f"count(*) FILTER (c = '{c}') AS \"{c}\"" for c in CLASSES)


@register("class_by_role", f"SELECT role, count(*) AS total, {_COUNTS}, count(*) FILTER (c <> '미분류') AS related, {_PCT} FROM (SELECT role, {_CLASS} AS c FROM ({_TAGGED} conversations)) GROUP BY role")
def class_by_role(spark, sf_dir):
    """The flagship: tagged turns, classes by speaker's role."""
    made = keywords.tag(table(spark, sf_dir, "conversations"), LEXICON, "text")
    return rollups.class_counts(made, ["role"], "담론분류", CLASSES)


@register("keyword_counts", "SELECT doc_id, " + ", ".join(f"coalesce(CAST(len(regexp_extract_all(text, '{k}')) AS INT), 0) AS {k}" for k in ("the", "tion", "que", "license")) + " FROM documents")
def keyword_counts(spark, sf_dir):
    return keywords.plain_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), ["the", "tion", "que", "license"], "text").drop("text")


def _loose(word: str) -> str:
    return r"len(regexp_extract_all(t, '" + r"[\s\x{00A0}]*".join(word) + "'))"


def _ledger_inner() -> str:
    t = "text"
    t = f"regexp_replace({t}, '[\\r\\n\\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '-{{3,}}|_{{3,}}', ' ', 'g')"
    cols = [f"CAST({' + '.join(_loose(w) for w in ws)} AS INT) AS {n}" for n, (_, ws) in GROUPS.items()]
    strict = " + ".join(f"len(regexp_extract_all(t, '{w}'))" for _, ws in GROUPS.values() for w in ws)
    return f"SELECT id, {', '.join(cols)}, CAST({strict} AS INT) AS strict FROM (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace({t}, '\\s{{2,}}', ' ', 'g')) AS t FROM conversations)"


@register("ledger_counts", f"SELECT id, Article, Ending, Romance, German, Article + Ending + Romance + German AS Keyword_Total, Article + Ending AS Discourse_Grow, Romance + German AS Discourse_Edge, Article + Ending + Romance + German - strict AS Keyword_Spaced_Extra FROM ({_ledger_inner()})")
def ledger_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return keywords.ledger_counts(rows, GROUPS, "text").drop("text")


@register("chunk_split", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) AS INT) AS Speech_Seq, md5(c) AS digest FROM (SELECT doc_id, p, trim(list_extract(l, p), chr(32) || chr(9) || chr(10) || chr(13)) AS c FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents))) WHERE c <> ''")
def chunk_split(spark, sf_dir):
    rows = turns.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", mark=r"\. ", titles_differ=True)
    return rows.select("doc_id", "Speech_Seq", F.md5("Speech_Chunk").alias("digest"))


@register("turn_segments", """
WITH lines AS (SELECT doc_id, p, trim(list_extract(l, p), chr(32) || chr(9) || chr(13)) AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
k AS (SELECT *, CASE WHEN s LIKE 'Th%' THEN 'turn' WHEN regexp_matches(s, '^\\(.*\\)$') THEN 'note' WHEN regexp_matches(s, '^[0-9]+[.)]\\s*\\S') THEN 'item' END AS kind FROM lines WHERE s <> ''),
o AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS open FROM k),
q AS (SELECT *, CAST(sum(CASE WHEN kind IS NOT NULL OR coalesce(open, '') <> 'turn' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS INT) AS seq FROM o)
SELECT doc_id, seq, CASE arg_min(coalesce(kind, '-'), p) WHEN 'turn' THEN '발언' WHEN 'item' THEN '안건' ELSE '기타' END AS type FROM q GROUP BY doc_id, seq
""")
def turn_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return turns.segments(docs, ["doc_id"], "text", mark="Th").select("doc_id", "seq", "type")


_THIRD = "array_to_string(list_slice(string_split(w, ' '), 3, 1000000), ' ')"


@register("turn_texts", f"""
WITH lines AS (SELECT doc_id, p, regexp_replace(list_extract(l, p), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
k AS (SELECT *, CASE WHEN s LIKE 'Th%' THEN 'turn' WHEN regexp_matches(s, '^\\(.*\\)$') THEN 'note' WHEN regexp_matches(s, '^[0-9]+[.)]\\s*\\S') THEN 'item' END AS kind FROM lines WHERE s <> ''),
o AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS open FROM k),
q AS (SELECT *, regexp_replace(substr(s, 3), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') AS w, CAST(sum(CASE WHEN kind IS NOT NULL OR coalesce(open, '') <> 'turn' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS INT) AS seq FROM o),
r AS (SELECT *, CASE kind WHEN 'turn' THEN {_THIRD} WHEN 'note' THEN regexp_replace(s, '^\\(\\s*|\\s*\\)$', '', 'g') ELSE s END AS part, CASE kind WHEN 'turn' THEN array_to_string(list_slice(string_split(w, ' '), 1, 2), ' ') ELSE '' END AS who FROM q)
SELECT doc_id, seq, max(who) AS speaker, md5(coalesce(string_agg(part, ' ' ORDER BY p) FILTER (part <> ''), '')) AS digest FROM r GROUP BY doc_id, seq
""")
def turn_texts(spark, sf_dir):
    """Speakers and what they say, beside the types of turn_segments."""
    rows = turns.segments(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", mark="Th")
    return rows.select("doc_id", "seq", "speaker", F.md5("content").alias("digest"))


_TITLE = "'제' || (o_orderkey % 6 + 1) || '대국회 제' || (o_orderkey % 30) || '회(임시회) 제' || (o_orderkey % 12) || '차 국회본회의(전체회의) (' || strftime(o_orderdate, '%Y.%m.%d.') || ')'"


@register("title_parts", f"""
SELECT o_orderkey, CASE WHEN a BETWEEN 1 AND 4 THEN a END AS term, CASE WHEN a = 1 THEN '제헌' ELSE '제' || a || '대' END AS term_name, CAST(o_orderkey % 30 AS INT) AS Session_No, '임시회' AS Session_Type,
CAST(o_orderkey % 12 AS INT) AS Sitting_No, '국회본회의' AS Meeting_Body, strftime(o_orderdate, '%Y-%m-%d') AS date, a || '-' || strftime(o_orderdate, '%Y-%m-%d') || '-S' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 3, '0') || '-M' || lpad(CAST(o_orderkey % 12 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0') AS speech_id
FROM (SELECT DISTINCT o_orderkey, o_orderdate, CAST(o_orderkey % 6 + 1 AS INT) AS a, {_TITLE} AS title FROM orders)""")
def title_parts(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    title = F.concat(F.lit("제"), s(k % 6 + 1), F.lit("대국회 제"), s(k % 30), F.lit("회(임시회) 제"), s(k % 12), F.lit("차 국회본회의(전체회의) ("), F.date_format("o_orderdate", "yyyy.MM.dd."), F.lit(")"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").distinct().withColumn("t", title)
    t, parts = F.col("t"), tx.title_parts(F.col("t"))
    date = tx.day(tx.title_date(t))
    n = tx.term_of_text(F.regexp_replace("t", "대국회", "대 국회"))
    return rows.select("o_orderkey", tx.term(t).alias("term"), tx.term_name(t).alias("term_name"), *[v.alias(c) for c, v in parts.items()], date.cast("string").alias("date"), tx.speech_id(n, date, parts["Session_No"], parts["Sitting_No"], k % 1000).alias("speech_id"))


NAMES = ["이승만", "신익희", "전규홍", "허정", "이인"]
ROLES = ["의장", "법무부장관", "운영위원장", "증인", "의원"]
_ROLE, _NAME = (f"list_extract([{', '.join(repr(x) for x in xs)}], CAST({e} AS INT))" for xs, e in ((ROLES, "doc_id % 5 + 1"), (NAMES, "doc_id % 3 + 1")))
_GROUP = "list_extract(['의장단', '국무위원', '위원장', '증인·참고인', '의원'], CAST(doc_id % 5 + 1 AS INT))"


@register("header_parse", f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_ROLE} END AS Title_Role, CASE WHEN doc_id % 7 = 1 THEN '' ELSE {_NAME} END AS Speaker, CASE WHEN doc_id % 7 = 0 THEN '미상' ELSE {_GROUP} END AS Role_Group, CAST(length(text) AS INT) AS speech_chars FROM documents WHERE regexp_matches(text, '^[A-Za-zÀ-ÿ0-9]') AND NOT regexp_matches(text, '\\s$')")
def header_parse(spark, sf_dir):
    """Headers written in front of the documents and parsed again: title and name, title alone, name alone."""
    return _headed(table(spark, sf_dir, "documents").filter(F.col("text").rlike("^[A-Za-zÀ-ÿ0-9]") & ~F.col("text").rlike("\\s\\z")))


#: Unicode's white space, and what may stand between a header and its speech.
_BLANK = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@register("header_parse_all", f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_ROLE} END AS Title_Role, CASE WHEN doc_id % 7 = 1 THEN '' ELSE {_NAME} END AS Speaker, CASE WHEN doc_id % 7 = 0 THEN '미상' ELSE {_GROUP} END AS Role_Group, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '^[{_BLANK},.·、，]+', ''), '[{_BLANK}]+$', '')) AS INT) AS speech_chars FROM documents")
def header_parse_all(spark, sf_dir):
    """The same over every document: null and empty texts, any first character, white space at the end."""
    return _headed(table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))))


def _headed(docs):
    d = F.col("doc_id")
    role, name = (F.element_at(F.array(*[F.lit(x) for x in xs]), (d % n + 1).cast("int")) for xs, n in ((ROLES, 5), (NAMES, 3)))
    chunk = F.when(d % 7 == 0, F.concat(name, F.lit(" "), "text")).when(d % 7 == 1, F.concat(role, F.lit(" "), "text")).when(d % 7 == 2, F.concat(name, F.lit(" "), role, F.lit(" "), "text")).otherwise(F.concat(role, name, F.lit(" "), "text"))
    rows = headers.parse(docs.select("doc_id", chunk.alias("Speech_Chunk")), NAMES)
    return rows.select("doc_id", "Title_Role", "Speaker", tx.role_group(F.col("Title_Role")).alias("Role_Group"), F.char_length("Speech").alias("speech_chars"))


@register("name_learning")
def name_learning(spark, sf_dir):
    """Names learned from headers whose names no gazetteer lists. Greedy growth isn't SQL; tests hold it against a model."""
    d = F.col("doc_id")
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (d % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.lit(1).alias("Assembly_Num"), F.concat(F.lit("장관 "), name, F.element_at(F.array(*[F.lit(x) for x in "요시법지국"]), (d % 7 % 5 + 1).cast("int")), F.lit("말씀")).alias("Speech_Chunk"))
    return headers.learn(headers.candidates(headers.parse(docs, [])))


@register("clean_text", "SELECT doc_id, md5(regexp_replace(text, '[\\s\\x{00A0}\\x{FEFF}\\x{200B}]+', '', 'g')) AS bare, md5(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\\r', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{00A0}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '^$', ''))) AS paragraphs FROM documents")
def clean_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.bare(t)).alias("bare"), F.md5(tx.paragraph(t)).alias("paragraphs"))


@register("normal_forms", "SELECT doc_id, md5(nfc_normalize(text)) AS nfc FROM documents")
def normal_forms(spark, sf_dir):
    from .session import ship

    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.nfc(F.col("text"))).alias("nfc"))
