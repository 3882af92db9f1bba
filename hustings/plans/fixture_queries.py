"""Queries over small written tables, for what the driver tables don't hold: Korean headers and names, files, sinks.

Each SQL is the rows worked out by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import text as tx
from hustings.operators import headers, keywords, rollups, turns
from hustings.sources import documents, pdf, sinks, tables
from hustings.streaming import landing

from . import storage
from .catalog import register
from .session import ship


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple], where: str = "TRUE") -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({columns}) WHERE {where}"


#: Chunks with the title, the name, the speech and the guess that they give.
_HEADERS = [
    ("의장이승만 지금 개회합니다", "의장", "이승만", "지금 개회합니다", False),
    ("법무부장관 이인 국적법 초안을", "법무부장관", "이인", "국적법 초안을", False),
    ("이 승만 의장 말씀드립니다", "의장", "이승만", "말씀드립니다", False),
    ("이" + " " * 200 + "승만 말씀", "", "이승만", "말씀", False),
    ("의장" + ":" * 200 + "이승만 말씀", "의장", "이승만", "말씀", False),
    ("의장(임시)이인(李仁) 말씀", "의장", "이인", "말씀", False),
    ("의장 그러면 다음", "의장", "", "그러면 다음", False),
    ("증인 김활란 저는 그날", "증인", "김활란", "저는 그날", True),
    ("박순천 의원 지금 말씀", "의원", "박순천", "지금 말씀", True),
    ("이인수 말씀", "", "", "이인수 말씀", False),
    ("말씀만 있는 글", "", "", "말씀만 있는 글", False),
    ("이인", "", "이인", "", False),
]


@register("header_fixture", _values("k, Title_Role, Speaker, Speech, guessed", [(k, *h[1:]) for k, h in enumerate(_HEADERS)]))
def header_fixture(spark, sf_dir):
    """Titles and names in either order, apart by any white space or signs, known or guessed."""
    rows = spark.createDataFrame([(k, h[0]) for k, h in enumerate(_HEADERS)], "k int, Speech_Chunk string")
    made = headers.guess(headers.parse(rows, ["이승만", "이인", "이"]))
    return made.select("k", "Title_Role", "Speaker", "Speech", F.col("_fallback_used").alias("guessed"))


#: Chunks of one term, the last column being their number.
_LEDGER = [*[f"장관 이인 {x}말씀" for x in "요시법지국"], "의장 이승만 개회", "증인 김활란 저는", "말씀만 있는 글", "위원장 그러면", "이 승만 다시"]
_LEDGER_ROWS = [
    *[(k, "장관", "이인", f"{x}말씀", "learned", "국무위원", False) for k, x in enumerate("요시법지국")], (5, "의장", "이승만", "개회", "member", "의장단", False), (6, "증인", "김활란", "저는", "fallback", "증인·참고인", False),
    (7, "", "", "말씀만 있는 글", "none", "미상", False), (8, "위원장", "", "그러면", "none", "위원장", False), (9, "", "이승만", "다시", "member", "미상", False),
]


def _ledger(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(_LEDGER)], "Assembly_Num int, k int, Speech_Chunk string")
    return headers.ledger(rows, ["이승만"])


@register("ledger_fixture", _values("k, Title_Role, Speaker, Speech, Speaker_Source, Role_Group, Residual_Header_Flag", _LEDGER_ROWS))
def ledger_fixture(spark, sf_dir):
    """Both passes: names learned from what follows a title, then parsed, guessed and flagged."""
    return _ledger(spark).select("k", "Title_Role", "Speaker", "Speech", "Speaker_Source", "Role_Group", "Residual_Header_Flag")


@register("candidate_fixture", _values("term, role, residual, n", [(1, "장관", f"이인{x}말씀", 1) for x in "요시법지국"] + [(1, "증인", "김활란저는", 1), (1, "위원장", "그러면", 1), (1, "의장", "이승만개회", 1)]))
def candidate_fixture(spark, sf_dir):
    rows = spark.createDataFrame([(1, t) for t in _LEDGER], "Assembly_Num int, Speech_Chunk string")
    return headers.candidates(headers.parse(rows, []))


@register("learned_fixture", _values("term, role, name, n, distinct_residuals", [(1, "장관", "이인", 5, 5)]))
def learned_fixture(spark, sf_dir):
    return headers.learn(candidate_fixture(spark, sf_dir))


@register("diagnostics_fixture", _values("item, n", [("speeches", 10), ("named", 8), ("unmatched", 1), ("title_only", 1), ("residual", 0), ("without_party", 6), ("spaced_names", 1), ("learned", 5), ("member", 2), ("fallback", 1), ("none", 2)]))
def diagnostics_fixture(spark, sf_dir):
    """Counts of the ledger, of its join with a roster of one member, and of its sources."""
    rows = _ledger(spark).withColumn("Party", F.when(F.col("Speaker") == "이승만", "가").otherwise("미상/직책자"))
    tall = lambda df: df.unpivot([], df.columns, "item", "n")
    joined = headers.join_diagnostics(rows).select("without_party", "spaced_names")
    return tall(headers.diagnostics(rows)).union(tall(joined)).union(headers.source_shares(rows).select("source", "speeches")).withColumn("n", F.col("n").cast("int"))


_NAMES = [("제1회 (1948.06.01.).hwp", "제1회", "1948-06-01"), ("회의___1948_05_31__.hwp", "회의", "1948-05-31"), ("a 1950-02-03 b.hwp", "a 1950-02-03 b", "1950-02-03"), ("x (1948.13.01.).hwp", "x (1948.13.01.)", ""), ("날짜 없음.hwp", "날짜 없음", "")]


@register("file_name_fixture", _values("name, title, date", _NAMES))
def file_name_fixture(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n, _, _ in _NAMES], "name string")
    title, date = tx.file_title_date(F.col("name"))
    return rows.select("name", title.alias("title"), date.alias("date"))


#: Texts by their number with the person's key, the present spelling, the historical and the short cleaning.
_TEXTS = [
    ("이 승\u00a0만", "이승만", "이 승\u00a0만", "이 승 만", "이 승 만"),
    ("하였읍니다 있읍니다", "하였읍니다있읍니다", "하였습니다 있습니다", "하였읍니다 있읍니다", "하였읍니다 있읍니다"),
    ("의 원 들 이 하 나 님 을", "의원들이하나님을", "의 원 들 이 하 나 님 을", "의원 들이하나님을", "의 원 들이하 나 님을"),
]


@register("spelling_fixture", _values("k, person, modern, historical, tidy", [(k, *t[1:]) for k, t in enumerate(_TEXTS)]))
def spelling_fixture(spark, sf_dir):
    ship(spark)
    t = F.col("t")
    rows = spark.createDataFrame([(k, x[0]) for k, x in enumerate(_TEXTS)], "k int, t string")
    return rows.select("k", tx.person(t).alias("person"), tx.modern(t).alias("modern"), tx.historical(t).alias("historical"), tx.tidy(t).alias("tidy"))


@register("composed_fixture", _values("k, nfkc, total, extra", [(0, "UN 이민 외국인", 2, 0), (1, "이 민족 이민", 2, 1), (2, "ABC 기술", 1, 0)]))
def composed_fixture(spark, sf_dir):
    """Compatibility forms, and the ledger's own keyword groups on Korean text."""
    ship(spark)
    rows = spark.createDataFrame([(0, "U N\r\n이민 외국인"), (1, "이 민족 이민"), (2, "ＡＢＣ 기술")], "k int, Speech string")
    made = keywords.ledger_counts(rows)
    return made.select("k", tx.nfkc(tx.readable(F.col("Speech"))).alias("nfkc"), F.col("Keyword_Total").alias("total"), F.col("Keyword_Spaced_Extra").alias("extra"))


@register("korean_tags_fixture", _values("k, dev, dev_families, dev_words, n, edge, class", [(0, "예", "기술; 노동", "동력; 노동력", "2", "아니오", "발전"), (1, "예", "기술", "산업", "1", "예", "발전+경계"), (2, "아니오", "", "", "0", "아니오", "미분류")]))
def korean_tags_fixture(spark, sf_dir):
    rows = spark.createDataFrame([(0, "노 동력이 있다"), (1, "교포와 산업"), (2, None)], "k int, Content string")
    made = keywords.tag(rows)
    return made.select("k", F.col("발전담론").alias("dev"), F.col("발전계열").alias("dev_families"), F.col("발전키워드").alias("dev_words"), F.col("발전키워드수").alias("n"), F.col("경계담론").alias("edge"), F.col("담론분류").alias("class"))


_MINUTES = "머리말\n◯의장 이승만 개회합니다\n계속\n(박수)\n\n뒤따름\n1. 개회\n이어서\n◯위원 허정"


@register("turn_fixture", _values("seq, type, speaker, content", [(1, "기타", "", "머리말"), (2, "발언", "의장 이승만", "개회합니다 계속"), (3, "기타", "", "박수"), (4, "기타", "", "뒤따름"), (5, "안건", "", "1. 개회"), (6, "기타", "", "이어서"), (7, "발언", "위원 허정", "")]))
def turn_fixture(spark, sf_dir):
    return turns.segments(spark.createDataFrame([(1, _MINUTES), (2, None), (3, " \n ")], "d int, Content string"), ["d"]).drop("d")


@register("until_fixture", _values("date", [("1949.01.10.",), ("1960.04.27.",)]))
def until_fixture(spark, sf_dir):
    return turns.until(spark.createDataFrame([("1949.01.10.",), ("1960.04.27.",), ("1960.04.28.",), (None,)], "date string"), "1960.04.27.", "date")


@register("attachment_fixture", _values("k, name, safe", [(0, "회의록 1+2.pdf", "회의록 1+2.pdf"), (1, "a:b?.pdf", "a_b_.pdf"), (2, None, None)]))
def attachment_fixture(spark, sf_dir):
    rows = spark.createDataFrame([(0, "attachment; filename=\"x.pdf\"; filename*=UTF-8''%ED%9A%8C%EC%9D%98%EB%A1%9D%201+2.pdf"), (1, 'inline; filename="a:b?.pdf"'), (2, "inline")], "k int, h string")
    return rows.select("k", tx.attachment_name(F.col("h")).alias("name"), tx.safe_name(tx.attachment_name(F.col("h"))).alias("safe"))


@register("per_head_fixture", _values("k, per_speech", [(0, 1.5), (1, None)]))
def per_head_fixture(spark, sf_dir):
    rows = spark.createDataFrame([(0, 1, 2, 2), (1, 3, None, 0)], "k int, a int, b int, n int")
    return rollups.per_head(rows, ["a", "b"], "n", "per_speech").select("k", "per_speech")


def _folder(spark, files: dict[str, bytes]) -> str:
    """A folder of small files where all executors see it."""
    at = storage.path(spark, "fixture")
    context = spark.sparkContext
    for name, content in files.items():
        where = context._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(content))
        out.close()
    return at


@register("roster_fixture", _values("Assembly_Num, Speaker, Party, Region, file_order", [(1, "이승만", "자유당", None, "제1대국회_명단.csv"), (1, "허정", None, None, "제1대국회_명단.csv"), (2, "조순", "민주당", "서울", "제2대국회_명단.csv")]))
def roster_fixture(spark, sf_dir):
    """Rosters of two encodings, with a header below a first line and without one."""
    at = _folder(spark, {"제1대국회_명단.csv": "\ufeff설명,,\n번호,대수,의원명,소속위원회,정당\n1,1,이 승만,외무,자유당\n2,,허정,,\n".encode(), "제2대국회_명단.csv": "1,2,조 순,위원회,민주당,서울,남,1,보선\n".encode("cp949")})
    out = storage.stored(tables.rosters(spark, at).select("Assembly_Num", "Speaker", "Party", "Region", F.try_url_decode("file_order").alias("file_order")), "rosters")
    storage.delete(spark, at)
    return out


@register("minutes_fixture", _values("Title, Content, Title_Role", [("t", 'a "b"\nc', ""), ("u", "", "의장")]))
def minutes_fixture(spark, sf_dir):
    """A CSV with a byte order mark, quotes, a field of two lines and a short row; an optional list of officers."""
    at = _folder(spark, {"m.csv": '\ufeffTitle,Content\nt,"a ""b""\nc"\nu\n'.encode(), "o.csv": "Assembly_Num,Title_Role,Speaker\n1,의장,u\n".encode()})
    rows = tables.padded(tables.minutes(spark, tables.first_file(spark, at, "m")), ["Title", "Content"])
    people = tables.officers(spark, f"{at}/o.csv").unionByName(tables.officers(spark, None)).select(F.col("Speaker").alias("Title"), "Title_Role")
    out = storage.stored(tables.padded(rows.join(people, "Title", "left"), []), "minutes")
    storage.delete(spark, at)
    return out


#: A PDF file of two pages: one plain, with an escape and a kerned array, one deflated, through a Unicode map.
def _pdf() -> bytes:
    import zlib

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <C758> endbfchar 1 beginbfrange <0002> <0003> <C7A5> endbfrange"
    first, second = b"BT /F1 12 Tf (One \\(1\\)) Tj 0 -14 Td [(t) -20 (wo) -300 (words)] TJ ET", zlib.compress(b"BT /F2 9 Tf <00010002> Tj ET")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(first), first), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(second), second), b"<< /Type /Font /BaseFont /Helvetica >>", b"<< /Type /Font /ToUnicode 9 0 R >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@register("pdf_fixture", _values("Title, Date, Status, Content", [("회의", "1949-01-10", documents.OK, "One (1) two words 의장"), ("나쁨", "", documents.FAILED, "[ERROR] no PDF file")]))
def pdf_fixture(spark, sf_dir):
    at = _folder(spark, {"회의 (1949.01.10.).pdf": _pdf(), "나쁨.pdf": b"xx"})
    rows = documents.extract(spark.read.format("binaryFile").load(at).withColumn("path", F.try_url_decode("path")), pdf.pdf)
    out = storage.stored(rows.select("Title", "Date", "Status", "Content"), "pdf")
    storage.delete(spark, at)
    return out


@register("landing_fixture", _values("Title, Status, Content", [("회의", documents.OK, "One (1) two words 의장"), ("나쁨", documents.FAILED, None)]))
def landing_fixture(spark, sf_dir):
    """A stream over a landing folder, restarted once: settled files are read once, failures are kept apart."""
    at = _folder(spark, {"회의 (1949.01.10.).pdf": _pdf(), "나쁨.pdf": b"xx"})
    if landing.settled(spark, at, "*.pdf", 0.1).count() != 2:
        raise ValueError("the files didn't settle")
    places = [storage.path(spark, n) for n in ("landed", "failed", "checkpoint")]
    for _ in range(2):
        landing.ingest(spark, at, *places, pattern="*.pdf", extractor=pdf.pdf).awaitTermination()
    title = lambda df: df.withColumn("Title", F.coalesce(F.try_url_decode("Title"), "Title"))
    whole = title(spark.read.parquet(places[0])).select(F.regexp_replace("Title", r" \(.*", "").alias("Title"), F.lit(documents.OK).alias("Status"), "Content")
    failed = title(spark.read.parquet(places[1])).select("Title", "Status", F.lit(None).cast("string").alias("Content"))
    out = storage.stored(whole.union(failed), "landing")
    for p in (at, *places):
        storage.delete(spark, p)
    return out


@register("sink_fixture", _values("sink, k, t", [("csv", 1, "a, b"), ("csv", 2, "말"), ("parquet", 1, "a, b"), ("parquet", 2, "말")]))
def sink_fixture(spark, sf_dir):
    """Tables written and read again."""
    at = storage.path(spark, "sinks")
    rows = spark.createDataFrame([(1, "a, b"), (2, "말")], "k int, t string")
    sinks.csv(rows, f"{at}/csv")
    sinks.parquet(rows, f"{at}/parquet", ("k",))
    back = spark.read.option("header", True).schema("k int, t string").csv(f"{at}/csv").select(F.lit("csv").alias("sink"), "k", "t")
    out = storage.stored(back.union(spark.read.schema("k int, t string").parquet(f"{at}/parquet").select(F.lit("parquet"), "k", "t")), "sink")
    storage.delete(spark, at)
    return out
