import math
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hustings.functions import text as tx
from hustings.operators import headers, keywords, turns
from hustings.plans import text_queries
from hustings.plans.session import ship

# Chunks with the title and the name that they begin with.
HEADERS = [
    ("의장이승만 지금제3차회의를개회하겠읍 니다.", "의장", "이승만"), ("사무총장전규홍 곧개회를하겠읍니다.", "사무총장", "전규홍"), ("부의장신익희 시방말씀하신", "부의장", "신익희"),
    ("위원장대리 송방용 이 안건에 대해서", "위원장대리", "송방용"), ("위원장대리백남식 그러면 다음", "위원장대리", "백남식"), ("사무총장대리 정홍섭 그 다음", "사무총장대리", "정홍섭"),
    ("국무총리서리 허정 지금 말씀드리겠읍니다", "국무총리서리", "허정"), ("법무부장관 이인 국적법 초안을 여러분에게", "법무부장관", "이인"), ("교통부장관 허정 인사의 말씀이 늦어서", "교통부장관", "허정"),
    ("운영위원장 조순 그러면 다음으로", "운영위원장", "조순"), ("위원 허정 의원선출 방법은 의장이", "위원", "허정"), ("조순 그러면 회의를 속개하겠습니다", "", "조순"), ("김철수 의원 이것은 말이 안 됩니다", "의원", "김철수"),
    ("의장 이 승만 그러면", "의장", "이승만"), ("법제사법위원장 이인 지금 보고드립니다", "법제사법위원장", "이인"), ("육군본부인사국장 김만수 저도 그렇게", "육군본부인사국장", "김만수"), ("증인 이원등 저는 그때", "증인", "이원등"),
    ("김철수(金哲洙) 의원 말씀드립니다", "의원", "김철수"), ("박순천 의원 지금 말씀드리면", "의원", "박순천"), ("증인 김활란 저는 그날", "증인", "김활란"), ("공보처장 김활란 보고드립니다", "공보처장", "김활란"),
    ("한국은행총재 김유택 금융 사정을", "한국은행총재", "김유택"), ("계엄사령관 이준식 계엄 상황은", "계엄사령관", "이준식"), ("심계원장 명제세 심계 결과를", "심계원장", "명제세"),
]
NAMES = "이승만 신익희 전규홍 허정 이인 조순 송방용 김두진 박흥규 백남식 변영태 이호 김훈 장면 정준 김식 이석 김철수 정홍섭 김만수 이원등".split()


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(k, c) for k, (c, _, _) in enumerate(HEADERS)], "k int, Speech_Chunk string")
    return {r.k: r for r in headers.flag_residual(headers.guess(headers.parse(rows, NAMES))).collect()}


@pytest.mark.parametrize("k", range(len(HEADERS)))
def test_headers(parsed, k):
    assert (parsed[k].Title_Role, parsed[k].Speaker) == HEADERS[k][1:]
    assert not parsed[k].Residual_Header_Flag


@pytest.mark.parametrize(("chunk", "title", "name", "speech"), [
    ("의장" + " " * 300 + "이승만 " + "말씀 " * 10, "의장", "이승만", ("말씀 " * 10).strip()),
    ("이" + " " * 200 + "승만 말씀", "", "이승만", "말씀"),
    ("의장" + ":" * 200 + "이승만 말씀", "의장", "이승만", "말씀"),
    ("의장 이승만 말씀\n둘째 줄 " + "가" * 3000, "의장", "이승만", "말씀\n둘째 줄 " + "가" * 3000),
    ("\x01의장 말씀", "", "", "\x01의장 말씀"),
    ("의장 말\x01씀\x01", "의장", "", "말\x01씀\x01"),
    ("의장", "의장", "", ""),
    ("", "", "", ""),
    (None, "", "", None),
])
def test_headers_of_any_length(spark, chunk, title, name, speech):
    got = headers.parse(spark.createDataFrame([(chunk,)], "Speech_Chunk string"), NAMES).first()
    assert (got.Title_Role, got.Speaker, got.Speech) == (title, name, speech)


def test_a_title_that_is_also_a_name(spark):
    got = headers.parse(spark.createDataFrame([("의장 말씀",)], "Speech_Chunk string"), ["의장"]).first()
    assert (got.Title_Role, got.Speaker, got.Speech) == ("의장", "의장", "말씀")


@given(st.sets(st.text("이승만인조", min_size=2, max_size=4), min_size=1, max_size=12), st.text("이승만인조 ", max_size=8))
def test_the_names_trie_is_the_alternation_longest_first(names, text):
    plain = "|".join(tx.spaced(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    for after in (r"", r"(?=\s|\Z)", r"조"):
        one, two = (re.match(f"(?:{p}){after}", text) for p in (headers.names_pattern(names), plain))
        assert (one and one[0]) == (two and two[0])


def test_no_names(spark):
    got = headers.parse(spark.createDataFrame([("의장 이승만 말씀",)], "Speech_Chunk string"), []).first()
    assert (got.Title_Role, got.Speaker, got.Speech) == ("의장", "", "이승만 말씀")


#: Counts of residuals, and by hand the names with the counts of their beginnings and of different residuals.
LEARNED = [
    ({**{f"이인{x}": 1 for x in "요시법지국"}, "송방용지금": 2, "송방용오늘": 2}, {"이인": (5, 5), "송방용": (4, 2)}),  # no letter prevails after 이인
    ({"이인국적법": 3, "이인지금질": 12}, {"이인지": (15, 2)}),  # one does in four of five
    ({"남궁억지금": 3, "남궁억말씀": 2}, {"남궁억": (5, 2)}),  # a fourth letter must prevail too
    ({"남궁억수": 7, "남궁억지": 2}, {"남궁억수": (9, 2)}),  # and may for a surname of two syllables
    ({"김철수오": 9}, {"김철수": (9, 1)}),  # but for no other
    ({"남궁억": 9}, {"남궁억": (9, 1)}),
    ({"그러면다음": 5}, {}),  # a stop word
    ({"가": 9, "ab말씀": 5}, {}),  # too short, no Hangul
    ({"송방용지": 2}, {}),  # too rare
    ({"송방용지": 3, "이인국적": 147}, {"이인국": (147, 1)}),  # 3 of 150 is too small a share
]


@pytest.mark.parametrize(("counter", "names"), LEARNED)
def test_name_learning(spark, counter, names):
    rows = spark.createDataFrame([(1, "장관", s, n) for s, n in counter.items()], "term int, role string, residual string, n int")
    assert {r.name: (r.n, r.distinct_residuals) for r in headers.learn(rows).collect()} == names


def test_ledger_learns_and_reparses(spark):
    ship(spark)
    texts = [f"장관 이인 {x}말씀" for x in "요시법지국"] + ["의장 이승만 개회", "증인 김활란 저는", "말씀만 있는 글"]
    got = headers.ledger(spark.createDataFrame([(1, t) for t in texts], "Assembly_Num int, Speech_Chunk string"), ["이승만"])
    by = {r.Speaker: (r.Speaker_Source, r.Role_Group) for r in got.collect()}
    assert by["이인"] == ("learned", "국무위원") and by["이승만"] == ("member", "의장단") and by["김활란"][0] == "fallback" and by[""][0] == "none"
    assert headers.diagnostics(got).first()["speeches"] == len(texts)


def test_segments(spark):
    text = "머리말\n◯의장 이승만 개회합니다\n계속\n(박수)\n\n뒤따름\n1. 개회\n◯위원 허정"
    got = [tuple(r)[1:] for r in turns.segments(spark.createDataFrame([(1, text), (2, None), (3, "")], "d int, Content string"), ["d"]).orderBy("d", "seq").collect()]
    assert got == [(1, "기타", "", "머리말"), (2, "발언", "의장 이승만", "개회합니다 계속"), (3, "기타", "", "박수"), (4, "기타", "", "뒤따름"), (5, "안건", "", "1. 개회"), (6, "발언", "위원 허정", "")]


def test_chunks_share_numbers_by_title(spark):
    docs = spark.createDataFrame([(1, "t", "◯a◯ ◯b"), (2, "t", "c"), (3, "u", None)], "o int, Title string, Content string")
    got = turns.chunks(docs, order="o").orderBy("Title", "Speech_Seq").collect()
    assert [(r.Title, r.Speech_Seq, r.Speech_Chunk) for r in got] == [("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c")]


def test_period_and_order(spark):
    rows = spark.createDataFrame([("1950-01-02", "b", "2"), ("1950-01-02", "b", "x"), ("", "a", "1"), ("1949-13-01", "c", "1"), ("1951-01-01", "a", "1")], "Date string, Title string, Seq string")
    assert turns.in_period(rows, "1950-01-01", "1950-12-31").count() == 2 and turns.in_period(rows, None, None).count() == 3
    assert [r.Date for r in turns.in_order(rows).collect()] == ["1950-01-02", "1950-01-02", "1951-01-01", "", "1949-13-01"]


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "c string").select(*[f(F.col("c")) for f in columns]).first())


def test_scalar_functions(spark):
    ship(spark)
    assert one(spark, "　 a b \n", tx.strip, tx.bare) == ("a b", "ab")
    assert one(spark, "abc", lambda c: tx.extract(c, "(x)"), lambda c: tx.count(c, "b")) == (None, 1)
    assert one(spark, None, lambda c: tx.count(c, "b"), tx.strip, tx.nfc) == (None, None, None)
    assert one(spark, "각ﬁ", tx.nfc, tx.nfkc) == ("각ﬁ", "각fi")
    assert one(spark, "U N 의\r\n말-----말  씀있읍니다", lambda c: tx.modern(tx.readable(c))) == ("UN 의 말 말 씀있습니다",)
    assert one(spark, "의 원 들 이 하 나 님 을◯말 ․ 씀", tx.historical) == ("의원 들이하나님을◯ 말․씀",)
    assert one(spark, "a\r\x00  b\n\n c ", tx.paragraph) == ("a b\nc",)
    assert one(spark, "제헌국회 회의", tx.term_of_text) == (1,) and one(spark, "제 3 대 국회", tx.term_of_text) == (3,) and one(spark, "글", tx.term_of_text) == (None,)
    assert one(spark, "제5대국회", tx.term, tx.term_name) == (None, "제5대")
    for name, want in (("제1회 (1948.06.01.).hwp", ("제1회", "1948-06-01")), ("회의___1948_05_31__.hwp", ("회의", "1948-05-31")), ("a 1950-02-03 b.hwp", ("a 1950-02-03 b", "1950-02-03")), ("x (1948.13.01.).hwp", ("x (1948.13.01.)", ""))):
        assert one(spark, name, lambda c: tx.file_title_date(c)[0], lambda c: tx.file_title_date(c)[1]) == want


def test_division_and_rounding(spark):
    assert spark.range(1).select(F.try_divide(F.lit(1.0), F.lit(0.0)), F.round(F.lit(0.125), 2)).first() == (None, 0.13)
    assert math.isclose(spark.range(1).select(F.round(F.lit(1450 / 5255214 * 1000), 3)).first()[0], 0.276)


def test_tagger_on_korean(spark):
    rows = spark.createDataFrame([("노 동력이 있다",), ("교포와 산업",), ("",), (None,)], "Content string")
    got = keywords.tag(rows).collect()
    assert (got[0].발전계열, got[0].발전키워드, got[0].발전키워드수, got[0].담론분류) == ("기술; 노동", "동력; 노동력", "2", "발전")
    assert got[1].담론분류 == "발전+경계" and got[2].담론분류 == got[3].담론분류 == "미분류" and got[3].경계담론 == "아니오"


def test_ledger_counts_on_korean(spark):
    ship(spark)
    got = keywords.ledger_counts(spark.createDataFrame([("이 민족과 이민, 외국인 외인",), (None,)], "Speech string")).collect()
    assert (got[0].Immigration, got[0].Foreigner, got[0].Keyword_Total, got[0].Discourse_Boundary, got[0].Keyword_Spaced_Extra) == (2, 2, 4, 4, 1)
    assert got[1].Keyword_Total == 0


def test_header_parse_all_keeps_every_document(spark, tmp_path):
    texts = [None, "", "한국어 본문", '"인용" 말', "(괄호) 말", "  앞 공백", "끝 공백 \n", "plain text"]
    rows = [(k, texts[k % 8]) for k in range(280)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = text_queries
    got = sorted(tuple(r) for r in q.header_parse_all(spark, str(tmp_path)).select("doc_id", "Title_Role", "Speaker", "speech_chars").collect())
    want = [(d, q.ROLES[d % 5] if d % 7 != 0 else "", q.NAMES[d % 3] if d % 7 != 1 else "", len((t or "").strip())) for d, t in rows]
    assert got == want
