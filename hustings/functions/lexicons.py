"""Lexicons, sentinels and grammar parts. All of them are fixed values and the defaults of parameters elsewhere."""

# The ledger's keyword groups, column -> (discourse, synonyms).
LEDGER = {
    "Technology": ("development", ["기술"]),
    "Income": ("development", ["소득"]),
    "Labor": ("development", ["노동"]),
    "Immigration": ("boundary", ["이민"]),
    "Migration": ("boundary", ["이주"]),
    "Foreigner": ("boundary", ["외국인", "외인", "타국인"]),
}

# The tagger's lexicon, discourse -> family -> keywords.
TAGGER = {
    "발전": {
        "기술": ["산업", "공업", "생산", "기계", "기계화", "동력", "전력", "발전소", "개발", "건설", "부흥", "재건", "시설"],
        "소득": ["물가", "생활비", "임금", "급여", "봉급", "물자", "생계", "경제", "재정", "예산", "국민소득", "세입"],
        "노동": ["노무자", "근로자", "근로", "노동조합", "노조", "실업", "취업", "고용", "근로기준", "노동력", "노동자"],
    },
    "경계": {
        "이민": ["교포", "동포", "이주민", "이민자", "해외동포", "재외국민", "귀환동포", "재일교포", "재중교포"],
        "이주": ["이동", "인구이동", "유입", "유출", "정착", "피난민", "난민", "월남민", "실향민"],
        "외국인": ["외인", "외래", "화교", "왜인", "미군", "미인", "미국인", "양인", "이방인", "외지인"],
    },
}

# Marks and sentinels of the data model.
TURN_MARK = "◯"
UNKNOWN = "미상"
UNKNOWN_OR_OFFICER = "미상/직책자"
MEMBER = "의원"
HOMONYM = "동명이인(확인필요): "
SPEECH, AGENDA, OTHER = "발언", "안건", "기타"
CLASSES = ("발전", "경계", "발전+경계", "미분류")

# Titles that a speech header may begin with, in order of precedence.
TITLE_CORE = (
    "[가-힣]{0,10}위원회[가-힣]{0,6}(?:위원장|부위원장|사무총장|간사|위원)",
    "[가-힣]{0,10}위원장",
    "[가-힣]{0,8}장관",
    "[가-힣]{0,8}차관",
    "[가-힣]{0,10}처장",
    "[가-힣]{0,10}차장",
    "[가-힣]{0,10}부장",
    "[가-힣]{0,10}국장",
    "[가-힣]{0,10}청장",
    "[가-힣]{0,10}실장",
    "[가-힣]{0,10}총장",
    "[가-힣]{0,10}원장",
    "[가-힣]{1,10}총재",
    "[가-힣]{2,10}사령관",
    "[가-힣]{1,10}지사",
    "[가-힣]{2,10}시장",
    "[가-힣]{2,10}(?:준장|중장|대령)",
    "임시의장|부의장|의장",
    "국무총리|국무위원|정부위원|전문위원",
    "위원|의원|증인|참고인|서기관|서기",
)
TITLE_SUFFIX = ("직무대리", "권한대행", "직무대행", "대리", "서리", "대행")

# Role groups, in order of precedence.
ROLE_GROUPS = (
    ("국무총리|국무위원|장관|차관", "국무위원"),
    ("의장", "의장단"),
    ("위원장", "위원장"),
    ("정부위원|청장|국장|실장|부장", "정부위원"),
    ("사무총장|서기", "사무처"),
    ("증인|참고인", "증인·참고인"),
    ("의원|^위원$|전문위원", "의원"),
)

# First words of speeches that are no names, and surnames of two syllables.
STOPWORDS = (
    "그러 그러면 그런데 그리고 그것 그거 지금 이것 이거 저는 우리 오늘 어제 내일 다음 이번 지난 여러 "
    "회의 의사 국회 본회 의장 위원 의원 정부 대한 명단 출석 결석 전문 조사 감사 보고 동의 재청 "
    "개회 폐회 산회 속개 표결 가결 부결 제안 설명 질의 답변 발언 말씀 지금부 잠깐 먼저 다시 아까 "
    "여기 거기 저기 이상 이하 제일 제이 제삼 무슨 어떤 어떻 왜냐 만일 만약 물론 사실 실은 특히"
).split()
COMPOUND_SURNAMES = ("남궁", "황보", "선우", "독고", "사공", "서문", "제갈")

# Old spellings and their present forms.
LEGACY_SPELLING = (("있읍니다", "있습니다"), ("없읍니다", "없습니다"), ("하였읍니다", "하였습니다"), ("되었읍니다", "되었습니다"), ("드리겠읍니다", "드리겠습니다"), ("됩니다마는", "됩니다만"))
# Words that scans split, and particles and endings that belong to the word before them.
SPLIT_WORDS = ("의원", "임시의장", "부의장", "하나님", "국회", "선거위원회", "투표", "결선투표")
PARTICLES = (
    "가|이|은|는|을|를|의|에|과|와|도|로|으로|고|며|면|하|하고|하여|해서|했|함|하며|합|입|되|되며|되여|되어서|되어서는|되었|"
    "습니다|니다|의하야|가지고|하야|되었읍니다|하옵니다|시옵소서|하오나|하오니"
)
SHORT_PARTICLES = "을|를|이|가|은|는|에|의|로|으로|고|와|과|도|하|하고|하여|해서|했|습니다|합니다|입니다|었습니다|였습니다|되|되며|되여"

# Roster headers under their various names.
ROSTER_NAMES = {"대수": "Assembly_Num", "의원명": "Speaker", "정당": "Party", "당": "Party", "소속위원회": "Committee", "지역": "Region", "성별": "Gender", "당선횟수": "Election_Count", "당선방법": "Election_Method"}
ROSTER_COLUMNS = ("Assembly_Num", "Speaker", "Party", "Committee", "Region", "Gender", "Election_Count", "Election_Method")
