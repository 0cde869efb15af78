"""Korean personal names: dictionaries and Column expressions that read a name off a run of Hangul."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and patterns that results depend on.
SURNAMES = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용예봉夫皮"
COMPOUND_SURNAMES = ["남궁", "황보", "제갈", "선우", "사공", "서문", "독고", "동방", "망절"]
GIVEN_SYLLABLES = (
    "가강건경계고광교구국권규근금기길나난남내노다단담대덕도돈동두라란래량려련렬령례"
    "로록루류리린마만매명모목무문미민바박반발방배백범법별병보복본봉부빈사산삼상새생"
    "서석선설섭성세소솔송수숙순술숭슬승시식신실심아안애야양어억언엄여연열영예오옥온"
    "완요용우욱운웅원월위유육윤율은음의이익인일임자작잔장재전정제조존종주준중지진찬"
    "창채천철청초총최추춘충치칠태택하학한해행향헌혁현형혜호홍화환효후훈휘흠희"
    "늘봄빛결담든람샘아름"
)
NAME_LABELS = "성명 이름 명의 대상자 조치대상자 조치대상 피조치자 위반자 행위자 당사자 피의자 피고인 원고 피고 청구인 피청구인 신청인 피신청인 참고인 증인 진술인 대표자 담당자 작성자 신고인 피신고인 수신인 발신인 보호자 대리인 성함".split()
TITLE_BEFORE = "대표이사 사내이사 사외이사 이사장 이사 감사위원 감사 본부장 지점장 부서장 실장 부장 차장 과장 팀장 대리 주임 사원 임원 대표자 대표 사장 부사장 전무 상무 원고 피고 청구인 피청구인 신청인 피신청인 참고인 진술인 증인 대리인 변호사 위반자 행위자 담당자 신고인 피신고인 고소인 피고소인 매도인 매수인 채권자 채무자".split()
TITLE_AFTER = "대표이사 이사장 이사 감사 본부장 지점장 실장 부장 차장 과장 팀장 대리 주임 사장 부사장 전무 상무 회장 부회장 위원장 교수 박사 변호사 씨 님 귀하".split()
PARTICLES = ["", *"은 는 이 가 을 를 의 와 과 도 만 께 에 랑 이나 이라 이라고 이라는 이며 이고 으로 로 에게 에게서 께서 에서 으로부터 부터 까지 처럼 같이 이든지 에도 에는 과의 와의 에게도 에게는 이라며 님 씨 군 양 님은 님이 씨는 씨가 씨의 씨와 씨도".split()]
NAME_STOPWORDS = (
    "김포시 이천시 고양시 여주시 광주시 남양주 의정부 강남구 대한민국 금융위원 감독원장 위원장님 관계자는 안건명 조치의 "
    "조치내용 조치이유 결정문 처분청 재결청 심판원 관계인 이해관 조사관 심사역 신청서 위반행 은행법 보험업 자본시 "
    "개인정 전자금 신용정 여신전 금융소 지배구 특정금 명의로 이해관계 당해연도 고객확인 내부통제 이사회 주주총 정기주 "
    "준법감 감사회 임원회 운영위 심의위"
).split()
NON_NAME_WORDS = (
    "신청서 신고서 제출본 결정문 의견서 확인서 동의서 위임장 명세서 계약서 합의서 진술서 소명서 보고서 첨부물 별첨본 "
    "이용자 이해도 이자율 이행기 이사회 임원진 임대인 임차인 관계인 당사자 명의자 예금주 양수인 양도인 수취인 수령인 "
    "은행법 은행권 금융권 금융업 보험업 증권사 여신액 수신액 차입금 대출금 예치금 송금액 손실액 이익금 수수료 과태료 "
    "제재안 조치안 조치문 심의회 심판원 심사역 조사관 감독원 주주총 정기주 정관상 장부상 전산상 서면상 사실상 형식상 "
    "당해년 전년도 당년도 반기말 분기말 연간액 월평균 일평균 백만원 천만원 억원대 최고가 최저가 최종안 추정치 예상액 "
    "고의성 정당성 성실성 위험도 중요도 우선순 유의점 문제점 가능성 필요성 타당성 적정성 투명성 신뢰도 만족도 참고로 "
    "대한민 우리나 관련하 포함하 제외하 해당하 명의로 실질적 "
    "주장 의견 진술 답변 소명 요지 입장 반박 청구 신청 제출 확인 자격 지위 책임 과실 손해 배상 계약 약관 "
    "해지 해제 취소 철회 동의 승낙 통지 고지 설명 판단 결정 조정 심의 의결 검토 조사 처분 제재 위반 준수 "
    "성명 서명 날인 기준 진행 서류 명단 목록 정보 자료 내용 사항 여부 구분 항목 금액 일자 기간 번호 종류"
).split()
ORG_SUFFIXES = "은행 증권 보험 캐피탈 카드 저축은행 금고 신협 조합 중앙회 협회 공사 공단 재단 법인 주식회사 ㈜ 지주 홀딩스 자산운용 투자 파트너스 컨설팅 위원회 검찰청 경찰청 법원 시청 구청 도청 군청 부 처 청 원 국 과 팀".split()
PLACES = "특별시 광역시 시 군 구 읍 면 동 리 로 길".split()
HANGUL = "가-힣"
# End of the fixed values.

_COMPOUND = "|".join(COMPOUND_SURNAMES)
#: A whole string that has the shape of a name: a two-syllable surname and two given syllables, or one and one or two.
NAME_SHAPE = f"^(?:(?:{_COMPOUND})[{GIVEN_SYLLABLES}]{{2}}|(?!{_COMPOUND})[{SURNAMES}][{GIVEN_SYLLABLES}]{{1,2}})$"
#: How a bare name of three or four syllables begins.
NAME_START = f"(?:{_COMPOUND})[{GIVEN_SYLLABLES}]{{2}}|(?!{_COMPOUND})[{SURNAMES}][{GIVEN_SYLLABLES}]{{2}}"
STARTS_WITH_SURNAME = f"^(?:{_COMPOUND}|[{SURNAMES}])"


def one_of(value: Column, words: list[str]) -> Column:
    return value.isin(*words)


def head(run: Column, n: int, shaped: bool) -> Column:
    """The first n syllables, where what follows them is a particle (or nothing) and they look like a name."""
    name = F.substring(run, 1, n)
    test = name.rlike(NAME_SHAPE) if shaped else name.rlike(STARTS_WITH_SURNAME)
    return F.when((F.length(run) >= n) & test & one_of(F.substring(run, n + 1, 100), PARTICLES), name)


def anchored_name(run: Column) -> Column:
    """The name at the start of a run beside a label or a title: a shaped one of 4, 3 or 2 syllables, else any with a surname."""
    return F.coalesce(*(head(run, n, shaped) for shaped in (True, False) for n in (4, 3, 2)))


def bare_name(run: Column, stop: Column | None = None) -> Column:
    """The name that a whole run is, but for a particle: shaped, of 4 or 3 syllables, and no common word."""
    name = F.coalesce(*(head(run, n, True) for n in (4, 3)))
    banned = one_of(name, NON_NAME_WORDS)
    return F.when(~(banned if stop is None else banned | F.array_contains(stop, name)), name)


def plausible(name: Column, strict: Column, stop: Column | None = None) -> Column:
    """Whether a name isn't a title, a label or a common word; strict ones must have the shape and three syllables."""
    words = sorted({*TITLE_BEFORE, *TITLE_AFTER, *NAME_LABELS, *NON_NAME_WORDS})
    fine = F.length(name).between(2, 4) & ~one_of(name, words)
    if stop is not None:
        fine &= ~F.array_contains(stop, name)
    return fine & (~strict | (~one_of(name, NAME_STOPWORDS) & name.rlike(NAME_SHAPE) & (F.length(name) >= 3)))


def in_address(left: Column) -> Column:
    """Whether the text before ends in the name of a place; at most 14 characters and one line end count."""
    return F.substring(left, -14, 14).rlike(f"(?d)[{HANGUL}]{{2,}}(?:{'|'.join(PLACES)})[ \\t]*$")


def in_organisation(left: Column, name: Column, right: Column, single: bool = True) -> Column:
    """Whether a word within 12 characters around that ends like an organisation's name contains all of the name.

    Words are searched from the left, one after the other, each as long as can be.  ``single`` False leaves
    out suffixes of one syllable.
    """
    before, after = F.substring(left, -12, 12), F.substring(right, 1, 12)
    ends = "|".join(s for s in ORG_SUFFIXES if single or len(s) > 1)
    word = f"[{HANGUL}A-Za-z0-9]+(?:{ends})"
    text = F.concat(before, name, after)
    # cut the text at its matches: a gap, a match, a gap, ...; walk along until a match covers the name
    parts = F.arrays_zip(F.split(text, word, -1).alias("gap"), F.concat(F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.array(F.lit(""))).alias("hit"))
    start, stop = F.length(before), F.length(before) + F.length(name)
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("found"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), (acc["found"] | ((F.length(x["hit"]) > 0) & (begin <= start) & (stop <= end))).alias("found"))

    # most texts have no such word, which one search tells
    return F.when(text.rlike(word), F.aggregate(parts, zero, step, lambda acc: acc["found"])).otherwise(False)
