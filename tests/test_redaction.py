"""Goldens of detection and replacement; offsets count code points."""

import json

from pyspark.sql import functions as F

from paperweir.operators import redaction as R

GOLDENS = {
    "대표이사 김철수는 서명하였다. 김철수에게 통지.": [("NAME_TITLED", 5, 8, "〔자연인-01〕"), ("NAME_ECHO", 17, 20, "〔자연인-01〕")],
    "성명: 홍길동": [("NAME_LABELED", 4, 7, "〔자연인-01〕")],
    "| 대상자 | 남궁민수 |": [("NAME_LABELED", 8, 12, "〔자연인-01〕")],
    "신 청 인 : 홍길동": [("NAME_LABELED", 8, 11, "〔자연인-01〕")],
    "이유로": [("NAME_BARE", 0, 3, "〔자연인-01〕")],
    "조치대상자": [],
    "서명하였다": [],
    "김포시 장기동": [],
    "김포시\n장기동": [],
    "김포시\n\n장기동": [("NAME_BARE", 5, 8, "〔자연인-01〕")],
    "대표이사 이승원": [],
    "위반행위○20%": [],
    "홍○○ 씨": [("NAME_MASKED", 0, 3, "〔자연인-01〕")],
    "02-123-4567, 010-1234-5678": [("PHONE", 0, 11, "〔연락처-01〕"), ("MOBILE", 13, 26, "〔연락처-02〕")],
    "1234-5678-9012-3456": [("CARD", 0, 19, "〔카드번호-01〕")],
    "번호010-1234-5678로": [],
    "`홍길동` 성명: 홍길동": [("NAME_LABELED", 10, 13, "〔자연인-01〕")],
    "a@b.co x@y.com a@b.co": [("EMAIL", 0, 6, "〔이메일-01〕"), ("EMAIL", 7, 14, "〔이메일-02〕"), ("EMAIL", 15, 21, "〔이메일-01〕")],
    "+1 (017) 555-7713 9807915762804490": [],
    "😀😀 a@b.co": [("EMAIL", 3, 9, "〔이메일-01〕")],
    "900101-1234567 900101-5234567 M12345678 11-22-333333-44": [("RRN", 0, 14, "〔주민번호-01〕"), ("FOREIGNER", 15, 29, "〔외국인번호-01〕"), ("PASSPORT", 30, 39, "〔여권번호-01〕"), ("DRIVER", 40, 55, "〔면허번호-01〕")],
}


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_goldens(spark):
    texts = list(GOLDENS)
    found = R.detect(rows(spark, texts)).orderBy("doc_id", "seq").collect()
    for i, text in enumerate(texts):
        got = [(r["kind"], r["start"], r["end"], r["placeholder"]) for r in found if r["doc_id"] == i]
        assert got == GOLDENS[text], text
    for r in found:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["original"]


def test_many_values_are_numbered_in_full(spark):
    text = " ".join(f"u{i}@x.org" for i in range(120))
    found = R.detect(rows(spark, [text])).orderBy("seq").collect()
    assert [found[i]["placeholder"] for i in (0, 99, 119)] == ["〔이메일-01〕", "〔이메일-100〕", "〔이메일-120〕"]


def test_user_words(spark):
    found = R.detect(rows(spark, ["홍동. 홍동이"]), user_names=["홍동"]).orderBy("seq").collect()
    assert [(r["kind"], r["start"], r["end"], r["confidence"]) for r in found] == [("NAME_USER", 0, 2, "AUTO"), ("NAME_BARE", 4, 7, "REVIEW")]
    assert R.detect(rows(spark, ["성명: 홍길동"]), user_stopwords=["홍길동"]).count() == 0


def test_echoes_of_names_that_are_not_all_hangul(spark):
    masked = lambda text, **more: R.apply(d := rows(spark, [text]), R.detect(d, **more)).first()["masked_text"]
    assert masked("홍*동. 홍*동이 갔다", user_names=["홍*동"]) == "〔자연인-01〕. 〔자연인-01〕이 갔다"
    assert masked("홍길○ 씨가 왔다. 홍길○님은 갔다") == "〔자연인-01〕 씨가 왔다. 〔자연인-01〕님은 갔다"
    assert masked("성명: 김철수. 김철수는 `김철수` 김철수역") == "성명: 〔자연인-01〕. 〔자연인-01〕는 `김철수` 김철수역"


def test_user_names_as_a_table(spark):
    names = spark.createDataFrame([("홍동",), (None,), ("가",), ("Ann Lee",)], "word string")
    stop = spark.createDataFrame([("김철수",)], "word string")
    found = R.detect(rows(spark, ["홍동, Ann Lee 성명: 김철수"]), names, stop).orderBy("seq").collect()
    assert [(r["kind"], r["original"]) for r in found] == [("NAME_USER", "홍동"), ("NAME_USER", "Ann Lee")]


def test_long_lists_give_the_same_findings(spark):
    """Names and stop words beyond what goes to the tasks: a filter and joins instead, with or without room to broadcast."""
    import random

    rng = random.Random(3)
    parts = ["홍동", "김철수", "Ann Lee", "𝒳𝒴", "홍*동", "이", "은", "는", " ", ", ", "\n", "성명: ", "`", "대표이사 ", "a@b.co", "가", "이유로", "나폴레옹"]
    docs = rows(spark, ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)] + [None, "", "홍", "Ann Lee"])
    names = ["홍동", "Ann Lee", "𝒳𝒴", "홍*동", "나폴레옹", "가", "", None, "홍동"] + [f"name {i}" for i in range(500)]
    stop = ["김철수", "이유로", None]
    want = sorted(map(tuple, R.detect(docs, names, stop).collect()))
    assert {"NAME_USER", "NAME_ECHO", "EMAIL"} <= {r[2] for r in want} and not any(r[4] == "김철수" and r[2] != "NAME_ECHO" for r in want)
    table = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    assert sorted(map(tuple, R.detect(docs, table(names), table(stop), most=0).collect())) == want
    assert sorted(map(tuple, R.detect(docs, names, stop, most=0).collect())) == want
    bound = R.words.BROADCAST_ROWS
    try:
        R.words.among.__defaults__ = ("left_semi", 0)
        assert sorted(map(tuple, R.detect(docs, names, stop, most=0).collect())) == want
    finally:
        R.words.among.__defaults__ = ("left_semi", bound)
    assert R.detect(docs, table([]), table([])).count() == R.detect(docs).count()


def test_filters_miss_no_word(spark):
    from paperweir.operators import words

    known = [f"{'가나다라마바사'[i % 7]}{i}{'𝒳' * (i % 3)}" for i in range(3_000)]
    sieve = words.told(spark.createDataFrame([(w,) for w in known], "w string").repartition(3))
    for text in (" ".join(known[:200]), "".join(known[200:400]), known[7], "nothing here " * 2_000):
        got = sieve.places(text, words.starts(text, "가힣"))
        want = {(a, n) for n in sieve.lengths for a in range(len(text) - n + 1) if not (a and "가" <= text[a - 1] <= "힣") and text[a : a + n] in set(known)} if len(text) < 5_000 else set()
        assert want <= set(got) and len(got) - len(want) < 20


def test_one_syllable_organisations_are_optional(spark):
    found = R.detect(rows(spark, ["대표이사 이승원"]), single=False).collect()
    assert [(r["kind"], r["original"]) for r in found] == [("NAME_TITLED", "이승원")]


def test_apply_report_and_mapping(spark):
    docs = rows(spark, ["성명: 홍길동, 이유로 a@b.co", None, "", "nothing"])
    found = R.detect(docs)
    masked = {r["doc_id"]: r["masked_text"] for r in R.apply(docs, found).collect()}
    assert masked == {0: "성명: 〔자연인-01〕, 이유로 〔이메일-01〕", 1: None, 2: "", 3: "nothing"}
    report = json.loads(R.report(docs, found).where("doc_id = 0").first()["report"])
    assert report["summary"] == {"auto": 2, "review": 1, "applied": 2, "names": 2}
    assert "홍길동" not in json.dumps(report, ensure_ascii=False) and "context" not in report["findings"][0]
    assert R.mapping(found).first()["mapping"] == {"〔자연인-01〕": "홍길동", "〔이메일-01〕": "a@b.co"}
    everything = R.detect(docs, include_review=True)
    assert R.apply(docs, everything).where("doc_id = 0").first()["masked_text"] == "성명: 〔자연인-01〕, 〔자연인-02〕 〔이메일-01〕"
    assert R.detect(docs).where(F.col("kind") == "NAME_LABELED").first()["context"] == "성명: ⟦…⟧, 이유로 a@b.co"


def test_spans_hold_places():
    import random

    random.seed(4)
    for _ in range(200):
        spans = [(a := random.randrange(60), a + random.randrange(9)) for _ in range(random.randrange(12))]
        held = R.Spans(spans)
        assert [held.holds(p) for p in range(80)] == [any(a <= p < b for a, b in spans) for p in range(80)]


def test_long_islands_and_protected_places(spark):
    """Chains of overlapping matches beyond the length from which they are walked along, and matches in code, links and brackets."""
    chain = "".join(f"{i % 10}" for i in range(6)) + "-1234567-" + "-".join("123456" for _ in range(200))
    text = "`010-1234-5678` 「010-1111-2222」 [x](010-3333-4444) ```\n010-5555-6666\n``` 010-7777-8888\n" + "\n" * 3 + "a@b.co\n"
    rows = R.detect(spark.createDataFrame([(1, text), (2, chain)], "doc_id int, text string")).collect()
    assert [(r["original"], r["line"]) for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == 1] == [("010-7777-8888", 3), ("a@b.co", 7)]
    want = R.LONG_ISLAND
    try:
        R.LONG_ISLAND = 0
        walked = R.detect(spark.createDataFrame([(1, text), (2, chain)], "doc_id int, text string")).collect()
    finally:
        R.LONG_ISLAND = want
    assert sorted(map(tuple, walked)) == sorted(map(tuple, rows))


def test_work_grows_with_the_findings(spark):
    """One text with twice the findings takes about twice the time."""
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "\n".join(f"mail user{i}@example.com now" for i in range(n)))], "doc_id int, text string")
        found = R.detect(docs)
        begin = time.time()
        masked = R.apply(docs, found).first()["masked_text"]
        assert masked.count("〔이메일-") == n and "@" not in masked
        return time.time() - begin

    seconds(200)
    small, large = seconds(8_000), seconds(32_000)
    assert large < 6 * small + 5, (small, large)
