"""Rows worked out by hand from the rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricelore.functions import text as T
from pricelore.functions import values as V
from pricelore.operators import clustering as C
from pricelore.operators import insight as I
from pricelore.operators import matching as M
from pricelore.operators import messages
from pricelore.operators import prices as P

S = "string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, function, values, kind=S):
    frame = spark.createDataFrame(list(enumerate(values)), f"k long, v {kind}")
    return [r["x"] for r in frame.select("k", function(F.col("v")).alias("x")).orderBy("k").collect()]


def test_states(spark):
    words = [None, " ", "판매중", "예약중", "판매완료", "거래완료", "SOLD", "RESERVED", "판매 중", "?"]
    on, kept, sold = "판매중", "예약중", "판매완료"
    assert each(spark, V.import_state, words) == [on, on, on, kept, sold, on, on, on, on, on]
    assert each(spark, V.csv_state, words) == [sold, sold, on, kept, sold, sold, sold, sold, sold, sold]
    assert each(spark, V.state, words) == [on, on, on, kept, sold, sold, sold, kept, on, on]
    assert each(spark, lambda c: V.code_state(c, V.API_CODES), ["0", "1", "2", "3", "7"]) == [on, kept, "거래중", sold, "상태코드:7"]
    assert each(spark, lambda c: V.code_state(c, V.PAGE_CODES), ["0", "1", "2", "3"]) == [on, kept, "상태코드:2", "거래완료"]


def test_moments(spark):
    now = datetime.datetime(2026, 5, 10)
    got = each(spark, lambda c: V.moment(c, F.lit("2026-05-10 00:00:00").cast("timestamp")), ["2026-05-01 10:20", "2026.05.02 11:30", "2026-05-03", "2026.05.04", "x", None])
    assert got == [datetime.datetime(2026, 5, 1, 10, 20), datetime.datetime(2026, 5, 2, 11, 30), datetime.datetime(2026, 5, 3), now, now, now]
    assert each(spark, V.index_date, [None, "2026-05-01 10:20:30", "2026-05-01T10:20:30", "2026-05-01"]) == ["1970-01-01", "2026-05-01 10:20", "2026-05-01T10:20:30", "2026-05-01"]


@pytest.mark.parametrize(
    ("title", "category", "brand"),
    [("갤럭시북 프로", "노트북", "삼성"), ("게이밍 PC 본체", "컴퓨터", "컴퓨터"), ("아이폰 15", "핸드폰", "Apple"), ("아이패드 미니", "태블릿", "Apple"), ("에어팟 프로", "이어폰", "Apple"), ("PS5 디스크", "게임기", "Sony"), ("통기타", "악기", "악기"), ("소니 카메라", "카메라", "Sony"), ("무언가", "기타", "중고상품"), ("LG 그램", "노트북", "LG")],
)
def test_categories_and_brands(spark, title, category, brand):
    kind = V.category(F.lit(None).cast(S), F.lit(title), F.lit(None).cast(S))
    assert (one(spark, kind), one(spark, V.brand(kind, F.lit(title)))) == (category, brand)
    assert one(spark, V.category(F.lit(" 가전 "), F.lit(title))) == "가전"


def test_platforms_descriptions_series(spark):
    urls = ["https://m.bunjang.co.kr/1", "https://web.JOONGNA.com/1", "https://daangn.com", "https://x.org", None]
    assert each(spark, lambda c: V.platform(F.lit(" "), c), urls) == ["번개장터", "중고나라", "당근마켓", "중고거래", "중고거래"]
    assert one(spark, V.platform(F.lit("번개장터"), F.lit("joongna"))) == "번개장터"
    tail = "상세 상태와 거래 조건은 원본 페이지에서 확인해 주세요."
    text = lambda given, title, platform: one(spark, V.description(*(F.lit(x).cast(S) for x in (given, title, platform))))
    assert text(None, "폰", "번개장터") == f"폰 상품입니다. 번개장터에서 수집한 실제 중고거래 매물이며, {tail}"
    assert (text(None, "폰", ""), text(" 새것 ", "폰", "x"), text("새것", " ", "x")) == (f"폰 상품입니다. {tail}", "새것", "")
    series = lambda now, low: [(p["label"], p["price"]) for p in one(spark, V.service_series(F.lit(now).cast("long"), F.lit(low).cast("long"), F.to_date(F.lit("2026-05-07"))))]
    assert series(100_000, 90_000) == [("최저가", 90_000), ("현재가", 100_000)] and series(0, 5) == [] and series(None, 5) == []
    assert series(100_000, None) == [("05.01", 108_000), ("05.02", 105_000), ("05.03", 103_000), ("05.04", 101_000), ("05.05", 99_000), ("05.06", 102_000), ("05.07", 100_000)]
    assert [p for _, p in series(300, 0)] == [1000] * 7
    assert one(spark, V.images(F.lit("a"), 3)) == ["a", "a", "a"] and one(spark, V.images(F.lit(""))) == [] and one(spark, V.image_url(F.lit(" "))) is None


def test_words_of_lists(spark):
    got = each(spark, V.token_use, ["삽니다", "케이스", "256gb", "1테라", "프로", "갤럭시", "s25", "s25ultra", "16e", "16", "맥북"])
    use = V.USES
    assert got == [use["exclude"], use["exclude"], use["spec"], use["spec"], use["detail"], use["brand"], use["model"], use["model"], use["model"], use["model"], use["open"]]
    tokens = F.array(F.lit("a1"), F.lit("b2"), F.lit("c3"))
    assert [one(spark, V.product_keyword(F.lit(c).cast(S), tokens)) for c in ("갤럭시 S24", "갤럭시", "iPhone", "", None)] == ["갤럭시 S24", "기타 상품", "기타 상품", "a1 b2", "a1 b2"]
    assert [one(spark, V.comparison_keyword(F.lit(c).cast(S), tokens)) for c in ("갤럭시", "")] == ["갤럭시", "a1 b2"] and one(spark, V.comparison_keyword(F.lit(""), F.array().cast("array<string>"))) == "키워드 시세"


def test_outlier_sentences(spark):
    low = V.outlier_detail(F.lit(12_000), F.lit(30_000.4), F.lit(9e5), F.lit(150_000.0), F.lit(" 아이폰 "), F.lit("low"))
    high = V.outlier_detail(F.lit(1_200_000), F.lit(1.0), F.lit(900_000.0), F.lit(150_000.0), F.lit("x"), F.lit("high"), "product_name")
    assert one(spark, low) == "keyword=아이폰, price=12,000, lower_bound=30,000, median=150,000"
    assert one(spark, high) == "product_name=x, price=1,200,000, upper_bound=900,000, median=150,000"
    bounds = F.struct(F.lit(100.0).alias("low"), F.lit(900.0).alias("high"), F.lit(500.0).alias("median"))
    decided = lambda name, price: tuple(one(spark, P.decision(F.lit(name), F.lit(price).cast("long"), bounds)) or ())
    assert decided("폰", 50)[1:] == ("price_outlier", "price=50, lower_bound=100, median=500") and decided("폰", 950)[1:] == ("price_outlier", "price=950, upper_bound=900, median=500")
    assert decided("폰", None)[1] == "required_fields" and decided("폰", 500) == ()


def test_names(spark):
    assert each(spark, T.base_name, ["아이폰 13 미니 128gb", "갤럭시 s25 256기가 1테라", "512GB", "아이폰 13"]) == ["아이폰 13 미니", "갤럭시 s25", "512GB", "아이폰 13"]
    assert each(spark, T.is_accessory_name, ["아이폰 케이스", "충전 케이블", "보호 필름", "그립톡", "아이폰 13"]) == [True, True, True, True, False]
    found = each(spark, T.similarity_tokens, ["아이폰 16 프로 256기가", "갤럭시 S 25 울트라 512GB 새것", "z 플립 5", "책상", "1테라 ssd 2024"])
    assert found == [["아이폰16프로", "256기가", "256"], ["갤럭시s25울트라", "s25울트라", "512gb"], ["z플립5"], [], ["1테라"]]
    merged = [one(spark, T.merge_iphone(F.array(*map(F.lit, t)))) for t in (["아이폰", "16프로", "블루"], ["새", "아이폰", "16", "프로"], ["아이폰", "아이폰", "13", "미니"], ["아이폰", "16"], ["아이폰16", "프로"])]
    assert merged == [["아이폰16프로", "블루"], ["새", "아이폰16프로"], ["아이폰", "아이폰13미니"], ["아이폰", "16"], ["아이폰16", "프로"]]
    signs = each(spark, T.sign_patterns, ["S25+ / 256GB", "맥북(M2) 13.3\"", "a - b & c", "아이폰 II", "책상"])
    assert signs == [["plus_symbol_or_word", "slash_multiple_models", "storage_unit", "remaining_special_chars"], ["parentheses_detail", "inch_symbol", "remaining_special_chars"], ["hyphen_model_token", "ampersand_bundle", "remaining_special_chars"], ["roman_generation"], []]


def test_dedupe(spark):
    rows = [(1, "p", "1", "아이폰", "t", 5), (2, "p", "1", "아이폰 16 pro", "u", 6), (3, "p", "1", "아이폰", "v", 7), (4, "p", "1", "가나다라마바사아자차", "w", 8), (5, "p", "2", None, "x", 9)]
    got = {r["pid"]: tuple(r)[2:] for r in C.merged_keywords(spark.createDataFrame(rows, "seq long, platform string, pid string, keyword string, name string, price long")).collect()}
    # the normal form of the second is 아이폰 16 프로: three words, nine characters; the fourth has one word and ten
    assert got == {"1": ("아이폰 16 pro", "아이폰, 아이폰 16 pro, 가나다라마바사아자차", "가나다라마바사아자차", "w", 8), "2": ("", "", None, "x", 9)}


def test_dedupe_of_many_rows_and_odd_keywords(spark, monkeypatch):
    """Rows of a key are met once, dealt and sorted, whatever the number of keywords; keywords come from a table of their own if one is given."""
    import random
    import re

    names = {None: "", "": "", " ": "", "red": "red", " red": "red", "RED": "red", "red bolt": "red bolt", "tan nut 7": "tan nut 7", "anvil": "anvil", "nail 55": "nail 55"}
    assert each(spark, T.normal, list(names)) == list(names.values())
    rng = random.Random(5)
    rows = [(s // 2, rng.choice(["p", "q", None]), rng.choice(["1", "2", "3", None]), rng.choice(list(names)), rng.randrange(90)) for s in range(160)] + [(s, "p", "hot", "red", s) for s in range(500)] + [(1, "p", "bare", None, 4)]
    found = {}
    for key in {r[1:3] for r in rows}:
        own = sorted((r for r in rows if r[1:3] == key), key=lambda r: (r[0], r[4]))
        seen = list(dict.fromkeys(k for _, k in sorted((r[0], (r[3] or "").strip()) for r in own) if k))
        words = lambda k: len(re.findall("[a-z]+[0-9]+|[a-z]+|[0-9]+", names[k]))
        best = max(seen, key=lambda k: (words(k), len(names[k])), default="")
        kept = min(own, key=lambda r: (-len(names[r[3]]), r[0], r[3] is not None, r[3] or "", r[4]))
        found[key] = (best, ", ".join(seen), *kept[3:])
    frame = spark.createDataFrame(rows, "seq long, platform string, pid string, keyword string, price long").repartition(7)
    keywords = spark.createDataFrame([(k,) for k in (*names, "unused")], "keyword string")
    for most, known in ((C.FEW, None), (C.FEW, keywords), (0, None)):
        monkeypatch.setattr(C, "FEW", most)
        merged = C.merged_keywords(frame, known)
        assert {(r["platform"], r["pid"]): tuple(r)[2:] for r in merged.collect()} == found
        if most:
            plan = C.merged_keywords(frame, known)._jdf.queryExecution().executedPlan().toString()
            assert "ObjectHashAggregate" not in plan and "SortMergeJoin" not in plan and sum("Exchange hashpartitioning(pid" in line for line in plan.splitlines()) == 1
    with pytest.raises(Exception, match="none of the keywords"):
        C.merged_keywords(frame, keywords.where("keyword <> 'anvil'")).collect()


def test_intent_filters(spark):
    assert [I.widened("아이폰 16", n) for n in (5, 20, 100)] == [25, 80, 200] and I.widened("아이폰 케이스", 20) == 20 and I.widened("책상", 20) == 20
    fits = lambda q, t: one(spark, I.fits_intent(q, F.lit(t)))
    assert fits("아이폰 16", "아이폰 16 프로") and not fits("아이폰 16", "갤럭시 s25") and not fits("아이폰 16", "아이폰 16 범퍼 케이스") and not fits("galaxy", "Galaxy s24 시계 줄") and fits("책상", "아이폰 케이스")
    unlike = each(spark, I.accessory_or_wanted, ["아이폰 충전 케이블", "아이폰 삽 니다", "아이폰 교환", "아이폰 공기계", "문의"])
    assert unlike == [True, True, True, False, False]


def test_type_rules(spark):
    fits = lambda kind, text: one(spark, I.type_fits(kind, F.lit(text)))
    assert fits("desktop", "게이밍PC 본체") and not fits("desktop", "게이밍pc rtx 4070") and fits("laptop", "맥북") and not fits("smartphone", "책상") and fits("game_console", "스팀덱") and fits(None, "책상") and fits("other", "책상")
    search = lambda title, keyword="", kind=None: one(spark, I.search_fits(F.lit(title), keyword, kind))
    assert search("아이폰 16 프로", "아이폰 16") and not search("아이폰 15", "아이폰 16") and not search("아이폰 16 케이스", "아이폰 16") and search("아이폰 16 케이스", "아이폰 케이스 16")
    assert search("조립PC 본체", "", "desktop") and not search("조립pc 메인보드", "", "desktop") and not search("컴퓨터", "", "desktop") and not search("rtx 4070", "", "desktop")
    assert search("나이키 신발 270", "나이키 운동화") and not search("책상", "의자") and search("책상", "의") and not search("", "의자")


def test_recommendation_points(spark):
    now = F.lit("2026-05-10 00:00:00").cast("timestamp")
    pts = lambda price, low: one(spark, I.price_points(F.lit(price).cast("long"), F.lit(low).cast("long")))
    assert [pts(p, 1010) for p in (1010, 1011, 1061, 1062, 1111, 1112)] == [30, 20, 20, 10, 10, 0] and pts(5, None) == 0 and pts(None, 5) == 0 and pts(5, 0) == 0
    ages = each(spark, lambda c: I.age_points(c.cast("timestamp"), now), ["2026-05-09 00:00:01", "2026-05-09 00:00:00", "2026-05-07 00:00:01", "2026-05-07 00:00:00", "2026-05-03 00:00:00", None])
    assert ages == [15, 10, 10, 5, 0, 0]
    rows = [("아이폰 16", "아이폰 16", "아이폰 16,폰", "폰", 100, 100, "2026-05-09 12:00:00"), ("책상 rtx 4090", "책상", "아이폰 16", "가구", 100, None, None), ("케이스 아이폰 16", "", "", "", 105, 100, None)]
    frame = spark.createDataFrame(rows, "title string, canonical_name string, matched_keywords string, category_name string, current_price long, lowest_price long, c string").withColumn("crawled_at", F.col("c").cast("timestamp"))
    score = lambda **more: [r["s"] for r in frame.select("title", I.recommendation_score(" 아이폰 16", now, **more).alias("s")).orderBy("title").collect()]
    assert score() == [120 + 90 + 60 + 0 + 30 + 15, 60, 70 + 20]
    assert score(kind="smartphone", use_case="gaming", level="EXTREME") == [315, 60 + 40 + 40, 90] and score(kind="laptop") == [-100, -100, -100]


def test_personal_recommendations(spark):
    rows = [(k, "판매중", 1000 - k, 900, None) for k in range(1, 4)] + [(4, "판매완료", 1, 1, None)]
    items = spark.createDataFrame(rows, "item_id long, status string, current_price long, lowest_price long, c string").withColumn("crawled_at", F.col("c").cast("timestamp"))
    wishes = spark.createDataFrame([(7, 1), (7, 1)], "user_id long, item_id long")
    views = spark.createDataFrame([(7, 2), (8, 99)], "user_id long, item_id long").withColumn("ts", F.current_timestamp())
    got = [(r["user_id"], r["item_id"], r["score"], r["place"]) for r in I.recommend_personal(items, wishes, views, F.current_timestamp()).orderBy("user_id", "place").collect()]
    assert got == [(7, 3, 0, 1), (7, 2, 15, 2), (7, 1, 30, 3), (8, 3, 0, 1), (8, 2, 0, 2), (8, 1, 0, 3)]


def test_picker_quota(spark):
    own = spark.createDataFrame([(1, "a", 1, ["x"], 10, 1), (1, "b", 2, ["x"], 11, 1), (1, "misc", 3, [], 12, 1), (2, "a", 1, ["y"], 10, 1)] + [(3, "six", 1, ["x"], 20 + k, k) for k in range(6)], "user_id long, section string, section_no int, tokens array<string>, product_id long, place int")
    offered = [(u, 100 + k, "X item y", k) for u in (1, 2, 3) for k in range(4)] + [(1, 10, "x", -1), (1, 200, "z", -2)]
    got = I.picker_quota(own, spark.createDataFrame(offered, "user_id long, product_id long, text string, place int")).where("kind = 'recommended'").collect()
    assert sorted((r["user_id"], r["section"], r["product_id"], r["place"]) for r in got) == [(1, "a", 100, 1), (1, "a", 101, 2), (1, "b", 102, 1), (1, "b", 103, 2), (2, "a", 100, 1), (2, "a", 101, 2), (3, "six", 100, 1)]


def test_nearest_points(spark):
    day = lambda c: F.to_date(c)
    points = spark.createDataFrame([("s", k, d) for k, d in enumerate(["2026-01-01", "2026-01-05", "2026-01-09", "2025-01-05", "2026-02-01"])], "series_id string, idx int, d string").withColumn("day", day("d"))
    products = spark.createDataFrame([(1, "s", "2024-01-05", 0), (2, "s", "2026-01-07", 0), (3, "s", "2026-12-31", 0), (4, "s", None, 0), (5, "s", None, 1), (6, "s", None, 9)], "product_id long, series_id string, d string, place int").withColumn("day", day("d"))
    assert {r["product_id"]: r["idx"] for r in I.nearest_point(products, points).collect()} == {1: 1, 2: 1, 3: 4, 4: 4, 5: 1, 6: 0}


def test_similar_group(spark):
    rows = [("a", "아이폰 16 프로 128gb", 1000, "2026-05-01"), ("a", "아이폰16프로 128 GB", 1100, "2026-05-01"), ("a", "아이폰 16 프로 128gb 케이스", 10, "2026-05-01"), ("a", "아이폰 16 프로 256gb", 1300, "2026-05-01"), ("a", "아이폰 16 프로 128gb s급", 9000, "2026-05-02"), ("a", "아이폰 16 프로 128gb", 0, "2026-05-02"), ("b", "아이폰 16 프로 128gb", 5, "2026-05-03")]
    items = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "item_id long, canonical_name string, title string, current_price long, c string").select("*", F.lit("").alias("category_name"), F.col("c").cast("timestamp").alias("crawled_at"))
    got = I.similar_group_series({"canonical_name": "a", "title": "아이폰 16 프로 128gb"}, items).collect()
    assert [tuple(r) for r in got] == [("2026-05-01", 1050)]
    assert I.similar_group_series({"title": "아이폰"}, items).count() == 0


def test_category_votes(spark):
    matches = spark.createDataFrame([(1, "x", 0.4, False, 1), (1, "y", 0.4, False, 2), (2, "", 0.9, False, 1), (2, "x", 0.5, True, 2), (3, "x", 0.2, True, 1), (4, "z", 0.8, True, 1), (4, "x", 0.75, False, 2)], "profile_id long, category string, similarity double, verified boolean, place int")
    profiles = spark.createDataFrame([(1, ""), (2, "k"), (3, None), (4, "x"), (5, "k")], "profile_id long, source_keyword string")
    got = {r["profile_id"]: (r["category"], r["confidence"], r["method"]) for r in M.category_votes(matches, profiles).collect()}
    assert got == {1: ("x", 0.416, "title_correlation"), 2: ("k", 0.55, "source_keyword"), 3: ("미분류", 0.0, "unclassified"), 4: ("x", round(0.75 + 0.08125, 4), "title_correlation"), 5: ("k", 0.55, "source_keyword")}
    assert each(spark, M.signal_tokens, ["a1 12 123 b 1234 케이스"]) == [["a1", "123", "1234", "케이스"]]


def test_message_tags(spark):
    texts = ["아이폰 16 프로 50만원 이하 추천해줘", "배그 돌아가는 컴퓨터 찾아줘", "100만원에서 150만원 노트북", "찜 목록 보여줘", "하마는 뭐 하는 서비스야?", "오늘 날씨 알려줘", "galaxy s24 얼마부터 30만", None, "사이버펑크 4K 본체 살까 말까?"]
    frame = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "message_id string, message string")
    got = {r["message_id"]: r for r in messages.message_tags(frame).collect()}
    row = lambda k, *names: tuple(got[str(k)][n] for n in names)
    assert row(0, "intent", "keyword", "product_type", "min_price", "max_price") == ("PRODUCT_RECOMMEND", "아이폰 16 프로", "smartphone", None, 500_000)
    assert row(1, "intent", "keyword", "product_type", "use_case", "game", "level") == ("PRODUCT_RECOMMEND", "컴퓨터", "desktop", "gaming", "배그", "MID")
    assert row(2, "intent", "keyword", "product_type", "min_price", "max_price") == ("PRODUCT_RECOMMEND", "노트북", "laptop", 1_000_000, 1_500_000)
    assert row(3, "intent") == ("WISHLIST_LIST",) and row(4, "template") == ("SERVICE_INTRO",) and row(5, "template") == ("OUT_OF_SCOPE",)
    assert row(6, "keyword", "min_price", "max_price") == ("갤럭시 s24", 300_000, None)
    assert row(7, "intent", "keyword", "template", "product_type") == ("UNKNOWN", "", None, None)
    assert row(8, "intent", "game", "level", "asks_price_advice", "asks_launch_price") == ("PRODUCT_RECOMMEND", "사이버펑크", "EXTREME", True, False)


def test_performance_levels(spark):
    cards = [("RTX 4090", 8), ("rtx-4070", 16), ("rtx 4070", 8), ("GTX 1660", 8), ("gtx1660", None), ("Iris Xe", 32), ("unknown", 64), (None, 64)]
    frame = spark.createDataFrame(cards, "card string, memory int").coalesce(1)
    assert [r[0] for r in frame.select(messages.level_of_specs(F.col("card"), F.col("memory"))).collect()] == ["EXTREME", "HIGH", "MID", "MID", "LOW", "LOW", "UNKNOWN", "UNKNOWN"]
    least = lambda a, b: one(spark, messages.level_at_least(F.lit(a).cast(S), F.lit(b).cast(S)))
    assert least("high", "MID") and not least("LOW", "MID") and not least("UNKNOWN", "LOW") and not least("HIGH", None)


def test_containment_join(spark):
    long = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz"), (2, "xyz"), (3, None), (4, "")], "a long, t string")
    parts = spark.createDataFrame([(1, "xyz"), (2, "mnopqrstuvwxyz"), (3, "abd"), (4, ""), (5, None), (6, "z"), (7, "mnopqrstuvwxzz")], "b long, p string")
    for most in (M.AUTOMATON_CHARS, 3):  # by the automaton and by keys
        assert sorted((r["a"], r["b"]) for r in M.contained(long, "t", parts, "p", most).collect()) == [(1, 1), (1, 2), (1, 6), (2, 1), (2, 6)]
    assert M.contained(long, "t", parts.where("b = 4"), "p").count() == 0


def test_users(spark):
    users = spark.createDataFrame([(1, "Kim", "k@x.org", "USER", "ACTIVE"), (2, "Lee", "L@X.org", "ADMIN", "ACTIVE"), (3, "Park", None, "USER", "BLOCKED")], "user_id long, name string, email string, role string, status string")
    ids = lambda **more: [r["user_id"] for r in I.user_search(users, **more).collect()]
    assert ids() == [3, 2, 1] and ids(role="USER") == [3, 1] and ids(status="ACTIVE", text=" x.ORG") == [2, 1] and ids(text="park") == [3]
    counts = {(r["role"], r["status"]): r["users"] for r in I.users_by(users).collect()}
    assert counts == {("USER", "ACTIVE"): 1, ("ADMIN", "ACTIVE"): 1, ("USER", "BLOCKED"): 1, ("USER", None): 2, ("ADMIN", None): 1, (None, "ACTIVE"): 2, (None, "BLOCKED"): 1, (None, None): 3}
    wishes = spark.createDataFrame([(1, 5), (1, 6)], "user_id long, item_id long")
    assert [tuple(r) for r in I.user_counts(users, wishes).collect()] == [(3, 0), (2, 0), (1, 2)]


def test_search_words_are_cut_alike(spark):
    rows = [(1, "아이폰 16 Pro 256GB", 500_000), (2, "아이폰 16 프로", 500_000), (3, "아이폰 16 플러스", 500_000)]
    items = spark.createDataFrame([(k, t, "", "", p, "판매중", datetime.datetime(2024, 1, 1)) for k, t, p in rows], "item_id long, title string, canonical_name string, category_name string, current_price long, status string, crawled_at timestamp")
    found = lambda q: sorted(int(r["document_id"]) for r in I.field_search(I.documents(items), q).collect())
    assert found("아이폰 pro") == [1] and found("아이폰 프로") == [1, 2] and found("아이폰, PRO!") == [1]


def test_written_back_rows_of_one_key_and_their_sql(spark, tmp_path):
    import __spark_entry__
    import duckdb

    both = [(1, "a", 10, "red"), (1, "a", 10, "blue"), (1, "a", 11, "green")]
    rows = spark.createDataFrame([("p", *r[1:]) for r in both], "platform string, pid string, price long, keyword string")
    changed = rows.where("price % 2 = 0").withColumn("keyword", F.upper("keyword"))
    got = sorted(tuple(r) for r in M.write_back(rows, changed, ["keyword"]).collect())
    rule = __spark_entry__.oracle_sql()["written_back"].rsplit("\nSELECT", 1)[1]
    con = duckdb.connect()
    con.execute("CREATE TABLE listings AS SELECT * FROM (VALUES ('p', 'a', 10, 'red'), ('p', 'a', 10, 'blue'), ('p', 'a', 11, 'green')) t(platform, pid, price, keyword)")
    assert got == sorted(con.sql("SELECT" + rule).fetchall()) == [("p", "a", 10, "RED"), ("p", "a", 10, "RED"), ("p", "a", 11, "green")]


def test_rule_hits_count_listings_of_one_text(spark):
    from pricelore.operators import reports as R

    rows = spark.createDataFrame([("p", "1", "k", "red anvil"), ("p", "1", "k", "red anvil"), ("p", "2", "k", "red anvil"), ("q", "1", "l", "red bolt")], "platform string, pid string, keyword string, name string")
    rules = spark.createDataFrame([("brand", "Red", "red"), ("brand", "Bolt", "bolt")], "field_name string, value string, alias string")
    found = R.rule_hits(rows, rules, ["field_name", "value"])
    assert {(r["value"], r["match_count"], r["source_keywords"], r["samples"]) for r in found.collect()} == {("Red", 3, "k:2, l:1", "red anvil | red bolt"), ("Bolt", 1, "l:1", "red bolt")}
    leaves = R.rule_hits(rows.limit(4), rules, ["field_name", "value"])._jdf.queryExecution().executedPlan().toString()
    assert "pid" not in leaves  # hits hold texts and their counts, not listings
