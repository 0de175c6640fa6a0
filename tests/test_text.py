"""Hand-made titles with what the rules make of them."""

from pyspark.sql import functions as F

from pricelore.functions import text as T
from pricelore.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normal_forms(spark):
    assert one(spark, T.normal(F.lit("갤럭시 S25+ Ultra 10.5인치 [A]"))) == "갤럭시 s25 플러스 울트라 10.5인치 a"
    assert one(spark, T.normal(F.lit("10.5인치"), "none")) == "10 5인치"
    assert one(spark, T.normal(F.lit("아이폰16프로맥스"), "none", parted=True)) == "아이폰 16 프로 맥스"
    assert one(spark, T.normal(F.lit(None).cast("string"))) == ""
    assert one(spark, T.compact(F.lit("아이폰 16 Pro"))) == "아이폰16프로"


def test_tokens(spark):
    assert one(spark, T.keyword_tokens(F.lit("a7c2 아이폰16"))) == ["a7c", "2", "아이폰", "16"]
    assert one(spark, T.split_list(F.lit("a, b/c;a|d"))) == ["a", "b", "c", "d"]
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_cluster_names(spark):
    cases = {
        ("갤럭시", "갤럭시S25울트라 256기가 A급"): ("갤럭시 s25울트라 256gb", "canonical", "갤럭시 s25울트라 256gb"),
        ("갤럭시", "z플립3 256기가 핑크"): ("z플립3 256gb", "canonical", "갤럭시 z플립3 256gb"),
        ("아이폰", "아이폰 16 프로 케이스 팝니다"): ("아이폰16프로 케이스", "accessory", "아이폰 16 프로 케이스"),
        ("카메라", "소니 카메라 가방"): ("소니 카메라 가방", "token", "소니 카메라 가방"),
    }
    for (keyword, title), expected in cases.items():
        text = T.cluster_text(F.lit(title))
        tokens = T.kept_tokens(text)
        got = spark.range(1).select(text.alias("a"), T.route(tokens, text).alias("b"), T.product_name(F.lit(keyword), tokens, text).alias("c")).first()
        assert tuple(got) == expected, title


def test_values(spark):
    assert one(spark, V.price(F.lit("1,200"))) == 1200
    assert one(spark, V.price(F.lit("1200원"))) is None
    assert one(spark, V.price(F.lit("1200원"), "digits")) == 1200
    assert one(spark, V.state(F.lit("거래완료"))) == V.SOLD
    assert one(spark, V.state(F.lit("?"), V.SOLD)) == V.SOLD
    assert one(spark, V.stable_id(F.lit("번개장터"), F.lit("1"))) == __import__("zlib").crc32("번개장터:1".encode())
    assert one(spark, V.price_score(F.lit(103), F.lit(100))) == 90.0
    assert one(spark, V.price_score(F.lit(0), F.lit(100))) == 0.0
    assert one(spark, V.quality_flags(F.lit("아이폰 케이스 교환"), F.lit(50_000))) == ["accessory_candidate", "invalid_price"]
    series = one(spark, V.estimated_series(F.lit(100_000), F.to_date(F.lit("2026-05-07"))))
    assert len(series) == 7 and series[-1]["price"] == 100_000 and str(series[0]["day"]) == "2026-05-01"
