import pytest

from pricelore.operators import matching as M
from pricelore.plans import registry


@pytest.mark.parametrize(
    ("message", "expected"),
    [("설정은 어디서 해?", 1), ("하트 목록", 2), ("찜", 2), ("평균은?", 3), ("찾기 방법", 4), ("사이트 기능", 5), ("하트", None), ("찾기", None), ("hello", None)],
)
def test_synonyms(spark, message, expected):
    faq = spark.createDataFrame([(1, "가격 알림이란"), (2, "찜 보기"), (3, "가격 비교란"), (4, "검색이란"), (5, "서비스란")], "faq_id long, pattern string")
    got = M.faq_matches(spark.createDataFrame([("m", message)], "message_id string, message string"), faq).collect()
    assert [r["faq_id"] for r in got] == ([] if expected is None else [expected])


def test_registered_query_takes_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, "user", "three four"), (1, 2, "user", "say one two")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [(r["message_id"], r["faq_id"]) for r in registry.QUERIES["faq_best_match"](spark, str(tmp_path)).collect()] == [("1-1", 1)]
