from pyspark.sql import functions as F

from pricelore.operators import prices as P
from pricelore.plans import pipelines
from pricelore.sources import listings as S


def rows(spark, data):
    return spark.createDataFrame(data, "keyword string, platform string, pid string, name string, price long")


def test_bounds_follow_the_quartiles(spark):
    data = rows(spark, [("k", "p", str(i), "n", v) for i, v in enumerate([82_250, 82_250, 330_000, 330_000])])
    got = P.group_stats(data, "keyword").first()
    iqr = got["q3"] - got["q1"]
    assert got["lower_bound"] == max(0, got["q1"] - 1.5 * iqr, 0.2 * got["median_price"])
    assert got["upper_bound"] == got["q3"] + 1.5 * iqr


def test_outliers_go_from_every_group_and_are_logged(spark):
    data = [("k", "p", str(i), "n", 100 + i) for i in range(20)] + [("k", "p", "high", "n", 10_000), ("j", "p", "high", "n", 10_000), ("", "p", "blank", "n", 5)]
    clean, dropped = P.remove_outliers(rows(spark, data), "keyword")
    assert {r["pid"] for r in dropped.collect()} == {"high"}
    kept = {(r["keyword"], r["pid"]) for r in clean.collect()}
    assert ("j", "high") not in kept and ("", "blank") in kept and len(kept) == 21
    assert dropped.first()["drop_reason"] == P.HIGH


def test_validation_order(spark):
    data = rows(spark, [(None, "p", "1", "n", 5), ("k", "p", "2", "n", 0), ("k", "p", "3", "갤럭시 매입 합니다", 5), ("k", "p", "4", "n", 5)])
    got = {r["pid"]: r["drop_reason"] for r in P.validate(data).collect()}
    assert got == {"1": P.MISSING, "2": P.INVALID, "3": P.BLACKLISTED, "4": None}


def test_empty_tables(spark):
    empty = rows(spark, [])
    assert P.clean_summary(empty).count() == 0
    assert P.group_stats(empty, "keyword").count() == 0
    assert P.outlier_overview(empty).first()["item_count"] == 0


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("p", "1", 5, 1), ("p", "2", 6, 1)], "platform string, pid string, price long, seq int")
    new = spark.createDataFrame([("p", "1", 7, 2), ("p", "1", 8, 3), ("p", "3", 9, 1)], "platform string, pid string, price long, seq int")
    once = S.upsert(old, new, ["platform", "pid"], ["seq"])
    assert {(r["pid"], r["price"]) for r in once.collect()} == {("1", 8), ("2", 6), ("3", 9)}
    assert {tuple(r) for r in S.upsert(once, new, ["platform", "pid"], ["seq"]).collect()} == {tuple(r) for r in once.collect()}


def test_refine_keeps_every_row_once(spark):
    data = [("갤럭시", "p", str(i), "갤럭시 S25 울트라 256기가 A급", 500_000 + 1000 * i) for i in range(12)] + [("갤럭시", "p", "low", "갤럭시 S25 울트라 256기가", 10), ("갤럭시", "p", "buy", "갤럭시 매입", 500_000)]
    frame = rows(spark, data).withColumn("status", F.lit("판매중")).withColumn("ts", F.lit("2026-05-01 00:00:00").cast("timestamp"))
    clean, dropped, _ = pipelines.refine(frame, F.lit("2026-05-02 00:00:00").cast("timestamp"))
    kept, gone = {r["pid"] for r in clean.collect()}, {r["pid"] for r in dropped.collect()}
    assert kept | gone == {r[2] for r in data} and not kept & gone and gone == {"low", "buy"}
    assert all(0 <= r["rating"] <= 100 for r in clean.collect())
    assert {r["cluster_product_name"] for r in clean.collect()} == {"갤럭시 s25 울트라 256gb"}


def test_summary_of_prices(spark):
    frame = spark.createDataFrame([(v, k) for k, v in enumerate([100, 2000, 10_000, 11_000, 12_000, 13_000])], "price long, k int").withColumn("ts", F.timestamp_seconds(F.col("k").cast("long")))
    got = P.summary(frame).first()
    assert (got["lowest"], got["average"]) == (10_000, 11_500)


def test_least_prices_come_without_a_window(spark):
    from pricelore.operators import prices as P

    rows = spark.createDataFrame([("a", 5), ("a", 3), ("a", 0), ("b", 0), (None, 7), (None, 9)], "keyword string, price long")
    found = P.min_prices(rows, "keyword")
    assert sorted((r["keyword"] or "", r["price"], r["lowest_price"]) for r in found.collect()) == [("", 7, 7), ("", 9, 7), ("a", 0, 3), ("a", 3, 3), ("a", 5, 3), ("b", 0, None)]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_listings_get_the_tokens_of_one(spark):
    from pricelore.operators import clustering as C

    texts = spark.createDataFrame([(1, "k", "red anvil"), (1, "k", "red anvil"), (2, None, "red anvil")], "row_id long, keyword string, cluster_text string")
    assert sorted((r["row_id"], r["tokens"]) for r in C.tokenised(texts).collect()) == [(1, ["red", "anvil"]), (1, ["red", "anvil"]), (2, [])]
    counted = spark.createDataFrame([("k", "red anvil", 3), ("k", "blue", 1)], "keyword string, cluster_text string, n long")
    assert {(r["token"], r["count"]) for r in C.vocabulary(counted, n="n").collect()} == {("red", 3), ("anvil", 3)}


def test_rows_of_a_hot_group_are_not_shuffled_to_their_bounds(spark):
    frame = rows(spark, [("k", "p", str(i), "n", 1000 + i) for i in range(20)] + [("k", "p", "low", "n", 1)])
    flagged = P.flag_outliers(frame, "keyword")
    assert {r["pid"] for r in flagged.where("outlier_type = 'low'").collect()} == {"low"}
    assert "BroadcastHashJoin" in flagged._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.flag_outliers(frame, "keyword")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan


def test_names_are_judged_once(spark):
    frame = rows(spark, [("k", "p", "1", "갤럭시 매입", 5), ("k", "p", "2", "갤럭시", 5), (None, "p", "3", "매입", 5), ("k", "p", "4", None, 5)])
    told = lambda df: {(r["pid"], r["drop_reason"], r["drop_detail"]) for r in df.collect()}
    by_name = P.validate(frame, by_name=True)
    assert told(by_name) == told(P.validate(frame)) and by_name.columns == P.validate(frame).columns
