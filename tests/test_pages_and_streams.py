from pyspark.sql import functions as F

from pricelore.functions import text as T
from pricelore.operators import insight as I
from pricelore.operators import matching as M
from pricelore.operators.matching import missing_tokens
from pricelore.sources import listings as S
from pricelore.streaming import alerts


def now():
    return F.lit("2026-05-10 00:00:00").cast("timestamp")


def test_page_records_and_descriptions(spark):
    records = [
        r'{\"seq\":7,\"x\":1,\"price\":1000,\"url\":\"u\\u0026v\",\"title\":\"갤럭시 \\u0026 버즈\",\"state\":0,\"sortDate\":\"2026-05-01\"}'.replace(r"\\u", r"\u"),
        r'{\"seq\":8,\"price\":2000,\"url\":\"v\",\"title\":\"b \x\",\"state\":3,\"sortDate\":\"2026-05-02\"}',
        r'{\"seq\":9,\"price\":3000,\"url\":\"w\",\"title\":\"c\",\"state\":5,\"sortDate\":\"2026-05-03\"}',
    ]
    html = ",".join(records) + '<meta content=" a  b &amp; c" property="og:description"><meta name="description" content="취향을 잇는 거래, 번개장터">'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, '{"seq":7,"price":1000,"url":"u","title":"t","state":0,"sortDate":"d"}<meta name=description content=\'x\'>')], "page_id long, html string")
    got = [tuple(r[c] for c in ("pid", "price", "name", "status", "image_url", "date")) for r in S.page_records(pages).orderBy("pid").collect()]
    assert got == [("7", 1000, "갤럭시 & 버즈", "판매중", "u&v", "2026-05-01"), ("8", 2000, "b \\x", "거래완료", "v", "2026-05-02"), ("9", 3000, "c", "상태코드:5", "w", "2026-05-03")]
    assert [r[0] for r in pages.orderBy("page_id").select(S.page_description(F.col("html"))).collect()] == ["a b & c", "", "", "x"]


def test_api_records(spark):
    body = '{"list":[{"pid":"1","name":"n","price":"1,000","status":"0","product_image":"i{res}.jpg","update_time":1778300000},{"pid":"2","name":"n","price":"5","status":"3","product_image":"","update_time":1}]}'
    got = S.api_records(spark.createDataFrame([(body,)], "body string"), "body", now()).collect()
    assert [(r["pid"], r["price"], r["image_url"]) for r in got] == [("1", 1000, "i720.jpg")]


def test_popular_keywords(spark):
    html = '<script type="application/json">{"Popular-Search":[{"word":"1 갤럭시  버즈"},{"label":"no","term":"아이폰"},"맥북",{"word":"아이폰"}, "검색", "??"],"rank":{"menu":["전체 보기"],"keyword":"LG 그램"},"other":["x y"],"popularRank":["z z"]}</script>'
    existing = spark.createDataFrame([("old", 1)], "keyword string, place int")
    got = S.popular_keywords(spark.createDataFrame([(1, html)], "page_id long, html string"), existing).orderBy("place").collect()
    assert [r["keyword"] for r in got] == ["갤럭시 버즈", "아이폰", "맥북", "lg 그램"]
    assert S.popular_keywords(spark.createDataFrame([(1, "x")], "page_id long, html string"), existing).first()["keyword"] == "old"


def test_token_rule(spark):
    rows = spark.createDataFrame([("아이폰16", "아이폰 16 프로"), ("아이폰16", "아이폰 160"), ("a7c2", "A7C2 소니")], "keyword string, name string")
    got = [(r["is_match"], r["missing_tokens"]) for r in M.accuracy(rows).orderBy("name").collect()]
    assert got == [(False, ["a7c"]), (True, []), (False, ["16"])]


def test_sold_stream_equals_batch(spark, tmp_path):
    data = [(1, "2026-05-01 00:00:00", "판매중"), (1, "2026-05-02 00:00:00", "판매완료"), (2, "2026-05-01 00:00:00", "판매완료"), (1, "2026-05-03 00:00:00", "판매중"), (1, "2026-05-04 00:00:00", "판매완료")]
    frame = spark.createDataFrame(data, "item_id long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = alerts.replay(spark, frame, alerts.sold_alerts, str(tmp_path), "sold").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, alerts.sold_transitions(frame).collect())) and len(got) == 2


def test_keyword_alert_stream(spark, tmp_path):
    listings = spark.createDataFrame([(1, "아이폰 16 프로"), (2, "갤럭시 s25")], "item_id long, name string").withColumn("ts", now())
    alerts_ = spark.createDataFrame([(5, "아이폰16", True), (6, "갤럭시", False), (7, "갤럭시", True)], "user_id long, keyword string, is_active boolean")
    settings = spark.createDataFrame([(5, True), (6, True), (7, False)], "user_id long, new_item_enabled boolean")
    got = alerts.replay(spark, listings, lambda s: alerts.keyword_alerts(s, alerts_, settings), str(tmp_path), "keyword").collect()
    assert [(r["user_id"], r["item_id"]) for r in got] == [(5, 1)]


def test_late_updates_are_put_in_place(spark, tmp_path):
    """Three micro-batches; the second brings an update that is older than the first's."""
    data = [[(1, "2026-05-01 00:00:00", "판매중"), (1, "2026-05-05 00:00:00", "판매중"), (2, "2026-05-01 00:00:00", "판매완료")], [(1, "2026-05-03 00:00:00", "판매완료"), (2, "2026-05-04 00:00:00", "예약중")], [(1, "2026-05-06 00:00:00", "판매완료"), (2, "2026-05-05 00:00:00", "판매완료")]]
    schema = "item_id long, ts string, status string"
    for k, rows in enumerate(data):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        alerts.sold_alerts(spark.readStream.schema("item_id long, ts timestamp, status string").parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        assert k < 3
    whole = spark.createDataFrame([r for rows in data for r in rows], schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = spark.read.schema("item_id long, ts timestamp, status_before string").parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alerts.sold_transitions(whole).collect())) and got.count() == 3


def test_rankings_of_closed_periods(spark, tmp_path):
    schema = "ts timestamp, keyword string, event_type string"
    rows = [("2026-01-01", "a"), ("2026-01-01", "b"), ("2026-01-02", "b"), ("2026-01-08", "a"), ("2026-01-09", "a"), ("2026-01-09", "b"), ("2026-03-01", "z"), ("2026-04-01", "z")]
    for day, word in rows:
        spark.createDataFrame([(day, word, "SEARCH")], "c string, keyword string, event_type string").select(F.col("c").cast("timestamp").alias("ts"), "keyword", "event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counts = alerts.search_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        alerts.write_rankings(counts, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/version=*").collect()
    assert sorted((str(r["period_start"])[:10], r["place"], r["keyword"], r["search_count"], r["trend"]) for r in got if r["keyword"] != "z") == [("2026-01-01", 1, "b", 2, "NEW"), ("2026-01-01", 2, "a", 1, "NEW"), ("2026-01-08", 1, "a", 2, "UP"), ("2026-01-08", 2, "b", 1, "DOWN")]


def test_state_of_few_keywords_is_few_partitions(spark, tmp_path):
    """Partitions of state follow the number of keywords, not the session's shuffles, and a batch of rankings passes the state once."""
    rows = [(day, word, "SEARCH") for day, word in (("2026-01-01", "a"), ("2026-01-01", "b"), ("2026-01-02", "b"), ("2026-03-01", "z"))]
    frame = spark.createDataFrame(rows, "c string, keyword string, event_type string").select(F.col("c").cast("timestamp").alias("ts"), "keyword", "event_type")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    parts = lambda folder: {p.name for p in folder.glob("state/*/*") if p.name.isdigit()}
    got = alerts.replay(spark, frame, alerts.search_counts, str(tmp_path), "search", "complete", key="keyword")
    assert sorted((r["keyword"], r["search_count"]) for r in got.collect()) == [("a", 1), ("b", 2), ("z", 1)] and parts(tmp_path / "search" / "state") == {"0"}
    counts = alerts.search_counts(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/search/in"))
    alerts.write_rankings(counts, f"{tmp_path}/out", f"{tmp_path}/state", alerts.state_partitions(frame, "keyword")).awaitTermination()
    assert sorted((r["keyword"], r["place"]) for r in spark.read.parquet(f"{tmp_path}/out/version=*").collect()) == [("a", 2), ("b", 1)]
    assert parts(tmp_path / "state") == {"0"} and spark.conf.get(key) == before


def test_daily_stats_stream_equals_batch(spark, tmp_path):
    rows = [("n", "p", 10, "2026-01-01 10:00:00"), ("n", "p", 20, "2026-01-01 11:00:00"), ("n", "q", 5, "2026-01-01 12:00:00"), ("m", "q", 7, "2026-01-02 12:00:00")]
    frame = spark.createDataFrame(rows, "canonical_name string, platform string, price long, c string").select("canonical_name", "platform", "price", F.col("c").cast("timestamp").alias("ts"))
    got = alerts.replay(spark, frame, alerts.daily_stats, str(tmp_path), "daily", "complete")
    columns = ("canonical_name", "platform_name", "stat_date", "item_count", "min_price", "avg_price", "max_price")
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, I.price_stats_daily(frame).select(*columns).collect())) and got.count() == 5


def test_price_alerts_come_once(spark, tmp_path):
    updates = spark.createDataFrame([(1, 90, 90), (1, 90, 90), (2, 90, 80)], "item_id long, current_price long, lowest_price long").withColumn("ts", now())
    wishes = spark.createDataFrame([(5, 1, 95, "N"), (6, 2, 10, "Y"), (7, 1, 10, "y")], "user_id long, item_id long, target_price long, is_lowest_alert string")
    got = alerts.replay(spark, updates.repartition(3), lambda s: alerts.price_alerts(s, wishes), str(tmp_path), "price", one_by_one=True).collect()
    assert sorted((r["user_id"], r["item_id"], r["current_price"]) for r in got) == [(5, 1, 90), (7, 1, 90)]


def test_merge_stream_over_batches(spark, tmp_path, monkeypatch):
    """Runs of one, two and four batches; what a larger run holds goes when it is old enough, and the tables are those of all batches put together."""
    monkeypatch.setattr(alerts, "FAN", 2)
    schema = "platform_name string, original_id string, current_price long, crawled_at timestamp"
    batches = [[("p", "1", 5, "2026-05-01"), ("p", "2", 7, "2026-05-01")], [("p", "1", 6, "2026-05-02")], [("p", "1", 4, "2026-05-02"), ("q", "1", 9, "2026-05-03")], [("p", "2", 1, "2026-04-01")], [("q", "2", 3, "2026-05-04")], [("q", "1", 8, "2026-05-05")], [("r", "1", 2, "2026-05-05")]]
    want: dict = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "platform_name string, original_id string, current_price long, c string").select("platform_name", "original_id", "current_price", F.col("c").cast("timestamp").alias("crawled_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        alerts.merge_listings(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        want |= {r[:2]: r[2] for r in rows}
        if k in (2, 6):
            assert {(r["platform_name"], r["original_id"]): r["current_price"] for r in alerts.items_of(spark, f"{tmp_path}/out", schema).collect()} == want
    assert sorted(r["price"] for r in alerts.history_of(spark, f"{tmp_path}/out").collect()) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert alerts.items_of(spark, f"{tmp_path}/none", schema).count() == 0
    runs = alerts._runs(spark, f"{tmp_path}/out/items")
    assert alerts._cover(runs) == [(0, 3), (4, 5), (6, 6)] and not {(0, 0), (1, 1), (0, 1), (2, 2), (3, 3), (2, 3)} & set(runs)


def test_merge_stream_is_idempotent(spark, tmp_path):
    schema = "platform_name string, original_id string, current_price long, crawled_at timestamp"
    frame = spark.createDataFrame([("p", "1", 5, "2026-05-01"), ("p", "1", 6, "2026-05-02"), ("p", "2", 7, "2026-05-01")], "platform_name string, original_id string, current_price long, c string").select("platform_name", "original_id", "current_price", F.col("c").cast("timestamp").alias("crawled_at"))
    frame.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        alerts.merge_listings(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    items = spark.read.parquet(f"{tmp_path}/out/items/run=0-0")
    assert {(r["original_id"], r["current_price"]) for r in items.collect()} == {("1", 6), ("2", 7)}
    assert spark.read.parquet(f"{tmp_path}/out/history/run=0-0").count() == 3


def test_alerts_are_found_inside_words(spark, tmp_path):
    """Tokens of one character and tokens inside longer words; a common brand is no alert's piece if it has a rarer one."""
    listings = spark.createDataFrame([(1, "휴대폰 케이스"), (2, "폰 케이스"), (3, "케이스"), (4, "아이폰 16 프로"), (5, "아이폰 160"), (6, "x 아이패드")], "item_id long, name string").withColumn("ts", now())
    told = spark.createDataFrame([(1, "폰 케이스", True), (2, "아이폰 16", True), (3, "아이폰", True), (4, "x", True), (5, "아이폰", False), (6, "아이폰", True)], "user_id long, keyword string, is_active boolean")
    settings = spark.createDataFrame([(k, k != 6) for k in range(1, 7)], "user_id long, new_item_enabled boolean")
    titles = spark.createDataFrame([("아이폰",)] * 50 + [("아이폰 16",)], "name string")
    counts = alerts.piece_counts(titles)
    pieces = {(r["user_id"]): r["piece"] for r in alerts.alert_index(told, settings, counts).collect()}
    assert pieces.keys() == {1, 2, 3, 4} and pieces[2] == "16" and pieces[4] == "x"
    for more in ({}, {"counts": counts}):
        got = alerts.replay(spark, listings, lambda s, more=more: alerts.keyword_alerts(s, told, settings, **more), str(tmp_path), f"inside{len(more)}").collect()
        plain = listings.crossJoin(told.join(settings, "user_id").where("is_active and new_item_enabled")).where(F.size(missing_tokens(T.keyword_tokens(F.col("keyword")), T.normal(F.col("name"), "none"))) == 0).collect()
        assert {(r["user_id"], r["item_id"]) for r in got} == {(r["user_id"], r["item_id"]) for r in plain} >= {(1, 1), (1, 2), (2, 4), (3, 4), (3, 5), (4, 6)}


def test_places_of_many_equal_counts(spark):
    rows = [("2026-01-01", f"w{k:03}", 1 + (k == 7)) for k in range(300)] + [("2026-01-08", f"w{k:03}", 5 - k) for k in range(3)]
    frame = spark.createDataFrame(rows, "d string, keyword string, search_count long").select("keyword", F.col("d").cast("timestamp").alias("period_start"), "search_count", F.lit(0).cast("long").alias("impression_count"), F.lit(0).cast("long").alias("click_count"))
    got = {(str(r["period_start"])[:10], r["place"]): (r["keyword"], r["trend"]) for r in I.ranked(frame).collect()}
    order = ["w007", *(f"w{k:03}" for k in range(300) if k != 7)]
    assert [got["2026-01-01", k + 1][0] for k in range(300)] == order and [got["2026-01-08", k][0] for k in (1, 2, 3)] == ["w000", "w001", "w002"] and got["2026-01-08", 1][1] == "UP" and len(got) == 303


def test_alerts_are_sent_to_the_listings(spark, tmp_path, monkeypatch):
    told = spark.createDataFrame([(1, "lue anvil", True)], "user_id int, keyword string, is_active boolean")
    settings = spark.createDataFrame([(1, True)], "user_id int, new_item_enabled boolean")
    listings = spark.createDataFrame([(n, name, "2026-05-01") for n, name in enumerate(("blue anvil", "red anvil"))], "item_id int, name string, ts string").withColumn("ts", F.to_timestamp("ts"))
    listings.write.parquet(f"{tmp_path}/listings")
    stream = spark.readStream.schema(listings.schema).parquet(f"{tmp_path}/listings")
    for most, strategy in ((1, "broadcast"), (0, "merge")):
        monkeypatch.setattr(alerts, "FEW", most)
        assert f"strategy={strategy}" in alerts.keyword_alerts(stream, told, settings)._jdf.queryExecution().analyzed().toString()
        got = alerts.replay(spark, listings, lambda s: alerts.keyword_alerts(s, told, settings), str(tmp_path), strategy).collect()
        assert [(r["user_id"], r["item_id"]) for r in got] == [(1, 0)]
        state = tmp_path / strategy / "state" / "state"
        assert [*state.rglob("*.zip"), *state.rglob("*.changelog")] and not list(state.rglob("*.delta"))
    counts = alerts.piece_counts(listings).where("piece IN ('an', 'bl')")
    assert {r["piece"]: r["n"] for r in counts.collect()} == {"an": 2, "bl": 1}


def test_sold_items_share_groups(spark, tmp_path):
    """Few groups of many items, and an item without id, give the batch twin's rows; an item that has been still for long doesn't hold up the others of its group."""
    rows = [(None if n == 6 else n, f"2026-05-0{d} 0{n % 7}:00:00", ("판매중", "판매완료", "예약중")[(n * d) % 3]) for n in range(40) for d in range(1, 8)]
    frame = spark.createDataFrame(rows, "item_id long, ts string, status string").withColumn("ts", F.to_timestamp("ts"))
    got = alerts.replay(spark, frame, lambda s: alerts.sold_alerts(s, groups=3), str(tmp_path), "shared")
    assert sorted(map(str, got.collect())) == sorted(map(str, alerts.sold_transitions(frame).select(*got.columns).collect())) != []
    path = str(tmp_path / "long")
    for n, (item, day, status) in enumerate(((1, "2026-01-01", "판매중"), (2, "2026-01-02", "판매중"), (2, "2026-03-10", "예약중"), (1, "2026-03-20", "판매완료"), (2, "2026-03-21", "판매완료"), (2, "2026-04-20", "예약중"), (1, "2026-04-21", "판매중"), (1, "2026-04-22", "판매완료"))):
        spark.createDataFrame([(item, day, status)], "item_id long, ts string, status string").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{path}/in")
        alerts.sold_alerts(stream, "1 day", groups=1).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(f"{path}/out").orderBy("ts").collect()
    # item 1's first update was gone by March
    assert [(r["item_id"], str(r["ts"])[:10], r["status_before"]) for r in told] == [(2, "2026-03-21", "예약중"), (1, "2026-04-22", "판매중")]
