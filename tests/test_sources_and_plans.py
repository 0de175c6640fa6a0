"""Readers, sinks, reports and pipelines on small inputs worked out by hand."""

import datetime

from pyspark.sql import functions as F

from pricelore.operators import clustering as C
from pricelore.operators import insight as I
from pricelore.operators import matching as M
from pricelore.operators import prices as P
from pricelore.operators import reports as R
from pricelore.plans import pipelines
from pricelore.sources import listings as S

NOW = "2026-05-10 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode("utf-8-sig"))
    return str(tmp_path / name)


CSV = 'keyword,platform,pid,name,price,status,date,image_url\n아이폰,번개장터,1,"아이폰 16, 새것","1,200",판매중,2026-05-01 10:00,i{res}.jpg\n아이폰,번개장터,2,아이폰 15,900,예약중,2026.05.02 11:00,\n아이폰,,3,아이폰 14,x,거래완료,bad,\n'


def test_listing_files(spark, tmp_path):
    rows = S.read_listings(spark, put(tmp_path, "a.csv", CSV))
    assert rows.columns[:3] == ["keyword", "platform", "pid"] and {"canonical_name", "price_numeric"} <= set(rows.columns)
    assert sorted((r["pid"], r["name"], r["price_numeric"]) for r in rows.collect()) == [("1", "아이폰 16, 새것", None), ("2", "아이폰 15", 900.0), ("3", "아이폰 14", None)]
    records = S.to_record(rows, now())
    got = {r["original_id"]: (r["current_price"], r["status"], r["crawled_at"], r["thumbnail_url"]) for r in records.collect()}
    assert got["1"] == (1200, "판매중", datetime.datetime(2026, 5, 1, 10), "i720.jpg") and got["2"][:3] == (900, "예약중", datetime.datetime(2026, 5, 2, 11)) and got["3"] == (None, "판매중", datetime.datetime(2026, 5, 10), None)
    good, counts = S.complete(records)
    assert {r["original_id"] for r in good.collect()} == {"1", "2"} and tuple(counts.first()) == (1, 3)
    preview = spark.createDataFrame([("p", "7", "t", "갤럭시 s25", "15.0")], "platform string, pid string, name string, cluster_product_name string, price_numeric string")
    assert S.is_preview(preview.columns) and [(r["canonical_name"], r["current_price"]) for r in S.to_record(preview, now()).collect()] == [("갤럭시 s25", 15)]
    several = S.read_listings(spark, [put(tmp_path, "b.csv", CSV), put(tmp_path, "c.csv", CSV)])
    assert several.count() == 6


def test_newest_file(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    for k, name in enumerate(("b.csv", "a.csv", "c.txt")):
        put(folder, name, f"x\n{name}\n")
        os.utime(folder / name, (1_700_000_000 + k, 1_700_000_000 + k))
    assert [r["x"] for r in S.newest_file(spark, str(folder)).collect()] == ["a.csv"]


def test_configuration_lists(spark, tmp_path):
    rows = S.read_config(spark, put(tmp_path, "rules.csv", "category,tokens,enabled\nA,x/ y;x,1\nB,z,비활성\nC,w,N\nD,v|u,\n"), "tokens")
    assert sorted((r["category"], r["tokens"]) for r in rows.collect()) == [("A", "x"), ("A", "y"), ("D", "u"), ("D", "v")]
    lines = spark.createDataFrame([("# note",), (" 케이스 ",), ("케이스",), ("(Pro)",), (None,)], "w string")
    words = lambda df: sorted(r["word"] for r in df.collect())
    assert words(S.word_list(lines, "w", ("x",))) == ["(Pro)", "케이스"] and words(S.word_list(lines, "w", (), True)) == ["케이스", "프로"] and words(S.word_list(lines.limit(1), "w", ("x", "y"))) == ["x", "y"]


def test_sinks(spark, tmp_path):
    clean = spark.createDataFrame([("b", "n", 2, "p", "1"), ("a", "n", 3, "p", "2"), ("a", "n", 1, "p", "3")], "keyword string, cluster_product_name string, price long, platform string, pid string")
    S.write_refined(clean, clean.limit(1), str(tmp_path))
    assert [r["pid"] for r in spark.read.parquet(f"{tmp_path}/clean").coalesce(1).sortWithinPartitions("keyword", "price").collect()] == ["3", "2", "1"] and spark.read.parquet(f"{tmp_path}/dropped").count() == 1
    S.write_report(clean, str(tmp_path), "r", "1")
    S.write_report(clean.limit(2), str(tmp_path), "r", "2")
    assert [spark.read.parquet(f"{tmp_path}/{where}/r").count() for where in ("run=1", "run=2", "latest")] == [3, 2, 2]
    S.write_by_keyword(clean, f"{tmp_path}/by")
    assert spark.read.parquet(f"{tmp_path}/by/keyword=a").count() == 2


def test_history_and_scans(spark):
    records = spark.createDataFrame([("p", "1", 5, "2026-05-01 10:00:00"), ("p", "1", 6, "2026-05-01 11:00:00"), ("p", "1", 7, "2026-05-02 01:00:00"), ("q", "1", 8, "2026-05-02 01:00:00")], "platform_name string, original_id string, current_price long, c string").withColumn("crawled_at", F.col("c").cast("timestamp"))
    items = spark.createDataFrame([("p", "1", 9)], "platform_name string, original_id string, item_id long")
    assert sorted(map(tuple, S.history_points(records, items).collect())) == [(9, datetime.date(2026, 5, 1), 6), (9, datetime.date(2026, 5, 2), 7)]
    rows = spark.createDataFrame([(1, "2026-05-01"), (2, "2026-05-03"), (3, "2026-05-03")], "item_id long, c string").withColumn("crawled_at", F.col("c").cast("timestamp"))
    assert [r["item_id"] for r in S.newest(rows, 2).collect()] == [3, 2] and S.newest(rows).count() == 3
    kept = S.recent(rows, F.lit("2026-05-16 00:00:00").cast("timestamp"), 14, "crawled_at")
    assert {r["item_id"] for r in kept.collect()} == {2, 3}
    proof = spark.createDataFrame([(1, "k", 0.5, "a"), (2, "k", 0.9, "b")], "item_id long, keyword string, score double, reason string")
    found = S.match_evidence(proof, spark.createDataFrame([(1, "k", 1.0, "c")], proof.schema)).collect()
    assert {(r["item_id"], r["score"], r["source"]) for r in found} == {(1, 1.0, "token_rule"), (2, 0.9, "title_match")}


def test_price_rules(spark):
    out = lambda t: one(spark, P.excluded_at_source(F.lit(t), ("새 상품",), ("매입",)))
    assert out("아이폰 새 상품") and out("(매입) 아이폰") and not out("아이폰 매입합니다") and not one(spark, P.excluded_at_source(F.lit("x"), (), ()))
    bounds = one(spark, P.list_bounds(F.array(*map(F.lit, (100, 0, 200, 300, 400, -5)))))
    assert (bounds["low"], bounds["high"], bounds["median"]) == (50.0, 550.0, 250.0) and one(spark, P.list_bounds(F.array(F.lit(1)))) is None


def test_joins_back(spark):
    rows = spark.createDataFrame([("p", "1", 5, "old"), ("p", "2", 5, "keep")], "platform string, pid string, price long, name string")
    new = spark.createDataFrame([("p", "1", 5, "new"), ("p", "2", 6, "other")], rows.schema)
    assert {r["pid"]: r["name"] for r in M.write_back(rows, new, ["name"]).collect()} == {"1": "new", "2": "keep"}
    named = spark.createDataFrame([(1, 10, " "), (2, 11, None), (3, 10, "own")], "id long, platform_id long, platform_name string")
    assert {r["id"]: r["platform_name"] for r in M.fill_platform(named, spark.createDataFrame([(10, "p")], "platform_id long, name string")).collect()} == {1: "p", 2: "unknown", 3: "own"}
    values = spark.createDataFrame([("t", "S25", 0.5), ("t", "갤럭시", 0.95), ("u", "S25", 0.5), ("v", "맥북", 0.5), ("v", "s25", 0.5)], "title string, value string, confidence double")
    rules = spark.createDataFrame([("폰", "s25"), ("폰", "갤럭시"), ("노트북", "맥북")], "category string, token string")
    assert {r["title"]: (r["category"], r["confidence"]) for r in M.category_by_rules(values, rules).collect()} == {"t": ("폰", 0.95), "u": ("폰", 0.9)}
    asked = spark.createDataFrame([("a", "미분류", 0.0), ("b", "폰", 0.9)], "name string, category string, category_confidence double")
    told = M.classify_titles(asked, lambda title: F.struct(F.upper(title).alias("category"), F.lit(0.7).alias("confidence")))
    assert {r["name"]: (r["category"], r["category_confidence"]) for r in told.collect()} == {"a": ("A", 0.7), "b": ("폰", 0.9)}


def test_reports(spark):
    rows = spark.createDataFrame([("p", "k", "[새것] x [A급]"), ("q", "k", "y [ 새것 ]"), ("q", "l", "z")], "platform string, keyword string, name string")
    found = {r["content"]: (r["total_count"], r["platforms"], r["keywords"]) for r in R.bracket_contents(rows).collect()}
    assert found == {"새것": (2, "p:1, q:1", "k:2"), "a급": (1, "p:1", "k:1")}
    counts = {r["token"]: r["count"] for r in R.token_counts(spark.createDataFrame([("새것 a", 2), ("새것 새것", 3)], "content string, total_count long")).collect()}
    assert counts == {"새것": 5, "a": 2}
    paths = spark.createDataFrame([("k", "n", "p1", "x", "1"), ("k", "n", "p2", "x", "2"), ("l", "n", "p1", "x", "2")], "keyword string, cluster_product_name string, path string, platform string, pid string")
    assert {r["check"]: r["count"] for r in R.duplicate_checks(paths).collect()} == {"paths_per_name": 1, "names_across_keywords": 1, "repeated_items": 1}
    clean = spark.createDataFrame([("token", 50.0), ("token", 60.0), (None, None)], "cluster_route string, rating double")
    dropped = spark.createDataFrame([("a",), ("a",)], "drop_reason string")
    assert {r["metric"]: r["value"] for r in R.run_statistics(clean, dropped).collect()} == {"clean_rows": 3.0, "mean_rating": 55.0, "dropped: a": 2.0, "route: token": 2.0, "route: none": 1.0}


def test_references(spark):
    rows = spark.createDataFrame([("p", "1", "폰", "갤럭시 S25 케이스"), ("p", "1", "폰", "갤럭시 S25 케이스"), ("p", "2", "폰", "S 25 급처"), ("q", "3", "북", "맥북")], "platform string, pid string, keyword string, name string")
    rules = spark.createDataFrame([("model", "s25", "s25"), ("model", "s25", "갤럭시s25"), ("category", "폰", "폰"), ("model", "x", "")], "field string, value string, alias string")
    got = {(r["field"], r["value"]): (r["match_count"], r["source_keywords"], r["samples"]) for r in R.rule_hits(rows, rules, ["field", "value"]).collect()}
    assert got == {("model", "s25"): (2, "폰:2", "S 25 급처 | 갤럭시 S25 케이스"), ("category", "폰"): (2, "폰:2", "S 25 급처 | 갤럭시 S25 케이스")}
    assert {r["token"]: (r["reason"], r["match_count"]) for r in R.excluded_tokens(rows).collect()} == {"케이스": ("accessory_or_low_signal", 1), "급처": ("bait_or_noise", 1)}


def test_lists(spark):
    ranks = I.price_places(spark.createDataFrame([("g", 5, 1), ("g", 9, 2), ("g", 9, 3)], "g string, price long, place int"), "g")
    assert sorted((r["place"], r["price_place"]) for r in ranks.collect()) == [(1, 3), (2, 1), (3, 2)]
    series = spark.createDataFrame([("g", [1], 1), ("g", [1, 2], 2), ("g", [3, 4], 3)], "g string, points array<int>, place int")
    assert I.longest_series(series, "g").first()["points"] == [1, 2]
    first, second = (spark.createDataFrame(x, "product_id long, place int") for x in ([(5, 1), (6, 2)], [(6, 1), (7, 2)]))
    assert [(r["product_id"], r["place"]) for r in I.ordered_union(first, second).orderBy("place").collect()] == [(5, 1), (6, 2), (7, 3)]
    words = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, keyword string")
    turned = lambda day: [r["keyword"] for r in I.rotated(words, F.lit(day), 3).orderBy("place").collect()]
    assert turned("1970-01-01") == ["a", "b", "c"] and turned("1970-01-02") == ["c", "a", "b"]
    rows = spark.createDataFrame([(k, "u", f"2026-05-0{k}") for k in (1, 2, 3)], "id long, user_id string, c string").withColumn("ts", F.col("c").cast("timestamp"))
    order = lambda **more: [r["id"] for r in I.newest_of(rows, "user_id", "ts", "id", **more).collect()]
    assert order() == [3, 2, 1] and order(oldest_first=True, since=F.lit("2026-05-02").cast("timestamp")) == [2, 3]
    numbers = spark.range(1000)
    picked = lambda df: {r["id"] for r in I.seeded_sample(df, 20, 7, F.col("id")).collect()}
    assert picked(numbers) == picked(numbers.repartition(13)) and len(picked(numbers)) == 20 and picked(numbers) != {r["id"] for r in I.seeded_sample(numbers, 20, 8, F.col("id")).collect()}


def test_attached_words(spark):
    names = ["아이폰 16 프로", "아이폰16프로 새상품", "아이폰 케이스티파이", "아이폰a1 아이폰", "아이폰 블루투스", "블루투스이어폰 이어폰", "이어폰"]
    rows = spark.createDataFrame([(k, "아이폰", n) for k, n in enumerate(names)], "row_id long, keyword string, cluster_text string")
    got = {r["row_id"]: r["tokens"] for r in C.tokenised(rows).collect()}
    assert got[0] == ["아이폰", "프로"]
    assert got[2] == ["아이폰", "케이스티파이"] and got[5] == ["블루투스", "이어폰", "이어폰"] and got[3] == ["아이폰", "a1", "아이폰"]  # a1 is a model


def test_pipelines(spark, tmp_path):
    csv = "keyword,platform,pid,name,price,status,date\n" + "".join(f"아이폰,번개장터,{k},아이폰 16 프로 256gb {k},{1_000_000 + k * 1000},판매중,2026-05-0{k % 9 + 1} 10:00\n" for k in range(20)) + "아이폰,번개장터,99,아이폰 16 매입,1000000,판매중,2026-05-01 10:00\n아이폰,번개장터,98,아이폰 16 프로,10,판매중,2026-05-01 10:00\n"
    pipelines.chain(spark, put(tmp_path, "in.csv", csv), f"{tmp_path}/out", now())
    records = spark.read.parquet(f"{tmp_path}/out/records")
    assert records.count() == 20 and spark.read.parquet(f"{tmp_path}/out/dropped").count() == 2
    assert {r["crawled_at"].hour for r in records.collect()} == {10}
    items = spark.createDataFrame([], "item_id long, platform_name string, original_id string, title string, canonical_name string, current_price long, lowest_price long, status string, crawled_at timestamp, rating double")
    history = spark.createDataFrame([], "item_id long, recorded_at date, price long")
    items, history = pipelines.load(records, items, history, now())
    assert items.count() == 20 and history.count() == 20 and items.agg(F.min("lowest_price")).first()[0] == 1_000_000
    again, points = pipelines.load(records, items, history, now())
    assert again.count() == 20 and points.count() == 20
    assert pipelines.index(items.withColumn("category_name", F.lit("")), 5).count() == 5
    named = items.withColumns({"cluster_product_name": F.col("canonical_name"), "category_name": F.lit("")})
    name = named.first()["cluster_product_name"]
    trend, related = pipelines.insights(named, history, name, None)
    assert trend.count() >= 1 and related.first()["cluster_product_name"] == name
    one_id = named.first()["item_id"]
    seen = pipelines.detail(one_id, named, history, now()).first()
    assert len(seen["points"]) >= 1 and seen["description"].startswith(seen["title"])
    assert pipelines.detail(-1, named, history, now()).count() == 0


def test_collection(spark):
    rows = [("k", "A", str(k), f"blue anvil {k}", 100 + k) for k in range(5)] + [("k", "B", "1", "blue anvil new", 110), ("k", "B", "2", "blue anvil", 1000), ("k", "B", "3", "red chair", 105), ("k", "B", "4", "blue anvil 매입", 100), ("k", "B", "5", "anvil", 0)]
    frame = spark.createDataFrame(rows, "keyword string, platform string, pid string, name string, price long").withColumn("status", F.lit("판매중"))
    entries = spark.createDataFrame([(1, ["blue", "anvil"], "e", True, "c", "tools", "k")], "entry_id long, tokens array<string>, platform string, verified boolean, cluster_id string, category string, keyword string")
    dictionary = spark.createDataFrame([("brand", "Anvil Co", "anvil", 1)], "field_name string, canonical_value string, alias string, row_no int")
    rules = spark.createDataFrame([("hardware", "Anvil Co")], "category string, token string")
    kept, dropped = pipelines.collect([frame.where("platform = 'A'"), frame.where("platform = 'B'")], "A", entries, dictionary, rules)
    got = {(r["platform"], r["pid"]): (r["category"], r["matched"]) for r in kept.collect()}
    assert got.keys() == {*(("A", str(k)) for k in range(5)), ("B", "1")} and got["B", "1"] == ("hardware", {"brand": "Anvil Co"})
    assert {(r["pid"], r["drop_stage"]) for r in dropped.collect()} == {("4", "name_blacklist"), ("5", "input_validation")}


def test_enrichment(spark):
    rows = spark.createDataFrame([(1, "갤럭시", "A", "갤럭시 S25 울트라 새상품"), (2, "맥북", "A", "unknown thing"), (3, "misc", "A", "chair red"), (4, "misc", "A", "nothing")], "row_id long, keyword string, platform string, name string")
    entries = spark.createDataFrame([(1, ["갤럭시", "s25"], "A", True, "c1", "phone", ["k1", "갤럭시"], "Galaxy S25", "p1/p2"), (2, ["chair", "red"], "B", False, None, "chairs", None, None, None), (3, ["갤럭시"], "B", False, "c3", "other", [], "x", "")], "entry_id long, tokens array<string>, platform string, verified boolean, cluster_id string, category string, matched_keywords array<string>, representative_name string, tree_path_ids string")
    dictionary = spark.createDataFrame([("model", "Galaxy S25", "갤럭시s25", 1), ("option", "Ultra", "울트라", 2)], "field_name string, canonical_value string, alias string, row_no int")
    rules = spark.createDataFrame([("스마트폰", "galaxy s25"), ("노트북", "맥북")], "category string, token string")
    got = {r["row_id"]: r for r in pipelines.enrich(rows, entries, dictionary, rules).collect()}
    told = {k: (r["category"], round(r["category_confidence"], 4), r["classification_method"]) for k, r in got.items()}
    assert told[1][0] == "스마트폰" and told[1][1] >= 0.9 and told[1][2] == "product_name_trie"
    assert told[2] == ("노트북", 0.75, "source_keyword_correlation") and told[3][0] == "chairs" and told[3][2] == "title_correlation" and told[4] == ("misc", 0.55, "source_keyword")
    assert got[1]["graph_keywords"] == ["스마트폰", "갤럭시", "k1", "s25", "Galaxy S25", "Ultra", "c1", "p1/p2"]
    assert got[4]["graph_keywords"] == ["misc"] and got[3]["graph_keywords"] == ["chairs", "misc", "chair", "red"]
    answered = pipelines.enrich(rows.where("row_id = 4").withColumn("keyword", F.lit("")), entries, dictionary, rules, lambda title: F.struct(F.lit("told").alias("category"), F.lit(0.6).alias("confidence"))).first()
    assert (answered["category"], answered["category_confidence"], answered["classification_method"]) == ("told", 0.6, "model_stub")


def test_lists_fall_back(spark):
    lines = lambda *rows: spark.createDataFrame([(r,) for r in rows], "keyword string")
    assert S.name_blacklist(lines("keyword", "# none", " ")) == P.BLACKLIST or set(S.name_blacklist(lines("keyword", "# none", " "))) == set(P.BLACKLIST)
    assert S.name_blacklist(lines("Keyword", " 매입 ", "대여", "매입")) == ("대여", "매입")
    assert sorted(r["word"] for r in S.word_list(lines("새 상품!", "(Pro)"), "keyword", (), True).collect()) == sorted(["새", "상품", "프로"])
