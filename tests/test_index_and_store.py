"""The kept search index and the store of items: equal to what a whole read gives, after any updates, and changed only where they must be."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pricelore.operators import insight as I
from pricelore.operators import prices as P
from pricelore.operators import search_index as X
from pricelore.plans import pipelines
from pricelore.sources import versions as V

ITEM = "item_id long, title string, canonical_name string, category_name string, current_price long, status string, platform string, crawled_at timestamp"


def items(spark, rows):
    return spark.createDataFrame([(k, t, c, "", price, "", p, datetime.datetime(2024, 1, 1 + k % 28)) for k, t, c, price, p in rows], ITEM)


def made(rnd, ids):
    words = ["blue", "bleu", "blues", "anvil", "anvils", "anvel", "case", "매입", "hammer", "hammers", "hamer", "갤럭시", "갤럭시s25", "a", "ab", "internationalization", "internationalisation", "x1"]
    return [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))), rnd.choice(["", "blue anvil", "갤럭시 s25"]), rnd.choice([500, 3000, 5000, 80_000]), rnd.choice("AB")) for k in ids]


QUERIES = ("blue", "blue anvil", "Anvl", "hammr case", "갤럭시", "a", "ab", "internationalizatoin", "nothing like it", "x1 case")


def same(spark, path, docs, queries=QUERIES, **more):
    for q in queries:
        rows = lambda df: [(r["document_id"], round(r["score"], 9)) for r in df.collect()]
        assert rows(X.find(spark, path, q, **more)[0]) == rows(I.field_search(docs, q, **more)), q


def test_index_equals_reading_all(spark, tmp_path):
    rnd, path = random.Random(3), f"{tmp_path}/index"
    first = made(rnd, range(60))
    X.update(spark, path, I.documents(items(spark, first)))
    same(spark, path, I.documents(items(spark, first)), QUERIES[1:3])
    changed = made(rnd, range(0, 30, 3)) + made(rnd, range(60, 70))
    now = {r[0]: r for r in [*first, *changed] if r[0] not in (1, 2)}
    gone = spark.createDataFrame([("1",), ("2",), ("unknown",)], "document_id string")
    X.update(spark, path, I.documents(items(spark, changed)), gone)
    docs = I.documents(items(spark, list(now.values())))
    same(spark, path, docs)
    same(spark, path, docs, QUERIES[:2], platforms=("B",), sort="low_price", limit=3, page=2)
    same(spark, path, docs, QUERIES[3:5], sort="recent", limit=4)
    assert X.find(spark, path, "")[0].count() == 0 and X.find(spark, f"{tmp_path}/none", "blue")[0].count() == 0


def test_update_changes_its_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/index"
    X.update(spark, path, I.documents(items(spark, made(random.Random(4), range(200)))))
    before = V.current(spark, path)
    one = I.documents(items(spark, [(7, "zebra", "", 3000, "A")]))
    old = set(V.read(spark, path, "documents", X.DOCUMENTS).where("document_id = '7'").first()["words"])
    X.update(spark, path, one)
    after = V.current(spark, path)
    words = old | set(V.read(spark, path, "documents", X.DOCUMENTS).where("document_id = '7'").first()["words"])
    changed = {(n, b) for (n, b), f in after.items() if before.get((n, b)) != f}
    assert {b for n, b in changed if n == "postings"} == {X._bucket(w) for w in words} and {b for n, b in changed if n == "documents"} == {X._bucket("7")}
    assert len([1 for n, _ in after if n == "postings"]) > len(words)
    assert [r["document_id"] for r in X.find(spark, path, "zebra")[0].collect()] == ["7"]
    assert V.unused(spark, path, "fields") and all("fields" in f for f in V.unused(spark, path, "fields"))


@pytest.mark.parametrize("edits", [1, 2])
def test_words_within_edits_share_a_key(spark, edits):
    """Any word within the allowed edits of a term is found by the keys of both."""
    rnd = random.Random(edits)
    words, terms = set(), set()
    for _ in range(150):
        w = "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 14)))
        t = list(w)
        for _ in range(edits):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", rnd.choice("abcde")])
        words.add(w)
        terms.add("".join(t) or "a")
    keys = {r["word"]: set(r["keys"]) for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", X.keys_of(F.col("word")).alias("keys")).collect()}
    pairs = spark.createDataFrame([(w, t) for w in words for t in terms], "word string, term string").where(F.levenshtein("word", "term") <= I.allowed_edits(F.col("term"))).collect()
    assert len(pairs) > 100 and all(keys[r["word"]] & X._keys_of(r["term"]) for r in pairs)


def test_totals(spark):
    found = lambda *prices: spark.createDataFrame([(str(k), 1.0, p, f"2024-01-0{k % 9 + 1}") for k, p in enumerate(prices)], "document_id string, score double, current_price long, crawled_on string")
    row = lambda *prices: tuple(X.totals(found(*prices)).first())
    assert row() == (0, 0, 0, None) and row(5000, 7000) == (2, 5000, 6000, "2024-01-02")
    assert row(1, 10_000, 20_000) == (3, 10_000, 15_000, "2024-01-03")  # one price below a fifth of the median
    assert row(500, 500) == (2, 500, 500, "2024-01-02")  # nothing is above the floor


def test_summary(spark):
    frame = lambda *prices: spark.createDataFrame([(p, datetime.datetime(2024, 1, k + 1)) for k, p in enumerate(prices)], "price long, ts timestamp")
    row = lambda *prices: (lambda r: (r["lowest"], r["average"], r["latest"].day))(P.summary(frame(*prices)).first())
    assert row(500, 500, 500, 500, 500) == (500, 500, 5)  # nothing is above the floor of 1,000
    assert row(5000, 6000, 7000, 1) == (5000, 6000, 4)  # the latest of all
    assert row(10_000, 20_000, 30_000, 1500, 40_000) == (10_000, 25_000, 5)
    assert row(0, 0) == (0, 0, 2)


RECORD = "platform_name string, original_id string, title string, canonical_name string, current_price long, status string, crawled_at timestamp, cluster_route string"


def records(spark, *rows):
    return spark.createDataFrame([("p", k, f"t{k}", f"c{k}", price, "s", datetime.datetime(2024, 1, day), None) for k, price, day in rows], RECORD)


def test_loads_keep_ids_and_what_they_do_not_bring(spark, tmp_path):
    path, as_of = f"{tmp_path}/store", F.lit("2024-02-01").cast("timestamp")
    known = spark.createDataFrame([(7, "p", "a", 1, "words", datetime.datetime(2023, 1, 1))], "item_id long, platform_name string, original_id string, current_price long, matched_keywords string, crawled_at timestamp")
    V.publish(spark, path, {"items": spark.createDataFrame([], pipelines.ITEMS).unionByName(known, allowMissingColumns=True), "history": spark.createDataFrame([(7, datetime.date(2023, 1, 1), 1)], pipelines.POINTS)})
    for _ in range(2):
        loaded, points = pipelines.store(spark, path, records(spark, ("c", 30, 1), ("a", 10, 1), ("b", 20, 1), ("a", 11, 2)), as_of)
    got = {r["original_id"]: (r["item_id"], r["current_price"], r["matched_keywords"], r["title"]) for r in loaded.collect()}
    assert got == {"a": (7, 11, "words", "ta"), "b": (8, 20, None, "tb"), "c": (9, 30, None, "tc")}
    assert sorted((r["item_id"], str(r["recorded_at"]), r["price"]) for r in points.collect()) == [(7, "2023-01-01", 1), (7, "2024-01-01", 10), (7, "2024-01-02", 11), (8, "2024-01-01", 20), (9, "2024-01-01", 30)]
    loaded, _ = pipelines.store(spark, path, records(spark, ("d", 40, 3)), as_of)
    assert {r["original_id"]: r["item_id"] for r in loaded.collect()} == {"a": 7, "b": 8, "c": 9, "d": 10}


def test_readers_see_whole_versions(spark, tmp_path):
    """Files of a version that its manifest doesn't name yet are not read."""
    path, rows = f"{tmp_path}/store", lambda n: spark.range(n)
    V.publish(spark, path, {"a": rows(1), "b": rows(2)})
    rows(50).write.parquet(f"{path}/a/half")
    assert V.read(spark, path, "a", "id long").count() == 1 and V.read(spark, path, "b", "id long").count() == 2
    assert V.publish(spark, path, {"a": rows(3)}) == 2 and V.read(spark, path, "a", "id long").count() == 3 and V.read(spark, path, "b", "id long").count() == 2
    assert V.read(spark, path, "c", "id long").count() == 0 and V.read(spark, f"{path}-no", "a", "id long").count() == 0


def test_chain_loads(spark, tmp_path):
    csv = "keyword,platform,pid,name,price,status,date\n" + "".join(f"아이폰,번개장터,{k},아이폰 16 프로 256gb {k},{1_000_000 + k * 1000},판매중,2026-05-0{k % 9 + 1} 10:00\n" for k in range(9))
    (tmp_path / "in.csv").write_text(csv)
    as_of = F.lit("2026-05-20").cast("timestamp")
    pipelines.chain(spark, str(tmp_path / "in.csv"), f"{tmp_path}/out", as_of)
    loaded = V.read(spark, f"{tmp_path}/out/store", "items", pipelines.ITEMS)
    assert sorted(r["item_id"] for r in loaded.collect()) == list(range(1, 10)) and V.read(spark, f"{tmp_path}/out/store", "history", pipelines.POINTS).count() == 9
    index = f"{tmp_path}/out/index"
    pipelines.sync(spark, index, loaded)
    assert X.find(spark, index, "아이폰")[0].count() == 9
    pipelines.sync(spark, index, loaded.where("item_id < 4"), recreate=True)
    assert sorted(r["document_id"] for r in X.find(spark, index, "아이폰")[0].collect()) == ["1", "2", "3"]
    found = I.combined_search(loaded, "아이폰", find=lambda q, limit, platforms, sort, page: X.find(spark, index, q, limit, platforms, sort, page)[0])
    assert sorted(r["item_id"] for r in found.collect()) == [1, 2, 3]


def test_blank_names_have_no_relatives(spark):
    own = items(spark, [(1, "a", "a", 3000, "A")]).withColumn("cluster_product_name", F.lit("blue"))
    history = spark.createDataFrame([], "item_id long, recorded_at date, price long")
    assert I.related_clusters(own, history, " ").count() == 0 and I.related_clusters(own, history, "blue").count() == 1


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from pricelore.sources import versions

    rows = spark.range(200_000).select(F.concat(F.lit("w"), F.col("id")).alias("word"), F.sha2(F.col("id").cast("string"), 256).alias("x"), F.lit(3).alias("bucket"))
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for k in keys:
        spark.conf.set(k, "1m")
    try:
        versions.publish(spark, str(tmp_path), {}, {"words": (rows.repartition(8), [3])})
    finally:
        for k in keys:
            spark.conf.unset(k)
    folder = versions.current(spark, str(tmp_path))[("words", 3)]
    written = spark.read.parquet(folder)
    assert written.count() == written.select("word").distinct().count() == 200_000
    assert written.select(F.input_file_name()).distinct().count() > 1
