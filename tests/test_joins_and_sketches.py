"""Top-k matches with heavy tokens against all pairs, sketches against exact quartiles, and what charts and pickers add."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pricelore.operators import insight as I
from pricelore.operators import matching as M
from pricelore.operators import prices as P


def best(profiles, entries, limit, min_shared):
    out = []
    for pid, tokens, platform in profiles:
        found = []
        for eid, own, e_platform, verified, cluster in entries:
            shared = len(set(tokens) & set(own))
            if shared >= max(min_shared, 1):
                similarity = min(1.0, shared / (len(set(tokens)) + len(set(own)) - shared) + 0.05 * (platform == e_platform) + 0.05 * verified)
                found.append(((not verified, -similarity, -shared, cluster is None, eid), eid, shared, similarity))
        out += [(pid, eid, shared, round(similarity, 9), place) for place, (_, eid, shared, similarity) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize(("limit", "min_shared"), [(3, 1), (2, 2)])
def test_heavy_tokens_give_the_same_matches(spark, limit, min_shared):
    rnd = random.Random(limit)
    common, rare = ["new", "sale", "phone"], [f"r{k}" for k in range(25)]
    pick = lambda: [t for t in common if rnd.random() < 0.5] + rnd.sample(rare, rnd.randint(0, 3))
    entries = [(k, pick(), rnd.choice("ab"), rnd.random() < 0.2, rnd.choice(["c", None])) for k in range(150)]
    profiles = [(k, pick(), rnd.choice("ab")) for k in range(60)]
    e = spark.createDataFrame(entries, "entry_id long, tokens array<string>, platform string, verified boolean, cluster_id string")
    p = spark.createDataFrame(profiles, "profile_id long, tokens array<string>, platform string")
    want = best(profiles, entries, limit, min_shared)
    for heavy in (10**6, 30, 0):
        got = M.title_matches(p, e, limit, min_shared, heavy).collect()
        assert sorted((r["profile_id"], r["entry_id"], r["shared"], round(r["similarity"], 9), r["place"]) for r in got) == want, heavy
    assert len(want) > 50


def test_sketches_of_days_merge(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", " "]), int(rnd.lognormvariate(10, 1)), datetime.date(2024, 1, 1 + k % 20)) for k in range(30_000)] + [("a", 0, datetime.date(2024, 1, 1)), ("a", None, datetime.date(2024, 1, 1)), (None, 5, datetime.date(2024, 1, 1)), ("few", 7, datetime.date(2024, 1, 2))]
    frame = spark.createDataFrame(rows, "keyword string, price long, day date")
    days = P.daily_sketches(frame, "keyword", F.col("day"))
    half = days.where("day < '2024-01-11'").unionByName(days.where("day >= '2024-01-11'"))
    got = {r["keyword"]: r for r in P.sketch_stats(half, "keyword").collect()}
    exact = {r["keyword"]: r for r in P.group_stats(frame, "keyword").collect()}
    assert got.keys() == exact.keys() == {"a", "b", "few"}
    for k in exact:
        own = sorted(r[1] for r in rows if r[0] == k and r[1])
        assert [got[k][c] for c in ("item_count", "min_price", "max_price")] == [exact[k][c] for c in ("item_count", "min_price", "max_price")] and abs(got[k]["average_price"] - exact[k]["average_price"]) < 1e-6
        for c, share in (("q1", 0.25), ("median_price", 0.5), ("q3", 0.75)):
            below, upto = sum(x < got[k][c] for x in own) / len(own), sum(x <= got[k][c] for x in own) / len(own)
            assert below - 0.005 <= share <= upto + 0.005, (k, c)


def test_charts_include_chosen_products(spark):
    points = spark.createDataFrame([("a", "2024-01-01", 10), ("a", "2024-01-02", 30), ("b", "2024-01-01", 5)], "item_id string, day string, price long")
    chosen = spark.createDataFrame([("a", 5), ("a", 20), ("c", 1)], "item_id string, price long")
    got = {r["item_id"]: (r["min_price"], r["max_price"], r["mean_price"], r["min_day"], r["latest_price"]) for r in I.series_summary(points, products=chosen).collect()}
    assert got == {"a": (5, 30, 20, "2024-01-01", 30), "b": (5, 5, 5, "2024-01-01", 5)}


def test_pickers_of_users_without_products(spark):
    own = spark.createDataFrame([(1, "s", 1, ["x"], 9, 1)], "user_id long, section string, section_no int, tokens array<string>, product_id long, place int")
    offered = spark.createDataFrame([(u, p, t, k) for u in (1, 2, 3, 4) for k, (p, t) in enumerate([(5, "갤럭시 S25"), (6, "아이폰 16"), (7, "갤럭시 S24 울트라"), (8, "갤럭시 탭")])], "user_id long, product_id long, text string, place int")
    anchors = spark.createDataFrame([(1, "갤럭시"), (2, "갤럭시 s24"), (3, " "), (4, "x")], "user_id long, keyword string")
    got = sorted((r["user_id"], r["section"], r["product_id"], r["place"]) for r in I.picker_anchors(own, offered, anchors).collect())
    assert got == [(2, "갤럭시 s24", 7, 1), (3, "추천 상품", 5, 1), (3, "추천 상품", 6, 2)]
