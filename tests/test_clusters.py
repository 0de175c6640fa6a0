import random

import numpy as np

from pricelore.operators import clustering as C
from pricelore.operators.graph import connected_components


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive(texts, low, high, threshold):
    def grams(t):
        out = {}
        for w in t.split():
            w = f" {w} "
            for n in range(low, high + 1):
                for i in range(len(w) - n + 1):
                    out[w[i : i + n]] = out.get(w[i : i + n], 0) + 1
        return out

    each = [grams(t) for t in texts]
    df = {}
    for g in each:
        for k in g:
            df[k] = df.get(k, 0) + 1
    vectors = []
    for g in each:
        v = {k: n * (np.log((1 + len(texts)) / (1 + df[k])) + 1) for k, n in g.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        vectors.append({k: x / norm for k, x in v.items()})
    d = np.array([[1 - sum(x * b.get(k, 0) for k, x in a.items()) for b in vectors] for a in vectors])
    clusters = [[i] for i in range(len(texts))]
    while len(clusters) > 1:
        best = min((np.mean([d[i, j] for i in a for j in b]), x, y) for x, a in enumerate(clusters) for y, b in enumerate(clusters) if x < y)
        if best[0] >= threshold:
            break
        clusters[best[1]] += clusters.pop(best[2])
    return {frozenset(texts[i] for i in c) for c in clusters}


def test_linked_clusters_equal_the_undivided_ones(spark):
    rnd = random.Random(8)
    texts = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))) for _ in range(24)})
    got = C.linked_clusters(spark.createDataFrame([("k", t) for t in texts], "keyword string, text string"), ["keyword"], 1, 4, 0.4).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["cluster"], set()).add(r["text"])
    assert {frozenset(g) for g in groups.values()} == naive(texts, 1, 4, 0.4)


def test_rounds_equal_the_undivided_clusters(spark, monkeypatch):
    rnd = random.Random(9)
    texts = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))) for _ in range(24)})
    monkeypatch.setattr(C, "LOCAL_TEXTS", 3)
    monkeypatch.setattr(C, "average_linkage", lambda d, t, own=C.average_linkage: own(d, t) if len(d) <= 3 else 1 / 0)
    got = C.linked_clusters(spark.createDataFrame([("k", t) for t in texts], "keyword string, text string"), ["keyword"], 1, 4, 0.4).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["cluster"], set()).add(r["text"])
    assert all(k == min(g) for k, g in groups.items()) and len(groups) < len(texts)
    assert {frozenset(g) for g in groups.values()} == naive(texts, 1, 4, 0.4)


def test_attached_words():
    assert C.split_attached("갤럭시버즈케이스", ["갤럭시", "케이스"]) == ["갤럭시", "버즈", "케이스"]
    assert C.split_attached("버즈", ["갤럭시"]) == ["버즈"]


def test_bracket_clusters(spark):
    contents = spark.createDataFrame([("새상품 미개봉", 5), ("미개봉", 2), ("직거래", 9)], "content string, total_count long")
    got = {r["content"]: r["cluster_id"] for r in C.bracket_clusters(contents).collect()}
    assert got["새상품 미개봉"] == got["미개봉"] == "bracket_002" and got["직거래"] == "bracket_001"


def test_bracket_clusters_are_numbered_over_partitions(spark):
    contents = spark.createDataFrame([(f"word{k}", k % 40) for k in range(200)], "content string, total_count long")
    found = C.bracket_clusters(contents)
    got = {r["content"]: r["cluster_id"] for r in found.collect()}
    order = sorted(range(200), key=lambda k: (-(k % 40), f"word{k}"))
    assert got == {f"word{k}": f"bracket_{n:03d}" for n, k in enumerate(order, 1)}
    keys = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "SinglePartition" in line]
    assert not keys


def test_registered_token_stages_reach_long_titles(spark, tmp_path):
    from pricelore.plans import registry

    spark.createDataFrame([(1, "red oak anvil stand north", "Brand#1", "T", 1, 900.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 10.0, 1.0, "1998-01-01")], "l_partkey long, l_extendedprice double, l_quantity double, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["token_stage_clusters"](spark, str(tmp_path)).first()
    assert [got[f"c{k}"] for k in range(1, 6)] == ["red", "oak", "anvil", "stand", "north"]


def test_stages_of_weighed_tokens_are_those_of_the_rows(spark):
    tokens = [(["alphabet", "x"], 1), (["alphabets", "x"], 3), (["river", "y"], 1), (["stone", "y"], 2), (["cloud"], 1), (["meadow"], 1), ([], 2), (None, 1)]
    schema = "row_id long, keyword string, tokens array<string>"
    once = spark.createDataFrame([(k, "k", t, n) for k, (t, n) in enumerate(tokens)] + [(90, None, ["river"], 1)], schema + ", n long")
    often = spark.createDataFrame([(k, "k", t) for k, (t, n) in enumerate(tokens) for _ in range(n)] + [(90, None, ["river"])], schema)
    plain = C.token_stages(often)
    assert plain.columns == ["row_id", "keyword", "tokens", "c1", "c2"] and plain.count() == 13
    weighed = {r["row_id"]: (r["c1"], r["c2"]) for r in C.token_stages(once, n="n").collect()}
    assert weighed == {r["row_id"]: (r["c1"], r["c2"]) for r in plain.collect()} and weighed[0] == weighed[1] == ("alphabets", "x") and weighed[6] == weighed[7] == (None, None)


def test_near_duplicate_groups(spark):
    long = "apple iphone sixteen pro max blue titanium with case and box"
    rows = [("k", long, "A", 100), ("k", long, "B", 300), ("k", long + "s", "C", 210), ("k", "other thing", "D", 5), ("l", long, "E", 7), ("l", "same", "F", 1), ("l", "same", "F2", 9)]
    got = {(r["keyword"], r["root"]): r for r in C.near_duplicate_groups(spark.createDataFrame(rows, "keyword string, text string, name string, price long")).collect()}
    assert got.keys() == {("k", long), ("l", "same")}
    r = got["k", long]
    assert (r["item_count"], r["min_price"], r["median_price"], r["max_price"], r["representative"], r["sample_names"], r["max_similarity"]) == (3, 100, 210.0, 300, "C", "A | B | C", 1.0)
    assert 0.92 <= r["min_similarity"] < 1 and abs(r["avg_similarity"] - (1 + 2 * r["min_similarity"]) / 3) < 2e-4
    assert (got["l", "same"]["item_count"], got["l", "same"]["min_similarity"], got["l", "same"]["representative"]) == (2, 1.0, "F")
