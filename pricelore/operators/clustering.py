"""Names and clusters of titles: attached words, token stages, near-duplicate titles, bracket contents.

Distances are cosines of character n-gram TF-IDF vectors (word-bounded, idf over all distinct texts of a group, L2 norm). Pairs come from a join on n-grams. Average linkage is run inside the
connected components of pairs below the threshold only: a merge below the threshold needs one such pair, so components never merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelore.functions import text as T
from pricelore.operators.graph import connected_components
from pricelore.operators.reports import first_samples
from pricelore.shared import FEW, few, reliable

if TYPE_CHECKING:
    import pandas as pd

STAGE_DISTANCE, STAGE_COLUMNS, STAGE_TOKENS, STAGE_ITEMS = 0.25, 8, 5, 2
MOST_NGRAMS = 5000
#: Texts of a component that one task links by itself; larger ones are linked in rounds over tables, with the same result.
LOCAL_TEXTS = 200


def vocabulary(rows: DataFrame, least_length: int = 2, least_count: int = 2, n: str | None = None) -> DataFrame:
    """(keyword, token, count) of the tokens by which attached words are taken apart. ``n``: a column that says how many rows a row stands for. Texts are cut once for each distinct one."""
    texts = rows.groupBy("keyword", "cluster_text").agg((F.sum(n) if n else F.count("*")).alias("n"))
    tokens = texts.select("keyword", "n", F.explode(T.kept_tokens(F.col("cluster_text"))).alias("token")).where((F.length("token") >= least_length) & ~T.is_fragment(F.col("token")))
    return tokens.groupBy("keyword", "token").agg(F.sum("n").alias("count")).where(F.col("count") >= least_count)


def split_attached(token: str, words: list[str]) -> list[str]:
    """A token cut along vocabulary words, the longest first, non-overlapping; itself if none is inside."""
    taken: list[tuple[int, int]] = []
    for word in words:
        at = token.find(word)
        while at >= 0 and word != token:
            if all(at + len(word) <= a or at >= b for a, b in taken):
                taken.append((at, at + len(word)))
            at = token.find(word, at + 1)
    if not taken:
        return [token]
    parts, cursor = [], 0
    for a, b in sorted(taken):
        parts += [token[cursor:a], token[a:b]]
        cursor = b
    return [p for p in [*parts, token[cursor:]] if p]


def tokenised(rows: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """``rows`` (keyword, cluster_text) with ``tokens``.

    Each distinct token of a keyword is cut once, against the vocabulary words it holds (met through their first two characters), then the parts go back to the distinct texts by position, and the texts' tokens to their rows.
    """
    vocab = vocabulary(rows) if vocab is None else vocab
    places = rows.select("keyword", "cluster_text").distinct().select("keyword", "cluster_text", F.posexplode(T.kept_tokens(F.col("cluster_text"))).alias("pos", "token"))
    distinct = places.select("keyword", "token").distinct()
    model_parts = F.regexp_replace("token", f"({T.BOUNDARY})", " $1 ")
    pieces = distinct.select("keyword", "token", F.posexplode(F.filter(F.split(model_parts, " "), lambda x: x != "")).alias("k", "piece"))
    pairs = pieces.select("keyword", "piece").distinct().withColumn("start", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("piece") - 1, F.lit(1))), lambda i: F.substring("piece", i, 2)))))
    keyed = vocab.select("keyword", F.col("token").alias("word"), "count", F.substring("token", 1, 2).alias("start"))
    held = pairs.join(keyed, ["keyword", "start"]).where(F.col("piece").contains(F.col("word")) & (F.col("piece") != F.col("word"))).select("keyword", "piece", "word", "count").distinct()
    order = F.struct((-F.length("word")).alias("a"), (-F.col("count")).alias("b"), F.col("word").alias("word"))
    words = held.groupBy("keyword", "piece").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["word"]).alias("words"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fixed = f["piece"].str.fullmatch(f"(?:{T.BOUNDARY}|{T.IPHONE_VARIANT}|케이스티파이)")
            f["parts"] = [[p] if keep or w is None else split_attached(p, list(w)) for p, w, keep in zip(f["piece"], f["words"], fixed, strict=True)]
            yield f[["keyword", "token", "k", "parts"]]

    parts = pieces.join(words, ["keyword", "piece"], "left").select("keyword", "token", "k", "piece", "words").mapInPandas(cut, "keyword string, token string, k int, parts array<string>")
    whole = parts.groupBy("keyword", "token").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "parts"))), lambda x: x["parts"])).alias("parts"))
    back = places.join(whole, ["keyword", "token"]).groupBy("keyword", "cluster_text").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parts"))), lambda x: x["parts"])).alias("tokens"))
    kept = F.filter("tokens", lambda t: ~t.isin(*T.EXCLUDED) & ~t.rlike("^[0-9]+$") & ~T.is_fragment(t))
    made = few(back.withColumn("tokens", T.merge_iphone(kept)))
    return rows.join(made, ["keyword", "cluster_text"], "left").select(*rows.columns, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def ngrams(texts: DataFrame, group: list[str], low: int, high: int, most: int | None = None) -> DataFrame:
    """(group, text, gram, weight): the TF-IDF vectors of the distinct texts of each group."""
    words = texts.select(*group, "text", F.explode(F.split("text", " ")).alias("w")).where("w <> ''").withColumn("w", F.concat(F.lit(" "), F.col("w"), F.lit(" ")))
    size = F.length("w")

    def of_length(n: int) -> Column:
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("w", i, n))).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*map(of_length, range(low, high + 1))))
    tf = words.select(*group, "text", F.explode(grams).alias("gram")).groupBy(*group, "text", "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*group, "gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if most:
        df = df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("total"), "gram"))).where(F.col("place") <= most)
    n = texts.groupBy(*group).agg(F.count("*").alias("n"))
    raw = tf.join(df, [*group, "gram"]).join(n, group).withColumn("raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy(*group, "text").agg(F.sqrt(F.sum(F.col("raw") ** 2)).alias("norm"))
    return raw.join(norms, [*group, "text"]).select(*group, "text", "gram", (F.col("raw") / F.col("norm")).alias("weight"))


def similar_pairs(vectors: DataFrame, group: list[str], least: float) -> DataFrame:
    """(group, a, b, similarity) of the pairs of texts with a cosine of ``least`` or more. Only pairs that share a gram of each one's prefix meet: the grams in order of rarity until the rest can't reach ``least`` any more."""
    freq = vectors.groupBy(*group, "gram").agg(F.count("*").alias("f"))
    order = Window.partitionBy(*group, "text").orderBy(F.desc("f"), "gram")
    ranked = vectors.join(freq, [*group, "gram"]).withColumn("rest", F.sqrt(F.sum(F.col("weight") ** 2).over(order)))
    prefix = ranked.where(F.col("rest") >= least - 1e-9).select(*group, "text", "gram")
    candidates = prefix.select(*group, "gram", F.col("text").alias("a")).join(prefix.select(*group, "gram", F.col("text").alias("b")), [*group, "gram"]).where("a < b").select(*group, "a", "b").distinct()
    left = candidates.join(vectors.select(*group, F.col("text").alias("a"), "gram", F.col("weight").alias("wa")), [*group, "a"])
    both = left.join(vectors.select(*group, F.col("text").alias("b"), "gram", F.col("weight").alias("wb")), [*group, "b", "gram"])
    return both.groupBy(*group, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def average_linkage(distance: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers of average linkage, merging the nearest pair while it is below the threshold."""
    d, size, label = distance.astype(float).copy(), np.ones(len(distance)), np.arange(len(distance))
    np.fill_diagonal(d, np.inf)
    while len(d) > 1:
        i, j = divmod(int(np.argmin(np.round(d, 12))), len(d))
        if not d[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i], d[i, i] = row, row, np.inf
        size[i] += size[j]
        d[j], d[:, j] = np.inf, np.inf
        label[label == j] = i
    return label


def linked_in_rounds(vectors: DataFrame, pairs: DataFrame, distance: float, cut=reliable) -> DataFrame:
    """(node, cluster) of average linkage over vectors (node, gram, weight), as tables. pairs (a, b): those below ``distance``.

    Each round merges all mutual nearest neighbours below the threshold, which average linkage would merge too (it is reducible). A pair's mean similarity is the product of its clusters' summed vectors over their sizes.
    Pairs at or above the threshold are dropped: merges bring two such pairs no nearer. Ties go to the least names; similarities count to twelve digits.
    """
    members = cut(vectors.select("node").distinct().withColumn("cluster", F.col("node")))
    sums, edges = vectors.select(F.col("node").alias("c"), "gram", "weight"), pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    while True:
        sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
        both = edges.join(sums.select(F.col("c").alias("a"), "gram", F.col("weight").alias("wa")), "a").join(sums.select(F.col("c").alias("b"), "gram", F.col("weight").alias("wb")), ["b", "gram"])
        products = both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s")).join(sizes.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
        near = cut(products.select("a", "b", F.round(1 - F.col("s") / (F.col("na") * F.col("nb")), 12).alias("d")).where(F.col("d") < distance))
        if near.isEmpty():
            return members
        pair = F.struct("d", "a", "b")
        best = near.select(F.explode(F.array("a", "b")).alias("c"), pair.alias("p")).groupBy("c").agg(F.min("p").alias("p"))
        merged = cut(best.groupBy("p").agg(F.count("*").alias("ends")).where("ends = 2").select(F.col("p.b").alias("old"), F.col("p.a").alias("new")))

        def renamed(rows: DataFrame, column: str, merged: DataFrame = merged) -> DataFrame:
            return rows.join(merged.withColumnRenamed("old", column), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")

        members = cut(renamed(members, "cluster"))
        sums = cut(renamed(sums, "c").groupBy("c", "gram").agg(F.sum("weight").alias("weight")))
        ends = renamed(renamed(near.select("a", "b"), "a"), "b")
        edges = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())


def linked_clusters(texts: DataFrame, group: list[str], low: int, high: int, distance: float, most: int | None = None, cut=reliable) -> DataFrame:
    """(group, text, cluster): average-linkage clusters of the distinct texts of each group, each named by its least text."""
    vectors = cut(ngrams(texts, group, low, high, most))
    key = F.to_json(F.struct(*group, F.lit(0).alias("_")))
    node = lambda c: F.concat(key, F.lit("\t"), F.col(c))
    pairs = cut(similar_pairs(vectors, group, 1 - distance).select(node("a").alias("a"), node("b").alias("b")))
    parts = cut(connected_components(pairs, cut).select(F.col("node"), F.col("root")))
    large = cut(parts.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > LOCAL_TEXTS).select("root"))
    noded = vectors.withColumn("node", node("text"))
    members = noded.join(parts.join(large, "root", "left_anti"), "node").select("root", "node", "gram", "weight")

    def link(frame):  # of and to pandas
        import pandas as pd

        names = sorted(frame["node"].unique())
        grams = {g: k for k, g in enumerate(sorted(frame["gram"].unique()))}
        x = np.zeros((len(names), len(grams)))
        x[[names.index(n) for n in frame["node"]] if len(names) < 50 else frame["node"].map({n: k for k, n in enumerate(names)}).to_numpy(), frame["gram"].map(grams).to_numpy()] = frame["weight"].to_numpy()
        label = average_linkage(np.maximum(0, 1 - x @ x.T), distance)
        return pd.DataFrame({"node": names, "cluster": [min(n for n, m in zip(names, label, strict=True) if m == k) for k in label]})

    named = members.groupBy("root").applyInPandas(link, "node string, cluster string")
    if not large.isEmpty():
        inside = parts.join(large, "root").select("node")
        named = named.unionByName(linked_in_rounds(cut(noded.join(inside, "node").select("node", "gram", "weight")), pairs.join(inside.withColumnRenamed("node", "a"), "a"), distance, cut))
    named = named.withColumn("cluster", F.element_at(F.split("cluster", "\t"), -1))
    return texts.withColumn("node", F.concat(key, F.lit("\t"), F.col("text"))).join(named, "node", "left").select(*group, "text", F.coalesce("cluster", "text").alias("cluster"))


def token_stages(rows: DataFrame, stages: int = STAGE_COLUMNS, distance: float = STAGE_DISTANCE, cut=reliable, n: str | None = None) -> DataFrame:
    """``rows`` (row_id, keyword, tokens) with c1..cN: at each position, the tokens of rows with one path so far are clustered; a cluster's label is its most frequent token (the longest, then the first of equals).

    Model and storage names keep to themselves, and so does a position with fewer than five distinct tokens or two rows. Stages run over the distinct tokens of a keyword, with the rows that have them; ``n``: a column that says how many rows a row stands for.
    """
    out, path = cut(rows.groupBy("keyword", "tokens").agg((F.sum(n) if n else F.count("*")).alias("_n"))), ["keyword"]
    for k in range(1, stages + 1):
        at = out.withColumn("_t", F.get("tokens", F.lit(k - 1))).where("_t IS NOT NULL")
        fixed = F.col("_t").rlike(f"^(?:{T.MODEL}|{T.STORAGE})$")
        counts = cut(at.groupBy(*path, "_t").agg(F.sum("_n").alias("n"), F.first(fixed).alias("fixed")))
        if counts.isEmpty():
            break
        sizes = counts.where(~F.col("fixed")).groupBy(*path).agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).where((F.col("kinds") >= STAGE_TOKENS) & (F.col("rows") >= STAGE_ITEMS))
        free = counts.where(~F.col("fixed")).join(sizes.select(*path), path).withColumnRenamed("_t", "text")
        clusters = linked_clusters(free.select(*path, "text"), path, 1, 4, distance, cut=cut)
        best = clusters.join(free, [*path, "text"]).groupBy(*path, "cluster").agg(F.max_by("text", F.struct("n", F.length("text").alias("l"), F.col("text"))).alias("label"))
        labels = clusters.join(best, [*path, "cluster"]).select(*path, F.col("text").alias("_t"), "label")
        named = counts.join(labels, [*path, "_t"], "left").select(*(F.col(c).alias(f"_p{n}") for n, c in enumerate(path)), "_t", F.coalesce("label", "_t").alias(f"c{k}"))
        same = F.get("tokens", F.lit(k - 1)) == F.col("_t")
        for n, c in enumerate(path):
            same = same & (F.col(c) == F.col(f"_p{n}"))
        out = cut(out.join(named, same, "left").select(*out.columns, f"c{k}"))
        path = [*path, f"c{k}"]
    made = few(out.select(F.col("keyword").alias("_k"), F.col("tokens").alias("_t"), *path[1:]))
    return rows.join(made, F.col("keyword").eqNullSafe(F.col("_k")) & F.col("tokens").eqNullSafe(F.col("_t")), "left").select(*rows.columns, *path[1:])


def representatives(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row of each group: the price next to the group's median, then the shortest text, then the lowest price."""
    median = rows.groupBy(*group).agg(F.percentile("price", F.lit(0.5)).alias("median"))
    return rows.join(median, group).groupBy(*group).agg(F.min_by("text", F.struct(F.abs(F.col("price") - F.col("median")), F.length("text"), "price", "text")).alias("representative"), F.count("*").alias("size"), F.first("median").alias("median_price"))


def near_duplicate_titles(rows: DataFrame, least: float = 0.92, cut=reliable) -> DataFrame:
    """(keyword, root, text): groups of two or more distinct titles of a keyword, joined by pairs of that cosine."""
    return _near_groups(_near_pairs(rows, least, cut), cut)


def _near_pairs(rows: DataFrame, least: float, cut) -> DataFrame:
    return cut(similar_pairs(ngrams(rows.select("keyword", "text").distinct(), ["keyword"], 2, 5, MOST_NGRAMS), ["keyword"], least))


def _near_groups(pairs: DataFrame, cut) -> DataFrame:
    node = lambda c: F.concat_ws("\t", "keyword", c)
    parts = connected_components(pairs.select(node("a").alias("a"), node("b").alias("b")), cut)
    return parts.select(F.element_at(F.split("node", "\t"), 1).alias("keyword"), F.element_at(F.split("root", "\t"), -1).alias("root"), F.element_at(F.split("node", "\t"), -1).alias("text"))


def near_duplicate_groups(rows: DataFrame, least: float = 0.92, cut=reliable) -> DataFrame:
    """(keyword, root, item_count, similarities of its pairs, prices, representative, sample_names): groups of two or more listings (keyword, text, name, price) of a keyword whose texts are the same or joined by pairs of that cosine.

    Listings with one text are as many pairs with a similarity of 1; they are counted, not made. The representative is next to the median price, then the shortest, then the cheapest.
    """
    counts = cut(rows.groupBy("keyword", "text").agg(F.count("*").alias("n")))
    pairs = _near_pairs(counts, least, cut)
    groups = _near_groups(pairs, cut)
    same = counts.where("n > 1").select("keyword", F.col("text").alias("root"), "text").join(groups.select("keyword", "text"), ["keyword", "text"], "left_anti").select("keyword", "root", "text")
    groups = cut(groups.unionByName(same))
    sized = groups.join(counts, ["keyword", "text"])
    within = sized.where("n > 1").select("keyword", "root", (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.lit(1.0).alias("similarity"))
    own = lambda side: sized.select("keyword", "root", F.col("text").alias(side), F.col("n").alias(f"n_{side}"))
    across = pairs.join(own("a"), ["keyword", "a"]).join(own("b").drop("root"), ["keyword", "b"]).select("keyword", "root", (F.col("n_a") * F.col("n_b")).cast("double").alias("pairs"), "similarity")
    both = within.unionByName(across).groupBy("keyword", "root")
    statistics = both.agg(F.round(F.min("similarity"), 4).alias("min_similarity"), F.round(F.sum(F.col("pairs") * F.col("similarity")) / F.sum("pairs"), 4).alias("avg_similarity"), F.round(F.max("similarity"), 4).alias("max_similarity"))
    listed = rows.join(groups, ["keyword", "text"])
    medians = listed.groupBy("keyword", "root").agg(F.count("*").alias("item_count"), F.min("price").alias("min_price"), F.percentile("price", F.lit(0.5)).alias("median_price"), F.max("price").alias("max_price"))
    nearest = F.min_by("name", F.struct(F.abs(F.col("price") - F.col("median_price")), F.length("text"), "price", "name")).alias("representative")
    chosen = listed.join(medians.select("keyword", "root", "median_price"), ["keyword", "root"]).groupBy("keyword", "root").agg(nearest)
    out = medians.join(statistics, ["keyword", "root"]).join(chosen, ["keyword", "root"]).join(first_samples(listed, ["keyword", "root"], "name", 6, "sample_names"), ["keyword", "root"])
    return out.select("keyword", "root", "item_count", "min_similarity", "avg_similarity", "max_similarity", "min_price", "median_price", "max_price", "representative", "sample_names")


def bracket_clusters(contents: DataFrame, threshold: float = 0.35, min_shared: int = 1, cut=reliable) -> DataFrame:
    """(content, cluster_id, representative) of contents (content, total_count): Jaccard of their tokens, closed over links, numbered by the clusters' total count, then by their first text."""
    tokens = contents.select("content", "total_count", F.array_distinct(T.least_tokens(F.col("content"), 1)).alias("tokens"))
    each = tokens.select("content", F.explode("tokens").alias("t"))
    # two texts at the threshold share one of each one's rarest tokens, so only so many of them meet (prefix filter); common tokens mostly don't
    ranked = each.join(each.groupBy("t").agg(F.count("*").alias("n")), "t").groupBy("content").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("tokens"))
    first = F.slice("tokens", 1, (F.size("tokens") - F.ceil(threshold * F.size("tokens") - 1e-9) + 1).cast("int"))
    rare = ranked.select("content", "tokens", F.explode(first).alias("t"))
    met = rare.select("t", F.col("content").alias("a"), F.col("tokens").alias("ta")).join(rare.select("t", F.col("content").alias("b"), F.col("tokens").alias("tb")), "t").where("a < b")
    shared = F.size(F.array_intersect("ta", "tb"))
    edges = met.where((shared >= min_shared) & (shared / (F.size("ta") + F.size("tb") - shared) >= threshold)).select("a", "b").distinct()
    parts = connected_components(edges, cut)
    whole = tokens.join(parts.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    summary = whole.groupBy("root").agg(F.sum("total_count").alias("total"), F.min("content").alias("first"), F.max_by("content", F.struct("total_count", F.size("tokens"), F.length("content"), "content")).alias("representative"))
    placed = cut(summary.repartitionByRange(F.desc("total"), F.asc("first")).withColumn("part", F.spark_partition_id()))
    offsets, before = [], 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], before))
        before += r["n"]
    offset = F.broadcast(placed.sparkSession.createDataFrame(offsets, "part int, before long"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("total"), "first")) + F.col("before")
    numbered = placed.join(offset, "part").withColumn("cluster_id", F.format_string("bracket_%03d", number)).drop("part", "before")
    return whole.join(numbered, "root").select("content", "cluster_id", "representative", "total_count")


def cluster_summary(rows: DataFrame, path: list[str], samples: tuple[str, ...] = ("name",)) -> DataFrame:
    """Counts, prices and five samples of each path."""
    out = rows.groupBy(*path).agg(F.count("*").alias("item_count"), F.min("price").alias("min_price"), F.percentile("price", F.lit(0.5)).alias("median_price"), F.round(F.avg("price"), 2).alias("mean_price"), F.max("price").alias("max_price"))
    for s in samples:
        out = out.join(first_samples(rows, path, s, 5, f"sample_{s}"), path, "left")
    return out


def cluster_tree(rows: DataFrame, group: str, item_limit: int = 20) -> DataFrame:
    """(keyword, clusters): each keyword's clusters by size, each with its first items by price."""
    place = F.row_number().over(Window.partitionBy("keyword", group).orderBy("price", "platform", "pid"))
    items = rows.withColumn("place", place).where(F.col("place") <= item_limit).groupBy("keyword", group).agg(F.array_sort(F.collect_list(F.struct("place", "platform", "pid", "name", "price"))).alias("items"))
    sizes = rows.groupBy("keyword", group).agg(F.count("*").alias("size"))
    node = F.struct((-F.col("size")).alias("order"), F.col(group).alias("name"), "size", "items")
    return sizes.join(items, ["keyword", group]).groupBy("keyword").agg(F.array_sort(F.collect_list(node)).alias("clusters"))


def named(rows: DataFrame) -> DataFrame:
    """``rows`` (keyword, cluster_text, tokens) with cluster_route and cluster_product_name."""
    return rows.withColumn("cluster_route", T.route(F.col("tokens"), F.col("cluster_text"))).withColumn("cluster_product_name", T.product_name(F.col("keyword"), F.col("tokens"), F.col("cluster_text")))


def keyword_facts(keywords: DataFrame) -> DataFrame:
    """``keywords`` (_keyword) with _k, the keyword without spaces at its ends, and _words and _length of its normal form."""
    normal = T.normal(F.col("_keyword"))
    words = F.size(F.regexp_extract_all(normal, F.lit("[a-z]+[0-9]+|[가-힣]+|[a-z]+|[0-9]+"), F.lit(0)))
    return keywords.withColumns({"_k": T.blank(F.col("_keyword")), "_words": words, "_length": F.length(normal)})


def merged_keywords(rows: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """One row of each (platform, pid): that of the longest keyword in its normal form, the first of equals. matched_keywords are the distinct keywords in order of appearance, canonical_name is the one of them with the most words and numbers, then the longest. rows: seq,
    platform, pid, keyword and what else the kept row brings, by which rows of one seq are told apart. ``keywords``: a smaller table that holds every keyword of the rows, so that these aren't read for them; a keyword that it lacks is an error."""
    key = ["pid", "platform"]  # rows are sorted by the first characters of what comes first, and a pid's tell more
    rest = [c for c in rows.columns if c not in (*key, "seq", "keyword")]
    # rows are dealt by key once and stay sorted by key and keyword: each keyword's first row, then the keywords of a key, are found without another shuffle or sort, and memory holds a key's distinct keywords at most
    first = rows.repartition(*key).groupBy(*key, "keyword").agg(F.min(F.struct("seq", *rest)).alias("_row"))
    # the normal form is made once for each distinct keyword, of which there are few
    texts = (rows if keywords is None else keywords).select(F.col("keyword").alias("_keyword")).distinct()
    known = keyword_facts(texts)
    known = F.broadcast(known) if texts.count() <= FEW else known
    each = first.join(known, F.col("keyword").eqNullSafe(F.col("_keyword")), "left").withColumn("_k", F.coalesce("_k", F.raise_error(F.lit("a keyword of the rows is none of the keywords"))))
    place = Window.partitionBy(*key).orderBy("keyword")
    one = F.struct("_row.seq", "_k", (-F.col("_words")).alias("w"), (-F.col("_length")).alias("n"), "keyword", "_row")
    merged = each.select(*key, F.row_number().over(place).alias("_place"), F.collect_list(one).over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all")).where("_place = 1")
    # most keys have one keyword, for which there is nothing to choose
    only, named = F.col("_all")[0], F.filter("_all", lambda x: x["_k"] != "")
    choice = lambda alone, chosen: F.when(F.size("_all") == 1, alone).otherwise(chosen)
    order = F.array_distinct(F.sort_array(F.transform(named, lambda x: F.struct(x["seq"], x["_k"])))["_k"])
    best = F.array_min(F.transform(named, lambda x: F.struct(x["w"], x["n"], x["seq"], x["_k"])))["_k"]
    kept = choice(only, F.array_min(F.transform("_all", lambda x: F.struct(x["n"], x["seq"], x.alias("x"))))["x"])
    return merged.select(
        "platform", "pid", choice(only["_k"], F.coalesce(best, F.lit(""))).alias("canonical_name"), choice(only["_k"], F.array_join(order, ", ")).alias("matched_keywords"), kept["keyword"].alias("keyword"), *(kept["_row"][c].alias(c) for c in rest)
    )


def single_fields(title: Column, keyword: Column) -> Column:
    """Cluster fields of one row alone, whose own tokens are all there is to go by."""
    text = T.cluster_text(title)
    tokens = T.kept_tokens(text)
    return F.struct(text.alias("cluster_text"), F.array_join(tokens, " ").alias("tokenized"), T.route(tokens, text).alias("cluster_route"), T.product_name(keyword, tokens, text).alias("cluster_product_name"))
