"""The entry points that users run: refine, enrich, collect, load, index, insights, detail, and the chain of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.functions import text as T
from pricelore.functions import values as V
from pricelore.operators import clustering as C
from pricelore.operators import insight as I
from pricelore.operators import matching as M
from pricelore.operators import prices as P
from pricelore.operators import reports as R
from pricelore.operators import search_index as X
from pricelore.shared import few, reliable
from pricelore.sources import listings as S
from pricelore.sources import versions


def refine(rows: DataFrame, as_of: Column, stages: int = 0, cut=reliable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P1. (clean with clusters and ratings, dropped with reasons, statistics) of listings keyword, platform, pid, name, price, status, ts.

    ``stages`` above 0 also runs the token-stage clusters and names token-route products by their labels.
    """
    checked = P.validate(rows, by_name=True)
    bad = checked.where("drop_reason IS NOT NULL")
    good = checked.where("drop_reason IS NULL").drop("drop_reason", "drop_stage", "drop_detail")
    clean, low_high = P.remove_outliers(good, "keyword")
    clean = cut(clean.withColumn("row_id", F.xxhash64("keyword", "platform", "pid", "name", "price")))
    # what follows from keyword and name is made once for each distinct pair
    texts = cut(clean.groupBy("keyword", "name").agg(F.count("*").alias("n")).withColumn("cluster_text", T.cluster_text(F.col("name"))))
    named = clean.join(few(C.named(cut(C.tokenised(texts, C.vocabulary(texts, n="n")))).drop("n")), ["keyword", "name"])
    if stages:
        staged = C.token_stages(cut(named), stages, cut=cut)
        label = F.array_join(F.array(*(F.col(f"c{k}") for k in range(1, stages + 1) if f"c{k}" in staged.columns)), " ")
        named = staged.withColumn("cluster_product_name", F.when(F.col("cluster_route") == "token", label).otherwise(F.col("cluster_product_name")))
    kept, by_product = P.remove_outliers(named, "cluster_product_name", "product_name_price_outlier")
    kept = cut(kept)
    rated = P.rate(kept.withColumn("view_count", F.lit(0)).withColumn("seen_at", F.col("ts")), as_of)
    dropped = bad.unionByName(low_high).unionByName(by_product.select(*bad.columns))
    return rated, dropped, R.run_statistics(rated, dropped)


def enrich(rows: DataFrame, entries: DataFrame, dictionary: DataFrame, rules: DataFrame, classifier=None) -> DataFrame:
    """P2. ``rows`` (row_id, keyword, platform, name) with category, its confidence and method, dictionary values, graph keywords and cluster fields.

    The category is that of the dictionary values' rules if they agree on one, else that of the keyword's own words, else the vote of the matched entries, else the classifier's. Entries may have representative_name, tree_path_ids and matched_keywords, which the graph keywords take up.
    """
    profiles = rows.select(F.col("row_id").alias("profile_id"), T.title_tokens(F.col("name")).alias("tokens"), "platform")
    matches = reliable(M.title_matches(profiles, entries).join(entries.select("entry_id", "category"), "entry_id"))
    votes = reliable(M.category_votes(matches, rows.select(F.col("row_id").alias("profile_id"), F.col("keyword").alias("source_keyword"))))
    matched = M.dictionary_matches(rows.select(F.col("name").alias("title")), dictionary)
    values = matched.select("title", F.explode("matched").alias("field", "value")).withColumn("confidence", F.lit(0.0))
    words = rows.select(F.col("keyword").alias("title")).distinct().select("title", F.explode(F.array_distinct(T.title_tokens(F.col("title")))).alias("value"), F.lit(0.0).alias("confidence"))
    ruled = lambda df, floor, key, prefix: M.category_by_rules(df, rules, floor).select(F.col("title").alias(key), F.col("category").alias(f"{prefix}_category"), F.col("confidence").alias(f"{prefix}_floor"))
    out = rows.join(votes.select(F.col("profile_id").alias("row_id"), "category", F.col("confidence").alias("category_confidence"), F.col("method").alias("classification_method")), "row_id", "left")
    out = out.fillna({"category": M.NO_CATEGORY, "category_confidence": 0.0})
    out = out.withColumn("classification_method", F.when(F.col("category") == M.NO_CATEGORY, M.BY_MODEL).otherwise(F.col("classification_method")))
    out = M.classify_titles(out, classifier) if classifier else out
    out = out.join(matched.withColumnRenamed("title", "name"), "name", "left").join(ruled(values, 0.9, "name", "r"), "name", "left").join(ruled(words, 0.75, "keyword", "k"), "keyword", "left")
    method = F.when(F.col("r_category").isNotNull(), M.BY_PRODUCT_NAME).when(F.col("k_category").isNotNull(), M.BY_KEYWORD_WORDS).otherwise(F.col("classification_method"))
    out = out.withColumns({"classification_method": method, "category_confidence": F.greatest("category_confidence", F.coalesce("r_floor", "k_floor", F.lit(0.0))), "category": F.coalesce("r_category", "k_category", "category")}).drop("r_category", "r_floor", "k_category", "k_floor")
    evidence = M.evidence(matches, votes, profiles, entries).withColumnRenamed("profile_id", "row_id")
    out = out.join(evidence, "row_id", "left").withColumn("graph_keywords", M.graph_keywords(F.col("category"), F.col("keyword"), F.col("matched"), F.col("evidence"))).drop("evidence")
    return out.withColumn("f", C.single_fields(F.col("name"), F.col("keyword"))).select("*", "f.*").drop("f")


def collect(sources: list[DataFrame], baseline: str, entries: DataFrame, dictionary: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P3. (kept, dropped): sources put together, filtered row by row, enriched, verified against the baseline platform, and cleaned of outliers by product."""
    whole = sources[0]
    for s in sources[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    checked = P.validate(whole)
    good = checked.where("drop_reason IS NULL").drop("drop_reason", "drop_stage", "drop_detail").withColumn("row_id", F.xxhash64("platform", "pid", "name"))
    rich = M.verify_across(enrich(good, entries, dictionary, rules), baseline).where("keep").drop("keep")
    clean, outliers = P.remove_outliers(rich, "cluster_product_name", "product_name_price_outlier")
    return clean, checked.where("drop_reason IS NOT NULL").unionByName(outliers, allowMissingColumns=True)


def load(records: DataFrame, items: DataFrame, history: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """P4. (items, history) after complete records are rated and merged by their keys. Known items keep their item_id, and whatever the records don't bring; new ones get the numbers above the greatest id."""
    good, _ = S.complete(records)
    rated = P.rate(good.withColumns({"cluster_product_name": F.col("canonical_name"), "price": F.col("current_price"), "seen_at": F.col("crawled_at"), "view_count": F.lit(0)}), as_of)
    batch = rated.withColumn("lowest_price", F.col("group_min_price")).withColumn("last_seen_at", as_of).drop("item_id")
    merged = versions.with_ids(versions.merged(items, batch, ITEM_KEYS, ["crawled_at", "current_price"]), "item_id", ITEM_KEYS)
    points = S.history_points(good, merged)
    return merged, S.upsert(history, points, ["item_id", "recorded_at"], ["price"])


ITEM_KEYS = ["platform_name", "original_id"]
#: What ``store`` keeps where nothing is kept yet.
ITEMS = "item_id long, platform_name string, original_id string, title string, canonical_name string, category_name string, current_price long, lowest_price long, status string, item_url string, thumbnail_url string, matched_keywords string, crawled_at timestamp, rating double, last_seen_at timestamp"
POINTS = "item_id long, recorded_at date, price long"


def store(spark: SparkSession, path: str, records: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """P4 into the tables below ``path``: items and history switch together by one manifest file. Gives both as they are then."""
    now = versions.current(spark, path)
    items, history = load(records, versions.read(spark, path, "items", ITEMS, now=now), versions.read(spark, path, "history", POINTS, now=now), as_of)
    versions.publish(spark, path, {"items": items, "history": history})
    now = versions.current(spark, path)
    return versions.read(spark, path, "items", ITEMS, now=now), versions.read(spark, path, "history", POINTS, now=now)


def sync(spark: SparkSession, path: str, items: DataFrame, limit: int | None = None, recreate: bool = False) -> int:
    """P5 and its sink: the items' documents go into the kept index below ``path``; ``recreate`` takes out all documents that aren't among them. Gives the version."""
    docs = index(items, limit)
    known = versions.read(spark, path, "documents", X.DOCUMENTS).select("document_id")
    return X.update(spark, path, docs, known.join(docs.select("document_id"), "document_id", "left_anti") if recreate else None)


def index(items: DataFrame, limit: int | None = None) -> DataFrame:
    """P5. Search documents with quality flags, of the newest items if there is a limit."""
    return I.documents(S.newest(items, limit) if limit else items)


def insights(items: DataFrame, history: DataFrame, name: str, days: int | None = 30) -> tuple[DataFrame, DataFrame]:
    """P6. (the cluster's daily trend, related clusters)."""
    own = items.where(F.col("cluster_product_name") == name).select("item_id", "cluster_product_name").join(history, "item_id")
    return I.window_points(I.daily_points(own, ["cluster_product_name"]), days, "cluster_product_name"), I.related_clusters(items, history, name)


def detail(item_id: int, items: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """P7. The product view of an item with the longer of its own and its group's series; estimated points if both are empty."""
    one = items.where(F.col("item_id") == item_id).limit(1)
    target = one.first()
    if target is None:
        return one.withColumn("points", F.array().cast("array<struct<day: string, price: bigint>>"))
    own = I.daily_points(history.where(F.col("item_id") == item_id), [])
    group = I.similar_group_series(target.asDict(), items)
    longer = own if own.count() >= group.count() else group
    points = longer.agg(F.array_sort(F.collect_list(F.struct("day", "price"))).alias("points")).first()["points"]
    made = V.estimated_series(F.col("current_price"), F.to_date(as_of))
    estimated = F.transform(made, lambda p: F.struct(p["day"].cast("string").alias("day"), p["price"].alias("price")))
    given = F.array(*(F.struct(F.lit(p["day"]).alias("day"), F.lit(p["price"]).cast("long").alias("price")) for p in points)) if points else estimated
    return one.withColumn("points", given).withColumn("description", V.description(F.col("description") if "description" in items.columns else F.lit(None).cast("string"), F.col("title"), F.col("platform_name") if "platform_name" in items.columns else F.lit("")))


def chain(spark: SparkSession, csv: str, out: str, as_of: Column, skip_refine: bool = False, skip_load: bool = False) -> None:
    """P8. Refine the listings of ``csv``, write both results, and load them as items and history into the store below ``out``."""
    raw = S.read_listings(spark, csv)
    rows = raw.select("keyword", "platform", "pid", "name", F.col("price_numeric").cast("long").alias("price"), V.import_state(F.col("status")).alias("status"), V.moment(F.col("date"), as_of).alias("ts"), "link", "image_url")
    if not skip_refine:
        clean, dropped, statistics = refine(rows, as_of)
        S.write_refined(clean, dropped, out)
        statistics.write.mode("overwrite").parquet(f"{out}/statistics")
    done = spark.read.parquet(f"{out}/clean").withColumnsRenamed({"price": "price_numeric", "ts": "date"}).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm"))
    records = S.complete(S.to_record(done, as_of))[0]
    records.write.mode("overwrite").parquet(f"{out}/records")
    if not skip_load:
        store(spark, f"{out}/store", spark.read.parquet(f"{out}/records"), as_of)
