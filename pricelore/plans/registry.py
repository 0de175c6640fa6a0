"""Queries of the library over the driver's tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelore.functions import text as T
from pricelore.functions import values as V
from pricelore.operators import clustering as C
from pricelore.operators import insight as I
from pricelore.operators import matching as M
from pricelore.operators import messages
from pricelore.operators import prices as P
from pricelore.operators import reports as R
from pricelore.operators import search_index as X
from pricelore.plans import adapter as A
from pricelore.plans import pipelines
from pricelore.shared import few, reliable, shared_dir
from pricelore.sources import listings as S
from pricelore.sources import versions
from pricelore.streaming import alerts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _priced(spark: SparkSession, d: str) -> DataFrame:
    """The adapter's items at prices of which some are implausible and some are not."""
    return A.items(spark, d).withColumn("current_price", F.col("current_price") * (F.col("item_id") % 50) * 10)


def as_of():
    return F.lit(A.AS_OF).cast("timestamp")


STATS = """
stats AS (SELECT keyword, count(*) AS item_count, min(price) AS min_price, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median_price, quantile_cont(price, 0.75) AS q3, max(price) AS max_price, avg(price) AS average_price FROM listings WHERE trim(keyword) <> '' AND price > 0 GROUP BY keyword),
bounds AS (SELECT *, q3 - q1 AS iqr, greatest(0, q1 - 1.5 * (q3 - q1), median_price * 0.2) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM stats),
flagged AS (SELECT l.*, median_price, lower_bound, upper_bound, CASE WHEN price < lower_bound THEN 'low' WHEN price > upper_bound THEN 'high' END AS outlier_type FROM listings l LEFT JOIN bounds USING (keyword)),
clean AS (SELECT l.* FROM listings l WHERE NOT EXISTS (SELECT 1 FROM flagged f WHERE f.outlier_type IS NOT NULL AND f.platform = l.platform AND f.pid = l.pid AND f.price = l.price))"""
ACCURACY = """
judged AS (SELECT *, list_filter(regexp_extract_all(keyword, '[a-z]+[0-9]+[a-z]?|[a-z]+|[0-9]+'), lambda t: NOT contains(lower(name), t)) AS missing FROM listings)"""
#: Search documents of the adapter's items, and the words of their fields.
DOCS = """
docs AS (SELECT *, concat_ws(',', CASE WHEN contains(c, 'case') OR contains(c, 'magsafe') THEN 'accessory_candidate' END, CASE WHEN current_price < 1000 OR current_price >= 20000000 THEN 'invalid_price' END) AS quality_flags, title || ' ' || normalized_title || ' ' || canonical_name || ' ' || category_name || ' ' || array_to_string(keywords, ' ') AS search_text FROM (
  SELECT *, CAST(item_id AS VARCHAR) AS document_id, replace(lower(title), ' ', '') AS c, trim(regexp_replace(lower(title), '[^0-9a-z]+', ' ', 'g')) AS normalized_title, [split_part(matched_keywords, ',', 1), split_part(split_part(matched_keywords, ',', 2), '|', 1)] AS keywords FROM (SELECT * REPLACE (current_price * (item_id % 50) * 10 AS current_price) FROM items) WHERE platform_name <> '')),
found AS (SELECT * FROM docs WHERE NOT contains(quality_flags, 'accessory') AND NOT contains(quality_flags, 'invalid')),
fields AS (SELECT document_id, field, weight, list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM (
  SELECT document_id, 'c' AS field, 5.0 AS weight, canonical_name AS body FROM found UNION ALL SELECT document_id, 't', 4.0, title FROM found UNION ALL SELECT document_id, 'k', 3.0, array_to_string(keywords, ' ') FROM found
  UNION ALL SELECT document_id, 'n', 2.0, normalized_title FROM found UNION ALL SELECT document_id, 's', 1.0, search_text FROM found))"""


def fuzzy(*terms: str) -> str:
    """The page of documents of which one field holds all terms, by BM25 and the fields' weights."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""ranked AS (SELECT document_id, max(s * weight) AS score FROM (SELECT h.document_id, h.field, h.weight, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS s, count(*) AS n FROM h JOIN idf USING (field, term) JOIN stats USING (field) GROUP BY ALL) WHERE n = {len(terms)} GROUP BY document_id ORDER BY score DESC, document_id LIMIT 20)""", f"""
h AS (SELECT document_id, field, weight, size, term, count(*) AS tf FROM (SELECT document_id, field, weight, len(words) AS size, unnest(words) AS word FROM fields), (SELECT unnest([{listed}]) AS term) WHERE levenshtein(word, term) <= CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END GROUP BY ALL),
idf AS (SELECT field, term, count(*) AS df FROM h GROUP BY ALL), stats AS (SELECT field, avg(len(words)) AS mean, count(*) AS docs FROM fields GROUP BY field)"""


HISTORY = """
daily AS (SELECT canonical_name, strftime(recorded_at, '%Y-%m-%d') AS day, CAST(round(avg(h.price)) AS BIGINT) AS price FROM history h JOIN items USING (item_id) GROUP BY ALL)"""


def query(sql: str = "", *parts: str):
    """Registers a function under its name, with the SQL behind the adapter's tables and ``parts``."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "WITH " + ",".join((A.SQL, *parts)) + "\n" + sql
        return f

    return put


def two(*columns: str) -> list:
    return [F.round(c, 2).alias(c) for c in columns]


# --- prices and outliers


@query("SELECT keyword, item_count, min_price, round(q1, 2) AS q1, round(median_price, 2) AS median_price, round(q3, 2) AS q3, max_price, round(average_price, 2) AS average_price, round(iqr, 2) AS iqr, round(lower_bound, 2) AS lower_bound, round(upper_bound, 2) AS upper_bound FROM bounds", STATS)
def group_price_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.group_stats(A.listings(spark, d), "keyword").select("keyword", "item_count", "min_price", *two("q1", "median_price", "q3"), "max_price", *two("average_price", "iqr", "lower_bound", "upper_bound"))


@query("SELECT keyword, platform, pid, price, outlier_type, round(lower_bound, 2) AS lower_bound FROM flagged WHERE outlier_type IS NOT NULL", STATS)
def outlier_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.flag_outliers(A.listings(spark, d), "keyword").where("outlier_type IS NOT NULL").select("keyword", "platform", "pid", "price", "outlier_type", *two("lower_bound"))


@query("SELECT keyword, item_count, min_price, max_price, round(average_price, 2) AS average_price, true AS near_q1, true AS near_median, true AS near_q3 FROM stats", STATS)
def sketch_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of daily sketches put together: each within half a percent of its rank among all prices."""
    rows = A.listings(spark, d)
    stats = P.sketch_stats(P.daily_sketches(rows, "keyword", F.to_date("ts")), "keyword")
    below = lambda c: F.count_if(F.col("price") < F.col(c)) / F.count("*")
    upto = lambda c: F.count_if(F.col("price") <= F.col(c)) / F.count("*")
    near = lambda c, share: ((below(c) <= share + 0.005) & (upto(c) >= share - 0.005)).alias(f"near_{c.removesuffix('_price')}")
    return rows.join(stats, "keyword").groupBy("keyword", "item_count", "min_price", "max_price", F.round("average_price", 2).alias("average_price")).agg(near("q1", 0.25), near("median_price", 0.5), near("q3", 0.75))


@query("SELECT keyword, count(*) AS item_count, count(*) FILTER (outlier_type = 'low') AS low_count, count(*) FILTER (outlier_type = 'high') AS high_count, count(outlier_type) AS outlier_count, round(count(outlier_type) / count(*), 4) AS outlier_rate, round(any_value(lower_bound), 2) AS lower_bound, round(any_value(upper_bound), 2) AS upper_bound FROM flagged JOIN (SELECT keyword, upper_bound AS _u FROM bounds) USING (keyword) WHERE price > 0 GROUP BY keyword", STATS)
def outlier_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.outlier_summary(A.listings(spark, d)).select("keyword", "item_count", "low_count", "high_count", "outlier_count", F.round("outlier_rate", 4).alias("outlier_rate"), *two("lower_bound", "upper_bound"))


@query("SELECT count(*) AS item_count, count(DISTINCT keyword) AS keyword_count, count(*) FILTER (outlier_type = 'low') AS low_count, count(*) FILTER (outlier_type = 'high') AS high_count, round(count(outlier_type) / count(*), 4) AS outlier_rate FROM flagged WHERE price > 0", STATS)
def outlier_overview(spark: SparkSession, d: str) -> DataFrame:
    return P.outlier_overview(A.listings(spark, d)).withColumn("outlier_rate", F.round("outlier_rate", 4))


@query(
    """SELECT keyword, original_count, coalesce(clean_count, 0) AS clean_count, original_count - coalesce(clean_count, 0) AS removed_count, round((original_count - coalesce(clean_count, 0)) / original_count, 4) AS removed_rate, clean_min, clean_median, clean_max, clean_mean
    FROM (SELECT keyword, count(*) AS original_count FROM listings GROUP BY keyword) LEFT JOIN (SELECT keyword, count(*) AS clean_count, min(price) AS clean_min, round(quantile_cont(price, 0.5), 2) AS clean_median, max(price) AS clean_max, round(avg(price), 2) AS clean_mean FROM clean GROUP BY keyword) USING (keyword)""",
    STATS,
)
def clean_price_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.clean_summary(A.listings(spark, d)).withColumns({"removed_rate": F.round("removed_rate", 4), "clean_median": F.round("clean_median", 2), "clean_mean": F.round("clean_mean", 2)})


@query("SELECT keyword, price_rank, platform, pid, price FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY price, platform, pid) AS price_rank FROM listings) WHERE price_rank <= 30")
def low_price_top30(spark: SparkSession, d: str) -> DataFrame:
    return P.cheapest(A.listings(spark, d)).select("keyword", "price_rank", "platform", "pid", "price")


@query("SELECT keyword, platform, pid, price, round(CASE outlier_type WHEN 'low' THEN lower_bound - price ELSE price - upper_bound END, 2) AS gap, round(CASE outlier_type WHEN 'low' THEN median_price / price ELSE price / median_price END, 3) AS severity FROM flagged WHERE outlier_type IS NOT NULL", STATS)
def outlier_review(spark: SparkSession, d: str) -> DataFrame:
    return P.outlier_review(A.listings(spark, d)).select("keyword", "platform", "pid", "price", *two("gap"), F.round("severity", 3).alias("severity"))


@query("SELECT keyword, count(*) AS item_count, count(*) FILTER (contains(lower(name), 'gear') OR contains(lower(name), 'bolt')) AS dropped_count, round(count(*) FILTER (contains(lower(name), 'gear') OR contains(lower(name), 'bolt')) / count(*), 4) AS drop_rate FROM listings GROUP BY keyword")
def blacklist_overview(spark: SparkSession, d: str) -> DataFrame:
    return P.blacklist_overview(A.listings(spark, d), ("gear", "bolt")).withColumn("drop_rate", F.round("drop_rate", 4))


@query("SELECT keyword, pid, platform, lowest_price FROM (SELECT *, min(price) OVER (PARTITION BY keyword) AS lowest_price FROM listings)")
def lowest_by_keyword(spark: SparkSession, d: str) -> DataFrame:
    return P.min_prices(A.listings(spark, d), "keyword").select("keyword", "pid", "platform", "lowest_price")


@query(
    """SELECT keyword, pid, platform, drop_reason FROM (SELECT *, CASE WHEN keyword IS NULL OR name IS NULL OR price IS NULL THEN '필수값 누락' WHEN price <= 0 THEN '유효하지 않은 가격' WHEN contains(lower(name), 'red') THEN '상품명 블랙리스트' END AS drop_reason FROM listings)"""
)
def validated(spark: SparkSession, d: str) -> DataFrame:
    return P.validate(A.listings(spark, d), ("red",)).select("keyword", "pid", "platform", "drop_reason")


# --- dedupe, merge, load


@query(
    """SELECT platform, pid, canonical_name, matched_keywords, keyword, price FROM (
    SELECT platform, pid, arg_max(keyword, (len(regexp_extract_all(keyword, '[a-z]+[0-9]+|[a-z]+|[0-9]+')), length(keyword), -seq)) AS canonical_name, arg_max(keyword, (length(keyword), -seq)) AS keyword, arg_max(price, (length(keyword), -seq)) AS price FROM s GROUP BY ALL)
    JOIN (SELECT platform, pid, string_agg(keyword, ', ' ORDER BY seq) AS matched_keywords FROM (SELECT platform, pid, keyword, min(seq) AS seq FROM s GROUP BY ALL) GROUP BY ALL) USING (platform, pid)""",
    "s AS (SELECT *, epoch(ts) * 1000000 + hash_no AS seq FROM (SELECT *, item_id * 10 + length(keyword) AS hash_no FROM listings))",
)
def dedupe_listings(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d).withColumn("seq", F.col("ts").cast("double") * 1000000 + F.col("item_id") * 10 + F.length("keyword"))
    keywords = A.tables(spark, d, "part")[0].select(F.lower("p_type").alias("keyword"))
    return C.merged_keywords(rows.select("seq", "platform", "pid", "keyword", "price"), keywords).select("platform", "pid", "canonical_name", "matched_keywords", "keyword", "price")


@query("SELECT platform, pid, arg_max(price, (b, ts, price)) AS price, strftime(arg_max(ts, (b, ts, price)), '%Y-%m-%d') AS day FROM (SELECT *, CASE WHEN status = '판매중' THEN 1 ELSE 0 END AS b FROM listings) GROUP BY platform, pid")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d).select("platform", "pid", "price", "ts", "status")
    old, new = (rows.where(F.col("status") == V.ON_SALE) if k else rows.where(F.col("status") != V.ON_SALE) for k in (0, 1))
    return S.upsert(old, new, ["platform", "pid"], ["ts", "price"]).select("platform", "pid", "price", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT item_id, strftime(recorded_at, '%Y-%m-%d') AS recorded_at, price FROM history")
def price_history_daily(spark: SparkSession, d: str) -> DataFrame:
    return A.history(A.listings(spark, d)).select("item_id", F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded_at"), "price")


# --- ratings, flags, documents


@query(
    """SELECT item_id, price_score, recency_score, cluster_score, round(greatest(0, least(100, 0.4 * cluster_score + 0.3 * price_score + 0.1 * recency_score)), 1) AS rating FROM (
    SELECT item_id, round(CASE WHEN current_price <= 0 THEN 0 WHEN current_price / m <= 1 THEN 100 WHEN current_price / m <= 1.03 THEN 90 WHEN current_price / m <= 1.08 THEN 75 WHEN current_price / m <= 1.15 THEN 55 WHEN current_price / m <= 1.30 THEN 35 ELSE greatest(0, 100 - (current_price / m - 1) * 100) END, 4) AS price_score,
    round(CASE WHEN g <= 1 THEN 100 WHEN g >= 30 THEN 0 ELSE (30 - g) / 29 * 100 END, 4) AS recency_score, CASE WHEN regexp_matches(canonical_name, '(?i)s\\d{1,2}|a\\d{1,2}') THEN 65.0 ELSE 45.0 END AS cluster_score
    FROM (SELECT *, min(current_price) FILTER (current_price > 0) OVER (PARTITION BY canonical_name) AS m, (epoch(TIMESTAMP '1999-01-01 00:00:00') - epoch(crawled_at)) / 86400 AS g FROM items))"""
)
def item_rating(spark: SparkSession, d: str) -> DataFrame:
    rows = A.items(spark, d).select("item_id", F.col("canonical_name").alias("cluster_product_name"), F.lit(None).cast("string").alias("cluster_route"), F.col("current_price").alias("price"), F.lit(0).alias("view_count"), F.col("crawled_at").alias("seen_at"))
    rated = P.rate(rows, as_of())
    total = V.rating(F.col("cluster_score"), F.round("price_score", 4), F.col("view_score"), F.round("recency_score", 4))
    return rated.select("item_id", F.round("price_score", 4).alias("price_score"), F.round("recency_score", 4).alias("recency_score"), "cluster_score", F.round(total, 1).alias("rating"))


@query(
    """SELECT item_id, concat_ws(',', CASE WHEN contains(c, 'case') OR contains(c, 'magsafe') THEN 'accessory_candidate' END, CASE WHEN current_price < 1000 OR current_price >= 20000000 THEN 'invalid_price' END) AS flags
    FROM (SELECT *, replace(lower(title), ' ', '') AS c FROM items)"""
)
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", F.array_join(V.quality_flags(F.col("title"), F.col("current_price")), ",").alias("flags"))


@query(
    """SELECT document_id, platform_name AS platform, original_id AS pid, platform_name || ':' || original_id AS item_key, title, normalized_title, canonical_name, category_name, array_to_string(keywords, '|') AS keywords, current_price, status, search_text,
    strftime(crawled_at, '%Y-%m-%d') AS crawled_on, contains(quality_flags, 'accessory') AS is_accessory_candidate, quality_flags FROM docs""",
    DOCS,
)
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.index(_priced(spark, d)).select("document_id", "platform", "pid", "item_key", "title", "normalized_title", "canonical_name", "category_name", F.array_join("matched_keywords", "|").alias("keywords"), "current_price", "status", "search_text", "crawled_on", "is_accessory_candidate", "quality_flags")


# --- search


SEARCH = "found AS (SELECT * FROM listings WHERE contains(replace(lower(concat_ws(' ', name, canonical_name, keyword)), ' ', ''), 'anvil') AND platform IN ('ASIA', 'EUROPE'))"


def _loaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records of all items, loaded into a store that knows half of them under ids of its own, with columns that records don't bring, and their history."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    items = A.items(spark, d).where("platform_name <> ''")
    known = items.where("item_id % 2 = 0").withColumn("item_id", F.col("item_id") * 10 + 7)
    kept = spark.createDataFrame([], pipelines.ITEMS)
    old = known.withColumns({"current_price": F.lit(1).cast("long"), "matched_keywords": F.concat(F.lit("k"), F.col("item_id")), "crawled_at": F.lit("1990-01-01").cast("timestamp")})
    old = kept.unionByName(old.select(*(c for c in old.columns if c in kept.columns)), allowMissingColumns=True)
    versions.publish(spark, path, {"items": old, "history": old.select("item_id", F.to_date("crawled_at").alias("recorded_at"), F.col("current_price").alias("price"))})
    records = items.select("platform_name", "original_id", "title", "canonical_name", "current_price", "crawled_at", "status", F.lit(None).cast("string").alias("cluster_route"))
    pipelines.store(spark, path, records, as_of())
    return pipelines.store(spark, path, records, as_of())  # loading again changes nothing


LOADED = """
loaded AS (SELECT coalesce(old_id, top + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY platform_name, original_id)) AS item_id, platform_name, original_id, current_price, old_keywords AS matched_keywords, crawled_at FROM (
  SELECT *, CASE WHEN item_id % 2 = 0 THEN item_id * 10 + 7 END AS old_id, CASE WHEN item_id % 2 = 0 THEN 'k' || (item_id * 10 + 7) END AS old_keywords FROM items WHERE platform_name <> ''), (SELECT max(item_id * 10 + 7) AS top FROM items WHERE platform_name <> '' AND item_id % 2 = 0))"""


@query("SELECT item_id, platform_name, original_id, current_price, matched_keywords, strftime(crawled_at, '%Y-%m-%d') AS crawled FROM loaded", LOADED)
def loaded_items(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d)[0].select("item_id", "platform_name", "original_id", "current_price", "matched_keywords", F.date_format("crawled_at", "yyyy-MM-dd").alias("crawled"))


@query("SELECT item_id, CAST(crawled_at AS DATE) AS recorded_at, current_price AS price FROM loaded UNION ALL SELECT item_id, DATE '1990-01-01', 1 FROM loaded WHERE matched_keywords IS NOT NULL", LOADED)
def loaded_history(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d)[1]


@query("SELECT platform, pid, price FROM found ORDER BY price, platform, pid LIMIT 20 OFFSET 20", SEARCH)
def search_low_price(spark: SparkSession, d: str) -> DataFrame:
    return I.search(A.listings(spark, d), "anvil", ("ASIA", "EUROPE"), "low_price", 2).select("platform", "pid", "price")


@query("SELECT platform, pid, price FROM found ORDER BY ts DESC, platform, pid LIMIT 20", SEARCH)
def search_recent(spark: SparkSession, d: str) -> DataFrame:
    return I.search(A.listings(spark, d), "anvil", ("ASIA", "EUROPE"), "recent").select("platform", "pid", "price")


@query(
    """SELECT platform, pid, round(8 * (CAST(contains(t, '1') AS INT) + CAST(contains(t, 'anvil') AS INT)) / 2 + CASE WHEN contains(t, '1anvil') THEN 0.35 ELSE 0 END + 2 * greatest(0, 1 - abs(price - m) / greatest(m, 1)), 4) AS relevance FROM (
    SELECT *, replace(lower(concat_ws(' ', name, canonical_name, keyword)), ' ', '') AS t, avg(price) OVER () AS m FROM listings)"""
)
def search_relevance(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d).withColumn("text", I.search_text("name", "canonical_name", "keyword"))
    return I.relevance(rows, "1 Anvil", shuffle=False).select("platform", "pid", F.round("relevance", 4).alias("relevance"))


@query(
    """SELECT least_of AS lowest, mean_of AS average, (SELECT strftime(max(ts), '%Y-%m-%d') FROM listings) AS latest FROM (
    SELECT coalesce(min(price) FILTER (price >= bound), min(price), 0) AS least_of, CAST(round(coalesce(avg(price) FILTER (price >= bound), avg(price), 0)) AS BIGINT) AS mean_of FROM used, bounds_of)""",
    """plausible AS (SELECT price FROM listings WHERE price >= 1000 AND price < 20000000),
    used AS (SELECT price FROM plausible UNION ALL SELECT price FROM listings WHERE price > 0 AND NOT EXISTS (FROM plausible)),
    bounds_of AS (SELECT CASE WHEN count(*) >= 5 THEN greatest(1000, round_even(0.2 * list_sort(list(price))[count(*) // 2 + 1], 0)) ELSE 0 END AS bound FROM used)""",
)
def search_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.summary(A.listings(spark, d)).withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


@query("SELECT coalesce(min(price), 0) AS lowest, CAST(round(avg(price)) AS BIGINT) AS average FROM listings WHERE price > 0 AND status = '판매중' AND contains(lower(name), 'anvil')")
def simple_search_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.summary(A.listings(spark, d).where((F.col("status") == V.ON_SALE) & F.lower("name").contains("anvil")), floors=False).select("lowest", "average")


@query("SELECT document_id, round(score, 6) AS score FROM ranked", DOCS, fuzzy("anvl", "blue")[1], fuzzy("anvl", "blue")[0])
def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    rows = I.documents(_priced(spark, d))
    return I.field_search(rows, "Anvl blue").select("document_id", F.round("score", 6).alias("score"))


def _indexed(spark: SparkSession, d: str) -> str:
    """A kept index of the documents: a first version holds other texts, prices and platforms for half of them, and some that go again; the second one takes all of that back."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    docs = I.documents(_priced(spark, d))
    other = docs.where("item_id % 2 = 0").withColumns({"title": F.lit("blue anvl anvil"), "current_price": F.lit(5000).cast("long"), "platform": F.lit("x")})
    gone = docs.limit(1).withColumns({"document_id": F.lit("gone"), "title": F.lit("blue anvil anvl")})
    X.update(spark, path, other.unionByName(gone))
    X.update(spark, path, docs, gone.select("document_id"))
    return path


@query("SELECT document_id, round(score, 6) AS score FROM ranked", DOCS, fuzzy("anvl", "blue")[1], fuzzy("anvl", "blue")[0])
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    return X.find(spark, _indexed(spark, d), "Anvl blue")[0].select("document_id", F.round("score", 6).alias("score"))


@query(
    """SELECT count(*) AS total, coalesce(min(current_price) FILTER (current_price >= bound), min(current_price)) AS lowest, CAST(round(coalesce(avg(current_price) FILTER (current_price >= bound), avg(current_price))) AS BIGINT) AS average,
    strftime(coalesce(max(crawled_at) FILTER (current_price >= bound), max(crawled_at)), '%Y-%m-%d') AS latest FROM priced, (SELECT CASE WHEN min(current_price) < greatest(1000, round_even(0.2 * quantile_cont(current_price, 0.5), 0)) THEN greatest(1000, round_even(0.2 * quantile_cont(current_price, 0.5), 0)) ELSE 0 END AS bound FROM priced)""",
    DOCS, fuzzy("anvl")[1], fuzzy("anvl")[0].replace(" ORDER BY score DESC, document_id LIMIT 20", ""), "priced AS (SELECT docs.current_price, docs.crawled_at FROM ranked JOIN docs USING (document_id))",
)
def indexed_totals(spark: SparkSession, d: str) -> DataFrame:
    return X.find(spark, _indexed(spark, d), "Anvl")[1]


@query("SELECT item_id, canonical_name, current_price FROM items WHERE status = '판매중' ORDER BY item_id DESC LIMIT 20")
def newest_on_sale(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).where(F.col("status") == V.ON_SALE).orderBy(F.desc("item_id")).limit(20).select("item_id", "canonical_name", "current_price")


# --- reports


@query(
    """SELECT * FROM (SELECT platform, count(*) AS row_count, count(DISTINCT pid) AS pid_count, count(DISTINCT keyword) AS keyword_count, count(*) FILTER (len(missing) = 0) AS pass_count, count(*) FILTER (len(missing) > 0) AS fail_count, round(count(*) FILTER (len(missing) = 0) / count(*), 4) AS pass_rate,
    count(*) FILTER (contains(name, '[') AND contains(name, ']')) AS bracket_count, round(avg(length(name)), 2) AS mean_title_length, round(avg(price), 2) AS mean_price, quantile_cont(price, 0.5) AS median_price,
    count(*) FILTER (status = '판매중') AS on_sale_count, count(*) FILTER (status = '예약중') AS reserved_count, count(*) FILTER (status = '판매완료') AS sold_count FROM judged GROUP BY platform)
    JOIN (SELECT platform, string_agg(keyword || ':' || n, ', ' ORDER BY n DESC, keyword) AS top_keywords FROM (SELECT platform, keyword, count(*) AS n FROM listings GROUP BY ALL) GROUP BY platform) USING (platform)""",
    ACCURACY,
)
def platform_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.platform_summary(M.accuracy(A.listings(spark, d)), ["platform"])


@query("SELECT platform, string_agg(keyword || ':' || n, ', ' ORDER BY n DESC, keyword) AS top_keywords FROM (SELECT platform, keyword, count(*) AS n FROM listings GROUP BY ALL) GROUP BY platform")
def platform_keywords(spark: SparkSession, d: str) -> DataFrame:
    return R.counter(A.listings(spark, d), ["platform"], "keyword", 15, "top_keywords")


@query("SELECT keyword, platform, count(*) AS row_count, count(*) FILTER (len(missing) = 0) AS pass_count, round(count(*) FILTER (len(missing) = 0) / count(*), 4) AS pass_rate, round(avg(price), 2) AS mean_price FROM judged GROUP BY ALL", ACCURACY)
def keyword_platform_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.platform_summary(M.accuracy(A.listings(spark, d)), ["keyword", "platform"]).select("keyword", "platform", "row_count", "pass_count", "pass_rate", "mean_price")


@query(
    """SELECT platform, token, fail_count, top_keywords, samples FROM (SELECT platform, token, count(*) AS fail_count, array_to_string(list_sort(list_distinct(list(name)))[1:3], ' | ') AS samples FROM (SELECT platform, name, unnest(list_distinct(missing)) AS token FROM judged) GROUP BY ALL)
    JOIN (SELECT platform, string_agg(keyword || ':' || n, ', ' ORDER BY n DESC, keyword) AS top_keywords FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY n DESC, keyword) AS k FROM (SELECT platform, keyword, count(*) AS n FROM judged WHERE len(missing) > 0 GROUP BY ALL)) WHERE k <= 5 GROUP BY platform) USING (platform)""",
    ACCURACY,
)
def missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return R.missing_token_summary(M.accuracy(A.listings(spark, d))).select("platform", "token", "fail_count", "top_keywords", "samples")


@query("UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS total_rows, CAST(count(*) FILTER (len(missing) = 0) AS DOUBLE) AS pass_rows, CAST(count(*) FILTER (len(missing) > 0) AS DOUBLE) AS fail_rows, round(count(*) FILTER (len(missing) = 0) / count(*), 4) AS pass_rate FROM judged) ON COLUMNS(*) INTO NAME metric VALUE value", ACCURACY)
def accuracy_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.accuracy_summary(M.accuracy(A.listings(spark, d)))


ORACLE_SQL["accuracy_summary"] = ORACLE_SQL["accuracy_summary"].replace("UNPIVOT (", "SELECT * FROM (UNPIVOT (").replace("VALUE value", "VALUE value)")


@query(
    """SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0 END AS recall FROM (
    SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn FROM (SELECT len(missing) = 0 AS p, status = '판매중' AS a FROM judged))""",
    ACCURACY,
)
def accuracy_confusion(spark: SparkSession, d: str) -> DataFrame:
    return R.confusion(M.accuracy(A.listings(spark, d)), F.col("is_match"), F.col("status") == V.ON_SALE)


@query("SELECT token, count(*) AS row_count FROM (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: length(w) >= 2))) AS token FROM listings) GROUP BY token")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return R.token_frequency(A.listings(spark, d)).select("token", "row_count")


@query(
    """SELECT token, doc_count, top_keywords, samples, CASE WHEN regexp_full_match(token, '[0-9]{2}e?|s[0-9]{2}(plus|ultra|edge)?') THEN 'product_token_dictionary model 후보' ELSE '검토 필요' END AS use FROM (SELECT token, count(*) AS doc_count, array_to_string(list_sort(list_distinct(list(name)))[1:3], ' | ') AS samples FROM t GROUP BY token HAVING count(*) >= 2)
    JOIN (SELECT token, string_agg(keyword || ':' || n, ', ' ORDER BY n DESC, keyword) AS top_keywords FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, keyword) AS k FROM (SELECT token, keyword, count(*) AS n FROM t GROUP BY ALL)) WHERE k <= 3 GROUP BY token) USING (token)""",
    "t AS (SELECT DISTINCT platform, pid, keyword, name, unnest(list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''))) AS token FROM listings)",
)
def reference_tokens(spark: SparkSession, d: str) -> DataFrame:
    return R.reference_tokens(A.listings(spark, d)).select("token", "doc_count", "top_keywords", "samples", "use")


@query(
    """SELECT field_name, value, match_count, samples FROM (SELECT field_name, value, count(*) AS match_count, array_to_string(list_sort(list_distinct(list(name)))[1:3], ' | ') AS samples FROM (SELECT DISTINCT platform, pid, keyword, name, field_name, value FROM r JOIN dict ON contains(c, alias)) GROUP BY ALL)""",
    """r AS (SELECT DISTINCT platform, pid, keyword, name, replace(regexp_replace(lower(name || ' ' || keyword), '[^a-z0-9]+', ' ', 'g'), ' ', '') AS c FROM listings),
    dict AS (SELECT 'brand' AS field_name, p_brand AS value, lower(regexp_replace(p_brand, '[# ]', '', 'g')) AS alias FROM part UNION SELECT 'category', p_type, lower(p_type) FROM part)""",
)
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    (part,) = A.tables(spark, d, "part")
    rules = part.select(F.lit("brand").alias("field_name"), F.col("p_brand").alias("value")).union(part.select(F.lit("category"), "p_type")).distinct().where("value IS NOT NULL").withColumn("alias", F.col("value"))
    return R.rule_hits(A.listings(spark, d).select("platform", "pid", "keyword", "name"), rules, ["field_name", "value"]).select("field_name", "value", "match_count", "samples")


@query(
    """SELECT pattern, count(*) AS title_count FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(name, '(?i)(\\+|\\bplus\\b)') THEN 'plus_symbol_or_word' END, CASE WHEN contains(name, '/') THEN 'slash_multiple_models' END, CASE WHEN regexp_matches(name, '(?i)[0-9a-z] *- *[0-9a-z]') THEN 'hyphen_model_token' END,
    CASE WHEN regexp_matches(name, '[()\\[\\]{}]') THEN 'parentheses_detail' END, CASE WHEN regexp_matches(name, '[0-9] *"') THEN 'inch_symbol' END, CASE WHEN regexp_matches(name, '(?i)[0-9] *(gb|g|tb)') THEN 'storage_unit' END, CASE WHEN regexp_matches(name, '(?i)\\b(i|ii|iii|iv|v)\\b') THEN 'roman_generation' END,
    CASE WHEN contains(name, '&') THEN 'ampersand_bundle' END, CASE WHEN regexp_matches(name, '[^0-9a-zA-Z\\s]') THEN 'remaining_special_chars' END], lambda x: x IS NOT NULL)) AS pattern FROM listings) GROUP BY pattern"""
)
def sign_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.sign_summary(A.listings(spark, d)).select("pattern", "title_count")


# --- matching


@query(
    """SELECT profile_id, entry_id, shared, round(similarity, 4) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY verified DESC, similarity DESC, shared DESC, entry_id) AS place FROM (
    SELECT p.id AS profile_id, e.id AS entry_id, any_value(e.v) AS verified, count(*) AS shared, least(1.0, count(*) / (any_value(p.n) + any_value(e.n) - count(*)) + CASE WHEN any_value(e.v) THEN 0.05 ELSE 0 END) AS similarity FROM p JOIN e USING (token) GROUP BY p.id, e.id)) WHERE place <= 5""",
    """t AS (SELECT s.item_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(s.title), '[^a-z0-9]+'), lambda w: w <> '')) AS ts, s.category_name FROM items s),
    p AS (SELECT id, len(ts) AS n, unnest(ts) AS token FROM t), e AS (SELECT min(item_id) AS id, item_id IS NULL AS z, canonical_name, any_value(category_name) AS c, bool_or(status = '판매완료') AS v, len(list_distinct(string_split(canonical_name, ' '))) AS n, unnest(list_distinct(string_split(canonical_name, ' '))) AS token FROM items GROUP BY canonical_name, item_id IS NULL)""",
)
def title_match_topk(spark: SparkSession, d: str) -> DataFrame:
    items = A.items(spark, d)
    return M.title_matches(_profiles(items), _entries(items)).select("profile_id", "entry_id", "shared", F.round("similarity", 4).alias("similarity"), "place")


def _profiles(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").alias("profile_id"), T.title_tokens(F.col("title")).alias("tokens"), F.lit("p").alias("platform"))


def _entries(items: DataFrame) -> DataFrame:
    by_name = items.groupBy("canonical_name").agg(F.min("item_id").alias("entry_id"), F.max(F.col("status") == V.SOLD).alias("verified"), F.max_by("category_name", (-F.col("item_id"))).alias("category"))
    return by_name.select("entry_id", T.title_tokens(F.col("canonical_name")).alias("tokens"), F.lit("e").alias("platform"), "verified", F.lit("c").alias("cluster_id"), "category", F.lower("category").alias("keyword"), "canonical_name")


@query(
    """SELECT t.id AS profile_id, coalesce(category, source) AS category, round(score, 4) AS score, coalesce(confidence, 0.55) AS confidence, coalesce(method, 'source_keyword') AS method FROM t LEFT JOIN (
    SELECT id, category, score, round(least(0.99, top + least(0.25, score / 10)), 4) AS confidence, CASE WHEN sure THEN 'joongna_correlation' ELSE 'title_correlation' END AS method FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, first) AS nth FROM (
    SELECT id, category, sum(similarity * similarity + CASE WHEN v THEN 0.1 ELSE 0 END + CASE WHEN category = source THEN 0.25 ELSE 0 END) AS score, max(similarity) FILTER (k <= 3) AS top, bool_or(v) FILTER (k <= 3) AS sure, min(place) AS first FROM (
    SELECT m.*, t.source, row_number() OVER (PARTITION BY m.id, category ORDER BY place) AS k FROM (SELECT *, max(similarity) OVER (PARTITION BY id) AS best FROM m) m JOIN t ON t.id = m.id WHERE similarity >= greatest(0.35, 0.75 * best)) GROUP BY id, category)) WHERE nth = 1) USING (id)""",
    """t AS (SELECT s.item_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(s.title), '[^a-z0-9]+'), lambda w: w <> '')) AS ts, s.category_name AS source FROM items s),
    p AS (SELECT id, len(ts) AS n, unnest(ts) AS token FROM t), e AS (SELECT min(item_id) AS id, arg_min(category_name, item_id) AS c, bool_or(status = '판매완료') AS v, len(list_distinct(string_split(canonical_name, ' '))) AS n, unnest(list_distinct(string_split(canonical_name, ' '))) AS token FROM items GROUP BY canonical_name),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, similarity DESC, shared DESC, entry_id) AS place FROM (
    SELECT p.id, e.id AS entry_id, any_value(e.v) AS v, any_value(e.c) AS category, count(*) AS shared, least(1.0, count(*) / (any_value(p.n) + any_value(e.n) - count(*)) + CASE WHEN any_value(e.v) THEN 0.05 ELSE 0 END) AS similarity FROM p JOIN e USING (token) GROUP BY p.id, e.id)) WHERE place <= 5)""",
)
def category_vote(spark: SparkSession, d: str) -> DataFrame:
    items = A.items(spark, d)
    entries = _entries(items)
    matches = M.title_matches(_profiles(items), entries).join(entries.select("entry_id", "category"), "entry_id")
    votes = M.category_votes(matches, items.select(F.col("item_id").alias("profile_id"), F.col("category_name").alias("source_keyword")))
    return votes.select("profile_id", "category", F.round("score", 4).alias("score"), "confidence", "method")


@query(
    """SELECT title, max(value) FILTER (field_name = 'brand') AS brand, max(value) FILTER (field_name = 'model') AS model FROM (SELECT title, field_name, arg_max(value, (length(alias), -instr(c, alias))) AS value FROM (SELECT DISTINCT name AS title, replace(lower(name), '#', '') AS n, replace(replace(lower(name), '#', ''), ' ', '') AS c FROM listings) JOIN dict ON contains(c, alias) GROUP BY title, field_name) GROUP BY title""",
    "dict AS (SELECT 'brand' AS field_name, p_brand AS value, lower(regexp_replace(p_brand, '[# ]', '', 'g')) AS alias FROM part UNION SELECT 'model', split_part(p_name, ' ', 2), lower(split_part(p_name, ' ', 2)) FROM part)",
)
def dictionary_match(spark: SparkSession, d: str) -> DataFrame:
    (part,) = A.tables(spark, d, "part")
    both = part.select(F.lit("brand").alias("field_name"), F.col("p_brand").alias("v")).union(part.select(F.lit("model"), F.get(F.split("p_name", " "), F.lit(1)))).distinct().where("v IS NOT NULL")
    dictionary = both.select("field_name", F.col("v").alias("canonical_value"), F.col("v").alias("alias"), F.xxhash64("v").alias("row_no"))
    found = M.dictionary_matches(A.listings(spark, d).select(F.col("name").alias("title")), dictionary)
    return found.select("title", F.try_element_at("matched", F.lit("brand")).alias("brand"), F.try_element_at("matched", F.lit("model")).alias("model"))


@query(
    # a row with a keyword has a confidence of 0.55 at least where no title is like it, and 0.35 and more where one is, so only price and tokens decide
    """SELECT platform, keep, count(*) AS n FROM (SELECT platform, platform = 'ASIA' OR (price > 0 AND price BETWEEN (SELECT CAST(floor(0.35 * m) AS BIGINT) FROM med) AND (SELECT CAST(floor(2.5 * m) AS BIGINT) FROM med) AND list_has_any(tokens, (SELECT list(token) FROM core))) AS keep FROM r) GROUP BY ALL""",
    """r AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) AS tokens FROM listings), med AS (SELECT quantile_cont(price, 0.5) AS m FROM r WHERE platform = 'ASIA' AND price > 0),
    core AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM r WHERE platform = 'ASIA') WHERE length(token) >= 2 AND (NOT regexp_full_match(token, '[0-9]+') OR length(token) >= 3) GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 8)""",
)
def cross_platform_verify(spark: SparkSession, d: str) -> DataFrame:
    return M.verify_across(A.listings(spark, d), "ASIA").groupBy("platform", "keep").agg(F.count("*").alias("n"))


@query(
    "SELECT id AS message_id, arg_max(item_id, (length(p), -item_id)) AS faq_id FROM (SELECT conv_id || '-' || turn AS id, regexp_replace(lower(text), '[\\s?.,!~]+', '', 'g') AS m FROM conversations) JOIN (SELECT item_id, regexp_replace(lower(text), '[\\s?.,!~]+', '', 'g') AS p FROM benchmark) ON m <> '' AND p <> '' AND (contains(m, p) OR contains(p, m)) GROUP BY id"
)
def faq_best_match(spark: SparkSession, d: str) -> DataFrame:
    bench, talks = A.tables(spark, d, "benchmark", "conversations")
    faq = bench.select(F.col("item_id").alias("faq_id"), F.col("text").alias("pattern"))
    return M.faq_matches(talks.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("text").alias("message")), faq)


@query(
    """SELECT id AS message_id, CASE WHEN gaming OR (known IS NULL AND keyword <> '') THEN 'PRODUCT_RECOMMEND' ELSE coalesce(known, 'UNKNOWN') END AS intent, keyword,
    CASE WHEN gaming OR keyword = '컴퓨터' OR regexp_matches(s, 'computer|desktop|pc') THEN 'desktop' WHEN regexp_matches(s, 'laptop|macbook') THEN 'laptop' WHEN regexp_matches(s, 'iphone|galaxy') THEN 'smartphone' WHEN regexp_matches(s, 'switch|ps5|ps4|xbox') THEN 'game_console' END AS product_type,
    CASE WHEN gaming THEN 'gaming' END AS use_case, game, CASE WHEN gaming THEN coalesce(level, 'MID') ELSE level END AS level FROM (
    SELECT *, CASE WHEN regexp_matches(s, 'hello|hi') THEN 'GREETING' WHEN contains(s, 'count') THEN 'ITEM_COUNT' WHEN regexp_matches(s, 'personal|custom') THEN 'PERSONAL_RECOMMEND' WHEN regexp_matches(s, 'compare|price') THEN 'PRICE_COMPARE' WHEN contains(s, 'alert') THEN 'PRICE_ALERT_GUIDE' WHEN contains(s, 'search') THEN 'SEARCH_HELP' WHEN regexp_matches(s, 'recommend|find') THEN 'PRODUCT_RECOMMEND' END AS known,
    CASE WHEN gaming OR contains(s, 'pc') THEN '컴퓨터' WHEN contains(s, 'ps5') THEN 'PS5' WHEN contains(s, 'ps4') THEN 'PS4' ELSE trim(regexp_replace(regexp_replace(trim(coalesce(text, '')), '(?i)recommend|find|compare|price|please', '', 'g'), '\\s+', ' ', 'g')) END AS keyword,
    CASE WHEN regexp_matches(g, 'leagueoflegends|lol') THEN '롤' WHEN contains(g, 'valorant') THEN '발로란트' WHEN contains(g, 'pubg') THEN '배그' WHEN contains(g, 'apex') THEN '에이펙스 레전드' WHEN contains(g, 'overwatch') THEN '오버워치2' WHEN contains(g, 'lostark') THEN '로스트아크' WHEN contains(g, 'eldenring') THEN '엘든링' WHEN contains(g, 'cyberpunk') THEN '사이버펑크' WHEN contains(g, 'gta') THEN 'GTA5'
    WHEN contains(g, 'diablo') THEN '디아블로4' WHEN contains(g, 'reddead') THEN '레드 데드 리뎀션2' WHEN regexp_matches(g, 'blackmyth|wukong') THEN '검은 신화: 오공' WHEN contains(g, 'rust') THEN '러스트' WHEN contains(g, 'maplestory') THEN '메이플스토리' WHEN regexp_matches(g, 'fconline|fifa') THEN 'FC온라인' WHEN contains(g, 'starcraft') THEN '스타크래프트' END AS game,
    CASE WHEN contains(g, '4k') THEN 'EXTREME' WHEN regexp_matches(g, 'qhd|144hz|gta|aaa') THEN 'HIGH' WHEN regexp_matches(g, 'pubg|apex|rust') THEN 'MID' WHEN contains(g, 'lol') THEN 'LOW' END AS level FROM (
    SELECT *, regexp_matches(s, 'game|gaming|lol|pubg|cyberpunk') AND regexp_matches(s, 'computer|desktop|pc') AS gaming, regexp_replace(s, '[_/-]', '', 'g') AS g FROM (SELECT conv_id || '-' || turn AS id, text, regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g') AS s FROM conversations)))"""
)
def message_tags(spark: SparkSession, d: str) -> DataFrame:
    (talks,) = A.tables(spark, d, "conversations")
    tags = messages.message_tags(talks.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("text").alias("message")))
    return tags.select("message_id", "intent", "keyword", "product_type", "use_case", "game", "level")


# --- series, advice, recommendation


@query("SELECT * FROM daily", HISTORY)
def cluster_trend(spark: SparkSession, d: str) -> DataFrame:
    named = A.items(spark, d).select("item_id", "canonical_name")
    return I.daily_points(A.history(A.listings(spark, d)).join(named, "item_id"), ["canonical_name"])


@query("SELECT canonical_name, day, price FROM (SELECT *, max(CAST(day AS DATE)) OVER (PARTITION BY canonical_name) AS last FROM daily) WHERE CAST(day AS DATE) >= last - 29", HISTORY)
def series_window(spark: SparkSession, d: str) -> DataFrame:
    return I.window_points(cluster_trend(spark, d), 30, "canonical_name")


@query("SELECT canonical_name, min(price) AS min_price, max(price) AS max_price, CAST(round(avg(price)) AS BIGINT) AS mean_price, arg_min(day, (price, day)) AS min_day, arg_min(day, (-price, day)) AS max_day, arg_max(price, day) AS latest_price FROM daily GROUP BY canonical_name", HISTORY)
def series_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.series_summary(cluster_trend(spark, d), "canonical_name")


@query(
    """SELECT canonical_name, least(min(d.price), any_value(low)) AS min_price, greatest(max(d.price), any_value(high)) AS max_price, CAST(round(avg(d.price)) AS BIGINT) AS mean_price, arg_min(day, (d.price, day)) AS min_day, arg_max(d.price, day) AS latest_price
    FROM daily d LEFT JOIN (SELECT canonical_name, min(current_price * 3) AS low, max(current_price * 3) AS high FROM items WHERE item_id % 7 = 0 GROUP BY ALL) USING (canonical_name) GROUP BY canonical_name""",
    HISTORY,
)
def chart_summary(spark: SparkSession, d: str) -> DataFrame:
    chosen = A.items(spark, d).where("item_id % 7 = 0").select("canonical_name", (F.col("current_price") * 3).alias("price"))
    return I.series_summary(cluster_trend(spark, d), "canonical_name", chosen).select("canonical_name", "min_price", "max_price", "mean_price", "min_day", "latest_price")


@query(
    "SELECT i.item_id AS product_id, arg_min(idx, (abs(month(i.crawled_at) * 31 + day(i.crawled_at) - month(CAST(p.day AS DATE)) * 31 - day(CAST(p.day AS DATE))), idx)) AS idx FROM items i JOIN (SELECT *, row_number() OVER (PARTITION BY canonical_name ORDER BY day) AS idx FROM daily) p USING (canonical_name) GROUP BY i.item_id",
    HISTORY,
)
def nearest_point(spark: SparkSession, d: str) -> DataFrame:
    points = cluster_trend(spark, d).withColumn("idx", F.row_number().over(Window.partitionBy("canonical_name").orderBy("day"))).select(F.col("canonical_name").alias("series_id"), "idx", F.to_date("day").alias("day"))
    return I.nearest_point(A.items(spark, d).select(F.col("item_id").alias("product_id"), F.col("canonical_name").alias("series_id"), F.to_date("crawled_at").alias("day")), points)


@query("SELECT item_id, list_min(list(price)) AS lowest, count(*) AS days, string_agg(strftime(recorded_at, '%Y-%m-%d') || ':' || price, ',' ORDER BY recorded_at) AS points FROM history GROUP BY item_id")
def nested_history(spark: SparkSession, d: str) -> DataFrame:
    points = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["recorded_at"].cast("string"), p["price"])), ",")
    return I.series(A.history(A.listings(spark, d))).select("item_id", I.lowest_of(F.col("points"), F.lit(None).cast("long")).alias("lowest"), F.size("points").cast("long").alias("days"), points.alias("points"))


@query(
    """SELECT item_id, lc AS listing_count, round(ls / nullif(lc, 0), 2) AS listing_mean, sc AS sold_count, round(ss / nullif(sc, 0), 2) AS sold_mean,
    CASE WHEN lc < 3 THEN 'insufficient' WHEN current_price < coalesce(ss / nullif(sc, 0), ls / nullif(lc, 0)) THEN 'cheaper' WHEN current_price > coalesce(ss / nullif(sc, 0), ls / nullif(lc, 0)) THEN 'dearer' ELSE 'equal' END AS verdict FROM (
    SELECT a.item_id, a.current_price, count(b.item_id) FILTER (b.status = '판매중') AS lc, sum(b.current_price) FILTER (b.status = '판매중') AS ls, count(b.item_id) FILTER (b.status = '판매완료') AS sc, sum(b.current_price) FILTER (b.status = '판매완료') AS ss
    FROM items a LEFT JOIN items b ON (lower(a.canonical_name) = lower(b.canonical_name) OR lower(a.category_name) = lower(b.category_name)) AND a.item_id <> b.item_id AND b.current_price > 0 GROUP BY ALL)"""
)
def price_advice_all(spark: SparkSession, d: str) -> DataFrame:
    return I.price_advice(A.items(spark, d))


@query("SELECT w.user_id, w.item_id, current_price, target_price FROM wishlists w JOIN items USING (item_id) WHERE current_price <= target_price OR (is_lowest_alert = 'Y' AND current_price <= lowest_price)")
def reached_alerts(spark: SparkSession, d: str) -> DataFrame:
    return I.reached_alerts(A.wishlists(spark, d), A.items(spark, d)).select("user_id", "item_id", "current_price", "target_price")


@query("SELECT user_id, item_id, place FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, item_id) AS place FROM actions WHERE event_type = 'IMPRESSION' GROUP BY user_id, item_id) WHERE place <= 20")
def recent_views20(spark: SparkSession, d: str) -> DataFrame:
    return I.latest_distinct(A.actions(spark, d).where("event_type = 'IMPRESSION'"), "item_id", 20).select("user_id", "item_id", "place")


@query("SELECT user_id, keyword, place FROM (SELECT user_id, keyword, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, keyword) AS place FROM actions WHERE event_type = 'SEARCH' AND keyword IS NOT NULL GROUP BY user_id, keyword) WHERE place <= 8")
def recent_distinct(spark: SparkSession, d: str) -> DataFrame:
    return I.latest_distinct(A.actions(spark, d).where("event_type = 'SEARCH'"), "keyword", 8).select("user_id", "keyword", "place")


@query("SELECT user_id, item_id FROM actions GROUP BY ALL HAVING count(*) % 2 = 1")
def toggled_items(spark: SparkSession, d: str) -> DataFrame:
    return I.toggled(A.actions(spark, d))


@query("SELECT c_custkey AS user_id, coalesce(n, 0) AS wishlist_count FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM wishlists GROUP BY ALL) ON user_id = c_custkey")
def wishlist_counts(spark: SparkSession, d: str) -> DataFrame:
    (users,) = A.tables(spark, d, "customer")
    return I.user_counts(users.select(F.col("c_custkey").alias("user_id")), A.wishlists(spark, d))


POINTS = """CASE WHEN lowest_price > 0 AND current_price <= lowest_price THEN 30 WHEN lowest_price > 0 AND current_price <= floor(lowest_price * 1.05 + 0.5) THEN 20 WHEN lowest_price > 0 AND current_price <= floor(lowest_price * 1.10 + 0.5) THEN 10 ELSE 0 END
    + CASE WHEN crawled_at > TIMESTAMP '1998-12-31 00:00:00' THEN 15 WHEN crawled_at > TIMESTAMP '1998-12-29 00:00:00' THEN 10 WHEN crawled_at > TIMESTAMP '1998-12-25 00:00:00' THEN 5 ELSE 0 END"""


@query(
    f"""SELECT item_id, score, CASE WHEN lowest_price > 0 AND current_price <= floor(lowest_price * 1.05 + 0.5) THEN '현재가가 기록된 최저가 수준이라 가격 메리트가 큰 상품입니다.' WHEN score >= 100 THEN '검색어와 상품명, 카테고리 조건이 잘 맞는 상품입니다.' ELSE '검색 조건과 연관성이 있는 상품입니다.' END AS reason FROM (
    SELECT *, CAST(CASE WHEN lower(canonical_name) = 'anvil' THEN 120 WHEN contains(lower(canonical_name), 'anvil') THEN 100 ELSE 0 END + CASE WHEN lower(title) = 'anvil' THEN 90 WHEN contains(lower(title), 'anvil') THEN 70 ELSE 0 END + CASE WHEN contains(lower(category_name), 'anvil') THEN 35 ELSE 0 END + {POINTS} AS INT) AS score FROM (
    SELECT * FROM items WHERE status = '판매중' AND current_price > 0 AND (contains(lower(title), 'anvil') OR contains(lower(category_name), 'anvil')) ORDER BY item_id LIMIT 150)) WHERE score > 0 ORDER BY score DESC, current_price, item_id LIMIT 10"""
)
def recommend_scored(spark: SparkSession, d: str) -> DataFrame:
    return I.recommend(A.items(spark, d), "anvil", as_of()).select("item_id", "score", "reason")


@query(
    f"""SELECT user_id, item_id, current_price, score, reason, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN coalesce(current_price, 0) <= 0 THEN 1 ELSE 0 END, current_price, score DESC, item_id) AS place FROM (
    SELECT u.user_id, pool.item_id, current_price, CAST(base + CASE WHEN w.item_id IS NULL THEN 0 ELSE 30 END + CASE WHEN v.item_id IS NULL THEN 0 ELSE 15 END AS INT) AS score,
    CASE WHEN lowest_price > 0 AND current_price <= floor(lowest_price * 1.05 + 0.5) THEN '현재가가 기록된 최저가 수준이라 가격 메리트가 큰 상품입니다.' ELSE '검색 조건과 연관성이 있는 상품입니다.' END || CASE WHEN w.item_id IS NULL THEN '' ELSE ' 찜 목록에 있는 상품이라 우선 추천했습니다.' END || CASE WHEN v.item_id IS NULL THEN '' ELSE ' 최근 본 상품과도 연결되는 후보입니다.' END AS reason
    FROM (SELECT user_id FROM wishlists UNION SELECT user_id FROM seen) u CROSS JOIN pool LEFT JOIN wishlists w ON w.user_id = u.user_id AND w.item_id = pool.item_id LEFT JOIN seen v ON v.user_id = u.user_id AND v.item_id = pool.item_id)""",
    f"""pool AS (SELECT * FROM (SELECT *, {POINTS} AS base FROM (SELECT * FROM items WHERE status = '판매중' ORDER BY item_id DESC LIMIT 30)) ORDER BY base DESC, item_id DESC LIMIT 10),
    seen AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, item_id) AS place FROM actions WHERE event_type = 'IMPRESSION' AND item_id IS NOT NULL GROUP BY user_id, item_id) WHERE place <= 20)""",
)
def recommend_personal(spark: SparkSession, d: str) -> DataFrame:
    return I.recommend_personal(A.items(spark, d), A.wishlists(spark, d), A.actions(spark, d).where("event_type = 'IMPRESSION'"), as_of())


@query("SELECT user_id, item_id, current_price, place, current_price - min(current_price) OVER (PARTITION BY user_id) AS gap, max(current_price) OVER (PARTITION BY user_id) - min(current_price) OVER (PARTITION BY user_id) AS spread FROM (SELECT user_id, item_id, current_price, row_number() OVER (PARTITION BY user_id ORDER BY current_price, item_id) AS place FROM wishlists JOIN items USING (item_id) WHERE current_price > 0) WHERE place <= 5")
def personal_comparison(spark: SparkSession, d: str) -> DataFrame:
    return I.personal_comparison(A.wishlists(spark, d).join(A.items(spark, d).select("item_id", "current_price"), "item_id")).select("user_id", "item_id", "current_price", "place", "gap", "spread")


@query("SELECT w.user_id, w.item_id FROM wishlists w WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = w.user_id AND a.item_id = w.item_id)")
def wishes_not_seen(spark: SparkSession, d: str) -> DataFrame:
    return I.not_stored(A.wishlists(spark, d).select("user_id", "item_id"), A.actions(spark, d).select("user_id", "item_id"), ("user_id", "item_id"))


@query("SELECT item_id, CASE WHEN platform_name <> '' THEN platform_name WHEN item_id % 7 < 5 THEN (SELECT r_name FROM region WHERE r_regionkey = item_id % 7) ELSE 'unknown' END AS platform_name FROM items")
def filled_platforms(spark: SparkSession, d: str) -> DataFrame:
    names = A.tables(spark, d, "region")[0].select(F.col("r_regionkey").cast("long").alias("platform_id"), F.col("r_name").alias("name"))
    return M.fill_platform(A.items(spark, d).withColumn("platform_id", F.col("item_id") % 7), names).select("item_id", "platform_name")


@query("SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(canonical_name), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND w <> 'anvil'))) AS token FROM listings) GROUP BY token ORDER BY n DESC, token LIMIT 8")
def core_title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return M.core_tokens(A.listings(spark, d).select(F.col("canonical_name").alias("title")), (" Anvil",))


@query("SELECT platform, pid, price, CASE WHEN price % 2 = 0 THEN max(upper(keyword)) OVER (PARTITION BY platform, pid, price) ELSE keyword END AS keyword FROM listings")
def written_back(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d).select("platform", "pid", "price", "keyword")
    return M.write_back(rows, rows.where("price % 2 = 0").withColumn("keyword", F.upper("keyword")), ["keyword"])


@query("SELECT canonical_name, item_id, row_number() OVER (PARTITION BY canonical_name ORDER BY current_price DESC, item_id) AS price_place FROM items")
def price_places(spark: SparkSession, d: str) -> DataFrame:
    rows = A.items(spark, d).select("canonical_name", "item_id", F.col("current_price").alias("price"), F.col("item_id").alias("place"))
    return I.price_places(rows, "canonical_name").select("canonical_name", "item_id", "price_place")


# --- statistics by day, rankings, anomalies


@query("SELECT canonical_name, platform AS platform_name, strftime(ts, '%Y-%m-%d') AS stat_date, count(*) AS item_count, min(price) AS min_price, round(avg(price), 2) AS avg_price, max(price) AS max_price FROM (SELECT *, CAST(ts AS DATE) AS day FROM listings) GROUP BY GROUPING SETS ((canonical_name, platform, strftime(ts, '%Y-%m-%d')), (canonical_name, strftime(ts, '%Y-%m-%d')))")
def price_stats_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return I.price_stats_daily(A.listings(spark, d)).withColumn("stat_date", F.date_format("stat_date", "yyyy-MM-dd"))


WEEKS = "w AS (SELECT keyword, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, count(*) FILTER (event_type = 'SEARCH') AS search_count, count(*) FILTER (event_type = 'IMPRESSION') AS impression_count, count(*) FILTER (event_type = 'CLICK') AS click_count FROM actions WHERE keyword IS NOT NULL GROUP BY ALL)"


@query("SELECT keyword, week, search_count, click_count, row_number() OVER (PARTITION BY week ORDER BY search_count DESC, keyword) AS place, CASE WHEN b IS NULL THEN 'NEW' WHEN search_count > b THEN 'UP' WHEN search_count < b THEN 'DOWN' ELSE 'SAME' END AS trend FROM (SELECT *, lag(search_count) OVER (PARTITION BY keyword ORDER BY week) AS b FROM w)", WEEKS)
def search_ranking_trend(spark: SparkSession, d: str) -> DataFrame:
    return I.search_ranking(A.actions(spark, d)).select("keyword", F.floor(F.datediff("period_start", F.lit("1970-01-01")) / 7).cast("long").alias("week"), "search_count", "click_count", "place", "trend")


CLUSTERED = "named AS (SELECT *, CASE item_id % 4 WHEN 0 THEN 0.45 WHEN 1 THEN 0.65 WHEN 2 THEN NULL ELSE 1.0 END AS confidence FROM items)"


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id") % 4
    return A.items(spark, d).withColumn("cluster_product_name", F.col("canonical_name")).withColumn("cluster_confidence", F.when(k == 0, 0.45).when(k == 1, 0.65).when(k == 3, 1.0))


@query("SELECT item_id, current_price FROM named WHERE confidence < 0.5 ORDER BY current_price DESC NULLS LAST, item_id LIMIT 20 OFFSET 20", CLUSTERED)
def anomaly_page(spark: SparkSession, d: str) -> DataFrame:
    return I.anomalies(_clustered(spark, d), "confidence", "price_desc", 2).select("item_id", "current_price")


@query("SELECT count(*) FILTER (confidence < 0.5) AS low_confidence, count(*) FILTER (contains(lower(title), 'case') OR contains(lower(title), 'magsafe')) AS accessory_title FROM named", CLUSTERED)
def anomaly_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.anomaly_counts(_clustered(spark, d))


# --- clusters


@query()
def token_stage_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = A.items(spark, d).select(F.col("item_id").alias("row_id"), F.lower("category_name").alias("keyword"), "title")
    # titles are cleaned, cut into tokens and staged once for each distinct keyword and title
    titles = rows.groupBy(F.col("keyword").alias("_k"), F.col("title").alias("_title")).agg(F.count("*").alias("n"))
    texts = reliable(titles.select(F.col("_k").alias("keyword"), "_title", "n", T.cluster_text(F.col("_title")).alias("cluster_text")))
    made = few(C.token_stages(reliable(C.tokenised(texts, C.vocabulary(texts, n="n"))), n="n").withColumnRenamed("keyword", "_k").drop("n", "tokens"))
    staged = rows.join(made, F.col("keyword").eqNullSafe(F.col("_k")) & F.col("title").eqNullSafe(F.col("_title")), "left")
    return staged.select("row_id", "keyword", "cluster_text", *(c for c in (f"c{k}" for k in range(1, C.STAGE_COLUMNS + 1)) if c in staged.columns))


@query()
def name_clusters(spark: SparkSession, d: str) -> DataFrame:
    texts = A.items(spark, d).select(F.lower("category_name").alias("keyword"), T.cluster_text(F.col("canonical_name")).alias("text")).distinct()
    return C.linked_clusters(texts, ["keyword"], 2, 5, 0.58, C.MOST_NGRAMS)


@query(
    # no two different texts of a keyword reach the cosine, so groups are of equal texts
    """SELECT keyword, root, count(*) AS item_count, 1.0 AS min_similarity, 1.0 AS avg_similarity, 1.0 AS max_similarity, min(price) AS min_price, any_value(m) AS median_price, max(price) AS max_price, arg_min(name, (abs(price - m), price, name)) AS representative, any_value(name) AS sample_names FROM (
    SELECT lower(category_name) AS keyword, lower(title) AS root, title AS name, current_price AS price, quantile_cont(current_price, 0.5) OVER (PARTITION BY lower(category_name), lower(title)) AS m FROM items) GROUP BY keyword, root HAVING count(*) > 1"""
)
def near_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = A.items(spark, d).select(F.lower("category_name").alias("keyword"), F.lower("title").alias("text"), F.col("title").alias("name"), F.col("current_price").alias("price"))
    return C.near_duplicate_groups(rows)


@query(
    """SELECT content, total_count, 'bracket_' || lpad(CAST(dense_rank() OVER (ORDER BY total DESC, first) AS VARCHAR), 3, '0') AS cluster_id, representative FROM (SELECT content, total_count, sum(total_count) OVER w AS total, min(content) OVER w AS first, first_value(content) OVER (PARTITION BY root ORDER BY total_count DESC, n DESC, length(content) DESC, content DESC) AS representative
    FROM (SELECT c.content, total_count, len(c.tokens) AS n, (SELECT min(b) FROM reach WHERE a = c.content) AS root FROM contents c) WINDOW w AS (PARTITION BY root))""",
    """contents AS (SELECT canonical_name AS content, count(*) AS total_count, list_distinct(list_filter(regexp_split_to_array(lower(canonical_name), '[^a-z0-9]+'), lambda t: t <> '')) AS tokens FROM listings GROUP BY canonical_name),
    edges AS (SELECT x.content AS a, y.content AS b FROM contents x, contents y WHERE len(list_intersect(x.tokens, y.tokens)) / len(list_distinct(list_concat(x.tokens, y.tokens))) >= 0.35)""",
    "reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)",
)
def bracket_clusters(spark: SparkSession, d: str) -> DataFrame:
    contents = A.listings(spark, d).groupBy(F.col("canonical_name").alias("content")).agg(F.count("*").alias("total_count"))
    return C.bracket_clusters(contents, 0.35)


ORACLE_SQL["bracket_clusters"] = ORACLE_SQL["bracket_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("SELECT keyword, canonical_name, count(*) AS item_count, min(price) AS min_price, quantile_cont(price, 0.5) AS median_price, round(avg(price), 2) AS mean_price, max(price) AS max_price, array_to_string(list_sort(list_distinct(list(name)))[1:5], ' | ') AS sample_name FROM listings GROUP BY ALL")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster_summary(A.listings(spark, d), ["keyword", "canonical_name"])


@query()
def refined_listings(spark: SparkSession, d: str) -> DataFrame:
    clean, _, _ = pipelines.refine(A.listings(spark, d), as_of())
    return clean.select("keyword", "platform", "pid", "name", "cluster_product_name", "cluster_route", "price", "rating")


# --- streams, against their batch twins


@query("SELECT DISTINCT w.user_id, w.item_id, i.current_price FROM wishlists w JOIN items i USING (item_id) WHERE current_price <= target_price OR (is_lowest_alert = 'Y' AND current_price <= lowest_price)")
def stream_price_alerts(spark: SparkSession, d: str) -> DataFrame:
    updates = A.items(spark, d).select("item_id", "current_price", "lowest_price", F.col("crawled_at").cast("timestamp").alias("ts"))
    wishes = A.wishlists(spark, d)
    return _replay(spark, updates, lambda s: alerts.price_alerts(s, wishes, "3650 days"), "price").select("user_id", "item_id", "current_price")


@query("SELECT item_id, strftime(ts, '%Y-%m-%d') AS day, b AS status_before FROM (SELECT *, lag(status) OVER (PARTITION BY item_id ORDER BY ts, status) AS b FROM listings) WHERE status = '판매완료' AND b <> '판매완료'")
def stream_sold_alerts(spark: SparkSession, d: str) -> DataFrame:
    updates = A.listings(spark, d).select("item_id", F.col("ts").cast("timestamp").alias("ts"), "status")
    return _replay(spark, updates, lambda s: alerts.sold_alerts(s, "3650 days"), "sold").select("item_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "status_before")


@query("SELECT keyword, week, search_count, impression_count, click_count FROM w", WEEKS)
def stream_search_counts(spark: SparkSession, d: str) -> DataFrame:
    events = A.actions(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "keyword", "event_type")
    return _replay(spark, events, lambda s: alerts.search_counts(s), "search", "complete", "keyword").select("keyword", F.floor(F.col("period_start").cast("long") / 604800).cast("long").alias("week"), "search_count", "impression_count", "click_count")


@query(
    """SELECT keyword, week, search_count, click_count, place, trend FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY search_count DESC, keyword) AS place, CASE WHEN b IS NULL THEN 'NEW' WHEN search_count > b THEN 'UP' WHEN search_count < b THEN 'DOWN' ELSE 'SAME' END AS trend FROM (SELECT *, lag(search_count) OVER (PARTITION BY keyword ORDER BY week) AS b FROM w))
    WHERE (week + 1) * 604800 <= (SELECT epoch(max(ts)) FROM actions) - 86400""",
    WEEKS,
)
def stream_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of the weeks that a stream with a day's watermark has closed, from four micro-batches."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    events = A.actions(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "keyword", "event_type")
    events.withColumn("part", F.floor((F.dayofmonth("ts") - 1) / 8).cast("int")).write.partitionBy("part").parquet(f"{path}/events")  # made once for all batches
    made = spark.read.schema("ts timestamp, keyword string, event_type string, part int").parquet(f"{path}/events")
    partitions = alerts.state_partitions(made, "keyword")
    for k in range(4):
        made.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        alerts.write_rankings(alerts.search_counts(stream, late="1 day"), f"{path}/out", f"{path}/state", partitions).awaitTermination()
    written = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/version=*")
    return written.select("keyword", F.floor(F.col("period_start").cast("long") / 604800).cast("long").alias("week"), "search_count", "click_count", "place", "trend")


@query("SELECT platform AS platform_name, CAST(item_id AS VARCHAR) AS original_id, arg_max(price, (part, ts, pid)) AS current_price FROM (SELECT *, month(ts) % 9 AS part FROM listings) GROUP BY ALL")
def stream_merged_items(spark: SparkSession, d: str) -> DataFrame:
    """The item table of nine micro-batches, the first eight of which become one run."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = A.listings(spark, d).withColumn("part", F.month("ts") % 9)
    records = rows.groupBy("part", F.col("platform").alias("platform_name"), F.col("item_id").cast("string").alias("original_id")).agg(F.max_by("price", F.struct("ts", "pid")).alias("current_price"), F.max("ts").alias("crawled_at"))
    schema = "platform_name string, original_id string, current_price long, crawled_at timestamp"
    records.write.partitionBy("part").parquet(f"{path}/records")  # made once for all batches
    for k in range(9):
        spark.read.schema(f"{schema}, part int").parquet(f"{path}/records").where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{path}/in")
        alerts.merge_listings(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    return alerts.items_of(spark, f"{path}/out", schema).select("platform_name", "original_id", "current_price")


@query("SELECT user_id, keyword, item_id FROM wanted JOIN items ON contains(lower(title), first) AND contains(lower(title), second)", "wanted AS (SELECT DISTINCT p_partkey % 40 AS user_id, split_part(p_name, ' ', 2) || ' ' || substr(split_part(p_name, ' ', 1), 2) AS keyword, split_part(p_name, ' ', 2) AS first, substr(split_part(p_name, ' ', 1), 2) AS second FROM part WHERE p_partkey % 40 % 4 <> 0)")
def stream_keyword_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts for the second word and a part of the first word of names, by their rarest pieces."""
    words = F.split("p_name", " ")
    told = A.tables(spark, d, "part")[0].select((F.col("p_partkey") % 40).alias("user_id"), F.concat(words[1], F.lit(" "), F.substring(words[0], 2, 100)).alias("keyword"), F.lit(True).alias("is_active")).distinct()
    settings = told.select("user_id").distinct().withColumn("new_item_enabled", F.col("user_id") % 4 != 0)
    items = A.items(spark, d).select("item_id", F.col("title").alias("name"), F.col("crawled_at").alias("ts"))
    counts = reliable(alerts.piece_counts(items))  # the table that is kept
    return _replay(spark, items, lambda s: alerts.keyword_alerts(s, told, settings, "3650 days", counts), "alerts").select("user_id", "keyword", "item_id")


def _replay(spark: SparkSession, frame: DataFrame, build, name: str, mode: str = "append", key: str | None = None) -> DataFrame:
    return alerts.replay(spark, frame, build, f"{shared_dir(spark)}/{uuid.uuid4().hex}", name, mode, key=key)


@query("SELECT item_id, title, canonical_name AS category, current_price, status, n AS points, coalesce(low, current_price) AS lowest_price, first AS first_label, title || ' ' || canonical_name || ' ' || category_name || ' ' || matched_keywords AS search_text FROM items LEFT JOIN (SELECT item_id, min(price) AS low, count(*) AS n, strftime(min(recorded_at), '%m.%d') AS first FROM history GROUP BY item_id) USING (item_id)")
def product_views(spark: SparkSession, d: str) -> DataFrame:
    return I.product_view(A.items(spark, d), A.history(A.listings(spark, d)), as_of()).select("item_id", "title", "category", "current_price", "status", F.size("points").cast("long").alias("points"), "lowest_price", F.get("points", F.lit(0))["label"].alias("first_label"), "search_text")


@query("SELECT row_number() OVER (ORDER BY score DESC, document_id) AS place, CAST(document_id AS BIGINT) AS item_id, title FROM ranked JOIN docs USING (document_id)", DOCS, fuzzy("blue", "anvil")[1], fuzzy("blue", "anvil")[0])
def combined_search(spark: SparkSession, d: str) -> DataFrame:
    return I.combined_search(_priced(spark, d), "blue anvil").select("place", "item_id", "title")


@query("SELECT item_id, current_price FROM items WHERE status = '판매중' AND contains(lower(title), 'gear') AND platform_name = '중고나라' ORDER BY current_price, item_id LIMIT 20 OFFSET 20")
def simple_search(spark: SparkSession, d: str) -> DataFrame:
    return I.simple_search(A.items(spark, d), " Gear", ("중고나라",), page=2).select("item_id", "current_price")


@query(
    """SELECT item_id, CASE WHEN platform_name <> '' THEN platform_name WHEN contains(item_url, 'daangn') THEN '당근마켓' ELSE '중고거래' END AS platform, original_id AS pid, category_name AS category, category_name AS brand, current_price AS price, status,
    title || ' 상품입니다. ' || CASE WHEN platform_name <> '' THEN platform_name WHEN contains(item_url, 'daangn') THEN '당근마켓' ELSE '중고거래' END || '에서 수집한 실제 중고거래 매물이며, 상세 상태와 거래 조건은 원본 페이지에서 확인해 주세요.' AS description,
    '최저가:' || lowest_price || ',현재가:' || current_price AS points FROM items"""
)
def service_products(spark: SparkSession, d: str) -> DataFrame:
    points = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["label"], p["price"])), ",")
    return I.service_view(A.items(spark, d), as_of()).select("item_id", "platform", "pid", "category", "brand", "price", "status", "description", points.alias("points"))


@query(
    """SELECT canonical_name AS cluster_product_name, CAST(round(avg(current_price)) AS BIGINT) AS mean_price, count(*) AS item_count, any_value(days) AS days, any_value(total) AS total FROM items LEFT JOIN (SELECT canonical_name, count(*) AS days, sum(price) AS total FROM daily GROUP BY ALL) USING (canonical_name)
    WHERE starts_with(canonical_name, 'blue') GROUP BY canonical_name ORDER BY canonical_name <> 'blue', item_count DESC, canonical_name LIMIT 6""",
    HISTORY,
)
def related_clusters(spark: SparkSession, d: str) -> DataFrame:
    named = A.items(spark, d).withColumn("cluster_product_name", F.col("canonical_name"))
    total = F.aggregate("points", F.lit(0).cast("bigint"), lambda a, p: a + p["price"])
    return I.related_clusters(named, A.history(A.listings(spark, d)), "Blue 128GB").select("cluster_product_name", "mean_price", "item_count", F.size("points").cast("long").alias("days"), total.alias("total"))


@query(
    """SELECT strftime(crawled_at, '%Y-%m-%d') AS day, CAST(round(avg(current_price)) AS BIGINT) AS price FROM f WHERE current_price BETWEEN 0.35 * (SELECT list_sort(list(current_price))[count(*) // 2 + 1] FROM f) AND 2.5 * (SELECT list_sort(list(current_price))[count(*) // 2 + 1] FROM f) GROUP BY ALL""",
    "f AS (SELECT * FROM items WHERE canonical_name = (SELECT min(canonical_name) FROM items) ORDER BY crawled_at, item_id LIMIT 300)",
)
def similar_group_series(spark: SparkSession, d: str) -> DataFrame:
    items = A.items(spark, d)
    return I.similar_group_series({"canonical_name": items.agg(F.min("canonical_name")).first()[0], "title": "x"}, items)


@query("SELECT item_id, title FROM items WHERE contains(lower(title), 'anvil') AND status = '판매중'")
def title_finder(spark: SparkSession, d: str) -> DataFrame:
    return I.finder(A.items(spark, d), title="anvil", on_sale=True).select("item_id", "title")


@query(
    """SELECT 'on_sale_items' AS metric, count(*) FILTER (status = '판매중') AS value FROM items UNION ALL SELECT 'wishes', count(*) FROM wishlists UNION ALL SELECT 'users_with_wishes', count(DISTINCT user_id) FROM wishlists
    UNION ALL SELECT 'views', count(*) FROM actions WHERE event_type = 'IMPRESSION'"""
)
def simple_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.simple_counts(A.items(spark, d), A.wishlists(spark, d), A.actions(spark, d).where("event_type = 'IMPRESSION'"))


@query("SELECT i.item_id, count(a.event_id) AS view_count FROM items i LEFT JOIN actions a ON a.item_id = i.item_id AND a.event_type = 'IMPRESSION' GROUP BY i.item_id")
def view_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.view_counts(A.items(spark, d), A.actions(spark, d).where("event_type = 'IMPRESSION'"))


@query("SELECT canonical_name, count(*) AS size, round(any_value(m), 2) AS median_price, arg_min(title, (abs(current_price - m), length(title), current_price, title)) AS representative FROM items JOIN (SELECT canonical_name, quantile_cont(current_price, 0.5) AS m FROM items GROUP BY ALL) USING (canonical_name) GROUP BY canonical_name")
def group_representatives(spark: SparkSession, d: str) -> DataFrame:
    rows = A.items(spark, d).select("canonical_name", F.col("title").alias("text"), F.col("current_price").alias("price"))
    return C.representatives(rows, ["canonical_name"]).select("canonical_name", "size", F.round("median_price", 2).alias("median_price"), "representative")


@query()
def cluster_trees(spark: SparkSession, d: str) -> DataFrame:
    found = C.cluster_tree(A.listings(spark, d), "canonical_name")
    return found.select("keyword", F.explode("clusters").alias("c")).select("keyword", "c.name", "c.size", F.size("c.items").alias("shown"))


@query("SELECT keyword, word, CAST(n AS BIGINT) AS count FROM (SELECT keyword, word, count(*) AS n FROM (SELECT keyword, unnest(string_split(lower(canonical_name), ' ')) AS word FROM listings) WHERE length(word) >= 2 GROUP BY ALL) WHERE n >= 2")
def keyword_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d).select("keyword", T.normal(F.col("canonical_name")).alias("cluster_text"))
    return C.vocabulary(rows).select("keyword", F.col("token").alias("word"), "count")
