"""The driver's tables as listings, items, price history, wishlists and events, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.functions.values import ON_SALE, RESERVED, SOLD

#: The clock of all queries.
AS_OF = "1999-01-01 00:00:00"

SQL = f"""
listings AS (
  SELECT lower(p_type) AS keyword, p_name AS canonical_name, r_name AS platform, l_orderkey || '-' || l_linenumber AS pid, p_name || ' ' || p_brand AS name,
    CAST(round(l_extendedprice) AS BIGINT) AS price, CASE l_returnflag WHEN 'N' THEN '{ON_SALE}' WHEN 'A' THEN '{RESERVED}' ELSE '{SOLD}' END AS status, l_shipdate AS ts, l_partkey AS item_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
items AS (
  SELECT p_partkey AS item_id, any_value(p_name || ' ' || p_brand) AS title, any_value(p_name) AS canonical_name, any_value(p_type) AS category_name, any_value(CAST(round(p_retailprice) AS BIGINT)) AS current_price,
    CAST(round(min(l_extendedprice / l_quantity)) AS BIGINT) AS lowest_price, max(l_shipdate) AS crawled_at, CASE p_partkey % 3 WHEN 0 THEN '{SOLD}' ELSE '{ON_SALE}' END AS status,
    CASE p_partkey % 5 WHEN 4 THEN '' WHEN 3 THEN '중고나라' ELSE '번개장터' END AS platform_name, 'p' || p_partkey AS original_id, any_value(lower(p_type) || ',' || p_brand || '|' || lower(p_type)) AS matched_keywords,
    'https://www.' || CASE p_partkey % 2 WHEN 0 THEN 'daangn' ELSE 'example' END || '.com/' || p_partkey AS item_url
  FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey),
history AS (
  SELECT item_id, CAST(ts AS DATE) AS recorded_at, arg_max(price, (ts, pid)) AS price FROM listings GROUP BY item_id, CAST(ts AS DATE)),
wishlists AS (
  SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id, 900 + (o_custkey * 7 + l_partkey * 13) % 1200 AS target_price, CASE WHEN (o_custkey + l_partkey) % 2 = 0 THEN 'Y' ELSE 'N' END AS is_lowest_alert
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
actions AS (
  SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'IMPRESSION' WHEN 'click' THEN 'CLICK' ELSE 'SEARCH' END AS event_type, json_extract_string(props, '$.k') AS keyword,
    event_id % (SELECT count(*) FROM part) AS item_id FROM events)
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item. The four dimension tables are left to the planner, which broadcasts them by their size."""
    line, part, supplier, nation, region = tables(spark, sf_dir, "lineitem", "part", "supplier", "nation", "region")
    whole = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return whole.select(
        F.lower("p_type").alias("keyword"),
        F.col("p_name").alias("canonical_name"),
        F.col("r_name").alias("platform"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pid"),
        F.concat_ws(" ", "p_name", "p_brand").alias("name"),
        F.round("l_extendedprice").cast("long").alias("price"),
        F.when(F.col("l_returnflag") == "N", ON_SALE).when(F.col("l_returnflag") == "A", RESERVED).otherwise(SOLD).alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_partkey").alias("item_id"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = tables(spark, sf_dir, "part", "lineitem")
    least = line.groupBy("l_partkey").agg(F.round(F.min(F.col("l_extendedprice") / F.col("l_quantity"))).cast("long").alias("lowest_price"), F.max("l_shipdate").cast("timestamp").alias("crawled_at"))
    return part.join(least, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("category_name"),
        F.round("p_retailprice").cast("long").alias("current_price"), "lowest_price", "crawled_at", F.when(F.col("p_partkey") % 3 == 0, SOLD).otherwise(ON_SALE).alias("status"),
        F.when(F.col("p_partkey") % 5 == 4, "").when(F.col("p_partkey") % 5 == 3, "중고나라").otherwise("번개장터").alias("platform_name"), F.concat(F.lit("p"), F.col("p_partkey")).alias("original_id"),
        F.concat(F.lower("p_type"), F.lit(","), F.col("p_brand"), F.lit("|"), F.lower("p_type")).alias("matched_keywords"),
        F.concat(F.lit("https://www."), F.when(F.col("p_partkey") % 2 == 0, "daangn").otherwise("example"), F.lit(".com/"), F.col("p_partkey")).alias("item_url"),
    )


def history(rows: DataFrame) -> DataFrame:
    """The last price of each item and day."""
    return rows.groupBy("item_id", F.to_date("ts").alias("recorded_at")).agg(F.max_by("price", F.struct("ts", "pid")).alias("price"))


def wishlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, line = tables(spark, sf_dir, "orders", "lineitem")
    both = orders.join(line, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).distinct()
    return both.select("user_id", "item_id", (900 + (F.col("user_id") * 7 + F.col("item_id") * 13) % 1200).alias("target_price"), F.when((F.col("user_id") + F.col("item_id")) % 2 == 0, "Y").otherwise("N").alias("is_lowest_alert"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, part = tables(spark, sf_dir, "events", "part")
    n = part.count()
    kind = F.when(F.col("event_type") == "view", "IMPRESSION").when(F.col("event_type") == "click", "CLICK").otherwise("SEARCH")
    return events.select("event_id", "ts", "user_id", kind.alias("event_type"), F.get_json_object("props", "$.k").alias("keyword"), (F.col("event_id") % n).alias("item_id"))
