"""Validation, blacklists, group price bounds and outliers. Every function returns frames; what is dropped is a frame of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelore.functions import text as T
from pricelore.functions import values as V
from pricelore.shared import few

#: Reasons and stages of the drop log, default blacklist.
MISSING, INVALID, BLACKLISTED, LOW, HIGH = "필수값 누락", "유효하지 않은 가격", "상품명 블랙리스트", "가격 이상치(저가)", "가격 이상치(고가)"
BLACKLIST = ("삽니다", "구매합니다", "매입", "대여", "교환", "렌탈", "급처")
MEDIAN_RATIO = 0.2


def blacklist_hits(name: Column, words: tuple[str, ...] = BLACKLIST) -> Column:
    """The blacklist words that the raw, normal or compact name holds."""
    raw, normal, compact = F.lower(F.coalesce(name, F.lit(""))), T.normal(name), T.compact(name)
    entry = F.array(*(F.struct(F.lit(w).alias("word"), F.lower(F.lit(w)).alias("raw"), T.normal(F.lit(w)).alias("normal"), T.compact(F.lit(w)).alias("compact")) for w in dict.fromkeys(words)))
    holds = lambda hay, needle: F.call_function("contains", hay, needle)
    found = F.filter(entry, lambda e: (e["normal"] != "") & (holds(raw, e["raw"]) | holds(normal, e["normal"]) | holds(compact, e["compact"])))
    return F.transform(found, lambda e: e["word"])


def excluded_at_source(title: Column, phrases: tuple[str, ...], tokens: tuple[str, ...]) -> Column:
    text = F.lower(F.coalesce(title, F.lit("")))
    by_phrase = F.exists(F.array(*map(F.lit, phrases)), lambda p: F.call_function("contains", text, p)) if phrases else F.lit(False)
    return by_phrase | (F.arrays_overlap(T.title_tokens(title), F.array(*map(F.lit, tokens))) if tokens else F.lit(False))


def validate(rows: DataFrame, words: tuple[str, ...] = BLACKLIST, by_name: bool = False) -> DataFrame:
    """``rows`` with drop_reason, drop_stage and drop_detail; null where a row is good. ``by_name`` looks for the words once in each distinct name, in a pass before."""
    hits = F.col("_hits") if by_name else blacklist_hits(F.col("name"), words)
    if by_name:
        held = few(rows.select(F.col("name").alias("_name")).distinct().withColumn("_hits", blacklist_hits(F.col("_name"), words)).where(F.size("_hits") > 0))
        rows = rows.join(held, F.col("name") == F.col("_name"), "left").drop("_name")
    missing = F.col("keyword").isNull() | F.col("name").isNull() | F.col("price").isNull()
    reason = F.when(missing, MISSING).when(F.col("price") <= 0, INVALID).when(F.size(hits) > 0, BLACKLISTED)
    out = rows.withColumn("drop_reason", reason)
    stage = F.when(F.col("drop_reason").isin(MISSING, INVALID), "input_validation").when(F.col("drop_reason") == BLACKLISTED, "name_blacklist")
    return out.withColumn("drop_stage", stage).withColumn("drop_detail", F.when(F.col("drop_reason") == BLACKLISTED, F.array_join(hits, " | ")).otherwise(F.col("drop_reason"))).drop("_hits")


def group_stats(rows: DataFrame, group: str, ratio: float = MEDIAN_RATIO, approximate: bool = False) -> DataFrame:
    """Counts, quartiles and bounds of each non-blank group. ``approximate`` bounds the memory of a group; exact quartiles hold a count for each distinct price."""
    named = rows.select(T.blank(F.col(group)).alias(group), "price").where((F.col(group) != "") & (F.col("price") > 0))
    q = F.percentile_approx("price", [0.25, 0.5, 0.75], 10000) if approximate else F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = named.groupBy(group).agg(F.count("*").alias("item_count"), F.min("price").alias("min_price"), q.alias("q"), F.max("price").alias("max_price"), F.avg("price").alias("average_price"))
    q1, median, q3 = (F.get("q", F.lit(k)).cast("double") for k in range(3))
    iqr = q3 - q1
    return stats.select(group, "item_count", "min_price", q1.alias("q1"), median.alias("median_price"), q3.alias("q3"), "max_price", "average_price", iqr.alias("iqr"), F.greatest(F.greatest(F.lit(0.0), q1 - 1.5 * iqr), median * ratio).alias("lower_bound"), (q3 + 1.5 * iqr).alias("upper_bound"))


#: The size of a sketch; the greater it is, the nearer are its ranks (0.1 % off or less at this size).
SKETCH_SIZE = 4096


def daily_sketches(rows: DataFrame, group: str, day: Column, size: int = SKETCH_SIZE) -> DataFrame:
    """(group, day, item_count, min_price, max_price, price_sum, sketch): what is kept of a day's prices, for each non-blank group, in bounded size. Days are made once and put together as often as is liked (``sketch_stats``)."""
    named = rows.select(T.blank(F.col(group)).alias(group), day.alias("day"), F.col("price").cast("long").alias("price")).where((F.col(group) != "") & (F.col("price") > 0))
    return named.groupBy(group, "day").agg(F.count("*").alias("item_count"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.sum("price").alias("price_sum"), F.kll_sketch_agg_bigint("price", size).alias("sketch"))


def sketch_stats(days: DataFrame, group: str, ratio: float = MEDIAN_RATIO, size: int = SKETCH_SIZE) -> DataFrame:
    """``group_stats`` from ``daily_sketches``: counts, extremes and means are exact, quartiles and bounds are those of the merged sketches."""
    merged = days.groupBy(group).agg(F.sum("item_count").alias("item_count"), F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"), F.sum("price_sum").alias("price_sum"), F.kll_merge_agg_bigint("sketch", size).alias("sketch"))
    q1, median, q3 = (F.kll_sketch_get_quantile_bigint("sketch", F.lit(x)).cast("double") for x in (0.25, 0.5, 0.75))
    stats = merged.select(group, "item_count", "min_price", q1.alias("q1"), median.alias("median_price"), q3.alias("q3"), "max_price", (F.col("price_sum") / F.col("item_count")).alias("average_price"))
    iqr = F.col("q3") - F.col("q1")
    return stats.select("*", iqr.alias("iqr"), F.greatest(F.lit(0.0), F.col("q1") - 1.5 * iqr, F.col("median_price") * ratio).alias("lower_bound"), (F.col("q3") + 1.5 * iqr).alias("upper_bound"))


def list_bounds(prices: Column, ratio: float = MEDIAN_RATIO) -> Column:
    """(low, high) of an array of prices; null with fewer than two valid ones."""
    valid = F.array_sort(F.filter(prices, lambda p: p > 0))
    n = F.size(valid)

    def quantile(share: float) -> Column:
        at = (n - 1) * share
        low, high = F.get(valid, F.floor(at).cast("int")), F.get(valid, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    q1, median, q3 = map(quantile, (0.25, 0.5, 0.75))
    return F.when(n >= 2, F.struct(F.greatest(F.lit(0.0), q1 - 1.5 * (q3 - q1), median * ratio).alias("low"), (q3 + 1.5 * (q3 - q1)).alias("high"), median.alias("median")))


def decision(name: Column, price: Column, bounds: Column) -> Column:
    """(reason, stage, detail) of one row: bad price, blacklist, too low, too high; null if it stays."""
    hits = blacklist_hits(name)
    made = lambda r, s, d: F.struct(F.lit(r).alias("reason"), F.lit(s).alias("stage"), d.alias("detail"))
    shown = lambda c: F.format_string("%.0f", F.coalesce(c, F.lit(0)).cast("double"))
    detail = lambda name, bound: F.concat(F.lit("price="), F.floor(price).cast("string"), F.lit(f", {name}="), shown(bound), F.lit(", median="), shown(bounds["median"]))
    return F.when(price.isNull() | (price <= 0), made(INVALID, "required_fields", F.when(F.coalesce(price, F.lit(0)) == 0, "").otherwise(price.cast("string")))).when(F.size(hits) > 0, made(BLACKLISTED, "name_blacklist", F.array_join(hits, " | "))).when(price < bounds["low"], made(LOW, "price_outlier", detail("lower_bound", bounds["low"]))).when(price > bounds["high"], made(HIGH, "price_outlier", detail("upper_bound", bounds["high"])))


def flag_outliers(rows: DataFrame, group: str, stats: DataFrame | None = None) -> DataFrame:
    """Every row with its group's bounds and outlier_type (low, high or null); rows of blank groups have neither. The bounds of few groups are broadcast, so a group's rows don't meet in one task."""
    stats = group_stats(rows, group) if stats is None else stats
    bounds = few(stats.select(F.col(group).alias("_group"), "median_price", "lower_bound", "upper_bound"))
    kind = F.when(F.col("price") < F.col("lower_bound"), "low").when(F.col("price") > F.col("upper_bound"), "high")
    return rows.join(bounds, T.blank(F.col(group)) == F.col("_group"), "left").drop("_group").withColumn("outlier_type", kind)


def remove_outliers(rows: DataFrame, group: str, stage: str = "price_outlier") -> tuple[DataFrame, DataFrame]:
    """(clean, dropped). A listing (platform, pid, price) that is flagged in one group goes from all."""
    flagged = flag_outliers(rows, group)
    bad = flagged.where("outlier_type IS NOT NULL")
    keys = ["platform", "pid", "price"]
    clean = rows.join(bad.select(*keys).distinct(), keys, "left_anti")
    reason = F.when(F.col("outlier_type") == "low", LOW).otherwise(HIGH)
    detail = V.outlier_detail(F.col("price"), F.col("lower_bound"), F.col("upper_bound"), F.col("median_price"), F.col(group), F.col("outlier_type"), "keyword" if group == "keyword" else "product_name")
    dropped = bad.withColumn("drop_reason", reason).withColumn("drop_stage", F.lit(stage)).withColumn("drop_detail", detail).select(*rows.columns, "drop_reason", "drop_stage", "drop_detail")
    return clean.select(*rows.columns), dropped


def outlier_summary(rows: DataFrame, group: str = "keyword") -> DataFrame:
    flagged = flag_outliers(rows.where("price > 0"), group)
    low, high = F.count_if(F.col("outlier_type") == "low"), F.count_if(F.col("outlier_type") == "high")
    return flagged.groupBy(group).agg(F.count("*").alias("item_count"), low.alias("low_count"), high.alias("high_count"), (low + high).alias("outlier_count"), ((low + high) / F.count("*")).alias("outlier_rate"), F.first("lower_bound").alias("lower_bound"), F.first("upper_bound").alias("upper_bound"))


def outlier_overview(rows: DataFrame, group: str = "keyword") -> DataFrame:
    flagged = flag_outliers(rows.where("price > 0"), group)
    low, high = F.count_if(F.col("outlier_type") == "low"), F.count_if(F.col("outlier_type") == "high")
    return flagged.agg(F.count("*").alias("item_count"), F.count_distinct(group).alias("keyword_count"), low.alias("low_count"), high.alias("high_count"), F.try_divide(low + high, F.count("*")).alias("outlier_rate"))


def clean_summary(rows: DataFrame, group: str = "keyword") -> DataFrame:
    """Original and removed counts of each group with the statistics of what stays."""
    clean, _ = remove_outliers(rows, group)
    before = rows.groupBy(group).agg(F.count("*").alias("original_count"))
    after = clean.groupBy(group).agg(F.count("*").alias("clean_count"), F.min("price").alias("clean_min"), F.percentile("price", F.lit(0.5)).alias("clean_median"), F.max("price").alias("clean_max"), F.avg("price").alias("clean_mean"))
    kept = F.coalesce("clean_count", F.lit(0))
    return before.join(after, group, "left").select(group, "original_count", kept.alias("clean_count"), (F.col("original_count") - kept).alias("removed_count"), ((F.col("original_count") - kept) / F.col("original_count")).alias("removed_rate"), "clean_min", "clean_median", "clean_max", "clean_mean")


def blacklist_overview(rows: DataFrame, words: tuple[str, ...] = BLACKLIST) -> DataFrame:
    hit = F.size(blacklist_hits(F.col("name"), words)) > 0
    return rows.groupBy("keyword").agg(F.count("*").alias("item_count"), F.count_if(hit).alias("dropped_count"), (F.count_if(hit) / F.count("*")).alias("drop_rate"))


def cheapest(rows: DataFrame, n: int = 30) -> DataFrame:
    order = Window.partitionBy("keyword").orderBy("price", "platform", "pid")
    return rows.withColumn("price_rank", F.row_number().over(order)).where(F.col("price_rank") <= n)


def outlier_review(rows: DataFrame, group: str = "keyword") -> DataFrame:
    """Outliers with their distance to the bound and a severity: median over price for low ones, price over median for high ones."""
    bad = flag_outliers(rows, group).where("outlier_type IS NOT NULL")
    low = F.col("outlier_type") == "low"
    return bad.withColumn("gap", F.when(low, F.col("lower_bound") - F.col("price")).otherwise(F.col("price") - F.col("upper_bound"))).withColumn("median_ratio", F.col("price") / F.col("median_price")).withColumn("severity", F.when(low, F.col("median_price") / F.col("price")).otherwise(F.col("price") / F.col("median_price")))


def min_prices(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` with the least positive price of their group, joined from an aggregate; rows without a group are one group."""
    least = rows.where("price > 0").groupBy(F.col(group).alias("_group")).agg(F.min("price").alias("lowest_price"))
    return rows.join(least, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def rate(rows: DataFrame, as_of: Column, group: str = "cluster_product_name") -> DataFrame:
    """Ratings of ``rows`` (``group``, cluster_route, price, view_count, seen_at). The least price is joined from an aggregate, so that a hot group is not one task's work."""
    least = few(rows.where("price > 0").groupBy(group).agg(F.min("price").alias("group_min_price")))
    most = rows.agg(F.max("view_count").alias("max_views")).first()["max_views"]
    score, confidence = V.cluster_score(F.col(group), F.col("cluster_route"))
    out = rows.join(least, group, "left").withColumns({"cluster_score": score, "cluster_confidence": confidence, "price_score": V.price_score(F.col("price"), F.col("group_min_price")), "view_score": V.view_score(F.col("view_count"), F.lit(most)), "recency_score": V.recency_score(F.col("seen_at"), as_of)})
    return out.withColumn("rating", V.rating(*(F.col(f"{k}_score") for k in ("cluster", "price", "view", "recency"))))


def summary(rows: DataFrame, floors: bool = True, upper: bool = True) -> DataFrame:
    """(lowest, average, latest) of the matching listings: plausible prices if there are any, and of five or more only those above a fifth of the median, if there are any. ``latest`` is of all listings, whatever their prices. Two passes, of one row each; the median is the upper one of two, or
    lies between them."""
    least, mean = F.min("price"), F.round(F.avg("price")).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    if not floors:
        priced = F.when(F.col("price") > 0, F.col("price"))
        return rows.agg(zero(F.min(priced)).alias("lowest"), zero(F.round(F.avg(priced)).cast("long")).alias("average"), F.max("ts").alias("latest"))
    plausible = (F.col("price") >= V.LOWEST_PRICE) & (F.col("price") < V.HIGHEST_PRICE)
    total, good, latest = rows.agg(F.count_if(F.col("price") > 0), F.count_if(plausible), F.max("ts")).first()
    used, n = (rows.where(plausible), good) if good else (rows.where("price > 0"), total)
    floor = 0
    if n >= 5:
        share = (n // 2 + 1) / n - 1e-12
        middle = F.expr(f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY price)") if upper else F.percentile("price", F.lit(0.5))
        floor = max(V.LOWEST_PRICE, round(used.agg(middle).first()[0] * V.FLOOR_RATIO))
    above = F.when(F.col("price") >= floor, F.col("price"))
    return used.agg(zero(F.coalesce(F.min(above), least)).alias("lowest"), zero(F.coalesce(F.round(F.avg(above)).cast("long"), mean)).alias("average"), F.lit(latest).cast(rows.schema["ts"].dataType).alias("latest"))
