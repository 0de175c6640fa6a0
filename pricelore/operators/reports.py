"""Reports on keywords, platforms, tokens and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelore.functions import text as T
from pricelore.functions import values as V
from pricelore.shared import reliable


def counter(rows: DataFrame, groups: list[str], key: str, n: int, name: str, weight: str | None = None) -> DataFrame:
    """(groups, name): ``key:count`` of the n most frequent non-blank keys of each group; ties by key. ``weight``: a column that says how many rows a row stands for."""
    counts = rows.where(T.blank(F.col(key)) != "").groupBy(*groups, key).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), key)) if groups else F.row_number().over(Window.orderBy(F.desc("n"), key))
    top = counts.withColumn("place", place).where(F.col("place") <= n)
    entry = F.struct("place", F.concat_ws(":", F.col(key), F.col("n").cast("string")).alias("t"))
    return top.groupBy(*groups).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), ", ").alias(name))


def first_samples(rows: DataFrame, groups: list[str], column: str, n: int, name: str) -> DataFrame:
    """The n least distinct values of each group."""
    distinct = rows.select(*groups, column).where(F.col(column).isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(column))
    return distinct.withColumn("place", place).where(F.col("place") <= n).groupBy(*groups).agg(F.array_join(F.array_sort(F.collect_list(column)), " | ").alias(name))


def platform_summary(rows: DataFrame, groups: list[str], top: int = 15) -> DataFrame:
    """Counts and prices of each group; rows: platform, pid, keyword, name, price, status, is_match."""
    passed = F.count_if("is_match")
    out = rows.groupBy(*groups).agg(
        F.count("*").alias("row_count"), F.count_distinct("pid").alias("pid_count"), F.count_distinct("keyword").alias("keyword_count"), passed.alias("pass_count"), (F.count("*") - passed).alias("fail_count"), F.round(passed / F.count("*"), 4).alias("pass_rate"),
        F.count_if(F.col("name").rlike(r"\[[^\]]*\]")).alias("bracket_count"), F.round(F.avg(F.length("name")), 2).alias("mean_title_length"), F.round(F.avg("price"), 2).alias("mean_price"), F.percentile("price", F.lit(0.5)).alias("median_price"),
        *(F.count_if(F.col("status") == s).alias(n) for s, n in ((V.ON_SALE, "on_sale_count"), (V.RESERVED, "reserved_count"), (V.SOLD, "sold_count"))),
    )
    return out.join(counter(rows, groups, "keyword", top, "top_keywords"), groups, "left")


def missing_token_summary(rows: DataFrame) -> DataFrame:
    """(platform, token, fail_count, top_keywords, samples) of the tokens that titles lack."""
    each = rows.where(~F.col("is_match")).select("platform", "keyword", "name", F.explode(F.array_distinct("missing_tokens")).alias("token"))
    counts = each.groupBy("platform", "token").agg(F.count("*").alias("fail_count"))
    keywords = counter(rows.where(~F.col("is_match")), ["platform"], "keyword", 5, "top_keywords")
    return counts.join(keywords, "platform", "left").join(first_samples(each, ["platform", "token"], "name", 3, "samples"), ["platform", "token"], "left")


def accuracy_summary(rows: DataFrame) -> DataFrame:
    """(metric, value) in long form."""
    one = rows.agg(F.count("*").cast("double").alias("total_rows"), F.count_if("is_match").cast("double").alias("pass_rows"), F.count_if(~F.col("is_match")).cast("double").alias("fail_rows"), F.round(F.try_divide(F.count_if("is_match"), F.count("*")), 4).alias("pass_rate"))
    return one.unpivot([], one.columns, "metric", "value")


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    c = rows.agg(F.count_if(p & a).alias("tp"), F.count_if(~p & ~a).alias("tn"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    ratio = lambda x, y: F.when(y > 0, F.round(x / y, 4)).otherwise(0.0)
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return c.select("tp", "tn", "fp", "fn", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def bracket_contents(rows: DataFrame) -> DataFrame:
    """(content, total_count, platforms, keywords, samples) of what stands in square brackets, in lower case."""
    each = rows.select("platform", "keyword", "name", F.explode(F.regexp_extract_all("name", F.lit(r"\[([^\]]*)\]"), F.lit(1))).alias("c")).withColumn("content", F.lower(T.tidy(F.col("c")))).where("content <> ''")
    out = each.groupBy("content").agg(F.count("*").alias("total_count"))
    for key, name in (("platform", "platforms"), ("keyword", "keywords")):
        out = out.join(counter(each, ["content"], key, 5, name), "content", "left")
    return out.join(first_samples(each, ["content"], "name", 3, "samples"), "content", "left")


def token_counts(contents: DataFrame, length: int = 1) -> DataFrame:
    """(token, count) over contents (content, total_count); a token counts once in a content."""
    return contents.select(F.explode(F.array_distinct(T.least_tokens(F.col("content"), length))).alias("token"), "total_count").groupBy("token").agg(F.sum("total_count").alias("count"))


def token_frequency(rows: DataFrame, column: str = "name", length: int = 2) -> DataFrame:
    """(token, count, row_count) of every word of a column, for labelling."""
    each = rows.select(F.monotonically_increasing_id().alias("r"), F.explode(T.least_tokens(F.col(column), length)).alias("token"))
    by_row = each.groupBy("token", "r").agg(F.count("*").alias("n"))
    return by_row.groupBy("token").agg(F.sum("n").alias("count"), F.count("*").alias("row_count"))


def reference_tokens(rows: DataFrame, least: int = 2, top: int = 3) -> DataFrame:
    """(token, doc_count, top_keywords, samples, use) over listings distinct by platform, pid, keyword and name."""
    distinct = rows.select("platform", "pid", "keyword", "name").distinct()
    each = distinct.select("keyword", "name", F.explode(F.array_distinct(T.title_tokens(F.col("name")))).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("doc_count")).where(F.col("doc_count") >= least)
    out = counts.join(counter(each, ["token"], "keyword", top, "top_keywords"), "token", "left").join(first_samples(each, ["token"], "name", 3, "samples"), "token", "left")
    return out.withColumn("use", V.token_use(F.col("token")))


def rule_hits(rows: DataFrame, rules: DataFrame, groups: list[str], keywords: int = 8, samples: int = 3) -> DataFrame:
    """(groups, match_count, source_keywords, samples): how many listings, distinct by platform, pid, keyword and name, hold one of a rule's aliases in their compact texts (name, keyword, and canonical_name and matched_keywords where there are any). For the
    references of the product dictionary and of the category rules; rules: the ``groups`` columns and alias, a row for each alias."""
    from pricelore.operators.matching import contained

    more = [c for c in ("canonical_name", "matched_keywords") if c in rows.columns]
    # what follows from the texts is made once for each distinct one, which stands for so many listings
    alike = rows.dropDuplicates(["platform", "pid", "keyword", "name"]).groupBy("keyword", "name", *more).agg(F.count("*").alias("_n"))
    distinct = reliable(alike.withColumn("_text", T.compact(F.concat_ws(" ", "name", "keyword", *more))))
    aliases = rules.select(*groups, T.compact(F.col("alias")).alias("_alias"))
    texts = contained(distinct.select("_text").distinct(), "_text", aliases, "_alias").select("_text", *groups).distinct()
    hits = distinct.join(texts, "_text")
    counts = hits.groupBy(*groups).agg(F.sum("_n").alias("match_count"))
    return counts.join(counter(hits, groups, "keyword", keywords, "source_keywords", "_n"), groups, "left").join(first_samples(hits, groups, "name", samples, "samples"), groups, "left")


def excluded_tokens(rows: DataFrame, samples: int = 3) -> DataFrame:
    """(token, reason, match_count, samples) of the words of noise and low signal that titles hold."""
    reason = F.when(F.col("token").isin(*V.LOW_SIGNAL_WORDS), "accessory_or_low_signal").when(F.col("token").isin(*V.NOISE_WORDS), "bait_or_noise")
    return reference_tokens(rows, 1).withColumn("reason", reason).where("reason IS NOT NULL").select("token", "reason", F.col("doc_count").alias("match_count"), "samples")


def duplicate_checks(rows: DataFrame) -> DataFrame:
    """(check, count): names with several paths in a keyword, names in several keywords, repeated items."""
    paths = rows.groupBy("keyword", "cluster_product_name").agg(F.count_distinct("path").alias("n")).agg(F.count_if(F.col("n") > 1).alias("paths_per_name"))
    names = rows.groupBy("cluster_product_name").agg(F.count_distinct("keyword").alias("n")).agg(F.count_if(F.col("n") > 1).alias("names_across_keywords"))
    items = rows.groupBy("platform", "pid").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_items"))
    return paths.unpivot([], ["paths_per_name"], "check", "count").union(names.unpivot([], ["names_across_keywords"], "check", "count")).union(items.unpivot([], ["repeated_items"], "check", "count"))


def run_statistics(clean: DataFrame, dropped: DataFrame) -> DataFrame:
    """(metric, value): rows in and out, drops by reason, routes, mean rating."""
    named = lambda df, prefix, col: df.groupBy(col).agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit(prefix), F.coalesce(F.col(col), F.lit("none"))).alias("metric"), "value")
    totals = clean.agg(F.count("*").cast("double").alias("clean_rows"), F.round(F.avg("rating"), 4).alias("mean_rating"))
    return totals.unpivot([], totals.columns, "metric", "value").unionByName(named(dropped, "dropped: ", "drop_reason")).unionByName(named(clean, "route: ", "cluster_route"))


def sign_summary(rows: DataFrame) -> DataFrame:
    each = rows.select("name", F.explode(T.sign_patterns(F.col("name"))).alias("pattern"))
    return each.groupBy("pattern").agg(F.count("*").alias("title_count")).join(first_samples(each, ["pattern"], "name", 3, "samples"), "pattern", "left")
