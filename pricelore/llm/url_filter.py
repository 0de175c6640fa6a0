"""Operator 10: URL filter by fixed rules and by association rules.

Fixed rules (host, path) label the pages that they fit. The labelled pages are the transactions: URL tokens (labels of the host, registered domain, top-level domain, path steps, scheme, query names, fragment) plus the label's token. Spark's FP-growth mines the
combinations; one that leads to ``block`` becomes a rule if its confidence and support among labelled pages suffice, if its confidence is significant, and if it is more frequent among blocked pages than among all pages, labelled or not, by ``LIFT`` at least: what is
as common everywhere (a scheme, say) tells nothing. Rules that a more general one covers with no less confidence are pruned. A rule is filed in an inverted index under its rarest token; a page looks up its own tokens and checks the rules that it meets.

The longest fixed rule that fits decides; else the method: block if a mined rule matches, allow if none does. Edge cases: a null url or one without ``://`` has an empty host and path, and is allowed unless a mined rule matches; repeated rows and null page_ids are judged like
any other row; ties of fixed rules go to the longer host, and of mined rules to the first by their tokens; a very long url has as many tokens as steps, and repeated or nested long urls cost no more than the pairs of their frequent tokens (see ``mine``), while urls of one long set of frequent steps, each without
another step and labelled both ways, are as many combinations as they have, since none of those is covered; an empty table gives no rows; columns other than page_id and url are ignored.
``MAX_RULES`` bounds what is broadcast; beyond it the index is joined by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import cut, table

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.8, 1.5
#: At every table size, the lower Wilson bound (95 %, one-sided) of a rule's confidence must be over ``SURE``, so that no rules come by chance.
Z, SURE = 1.645, 0.5
#: No rule with fewer blocked pages can pass that: with n of n the bound is n / (n + Z * Z).
LEAST_PAGES = math.floor(SURE * Z * Z / (1 - SURE)) + 1
MAX_RULES = 200_000
#: Rows of tokens, pairs or rules that a task takes: few of them (counted) are one partition, so that what is done with them alone needs no shuffle, however many partitions a shuffle has.
TASK_ROWS = 10_000
#: Between the two tokens of an item of FP-growth.
BESIDE = "\x01"
BLOCK, ALLOW = "label=block", "label=allow"


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host_: Column, path_: Column, rules: tuple = RULES) -> Column:
    """The longest fixed rule that fits, as (verdict, rule), or null: the longest host and path together, then the longest host."""
    best = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(best)
    return best


def tokens(host_: Column, path_: Column, url: Column) -> Column:
    parts = F.filter(F.split(host_, r"\."), lambda x: x != "")
    steps = F.filter(F.split(path_, "/"), lambda x: x != "")
    names = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    pair = F.when(F.size(parts) >= 2, F.array(F.concat(F.lit("domain="), F.array_join(F.slice(parts, -2, 2), ".")))).otherwise(F.array())
    label = lambda kind: lambda x: F.concat(F.lit(kind), x)
    inner = F.when(F.size(parts) > 2, F.slice(parts, 1, F.size(parts) - 2)).otherwise(F.array())
    return F.array_distinct(
        F.concat(F.transform(inner, label("label ")), pair, F.transform(F.slice(parts, -1, 1), label("top=")), F.transform(steps, label("step=")), F.transform(names, label("name=")), F.when(url.contains("://"), F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([^:/?#]*)", 1)))).otherwise(F.array()), F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array()))
    )


def prepared(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, fixed, tokens)."""
    known = pages.select(F.col("page_id").cast("long"), "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return known.select("page_id", "host", "path", fitting(F.col("host"), F.col("path"), rules).alias("fixed"), F.coalesce(tokens(F.col("host"), F.col("path"), F.col("url")), F.array()).alias("tokens"))


def tested(rules: DataFrame, confidence: float, lift: float, labelled: int, blocked: int, total: int) -> DataFrame:
    """(antecedent, confidence, support) of the ``rules`` (antecedent, n, labelled, blocked: pages that hold it) that are confident, significant and more frequent among blocked pages than among all."""
    c, pages = F.col("blocked") / F.col("labelled"), F.col("labelled")
    middle, spread = c + Z * Z / (2 * pages), Z * F.sqrt((c * (1 - c) + Z * Z / (4 * pages)) / pages)
    good = (c >= confidence) & ((middle - spread) / (1 + Z * Z / pages) > SURE) & (F.col("blocked") / max(blocked, 1) >= lift * F.col("n") / max(total, 1))
    return rules.where(good).select("antecedent", c.alias("confidence"), (F.col("blocked") / max(labelled, 1)).alias("support"))


def counted(each: DataFrame, keys: tuple[str, ...], least: float) -> DataFrame:
    """Pages, labelled and blocked ones of each key that the support doesn't rule out; those that the same token sets hold have equal ``mark``."""
    mark = F.struct(F.count("*").alias("sets"), *(F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)))
    return each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), mark.alias("mark")).where(F.col("blocked") >= least)


def gathered(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df``, made once, in partitions of ``TASK_ROWS`` on average at least, and how a join takes it: broadcast if one task holds it."""
    made = cut(df)
    parts = max(math.ceil(made.count() / TASK_ROWS), 1)
    return made.coalesce(parts), F.broadcast if parts == 1 else lambda x: x


def mine(ready: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(rule_id, antecedent, confidence, support) of the rules that lead to ``block``: support and confidence among the labelled pages. Antecedents are of any length.

    FP-growth lists every subset of what frequent pages share, so what can only give covered rules is taken out before it, at no loss. Tokens that can't reach the support, or the pages that the significance test needs, go. Tokens that the same pages hold, labelled or not, are one
    token, named by the first. A token that is a rule of confidence 1 by itself covers all others with it. Then each page gives a transaction for each token t: the page's tokens that come after t by number of pages, marked with t, but for those that all of t's pages hold,
    as they add nothing to t; of those that stand for the same pages beside t the first remains, and one that makes a rule of confidence 1 with t covers all others with the two."""
    verdict = F.col("fixed.verdict")
    sets = cut(ready.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.count("*").alias("n"), F.count(verdict).alias("labelled"), F.count_if(verdict == "block").alias("blocked")).withColumn("row", F.monotonically_increasing_id()))
    total, n, blocked = (x or 0 for x in sets.agg(F.sum("n"), F.sum("labelled"), F.sum("blocked")).first())
    least = max(support * n * (1 - 1e-12), LEAST_PAGES)
    test = lambda rules: tested(rules, confidence, lift, n, blocked, total)
    pages = ("row", "n", "labelled", "blocked")

    alike = counted(sets.select(*pages, F.explode("tokens").alias("token")), ("token",), least)
    tokens, sent = gathered(alike.groupBy("n", "mark").agg(F.min("token").alias("token"), F.first("labelled").alias("labelled"), F.first("blocked").alias("blocked")))
    single = cut(test(tokens.withColumn("antecedent", F.array("token"))))
    sure = single.where("confidence = 1").select(F.element_at("antecedent", 1).alias("token"))
    unsure = tokens.join(sure, "token", "left_anti").select("token", F.struct(F.col("n").alias("n"), "token").alias("item"))
    held = sets.select(*pages, F.explode("tokens").alias("token")).join(sent(unsure), "token").groupBy("row").agg(*(F.first(c).alias(c) for c in pages[1:]), F.array_sort(F.collect_list("item")).alias("items"))
    beside = held.select(*pages, "items", F.posexplode("items").alias("at", "t")).select(*pages, "t", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))["token"]).alias("x"))

    pairs = counted(beside, ("t", "x"), least).where(F.col("n") < F.col("t.n"))
    pairs, sent = gathered(pairs.groupBy("t", "n", "mark").agg(F.min("x").alias("x"), F.first("labelled").alias("labelled"), F.first("blocked").alias("blocked")))
    double = cut(test(pairs.withColumn("antecedent", F.array_sort(F.array("t.token", "x")))).where("confidence = 1"))
    closed = F.array_sort(F.array("t.token", "x"))
    followed = pairs.join(double.select(F.col("antecedent").alias("sure")), closed == F.col("sure"), "left_anti").select("t", "x")
    each = beside.where("labelled > 0").join(sent(followed), ["t", "x"]).groupBy("row", "t").agg(F.first("labelled").alias("labelled"), F.first("blocked").alias("blocked"), F.collect_list(F.concat("t.token", F.lit(BESIDE), "x")).alias("items"))
    # kept once with how often it counts; only FP-growth, which knows no weights, sees the repeats
    both = F.array(F.struct(F.lit(BLOCK).alias("label"), F.col("blocked").alias("times")), F.struct(F.lit(ALLOW).alias("label"), (F.col("labelled") - F.col("blocked")).alias("times")))
    weighed = cut(each.select("items", F.explode(both).alias("as")).where("as.times > 0").select(F.concat("items", F.array("as.label")).alias("items"), "as.times"))
    marked = weighed.select("items", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k")).select("items")
    many = weighed.agg(F.sum("times")).first()[0] or 0
    columns = "antecedent", "confidence", "support"
    rules = single.unionByName(double)
    if many:
        from pyspark.ml.fpm import FPGrowth

        found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / many), minConfidence=confidence).fit(marked).associationRules
        plain = F.concat(F.array(F.substring_index(F.element_at("antecedent", 1), BESIDE, 1)), F.transform("antecedent", lambda x: F.substring_index(x, BESIDE, -1)))
        hits = F.round(F.col("support") * many)
        mined, sent = gathered(found.where(F.array_contains("consequent", BLOCK)).select(F.array_sort(plain).alias("antecedent"), hits.alias("blocked"), F.round(hits / F.col("confidence")).alias("labelled")).withColumn("rule_id", F.xxhash64("antecedent")))
        met = sets.select("tokens", "n", F.explode("tokens").alias("token")).join(sent(index(mined, sets, sent)), "token").where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("rule_id").agg(F.sum("n").alias("n"))
        rules = rules.unionByName(test(mined.join(met, "rule_id")))
    return uncovered(gathered(rules.withColumn("rule_id", F.xxhash64("antecedent")).select("rule_id", *columns))[0])


def uncovered(rules: DataFrame) -> DataFrame:
    """``rules`` without those that a more general one covers with no less confidence. Shorter rules are settled first: what covers a covered rule covers all that it covers, so longer ones are held against the kept ones only."""
    lengths = sorted(r["n"] for r in rules.select(F.size("antecedent").alias("n")).distinct().collect())
    columns = ("rule_id", "antecedent", "confidence", "support")
    kept = rules.where(F.size("antecedent") == lengths[0]).select(*columns) if lengths else rules.select(*columns)
    for n in lengths[1:]:
        own = rules.where(F.size("antecedent") == n)
        general = kept.select(F.col("antecedent").alias("g_antecedent"), F.col("confidence").alias("g_confidence"), F.element_at("antecedent", 1).alias("t"))
        covered = own.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("t")).join(general, "t").where((F.size(F.array_except("g_antecedent", "antecedent")) == 0) & (F.col("g_confidence") >= F.col("confidence"))).select("rule_id").distinct()
        kept, _ = gathered(kept.unionByName(own.join(covered, "rule_id", "left_anti").select(*columns)))
    return kept


def index(rules: DataFrame, sets: DataFrame, sent: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(token, antecedent, rule_id): each rule under the token that the fewest of ``sets`` hold."""
    used = rules.select("rule_id", F.explode("antecedent").alias("token"))
    counts = sets.select(F.explode("tokens").alias("token")).join(sent(used.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return sent(used).join(counts, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token")).join(sent(rules), "rule_id").select("token", "antecedent", "rule_id")


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule that blocked the page, if one did."""
    ready = prepared(pages, rules)
    rules_, sent = gathered(mine(ready))
    filed = cut(index(rules_, ready, sent))
    filed = F.broadcast(filed) if filed.limit(MAX_RULES + 1).count() <= MAX_RULES else filed
    sets = ready.where(F.col("fixed").isNull()).select("tokens").distinct()
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(filed, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    judged = ready.join(met.groupBy("tokens").agg(F.min(F.array_join("antecedent", "+")).alias("mined")), "tokens", "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fixed").isNull(), F.col("mined")).alias("mined"))


def op10_association_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
