"""Operator 4: secrets, by patterns and by two character Markov models. DataFrame functions only.

Base kinds are plain patterns. The method adds the kind ``markov``: a run of 16 or more token characters whose log-likelihood ratio between a first-order model of random strings and one of ordinary
identifiers passes ``MEAN`` nats a step and ``TOTAL`` nats, and that touches no base span. Both models come from labelled samples: the strings that the base patterns find in a bounded
sample of documents (``SAMPLE_DOCS``) and strings drawn from hashes (``DRAWN`` of each alphabet) are random; the sample's other tokens and names put together from ``IDENTIFIER_WORDS`` are ordinary.

Edge cases: a null text counts as empty and has no spans; repeated rows and null doc_ids give results like any other row; spans that begin at one place are in order of their kind; the places of a very long text's matches are summed up by chunks, so that the work
grows with their number, and with its square only by the number of chunks; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run of so many characters is what the plain run has if it is long enough.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
KINDS = ("assign", "access", "hex", "markov")
SAMPLE_DOCS, DRAWN = 4000, 1500
#: Matches that are put together at once, and the pairs that a training token counts for at most: those of a longer one (long runs of one alphabet, such as embedded images) share that weight, so that it doesn't outweigh all others.
CHUNK, TOKEN_WEIGHT = 256, 400
MEAN, TOTAL, PRIOR = 2.4, 36.0, 4.0

#: Words of ordinary identifiers; pairs of them are joined by rule in the usual styles.
IDENTIFIER_WORDS = "account action address application array attribute batch buffer builder cache callback channel client color column command common config connection container content context controller counter create current data database default delete description directory document element encoding entity error event factory field file filter format function group handler header height index information initial input instance interface internationalization item iterator key language length level library list listener local location manager map maximum memory message method minimum model module name network node number object offset option order output package page parameter parser password path pattern position previous process property provider query range record reference register remote request resource response result return row schema search secret section select sequence server service session setting source start state status storage stream string table target template text thread timeout token transaction type update user utility validation value variable vector version view widget width window writer".split()

SPANS = "array<struct<start: int, rank: int, end_: int, value: string>>"


def place(c: Column) -> Column:
    """The place of a character in the alphabet, from 1; 0 for others."""
    return F.call_function("locate", c, F.lit(ALPHABET))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, whatever lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunked(items: Column) -> Column:
    """An array in arrays of ``CHUNK``, in order; each element is fetched by its place, so that this is linear."""

    def cut_up(x: Column) -> Column:
        n = F.size(x)
        numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda k: F.transform(F.sequence(k * CHUNK + 1, F.least((k + 1) * CHUNK, n)), lambda i: F.element_at(x, i)))

    return bound(items, cut_up)


def matches(text: Column, pattern: str, rank: int, value: int = 0) -> Column:
    """The leftmost, non-overlapping matches with their places, in code points. What stands between matches comes from ``split``, so starts are sums of lengths: those of whole chunks first, then on within each, so that no long array is copied for each match."""
    between = F.split(text, pattern, -1)
    found = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value"), between.alias("gap")), lambda x: x["whole"].isNotNull())
    none = F.array().cast(SPANS)
    length = lambda x: F.length(x["gap"]) + F.length(x["whole"])

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end_"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def within(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def walk(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + length(x)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return bound(starts, lambda at: F.flatten(F.transform(chunks, lambda c, k: within(c, F.element_at(at, k + 1)))))

    return F.when(text.rlike(pattern), bound(chunked(found), walk)).otherwise(none)


def touches(spans: Column):
    """A function that says whether a span overlaps one of ``spans``, which are sorted: by the chunks' extent, then within those that reach it."""
    held = F.transform(chunked(spans), lambda c: F.struct(F.array_min(F.transform(c, lambda s: s["start"])).alias("low"), F.array_max(F.transform(c, lambda s: s["end_"])).alias("high"), c.alias("items")))

    def use(extents: Column, s: Column) -> Column:
        return F.exists(extents, lambda e: (e["low"] < s["end_"]) & (s["start"] < e["high"]) & F.exists(e["items"], lambda b: (b["start"] < s["end_"]) & (s["start"] < b["end_"])))

    return held, use


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 8)
    return F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2))


def samples(docs: DataFrame) -> DataFrame:
    """(label, token): 1 for random strings, 0 for ordinary ones."""
    spark = docs.sparkSession
    chosen = docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    text = F.coalesce("text", F.lit(""))
    seen = docs.join(F.broadcast(chosen), "doc_id").select(text.alias("text"))
    flagged = seen.select(F.explode(base_spans(F.col("text"))).alias("s")).select(F.lit(1).alias("label"), F.col("s.value").alias("token"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = seen.select(F.explode(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("token")).select(F.lit(0).alias("label"), "token")
    key = F.sha2(F.col("id").cast("string"), 256)
    drawn = spark.range(DRAWN).select(F.explode(F.array(key, F.upper(F.substring(F.conv(F.substring(key, 1, 14), 16, 36), 1, 10)), F.substring(F.base64(F.unhex(key)), 1, 40))).alias("token")).select(F.lit(1).alias("label"), "token")
    n = len(IDENTIFIER_WORDS)
    pair = spark.createDataFrame([(w, IDENTIFIER_WORDS[(k + step) % n]) for k, w in enumerate(IDENTIFIER_WORDS) for step in range(1, 13)], "w string, w2 string")
    styles = F.array(F.concat_ws("_", "w", "w2"), F.concat_ws("-", "w", "w2"), F.concat("w", F.initcap("w2")), F.concat(F.initcap("w"), F.initcap("w2")), F.upper(F.concat_ws("_", "w", "w2")))
    names = pair.select(F.lit(0).alias("label"), F.explode(styles).alias("token"))
    return flagged.unionByName(ordinary).unionByName(drawn).unionByName(names)


def fit(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios by the places of two neighbouring characters in the alphabet; at most SIZE * SIZE counts reach the driver."""
    weight = F.least(F.lit(1.0), TOKEN_WEIGHT / (F.length("token") - 1)).cast("decimal(20,9)")  # its sums don't depend on the order of rows
    pairs = samples(docs).where(F.length("token") >= 2).select("label", weight.alias("weight"), F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))")).alias("pair"))
    rows = pairs.groupBy("label", "pair").agg(F.sum("weight").alias("n")).select("label", place(F.substring("pair", 1, 1)).alias("a"), place(F.substring("pair", 2, 1)).alias("b"), "n").collect()
    count = {(r["label"], r["a"], r["b"]): float(r["n"]) for r in rows}
    before: dict = {}
    single: dict = {}
    for (label, a, b), n in count.items():
        before[label, a] = before.get((label, a), 0) + n
        single[label, b] = single.get((label, b), 0) + n
    whole = [sum(n for (own, _), n in single.items() if own == label) for label in (0, 1)]

    def chance(label: int, a: int, b: int) -> float:
        """Of a pair, smoothed by the second character's own frequency, and that by an even one."""
        alone = (single.get((label, b), 0) + 0.5) / (whole[label] + 0.5 * (SIZE - 1))
        return math.log((count.get((label, a, b), 0) + PRIOR * alone) / (before.get((label, a), 0) + PRIOR))

    return [round(chance(1, a, b) - chance(0, a, b), 6) if a and b else 0.0 for a in range(SIZE) for b in range(SIZE)]


def ratio(token: Column, weights: Column) -> Column:
    """The summed log-likelihood ratio of a token."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        more = F.when(s["last"] >= 0, F.element_at(weights, s["last"] * SIZE + place(c) + 1)).otherwise(0.0)
        return F.struct(place(c).alias("last"), (s["sum"] + more).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda s: s["sum"])


def scan(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """(doc_id, base, spans): both arrays of (start, rank, end_, value), ordered by start and kind."""
    weights = fit(docs) if weights is None else weights
    table_ = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    found = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", base_spans(F.col("text")).alias("base"), matches(F.col("text"), TOKEN, 3).alias("tokens"))

    def odd(s: Column) -> Column:
        length = F.length(s["value"])
        score = ratio(s["value"], table_)
        return score >= F.greatest(F.lit(TOTAL), MEAN * (length - 1))

    extents, inside = touches(F.array_sort("base"))
    free = bound(extents, lambda e: F.filter("tokens", lambda s: odd(s) & ~inside(e, s)))
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", free)).alias("spans"))


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end_"])), ",")


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(3)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
