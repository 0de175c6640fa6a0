"""A kept index of search documents: postings of words, and the words under what is left of them without one or two characters, in buckets that an update changes only where its documents are.

A query reads the buckets of its terms' keys, compares the words found there with the terms, and reads the postings of those that are near: no other word of the corpus. Results are those of ``insight.field_search`` over the same documents.

Below a path there are four tables (``sources.versions`` keeps their versions): ``postings`` by word, ``keys`` by key, ``documents`` by id (what of a document is in the others), and ``fields``, sums of the fields' sizes by what searches filter by.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.operators import insight as I
from pricelore.functions import values as V
from pricelore.shared import reliable
from pricelore.sources import versions

BUCKETS = 64
#: Words are cut to so many characters before characters are left out: two words within two edits still share a key.
PREFIX = 8
#: Near words that are named in the scan of the postings; more of them are joined.
NAMED = 1000
POSTINGS = "word string, document_id string, field string, weight double, tf long, size int, platform string, quality_flags string, crawled_on string, current_price long"
KEYS = "key string, word string"
DOCUMENTS = "document_id string, platform string, quality_flags string, fields array<struct<field: string, size: int>>, words array<string>"
FIELDS = "field string, platform string, quality_flags string, docs long, size long"


def bucket_of(text: Column) -> Column:
    return F.pmod(F.crc32(F.encode(text, "utf-8")), F.lit(BUCKETS)).cast("int")


def _bucket(text: str) -> int:
    return zlib.crc32(text.encode()) % BUCKETS


def keys_of(word: Column) -> Column:
    """The beginning of a word, and that without one or two of its characters: as many as words of that length may lack."""
    start = F.substring(word, 1, PREFIX)
    shorter = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    one = F.when(F.length(word) >= 2, shorter(start)).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length(word) >= 4, F.flatten(F.transform(one, shorter))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(start), one, two))


def _keys_of(term: str) -> set[str]:
    """The keys of a query's term, for the edits that it is allowed."""
    start, edits = term[:PREFIX], 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2
    return {"".join(c for k, c in enumerate(start) if k not in left) for n in range(edits + 1) for left in combinations(range(len(start)), min(n, len(start)))}


def _filtered(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that searches filter and sort by."""
    has = {"platform": F.lit(None).cast("string"), "quality_flags": F.lit("")} | {c: F.col(c) for c in ("platform", "quality_flags") if c in docs.columns}
    return docs.withColumns({"platform": has["platform"], "quality_flags": F.coalesce(has["quality_flags"], F.lit("")), "current_price": F.col("current_price").cast("long")})


def update(spark: SparkSession, path: str, docs: DataFrame, gone: DataFrame | None = None) -> int:
    """Puts documents (``insight.documents``) into the index below ``path`` in place of those with the same id, and takes out those of ``gone`` (document_id). Repeated ids count once. Only the buckets that hold their old or new words are read and written."""
    now = versions.current(spark, path)
    here = _filtered(docs).dropDuplicates(["document_id"])
    each = reliable(I.field_words(here, I.FIELDS, "platform", "quality_flags", "crawled_on", "current_price"))
    ids = here.select("document_id") if gone is None else here.select("document_id").unionByName(gone.select(F.col("document_id").cast("string"))).distinct()
    ids = reliable(ids.withColumn("bucket", bucket_of(F.col("document_id"))))
    id_buckets = _numbers(ids)
    known = versions.read(spark, path, "documents", DOCUMENTS, id_buckets, now)
    old = reliable(known.join(ids.select("document_id"), "document_id", "left_semi"))

    new_words = each.select(F.explode("words").alias("word"))
    words = reliable(new_words.unionByName(old.select(F.explode("words").alias("word"))).distinct().withColumn("bucket", bucket_of(F.col("word"))))
    word_buckets = _numbers(words)
    fresh = each.select("document_id", "field", "weight", F.size("words").alias("size"), "platform", "quality_flags", "crawled_on", "current_price", F.explode("words").alias("word")).groupBy("word", "document_id", "field", "weight", "size", "platform", "quality_flags", "crawled_on", "current_price").agg(F.count("*").alias("tf"))
    order = [c.split()[0] for c in POSTINGS.split(", ")]
    postings = versions.read(spark, path, "postings", POSTINGS, word_buckets, now).join(ids.select("document_id"), "document_id", "left_anti").select(*order).unionByName(fresh.select(*order)).withColumn("bucket", bucket_of(F.col("word")))

    made = each.groupBy("document_id").agg(F.first("platform").alias("platform"), F.first("quality_flags").alias("quality_flags"), F.collect_list(F.struct("field", F.size("words").alias("size"))).alias("fields"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    documents = known.join(ids.select("document_id"), "document_id", "left_anti").unionByName(made).withColumn("bucket", bucket_of(F.col("document_id")))

    keyed = reliable(new_words.distinct().select(F.explode(keys_of(F.col("word"))).alias("key"), "word").withColumn("bucket", bucket_of(F.col("key"))))
    key_buckets = _numbers(keyed)
    keys = versions.read(spark, path, "keys", KEYS, key_buckets, now).withColumn("bucket", bucket_of(F.col("key"))).unionByName(keyed).distinct()

    sums = lambda df, sign: df.select("platform", "quality_flags", F.explode("fields").alias("f")).select("f.field", "platform", "quality_flags", F.lit(sign).cast("long").alias("docs"), (sign * F.col("f.size")).cast("long").alias("size"))
    fields = versions.read(spark, path, "fields", FIELDS, now=now).unionByName(sums(made, 1)).unionByName(sums(old, -1)).groupBy("field", "platform", "quality_flags").agg(F.sum("docs").alias("docs"), F.sum("size").alias("size")).where("docs > 0")
    return versions.publish(spark, path, {"fields": fields}, {"postings": (postings, word_buckets), "documents": (documents, id_buckets), "keys": (keys, key_buckets)})


def _numbers(df: DataFrame) -> list[int]:
    return sorted(r["bucket"] for r in df.select("bucket").distinct().collect())  # ``BUCKETS`` at most


def near_words(spark: SparkSession, path: str, terms: Iterable[str], now: dict) -> DataFrame:
    """(word, term) of the index' words within the edits that each term allows."""
    keys = sorted(set().union(*map(_keys_of, terms)))
    found = versions.read(spark, path, "keys", KEYS, sorted({_bucket(k) for k in keys}), now).where(F.col("key").isin(keys)).select("word").distinct()
    asked = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
    return found.join(asked, F.levenshtein("word", "term") <= I.allowed_edits(F.col("term")))


def matching(spark: SparkSession, path: str, query: str, platforms: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, score, crawled_on, current_price) of all documents that a query finds."""
    terms = I.asked_terms(query)
    out = "document_id string, crawled_on string, current_price long, score double"
    if not terms:
        return spark.createDataFrame([], out)
    now = versions.current(spark, path)
    near = reliable(near_words(spark, path, terms, now))
    listed = near.limit(NAMED + 1).collect()
    words = sorted({r["word"] for r in listed})
    buckets = _numbers(near.withColumn("bucket", bucket_of(F.col("word")))) if len(listed) > NAMED else sorted(set(map(_bucket, words)))
    postings = I.searchable(versions.read(spark, path, "postings", POSTINGS, buckets, now), query, platforms) if buckets else spark.createDataFrame([], POSTINGS)
    postings = postings.where(F.col("word").isin(words)) if len(listed) <= NAMED else postings
    hits = postings.join(near, "word").groupBy("document_id", "crawled_on", "current_price", "field", "weight", "size", "term").agg(F.sum("tf").alias("tf"))
    stats = I.searchable(versions.read(spark, path, "fields", FIELDS, now=now), query, platforms).groupBy("field").agg((F.sum("size") / F.sum("docs")).alias("mean"), F.sum("docs").alias("docs"))
    return I.best_fields(hits, stats, len(terms), "crawled_on", "current_price")


def totals(found: DataFrame) -> DataFrame:
    """(total, lowest, average, latest) of the found documents: of their prices in one pass, and in a second one of those from the floor on (a share of the median) only if the least price is below it."""
    least, mean = F.coalesce(F.min("current_price"), F.lit(0)), F.coalesce(F.round(F.avg("current_price")).cast("long"), F.lit(0))
    one = found.agg(F.count("*").alias("total"), least.alias("lowest"), mean.alias("average"), F.max("crawled_on").alias("latest"), F.percentile("current_price", F.lit(0.5)).alias("median")).first()
    values = (one["lowest"], one["average"], one["latest"])
    if one["median"] is not None:
        floor = max(V.LOWEST_PRICE, round(one["median"] * V.FLOOR_RATIO))
        if 0 < one["lowest"] < floor:
            above = found.where(F.col("current_price") >= floor).agg(least, mean, F.max("crawled_on")).first()
            values = tuple(above) if above[0] else values
    return found.sparkSession.createDataFrame([(one["total"], *values)], "total long, lowest long, average long, latest string")


def find(spark: SparkSession, path: str, query: str, limit: int = 20, platforms: tuple[str, ...] = (), sort: str = "relevance", page: int = 1) -> tuple[DataFrame, DataFrame]:
    """(page, totals) of a query: the postings are read once."""
    found = reliable(matching(spark, path, query, platforms))
    return I.page_of(found, sort, page, limit), totals(found)
