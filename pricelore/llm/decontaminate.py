"""Operator 3: benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only.

An item's sketch row j is the shingle that has the least value under hash function j; a document agrees with the row if it holds that shingle, which happens with the chance
of the containment |item and document| / |item| however long the document is (the containment form of MinHash; plain signatures of a short item and a long document hardly ever agree). Items
are partitioned by size: each size class has its own number of rows and its own count of rows that must agree, set so that less than ``MISS`` of the pairs at the threshold are missed. Candidates are
then verified by the exact containment of shingle sets.

Shingles are runs of five words; words are maximal runs of letters and digits of the lower-cased text. Edge cases: null and empty texts and items of fewer than five words match nothing; repeated
rows of documents count once per doc_id (their shingles together), rows without doc_id or item_id are left out; a very long text is looked up shingle by shingle like any other; an item
that several documents hold is found in each, and of several items in a document each has its row, so there are no ties to settle; empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import cut, table

WIDTH, THRESHOLD, MISS = 5, 0.8, 1e-6
#: Most shingles of an item in each size class, and the sketch rows of the class.
CLASSES = ((8, 12), (32, 16), (128, 20), (1 << 62, 24))
#: Rows of up to 32 bytes that are broadcast at most; more go through a shuffle join.
BROADCAST_ROWS = 2_000_000


def needed(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The most rows that can be asked to agree if at most ``miss`` of the pairs at the threshold may have fewer."""
    total = 0.0
    for n in range(rows + 1):
        total += comb(rows, n) * threshold**n * (1 - threshold) ** (rows - n)
        if total > miss:
            return max(n, 1)
    return rows


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def with_shingles(df: DataFrame, id_: str) -> DataFrame:
    """(id, shingles): the hashes of the runs of five words, repeats included. The outer ``transform`` over one element only names the words, so that they are cut out once."""

    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH)))))

    return df.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias(id_), F.element_at(F.transform(F.array(words(F.col("text"))), runs), 1).alias("shingles"))


def exploded(df: DataFrame, id_: str) -> DataFrame:
    """(id, shingle). The outer form keeps Spark from computing the shingles once more to test that there are any."""
    return with_shingles(df, id_).select(id_, F.explode_outer("shingles").alias("shingle"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (checkpointed) for a broadcast join if it has few rows; else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of all pairs with at least the threshold."""
    item = cut(exploded(items, "item_id").where("shingle IS NOT NULL").distinct())
    sizes = item.groupBy("item_id").agg(F.count("*").alias("n_item"))
    group = F.lit(len(CLASSES) - 1)
    for k in reversed(range(len(CLASSES) - 1)):
        group = F.when(F.col("n_item") <= CLASSES[k][0], k).otherwise(group)
    rows = F.element_at(F.array(*(F.lit(r) for _, r in CLASSES)), group + 1)
    agree = F.element_at(F.array(*(F.lit(needed(r, threshold)) for _, r in CLASSES)), group + 1)
    sized = item.join(sizes, "item_id").withColumn("j", F.explode(F.sequence(F.lit(1), rows)))
    sketch = sized.groupBy("item_id", "j").agg(F.min_by("shingle", F.xxhash64("shingle", "j")).alias("shingle"), F.first(agree).alias("agree"))
    sketch = cut(sketch.groupBy("item_id", "shingle").agg(F.count("*").alias("weight"), F.first("agree").alias("agree")))

    held = exploded(docs, "doc_id")
    met = held.join(small(sketch), "shingle").groupBy("doc_id", "item_id", "shingle").agg(F.first("weight").alias("weight"), F.first("agree").alias("agree"))
    candidates = cut(met.groupBy("doc_id", "item_id").agg(F.sum("weight").alias("n"), F.first("agree").alias("agree")).where("n >= agree").select("doc_id", "item_id"))

    again = docs.join(small(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
    mine = exploded(again, "doc_id").join(small(item), "shingle").distinct()
    shared = mine.join(candidates, ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    out = shared.join(small(sizes), "item_id")
    return out.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")).where(F.col("n_shared") >= threshold * F.col("n_item"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without doc_id stay."""
    hit = cut(find(docs, items, threshold).select("doc_id").distinct())
    return docs.join(small(hit), "doc_id", "left_anti").select(*docs.columns)


def op3_containment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", F.round("containment", 6).alias("containment"))


OP3_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
"""
