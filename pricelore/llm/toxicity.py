"""Operator 6: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other sampled texts are unlabelled, whether someone called them harmless or not. A linear model over the
presence of words is fitted with numpy to the risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` (Kiryo et al., 2017), and a logistic map, fitted on the
training folds' labels, turns its output into the chance of label 1.

The fit reads a bounded sample (``MAX_POSITIVE``, ``MAX_UNLABELLED`` documents, chosen by the hash of their id, all if there are fewer); scoring reads every text.
Edge cases: a null text counts as empty, and empty texts get the score of a text without any known word; without positives in the training folds every score is the
training labels' rate of 1 (0 without labels); repeated rows are scored alike, and a repeated doc_id is one document of the sample, with the least of its texts and the highest of its labels; null doc_ids are scored but never learnt from;
words of equal weight go by their spelling; a very long text is scored from all its words; an empty table gives no rows; columns other than doc_id and text are no input, and ``harmless`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import cut, table, text_slices

MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
#: Words that are kept: the most telling ones that at least MIN_DOCS positives hold.
MAX_WORDS, MIN_DOCS = 4000, 3
CUT = 0.3
SLICE_CHARS = 2_000_000
#: What counts as a word, in the fit (Java) and in the scores (Python) alike.
WORD = r"[\p{L}\p{M}\p{N}_]+"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def nnpu(rows_p: list[np.ndarray], rows_u: list[np.ndarray], n_words: int, prior: float, epochs: int = 250, rate: float = 0.05, l1: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias. Rows hold the numbers of the words that are present."""

    def flat(rows):
        sizes = np.array([len(r) for r in rows])
        return np.repeat(np.arange(len(rows)), sizes), np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64), len(rows)

    data = {"p": flat(rows_p), "u": flat(rows_u)}
    w, b = np.zeros(n_words), np.log(prior / (1 - prior))
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    out = lambda k: np.bincount(data[k][0], weights=w[data[k][1]], minlength=data[k][2]) + b
    loss = lambda z: np.logaddexp(0, -z)

    def back(k, g):
        return np.append(np.bincount(data[k][1], weights=g[data[k][0]], minlength=n_words), g.sum())

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, epochs + 1):
        p, u = out("p"), out("u")
        negative = loss(-u).mean() - prior * loss(-p).mean()
        on_negative = back("u", sigmoid(u) / len(u)) - prior * back("p", sigmoid(p) / len(p))
        # below zero the unlabelled part is overfitted: only undo that
        g = prior * back("p", -sigmoid(-p) / len(p)) + on_negative if negative >= 0 else -on_negative
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of sigmoid(a z + b) by Newton's method, with a small ridge and a not below 0."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        s, r = np.maximum(p * (1 - p), 1e-9), p - y
        grad = np.array([r @ z + 1e-3 * a, r.sum() + 1e-3 * b])
        hess = np.array([[s @ (z * z) + 1e-3, s @ z], [s @ z, s.sum() + 1e-3]])
        d = np.linalg.solve(hess, grad)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return max(a, 0.0), b


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model as plain values: words with weights, bias, and the two calibration values."""
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = seen.agg(F.avg("toxic"), F.count("*")).first()
    if not rate[0]:
        return {"words": {}, "bias": 0.0, "a": 0.0, "b": -40.0}
    prior = min(max(float(rate[0]), 0.01), 0.9)
    unknown = {"words": {}, "bias": 0.0, "a": 0.0, "b": float(np.log(prior / (1 - prior)))}
    order = F.xxhash64(F.col("doc_id"))
    positive = seen.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_POSITIVE).select("doc_id", F.lit("p").alias("part"), F.lit(1).alias("toxic"))
    # each id once: a repeated one has one place in the sample
    others = cut(docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).select("doc_id").distinct().orderBy(order, "doc_id").limit(MAX_UNLABELLED))
    judged_others = others.join(F.broadcast(seen.join(F.broadcast(others), "doc_id")), "doc_id", "left").select("doc_id", F.lit("u").alias("part"), "toxic")
    chosen = cut(positive.unionByName(judged_others))
    text = F.coalesce("text", F.lit(""))
    sampled = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min(text).alias("text"))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    # written once, so that the rows keep their numbers whatever executor is lost
    words = cut(sampled.join(F.broadcast(chosen), "doc_id").select(F.monotonically_increasing_id().alias("row"), "part", "toxic", found.alias("words")))
    rows = words.select("row", "part", "toxic").collect()  # the bounded sample, without its texts
    n_p, n_u = (sum(r["part"] == part for r in rows) for part in "pu")
    if not n_u or not n_p:
        return unknown
    each = words.select("row", "part", F.explode("words").alias("word"))
    count = each.groupBy("word").agg(F.count_if(F.col("part") == "p").alias("p"), F.count_if(F.col("part") == "u").alias("u"))
    gain = F.log((F.col("p") + 0.5) / (n_p + 1)) - F.log((F.col("u") + 0.5) / (n_u + 1))
    top = count.where(F.col("p") >= MIN_DOCS).withColumn("telling", F.col("p") * F.abs(gain)).where(F.abs(gain) > 0.7).orderBy(F.desc("telling"), "word").limit(MAX_WORDS)
    known = {r["word"]: k for k, r in enumerate(top.select("word").collect())}
    if not known:
        return unknown
    numbers = words.sparkSession.range(1).select(F.posexplode(F.split(F.lit("\n".join(known)), "\n")).alias("number", "word"))  # a word holds no line feed
    # as Arrow: Python lists of the sample's words would hold a multiple of their size in the driver
    held = each.join(F.broadcast(numbers), "word").groupBy("row").agg(F.array_sort(F.collect_list("number")).alias("numbers")).toArrow()
    lists = held["numbers"].combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    has = {r: values[a:b] for r, a, b in zip(held["row"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
    none = np.zeros(0, dtype=np.int64)
    number = lambda part: [has.get(r["row"], none) for r in rows if r["part"] == part]
    w, b = nnpu(number("p"), number("u"), len(known), prior)
    judged = [r for r in rows if r["part"] == "u" and r["toxic"] is not None]
    z = np.array([b + w[has.get(r["row"], none)].sum() for r in judged])
    y = np.array([float(r["toxic"]) for r in judged])
    a, c = calibrate(z, y) if 0 < y.sum() < len(y) else (1.0, 0.0)
    return {"words": {x: float(w[k]) for x, k in known.items() if w[k]}, "bias": float(b), "a": float(a), "b": float(c)}


def _scorer(model: dict):
    find, weights, known = regex.compile(WORD).findall, model["words"], frozenset(model["words"])

    def run(texts: list[str | None]) -> np.ndarray:
        z = np.array([model["bias"] + sum(weights[w] for w in sorted(known.intersection(find((t or "").lower())))) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(model["a"] * z + model["b"], -40, 40)))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score for every row, from the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), SLICE_CHARS):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(scorer(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def harmless(docs: DataFrame, model: dict, least: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text"), SLICE_CHARS):
                yield batch.slice(a, b - a).filter(pa.array(scorer(texts) < least))

    return docs.mapInArrow(run, docs.schema)


def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
