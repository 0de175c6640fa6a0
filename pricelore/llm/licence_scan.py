"""Operator 2: licence scan by a trained paragraph classifier. DataFrame functions and Spark ML only.

A paragraph is a line. The word one- and two-grams of its windows are hashed into sparse vectors, and a multinomial logistic regression (elastic net) tells ordinary text, each licence family, and notices of
unknown licences apart. It is trained from notices that are made by rule from ``FAMILIES`` and ``FRAMES``, from the paragraphs of the licences' own texts (whole, in windows, and in pieces of a wrapped line's length), from made-up licence names, and from a bounded
sample of the corpus' lines (``SAMPLE_LINES``) that hold no piece of a licence text. The unknown class learns from names of other licences and made-up ones; the chances are calibrated by a temperature that is chosen on a held-out fold, to which whole licence
families belong that the fit has never seen.

A predicted family is confirmed if one of its names' two-grams are contained in the window to ``CONFIRM`` at least. A window that shares ``CONFIRM`` of its three-word shingles with a paragraph of a licence text, of the smaller of the two, is of that text's family,
whatever was predicted. What is not confirmed or has too little chance is ``unknown``.

Every line of every text is scored, in windows of ``WINDOW`` words that overlap by ``OVERLAP`` and cover the whole line; its best window is reported. Training lines are cut into the same windows, and each has a twin with a notice or a piece of a licence text put
into it. Edge cases: null and empty texts have no lines; repeated rows and null doc_ids give results like any other; a line's windows of equal worth are told apart by their
family's name; a very long line has as many windows as it needs; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import cut, table
from pricelore.llm.licence_texts import TEXTS

if TYPE_CHECKING:
    from pyspark.ml.classification import LogisticRegressionModel

#: Names of licences by family.
FAMILIES = {
    "mit": ["MIT License", "MIT Licence", "Expat License", "MIT"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "BSD-3-Clause", "New BSD License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL-3.0-or-later", "GPL-2.0", "GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["GNU Lesser General Public License", "LGPL-2.1", "GNU LGPL, version 3"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License"],
    "cc": ["CC BY 4.0", "CC BY-NC 4.0", "CC BY-SA 3.0", "CC BY-NC-SA 4.0", "CC0 1.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-NonCommercial license"],
}
FRAMES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This file is distributed under the terms of the {}.", "This program is available under {}; see the file LICENSE.", "SPDX-License-Identifier: {}", "You may use this software under the {}.", "The code is covered by the {} license."]
#: Names of licences of other families. The first ones teach what an unknown licence is; the last ones are held out with their families, for the temperature and the calibration error.
OTHER_LICENCES = ["Eclipse Public License 2.0", "Artistic License 2.0", "zlib License", "ISC License", "Common Development and Distribution License", "Academic Free License 3.0", "Microsoft Public License"]
HELD_OUT_LICENCES = ["European Union Public Licence 1.2", "Boost Software License 1.0", "Zope Public License 2.1", "Open Software License 3.0"]
UNKNOWN_NAMES = ["Acme Shared Source License", "House Terms, version 1", "Sample Public Licence", "Garden Community License 2.1", "proprietary license of the owner", "Internal Use Licence"]
NONE, UNKNOWN = "none", "unknown"
CLASSES = [NONE, UNKNOWN, *FAMILIES]
SAMPLE_DOCS, SAMPLE_LINES = 1500, 6000
FEATURES, CONFIRM, LEAST = 1 << 15, 0.5, 0.5
#: Words of a shingle, shingles that a confirming overlap holds at least, and words of a training piece of a licence text and from one piece to the next.
SHINGLE, LEAST_SHINGLES, PIECE, PIECE_STEP = 3, 6, 12, 8
#: Words of a window and those that it shares with the next: a wording of up to ``OVERLAP`` words is whole in one of them.
WINDOW, OVERLAP = 64, 24


def words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def grams(line: Column) -> Column:
    return word_grams(words(line))


def word_grams(w: Column) -> Column:
    """One- and two-grams; the outer transform names the words, so that they are cut out once."""

    def both(w: Column) -> Column:
        return F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))

    return F.element_at(F.transform(F.array(w), both), 1)


def windows(line: Column) -> Column:
    """The words of a line in overlapping windows that cover all of it."""

    def cut_up(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - OVERLAP, F.lit(1)), F.lit(WINDOW - OVERLAP))
        return F.transform(starts, lambda k: F.slice(w, k, WINDOW))

    return F.element_at(F.transform(F.array(words(line)), cut_up), 1)


def shingles(w: Column) -> Column:
    """The distinct three-word shingles of words ``w``."""
    n = F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))
    pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.zip_with(pairs, F.slice(w, SHINGLE, n), lambda a, b: F.concat_ws(" ", a, b)))


def licence_shingles(spark: SparkSession) -> DataFrame:
    """(text_family, text_shingles) of the paragraphs of the licences' texts."""
    made = spark.createDataFrame([(f, t) for f, texts in TEXTS.items() for t in texts], "text_family string, text string")
    return made.select("text_family", shingles(words(F.col("text"))).alias("text_shingles"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the lines with words."""
    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), F.posexplode_outer(F.split("text", r"[\r\n]+")).alias("line_no", "line"))


def notices(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(line, family): the notices made by rule; only those of unknown ``names`` if there are any."""
    families = [*FAMILIES.items(), (UNKNOWN, [*UNKNOWN_NAMES, *OTHER_LICENCES])] if names is None else [(UNKNOWN, names)]
    made = [(frame.format(name), family) for family, own in families for name in own for frame in FRAMES]
    if names is None:
        made += [(piece, family) for family, texts in TEXTS.items() for text in texts for piece in pieces(text)]
    return spark.createDataFrame(made, "line string, family string")


def pieces(text: str) -> list[str]:
    """A licence paragraph, and what its lines hold when it is wrapped."""
    w = text.split()
    return list(dict.fromkeys([text, *(" ".join(w[k : k + PIECE]) for k in range(0, max(len(w) - PIECE + PIECE_STEP, 1), PIECE_STEP))]))


def embedded(plain: DataFrame, made: DataFrame) -> DataFrame:
    """(line, family): each window of ``plain`` with a row of ``made`` put into it at a place drawn by its hash, as long as a window at most."""
    listed = made.agg(F.sort_array(F.collect_list(F.struct("line", "family"))).alias("made"))  # some hundreds of rows, made by rule
    w, n = F.col("w"), F.col("n")
    drawn = plain.crossJoin(F.broadcast(listed)).select(words(F.col("line")).alias("w"), F.element_at("made", (F.pmod(F.xxhash64("line"), F.size("made")) + 1).cast("int")).alias("m"), F.xxhash64("line", F.lit(1)).alias("hash"))
    room = F.greatest(F.lit(WINDOW) - F.size(words(F.col("m.line"))), F.lit(8))
    placed = drawn.select(F.slice(F.col("w"), 1, room).alias("w"), "m", "hash").select("w", "m", F.pmod("hash", F.size("w") + 1).cast("int").alias("n"))
    return placed.select(F.concat_ws(" ", F.slice(w, 1, n), F.col("m.line"), F.slice(w, n + 1, WINDOW)).alias("line"), F.col("m.family").alias("family"))


def training_rows(docs: DataFrame) -> DataFrame:
    """(label, features, held): the rows of the fit. Held out are a quarter of the rows by their hash, and the licence families of ``HELD_OUT_LICENCES`` whole."""
    from pyspark.ml.feature import HashingTF

    spark = docs.sparkSession
    chosen = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    notice = r"(?i)licen[sc]e|copyright|spdx"
    plain = lines(docs.join(F.broadcast(chosen), "doc_id")).where(~F.col("line").rlike(notice)).select(F.explode(windows(F.col("line"))).alias("w")).where(F.size("w") > 0).select(F.array_join("w", " ").alias("line")).orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES)
    known = F.broadcast(licence_shingles(spark).agg(F.array_distinct(F.flatten(F.collect_list("text_shingles"))).alias("known")))
    plain = cut(plain.crossJoin(known).where(F.size(F.array_intersect(shingles(words(F.col("line"))), "known")) < LEAST_SHINGLES).select("line", F.lit(NONE).alias("family")))
    made = notices(spark)
    rows = made.unionByName(plain).unionByName(embedded(plain, made)).withColumn("held", F.pmod(F.xxhash64("line"), F.lit(4)) == 0)
    rows = rows.unionByName(notices(spark, HELD_OUT_LICENCES).withColumn("held", F.lit(True)))
    label = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("family")).cast("double") - 1
    data = rows.select(label.alias("label"), grams(F.col("line")).alias("grams"), "held")
    return cut(HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features", binary=True).transform(data).select("label", "features", "held"))


def learn(data: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier of the rows that aren't held out, and the temperature with the least loss on those that are."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    counts = {r["label"]: r["count"] for r in data.where("NOT held").groupBy("label").count().collect()}
    weight = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, math.sqrt(1000.0 / n))]), F.col("label")) if counts else F.lit(1.0)
    learner = LogisticRegression(maxIter=40, regParam=2e-4, elasticNetParam=0.3, family="multinomial", weightCol="weight", standardization=False, aggregationDepth=2)
    model = learner.fit(data.where("NOT held").withColumn("weight", weight))
    raw = model.transform(data.where("held")).select(vector_to_array("rawPrediction").alias("raw"), "label")
    best = (math.inf, 1.0)
    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    loss = raw.agg(*(F.avg(-F.log(F.greatest(F.element_at(softmax(F.col("raw"), t), F.col("label").cast("int") + 1), F.lit(1e-12)))).alias(str(k)) for k, t in enumerate(grid))).first()
    for k, t in enumerate(grid):
        if loss[k] is not None:
            best = min(best, (loss[k], t))
    return model, best[1]


def fit(docs: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier and the temperature."""
    return learn(training_rows(docs))


def calibration_error(data: DataFrame, model: LogisticRegressionModel, temperature: float, bins: int = 10) -> float:
    """The expected calibration error on the rows held out: how far the chance of the answer is from how often it is right, over bins of the chance."""
    from pyspark.ml.functions import vector_to_array

    chances = softmax(F.col("raw"), temperature)
    judged = model.transform(data.where("held")).select(vector_to_array("rawPrediction").alias("raw"), (F.col("prediction") == F.col("label")).cast("double").alias("right")).select(F.array_max(chances).alias("chance"), "right")
    by_bin = judged.groupBy(F.least(F.floor(F.col("chance") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("chance") - F.avg("right")).alias("gap"))
    return by_bin.agg(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).first()[0] or 0.0


def softmax(raw: Column, temperature: float) -> Column:
    top = F.array_max(raw)
    powers = F.transform(raw, lambda x: F.exp((x - top) / temperature))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def scan(docs: DataFrame, model: LogisticRegressionModel, temperature: float) -> DataFrame:
    """(doc_id, line_no, family, chance, contained) of every line with a window that the classifier takes for a notice: of its best window, a named family before ``unknown``."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    spark = docs.sparkSession
    # ``row`` keeps the lines of repeated rows apart; only windows taken for notices are grouped by it
    each = lines(docs).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "line_no", F.explode(windows(F.coalesce("line", F.lit("")))).alias("w")).where(F.size("w") > 0)
    hashed = HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features", binary=True).transform(each.withColumn("grams", word_grams(F.col("w")))).drop("grams")
    judged = model.transform(hashed).where("prediction > 0").select("row", "doc_id", "line_no", "w", "prediction", vector_to_array("rawPrediction").alias("raw"))
    chances = softmax(F.col("raw"), temperature)
    hits = judged.select("row", "doc_id", "line_no", F.array_distinct(word_grams(F.col("w"))).alias("grams"), shingles(F.col("w")).alias("shingles"), F.element_at(F.array(*map(F.lit, CLASSES)), F.col("prediction").cast("int") + 1).alias("family"), chances.alias("chances"))
    # a name of one word (MIT, also a German word) confirms by its neighbours in the frames only
    single = [(f, n, re.search(r"(\w+\W+)?\{\}(\W+\w+)?", frame).group().format(n)) for f, names in FAMILIES.items() for n in names if n.isalnum() for frame in FRAMES]
    templates = spark.createDataFrame([(f, n, n) for f, names in FAMILIES.items() for n in names if not n.isalnum()] + single, "family string, name string, around string")
    held = F.filter(grams(F.col("around")), lambda g: (F.col("name") != F.col("around")) & g.contains(" "))
    by_family = F.broadcast(templates.select("family", F.array_distinct(F.when(F.col("name") == F.col("around"), grams(F.col("name"))).otherwise(held)).alias("template")).groupBy("family").agg(F.collect_list("template").alias("templates")))
    texts = F.broadcast(licence_shingles(spark).agg(F.collect_list(F.struct("text_family", "text_shingles")).alias("texts")))
    within = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t)))

    def overlap(t: Column) -> Column:
        shared = F.size(F.array_intersect(t["text_shingles"], F.col("shingles")))
        score = F.when(shared >= LEAST_SHINGLES, shared / F.least(F.size(t["text_shingles"]), F.size("shingles"))).otherwise(0.0)
        return F.struct(score.alias("score"), (t["text_family"] == F.col("family")).alias("predicted"), t["text_family"].alias("family"))

    out = hits.join(by_family, "family", "left").crossJoin(texts).select("row", "doc_id", "line_no", "family", "chances", F.coalesce(within, F.lit(0.0)).alias("named"), F.array_max(F.transform("texts", overlap)).alias("text"))
    by_text = F.col("text.score") >= CONFIRM
    chance = lambda family: F.element_at("chances", F.array_position(F.array(*map(F.lit, CLASSES)), family).cast("int"))
    sure = (chance(F.col("family")) >= LEAST) & (F.col("named") >= CONFIRM)
    found = out.select(
        "row", "doc_id", "line_no", F.when(by_text, F.col("text.family")).when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"),
        F.when(by_text, chance(F.col("text.family"))).otherwise(chance(F.col("family"))).alias("chance"), F.when(by_text, F.col("text.score")).otherwise(F.col("named")).alias("contained"),
    )
    best = F.max(F.struct((F.col("family") != UNKNOWN).alias("confirmed"), "chance", "contained", "family"))
    return found.groupBy("row", "doc_id", "line_no").agg(best.alias("best")).select("doc_id", "line_no", "best.family", "best.chance", "best.contained")


def op2_licence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, temperature = fit(docs)
    return scan(docs, model, temperature).select("doc_id", "line_no", "family", F.round("chance", 6).alias("chance"), F.round("contained", 6).alias("contained"))
