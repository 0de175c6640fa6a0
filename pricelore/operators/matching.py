"""Matching of titles: inverted-index joins, dictionary match, category vote, verification across platforms, token rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from pricelore.functions import text as T
from pricelore.operators.messages import question
from pricelore.shared import reliable
from pricelore.sources.listings import last_by_key


#: A token of more entries than this is heavy: it is met by kinds of entries, not by each.
HEAVY = 1000


def title_matches(profiles: DataFrame, entries: DataFrame, limit: int = 5, min_shared: int = 1, heavy: int = HEAVY) -> DataFrame:
    """(profile_id, entry_id, shared, similarity, verified, place): the best entries of each profile.

    profiles: profile_id, tokens, platform; entries: entry_id, tokens, platform, verified, cluster_id. Profiles with the same tokens meet entries once. Pairs meet by an equi-join on the tokens that at most ``heavy`` entries hold. Entries that share heavy tokens only are alike if they have the same heavy tokens,
    size, platform and marks: each such kind stands for its first ``limit`` entries, and profiles meet kinds by their heavy tokens. An entry of a kind that is left out has ``limit`` better ones: those kept, whose similarity is the same or, if they share more with a profile, higher. So the result is that of
    all pairs, and no token's entries meet its profiles in one task.
    """
    # written once, as both are used several times and their tokens are costly to make
    sets = reliable(profiles.select(F.array_sort(F.array_distinct("tokens")).alias("p_tokens"), F.col("platform").alias("p_platform"), "profile_id"))
    e = reliable(entries.select("entry_id", F.array_distinct("tokens").alias("e_tokens"), F.col("platform").alias("e_platform"), "verified", "cluster_id"))
    each = e.select("entry_id", F.explode("e_tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > heavy).agg(F.array_sort(F.collect_list("token")).alias("often")).first()["often"]  # the entries' tokens over ``heavy`` at most
    common = F.array(*map(F.lit, often)).cast("array<string>")
    split_up = lambda df, c: df.withColumns({"heavy": F.array_sort(F.array_intersect(c, common)), "size": F.size(c)})
    p = split_up(sets.select("p_tokens", "p_platform").distinct().withColumn("p_set", F.xxhash64("p_tokens", "p_platform")), "p_tokens").withColumnsRenamed({"heavy": "p_heavy", "size": "p_size"})
    e = split_up(e, "e_tokens").withColumnsRenamed({"heavy": "e_heavy", "size": "e_size"})
    rare = lambda df, key, c: df.select(key, F.explode(F.array_except(c, common)).alias("token"))
    met = rare(p, "p_set", "p_tokens").join(rare(e, "entry_id", "e_tokens"), "token").groupBy("p_set", "entry_id").agg(F.count("*").alias("rare"))
    out = ["p_set", "p_size", "p_platform", "entry_id", "e_size", "e_platform", "verified", "cluster_id", "shared"]
    pairs = met.join(p.drop("p_tokens"), "p_set").join(e.drop("e_tokens"), "entry_id").withColumn("shared", F.col("rare") + F.size(F.array_intersect("p_heavy", "e_heavy"))).select(*out)
    if often:
        kind = ["e_heavy", "e_size", "e_platform", "verified", F.col("cluster_id").isNull().alias("loose")]
        first = F.slice(F.array_sort(F.collect_list(F.struct("entry_id", "cluster_id"))), 1, limit)
        placed = F.row_number().over(Window.partitionBy(*kind).orderBy("entry_id"))
        kinds = e.where(F.size("e_heavy") > 0).withColumn("_nth", placed).where(F.col("_nth") <= limit).groupBy(*kind).agg(first.alias("first"))
        classes = p.where(F.size("p_heavy") > 0).select("p_heavy", "p_size", "p_platform").distinct()
        both = classes.withColumn("token", F.explode("p_heavy")).join(kinds.withColumn("token", F.explode("e_heavy")), "token").drop("token").distinct().withColumn("shared", F.size(F.array_intersect("p_heavy", "e_heavy")).cast("long")).where(F.col("shared") >= min_shared)
        # after ``limit`` different ranks of kinds there are ``limit`` better entries; kinds of one rank stay together, as their entries' ids decide
        kept = both.withColumn("_nth", F.dense_rank().over(Window.partitionBy("p_heavy", "p_size", "p_platform").orderBy(F.desc("verified"), F.desc(_similarity()), F.desc("shared"), "loose"))).where(F.col("_nth") <= limit).drop("_nth")
        common_pairs = p.select("p_set", "p_heavy", "p_size", "p_platform").join(kept, ["p_heavy", "p_size", "p_platform"]).withColumn("x", F.explode("first")).select("p_set", "p_size", "p_platform", F.col("x.entry_id").alias("entry_id"), "e_size", "e_platform", "verified", F.col("x.cluster_id").alias("cluster_id"), "shared")
        pairs = pairs.unionByName(common_pairs.select(*out)).groupBy(*out[:-1]).agg(F.max("shared").alias("shared"))
    scored = pairs.where(F.col("shared") >= min_shared).withColumn("similarity", _similarity())
    order = Window.partitionBy("p_set").orderBy(F.desc("verified"), F.desc("similarity"), F.desc("shared"), F.col("cluster_id").isNull(), "entry_id")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("p_set", "entry_id", "shared", "similarity", "verified", "place")
    return sets.select("profile_id", F.xxhash64("p_tokens", "p_platform").alias("p_set")).join(best, "p_set").select("profile_id", "entry_id", "shared", "similarity", "verified", "place")


def _similarity() -> Column:
    """Of shared, p_size, e_size, the platforms and the mark of an entry."""
    base = F.col("shared") / (F.col("p_size") + F.col("e_size") - F.col("shared"))
    return F.least(F.lit(1.0), base + F.when(F.col("p_platform") == F.col("e_platform"), 0.05).otherwise(0.0) + F.when(F.col("verified"), 0.05).otherwise(0.0))


#: The category of what has none, the confidence of a category that only the search keyword tells, and the methods' names.
NO_CATEGORY, BY_KEYWORD = "미분류", 0.55
BY_VERIFIED, BY_TITLE = "joongna_correlation", "title_correlation"
BY_PRODUCT_NAME, BY_KEYWORD_WORDS, BY_MODEL = "product_name_trie", "source_keyword_correlation", "model_stub"


def category_votes(matches: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(profile_id, category, score, confidence, method) from matches (profile_id, category, similarity, verified, place).

    Candidates count from 0.35 and three quarters of the best on, whatever their category; those with one vote with their squared similarity, more if verified or if it is the profile's source keyword, and the category met first wins a tie. With ``profiles``
    (profile_id, source_keyword) every profile has a row: its keyword with 0.55 where no vote is cast, no category where it has none.
    """
    known = matches if profiles is None else matches.join(profiles.select("profile_id", "source_keyword"), "profile_id")
    source = T.blank(F.col("source_keyword")) if profiles is not None else F.lit("")
    best = F.max("similarity").over(Window.partitionBy("profile_id"))
    kept = known.withColumn("best", best).where((F.col("similarity") >= F.greatest(F.lit(0.35), 0.75 * F.col("best"))) & (T.blank(F.col("category")) != ""))
    weight = F.col("similarity") ** 2 + F.when(F.col("verified"), 0.1).otherwise(0.0) + F.when((source != "") & (F.col("category") == source), 0.25).otherwise(0.0)
    nth = F.row_number().over(Window.partitionBy("profile_id", "category").orderBy("place"))
    evidence = kept.withColumn("weight", weight).withColumn("nth", nth)
    votes = evidence.groupBy("profile_id", "category").agg(F.sum("weight").alias("score"), F.max(F.when(F.col("nth") <= 3, F.col("similarity"))).alias("top"), F.max(F.when(F.col("nth") <= 3, F.col("verified"))).alias("sure"), F.min("place").alias("first"))
    chosen = votes.groupBy("profile_id").agg(F.max_by(F.struct("category", "score", "top", "sure"), F.struct(F.round("score", 12), (-F.col("first")).alias("early"))).alias("v"))
    out = chosen.select("profile_id", "v.category", "v.score", F.round(F.least(F.lit(0.99), F.col("v.top") + F.least(F.lit(0.25), F.col("v.score") / 10)), 4).alias("confidence"), F.when(F.col("v.sure"), BY_VERIFIED).otherwise(BY_TITLE).alias("method"))
    if profiles is None:
        return out
    whole = profiles.select("profile_id", source.alias("source")).join(out, "profile_id", "left")
    told = F.col("source") != ""
    return whole.select(
        "profile_id", F.coalesce("category", F.when(told, F.col("source")).otherwise(NO_CATEGORY)).alias("category"), "score",
        F.coalesce("confidence", F.when(told, BY_KEYWORD).otherwise(0.0)).alias("confidence"), F.coalesce("method", F.when(told, "source_keyword").otherwise("unclassified")).alias("method"),
    )


def evidence(matches: DataFrame, votes: DataFrame, profiles: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """(profile_id, evidence): the first ``most`` matches (profile_id, entry_id, similarity, category, place) that count for the category of ``votes``, in order, with their shared tokens and what the entries have of matched_keywords, representative_name, cluster_id and tree_path_ids."""
    best = F.max("similarity").over(Window.partitionBy("profile_id"))
    strong = matches.withColumn("best", best).where(F.col("similarity") >= F.greatest(F.lit(0.35), 0.75 * F.col("best")))
    own = strong.join(votes.select("profile_id", F.col("category").alias("voted")), "profile_id").where(F.col("category") == F.col("voted"))
    nth = F.row_number().over(Window.partitionBy("profile_id").orderBy("place"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in entries.columns else F.lit("")
    words = F.coalesce("matched_keywords", F.array().cast("array<string>")) if dict(entries.dtypes).get("matched_keywords", "").startswith("array") else T.split_list(text("matched_keywords"))
    known = entries.select("entry_id", F.col("tokens").alias("e_tokens"), words.alias("words"), *(text(c).alias(c) for c in ("representative_name", "cluster_id", "tree_path_ids")))
    first = own.withColumn("nth", nth).where(F.col("nth") <= most).join(known, "entry_id").join(profiles.select("profile_id", "tokens"), "profile_id")
    row = F.struct("nth", F.array_intersect("tokens", "e_tokens").alias("tokens"), "words", "representative_name", "cluster_id", "tree_path_ids")
    return first.groupBy("profile_id").agg(F.array_sort(F.collect_list(row)).alias("evidence"))


def graph_keywords(category: Column, keyword: Column, matched: Column, evidence_: Column) -> Column:
    """The distinct words by which a row is tied to others: its category and keyword, the evidence's keywords, tokens and names, the dictionary values, and the evidence's names, clusters, paths and tokens."""
    none = F.array().cast("array<string>")
    each = lambda f: F.coalesce(F.flatten(F.transform(evidence_, f)), none)
    order = F.array(*map(F.lit, ("brand", "model", "detail", "spec", "option")))
    values = F.coalesce(F.filter(F.transform(order, lambda k: F.try_element_at(matched, k)), lambda v: v.isNotNull()), none)
    whole = F.concat(F.array(category, keyword), each(lambda x: F.concat(x["words"], x["tokens"], F.array(x["representative_name"]))), values, each(lambda x: F.concat(F.array(x["representative_name"], x["cluster_id"], x["tree_path_ids"]), x["tokens"])))
    return F.array_distinct(F.filter(F.transform(whole, T.blank), lambda w: w != ""))


#: Characters of the parts that one automaton holds; more of them go by keys.
AUTOMATON_CHARS = 8_000_000


def contained(whole: DataFrame, text: str, parts: DataFrame, part: str, most: int = AUTOMATON_CHARS) -> DataFrame:
    """The pairs of rows of which ``part`` is in ``text``. Empty parts are in nothing.

    Up to ``most`` characters of distinct parts (counted first) go to the tasks as one Aho-Corasick automaton, which each text passes once, in its place. Beyond that parts and texts meet by keys (``keyed_pairs``).
    """
    own = parts.where(F.length(part) > 0)
    distinct = own.select(F.col(part).alias("part")).distinct()
    if (distinct.agg(F.sum(F.length("part"))).first()[0] or 0) > most:
        return keyed_pairs(whole, text, own, part)
    words = whole.sparkSession.sparkContext.broadcast([r["part"] for r in distinct.collect()])  # ``most`` characters at most
    schema = T_.StructType([*whole.schema.fields, T_.StructField("_parts", T_.ArrayType(T_.StringType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = ahocorasick.Automaton()
        for k, w in enumerate(words.value):
            known.add_word(w, k)
        known.make_automaton()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            held = [[words.value[k] for k in sorted({k for _, k in known.iter(t.as_py())})] if t.is_valid and words.value else [] for t in column]
            yield batch.append_column("_parts", pa.array(held, pa.list_(pa.string())))

    hits = whole.mapInArrow(scan, schema).withColumn("_part", F.explode("_parts")).drop("_parts")
    return hits.join(own, F.col("_part") == own[part]).drop("_part")


def keyed_pairs(whole: DataFrame, text: str, parts: DataFrame, part: str, grams: int = 12) -> DataFrame:
    """``contained`` by an equi-join: a part's key are its first ``grams`` characters, or all of a shorter one, and a text's keys are its pieces of the lengths that keys have. Keys carry a text's name only; the texts come to the pairs that share a key."""
    size = F.least(F.length(part), F.lit(grams))
    lengths = sorted(r[0] for r in parts.select(size.alias("n")).distinct().collect())  # ``grams`` numbers at most
    none = F.array().cast("array<string>")

    def cut(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(F.col(text), i, F.lit(n)))).otherwise(none)

    name = F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b")).alias("_name")
    keyed = whole.select(text).distinct().select(name, F.explode(F.array_distinct(F.flatten(F.array(*map(cut, lengths))))).alias("_key"))
    pairs = keyed.join(parts.select(F.col(part).alias("_part"), F.substring(F.col(part), F.lit(1), size).alias("_key")).distinct(), "_key").select("_name", "_part")
    met = whole.withColumn("_name", name).join(pairs, "_name").where(F.col(text).contains(F.col("_part"))).drop("_name")
    return met.join(parts, F.col("_part") == parts[part]).drop("_part")


def dictionary_matches(titles: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(title, matched): a map brand, model, detail, spec, option of the longest alias of each field that the compact title holds, then the earliest.

    dictionary: field_name, canonical_value, alias, row_no; a repeated alias counts as its last row. The work is done once for each distinct title.
    """
    entries = last_by_key(dictionary.select(T.compact(F.col("alias")).alias("alias"), "field_name", "canonical_value", "row_no").where("alias <> ''"), ["alias"], ["row_no"])
    distinct = titles.select("title").distinct().withColumn("compact", T.compact(F.col("title")))
    hits = contained(distinct, "compact", entries, "alias")
    best = hits.groupBy("title", "field_name").agg(F.max_by("canonical_value", F.struct(F.length("alias"), (-F.expr("instr(compact, alias)")).alias("early"), "canonical_value")).alias("value"))
    order = ("brand", "model", "detail", "spec", "option")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("field_name"))
    return best.groupBy("title").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col("field_name").alias("k"), F.col("value").alias("v")))).alias("rows")).select("title", F.map_from_entries(F.transform("rows", lambda r: F.struct(r["k"], r["v"]))).alias("matched"))


def category_by_rules(values: DataFrame, rules: DataFrame, floor: float = 0.9) -> DataFrame:
    """(title, category, confidence): values (title, value, confidence) that lead to exactly one category of rules (category, token)."""
    met = values.join(rules, T.compact(F.col("value")) == T.compact(F.col("token")))
    one = met.groupBy("title").agg(F.count_distinct("category").alias("n"), F.min("category").alias("category"), F.max("confidence").alias("confidence")).where("n = 1")
    return one.select("title", "category", F.greatest(F.lit(floor), F.col("confidence")).alias("confidence"))


def _compact_words(words: tuple[str, ...]) -> Column:
    """Words in the compact form in which tokens are compared to them."""
    return F.array(*(T.compact(F.lit(w)) for w in words)).cast("array<string>")


def signal_tokens(title: Column, excluded: tuple[str, ...] = ()) -> Column:
    return F.filter(F.array_distinct(T.title_tokens(title)), lambda t: (F.length(t) >= 2) & (~t.rlike("^[0-9]+$") | (F.length(t) >= 3)) & ~F.array_contains(_compact_words(excluded), T.compact(t)))


def core_tokens(titles: DataFrame, excluded: tuple[str, ...] = (), n: int = 8) -> DataFrame:
    """The (token, n) that most titles hold; with three or more titles only those in two at least."""
    total = titles.where(F.size(T.title_tokens(F.col("title"))) > 0).count()
    counts = titles.select(F.explode(signal_tokens(F.col("title"), excluded)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= (2 if total >= 3 else 1)).orderBy(F.desc("n"), "token").limit(n)


def verify_across(rows: DataFrame, baseline: str, excluded: tuple[str, ...] = (), min_confidence: float = 0.35) -> DataFrame:
    """``rows`` (platform, keyword, name, price) with ``keep``: those of other platforms stay if their price, tokens and category confidence agree with the baseline platform's; without baseline all stay.

    The confidence is that of ``category_votes`` over the baseline's titles (five of equal ones at most, since five candidates vote), once for each distinct keyword and title.
    """
    base = rows.where(F.col("platform") == baseline)
    first = base.agg(F.percentile(F.when(F.col("price") > 0, F.col("price")), F.lit(0.5)).alias("median"), F.count("*").alias("n")).first()
    if not first["n"]:
        return rows.withColumn("keep", F.lit(True))
    core = [r["token"] for r in core_tokens(base.select(F.col("name").alias("title")), excluded).collect()]  # eight at most
    tokens_of = lambda df: df.select("*", F.array_sort(F.array_distinct(T.title_tokens(F.col("name")))).alias("tokens"))
    listed = tokens_of(base.select("name", "keyword")).groupBy("tokens", F.col("keyword").alias("category")).agg(F.count("*").alias("n"))
    titles = listed.select("tokens").distinct().select(F.xxhash64("tokens").alias("entry_id"), "tokens", F.lit(baseline).alias("platform"), F.lit(True).alias("verified"), F.lit(None).cast("string").alias("cluster_id"))
    asked = tokens_of(rows.where(F.col("platform") != baseline).select("keyword", "name").distinct())
    # titles with the same tokens are equally like a profile, so the five best titles hold the five best listings
    like = title_matches(asked.select(F.xxhash64("tokens").alias("profile_id"), "tokens").distinct().withColumn("platform", F.lit("")), titles)
    copies = listed.select(F.xxhash64("tokens").alias("entry_id"), "category", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(5)).cast("int"))).alias("copy"))
    nth = F.row_number().over(Window.partitionBy("profile_id").orderBy("title_place", "category", "copy"))
    five = like.withColumnRenamed("place", "title_place").join(copies, "entry_id").withColumn("place", nth).where("place <= 5").select(F.col("profile_id").alias("title_id"), "category", "similarity", "verified", "place")
    profiles = asked.select(F.xxhash64("keyword", "name").alias("profile_id"), F.xxhash64("tokens").alias("title_id"), F.col("keyword").alias("source_keyword"))
    votes = category_votes(profiles.join(five, "title_id").select("profile_id", "category", "similarity", "verified", "place"), profiles.select("profile_id", "source_keyword")).select("profile_id", F.col("confidence").alias("_confidence"))
    tokens = T.title_tokens(F.col("name"))
    noise = F.size(F.array_intersect(F.transform(tokens, T.compact), _compact_words(excluded))) if excluded else F.lit(0)
    relevant = F.arrays_overlap(tokens, F.array(*map(F.lit, core))) & (noise < 3) if core else F.lit(True)
    priced = F.lit(True) if first["median"] is None else F.col("price").between(int(0.35 * first["median"]), int(2.5 * first["median"])) & (F.col("price") > 0)
    judged = rows.withColumn("profile_id", F.xxhash64("keyword", "name")).join(votes, "profile_id", "left").drop("profile_id")
    good = priced & relevant & (F.coalesce("_confidence", F.lit(0.0)) >= min_confidence)
    return judged.withColumn("keep", (F.col("platform") == baseline) | F.coalesce(good, F.lit(False))).drop("_confidence")


def missing_tokens(tokens: Column, title: Column) -> Column:
    """The keyword tokens that the normal title lacks: a token with digits needs a place that isn't inside a longer word or number, others need only be held."""
    edge = lambda t, cls: F.concat(F.lit(f"(?<![{cls}])"), t, F.lit(f"(?![{cls}])"))
    holds = lambda t: F.when(t.rlike("^[0-9]+$"), F.call_function("rlike", title, edge(t, "0-9"))).when(t.rlike("[0-9]"), F.call_function("rlike", title, edge(t, "0-9a-z"))).otherwise(F.call_function("contains", title, t))
    return F.filter(tokens, lambda t: ~holds(t))


def accuracy(rows: DataFrame) -> DataFrame:
    """``rows`` (keyword, name) with missing_tokens and is_match, which are found once for each distinct keyword and name."""
    pairs = rows.select(F.col("keyword").alias("_keyword"), F.col("name").alias("_name")).distinct()
    pairs = pairs.withColumns({"_tokens": T.keyword_tokens(F.col("_keyword")), "_text": T.normal(F.col("_name"), "none")})
    judged = pairs.select("_keyword", "_name", F.coalesce(missing_tokens(F.col("_tokens"), F.col("_text")), F.array().cast("array<string>")).alias("missing_tokens"))
    out = rows.join(judged, F.col("keyword").eqNullSafe(F.col("_keyword")) & F.col("name").eqNullSafe(F.col("_name")), "left").drop("_keyword", "_name")
    return out.withColumn("is_match", F.size("missing_tokens") == 0)


def fill_platform(rows: DataFrame, platforms: DataFrame) -> DataFrame:
    """``rows`` with a blank platform_name filled from platforms (platform_id, name); ``unknown`` where that has none."""
    found = rows.join(platforms.select("platform_id", F.col("name").alias("_name")), "platform_id", "left")
    return found.withColumn("platform_name", F.coalesce(F.nullif(F.trim("platform_name"), F.lit("")), F.nullif(F.trim("_name"), F.lit("")), F.lit("unknown"))).drop("_name")


def write_back(rows: DataFrame, clustered: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` from ``clustered`` on (platform, pid, price), the greatest where it has several for a key; rows without a partner keep what they have."""
    keys = ["platform", "pid", "price"]
    new = last_by_key(clustered.select(*keys, *columns), keys, columns).withColumnsRenamed({c: f"_{c}" for c in columns})
    return rows.join(new, keys, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).select(*rows.columns)


#: Ordered rules (words of a pattern, groups of words of a message): the first rule that fits a pattern asks for a word of each group.
SYNONYM_RULES = (
    (("알림", "가격알림"), (("알림", "가격알림", "등록", "설정", "종"),)),
    (("찜", "관심"), (("찜", "하트", "관심", "저장"), ("방법", "어떻게", "확인", "목록"))),
    (("가격비교", "비교"), (("가격", "비교", "평균", "최저가", "살래말래"),)),
    (("검색",), (("검색", "찾기", "상품찾기"), ("방법", "어떻게", "사용"))),
    (("서비스", "하마", "소개"), (("하마", "서비스", "사이트"), ("뭐", "소개", "설명", "기능"))),
)


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (text.contains(w) for w in words))


def synonym_rule(pattern: Column, rules: tuple = SYNONYM_RULES) -> Column:
    """The number of the first rule that fits a pattern, null for none."""
    out = F.lit(None).cast("int")
    for k, (of_pattern, _) in reversed(list(enumerate(rules))):
        out = F.when(_holds(pattern, of_pattern), k).otherwise(out)
    return out


def answered_rules(message: Column, rules: tuple = SYNONYM_RULES) -> Column:
    """The numbers of the rules that a message answers."""
    fits = [F.when(reduce(and_, (_holds(message, g) for g in groups)), k) for k, (_, groups) in enumerate(rules)]
    return F.filter(F.array(*fits), lambda k: k.isNotNull())


def faq_matches(messages: DataFrame, faq: DataFrame) -> DataFrame:
    """(message_id, faq_id): the longest pattern that holds the message, is held by it, or fits it by ``SYNONYM_RULES``.

    Texts meet by ``contained`` only, and a rule's number joins the patterns that ask for it to the messages that answer it. Of a rule's patterns only the longest can win, so each rule has one.
    """
    m = messages.select("message_id", question(F.col("message")).alias("m")).where("m <> ''")
    f = faq.select("faq_id", question(F.col("pattern")).alias("p")).where("p <> ''")

    rule = synonym_rule(F.col("p"))
    of_rule = f.withColumn("rule", rule).where("rule IS NOT NULL").groupBy("rule").agg(F.max_by(F.struct("faq_id", "p"), F.struct(F.length("p"), (-F.col("faq_id")).alias("early"))).alias("best"))
    answered = m.withColumn("rule", F.explode(answered_rules(F.col("m")))).join(of_rule, "rule").select("message_id", F.col("best.faq_id").alias("faq_id"), F.col("best.p").alias("p"))
    both = lambda df: df.select("message_id", "faq_id", "p")
    met = both(contained(m, "m", f, "p")).unionByName(both(contained(f, "p", m, "m"))).unionByName(answered)
    return met.groupBy("message_id").agg(F.max_by("faq_id", F.struct(F.length("p"), (-F.col("faq_id")).alias("early"))).alias("faq_id"))


def classify_titles(rows: DataFrame, classifier, none: str = "미분류") -> DataFrame:
    """``rows`` whose category is still ``none`` get the classifier's answer: a function of the title column that gives (category, confidence), such as a pandas_udf."""
    asked = classifier(F.col("name"))
    return rows.withColumn("_c", F.when(F.col("category") == none, asked)).withColumn("category", F.coalesce(F.col("_c")["category"], F.col("category"))).withColumn("category_confidence", F.coalesce(F.col("_c")["confidence"], F.col("category_confidence"))).drop("_c")
