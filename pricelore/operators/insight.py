"""Search, price series, advice, recommendations and alerts over items and their users."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelore.functions import text as T
from pricelore.functions import values as V
from pricelore.shared import numbered, reliable

#: Brands and words of phone bodies, words of their accessories, and words of listings that are like no product: accessories and wishes.
PHONE_BRANDS = (("아이폰", "iphone"), ("갤럭시", "galaxy"))
PHONE_ACCESSORIES = ("케이스", "젤리케이스", "범퍼케이스", "충전기", "충전케이블", "케이블", "보호필름", "필름", "강화유리", "맥세이프", "magsafe", "거치대", "파우치", "스트랩", "어댑터", "액정필름", "카메라필름", "커버", "시계줄")
UNLIKE = ("케이스", "필름", "강화유리", "렌즈필름", "카메라필름", "충전기", "충전케이블", "어댑터", "맥세이프", "거치대", "스트랩", "보호캡", "삽니다", "사봐요", "구매합니다", "구합니다", "매입", "교환", "대리구매")
#: Ordered steps (share of the lowest price, points) and (days, points) of a recommendation.
PRICE_POINTS, AGE_POINTS = ((1.0, 30), (1.05, 20), (1.10, 10)), ((1, 15), (3, 10), (7, 5))
#: Words of a product type in a listing and words that rule it out; words of use and of performance levels, with their points.
TYPE_WORDS = {
    "desktop": (("컴퓨터", "데스크탑", "데스크톱", "본체", "게이밍pc", "pc"), ("그래픽카드", "rtx", "gtx", "gpu", "그래픽 카드만", "노트북")),
    "laptop": (("노트북", "맥북", "그램", "갤럭시북", "레노버", "thinkpad"), ()),
    "smartphone": (("아이폰", "갤럭시", "스마트폰", "핸드폰", "휴대폰", "iphone", "galaxy"), ()),
    "game_console": (("스위치", "닌텐도", "ps5", "ps4", "플스", "xbox", "steamdeck", "스팀덱"), ()),
}
GAMING_POINTS = (("rtx", "gtx", "rx ", "게이밍", "그래픽", "gpu"), 40)
LEVEL_POINTS = {
    "LOW": (("gtx 1050", "gtx1050", "gtx 1060", "gtx1060", "gtx 1660", "rtx 2060", "rtx 3060", "rtx 4060"), 25),
    "MID": (("gtx 1660", "rtx 2060", "rtx 3060", "rtx 4060", "rtx 4070"), 30),
    "HIGH": (("rtx 3060", "rtx 3070", "rtx 3080", "rtx 4060", "rtx 4070", "rtx 4080"), 35),
    "EXTREME": (("rtx 4080", "rtx4080", "rtx 4090", "rtx4090"), 40),
}
#: Reasons of a recommendation.
REASONS = {
    "lowest": "현재가가 기록된 최저가 수준이라 가격 메리트가 큰 상품입니다.",
    "fitting": "검색어와 상품명, 카테고리 조건이 잘 맞는 상품입니다.",
    "related": "검색 조건과 연관성이 있는 상품입니다.",
    "wished": "찜 목록에 있는 상품이라 우선 추천했습니다.",
    "seen": "최근 본 상품과도 연결되는 후보입니다.",
}
#: How the search for a type judges a title: words of a whole computer, of its looks, of a card alone, of parts; words of accessories in a query and in a title.
WHOLE_PC = ("본체", "데스크탑", "완본체", "조립pc", "조립 pc", "게이밍pc", "게이밍 pc", "고사양 컴퓨터", "컴퓨터 풀세트")
LOOKS_PC = ("pc", "컴퓨터", "본체", "데스크탑", "게이밍")
PC_PARTS = ("메인보드", "보드", "파워", "램", "ram", "ssd", "hdd", "케이블", "어댑터", "케이스", "키보드", "마우스", "모니터", "책상", "테이블", "노트북", "맥미니", "mac mini", "맥북")
LAPTOP_TITLES = ("노트북", "맥북", "gram", "그램", "thinkpad", "레노버")
PHONE_TITLES = ("아이폰", "iphone", "갤럭시", "galaxy", "핸드폰", "스마트폰")
ASKED_ACCESSORIES = ("케이스", "충전기", "충전", "케이블", "보호필름", "필름", "강화유리", "맥세이프", "magsafe", "거치대", "파우치", "스트랩", "어댑터", "액세서리")
TITLE_ACCESSORIES = ("케이스", "젤리케이스", "범퍼케이스", "충전기", "충전 케이블", "케이블", "보호필름", "필름", "강화유리", "맥세이프", "magsafe", "거치대", "파우치", "스트랩", "어댑터", "액정필름", "카메라필름")
QUERY_TOKEN = r"[a-z]+[0-9]+|[가-힣]+|[a-z]+|[0-9]+"


def search_text(*columns: str) -> Column:
    return F.regexp_replace(F.lower(F.concat_ws(" ", *columns)), r"(?U)\s+", "")


def matches(query: str, text: Column) -> Column:
    needle = "".join(query.lower().split())
    return text.contains(needle) if needle else F.lit(True)


def on_platforms(platforms: tuple[str, ...], column: Column) -> Column:
    return column.isin(*platforms) if platforms else F.lit(True)


def relevance(rows: DataFrame, query: str, shuffle: bool = True) -> DataFrame:
    """``rows`` (text, price, key) with ``relevance``: the share of the query's tokens that the text holds, the whole query, nearness to the mean price, and a shuffle that the query and the key always give."""
    whole = "".join(query.lower().split())
    tokens = re.findall(QUERY_TOKEN, whole)
    mean = rows.where("price > 0").agg(F.avg("price")).first()[0] or 0.0
    share = sum((F.when(F.col("text").contains(t), 1).otherwise(0) for t in tokens), F.lit(0)) / max(len(tokens), 1)
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.coalesce("price", F.lit(0)) - mean) / max(mean, 1.0))
    bonus = F.when(F.col("text").contains(whole), 0.35).otherwise(0.0) if whole else F.lit(0.0)
    return rows.withColumn("relevance", 8 * share + bonus + 2 * near + (V.stable_share(F.concat_ws(":", F.lit(whole), F.col("key"))) if shuffle else F.lit(0.0)))


def search(rows: DataFrame, query: str, platforms: tuple[str, ...] = (), sort: str = "low_price", page: int = 1, limit: int = 20) -> DataFrame:
    """A page of listings (name, canonical_name, keyword, platform, pid, price, ts) by low_price, recent or relevance."""
    found = rows.withColumn("text", search_text("name", "canonical_name", "keyword")).where(matches(query, F.col("text")) & on_platforms(platforms, F.col("platform")))
    if sort == "relevance":
        found = relevance(found.withColumn("key", F.concat_ws(":", "platform", "pid")), query)
    order = {"low_price": ["price", "platform", "pid"], "recent": [F.desc("ts"), "platform", "pid"], "relevance": [F.desc("relevance") if sort == "relevance" else F.lit(0), "platform", "pid"]}[sort]
    return found.orderBy(*order).offset((max(page, 1) - 1) * limit).limit(limit)


def asks_for_accessories(query: str) -> bool:
    asked = "".join(query.lower().split())
    return any(w in asked for w in V.ACCESSORY_TOKENS)


def searchable(rows: DataFrame, query: str, platforms: tuple[str, ...] = ()) -> DataFrame:
    """Documents without noise and implausible prices, without accessories unless the query asks for them, and of ``platforms`` if there are any. Rows without ``quality_flags`` are all kept."""
    kept = rows.where(on_platforms(platforms, F.col("platform"))) if platforms else rows
    if "quality_flags" not in rows.columns:
        return kept
    dropped = ("noise_candidate", "invalid_price", *(() if asks_for_accessories(query) else ("accessory_candidate",)))
    return kept.where(~F.arrays_overlap(F.split(F.coalesce("quality_flags", F.lit("")), ","), F.array(*map(F.lit, dropped))))


#: Fields of a search document and their weights.
FIELDS = (("canonical_name", 5.0), ("title", 4.0), ("matched_keywords", 3.0), ("normalized_title", 2.0), ("search_text", 1.0))


def asked_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def allowed_edits(term: Column) -> Column:
    """None up to two characters, one up to five, else two."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def edits(term: str) -> int:
    """``allowed_edits`` of a term of the query."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def field_words(rows: DataFrame, weights: tuple[tuple[str, float], ...] = FIELDS, *more: str) -> DataFrame:
    """(document_id, field, weight, words) of each document's fields that have words, with the columns ``more``."""
    types = dict(rows.dtypes)
    whole = lambda f: F.array_join(f, " ") if types[f].startswith("array") else F.col(f)
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), T.least_tokens(whole(f), 1).alias("words")) for f, w in weights if f in types))
    return rows.select("document_id", *more, F.explode(each).alias("f")).select("document_id", *more, "f.*").where(F.size("words") > 0)


def best_fields(hits: DataFrame, stats: DataFrame, n_terms: int, *more: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(document_id, score): BM25 of the best field in which every term is found. hits: document_id, field, weight, size, term, tf, and ``more`` of a document; stats: field, mean, docs."""
    idf = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = hits.join(idf, ["field", "term"]).join(stats, "field").withColumn("s", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean"))))
    by_field = scored.groupBy("document_id", *more, "field", "weight").agg(F.sum("s").alias("s"), F.count("*").alias("n")).where(F.col("n") == n_terms)
    return by_field.groupBy("document_id", *more).agg(F.max(F.col("s") * F.col("weight")).alias("score"))


SORTS = {"relevance": [], "recent": [F.desc_nulls_last], "low_price": [F.asc_nulls_last]}
SORT_COLUMNS = {"recent": "crawled_on", "low_price": "current_price"}


def page_of(found: DataFrame, sort: str, page: int, limit: int) -> DataFrame:
    """A page of found documents (document_id, score, and the column of the sort) by relevance, recent or low_price, then by score."""
    order = [f(SORT_COLUMNS[sort]) for f in SORTS[sort]]
    return found.orderBy(*order, F.desc("score"), "document_id").offset((max(page, 1) - 1) * limit).limit(limit).select("document_id", "score")


def field_search(rows: DataFrame, query: str, limit: int = 20, weights: tuple[tuple[str, float], ...] = FIELDS, k1: float = 1.2, b: float = 0.75, platforms: tuple[str, ...] = (), sort: str = "relevance", page: int = 1) -> DataFrame:
    """(document_id, score): a page of ``searchable`` documents by relevance, recent or low_price, then by score. The score is BM25 of the best field in which every query term is found, exactly or by few edits; words of texts and queries are cut alike.

    The filters come first, so term and field statistics are those of the documents that can be found. This reads every document; ``search_index`` keeps an index of them.
    """
    rows = searchable(rows, query, platforms)
    asked = asked_terms(query)
    # the documents are read once: of each field its size and how often it holds each of the few terms, exactly or nearly
    near = lambda t: lambda w: F.levenshtein(w, F.lit(t)) <= F.lit(edits(t))
    tf = F.array(*(F.size(F.filter("words", near(t))).cast("long") for t in asked)) if asked else F.array().cast("array<bigint>")
    each = reliable(field_words(rows, weights).select("document_id", "field", "weight", F.size("words").alias("size"), tf.alias("tfs")))
    stats = each.groupBy("field").agg(F.avg("size").alias("mean"), F.count("*").alias("docs"))
    terms = F.array(*map(F.lit, asked)).cast("array<string>")
    hits = each.where(F.exists("tfs", lambda n: n > 0)).select("document_id", "field", "weight", "size", F.explode(F.arrays_zip(terms.alias("term"), F.col("tfs").alias("tf"))).alias("h")).select("document_id", "field", "weight", "size", F.col("h.term").alias("term"), F.col("h.tf").alias("tf")).where("tf > 0")
    found = best_fields(hits, stats, len(asked), k1=k1, b=b)
    if sort in SORT_COLUMNS:
        found = found.join(rows.select("document_id", SORT_COLUMNS[sort]), "document_id")
    return page_of(found, sort, page, limit)


def hydrate(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """Items of ranked (item_id, place) in that order; missing ones are left out."""
    return ranked.join(items, "item_id").orderBy("place")


def asks_for_phone(query: str) -> bool:
    """Whether a query is for a phone's body: it names a brand and no accessory."""
    asked = "".join(query.lower().split())
    return any(w in asked for words in PHONE_BRANDS for w in words) and not any(w in asked for w in PHONE_ACCESSORIES)


def fits_intent(query: str, *texts: Column) -> Column:
    """A query for a phone's body keeps its brand and no accessories; any other keeps all."""
    if not asks_for_phone(query):
        return F.lit(True)
    asked, solid = "".join(query.lower().split()), T.solid(F.concat_ws(" ", *texts))
    brand = next(words for words in PHONE_BRANDS if any(w in asked for w in words))
    return V.holds_any(solid, brand) & ~V.holds_any(solid, PHONE_ACCESSORIES)


def widened(query: str, limit: int) -> int:
    """How many are fetched so that ``limit`` are left after ``fits_intent``."""
    return min(max(limit * 4, limit + 20), 200) if asks_for_phone(query) else limit


def accessory_or_wanted(*texts: Column) -> Column:
    return V.holds_any(T.solid(F.concat_ws(" ", *map(T.blank, texts))), UNLIKE)


def similar(rows: DataFrame, tokens: Column, *texts: Column) -> DataFrame:
    """Rows that are no accessories or wishes and hold all similarity tokens; all candidates if there are no tokens."""
    solid = T.solid(F.concat_ws(" ", *map(T.blank, texts)))
    return rows.where(~accessory_or_wanted(*texts) & F.forall(tokens, lambda t: F.call_function("contains", solid, t)))


def documents(items: DataFrame) -> DataFrame:
    """Search documents (item_id, title, canonical_name, category_name, current_price, status, crawled_at, and where the table has them platform_name or platform, original_id, matched_keywords, thumbnail_url, item_url).

    Items without id, price, title, or a platform or original id that the table should have, have none. A blank canonical name falls back to the title, a blank category to that, no keywords to that.
    """
    text = {c: T.blank(F.col(c)) for c in items.columns if dict(items.dtypes)[c] == "string"}
    platform = next((text[c] for c in ("platform_name", "platform") if c in text), None)
    ok = F.col("item_id").isNotNull() & F.col("current_price").isNotNull() & (text["title"] != "")
    for needed in (platform, text.get("original_id")):
        ok = ok if needed is None else ok & (needed != "")
    canonical = F.when(text["canonical_name"] != "", text["canonical_name"]).otherwise(text["title"])
    category = F.when(text["category_name"] != "", text["category_name"]).otherwise(canonical)
    words = F.array_distinct(F.filter(F.split(text["matched_keywords"], "[,/|;]"), lambda w: w != "")) if "matched_keywords" in text else F.array().cast("array<string>")
    words = F.when(F.size(words) > 0, words).otherwise(F.array(canonical))
    # titles are judged once for each distinct one, after a shuffle: as filters of a scan the flags would be the work of a file's few tasks
    judged = items.where(ok).select("title").distinct().select("title", T.normal(text["title"], "none", parted=True).alias("_normal"), V.flag_words(text["title"]).alias("_words"))
    normal, flags = F.col("_normal"), V.flags_of(F.col("_words"), F.col("current_price"))
    some = lambda name, column: [] if column is None else [column.alias(name)]
    return items.where(ok).join(judged, "title").select(
        F.col("item_id").cast("string").alias("document_id"), "item_id", *some("platform", platform), *some("pid", text.get("original_id")), *some("item_key", F.concat_ws(":", platform, text["original_id"]) if platform is not None and "original_id" in text else None),
        text["title"].alias("title"), normal.alias("normalized_title"), canonical.alias("canonical_name"), category.alias("category_name"), words.alias("matched_keywords"), F.concat_ws(" ", text["title"], normal, canonical, category, words).alias("search_text"),
        "current_price", V.import_state(F.col("status")).alias("status"), *some("image_url", text.get("thumbnail_url")), *some("item_url", text.get("item_url")), V.index_date(F.date_format("crawled_at", "yyyy-MM-dd")).alias("crawled_on"),
        F.array_contains(flags, "accessory_candidate").alias("is_accessory_candidate"), F.array_join(flags, ",").alias("quality_flags"),
    )


def daily_points(history: DataFrame, group: list[str]) -> DataFrame:
    return history.where("recorded_at IS NOT NULL").groupBy(*group, F.date_format("recorded_at", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("price")).cast("long").alias("price"))


def series(history: DataFrame) -> DataFrame:
    """(item_id, points) with the points in order of their day."""
    return history.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("recorded_at", "price"))).alias("points"))


def lowest_of(points: Column, current: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(points, lambda p: p["price"])), current)


def window_points(points: DataFrame, days: int | None, group: str = "item_id") -> DataFrame:
    """The points of the last ``days`` days, both ends included, counted back from each series' own last day."""
    if days is None:
        return points
    last = points.groupBy(group).agg(F.max("day").alias("last"))
    return points.join(last, group).where(F.to_date("day") >= F.date_sub(F.to_date("last"), days - 1)).drop("last")


def series_summary(points: DataFrame, group: str = "item_id", products: DataFrame | None = None) -> DataFrame:
    """Least, highest and mean price, their first days and the latest price of each series. With ``products`` (group, price), the least and the highest price are those of the products chosen for the chart too; mean, days and latest stay the series' own."""
    own = points.groupBy(group).agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.round(F.avg("price")).cast("long").alias("mean_price"), F.min_by("day", F.struct("price", "day")).alias("min_day"), F.min_by("day", F.struct((-F.col("price")).alias("p"), "day")).alias("max_day"), F.max_by("price", "day").alias("latest_price"))
    if products is None:
        return own
    chosen = products.groupBy(group).agg(F.min("price").alias("_low"), F.max("price").alias("_high"))
    return own.join(chosen, group, "left").withColumns({"min_price": F.least("min_price", "_low"), "max_price": F.greatest("max_price", "_high")}).drop("_low", "_high")


def nearest_point(products: DataFrame, points: DataFrame) -> DataFrame:
    """(product_id, idx): the point of the product's series with its month and day, else the nearest by 31 * month + day, the first of equals. A product without a day gets the last point, less three for each ``place`` before it.

    products: product_id, series_id, day, and place if there is one; points: series_id, idx, day. A series has 403 different days at most, so its points are one short array and each (series, day) is placed once.
    """
    number = lambda c: F.month(c) * 31 + F.dayofmonth(c)
    first = points.groupBy("series_id", number("day").alias("q")).agg(F.min("idx").alias("idx"), F.max("idx").alias("last"))
    held = first.groupBy("series_id").agg(F.collect_list(F.struct("q", "idx")).alias("points"), F.min("idx").alias("low"), F.max("last").alias("high"))
    own = products.withColumns({"p": number("day"), "place": F.col("place") if "place" in products.columns else F.lit(0)})
    near = F.array_min(F.transform(F.filter("points", lambda x: x["q"].isNotNull()), lambda x: F.struct(F.abs(x["q"] - F.col("p")).alias("d"), x["idx"].alias("idx"))))["idx"]
    placed = own.select("series_id", "p").distinct().join(held, "series_id").select("series_id", F.col("p").alias("known_p"), F.when(F.col("p").isNotNull(), near).alias("near"), "low", "high")
    met = own.alias("o").join(placed.alias("k"), (F.col("o.series_id") == F.col("k.series_id")) & F.col("p").eqNullSafe(F.col("known_p")))
    return met.select("product_id", F.coalesce("near", F.least(F.col("high"), F.greatest(F.col("low"), F.col("high") - 3 * F.col("place")))).alias("idx"))


def related_clusters(items: DataFrame, history: DataFrame, name: str, limit: int = 6) -> DataFrame:
    """(cluster_product_name, mean_price, item_count, points): clusters that begin like ``name`` without its capacity, itself first, then by count; ``points`` are (day, price) in order. A blank name has none. ``%`` and ``_`` in a name are plain characters."""
    base = items.sparkSession.createDataFrame([(name,)], "n string").select(T.base_name(F.col("n"))).first()[0].lower()
    cluster = T.blank(F.col("cluster_product_name"))
    own = cluster == name.strip()
    found = items.where(F.lit(bool(name.strip())) & F.col("item_id").isNotNull() & (cluster != "") & F.lower(cluster).startswith(base) & (own | ~T.is_accessory_name(cluster))).withColumn("cluster_product_name", cluster)
    stats = found.groupBy("cluster_product_name").agg(F.round(F.avg(F.coalesce("current_price", F.lit(0)))).cast("long").alias("mean_price"), F.count("*").alias("item_count"))
    first = stats.orderBy(F.desc(own), F.desc("item_count"), "cluster_product_name").limit(limit)
    daily = daily_points(found.join(first.select("cluster_product_name"), "cluster_product_name", "left_semi").select("item_id", "cluster_product_name").join(history, "item_id"), ["cluster_product_name"])
    points = daily.groupBy("cluster_product_name").agg(F.array_sort(F.collect_list(F.struct("day", "price"))).alias("points"))
    none = F.array().cast("array<struct<day: string, price: bigint>>")
    return first.join(points, "cluster_product_name", "left").withColumn("points", F.coalesce("points", none)).orderBy(F.desc(own), F.desc("item_count"), "cluster_product_name")


def similar_group_series(target: dict, items: DataFrame, most: int = 300) -> DataFrame:
    """(day, price): the mean price by day seen of items like ``target`` (canonical_name, category_name, title, matched_keywords): the first 300 seen of its name, or of its category, that are no accessories and hold its tokens, without price outliers.

    An outlier is outside 0.35 to 2.5 times the middle price; if all are, or there are fewer than three, none is.
    """
    given = {k: (target.get(k) or "").strip() for k in ("canonical_name", "category_name", "title", "matched_keywords")}
    by = "canonical_name" if given["canonical_name"] else "category_name"
    if not given[by]:
        return items.where(F.lit(False)).select(F.lit("").alias("day"), F.lit(0).cast("long").alias("price"))
    one = items.sparkSession.createDataFrame([tuple(given.values())], "canonical_name string, category_name string, title string, matched_keywords string")
    tokens = one.select(T.similarity_tokens(F.col("title"), F.col("canonical_name"), F.col("matched_keywords"))).first()[0]
    own = items.where((F.col(by) == given[by]) & F.col("current_price").isNotNull()).orderBy("crawled_at", "item_id").limit(most)
    kept = similar(own, F.array(*map(F.lit, tokens)).cast("array<string>"), F.col("title"), F.col("canonical_name"), F.col("category_name")).where("current_price > 0")
    listed = kept.agg(F.sort_array(F.collect_list(F.struct(F.col("current_price").alias("price"), F.date_format("crawled_at", "yyyy-MM-dd").alias("day")))).alias("all"))  # ``most`` at most
    middle = F.get("all", F.floor(F.size("all") / 2).cast("int"))["price"]
    inside = F.filter("all", lambda x: (x["price"] >= 0.35 * middle) & (x["price"] <= 2.5 * middle))
    chosen = F.when((F.size("all") < 3) | (F.size(inside) == 0), F.col("all")).otherwise(inside)
    return listed.select(F.explode(chosen).alias("x")).select("x.*").where("day IS NOT NULL").groupBy("day").agg(F.round(F.avg("price")).cast("long").alias("price"))


def price_advice(items: DataFrame) -> DataFrame:
    """(item_id, listing and sold statistics of similar items, verdict). Similar: same canonical name or same category, any case, other id, priced; the OR is two equi-aggregates by names, less what both count.

    Sums by name, by category and by both give the union's sums, so no pair of items is ever made.
    """
    priced = items.select("item_id", "current_price", F.lower("canonical_name").alias("n"), F.lower("category_name").alias("c"), "status")
    open_, sold = F.col("status") == V.ON_SALE, F.col("status") == V.SOLD
    cell = lambda on: (F.sum(F.when(on & (F.col("current_price") > 0), F.col("current_price"))), F.count_if(on & (F.col("current_price") > 0)))
    total = lambda keys, p: priced.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(cell(open_)[0].alias(f"{p}os"), cell(open_)[1].alias(f"{p}on"), cell(sold)[0].alias(f"{p}ss"), cell(sold)[1].alias(f"{p}sn"))
    out = priced.join(total(["n"], "n_"), "n", "left").join(total(["c"], "c_"), "c", "left").join(total(["n", "c"], "b_"), ["n", "c"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = lambda on, x: F.when(on & (F.col("current_price") > 0) & (F.col("n").isNotNull() | F.col("c").isNotNull()), x).otherwise(0)
    union = lambda k, on, x: zero(f"n_{k}") + zero(f"c_{k}") - zero(f"b_{k}") - own(on, x)
    counted = out.select("item_id", "current_price", union("on", open_, F.lit(1)).alias("listing_count"), union("os", open_, F.col("current_price")).alias("listing_sum"), union("sn", sold, F.lit(1)).alias("sold_count"), union("ss", sold, F.col("current_price")).alias("sold_sum"))
    mean = counted.withColumn("listing_mean", F.when(F.col("listing_count") > 0, F.col("listing_sum") / F.col("listing_count"))).withColumn("sold_mean", F.when(F.col("sold_count") > 0, F.col("sold_sum") / F.col("sold_count")))
    against = F.coalesce("sold_mean", "listing_mean")
    verdict = F.when(F.col("listing_count") < 3, "insufficient").when(F.col("current_price") < against, "cheaper").when(F.col("current_price") > against, "dearer").otherwise("equal")
    return mean.select("item_id", "listing_count", F.round("listing_mean", 2).alias("listing_mean"), "sold_count", F.round("sold_mean", 2).alias("sold_mean"), verdict.alias("verdict"))


def anomalies(items: DataFrame, mode: str = "confidence", sort: str = "confidence_asc", page: int = 1, limit: int = 20) -> DataFrame:
    """Clustered items of low confidence, or with accessory words in their title."""
    has = F.filter(F.array(*map(F.lit, V.ACCESSORY_TOKENS)), lambda w: F.call_function("contains", F.lower("title"), w))
    base = items.where(T.blank(F.col("cluster_product_name")) != "").withColumn("matched_tokens", F.array_join(has, ","))
    found = base.where("cluster_confidence < 0.5") if mode == "confidence" else base.where("matched_tokens <> ''")
    key, way = sort.rsplit("_", 1)
    column = F.col("cluster_confidence" if key == "confidence" else "current_price")
    return found.orderBy(column.asc_nulls_last() if way == "asc" else column.desc_nulls_last(), "item_id").offset((page - 1) * limit).limit(limit)


def anomaly_counts(items: DataFrame) -> DataFrame:
    named = items.where(T.blank(F.col("cluster_product_name")) != "")
    has = F.exists(F.array(*map(F.lit, V.ACCESSORY_TOKENS)), lambda w: F.call_function("contains", F.lower("title"), w))
    return named.agg(F.count_if(F.col("cluster_confidence") < 0.5).alias("low_confidence"), F.count_if(has).alias("accessory_title"))


def reached_alerts(wishlists: DataFrame, items: DataFrame) -> DataFrame:
    """Wishes whose target is reached, or that want the lowest price and have it."""
    lowest = (F.upper("is_lowest_alert") == "Y") & (F.col("current_price") <= F.col("lowest_price"))
    return wishlists.join(items.select("item_id", "current_price", "lowest_price"), "item_id").where((F.col("current_price") <= F.col("target_price")) | lowest)


def latest_distinct(events: DataFrame, key: str, n: int) -> DataFrame:
    """(user_id, key, ts, place): the n keys that a user used last, each once."""
    last = events.where(F.col(key).isNotNull()).groupBy("user_id", key).agg(F.max("ts").alias("ts"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), key))).where(F.col("place") <= n)


def toggled(events: DataFrame, key: str = "item_id") -> DataFrame:
    """(user_id, key) that were switched an odd number of times."""
    return events.groupBy("user_id", key).agg(F.count("*").alias("n")).where("n % 2 = 1").select("user_id", key)


def not_stored(new: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("user_id", "item_id", "recommend_type")) -> DataFrame:
    return new.dropDuplicates(list(keys)).join(stored, list(keys), "left_anti")


def user_counts(users: DataFrame, wishlists: DataFrame) -> DataFrame:
    """(user_id, wishlist_count) of every user, the newest first (by created_at where there is one, else by id)."""
    counts = wishlists.groupBy("user_id").agg(F.count("*").alias("wishlist_count"))
    newest = [F.desc_nulls_last("created_at")] if "created_at" in users.columns else []
    return users.join(counts, "user_id", "left").withColumn("wishlist_count", F.coalesce("wishlist_count", F.lit(0))).orderBy(*newest, F.desc("user_id")).select("user_id", "wishlist_count")


def user_search(users: DataFrame, role: str | None = None, status: str | None = None, text: str = "") -> DataFrame:
    """Users of a role and a status whose name or address holds a text, in any case, the newest first."""
    ok, word = F.lit(True), text.strip().lower()
    if role:
        ok = ok & (F.col("role") == role)
    if status:
        ok = ok & (F.col("status") == status)
    if word:
        ok = ok & F.lower(F.concat_ws("\n", "name", "email")).contains(word)
    return users.where(ok).orderBy(F.desc("user_id"))


def users_by(users: DataFrame) -> DataFrame:
    """(role, status, users): counts by both, and by each alone (the other null), and in all, by grouping sets."""
    return users.groupingSets([["role", "status"], ["role"], ["status"], []], "role", "status").agg(F.grouping_id().alias("level"), F.count("*").alias("users")).drop("level")


def type_fits(kind: str | None, *texts: Column) -> Column:
    """Whether a listing's names are of a product type and of no part of it; any listing is where no type is asked for."""
    words, without = TYPE_WORDS.get((kind or "").strip().lower(), ((), ()))
    text = F.concat_ws(" ", *(F.lower(T.blank(t)) for t in texts))
    ok = V.holds_any(text, words) if words else F.lit(True)
    return ok & ~V.holds_any(text, without) if without else ok


def search_fits(title: Column, keyword: str = "", kind: str | None = None) -> Column:
    """Whether a title is what a search for a keyword and a product type is after: the phone brand, no accessory unless one is asked for, and the model's number; a whole computer; a laptop; a phone; else a word of the keyword."""
    text, asked, kind = T.tidy(F.lower(T.blank(title))), " ".join(keyword.lower().split()), (kind or "").strip().lower()
    plain = F.lit(True) if any(w in asked for w in ASKED_ACCESSORIES) else ~V.holds_any(text, TITLE_ACCESSORIES)
    number = re.search(r"\d+", asked)
    for words in PHONE_BRANDS:
        if any(w in asked for w in words):
            return (text != "") & V.holds_any(text, words) & plain & (text.contains(number[0]) if number else F.lit(True))
    if kind == "desktop":
        ok = V.holds_any(text, LOOKS_PC) & V.holds_any(text, WHOLE_PC) & ~V.holds_any(text, PC_PARTS)
    elif kind == "laptop":
        ok = V.holds_any(text, LAPTOP_TITLES)
    elif kind == "smartphone":
        ok = plain & V.holds_any(text, PHONE_TITLES)
    elif len(asked) >= 2:
        tokens = tuple(t for t in re.split("[^0-9a-zA-Z가-힣]+", asked) if len(t) >= 2)
        ok = text.contains(asked) | (V.holds_any(text, tokens) if tokens else F.lit(False))
    else:
        ok = F.lit(True)
    return (text != "") & ok


def price_points(current: Column, lowest: Column) -> Column:
    """Points for a price near the lowest one, whose steps are rounded to whole units."""
    out = F.lit(0)
    for share, points in reversed(PRICE_POINTS):
        out = F.when(current <= F.floor(lowest * share + 0.5), points).otherwise(out)
    return F.when((lowest > 0) & current.isNotNull(), out).otherwise(0)


def age_points(seen: Column, as_of: Column) -> Column:
    """Points for a listing seen within so many days."""
    out = F.lit(0)
    for days, points in reversed(AGE_POINTS):
        out = F.when(seen > as_of - F.expr(f"INTERVAL {days} DAYS"), points).otherwise(out)
    return F.when(seen.isNotNull(), out).otherwise(0)


def reason(current: Column, lowest: Column, score: Column, use_case: str | None = None, game: str | None = None) -> Column:
    """Why a listing is recommended."""
    if use_case == "gaming":
        return F.lit(f"{game} 플레이 후보로 볼 만합니다. 옵션 타협 여부와 부품 구성을 함께 확인해 주세요." if game else "게이밍 용도로 볼 만한 상품입니다. CPU, GPU, RAM 구성을 함께 확인해 주세요.")
    low = (lowest > 0) & (current <= F.floor(lowest * PRICE_POINTS[1][0] + 0.5))
    return F.when(low, REASONS["lowest"]).when(score >= 100, REASONS["fitting"]).otherwise(REASONS["related"])


def recommendation_score(keyword: str, as_of: Column, kind: str | None = None, use_case: str | None = None, level: str | None = None) -> Column:
    """The whole-number score of a candidate: how its names hold the keyword, its use and performance level, its price against its lowest, its age; -100 for another product type."""
    word = keyword.strip().lower()
    names = {c: F.lower(T.blank(F.col(c))) for c in ("title", "canonical_name", "matched_keywords", "category_name")}
    score = F.lit(0)
    if word:
        score = F.when(names["canonical_name"] == word, 120).when(names["canonical_name"].contains(word), 100).otherwise(0) + F.when(names["title"] == word, 90).when(names["title"].contains(word), 70).otherwise(0)
        score = score + F.when(names["matched_keywords"].contains(word), 60).otherwise(0) + F.when(names["category_name"].contains(word), 35).otherwise(0)
    if (use_case or "").strip().lower() == "gaming":
        score = score + F.when(V.holds_any(names["title"], GAMING_POINTS[0]), GAMING_POINTS[1]).otherwise(0)
    if (level or "").strip().upper() in LEVEL_POINTS:
        words, points = LEVEL_POINTS[level.strip().upper()]
        score = score + F.when(V.holds_any(names["title"], words), points).otherwise(0)
    whole = score + price_points(F.col("current_price"), F.col("lowest_price")) + age_points(F.col("crawled_at"), as_of)
    return F.when(type_fits(kind, *names.values()), whole).otherwise(-100).cast("int")


def recommend(items: DataFrame, keyword: str, as_of: Column, low: int | None = None, high: int | None = None, limit: int = 10, most: int = 150, kind: str | None = None, use_case: str | None = None, level: str | None = None) -> DataFrame:
    """The ten best, with ``score`` and ``reason``, of at most 150 candidates (by item_id): on sale, priced, within bounds, keyword in a name."""
    word = keyword.lower()
    held = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(word) for c in ("canonical_name", "title", "matched_keywords", "category_name")]
    ok = (F.col("status") == V.ON_SALE) & (F.col("current_price") > 0) & (held[0] | held[1] | held[2] | held[3])
    if low is not None:
        ok = ok & (F.col("current_price") >= low)
    if high is not None:
        ok = ok & (F.col("current_price") <= high)
    candidates = items.where(ok).orderBy("item_id").limit(most)
    scored = candidates.withColumn("score", recommendation_score(keyword, as_of, kind, use_case, level)).where("score > 0")
    return scored.withColumn("reason", reason(F.col("current_price"), F.col("lowest_price"), F.col("score"), use_case)).orderBy(F.desc("score"), "current_price", "item_id").limit(limit)


def recommend_personal(items: DataFrame, wishlists: DataFrame, views: DataFrame, as_of: Column, newest: int = 30, limit: int = 10) -> DataFrame:
    """(user_id, item_id, current_price, score, reason, place): the best of the newest items by price and age, with bonuses for what a user wished for (30) or saw among the last 20 (15); the cheapest first, unpriced ones last."""
    points = price_points(F.col("current_price"), F.col("lowest_price")) + age_points(F.col("crawled_at"), as_of)
    pool = items.where(F.col("status") == V.ON_SALE).orderBy(F.desc("item_id")).limit(newest).withColumn("base", points).orderBy(F.desc("base"), F.desc("item_id")).limit(limit)
    pool = pool.select("item_id", "current_price", "base", reason(F.col("current_price"), F.col("lowest_price"), F.col("base")).alias("why"))
    made = [F.struct(F.lit(r["item_id"]).cast("long").alias("item_id"), F.lit(r["current_price"]).cast("long").alias("current_price"), F.lit(r["base"]).alias("base"), F.lit(r["why"]).alias("why")) for r in pool.collect()]  # ``limit`` at most
    wished = wishlists.select("user_id", "item_id").distinct().withColumn("wished", F.lit(30))
    seen = latest_distinct(views, "item_id", 20).select("user_id", "item_id").withColumn("seen", F.lit(15))
    users = wished.select("user_id").unionByName(seen.select("user_id")).distinct()
    offered = F.array(*made) if made else F.array().cast("array<struct<item_id: bigint, current_price: bigint, base: int, why: string>>")
    offers = users.select("user_id", F.explode(offered).alias("o")).select("user_id", "o.*")
    scored = offers.join(wished, ["user_id", "item_id"], "left").join(seen, ["user_id", "item_id"], "left").withColumn("score", F.col("base") + F.coalesce("wished", F.lit(0)) + F.coalesce("seen", F.lit(0)))
    told = F.concat_ws(" ", "why", F.when(F.col("wished").isNotNull(), REASONS["wished"]), F.when(F.col("seen").isNotNull(), REASONS["seen"]))
    order = Window.partitionBy("user_id").orderBy((F.coalesce("current_price", F.lit(0)) <= 0).cast("int"), "current_price", F.desc("score"), "item_id")
    return scored.select("user_id", "item_id", "current_price", "score", told.alias("reason"), F.row_number().over(order).alias("place"))


def personal_comparison(user_items: DataFrame, n: int = 5) -> DataFrame:
    """The n cheapest items of each user with the gap to the lowest and the spread to the dearest."""
    order = Window.partitionBy("user_id").orderBy("current_price", "item_id")
    top = user_items.where("current_price > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    whole = Window.partitionBy("user_id")
    return top.withColumn("gap", F.col("current_price") - F.min("current_price").over(whole)).withColumn("spread", F.max("current_price").over(whole) - F.min("current_price").over(whole))


#: The section of a user without products and without a keyword, which takes all recommendations, and how many a section has.
ANY_SECTION, SECTION_QUOTA = "추천 상품", 2


def picker_anchors(own: DataFrame, recommended: DataFrame, anchors: DataFrame) -> DataFrame:
    """(user_id, section, product_id, kind, place) of users without own products: one section, named by their keyword (anchors: user_id, keyword) or ``ANY_SECTION`` where that is blank, with the first ``SECTION_QUOTA`` recommendations that hold all its tokens; that without a keyword takes any."""
    name = F.coalesce(F.nullif(F.trim("keyword"), F.lit("")), F.lit(ANY_SECTION))
    users = anchors.join(own.select("user_id").distinct(), "user_id", "left_anti").select("user_id", name.alias("section")).distinct()
    tokens = F.filter(F.split(F.lower("section"), "[^0-9a-z가-힣]+"), lambda t: F.length(t) >= 2)
    fits = (F.col("section") == ANY_SECTION) | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.call_function("contains", F.lower("text"), t)))
    met = users.join(recommended, "user_id").where(fits)
    nth = F.row_number().over(Window.partitionBy("user_id", "section").orderBy("place", "product_id"))
    return met.withColumn("nth", nth).where(F.col("nth") <= SECTION_QUOTA).select("user_id", "section", "product_id", F.lit("recommended").alias("kind"), F.col("nth").alias("place"))


def picker_quota(own: DataFrame, recommended: DataFrame) -> DataFrame:
    """(user_id, section, product_id, kind, place): a section's own products, then two recommended ones (one if it has six or more), in the order in which they are recommended, that hold all its tokens. Sections choose one after the other; each takes what no
    earlier one took. The section of other products (no tokens) gets none.

    own: user_id, section, section_no, tokens, product_id, place; recommended: user_id, product_id, text, place. A user's sections and recommendations are a screen's lists.
    """
    sections = own.groupBy("user_id", "section", "section_no").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    fresh = recommended.join(own.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
    fits = sections.where(F.size("tokens") > 0).join(fresh, "user_id").where(F.forall("tokens", lambda t: F.call_function("contains", F.lower("text"), F.lower(t))))
    listed = fits.groupBy("user_id", "section", "section_no", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "product_id"))), lambda x: x["product_id"]).alias("ids"))
    kind = dict(own.dtypes)["product_id"]
    start = F.struct(F.array().cast(f"array<{kind}>").alias("used"), F.array().cast(f"array<struct<section: string, ids: array<{kind}>>>").alias("out"))

    def choose(state: Column, x: Column) -> Column:
        left = F.filter(x["ids"], lambda i: ~F.array_contains(state["used"], i))
        got = F.slice(left, 1, F.when(x["n"] >= 6, 1).otherwise(2))
        return F.struct(F.concat(state["used"], got).alias("used"), F.concat(state["out"], F.array(F.struct(x["section"].alias("section"), got.alias("ids")))).alias("out"))

    turn = F.array_sort(F.collect_list(F.struct("section_no", "section", "n", "ids")))
    chosen = listed.groupBy("user_id").agg(turn.alias("turns")).select("user_id", F.explode(F.aggregate("turns", start, choose, lambda s: s["out"])).alias("x"))
    more = chosen.select("user_id", "x.section", F.posexplode("x.ids").alias("at", "product_id"))
    return own.select("user_id", "section", "product_id", F.lit("own").alias("kind"), "place").unionByName(more.select("user_id", "section", "product_id", F.lit("recommended").alias("kind"), (F.col("at") + 1).alias("place")))


def longest_series(candidates: DataFrame, group: str) -> DataFrame:
    return candidates.groupBy(group).agg(F.max_by("points", F.struct(F.size("points"), (-F.col("place")).alias("p"))).alias("points"))


def ordered_union(*frames: DataFrame, key: str = "product_id") -> DataFrame:
    """The distinct keys of several lists (key, place): earlier lists first."""
    parts = [f.select(key, F.lit(k).alias("list"), "place") for k, f in enumerate(frames)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    first = whole.groupBy(key).agg(F.min(F.struct("list", "place")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("at", key))).select(key, "place")


def rotated(keywords: DataFrame, day: Column, n: int) -> DataFrame:
    """The list (idx, keyword) turned on by one place each day."""
    return keywords.withColumn("place", F.pmod(F.datediff(day, F.lit("1970-01-01")) + F.col("idx"), F.lit(n)))


def price_places(rows: DataFrame, group: str) -> DataFrame:
    return rows.withColumn("price_place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("price"), "place")))


def price_stats_daily(rows: DataFrame) -> DataFrame:
    """(canonical_name, platform_name, stat_date, counts and prices): a row for each platform and one (platform null) for all, by grouping sets."""
    day = rows.withColumn("stat_date", F.to_date("ts")).withColumnRenamed("platform", "platform_name")
    sets = day.groupingSets([["canonical_name", "platform_name", "stat_date"], ["canonical_name", "stat_date"]], "canonical_name", "platform_name", "stat_date")
    return sets.agg(F.count("*").alias("item_count"), F.min("price").alias("min_price"), F.round(F.avg("price"), 2).alias("avg_price"), F.max("price").alias("max_price"))


def search_ranking(events: DataFrame, period: str = "7 days") -> DataFrame:
    """(keyword, period_start, search_count, click_count, click_rate, place, trend) with the trend against the period before."""
    counts = events.where("keyword IS NOT NULL").groupBy(F.window("ts", period).alias("w"), "keyword").agg(F.count_if(F.col("event_type") == "SEARCH").alias("search_count"), F.count_if(F.col("event_type") == "IMPRESSION").alias("impression_count"), F.count_if(F.col("event_type") == "CLICK").alias("click_count"))
    return ranked(counts.select("keyword", F.col("w.start").alias("period_start"), "search_count", "impression_count", "click_count"))


def ranked(counts: DataFrame) -> DataFrame:
    """``counts`` of periods and keywords with click_rate, place in the period, and trend against the keyword's period before."""
    return placed(counts.withColumn("before", F.lag("search_count").over(Window.partitionBy("keyword").orderBy("period_start"))))


def placed(counts: DataFrame) -> DataFrame:
    """``counts`` with ``before``, the keyword's searches in its period before, as click_rate, place and trend. Places are numbers in one sort by ranges, less those of the periods before, so that neither a period nor the many keywords with equal counts are one task's work."""
    trend = F.when(F.col("before").isNull(), "NEW").when(F.col("search_count") > F.col("before"), "UP").when(F.col("search_count") < F.col("before"), "DOWN").otherwise("SAME")
    known = counts.withColumn("trend", trend).withColumn("click_rate", F.when(F.col("impression_count") > 0, F.round(F.col("click_count") / F.col("impression_count"), 4))).drop("before")
    sorted_ = numbered(known, [F.asc("period_start"), F.desc("search_count"), F.asc("keyword")], "number")
    first = sorted_.groupBy("period_start").agg(F.min("number").alias("first"))
    return sorted_.join(first, "period_start").withColumn("place", (F.col("number") - F.col("first") + 1).cast("int")).drop("number", "first")


def seeded_sample(rows: DataFrame, n: int, seed: int, key: Column) -> DataFrame:
    """n rows by the hash of key and seed: the same ones whatever the partitions are."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def product_view(items: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """Products of the search service: the canonical name, else the category, is their heading; their points are (label, date, price) of the history, else the current price."""
    text = {c: T.blank(F.col(c)) if c in items.columns else F.lit("") for c in ("title", "canonical_name", "category_name", "matched_keywords")}
    price = F.coalesce("current_price", F.lit(0)).cast("long")
    known = F.transform("points", lambda p: F.struct(V.day_label(p["recorded_at"]).alias("label"), V.iso_day(p["recorded_at"]).alias("date"), p["price"].cast("long").alias("price")))
    alone = F.array(F.struct(F.lit("현재").alias("label"), F.lit(None).cast("string").alias("date"), price.alias("price")))
    heading = F.when(text["canonical_name"] != "", text["canonical_name"]).otherwise(text["category_name"])
    points = F.coalesce(known, alone)
    return items.join(series(history), "item_id", "left").select(
        "item_id", text["title"].alias("title"), heading.alias("category"), price.alias("current_price"), V.import_state(F.col("status")).alias("status"), points.alias("points"), lowest_of(points, price).alias("lowest_price"),
        F.concat_ws(" ", *text.values()).alias("search_text"),
    )


def service_view(items: DataFrame, as_of: Column) -> DataFrame:
    """Products of the product service: platform, category and brand told from the texts where they aren't given, a description, three images, the lowest and the current price or an estimated series."""
    has = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    platform, kind = V.platform(has("platform_name"), has("item_url")), V.category(has("category_name"), has("title"), has("canonical_name"))
    return items.select(
        "item_id", platform.alias("platform"), F.coalesce(has("original_id"), F.lit("")).alias("pid"), F.coalesce(has("title"), F.lit("")).alias("title"), kind.alias("category"),
        V.brand(kind, has("title"), has("canonical_name"), has("matched_keywords")).alias("brand"), F.coalesce("current_price", F.lit(0)).alias("price"), V.state(has("status")).alias("status"),
        V.description(has("description"), has("title"), platform).alias("description"), V.images(has("thumbnail_url"), 3).alias("images"), V.service_series(F.col("current_price"), F.col("lowest_price"), F.to_date(as_of)).alias("points"),
    )


def simple_search(items: DataFrame, query: str = "", platforms: tuple[str, ...] = (), sort: str = "low_price", page: int = 1, limit: int = 20) -> DataFrame:
    """A page of the on-sale items whose title holds the query, of ``platforms`` if there are any: the cheapest first, or the newest; any other order is the table's, here by id. Pages and sizes below one count as one."""
    ok = (F.col("status") == V.ON_SALE) & F.lower("title").contains(query.strip().lower())
    if platforms:
        ok = ok & F.col("platform_name").isin(*(p.strip() for p in platforms))
    order = {"low_price": [F.coalesce("current_price", F.lit(0)), "item_id"], "recent": [F.desc("item_id")]}.get(sort, ["item_id"])
    page, limit = max(page, 1), max(limit, 1)
    return items.where(ok).orderBy(*order).offset((page - 1) * limit).limit(limit)


def combined_search(items: DataFrame, query: str, limit: int = 20, platforms: tuple[str, ...] = (), sort: str = "relevance", page: int = 1, find=None) -> DataFrame:
    """A page of the field search's items in its order, cut to the query's intent and to ``limit``. ``find`` (query, limit, platforms, sort, page) gives (document_id, score) from a kept index; without it all documents are read. A blank query goes to ``search`` over the items' names (by low_price, recent or relevance)."""
    if not query.strip():
        platform = next((c for c in ("platform_name", "platform") if c in items.columns), None)
        rows = items.select("*", F.col("title").alias("name"), F.lit("").alias("keyword"), F.col("current_price").alias("price"), F.col("crawled_at").alias("ts"), F.col("item_id").cast("string").alias("pid"), *([F.col(platform).alias("_platform")] if platform else [F.lit("").alias("_platform")]))
        rows = rows.drop("platform").withColumnRenamed("_platform", "platform")
        found = search(rows, "", platforms, sort, page, limit)
        return found.withColumn("place", F.lit(None).cast("int"))
    size = widened(query, limit)
    ranked = find(query, size, platforms, sort, page) if find else field_search(documents(items), query, size, platforms=platforms, sort=sort, page=page)
    order = {"relevance": [], "recent": [F.desc_nulls_last("day")], "low_price": [F.asc_nulls_last("price")]}[sort]
    known = items.select(F.col("item_id").cast("string").alias("document_id"), F.date_format("crawled_at", "yyyy-MM-dd").alias("day"), F.col("current_price").alias("price"))
    placed = ranked.join(known, "document_id").select(F.col("document_id").cast("long").alias("item_id"), F.row_number().over(Window.orderBy(*order, F.desc("score"), "document_id")).alias("place"))  # a page of two hundred rows at most
    return hydrate(placed, items).where(fits_intent(query, F.col("title"), F.col("canonical_name"), F.col("category_name"))).orderBy("place").limit(limit)


def newest_of(rows: DataFrame, user: str, time: str, key: str, oldest_first: bool = False, since: Column | None = None) -> DataFrame:
    """Each user's rows in order of time: listings, notifications and alerts newest first, chats oldest first."""
    kept = rows if since is None else rows.where(F.col(time) >= since)
    return kept.orderBy(user, F.asc(time) if oldest_first else F.desc(time), key)


def finder(items: DataFrame, category: str | None = None, title: str | None = None, on_sale: bool = False) -> DataFrame:
    """Items of a category, with a text in their title, or on sale, newest first."""
    ok = F.lit(True)
    if category is not None:
        ok = ok & (F.col("category_name") == category)
    if title is not None:
        ok = ok & F.lower("title").contains(title.lower())
    if on_sale:
        ok = ok & (F.col("status") == V.ON_SALE)
    return items.where(ok).orderBy(F.desc("item_id"))


def simple_counts(items: DataFrame, wishlists: DataFrame, views: DataFrame) -> DataFrame:
    """(metric, value): items on sale, wishes, users with wishes, views."""
    on_sale = items.agg(F.count_if(F.col("status") == V.ON_SALE).alias("on_sale_items"))
    wishes = wishlists.agg(F.count("*").alias("wishes"), F.count_distinct("user_id").alias("users_with_wishes"))
    seen = views.agg(F.count("*").alias("views"))
    parts = [df.unpivot([], df.columns, "metric", "value") for df in (on_sale, wishes, seen)]
    return parts[0].union(parts[1]).union(parts[2])


def view_counts(items: DataFrame, views: DataFrame) -> DataFrame:
    """(item_id, view_count) of every item."""
    return items.select("item_id").join(views.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("view_count"))
