"""Reading and writing of listings, lists and reports: CSV and pages in, Parquet out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelore.functions import text as X
from pricelore.functions import values as V

if TYPE_CHECKING:
    import pandas as pd

_texts = lambda *names: [T.StructField(n, T.StringType()) for n in names]
RAW = T.StructType(_texts("keyword", "platform", "pid", "name", "price", "status", "image_url", "link", "date", "matched_keywords", "canonical_name"))
#: Fixed value: words that switch a configuration row off.
OFF = ("0", "false", "n", "no", "비활성")


def read_listings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Listing CSVs (UTF-8, byte order mark allowed) with ``price_numeric``; columns that a file lacks are null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    missing = {f.name: F.lit(None).cast("string") for f in RAW if f.name not in raw.columns}
    return raw.withColumns(missing).select(*(f.name for f in RAW), *(c for c in raw.columns if c not in RAW.names)).withColumn("price_numeric", V.price(F.col("price"), "number"))


def newest_file(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """The rows of the file of ``directory`` that was written last, found by the reader's metadata."""
    rows = spark.read.option("header", True).option("pathGlobFilter", pattern).csv(directory).withColumns({"_path": F.col("_metadata.file_path"), "_written": F.col("_metadata.file_modification_time")})
    newest = rows.groupBy("_path", "_written").agg(F.lit(1)).orderBy(F.desc("_written"), F.desc("_path")).limit(1).select("_path")
    return rows.join(F.broadcast(newest), "_path", "left_semi").drop("_path", "_written")


def is_preview(columns: list[str]) -> bool:
    return {"cluster_product_name", "price_numeric"} <= set(columns)


def to_record(rows: DataFrame, as_of: Column) -> DataFrame:
    """One record schema from either import schema, chosen by the header."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    preview = is_preview(rows.columns)
    value = V.price(has("price_numeric"), "number").cast("long") if preview else V.price(has("price"), "digits")
    name = F.coalesce(F.nullif(X.blank(has("cluster_product_name")), F.lit("")), F.nullif(X.blank(has("canonical_name")), F.lit("")), has("name"))
    return rows.select(X.blank(has("platform")).alias("platform_name"), X.blank(has("pid")).alias("original_id"), name.alias("canonical_name"), X.blank(has("name")).alias("title"), value.alias("current_price"), V.import_state(has("status")).alias("status"), has("link").alias("item_url"), V.image_url(has("image_url")).alias("thumbnail_url"), V.moment(has("date"), as_of).alias("crawled_at"), has("cluster_route").alias("cluster_route"))


def complete(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with platform, id, title and price, one row with how many were skipped)."""
    ok = (F.col("platform_name") != "") & (F.col("original_id") != "") & (F.col("title") != "") & F.col("current_price").isNotNull()
    return records.where(ok), records.agg(F.count_if(~ok).alias("skipped"), F.count("*").alias("read"))


def read_config(spark: SparkSession, path: str, list_column: str | None = None) -> DataFrame:
    """The enabled rows of a configuration CSV; a list cell becomes one row for each entry."""
    rows = spark.read.option("header", True).csv(path)
    if "enabled" in rows.columns:
        rows = rows.where(~F.lower(X.blank(F.col("enabled"))).isin(*OFF))
    return rows.withColumn(list_column, F.explode(X.split_list(F.col(list_column)))) if list_column else rows


def word_list(lines: DataFrame, column: str, fallback: tuple[str, ...], normalise: bool = False) -> DataFrame:
    """Distinct (word) of a list column without ``#`` comments and repeated headers; the fallback where that is empty. ``normalise`` takes each word of an entry's normal form, without signs at its edges."""
    kept = lines.where(~X.blank(F.col(column)).startswith("#") & (F.lower(X.blank(F.col(column))) != column.lower()))
    word = F.explode(F.transform(F.split(X.normal(F.col(column), "none"), " "), lambda w: F.regexp_replace(w, r"(?U)^\W+|\W+$", ""))) if normalise else X.blank(F.col(column))
    found = kept.select(word.alias("word")).where("word <> ''").distinct()
    return lines.sparkSession.createDataFrame([(w,) for w in fallback], "word string") if found.isEmpty() and fallback else found


def name_blacklist(lines: DataFrame, column: str = "keyword") -> tuple[str, ...]:
    """The words that drop a listing by its name, from a list's rows; the built-in ones where the list is empty. A configuration list is small."""
    from pricelore.operators.prices import BLACKLIST

    return tuple(r["word"] for r in word_list(lines, column, BLACKLIST).orderBy("word").collect())


def write_refined(clean: DataFrame, dropped: DataFrame, path: str) -> None:
    """The clean set in order and the drop log. Ranges are sorted apart, so no task sees all rows."""
    order = [c for c in ("keyword", "cluster_product_name", "price", "platform", "pid") if c in clean.columns]
    clean.orderBy(*order).write.mode("overwrite").parquet(f"{path}/clean")
    dropped.write.mode("overwrite").parquet(f"{path}/dropped")


def write_report(report: DataFrame, path: str, name: str, run: str) -> None:
    """A copy of the run and the latest one."""
    for where in (f"{path}/run={run}/{name}", f"{path}/latest/{name}"):
        report.write.mode("overwrite").parquet(where)


def write_by_keyword(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("keyword").parquet(path)


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, as one aggregate: partial sums meet before the shuffle, so a hot key is no task's burden."""
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return found.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` merged with ``batch``: the batch wins over the target, its later rows over its earlier ones. Null parts of a key equal each other. Repeating it changes nothing."""
    both = target.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return last_by_key(both, keys, ["_batch", *order]).drop("_batch")


def history_points(records: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, recorded_at, price): a day's last price; records of unknown items are left out."""
    known = records.join(items.select("platform_name", "original_id", "item_id"), ["platform_name", "original_id"])
    return known.groupBy("item_id", F.to_date("crawled_at").alias("recorded_at")).agg(F.max_by("current_price", F.struct("crawled_at", "current_price")).alias("price"))


def newest(rows: DataFrame, n: int | None = None) -> DataFrame:
    ordered = rows.orderBy(F.desc("crawled_at"), F.desc("item_id"))
    return ordered.limit(n) if n else ordered


#: A record of a result page as it stands there, its quotes escaped, and the fields that its groups hold.
PAGE_RECORD = r'(?s)\{\\"seq\\":(\d+).*?\\"price\\":(\d+).*?\\"url\\":\\"(.*?)\\".*?\\"title\\":\\"(.*?)\\",\\"state\\":(\d+),\\"sortDate\\":\\"(.*?)\\"'
PAGE_FIELDS = ("pid", "price", "image_url", "name", "status", "date")


def unescaped(text: Column) -> Column:
    """A JSON string's content read as JSON; as it stands where it is none."""
    return F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "v string")["v"], text)


def page_records(pages: DataFrame, column: str = "html") -> DataFrame:
    """Listing rows of result pages (page_id, html), record by record: a record that lacks a field has no row and shifts no other."""
    each = pages.select("page_id", F.explode(F.regexp_extract_all(F.col(column), F.lit(PAGE_RECORD), F.lit(0))).alias("record"))
    rows = each.select("page_id", *(F.regexp_extract("record", PAGE_RECORD, k + 1).alias(f) for k, f in enumerate(PAGE_FIELDS)))
    return rows.withColumns({"name": unescaped(F.col("name")), "image_url": unescaped(F.col("image_url")), "price": F.col("price").try_cast("long"), "status": V.code_state(F.col("status"), V.PAGE_CODES)})


API = "struct<list: array<struct<pid: string, name: string, price: string, status: string, product_image: string, update_time: long>>>"


def api_records(payloads: DataFrame, column: str, as_of: Column, days: int = 14, link: str = "https://m.example.com/products/{}") -> DataFrame:
    """Listing rows of JSON payloads, not older than ``days``."""
    rows = payloads.select(F.explode(F.from_json(column, API)["list"]).alias("r")).select("r.*")
    out = rows.select("pid", "name", V.price(F.col("price")).alias("price"), V.code_state(F.col("status"), V.API_CODES).alias("status"), V.image_url(F.col("product_image")).alias("image_url"), F.replace(F.lit(link), F.lit("{}"), F.col("pid")).alias("link"), F.timestamp_seconds("update_time").alias("ts"))
    return recent(out, as_of, days)


def recent(rows: DataFrame, as_of: Column, days: int = 14, column: str = "ts") -> DataFrame:
    return rows.where(F.col(column) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


#: Attributes and names of description tags in order, and site slogans that say nothing.
META = (("name", "description"), ("property", "og:description"), ("name", "twitter:description"))
SLOGANS = ("직거래부터 택배거래까지 쉽고 안전하게, 취향 기반 중고거래 플랫폼", "취향을 잇는 거래, 번개장터")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def page_description(html: Column) -> Column:
    """The first description of a page's tags that says something; attributes may stand in any order."""
    tags = F.regexp_extract_all(html, F.lit("""(?is)<meta\\b(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))

    def content(attribute: str, name: str) -> Column:
        tag = F.get(F.filter(tags, lambda t: t.rlike(rf"""(?is)\b{attribute}\s*=\s*["']?{name}["'\s/>]""")), F.lit(0))
        text = F.regexp_extract(tag, r"""(?is)\scontent\s*=\s*("[^"]*"|'[^']*')""", 1)
        text = F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
        for a, b in ENTITIES:
            text = F.replace(text, F.lit(a), F.lit(b))
        text = X.tidy(text)
        return F.when(~text.isin("", *SLOGANS), text)

    return F.coalesce(*(content(*m) for m in META), F.lit(""))


#: Keys that hold keywords, keys of ranking blocks and of blocks that are passed over, words that are no keywords.
KEYWORD_KEYS = ("keyword", "keywords", "query", "queries", "searchword", "searchwords", "search_word", "search_words", "word", "words", "term", "terms")
RANKING = ("popular", "popularsearch", "popularsearches", "popularkeywords", "ranking", "rankings", "rank", "realtime", "realtimekeyword", "trend", "trends")
PASSED = ("category", "categories", "navigation", "nav", "menu", "gnb", "lnb", "footer")
NO_KEYWORDS = (
    "검색", "채팅하기", "로그인", "회원가입", "전체", "메뉴", "홈", "이전", "다음", "더보기", "앱 다운로드", "수입명품", "패션의류", "패션잡화", "뷰티", "출산/유아동", "모바일/태블릿", "가전제품", "노트북/pc",
    "카메라/캠코더", "가구/인테리어", "리빙/생활", "게임", "반려동물/취미", "도서/음반/문구", "티켓/쿠폰", "스포츠", "레저/여행", "중고차", "오토바이",
)


def keyword_text(text: Column) -> Column:
    """A keyword in its plain form: single spaces, no number in front, lower case."""
    return F.lower(F.regexp_replace(X.tidy(text), r"^\d+\s*", ""))


def popular_keywords(pages: DataFrame, existing: DataFrame, n: int = 20, column: str = "html") -> DataFrame:
    """(keyword, place): the texts that JSON blocks hold in lists, or under a keyword's key, below a ranking key and not below one that is passed over; valid and distinct in order. The existing list if fewer than three are found."""

    def walk(node, ranked: bool) -> Iterator[str]:
        if isinstance(node, list):
            for v in node:
                if ranked and isinstance(v, str):
                    yield v
                else:
                    yield from walk(v, ranked)
        if isinstance(node, dict):
            for k, v in node.items():
                key = "".join(c for c in k.lower() if "a" <= c <= "z")
                if key in PASSED:
                    continue
                below = ranked or key in RANKING
                if below and key in KEYWORD_KEYS and isinstance(v, str):
                    yield v
                yield from walk(v, below)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for frame in frames:
            out = []
            for page, blocks in zip(frame["page_id"], frame["blocks"], strict=True):
                k = 0
                for block in blocks if blocks is not None else []:
                    try:
                        tree = json.loads(block)
                    except ValueError:
                        continue
                    for word in walk(tree, False):
                        out.append((page, k, word))
                        k += 1
            yield pd.DataFrame(out, columns=["page_id", "k", "word"])

    blocks = F.regexp_extract_all(column, F.lit(r"""(?s)<script[^>]*type=["']?application/json["']?[^>]*>(.*?)</script>"""), F.lit(1))
    words = pages.select("page_id", blocks.alias("blocks")).where(F.size("blocks") > 0).mapInPandas(run, "page_id long, k int, word string").withColumn("word", keyword_text(F.col("word")))
    valid = words.where(F.length("word").between(2, 40) & ~F.col("word").isin(*NO_KEYWORDS) & ~F.col("word").rlike(r"(?U)^[\W_]+$"))
    first = valid.groupBy("word").agg(F.min(F.struct("page_id", "k")).alias("at")).orderBy("at", "word").limit(n)
    found = first.select(F.col("word").alias("keyword"), (F.row_number().over(Window.orderBy("at", "word"))).alias("place"))
    return found if found.count() >= 3 else existing.select("keyword", "place")


def match_evidence(matches: DataFrame, accuracy: DataFrame) -> DataFrame:
    """(item_id, keyword, score, reason, source): one row for each key, the best score first, then the source."""
    best = lambda df, source: df.select("item_id", "keyword", "score", "reason", F.lit(source).alias("source"))
    both = best(matches, "title_match").unionByName(best(accuracy, "token_rule"))
    return last_by_key(both, ["item_id", "keyword"], ["score", "source"])
