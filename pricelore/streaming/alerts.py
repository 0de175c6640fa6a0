"""Streams of prices, listings and search events: alerts, rankings and daily statistics. Each has a batch twin elsewhere in the library.

Watermarks default to 14 days, the age up to which listings are taken in. Tables that a stream is joined to are static frames, read anew in each micro-batch by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from pricelore.functions import values as V
from pricelore.operators.insight import placed, reached_alerts
from pricelore.operators.matching import missing_tokens
from pricelore.functions import text as T
from pricelore.shared import FEW
from pricelore.sources.listings import history_points, last_by_key

if TYPE_CHECKING:
    import pandas as pd

LATE = "14 days"
#: Keys that a partition of state holds. Each one costs every micro-batch its opening and its commit, whether it has rows or not, so small states aren't spread over all of a shuffle's partitions.
STATE_KEYS = 5_000


def price_alerts(updates: DataFrame, wishlists: DataFrame, late: str = LATE) -> DataFrame:
    """updates (item_id, current_price, lowest_price, ts) against static wishlists: one alert for each user, item and price within the watermark."""
    hit = updates.withWatermark("ts", late).join(wishlists, "item_id").where((F.col("current_price") <= F.col("target_price")) | ((F.upper("is_lowest_alert") == "Y") & (F.col("current_price") <= F.col("lowest_price"))))
    return hit.select("user_id", "item_id", "current_price", "ts").dropDuplicatesWithinWatermark(["user_id", "item_id", "current_price"])


def _pieces(text: Column) -> Column:
    """The distinct characters and pairs of neighbouring characters of a text."""
    n = F.length(text)
    run = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(run(1), run(2)))


def piece_counts(titles: DataFrame, column: str = "name") -> DataFrame:
    """(piece, n): in how many titles each character and pair of characters stands. A table to keep, and to make anew now and then."""
    texts = titles.groupBy(column).agg(F.count("*").alias("n")).select("n", T.normal(F.col(column), "none").alias("_title"))
    return texts.select("n", F.explode(_pieces(F.col("_title"))).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))


def alert_index(alerts: DataFrame, settings: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(piece, user_id, keyword, tokens): active alerts of users who want news of new items, under the rarest piece of their tokens by ``counts`` (``piece_counts``; without them by the alerts themselves). A title that holds all tokens of an alert holds all pieces of them."""
    active = alerts.where("is_active").join(settings.where("new_item_enabled").select("user_id").distinct(), "user_id").select("user_id", "keyword", T.keyword_tokens(F.col("keyword")).alias("tokens")).where(F.size("tokens") > 0).distinct()
    of_token = lambda t: F.when(F.length(t) < 2, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))
    each = active.select("user_id", "keyword", "tokens", F.explode(F.array_distinct(F.flatten(F.transform("tokens", of_token)))).alias("piece"))
    known = each.groupBy("piece").agg(F.count("*").alias("n")) if counts is None else counts.select("piece", "n")
    ranked_ = each.join(known, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked_.groupBy("user_id", "keyword", "tokens").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece")).select("piece", "user_id", "keyword", "tokens")


def keyword_alerts(listings: DataFrame, alerts: DataFrame, settings: DataFrame, late: str = LATE, counts: DataFrame | None = None) -> DataFrame:
    """New listings (item_id, name, ts) whose title holds all tokens of an active alert of a user who wants news of new items, wherever in a word. Alerts meet listings through their rarest piece (``alert_index``), so a common brand brings no listing to all alerts."""
    held = alert_index(alerts, settings, counts)
    # counted when the stream is made, and read anew by each micro-batch; left to the planner, the listings' pieces may be what is broadcast
    held = F.broadcast(held) if held.limit(FEW + 1).count() <= FEW else held.hint("merge")
    titled = listings.withWatermark("ts", late).withColumn("_title", T.normal(F.col("name"), "none"))
    met = titled.withColumn("piece", F.explode(_pieces(F.col("_title")))).join(held, "piece").where(F.size(missing_tokens(F.col("tokens"), F.col("_title"))) == 0)
    return met.select("user_id", "keyword", "item_id", "name", "ts").dropDuplicatesWithinWatermark(["user_id", "keyword", "item_id"])


#: Items of one hash are one group of ``sold_alerts``: a group costs milliseconds in Spark's exchange with Python whatever is in it, so its number is bounded.
SOLD_GROUPS = 65_536
#: So long an item's updates are kept after its last one, in milliseconds.
SOLD_KEPT = 14 * 86_400_000


def sold_alerts(updates: DataFrame, late: str = LATE, sold: str = V.SOLD, groups: int = SOLD_GROUPS) -> DataFrame:
    """(item_id, ts, status_before): one row whenever an item's state turns to sold.

    The state kept for an item are its updates since the watermark and the last one before it, so an update that comes late, within the watermark, is put in its place and raises the alert that it gives rise to; an alert that was sent isn't taken back. An
    item's state goes when the watermark has passed its last update by two weeks. The items of a hash share a group and its state; ``groups`` must stay the same over a checkpoint's life.
    """

    import numpy as np
    import pandas as pd

    def turns(rows: list[tuple[int, str]]) -> dict[int, str]:
        return {at: before for (_, before), (at, status) in zip(rows, rows[1:], strict=False) if status == sold and before != sold}

    def by_item(rows: Iterable[tuple]) -> dict[int | None, list[tuple[int, str]]]:
        found: dict = {}
        for item, at, status in rows:
            found.setdefault(item, []).append((at, status))
        return found

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = by_item(zip(*state.get, strict=True)) if state.exists else {}
        items = lambda f: f["item_id"].tolist() if key[0] >= 0 else [None] * len(f)
        read = [] if state.hasTimedOut else [zip(items(f), f["ts"].to_numpy("datetime64[us]").astype("int64").tolist(), f["status"].tolist(), strict=True) for f in frames]
        new = by_item(row for rows in read for row in rows)
        out, kept, until = [], [], []
        for item, rows in (held | new).items():
            if item in new:
                before = held.get(item, [])
                rows = sorted(before + rows)
                told = turns(before)
                out += [(item, at, status) for at, status in turns(rows).items() if at not in told]
                passed = sum(at < mark * 1000 for at, _ in rows)
                rows = rows[max(passed - 1, 0) :]
            elif rows[-1][0] // 1000 + SOLD_KEPT < mark:
                continue
            kept += [(item, *row) for row in rows]
            until.append(rows[-1][0] // 1000 + SOLD_KEPT)
        if kept:
            state.update(tuple(map(list, zip(*kept, strict=True))))
            state.setTimeoutTimestamp(max(min(until), mark + 1))
        else:
            state.remove()
        if out:
            item, at, before = zip(*out, strict=True)
            yield pd.DataFrame({"item_id": item, "ts": np.array(at, "datetime64[us]"), "status_before": before})

    group = F.when(F.col("item_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    keyed = updates.select("item_id", "ts", "status", group.alias("_group")).withWatermark("ts", late).groupBy("_group")
    return keyed.applyInPandasWithState(step, "item_id long, ts timestamp, status_before string", "item array<long>, at array<long>, status array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def sold_transitions(updates: DataFrame, sold: str = V.SOLD) -> DataFrame:
    """The batch twin of ``sold_alerts``."""
    from pyspark.sql import Window

    before = F.lag("status").over(Window.partitionBy("item_id").orderBy("ts", "status"))
    return updates.withColumn("status_before", before).where((F.col("status") == sold) & (F.col("status_before") != sold)).select("item_id", "ts", "status_before")


def search_counts(events: DataFrame, period: str = "7 days", late: str = LATE) -> DataFrame:
    """Counts of each keyword and tumbling period; places are given where the batch is written, once a window is closed."""
    counts = events.withWatermark("ts", late).where("keyword IS NOT NULL").groupBy(F.window("ts", period).alias("w"), "keyword")
    return counts.agg(*(F.count_if(F.col("event_type") == k).alias(f"{k.lower()}_count") for k in ("SEARCH", "IMPRESSION", "CLICK"))).select(F.col("w.start").alias("period_start"), "keyword", "search_count", "impression_count", "click_count")


def daily_stats(listings: DataFrame, late: str = LATE) -> DataFrame:
    """Daily statistics by name and platform, and (platform null) by name alone: each listing goes into both groups."""
    both = listings.withWatermark("ts", late).withColumn("platform_name", F.explode(F.array(F.col("platform"), F.lit(None).cast("string"))))
    day = F.window("ts", "1 day").alias("w")
    return both.groupBy(day, "canonical_name", "platform_name").agg(F.count("*").alias("item_count"), F.min("price").alias("min_price"), F.round(F.avg("price"), 2).alias("avg_price"), F.max("price").alias("max_price")).select("canonical_name", "platform_name", F.to_date("w.start").alias("stat_date"), "item_count", "min_price", "avg_price", "max_price")


#: So many runs of one size are merged into one.
FAN = 8


def merge_listings(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that takes each micro-batch of records into the item table and the history below ``path``. A batch writes a run of what it changed; each ``FAN`` runs of a size become one, so a row is written again once for each size and a batch costs what its own rows do, whatever the tables hold. Runs
    that a larger one replaces go when ``FAN`` more batches are done. A batch that is run again overwrites its own runs only. Read the tables by ``items_of`` and ``history_of``."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        items = last_by_key(batch, ["platform_name", "original_id"], ["crawled_at"])
        points = history_points(batch, items.withColumn("item_id", F.xxhash64("platform_name", "original_id")))
        for name, keys, rows in (("items", ITEM_KEYS, items), ("history", POINT_KEYS, points)):
            folder = f"{path}/{name}"
            rows.write.mode("overwrite").parquet(f"{folder}/run={number}-{number}")
            size = FAN
            while (number + 1) % size == 0:
                first = number + 1 - size
                _latest(spark, folder, [(k, min(k + size // FAN - 1, number)) for k in range(first, number + 1, size // FAN)], keys, rows.schema).write.mode("overwrite").parquet(f"{folder}/run={first}-{number}")
                size *= FAN
            known = _runs(spark, folder)
            now = set(_cover(known))
            _remove(spark, [f"{folder}/run={a}-{b}" for a, b in known if (a, b) not in now and any(x <= a and b <= y <= number - FAN for x, y in now)])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ITEM_KEYS, POINT_KEYS = ["platform_name", "original_id"], ["item_id", "recorded_at"]


def items_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """The items of ``merge_listings``: of each key what the last batch that has it brought."""
    return _table(spark, f"{path}/items", ITEM_KEYS, schema)


def history_of(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, f"{path}/history", POINT_KEYS, "item_id long, recorded_at date, price long")


def _folders(spark: SparkSession, path: str, kind: str) -> list[str]:
    """What follows ``kind=`` in the names of the complete folders below ``path``. A folder that can't be listed is an error; one that isn't there has none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in files.listStatus(folder) if files.exists(folder) else []:
        name, _, rest = entry.getPath().getName().partition("=")
        if name == kind and files.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found.append(rest)
    return found


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(p)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    return sorted(tuple(map(int, r.split("-"))) for r in _folders(spark, path, "run"))


def _cover(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The largest runs, one after the other, that hold every batch once."""
    out, at = [], -1
    for first, last in sorted(runs, key=lambda r: (r[0], -r[1])):
        if first > at:
            out.append((first, last))
            at = last
    return out


def _latest(spark: SparkSession, path: str, runs: list[tuple[int, int]], keys: list[str], schema) -> DataFrame:
    """Runs put together: the later one wins."""
    if not runs:
        return spark.createDataFrame([], schema)
    rows = [spark.read.schema(schema).parquet(f"{path}/run={a}-{b}").withColumn("_run", F.lit(a)) for a, b in runs]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return last_by_key(whole, keys, ["_run"]).drop("_run")


def _table(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    return _latest(spark, path, _cover(_runs(spark, path)), keys, schema)


COUNTS = "keyword string, period_start timestamp, search_count long, impression_count long, click_count long, before long"


class _Before(StatefulProcessor):
    """Keeps of a keyword the searches of its last closed period."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "search_count long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import pandas as pd

        own = pd.concat(list(rows)).sort_values("period_start")
        held = self.last.get() if self.last.exists() else (None,)
        own["before"] = pd.array([held[0], *own["search_count"].tolist()[:-1]], dtype="Int64")
        self.last.update((int(own["search_count"].iloc[-1]),))
        yield own[[c.split()[0] for c in COUNTS.split(", ")]]

    def close(self) -> None:
        pass


def with_before(counts: DataFrame) -> DataFrame:
    """``search_counts`` as they close, with the keyword's searches in its period before: one number of state for each keyword. The window's aggregate comes first, so a hot keyword is one row here. Needs the RocksDB state store."""
    return counts.groupBy("keyword").transformWithStateInPandas(_Before(), COUNTS, "Append", "None")


def state_partitions(events: DataFrame, key: str) -> int:
    """As many partitions as the state of the distinct values of ``key`` takes. A checkpoint keeps the number that its query began with."""
    return max(math.ceil(events.agg(F.approx_count_distinct(key)).first()[0] / STATE_KEYS), 1)


def write_rankings(counts: DataFrame, path: str, checkpoint: str, partitions: int | None = None):
    """Starts a query that ranks each period of ``search_counts`` once it is closed: places by searches, and the trend against the keyword's period before, which the state holds: nothing that was written is read again. A batch that is run again overwrites its own rows only.
    ``partitions``: those of the state (see ``state_partitions``), else those of the session's shuffles."""
    order = ["keyword", "period_start", "search_count", "impression_count", "click_count", "click_rate", "place", "trend"]

    def rank(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the sort passes it more than once, and each pass would run the state anew
        try:
            placed(batch).select(*order).write.mode("overwrite").parquet(f"{path}/version={number}")
        finally:
            batch.unpersist()

    with state_on_disk(counts.sparkSession, partitions):
        return with_before(counts).writeStream.foreachBatch(rank).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def state_on_disk(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB, so that it isn't held in the heap, in ``partitions`` if given; a query takes the session's settings when it starts."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    held = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in held.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def replay(spark: SparkSession, frame: DataFrame, build, checkpoint: str, name: str, mode: str = "append", one_by_one: bool = False, key: str | None = None) -> DataFrame:
    """Writes ``frame`` to files, runs ``build`` over them as a stream until all is read, and returns what came out. For tests and for the batch comparison. ``one_by_one`` makes a micro-batch of each file. ``key``: the column whose values the state holds, if they are few beside the rows."""
    source, sink = f"{checkpoint}/{name}/in", f"{checkpoint}/{name}/out"
    frame.write.mode("overwrite").parquet(source)
    reader = spark.readStream.schema(frame.schema)
    out = build((reader.option("maxFilesPerTrigger", 1) if one_by_one else reader).parquet(source))
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}/state").trigger(availableNow=True)
    with state_on_disk(spark, state_partitions(spark.read.schema(frame.schema).parquet(source), key) if key else None):
        query = (writer.format("parquet").option("path", sink) if mode == "append" else writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(sink))).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


__all__ = ["alert_index", "daily_stats", "history_of", "items_of", "keyword_alerts", "merge_listings", "piece_counts", "price_alerts", "reached_alerts", "replay", "search_counts", "sold_alerts", "sold_transitions", "state_on_disk", "state_partitions", "with_before", "write_rankings"]
