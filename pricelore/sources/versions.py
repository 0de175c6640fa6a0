"""Tables in versions that switch together: a version's files are written first, and then one manifest file names them all, so readers see the tables of one version or of the one before. Ids that are known stay; a batch changes only the columns that it brings."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.shared import numbered, reliable

#: A row for each table, or for each bucket of one; an empty folder says that the bucket holds nothing.
MANIFEST = "version long, name string, bucket int, folder string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the manifest below ``path``; none where there is no manifest yet."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, path: str) -> dict[tuple[str, int], str]:
    """The folder of each table and bucket now; -1 is a table without buckets. Their number bounds what is collected."""
    last = manifest(spark, path).groupBy("name", "bucket").agg(F.max_by("folder", "version").alias("folder"))
    return {(r["name"], r["bucket"]): r["folder"] for r in last.collect()}


def _switch(spark: SparkSession, path: str, rows: list[tuple[str, int, str]]) -> int:
    """Adds one file with the rows of a new version."""
    number = (manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    spark.createDataFrame([(number, *r) for r in rows], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return number


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], buckets: dict[str, tuple[DataFrame, list[int]]] | None = None) -> int:
    """Writes a new version of whole ``tables``, and of ``buckets`` of others: name to (rows with ``bucket``, the buckets that they replace). One writer at a time."""
    named: list[tuple[str, int, str]] = []
    for name, rows in tables.items():
        folder = f"{path}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        named.append((name, -1, folder))
    for name, (rows, replaced) in (buckets or {}).items():
        if not replaced:
            continue
        folder = f"{path}/{name}/{uuid.uuid4().hex}"
        order = [c for c in rows.columns if c != "bucket"][:1]
        # a bucket of frequent words is cut into parts of the advisory size, so no task sorts all of it
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(folder)
        try:
            full = {r["bucket"] for r in spark.read.parquet(folder).select("bucket").distinct().collect()}  # as many as there are buckets
        except AnalysisException:  # nothing was written
            full = set()
        named += [(name, b, f"{folder}/bucket={b}" if b in full else "") for b in replaced]
    return _switch(spark, path, named)


def read(spark: SparkSession, path: str, name: str, schema, buckets: list[int] | None = None, now: dict | None = None) -> DataFrame:
    """A table as it is now, or some of its buckets."""
    now = current(spark, path) if now is None else now
    wanted = [f for (n, b), f in now.items() if n == name and f and (buckets is None or b == -1 or b in set(buckets))]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def unused(spark: SparkSession, path: str, name: str) -> list[str]:
    """Folders of a table that the manifest has named and that no bucket uses any more; they can be removed once no reader of an older version is left."""
    used = {f.rsplit("/bucket=", 1)[0] for (n, _), f in current(spark, path).items() if n == name}
    all_ = manifest(spark, path).where((F.col("name") == name) & (F.col("folder") != "")).select(F.regexp_replace("folder", "/bucket=[0-9]+$", "").alias("folder")).distinct()
    return sorted({r["folder"] for r in all_.collect()} - used)


def merged(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` merged with ``batch`` by ``keys``: of the columns that the batch brings its last row by ``order`` wins, all others keep what the target has. One aggregate; repeating it changes nothing."""
    brought = [c for c in target.columns if c in batch.columns and c not in keys]
    kept = [c for c in target.columns if c not in batch.columns]
    both = target.withColumn("_batch", F.lit(0)).unionByName(batch.select(*keys, *brought, F.lit(1).alias("_batch")), allowMissingColumns=True)
    groups = [F.max_by(F.struct(*brought), F.struct("_batch", *order)).alias("_new")] + ([F.max_by(F.struct(*kept), -F.col("_batch")).alias("_old")] if kept else [])
    part = lambda c: F.col(c) if c in keys else F.col(f"{'_new' if c in brought else '_old'}.{c}").alias(c)
    return both.groupBy(*keys).agg(*groups).select(*map(part, target.columns))


def with_ids(rows: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """``rows`` whose missing ids are numbers above the greatest one there is, in this order."""
    rows = reliable(rows)
    top = rows.agg(F.max(id_column)).first()[0] or 0
    new = numbered(rows.where(F.col(id_column).isNull()).drop(id_column), order, id_column, top + 1)
    return rows.where(F.col(id_column).isNotNull()).unionByName(new.withColumn(id_column, F.col(id_column).cast(rows.schema[id_column].dataType)))
