"""The folder that driver and executors share, and numbers in order of a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MADE = "pricelore.test.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where it names none and one JVM runs all (tests) is a folder made; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = spark.conf.get(_MADE, None)
    if not named:
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(_MADE, named)
    return named


def reliable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` set, Spark removes it when nothing refers to it any more."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Rows that a join sends to every task at most.
FEW = 100_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, made once, and broadcast by a join if it has ``most`` rows at most (counted first), so that rows of a hot key stay where they are."""
    made = reliable(df)
    return F.broadcast(made) if made.count() <= most else made


def numbered(df: DataFrame, order: list[Column | str], name: str, first: int = 1) -> DataFrame:
    """``df`` with numbers from ``first`` on in this order, by ranges and their counts; no task holds all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = reliable(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    offsets, before = [], first - 1
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each partition
        offsets.append((r["_part"], before))
        before += r["n"]
    offset = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return placed.join(offset, "_part").withColumn(name, number).drop("_part", "_before")
