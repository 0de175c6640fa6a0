"""What the operators of this subpackage share: reading tables and the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pricelore.shared import numbered, reliable, shared_dir


__all__ = ["cut", "numbered", "partitions", "shared_dir", "stored", "table", "text_slices", "utf8_slices"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: ``df`` with its lineage cut by a reliable checkpoint in the shared folder.
cut = reliable


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(column: pa.Array, chars: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """(begin, end, texts) of runs of a batch's texts of about ``chars`` characters; only one run at a time is held as Python strings. A longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, before + chars, side="right")), begin + 1)
        yield begin, end, column.slice(begin, end - begin).to_pylist()
        begin = end


def utf8_slices(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """As ``text_slices``, but with the texts' bytes in UTF-8 (null: none) in runs of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, before + size, side="right")), begin + 1)
        raw = column.slice(begin, end - begin)
        yield begin, end, [x or b"" for x in raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary()).to_pylist()]
        begin = end
