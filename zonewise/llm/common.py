"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage, shared_folder, ship  # noqa: F401

#: Rows of an Arrow batch. Texts may be long, so the default of 10,000 could hold gigabytes.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded size."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def as_bytes(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The key columns and the text's UTF-8 bytes as ``body``; other columns are pruned at the scan."""
    return df.select(*keys, F.col(text).cast("binary").alias("body"))
