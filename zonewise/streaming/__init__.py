"""Continuous ingest of model replies into the rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ingest import build_rules, flatten_decree
from ..sources.schemas import REPLIES


def replies(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON files of replies (doc_id, chunk, content) in a folder."""
    return spark.readStream.schema(REPLIES).option("maxFilesPerTrigger", files_per_batch).json(folder)


def raw_rules(stream: DataFrame) -> DataFrame:
    """Normalized rules of a stream of replies. Rows don't depend on each other, so there is no state to keep."""
    null = lambda k: F.lit(None).cast(k)
    rows = flatten_decree(stream).withColumns({"rule_type": null("string"), "house_numbers": null("string"), "exceptions": null("string")})
    return build_rules(rows)


def write(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends rules to a Parquet folder; the checkpoint makes restarts exactly-once."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
