"""Capture as a stream: raw messages in, enriched units out, each unit once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.runtime import fresh_path
from spoor.sources.units import enrich, normal_role, normal_ts

#: How long a second delivery of a unit may lag behind the first in a running stream.
DEDUP_WINDOW = "30 days"
#: The pace of a running stream.
PACE = "1500 milliseconds"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a table, be it a folder or a single file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if fs.getFileStatus(hadoop).isFile():
        head, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(head)
    return reader.parquet(path)


def captured(raw: DataFrame) -> DataFrame:
    """Enriched units of a stream or table of raw messages; a unit delivered again is dropped by its id."""
    ts = normal_ts(F.col("ts_ms"))
    slim = raw.select(
        "unit_id", "session_id", "session_name", "cwd", normal_role(F.col("role")).alias("role"), "text", ts.alias("ts"), "seq", F.timestamp_millis(F.greatest(F.lit(1).cast("bigint"), F.coalesce(ts, F.lit(0)))).alias("event_time")
    )
    # a stream drops what is not later than its first watermark, the year 1970
    stream = slim.withWatermark("event_time", DEDUP_WINDOW) if raw.isStreaming else slim
    once = stream.dropDuplicatesWithinWatermark(["unit_id"]) if raw.isStreaming else slim.dropDuplicates(["unit_id"])
    return enrich(once).drop("event_time")


def ingest_once(spark: SparkSession, path: str) -> DataFrame:
    """Run the capture over all files at ``path`` and read what it wrote."""
    out = fresh_path(spark, "units")
    query = (
        captured(file_stream(spark, path))
        .writeStream.format("parquet")
        .option("checkpointLocation", fresh_path(spark, "ingest"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str):
    """The running capture: micro-batches at a steady pace, appended to ``out``."""
    return captured(file_stream(spark, path)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime=PACE).start(out)
