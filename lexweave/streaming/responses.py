"""Exam responses as a stream: windowed grades that equal the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_table_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def response_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int = 4) -> DataFrame:
    """Responses from parquet files as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def daily_grades(responses: DataFrame, threshold: float = 20.0, late: str = "2 days") -> DataFrame:
    """(day, category, total, correct): tumbling days; a response that is delivered
    again within the lateness counts once. The same for a stream and a table."""
    r = responses.withColumn("at", F.col("ts").cast("timestamp"))
    if r.isStreaming:
        r = r.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        r = r.dropDuplicates(["event_id"])
    right = F.coalesce(F.col("value") >= threshold, F.lit(False))
    g = r.groupBy(F.window("at", "1 day"), F.col("event_type").alias("category")).agg(F.count("*").alias("total"), F.count_if(right).alias("correct"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "category", "total", "correct")


def sliding_activity(responses: DataFrame, late: str = "1 hour") -> DataFrame:
    """(start, n): responses per two hours, every hour."""
    r = responses.withColumn("at", F.col("ts").cast("timestamp"))
    r = r.withWatermark("at", late) if r.isStreaming else r
    return r.groupBy(F.window("at", "2 hours", "1 hour")).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def session_activity(responses: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): sittings as session windows."""
    r = responses.withColumn("at", F.col("ts").cast("timestamp"))
    r = r.withWatermark("at", late) if r.isStreaming else r
    s = r.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_sessions(responses: DataFrame, folder: str | None = None) -> DataFrame:
    """``session_activity`` of a stream: the sittings that are over, later ones come with the next run."""
    return run_available(session_activity(responses), "sessions", ["user_id", "start"], "append", folder)


def run_available(stream: DataFrame, name: str, keys: list[str], mode: str = "update", folder: str | None = None) -> DataFrame:
    """Run a windowed aggregation over all that is there and return its result so far.

    In ``update`` mode every batch writes the windows that changed, and the
    last state of each window (``keys``) is the result; in ``append`` mode
    windows are written once, when the watermark has passed them. Either way
    the watermark frees the state of old windows. With the same ``folder``,
    which keeps state and results, the stream goes on where it stopped;
    without one it starts anew in the shared folder.
    """
    spark = stream.sparkSession
    at = folder or shared_table_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/result/{number}")  # a batch that runs again replaces itself

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", _batch bigint"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/result")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("_r"))
    return last.select("_r.*").select(*stream.columns)
