"""Streams of crawl events: counters, rates, deduplication, recent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlgrain.schemas import EVENTS


def read_events(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of events under a folder, as a stream."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def counters(events: DataFrame) -> DataFrame:
    """Running (event_type, n, total): the state is one row per type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which must be on timestamps with a time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def rates(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, n, per_second) of tumbling windows; windows close when the watermark passes."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("w.start"), F.col("w.end")) / 1e6
    marked = _marked(events, late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("per_second"))


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once; the state holds ids no longer than the watermark."""
    return _marked(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_once(stream: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is, into an in-memory table; for small results, as counters are.

    A later call with the same checkpoint goes on where this one ended.
    """
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream to Parquet files exactly once, over what there is."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Begins a stream into Parquet files, or goes on with one that was paused, from its checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()


def pause(query: StreamingQuery) -> None:
    """Stops a stream once it has read what there is; start() goes on where it ended."""
    query.processAllAvailable()
    query.stop()


def cancel(query: StreamingQuery) -> None:
    """Stops a stream at once; what its checkpoint doesn't name is read again if it is started again."""
    query.stop()


def keep_recent(stream: DataFrame, path: str, checkpoint: str, n: int = 5000) -> None:
    """A table of the newest n events, replaced with every batch: what is read per batch is bounded by n."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        old = spark.read.parquet(f"{path}/{(number - 1) % 2}") if number else df.limit(0)
        old.unionByName(df).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n).write.mode("overwrite").parquet(f"{path}/{number % 2}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
