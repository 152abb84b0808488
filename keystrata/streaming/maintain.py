"""Derived data kept up by Structured Streaming: counters, expiry and catching up with a changing source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, table: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Files named after a table in a folder, as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def fold_counts(events: DataFrame, keys: list[str], folder: str, keep: int = 2) -> DataFrame:
    """Running counts by key: every micro-batch is added up by itself, and what it adds is merged into the counts of the batch
    before, under the batch's number. A batch that runs again finds the same counts before it, so nothing counts twice; the
    stream has no state of its own. Counts of older batches than the last `keep` are removed."""
    spark = events.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    counts = f"{folder}/counts"

    def numbers() -> list[int]:
        found = fs.globStatus(path(f"{counts}/batch=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found)

    def merge(batch: DataFrame, number: int) -> None:
        added = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
        if before := [n for n in numbers() if n < number]:
            added = batch.sparkSession.read.parquet(f"{counts}/batch={before[-1]}").unionByName(added).groupBy(*keys).agg(F.sum("events").alias("events"))
        added.write.mode("overwrite").parquet(f"{counts}/batch={number}")
        for n in [n for n in numbers() if n <= number][:-keep]:
            fs.delete(path(f"{counts}/batch={n}"), True)

    query: StreamingQuery = events.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    last = numbers()
    return spark.read.parquet(f"{counts}/batch={last[-1]}") if last else spark.createDataFrame([], events.select(*keys, F.lit(1).cast("long").alias("events")).schema)


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, lateness: str) -> DataFrame:
    """Counts in windows of time, finished once the watermark has passed them, so that state doesn't pile up."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    w = timed.groupBy(F.window("_at", width).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return w.select(F.col("_w.start").alias("window_start"), *keys, "events")


def run_to_end(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All rows that come out for what is there now, in one run that can be resumed; a batch that runs again writes over itself."""
    spark = df.sparkSession
    out, checkpoint = f"{folder}/rows", f"{folder}/checkpoint"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query: StreamingQuery = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def swept(rows: DataFrame, ttl: str, now: int, grace: int) -> DataFrame:
    """Physical expiry: rows that expired more than `grace` seconds ago are gone; counters, claims and copies of theirs stay."""
    return rows.filter(F.col(ttl).isNull() | (F.col(ttl) == 0) | (F.col(ttl) > now - grace))


def without_expired(events: DataFrame, ttl: str, now: int) -> DataFrame:
    """Logical expiry: rows drop out at once; what was derived from them stays, since physical deletion bypasses it."""
    return events.filter(F.col(ttl).isNull() | (F.col(ttl) == 0) | (F.col(ttl) > now))
