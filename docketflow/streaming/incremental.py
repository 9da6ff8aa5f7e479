"""Incremental forms of batch steps: each run takes up what is new and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.runtime import fresh_path


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Append what has arrived since the checkpoint to a Parquet table."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Replace a Parquet table by the whole aggregate after each run."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the Parquet files of a table, whether it is one file or a folder."""
    whole = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(whole).schema
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(whole)
    is_file = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if is_file else reader.parquet(whole)


def calendar_counts(stream: DataFrame, ts: str, key: str, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Counts per window and key; rows later than ``lateness`` are dropped by the watermark in append mode only."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", lateness)
    return timed.groupBy(F.window("_t", width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), key, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Runs of events of a key without a pause longer than ``gap``."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", lateness)
    return timed.groupBy(F.session_window("_t", gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), key, "n")


def daily_counts(spark: SparkSession, folder: str, table: str, ts: str, key: str) -> DataFrame:
    """Run the calendar stream over all files there are, and read its result."""
    path = fresh_path(spark, "stream-result")
    run_complete(calendar_counts(file_stream(spark, folder, table), ts, key), path, fresh_path(spark, "stream-checkpoint"))
    return spark.read.parquet(path)
