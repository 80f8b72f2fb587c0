"""Event streams: windowed telemetry and duplicate removal; the same transformations serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_root


def windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): events per window and type."""
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The files of a folder that match, as a stream."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the table it wrote; the checkpoint lies in the shared folder."""
    import uuid

    spark = df.sparkSession
    root = f"{scratch_root(spark)}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def fresh(events: DataFrame, key: str = "event_id", late: str = "3650 days") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
