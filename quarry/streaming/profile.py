"""Streaming profile of events: windowed counts and value statistics that agree with the batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalog import register
from quarry.sources.tables import table


def windowed(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Per window and type: events, sum and largest value, nulls. With ``late`` a watermark bounds the state."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    t = t.withWatermark("ts", late) if late else t
    return t.groupBy(F.window("ts", width), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("largest"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_nulls")
    )


def stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start(df: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete"):
    """A query into an in-memory table; a checkpoint folder lets it go on after a restart."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


@register("stream_profile", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total, max(value) as largest from events group by 1, 2")
def stream_profile(spark, sf_dir):
    return windowed(table(spark, sf_dir, "events")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total", "largest")
