"""Signal counts over a growing folder of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import parse


def signal_windows(spark: SparkSession, folder: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Streaming: window start, level, lines, signals; late lines are let in up to the watermark."""
    lines = spark.readStream.text(folder).withColumnRenamed("value", "raw")
    ts = parse.time_value(parse.time_text(F.col("raw"))).cast("timestamp")
    timed = lines.withColumn("ts", ts).withColumn("level", parse.text_level(F.col("raw"))).filter("ts is not null").withWatermark("ts", late)
    signal = parse.is_signal(F.col("level"), F.col("raw"))
    return timed.groupBy(F.window("ts", window).alias("w"), "level").agg(F.count(F.lit(1)).alias("lines"), F.count_if(signal).alias("signals")).select(F.col("w.start").alias("start"), "level", "lines", "signals")
