"""Checkpointed appends as a stream: what a batch loop with resume counts does by hand.

An extension: scored outputs that arrive as files are appended once each,
whatever restarts, and accuracy by category follows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.functions import num, text

SCHEMA = "id long, category string, answer string, output string, at timestamp"


def scored_stream(spark: SparkSession, source: str, files_per_batch: int = 10) -> DataFrame:
    """JSON lines of outputs, with prediction and verdict; a late copy of an id within an hour is dropped."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source)
    rows = rows.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["id"])
    predicted = text.final_answer(F.col("output"))
    return rows.withColumn("predicted", predicted).withColumn("correct", num.verify(F.col("answer"), F.col("predicted")))


def append(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Takes up what is there and ends; a second call goes on where the first stopped."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_accuracy(stream: DataFrame, width: str = "10 minutes") -> DataFrame:
    g = stream.groupBy(F.window("at", width).alias("window"), "category")
    return g.agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("k"))
