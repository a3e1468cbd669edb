"""Blocks of intervals are never sent through the driver, however small their rows look."""

from pyspark.sql import functions as F

from tracewright.operators import ranges


def test_blocks_are_not_broadcast(spark):
    wide = spark.range(50).select("id", F.col("id").alias("low"), (F.col("id") + F.lit(10).cast("long") ** 9).cast("long").alias("high"))
    narrow = spark.range(50).select(F.col("id").alias("o"), F.col("id").alias("l"), (F.col("id") + 1).alias("h"))
    for made in (ranges.overlap_totals(wide, narrow, ("low", "high"), ("l", "h"), "o"), ranges.overlap_join(wide, narrow, ("low", "high"), ("l", "h"))):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() in (50, 2500 - sum(i - 1 for i in range(2, 50)))
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
