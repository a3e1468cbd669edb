"""Completions are made in many tasks."""

import pytest
from pyspark.sql import functions as F

from tracewright.plans import rewards


@pytest.mark.parametrize("made", [rewards.completions, rewards.parsed])
def test_keys_are_dealt_to_many_tasks(spark, made):
    """Keys of a small table would be one task again where no number is given."""
    tasks = made(spark, "/root/testdata/sf0.01").select(F.spark_partition_id().alias("p"), "text").groupBy("p").agg(F.count("text").alias("n"))
    assert tasks.count() > spark.sparkContext.defaultParallelism
