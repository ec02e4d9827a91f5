"""Graphs of models as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(nodes: DataFrame) -> DataFrame:
    """(tensor, producer, consumer) from (node, ins, outs): a row per use of a tensor; null where the graph's input makes it
    or nothing uses it."""
    made = nodes.select(F.col("node").alias("producer"), F.explode("outs").alias("tensor"))
    used = nodes.select(F.col("node").alias("consumer"), F.explode("ins").alias("tensor"))
    return made.join(used, "tensor", "full").select("tensor", "producer", "consumer")
