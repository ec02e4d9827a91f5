"""The quality gate over a stream of documents. An extension: rows are judged one by one, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsift.functions import text as X
from docsift.operators.quality import fail_reason


def judged_stream(docs: DataFrame, min_quality: float = 0.8) -> DataFrame:
    """docs (doc_id, text, score) with quality and engine, per row: lines are judged inside the row's own array."""
    lines = F.filter(F.split("text", "\n"), lambda t: X.strip(t) != "")
    sums = F.aggregate(lines, F.struct(F.lit(0).alias("all"), F.lit(0).alias("good")), lambda acc, t: F.struct((acc["all"] + F.length(t)).alias("all"), (acc["good"] + F.when(fail_reason(t, F.col("score")).isNull(), F.length(t)).otherwise(0)).alias("good")))
    rows = docs.withColumn("__s", sums)
    quality = F.col("__s.good").cast("double") / F.greatest(F.col("__s.all"), F.lit(1)).cast("double")
    return rows.withColumn("quality", quality).withColumn("engine", F.when(F.col("quality") >= min_quality, "primary").otherwise("secondary")).drop("__s")


def run_gate(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, min_quality: float = 0.8) -> StreamingQuery:
    """Judges what lies and arrives in source (Parquet) and appends to target; exactly once by the checkpoint."""
    docs = spark.readStream.schema(schema).parquet(source)
    return judged_stream(docs, min_quality).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
