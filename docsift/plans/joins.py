"""Joins whose small side is checked before it is broadcast, lineage cuts, and scans that are spread over tasks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if at most max_rows rows are there; beyond that the join is left to shuffle and AQE.

    Only max_rows + 1 rows are counted at most.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one does for a local master only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="docsift-")


def settled(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint in the shared folder: read again without being computed again, and kept when executors
    are lost."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it comes from fewer files than half of them: heavy work on texts then does not wait for
    one task. Tables of many files, the usual case at scale, stay as they are and shuffle nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 2 <= cores else df


def numbered(df: DataFrame, order: list[Column], name: str, within: list[str] = []) -> DataFrame:  # noqa: B006
    """df with the place of each row, from 1, in the given order: of all rows, or of those alike in the columns within.

    Rows are dealt to tasks by ranges of within and order, so neither a group nor the whole comes into one task. The order
    should be total.
    """
    keys = [f"__key{k}" for k in range(len(within) + len(order))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip([*map(F.col, within), *order], keys, strict=True)])
    placed = keyed.repartitionByRange(*keys).select("*", F.spark_partition_id().alias("__part"))
    group = F.struct(F.lit(0), *within)
    placed = settled(placed.withColumn("__group", group))
    inner = Window.partitionBy("__part").orderBy(*keys)
    counted = placed.withColumn("__at", F.row_number().over(inner))
    sizes = placed.groupBy("__part").count()  # a row per range
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.join(F.broadcast(sizes.select(F.col("__part").alias("__of"), before.alias("__before"))), F.col("__part") == F.col("__of")).withColumn("__at", F.col("__at") + F.col("__before"))
    if not within:
        return counted.select(*df.columns, F.col("__at").cast("long").alias(name))
    # a group's first place: within the range, or where the ranges before it have begun it
    first = counted.groupBy("__part", "__group").agg(F.min("__at").alias("__first"))
    first = first.withColumn("__first", F.min("__first").over(Window.partitionBy("__group"))).select(F.col("__part").alias("__p"), F.col("__group").alias("__g"), "__first")
    joined = counted.join(first, (F.col("__part") == F.col("__p")) & (F.col("__group") == F.col("__g")))
    return joined.select(*df.columns, (F.col("__at") - F.col("__first") + 1).cast("long").alias(name))
