"""What the operators of this subpackage share: lineage cuts, size-checked broadcasts, hash draws."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast. Every caller counts first.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of the Arrow batches that carry texts to Python workers.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded: long texts must not fill a worker's memory by the thousand."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A temporary one of this machine does only for a local
    master, as in tests; anywhere else its absence is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="docsift-checkpoint-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: replicated storage, so a lost executor costs no recomputation of what lies above."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of numbers, names and keys, no texts, that one file of a checkpoint holds.
FILE_ROWS = 20_000


def cut_narrow(df: DataFrame, rows: int) -> DataFrame:
    """``cut`` of about so many rows that hold no texts, in as few files as they need.

    Tasks are dealt by the bytes of the texts above or by the session's number of partitions; each of their files costs
    the storage an entry, and where that is a local folder without native code the executor a process of its own, to set
    its mode. All rows are kept; the number of files grows with them.
    """
    return cut(df.repartition(max(1, -(-rows // FILE_ROWS))))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after a count; beyond the bound the join is left to shuffle, where AQE splits hot keys.

    ``df`` should be cut: it is read once for the count and once for the join.
    """
    return F.broadcast(df) if df.count() <= rows else df


#: A key is heavy beyond this share of the rows (one in HEAVY_SHARE) and HEAVY_ROWS; its rows are dealt to SALTS places.
HEAVY_SHARE, HEAVY_ROWS, SALTS = 5000, 256, 32


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, total: int, deal: Column, how: str = "inner") -> DataFrame:
    """rows joined by key with per_key, which has one row per key and in ``uses`` the number of rows that have it.

    Heavy keys are split by ``deal``, so no task gets more than a part of one. There are HEAVY_SHARE of them at most, by
    the pigeonhole of ``total``, the number of rows: that list is broadcast. A null key meets nothing.
    """
    heavy = F.col("uses") > max(HEAVY_ROWS, total // HEAVY_SHARE)
    hot = F.broadcast(per_key.where(heavy).select(F.col(key).alias("__hot")))
    dealt = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(deal, F.lit(SALTS))).otherwise(0).cast("int")).drop("__hot")
    copies = per_key.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.when(heavy, SALTS - 1).otherwise(0)))).withColumnRenamed(key, "__key").drop("uses")
    return dealt.join(copies, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__copy")), how).drop("__salt", "__copy", "__key")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, order: list[Column], values: dict[str, Column], rows: int | None = None) -> DataFrame:
    """df with, for each name, the sum of its value over all rows before a row in the given order.

    Rows are dealt to tasks by ranges of the order, so no task gets them all; the sums of the ranges, a row each, are all
    that comes together. Rows that tie in the order share a range and stand in any order, so it should be total.
    rows: how many df has, if that is known; up to FILE_ROWS of them are one range.
    """
    keys = [f"__key{k}" for k in range(len(order))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)], *[v.alias(f"__of_{n}") for n, v in values.items()])
    dealt = keyed.coalesce(1) if rows is not None and rows <= FILE_ROWS else keyed.repartitionByRange(shuffle_parts(df.sparkSession), *keys)
    placed = cut(dealt.select("*", F.spark_partition_id().alias("__part")))
    inner = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = placed.groupBy("__part").agg(*[F.sum(f"__of_{n}").alias(n) for n in values])
    parts = parts.select(F.col("__part").alias("__of"), *[F.coalesce(F.sum(n).over(outer), F.lit(0)).alias(f"__base_{n}") for n in values])
    within = placed.select("*", *[F.coalesce(F.sum(f"__of_{n}").over(inner), F.lit(0)).alias(f"__sum_{n}") for n in values])
    joined = within.join(F.broadcast(parts), F.col("__part") == F.col("__of"))
    return joined.select(*df.columns, *[(F.col(f"__sum_{n}") + F.col(f"__base_{n}")).alias(n) for n in values])


def last_before(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with, as name, the last value that is not null of the rows before a row in the given order.

    Rows are dealt to tasks by ranges of the order; a row per range carries on what the ranges before it end with.
    """
    keys = [f"__key{k}" for k in range(len(order))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)], value.alias("__value"))
    placed = cut(keyed.repartitionByRange(shuffle_parts(df.sparkSession), *keys).select("*", F.spark_partition_id().alias("__part")))
    before = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ended = placed.where("__value IS NOT NULL").groupBy("__part").agg(F.max_by("__value", F.struct(*keys)).alias("__end"))
    parts = placed.select("__part").distinct().join(ended, "__part", "left")
    outer = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.select(F.col("__part").alias("__of"), F.last("__end", ignorenulls=True).over(outer).alias("__carried"))
    found = placed.withColumn("__last", F.last("__value", ignorenulls=True).over(before)).join(F.broadcast(parts), F.col("__part") == F.col("__of"))
    return found.select(*df.columns, F.coalesce("__last", "__carried").alias(name))


def unit_draw(seed: str, *keys: Column) -> Column:
    """Number in [0, 1) that depends on the keys and the seed alone, so reruns agree."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
