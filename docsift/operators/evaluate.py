"""Comparing recognizer variants: character error rate, agreement, mean times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.plans.joins import small_side


def cer(hypothesis: Column, reference: Column) -> Column:
    """Edit distance by length of the reference; an empty reference counts 0 if the hypothesis is empty, else 1."""
    return F.when(reference == "", F.when(hypothesis == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(hypothesis, reference).cast("double") / F.length(reference).cast("double"))


def compare_variants(runs: DataFrame, baseline: str, first: str | None = None) -> DataFrame:
    """One row per variant: mean encoder and total seconds, mean CER and identical texts against the baseline, and the
    speed-up of the encoder over that of the first variant (the baseline if none is named).

    runs: variant, stem, text, vision_s, total_s, pos. Of a stem's several runs in the baseline the last counts.
    """
    last = Window.partitionBy("stem").orderBy(F.desc("pos"))
    base = runs.where(F.col("variant") == baseline).withColumn("__no", F.row_number().over(last)).where("__no = 1").select("stem", F.col("text").alias("base_text"))
    joined = runs.join(base, "stem")
    per = joined.groupBy("variant").agg(F.count("*").alias("n"), F.avg("vision_s").alias("vision_s"), F.avg("total_s").alias("total_s"), F.avg(cer(F.col("text"), F.col("base_text"))).alias("cer"), F.sum((F.col("text") == F.col("base_text")).cast("long")).alias("identical"))
    usual = per.where(F.col("variant") == (first or baseline)).select(F.col("vision_s").alias("base_s"))
    return per.join(small_side(usual), F.lit(True)).withColumn("speedup", F.try_divide("base_s", "vision_s")).drop("base_s")


def truth_cer(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """(variant, n, cer) over the stems that have a ground truth (stem, truth)."""
    return runs.join(truth, "stem").groupBy("variant").agg(F.count("*").alias("n"), F.avg(cer(F.col("text"), F.col("truth"))).alias("cer"))
