"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, personal data, mixing.

Counted as part of ``docsift.llm``. Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. The folders of the stages stay, as the result reads the last one;
``remove_stages`` takes them away when the result is no longer needed.

Defined cases, in all stages: an empty table gives an empty table; extra columns pass through, unless they begin with two
underscores or are named copy_no; rows that are repeated or share a doc_id are judged by their texts; texts are read
whole at any length. Null doc_ids stay null and are treated as below.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docsift.llm import decontam, dedup, langid, mixing, pii
from docsift.llm.common import shared_dir, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Null, empty and letterless texts go. Equal texts fare alike; ties of two
    languages go to the one that sorts first. Nothing is learned from rows with a null doc_id, lang or text."""
    return langid.keep_identified(docs, langid.fit(docs))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each component of similar ones; ties of an id go to the least class,
    repeated rows to any of them. Rows with a null doc_id are last in that order. Texts without a word all stay."""
    return dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with all benchmark passages cut out; those left without a word by that go. Null and empty texts stay."""
    return decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data, by the session's key. Null and empty texts stay."""
    return pii.pseudonymise(docs, pii.key_of(spark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's rate asks, with copy_no. A null source is one of its own; null and
    empty texts have size 0 and are taken by the same draw as others of their source."""
    return mixing.mix(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", duplicate_stage),
    ("decontamination", decontamination_stage),
    ("privacy", privacy_stage),
    ("mixing", mixing_stage),
]

#: Language scores, Feistel rounds and prefix trees have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def stage_dir(spark: SparkSession) -> str:
    """A new folder of this run in the shared folder that the cluster names; in a local one only on a local master."""
    return f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"


def remove_stages(spark: SparkSession, folder: str) -> None:
    """Remove the folder of a run by the file system that it lies in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows. folder: where the stages are written; a new one in the shared folder by default."""
    docs, folder = table(spark, sf_dir, "documents"), folder or stage_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
