"""Files of the checkpoints."""

from pathlib import Path

from pyspark.sql import functions as F

from docsift.llm import common
from docsift.llm import dedup as D
from docsift.llm import mixing as M
from docsift.llm.common import ensure_checkpoint_dir


def checkpoint_files(spark):
    ensure_checkpoint_dir(spark)
    return set(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*"))


def test_checkpoints_of_few_rows_are_few_files(spark):
    """However many tasks the texts are dealt to: on a local folder each file makes an executor start a process."""
    few = spark.createDataFrame([(i, f"s{i % 23}", " ".join(f"w{(i % 150) * 7 + k}" for k in range(12))) for i in range(300)], "doc_id long, source string, text string")
    spread = few.repartition(60, "doc_id")
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for name, stage, most in (("mixing", M.mix_report, 20), ("near duplicates", D.keep_one, 140)):
        want = sorted(map(str, stage(few).collect()))
        before = checkpoint_files(spark)
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            got = sorted(map(str, stage(spread).collect()))
        finally:
            for k, v in was.items():
                spark.conf.set(k, v)
        assert got == want, name
        assert len(checkpoint_files(spark) - before) <= most, name


def test_files_of_narrow_checkpoints_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "FILE_ROWS", 100)
    rows = common.cut_narrow(spark.range(1001).repartition(40), 1001)
    assert rows.rdd.getNumPartitions() == 11
    assert sorted(r.id for r in rows.collect()) == list(range(1001))
    assert common.cut_narrow(spark.range(0), 0).rdd.getNumPartitions() == 1
    keys = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k long, v long")
    want = {k: sum(v for j, v in ((i * 37 % 101, i) for i in range(101)) if j < k) for k in range(101)}
    for known in (None, 101, 10):  # dealt by ranges, by ranges, in one
        assert {r.k: r.s for r in common.running_sums(keys, [F.col("k")], {"s": F.col("v")}, known).collect()} == want
