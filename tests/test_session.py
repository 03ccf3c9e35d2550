from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom import session


class Context:
    def __init__(self, master, folder=None):
        self.master, self.named, self.set = master, folder, None

    def getConf(self):
        return {"spark.checkpoint.dir": self.named} if self.named else {}

    def getCheckpointDir(self):
        return self.set

    def setCheckpointDir(self, folder):
        self.set = folder


class Session:
    def __init__(self, *args):
        self.sparkContext = Context(*args)


def test_a_cluster_must_name_its_checkpoint_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session("spark://a:7077"))
    assert session.ensure_checkpoint_dir(Session("spark://a:7077", "hdfs:///c")) == "hdfs:///c"
    assert "graphloom-checkpoint-" in session.ensure_checkpoint_dir(Session("local[2]"))


def test_spread_input_keeps_the_rows(spark):
    few = spark.range(100, numPartitions=1)
    many = spark.range(100, numPartitions=9)
    assert session.spread_input(few).rdd.getNumPartitions() == 8 and session.spread_input(many) is many
    shuffled = few.groupBy((F.col("id") % 7).alias("k")).count()
    assert session.spread_input(shuffled) is shuffled
    for df in (few, many):
        assert sorted(r["id"] for r in session.spread_input(df).collect()) == list(range(100))


def test_sizes_of_stored_tables_are_those_of_their_files(spark, tmp_path):
    small, large = (session.cut_lineage(spark.range(n, numPartitions=3)) for n in (10, 200_000))
    assert 0 < session.estimated_bytes(small) < 10_000 < session.estimated_bytes(large) < 20 << 20
    assert session.estimated_bytes(small.join(large, "id")) == session.estimated_bytes(small) + session.estimated_bytes(large)
    session.write_file(spark, "é\n", str(tmp_path / "a/b.txt"))
    assert (tmp_path / "a/b.txt").read_text(encoding="utf-8") == "é\n"
