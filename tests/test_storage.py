import os

import pytest

from sacbe import storage


def test_written_tables_are_read_back_and_released(spark):
    df = storage.materialize(spark.createDataFrame([(1, "a")], "x int, y string"), "t")
    assert [tuple(r) for r in df.collect()] == [(1, "a")]
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert storage.release(spark) >= 1 and not os.path.exists(path) and storage.release(spark) == 0


class Session:
    """Only what ``shared_folder`` asks of a session."""

    class conf:
        @staticmethod
        def get(key, default):
            return "hdfs://shared/checkpoints/" if key == "spark.checkpoint.dir" else default


def test_the_folder_the_cluster_names_is_used():
    assert storage.shared_folder(Session) == "hdfs://shared/checkpoints"


class Cluster(Session):
    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError):
        storage.shared_folder(Cluster)


def test_small_tables_are_spread(spark):
    df = spark.range(10).coalesce(1)
    assert storage.spread(df, "id").rdd.getNumPartitions() >= 4
