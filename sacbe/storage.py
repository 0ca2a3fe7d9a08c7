"""Reading tables and cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (a single machine, as in tests) a local folder
    is made and set; on a cluster executors wouldn't share it, so that the setting is required.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sacbe-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


#: Rows in memory take about so many times the bytes of their compressed columns.
IN_MEMORY = "20.0"
_written: list[str] = []


def _careful(spark: SparkSession) -> None:
    """Let the planner expect files to grow in memory, where the session leaves that open; ``release`` sets it back.

    It chooses broadcasts by the size of files; tables of ids and short codes compress so well that
    a side of some megabytes on disk can fill gigabytes.
    """
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", IN_MEMORY)


def release(spark: SparkSession) -> int:
    """Delete all tables ``materialize`` wrote in this process; call it once the results built on them are saved."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    if spark.conf.get("spark.sql.sources.fileCompressionFactor") == IN_MEMORY:
        spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    return n


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/sacbe-{tag}-{uuid.uuid4().hex}"


def kept(path: str) -> str:
    """``path``, which ``release`` will delete."""
    _written.append(path)
    return path


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` compressed into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does and survives lost executors, but the files are
    compressed columns, so a later read takes only the columns it needs.
    """
    spark = df.sparkSession
    _careful(spark)
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    kept(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, if its expected size fills fewer.

    For rows that are few bytes but much work. Larger tables are left as they are read.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    share = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(wanted, *keys) if size < share * wanted else df
