"""Job events as a stream: running status and counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sacbe.operators.jobs import job_marks
from sacbe.storage import kept, new_path

#: Events arrive up to some days late.
LATEST = "7 days"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files of job events."""
    schema = "evento_id bigint, trabajo string, pagina int, evento string, ts timestamp, recibido_ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def running_marks(events: DataFrame) -> DataFrame:
    """Marks of each job so far, repeats dropped while their state is kept (output mode complete or update)."""
    return job_marks(events.withWatermark("ts", LATEST).dropDuplicates(["evento_id", "ts"]))


def pages_per_window(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Finished and failed pages per window of event time; windows close when the watermark passes them (output mode append)."""
    own = events.withWatermark("ts", LATEST).dropDuplicates(["evento_id", "ts"])
    return own.groupBy(F.window("ts", width)).agg(F.count_if(F.col("evento") == "page_done").alias("hechas"), F.count_if(F.col("evento") == "page_failed").alias("fallidas")).select(F.col("window.start").alias("desde"), "hechas", "fallidas")


def run_to_end(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there into a table in memory; for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame) -> DataFrame:
    """Run a stream over all that is there and append its rows to a table in the shared folder, which is read back."""
    spark = df.sparkSession
    path = kept(new_path(spark, "stream"))
    q = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", kept(new_path(spark, "marks"))).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
