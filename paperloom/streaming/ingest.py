"""Incremental ingestion with Structured Streaming.

New files of a folder are parsed, chunked and written batch by batch. A file is skipped when the
status log holds a complete row with the same content hash and model version; one that cannot be
parsed is logged as failed and does not stop the others. Output and log of a batch lie under the
batch's own folder, which is written anew if a batch is repeated after a failure.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from paperloom.operators.chunking import chunk_sections
from paperloom.operators.state import latest_status, to_do
from paperloom.sources import articles as A

_FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])
LOG = "path string, content_hash string, model_version string, status string, error string, chunk_count int, batch bigint"


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """The log; empty before the first batch. A log that cannot be read is an error."""
    try:
        return spark.read.schema(LOG).parquet(f"{out}/log/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def ingest(spark: SparkSession, folder: str, out: str, model_version: str = "1", size: int = 180, overlap: int = 30) -> None:
    """Take in all new files of ``folder`` and stop (``availableNow``)."""
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.xml").load(folder)

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        seen = df.withColumn("content_hash", F.sha2("content", 256)).withColumn("model_version", F.lit(model_version))
        new = to_do(seen, read_log(session, out).where(F.col("batch") != number), ["content_hash", "model_version"])
        A.parse_files(new.select("path", "content")).write.mode("overwrite").parquet(f"{out}/papers/batch={number}")
        parsed = session.read.schema(A.SCHEMA).parquet(f"{out}/papers/batch={number}")  # parsed once, from storage after
        if not parsed.limit(1).count():
            return
        chunks = chunk_sections(A.child_table(parsed, "sections"), size, overlap)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        counts = session.read.parquet(f"{out}/chunks/batch={number}").groupBy("paper_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        log = parsed.join(counts, "paper_id", "left").select(
            "path", "content_hash", F.lit(model_version).alias("model_version"), F.when(F.col("error").isNull(), "complete").otherwise("failed").alias("status"), "error",
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(number).cast("bigint").alias("batch"),
        )
        log.write.mode("overwrite").parquet(f"{out}/log/batch={number}")

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def status(spark: SparkSession, out: str) -> DataFrame:
    """The last status of each file."""
    return latest_status(read_log(spark, out), "path", "batch")


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window of a stream (or a table), late rows beyond ``lateness`` left out."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")
    )
