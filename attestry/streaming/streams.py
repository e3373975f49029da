"""Structured Streaming forms: health windows over polls, and content dedup against the snapshot store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signatures
from ..operators.snapshots import first_writers
from ..storage import exists, work_path


def health_windows(polls: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(source_id, day, polls, failed, items) per tumbling window; works on streams and tables alike."""
    rows = polls.withWatermark("started_at", late) if polls.isStreaming else polls
    per = rows.groupBy(F.window("started_at", width), "source_id").agg(F.count("*").alias("polls"), F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("failed"), F.sum("items_seen").alias("items"))
    return per.select("source_id", F.col("window.start").alias("day"), "polls", "failed", "items")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its last result, written in the shared folder."""
    spark, path = stream.sparkSession, work_path(stream.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _batches(spark: SparkSession, store: str, before: int, schema) -> DataFrame:
    """What the batches below a number left in a store: one folder each, named by the number."""
    rows = spark.read.schema(schema).option("basePath", store).option("recursiveFileLookup", "false").parquet(store)
    return rows.filter((F.col("batch") < before) | (F.col("batch") == -1)).drop("batch")


def _numbered(schema):
    from pyspark.sql.types import IntegerType, StructType

    return StructType([*schema.fields]).add("batch", IntegerType())


def put_stream(items: DataFrame, store: str, checkpoint: str) -> None:
    """Append each batch's first writers to the store (a Parquet folder) unless it holds their hash.

    A batch writes below its own number, overwriting what a failed try left, and reads the folders below
    that number only, by partition pruning: running a batch again changes nothing.
    """
    spark: SparkSession = items.sparkSession
    schema = items.schema

    def put(batch: DataFrame, number: int) -> None:
        known = _batches(spark, store, number, _numbered(schema))
        first_writers(batch, known).select(*schema.names).write.mode("overwrite").parquet(f"{store}/batch={number}")

    _start(spark, schema, store)
    items.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def _start(spark: SparkSession, schema, store: str) -> None:
    if not exists(spark, f"{store}/batch=-1"):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{store}/batch=-1")


def cluster_stream(docs: DataFrame, store: str, checkpoint: str) -> None:
    """Give each batch's documents (content_hash, text, created_at) their clusters against the signature store,
    a Parquet folder of (content_hash, signature, created_at, cluster_id) that is the stream's state.

    A batch reads the folders of earlier batches only, from 14 days before its own earliest document on, and overwrites
    its own, so running it again changes nothing; no clock is read.
    """
    from pyspark.sql.types import ArrayType, LongType, StringType, StructType, TimestampType

    spark: SparkSession = docs.sparkSession
    schema = StructType().add("content_hash", StringType()).add("signature", ArrayType(LongType())).add("created_at", TimestampType()).add("cluster_id", StringType())

    def put(batch: DataFrame, number: int) -> None:
        known = _batches(spark, store, number, _numbered(schema))
        found = signatures.assign(signatures.signatures(first_of(batch)), known)
        found.select(*schema.names).write.mode("overwrite").parquet(f"{store}/batch={number}")

    _start(spark, schema, store)
    docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def first_of(docs: DataFrame) -> DataFrame:
    """Each content once, with its earliest time."""
    return docs.groupBy("content_hash").agg(F.min("created_at").alias("created_at"), F.min("text").alias("text"))


def read_store(spark: SparkSession, store: str, schema) -> DataFrame:
    return spark.read.schema(_numbered(schema)).parquet(store).drop("batch")
