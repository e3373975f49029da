"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_key(source: Column) -> Column:
    """A non-null key that sorts as the source does by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def running(df: DataFrame, keys: list[str], bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Add out: the running sum of value within keys, by (bucket, *order), this row included.

    Sums of whole buckets are added up first, so that the rows of one key are spread over as many
    tasks as it has buckets; a window then orders the rows of one bucket only.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_bucket_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("_bucket_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_inside", F.sum(value).over(inside))
    return rows.join(sums, [*keys, bucket]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def running_total(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Add out: the running sum of value over all rows in the total order of some columns, this row included.

    Rows are put in order by ranges, each range is summed, and a window orders the rows of one range only.
    Rows that are equal in all columns of the order come one after another.
    """
    placed = written(df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), "_amount": value}), "ordered")
    sums = placed.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("_inside", F.sum("_amount").over(inside)).join(F.broadcast(sums), "_part").withColumn(out, F.col("_before") + F.col("_inside")).drop("_part", "_amount", "_before", "_inside")


def row_key() -> Column:
    """What tells rows apart: the id and the whole text."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches by rows and bytes, so that very long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
