"""The corpus pipeline: five stages over the documents table, each written and read again.

Toxic documents go; of each group of near-duplicates the document with the smallest doc_id stays; documents
that hold a benchmark item go; the rest is mixed (a document may come twice or not at all); the mix is put
into shards. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontamination, mixing, sharding, simhash, toxicity
from attestry.storage import written

#: From this score on a document is toxic.
TOXIC = 0.5
SHARDS = 8

#: SQL has no compression dictionaries, so the whole can't be said in it; the tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Labels are learnt from rows that are not held out.

    Whole texts are scored, null and empty ones too; equal texts have equal scores, so repeated rows go or stay
    together. Without labels nothing is rejected. Empty table: no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out("doc_id"))
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(docs.select(F.struct("*").alias("row"), "text"), model)
    return scored.filter(F.col("toxicity") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: sets of five words with a Jaccard likeness of 0.8 or more, through
    any chain. Candidates pass 128-bit SimHash pivot tables, links are verified on the whole sets.

    The smallest doc_id stays (null last, ties by a hash of the text); repeated rows are one; of all null, empty and
    wordless texts one stays. Empty table: no rows."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, whole texts searched. Null and empty texts and rows without an id stay;
    repeated rows go or stay together. Empty tables: all rows stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Null and empty texts weigh nothing and come
    once; a null source is one of its own, after all others; ties go by a hash of doc_id. Empty table: no rows."""
    return mixing.expand(mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot, in place of columns of these names. Null texts weigh one byte, null values
    sort first, repeated rows stay in one shard. Empty table: no rows."""
    added = ["size", "shard", "slot"]
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    return sharding.kd_shards(docs, SHARDS).select(*own, *added)


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
