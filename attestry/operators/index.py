"""Index records: postings with saturated term weights, hashed embeddings, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import embed_tokens, token_index, tokenize

K1, B, AVERAGE = 1.5, 0.75, 400


def term_counts(docs: DataFrame) -> DataFrame:
    """(id, token, tf, n): how often each token is in a document of n tokens. Texts are dealt by id once; what groups
    tokens by id and more needs no further shuffle."""
    tokens = docs.select("id", "text").repartition("id").select("id", tokenize(F.col("text")).alias("t"))
    # a filter of empty lists would be pushed to the texts, which would be tokenized twice
    return tokens.select("id", F.size("t").alias("n"), F.explode_outer("t").alias("token")).filter("token IS NOT NULL").groupBy("id", "n", "token").agg(F.count("*").alias("tf"))


def postings(docs: DataFrame, k1: float = K1, b: float = B, average: int = AVERAGE) -> DataFrame:
    """(id, idx, weight): saturated term frequencies by hashed token; weights of colliding tokens add up."""
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / average))
    return term_counts(docs).groupBy("id", token_index(F.col("token")).alias("idx")).agg(F.sum(weight).alias("weight"))


def hashed_buckets(docs: DataFrame, dimension: int = 256) -> DataFrame:
    """(id, bucket, value): the non-zero places of the normalised hashing embedding. Texts are dealt by id, as in term_counts()."""
    tokens = docs.select("id", "text").repartition("id").select("id", embed_tokens(F.col("text")).alias("t"))
    tokens = tokens.select("id", F.explode_outer("t").alias("t")).filter("t IS NOT NULL").groupBy("id", "t").agg(F.count("*").alias("n"))
    sign = F.when(F.conv(F.substring(F.md5("t"), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = tokens.groupBy("id", (token_index(F.col("t")) % dimension).cast("int").alias("bucket")).agg(F.sum(F.col("n") * sign).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")).cast("double"))
    return sums.withColumn("norm", norm).filter("v <> 0 AND id IS NOT NULL").select("id", "bucket", (F.col("v") / F.col("norm")).alias("value"))


def embedded(docs: DataFrame, dimension: int = 256) -> DataFrame:
    """(id, vector): the hashing embedding as an array; all zero for texts without tokens."""
    sparse = hashed_buckets(docs, dimension).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return docs.select("id").join(sparse, "id", "left").select("id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dimension)).otherwise(value).alias("vector"))


def split_text(text: str, size: int = 1600, overlap: int = 200, marks: tuple = ("\n\n", "\n", " ")) -> list[str]:
    """Chunks of ``size`` characters at most. Each ends at the coarsest mark in its second half, or where
    it must; the next one begins up to ``overlap`` characters earlier, after a mark if there is one."""
    if not text.strip():
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for mark in marks:
                if (cut := text.rfind(mark, at + size // 2, end)) > at:
                    end = cut + len(mark)
                    break
        out.append(text[at:end])
        if end == len(text):
            break
        back = max(end - overlap, at + 1)
        cut = text.find(" ", back, end)
        at = cut + 1 if 0 <= cut < end - 1 else back
    return out


def chunks(text: Column, size: int = 1600, overlap: int = 200) -> Column:
    """The chunks of a text as an array; null text is empty, an empty text is one empty chunk."""

    @F.pandas_udf("array<string>")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([split_text(t or "", size, overlap) for t in batch])

    return split(text)
