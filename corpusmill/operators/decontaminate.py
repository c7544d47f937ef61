"""Screening against held-out texts by word n-grams.

Null texts have no n-grams. An empty blacklist contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import nfc, with_ngrams, words

MAX_BROADCAST_NGRAMS = 2_000_000


def matching_words(c: Column) -> Column:
    return words(F.lower(nfc(c)))


def blacklist(benchmark: DataFrame, text: str = "text", n: int = 13) -> DataFrame:
    """Distinct ``ngram`` of all texts."""
    df = with_ngrams(benchmark.where(F.col(text).isNotNull()).withColumn("__w", matching_words(F.col(text))), "__w", "__g", n)
    return df.select(F.explode("__g").alias("ngram")).distinct()


def _keys(c: Column, n: int) -> Column:
    """64-bit keys of the n-grams of an array of words."""
    last = F.size(c) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(c, i, n)))).otherwise(F.array().cast("array<bigint>"))


def contaminated(documents: DataFrame, banned: DataFrame, text: str = "text", n: int = 13, threshold: int = 1, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, hits`` of documents with at least ``threshold`` positions whose n-gram is banned.

    Documents are found by 64-bit keys, and no n-gram of the corpus is moved as a string: the banned keys are broadcast
    up to a checked number, beyond it keys of eight bytes meet in a shuffle. Only the documents found are read again, and
    their hits counted on the n-grams themselves.
    """
    held = documents.where(F.col(text).isNotNull()).select(id_column, F.col(text).alias("__text"))
    banned_keys = banned.select(F.xxhash64(F.split("ngram", " ")).alias("key")).distinct()
    small = banned_keys.limit(MAX_BROADCAST_NGRAMS + 1).count() <= MAX_BROADCAST_NGRAMS
    keys = held.withColumn("__w", matching_words(F.col("__text"))).select(id_column, F.explode(_keys(F.col("__w"), n)).alias("key"))
    found = keys.join(F.broadcast(banned_keys) if small else banned_keys, "key", "left_semi").select(F.col(id_column).alias("__id")).distinct()
    again = held.join(found, F.col(id_column).eqNullSafe(F.col("__id")), "left_semi").withColumn("__w", matching_words(F.col("__text")))
    grams = with_ngrams(again, "__w", "__g", n).select(id_column, F.explode("__g").alias("ngram"))
    hit = grams.join(banned, "ngram", "left_semi")
    return hit.groupBy(id_column).agg(F.count("*").alias("hits")).where(F.col("hits") >= threshold)
