"""Streaming counterparts: incremental deduplication against a stored seen-table, and live log metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions.text import nfc
from corpusmill.operators.dedup import new_rows


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def incremental_dedup(stream: DataFrame, store: str, checkpoint: str, text: str = "text", order: tuple[str, ...] = ("doc_id",)) -> StreamingQuery:
    """Keeps each new text once over all batches and restarts.

    ``store/seen/batch=N`` has the digests and ``store/kept/batch=N`` the rows of a batch. Both are overwritten when a
    batch is replayed, and a replay reads only the digests of earlier batches, so the result does not change.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        keyed = df.withColumn("digest", F.md5(nfc(F.col(text))))
        seen = _stored(spark, f"{store}/seen", "digest string, batch bigint").where(F.col("batch") < number)
        fresh = new_rows(keyed, seen, "digest", order)
        fresh.write.mode("overwrite").parquet(f"{store}/kept/batch={number}")
        kept = spark.read.parquet(f"{store}/kept/batch={number}")
        kept.select("digest").where("digest is not null").write.mode("overwrite").parquet(f"{store}/seen/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(log: DataFrame, time: str = "logged_at", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Mean loss and rate per run and window of event time; rows later than the watermark are left out."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return (
        log.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), "run_id")
        .agg(F.avg(finite("loss")).alias("mean_loss"), F.avg(finite("tok_per_sec")).alias("mean_rate"), F.count("*").alias("records"))
        .select("run_id", F.col("w.start").alias("window_start"), "mean_loss", "mean_rate", "records")
    )
