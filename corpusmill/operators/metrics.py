"""Training-log metrics: smoothing, running best, capped histories, schedule, validation, checkpoints.

A run is the unit of order; its log is folded in one pass over its rows sorted by step. Null, NaN and infinite values
count as missing and are left out of means, smoothing and minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.05
MAX_STEPS, WARMUP, STABLE, PEAK, FLOOR = 80_000, 0.0375, 0.7125, 3e-4, 1e-5
HISTORY_LIMIT, HISTORY_KEEP = 2000, 1500
#: Steps of a run that one task takes at once, and values folded together.
PIECE, FOLD = 4096, 256


def finite(c: Column) -> Column:
    """The value, or null if it is null, NaN or infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def deduplicated(log: DataFrame, keys: tuple[str, ...] = ("run_id", "step"), validation: bool = False) -> DataFrame:
    """The last delivered record of each step, training and validation records apart.

    A resumed run logs steps again and records arrive twice: the latest by time, then by log_id, counts. One map-side
    maximum per key, no window over a run.
    """
    kind = F.col("val_loss").isNotNull() & F.col("loss").isNull()
    rest = [c for c in log.columns if c not in keys]
    latest = log.where(kind == F.lit(validation)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("logged_at", F.lit("1970-01-01").cast("timestamp_ntz")), "log_id")).alias("r"))
    return latest.select(*keys, "r.*")


def smoothed(series: DataFrame, key: str = "run_id", order: str = "step", value: str = "loss", alpha: float = ALPHA) -> DataFrame:
    """``key, order, value, ema``: e = a*x + (1-a)*e from the first value of each run on.

    The fold is split: a run is cut into pieces of rows, each piece is folded from zero with its weight, the pieces'
    ends are chained, and the chained value enters each piece again. A run of any length is many small tasks.
    """
    rows = series.select(key, order, finite(F.col(value)).cast("double").alias(value)).where(F.col(value).isNotNull())
    piece = F.floor(F.col(order) / PIECE)
    schema = f"`{key}` string, `{order}` bigint, `{value}` double, partial double, weight double, piece bigint"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf[value].to_numpy()
        partial = np.empty(len(x))
        e = 0.0
        for at in range(0, len(x), FOLD):  # so few at once that the powers of 1 - alpha keep their precision
            v = x[at : at + FOLD]
            power = (1 - alpha) ** np.arange(1, len(v) + 1)
            partial[at : at + FOLD] = power * (e + np.cumsum(alpha * v / power))
            e = partial[at + len(v) - 1]
        weight = (1 - alpha) ** np.arange(1, len(x) + 1)
        return pd.DataFrame({key: pdf[key].astype(str), order: pdf[order], value: x, "partial": partial, "weight": weight, "piece": pdf["piece"]})

    parts = rows.withColumn("piece", piece.cast("bigint")).groupBy(key, "piece").applyInPandas(fold, schema)
    ends = parts.groupBy(key, "piece").agg(F.max_by(F.struct("partial", "weight"), order).alias("end"), F.min_by(value, order).alias("first"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        s, carry = pdf["first"].iloc[0], []
        for partial, weight in zip(pdf["partial"], pdf["weight"]):
            carry.append(s)
            s = partial + weight * s
        return pd.DataFrame({key: pdf[key], "piece": pdf["piece"], "carry": carry})

    # one row for each PIECE of a run
    carry = ends.select(F.col(key).cast("string").alias(key), "piece", "first", "end.partial", "end.weight").groupBy(key).applyInPandas(chain, f"`{key}` string, piece bigint, carry double")
    return parts.join(carry, [key, "piece"]).select(key, order, value, (F.col("partial") + F.col("weight") * F.col("carry")).alias("ema"))


def running_best(validation: DataFrame, key: str = "run_id", order: str = "step", value: str = "val_loss") -> DataFrame:
    """Adds ``best`` so far and ``improved``: strictly below everything before.

    A run is cut into pieces of steps; minima run inside a piece, and only one row a piece is ordered over the run.
    """
    rows = validation.where(finite(F.col(value)).isNotNull()).withColumn("__piece", F.floor(F.col(order) / PIECE))
    lows = rows.groupBy(F.col(key).alias("__key"), F.col("__piece").alias("__of")).agg(F.min(value).alias("__low"))
    earlier = lows.select("__key", "__of", F.min("__low").over(Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"))
    w = Window.partitionBy(key, "__piece").orderBy(order)
    inside = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("__inside", inside).join(earlier, F.col(key).eqNullSafe(F.col("__key")) & F.col("__piece").eqNullSafe(F.col("__of")))
    before = F.least("__inside", "__earlier")
    best = joined.withColumn("improved", before.isNull() | (F.col(value) < before)).withColumn("best", F.least(before, F.col(value)))
    return best.drop("__piece", "__inside", "__key", "__of", "__earlier")


def capped_size(appended: Column) -> Column:
    """Length after so many appends when a list over HISTORY_LIMIT is cut to its last HISTORY_KEEP."""
    return F.when(appended <= HISTORY_LIMIT, appended).otherwise(HISTORY_KEEP + (appended - HISTORY_LIMIT - 1) % (HISTORY_LIMIT - HISTORY_KEEP + 1))


def capped_history(series: DataFrame, key: str = "run_id", order: str = "step", value: str = "loss") -> DataFrame:
    """Rows a capped history holds at the end of each run, as (key, step, value)."""
    rows = series.where(finite(F.col(value)).isNotNull())
    total = rows.groupBy(key).agg(capped_size(F.count("*")).alias("__keep"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= HISTORY_LIMIT).join(total, key).where("__rank <= __keep").select(key, order, F.round(value, 5).alias("value"))


def learning_rate(step: Column, max_steps: int = MAX_STEPS) -> Column:
    """Linear warm-up, plateau, cosine decay; the boundaries are fractions of all steps counted from zero."""
    warm, stable = int(max_steps * WARMUP), int(max_steps * STABLE)
    ratio = (step - stable) / F.lit(max(max_steps - stable, 1))
    return F.when(step < warm, PEAK * (step + 1) / max(warm, 1)).when(step < stable, PEAK).otherwise(FLOOR + 0.5 * (1 + F.cos(F.lit(3.141592653589793) * ratio)) * (PEAK - FLOOR))


def validation_summary(validation: DataFrame, key: str = "run_id", batches: int = 500) -> DataFrame:
    """Mean validation loss over the first ``batches`` records of a run, and its perplexity with the exponent capped at 20."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("step"))
    rows = validation.where(finite(F.col("val_loss")).isNotNull()).withColumn("__r", rank).where(F.col("__r") <= batches)
    return rows.groupBy(key).agg(F.avg("val_loss").alias("mean_val_loss")).withColumn("perplexity", F.exp(F.least(F.col("mean_val_loss"), F.lit(20.0))))


def optimiser_steps(micro: DataFrame, key: str = "run_id", order: str = "step", value: str = "loss", accumulate: int = 16) -> DataFrame:
    """Mean loss of every ``accumulate`` consecutive micro-steps."""
    return micro.where(finite(F.col(value)).isNotNull()).groupBy(key, F.floor(F.col(order) / accumulate).alias("optimiser_step")).agg(F.avg(value).alias("mean_loss"), F.count("*").alias("micro_steps"))


def newest(checkpoints: DataFrame, keep: int = 3, key: str = "run_id", order: str = "step") -> DataFrame:
    return checkpoints.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("__r") <= keep).drop("__r")


def chosen_checkpoint(paths: DataFrame, explicit: str | None = None) -> DataFrame:
    """The explicit path if it exists, else best.pt, else final.pt, else the highest numbered one."""
    step = F.regexp_extract("path", r"ckpt_(\d+)\.pt$", 1)
    rank = F.when(F.col("path") == F.lit(explicit), 0).when(F.col("path").rlike(r"(^|/)best\.pt$"), 1).when(F.col("path").rlike(r"(^|/)final\.pt$"), 2).when(step != "", 3)
    ranked = paths.withColumn("__rank", rank).where("__rank is not null").withColumn("__step", F.coalesce(F.try_to_number(step, F.lit("999999999999")).cast("bigint"), F.lit(0)))
    return ranked.orderBy("__rank", F.desc("__step"), "path").limit(1).select("path")


def throughput(log: DataFrame, tokens_per_step: int = 65_536, max_steps: int = MAX_STEPS) -> DataFrame:
    """Adds tokens seen and the seconds left at the logged rate; null where the rate is missing."""
    left = (F.lit(max_steps) - F.col("step")) * tokens_per_step
    return log.withColumn("tokens_seen", (F.col("step") + 1) * tokens_per_step).withColumn("eta_seconds", F.when(finite(F.col("tok_per_sec")) > 0, left / F.col("tok_per_sec")))


def humanised(c: Column) -> Column:
    """1.23B, 4.5M, 6.7K or the plain number."""
    return F.when(c >= 1e9, F.concat(F.format_string("%.2f", c / 1e9), F.lit("B"))).when(c >= 1e6, F.concat(F.format_string("%.1f", c / 1e6), F.lit("M"))).when(c >= 1e3, F.concat(F.format_string("%.1f", c / 1e3), F.lit("K"))).otherwise(c.cast("bigint").cast("string"))


def chart_points(history: DataFrame) -> DataFrame:
    return history.select("run_id", F.col("step").alias("x"), F.col("value").alias("y"))


def sanitised(df: DataFrame, columns: Iterator[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})
