"""Filters on next-token distributions in long form: (row_id, token_id, logit).

Null and NaN logits are no candidates. Ties at the k-th place are all kept; in the running sums of top-p they are
ordered by token id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(vectors: DataFrame, id_column: str = "vec_id", values: str = "embedding") -> DataFrame:
    return vectors.select(F.col(id_column).alias("row_id"), F.posexplode(values).alias("token_id", "logit")).withColumn("logit", F.col("logit").cast("double")).where(F.col("logit").isNotNull() & ~F.isnan("logit"))


def top_k(logits: DataFrame, k: int) -> DataFrame:
    return logits.withColumn("__r", F.rank().over(Window.partitionBy("row_id").orderBy(F.desc("logit")))).where(F.col("__r") <= k).drop("__r")


def with_probability(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    row = Window.partitionBy("row_id")
    e = F.exp((F.col("logit") - F.max("logit").over(row)) / temperature)
    return logits.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(row)).drop("__e")


def top_p(logits: DataFrame, p: float, temperature: float = 1.0) -> DataFrame:
    """Tokens whose preceding, more probable ones sum to at most p; the first always stays."""
    w = Window.partitionBy("row_id").orderBy(F.desc("p"), "token_id").rowsBetween(Window.unboundedPreceding, -1)
    return with_probability(logits, temperature).withColumn("__before", F.coalesce(F.sum("p").over(w), F.lit(0.0))).where(F.col("__before") <= p).drop("__before")


def repetition_penalty(logits: DataFrame, history: DataFrame, penalty: float = 1.2, last: int = 64) -> DataFrame:
    """Logits of tokens among the last ones of ``history`` (row_id, tokens): divided if positive, else multiplied."""
    recent = history.select("row_id", F.explode(F.array_distinct(F.slice("tokens", F.when(F.size("tokens") > last, -last).otherwise(1).cast("int"), F.lit(last)))).alias("token_id")).withColumn("__seen", F.lit(True))
    out = F.when(F.col("__seen"), F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)).otherwise(F.col("logit"))
    return logits.join(recent, ["row_id", "token_id"], "left").withColumn("logit", out).drop("__seen")


def acceptance(main: Column, draft: Column, draw: Column) -> Column:
    """Whether a drafted token is accepted: draw < min(1, p/q), always for q = 0."""
    return draw < F.when(draft > 0, F.least(F.lit(1.0), main / draft)).otherwise(1.0)


def residual(pairs: DataFrame) -> DataFrame:
    """(row_id, token_id, p, q) with ``r``: max(p - q, 0) normalised; p itself where nothing is left."""
    row = Window.partitionBy("row_id")
    d = pairs.withColumn("__d", F.greatest(F.col("p") - F.col("q"), F.lit(0.0))).withColumn("__t", F.sum("__d").over(row))
    return d.withColumn("r", F.when(F.col("__t") > 0, F.col("__d") / F.when(F.col("__t") > 0, F.col("__t"))).otherwise(F.col("p"))).drop("__d", "__t")


def log_normaliser(logits: DataFrame) -> DataFrame:
    m = logits.groupBy("row_id").agg(F.max("logit").alias("__m"))
    return logits.join(m, "row_id").groupBy("row_id").agg((F.first("__m") + F.log(F.sum(F.exp(F.col("logit") - F.col("__m"))))).alias("logsumexp"))
