"""Problem 3: sources mixed to target shares of the total size.

Entropy balancing: among all rates with the wanted tokens per category, those nearest to the base rates in relative
entropy are exponential tilts of them, cut off at the category's repeats. The dual is convex; its Newton steps need one
gradient and one Hessian per category, summed over a table of (category, size) counts in one distributed job a step. The
rates become whole copies by systematic rounding along the sizes, which keeps every group's total within one document.

With the constraints that the tables give, a category's tokens and its mean document length, the uniform rate is feasible
and therefore the optimum: the dual ends at (ln rate, 0) and no document is tilted against another of its category.

Defined results: a null or empty text and a source without category or ratio are not drawn; a category with ratio but no
text is reported with share 0 and takes no part in the feasible total; repeated rows are separate records.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.mixing import category
from corpusmill.plans.lineage import materialize

GROUP = 20_000
#: Categories are held by the driver; a table of more ratios is refused.
MOST_CATEGORIES = 1000


def sized_records(counted: DataFrame, ratios: DataFrame) -> DataFrame:
    """``doc_id, source, category, n_chars, n_tokens, ratio, max_repeats`` of the records that can be drawn."""
    if ratios.count() > MOST_CATEGORIES:
        raise ValueError("so many categories do not fit a broadcast and the driver")
    r = ratios.select("category", "ratio", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")).where("ratio > 0")
    return counted.where("n_tokens > 0").withColumn("category", category(F.col("source"))).join(F.broadcast(r), "category").select("doc_id", "source", "category", "n_chars", "n_tokens", "ratio", "max_repeats")


def _sums(sizes: DataFrame, dual: dict[str, tuple[float, float]]) -> dict[str, np.ndarray]:
    """Per category: documents and tokens drawn at the current dual, and their derivatives.

    Records at their cap count in the derivatives as if they were just below it, so that these never vanish.
    """
    a, b = F.lit(0.0), F.lit(0.0)
    for name, (x, y) in dual.items():
        a, b = F.when(F.col("category") == name, F.lit(x)).otherwise(a), F.when(F.col("category") == name, F.lit(y)).otherwise(b)
    z = F.col("n_tokens") / F.col("scale")
    raw = F.exp(F.least(a + b * z, F.lit(50.0)))
    w = F.least(raw, F.col("max_repeats").cast("double"))
    n = F.col("n")
    rows = sizes.groupBy("category").agg(*(F.sum(x).alias(k) for k, x in (("d", n * w), ("t", n * w * z), ("h2", n * w * z * z)))).collect()
    return {r["category"]: np.array([r.d, r.t, r.h2]) for r in rows}


def solve(records: DataFrame, total: int | None = None, iterations: int = 40, tolerance: float = 1e-10) -> tuple[dict, int]:
    """Dual variables of each category, and the total of tokens aimed at.

    Without a wanted total it is the largest that meets all ratios exactly within the repeats. A category that has to be
    drawn in full is at its cap and needs no dual. The constraints of a category are its tokens and, so that long and
    short documents keep their proportion, its documents; both duals move together in damped Newton steps. A dual that
    has not converged after ``iterations`` steps is an error.
    """
    stats = {r["category"]: r for r in records.groupBy("category").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.max("ratio").alias("ratio"), F.max("max_repeats").alias("cap")).collect()}
    stats = {k: r for k, r in stats.items() if r.tokens and r.cap}
    whole = sum(r.ratio for r in stats.values()) or 1.0
    feasible = min((int(r.tokens * r.cap / (r.ratio / whole)) for r in stats.values()), default=0)
    aim = feasible if total is None else total
    duals: dict[str, dict] = {}
    for name, r in stats.items():
        want = min(aim * r.ratio / whole, r.tokens * r.cap)
        duals[name] = {"rate": want / r.tokens, "cap": r.cap, "mean": r.tokens / r.documents, "documents": r.documents, "full": want >= r.tokens * r.cap * (1 - 1e-9), "dual": (0.0, 0.0)}
    open_ = {k for k, d in duals.items() if not d["full"]}
    scale = F.lit(1.0)
    for name, d in duals.items():
        scale = F.when(F.col("category") == name, F.lit(d["mean"])).otherwise(scale)
    sizes = materialize(records.where(F.col("category").isin(sorted(open_) or [""])).groupBy("category", "n_tokens", "max_repeats").agg(F.count("*").alias("n")).withColumn("scale", scale))
    for _ in range(iterations + 1):
        if not open_:
            break
        got = _sums(sizes, {k: duals[k]["dual"] for k in open_})
        for name in sorted(open_):
            d, s = duals[name], got[name]
            wanted = d["rate"] * d["documents"]
            gradient = np.array([wanted - s[0], wanted - s[1]])
            if np.abs(gradient).max() <= tolerance * max(wanted, 1e-9):
                open_.discard(name)
                continue
            # Newton's step on the logarithms of both sums, which does not run past the cap from far below
            hessian = np.array([[s[0], s[1]], [s[1], s[2]]]) + np.eye(2) * 1e-9 * (1 + s[0])
            step = np.linalg.solve(hessian, s[:2] * np.log(wanted / s[:2]))
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            d["dual"] = (d["dual"][0] + float(step[0]), d["dual"][1] + float(step[1]))
    if open_:
        raise RuntimeError(f"the dual of {sorted(open_)} has not converged")
    return duals, aim


def draw(records: DataFrame, duals: dict) -> DataFrame:
    """Adds ``rate`` and ``copies``.

    Copies come from running sums of the rates along the sizes inside groups of bounded size, from a start that the
    group's hash decides; a record's copies are the whole numbers its stretch of the sum passes.
    """
    rate, cap, mean = F.lit(0.0), F.lit(0), F.lit(1.0)
    for name, d in duals.items():
        here = F.col("category") == name
        mean = F.when(here, F.lit(d["mean"])).otherwise(mean)
        cap = F.when(here, F.lit(d["cap"])).otherwise(cap)
    for name, d in duals.items():
        value = F.lit(float(d["cap"])) if d["full"] else F.exp(F.least(d["dual"][0] + d["dual"][1] * F.col("n_tokens") / mean, F.lit(50.0)))
        rate = F.when(F.col("category") == name, F.least(value, cap.cast("double"))).otherwise(rate)
    groups = max(1, math.ceil(max((d["documents"] for d in duals.values()), default=1) / GROUP))
    df = records.withColumn("rate", rate).withColumn("__g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    keys = ["category", "__g"]
    run = F.sum("rate").over(Window.partitionBy(*keys).orderBy("n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    start = F.pmod(F.xxhash64(F.lit("start"), *keys), F.lit(1_000_003)) / 1_000_003
    upper = F.floor(run + start + 1e-9)
    copies = F.greatest(F.least(upper - F.floor(run - F.col("rate") + start + 1e-9), F.ceil(F.col("rate") - 1e-9)), F.lit(0))
    return df.withColumn("copies", copies.cast("int")).drop("__g")


def shares(drawn: DataFrame, ratios: DataFrame) -> DataFrame:
    """Per category of the ratio table: what was drawn, and the shares reached in characters and in tokens."""
    c = F.col("copies")
    per = drawn.groupBy("category").agg(
        F.count("*").alias("available"), F.count_if(c > 0).alias("documents"), F.sum(c).alias("copies"), F.max(c).alias("most_repeats"), F.sum(c * F.col("n_chars")).alias("characters"), F.sum(c * F.col("n_tokens")).alias("tokens")
    )
    out = ratios.select("category", "ratio", "max_repeats").join(per, "category", "left").fillna(0)
    total = out.agg(F.sum("characters").alias("__c"), F.sum("tokens").alias("__t"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.join(F.broadcast(total)).withColumn("character_share", share("characters", "__c")).withColumn("token_share", share("tokens", "__t")).drop("__c", "__t")
