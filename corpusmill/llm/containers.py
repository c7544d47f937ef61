"""Problem 6: documents into sequences of fixed capacity.

Documents are dealt into groups of bounded size by a hash of their id, and each group is packed on its own. A document
over the capacity is cut into full sequences and a rest; nothing else is cut. The fragments go, in descending order, to
the sequence of lowest estimated cost (linear plus quadratic in the fragments' lengths) that still has room; how many
sequences are open from the start is searched for, since too few or too many both leave space.

Defined results: a null text is no document; an empty one is its begin and end token; ties go by document id; repeated
rows with one id are each placed; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.lineage import materialize

CAPACITY = 1025
FRAME = 2
GROUP = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 512


def _assign(sizes: np.ndarray, opened: int, capacity: int) -> tuple[np.ndarray, int]:
    """Sequence of each of the descending sizes, and the number of sequences used."""
    most = opened + len(sizes)
    cost, room = np.full(most, np.inf), np.full(most, capacity)
    cost[:opened] = 0
    place = np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        fits = np.where(room[:opened] >= size, cost[:opened], np.inf)
        k = int(fits.argmin()) if opened else 0
        if not opened or fits[k] == np.inf:
            k = opened
            opened += 1
            cost[k] = 0
        place[i] = k
        cost[k] += LINEAR * size + QUADRATIC * size * size
        room[k] -= size
    return place, len(np.unique(place))


def assign(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Sequences of descending sizes, none over the capacity: the number of open sequences is searched."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    least = math.ceil(sizes.sum() / capacity)
    best = None
    for opened in sorted({0, *(int(least * x) for x in (0.5, 0.8, 0.9, 0.95, 0.98, 1.0, 1.02, 1.05))}):
        place, used = _assign(sizes, opened, capacity)
        if best is None or used < best[1]:
            best = (place, used)
        if used == least:
            break
    return np.unique(best[0], return_inverse=True)[1]


def pack(sized: DataFrame, size: str = "n_tokens", id_column: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``doc_id, fragment, sequence, position, token_from, n``: where every fragment lies.

    ``n`` counts the begin and end token, ``token_from`` is the fragment's first token in the framed document.
    """
    # written once: the sizes are counted and packed, and computing them is the dear part
    docs = materialize(sized.where(F.col(size).isNotNull()).select(id_column, (F.col(size) + FRAME).cast("bigint").alias("size")))
    groups = max(1, math.ceil(docs.count() / group))
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, fragment bigint, sequence string, position bigint, token_from bigint, n bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = int(pdf["g"].iloc[0])
        pdf = pdf.sort_values([id_column, "size"], kind="stable")
        ids, total = pdf[id_column].to_numpy(), pdf["size"].to_numpy()
        full = total // capacity
        rest = total - full * capacity
        # full sequences of over-long documents
        row = np.repeat(np.arange(len(ids)), full)
        number = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        parts = [(row, number, np.arange(len(row)), np.zeros(len(row), np.int64), np.full(len(row), capacity))]
        left = np.flatnonzero(rest)
        order = left[np.argsort(-rest[left], kind="stable")]
        place = assign(rest[order], capacity)
        # positions: fragments of a sequence stand in the order in which they came
        by = np.argsort(place, kind="stable")
        before = np.cumsum(rest[order][by]) - rest[order][by]
        position = np.empty(len(order), np.int64)
        first = np.r_[True, place[by][1:] != place[by][:-1]] if len(by) else np.zeros(0, bool)
        position[by] = before - np.maximum.accumulate(np.where(first, before, 0)) if len(by) else []
        parts.append((order, full[order], place + len(row), position, rest[order]))
        row, number, sequence, position, n = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({id_column: ids[row], "fragment": number, "sequence": [f"{name}-{s}" for s in sequence], "position": position, "token_from": number * capacity, "n": n})

    # a fixed number of tasks: by their few bytes alone the groups would be merged into one
    tasks = max(min(groups, sized.sparkSession.sparkContext.defaultParallelism), math.ceil(groups / 16))
    return docs.withColumn("g", F.pmod(F.xxhash64(id_column), F.lit(groups))).repartition(tasks, "g").groupBy("g").applyInPandas(run, schema)


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, tokens, the share of the capacity used, and the spread of the sequences' estimated cost."""
    cost = F.col("n") * LINEAR + F.col("n") * F.col("n") * QUADRATIC
    per = packed.groupBy("sequence").agg(F.sum("n").alias("used"), F.sum(cost).alias("cost"), F.count("*").alias("fragments"))
    return per.agg(
        F.count("*").alias("sequences"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        (F.sum("used") / (F.count("*") * F.lit(capacity))).alias("filled"),
        (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"),
        F.sum("fragments").alias("fragments"),
    )
