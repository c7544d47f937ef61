"""Budgets per category, deterministic sampling, shards and the systematic split.

Categories, ratios and hints are parameters; the values below are the fixed defaults. Null sources have no category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.ranges import edges_of, range_of
from corpusmill.functions.text import contains_any, md5_mod, source_hash

#: First matching pattern decides a category; hints only suggest one.
CATEGORY_PATTERNS = {
    "italian": ["italian", "oscar_it", "wiki_it", "fineweb_it", "gutenberg_it"],
    "c_code": ["c_code", "/c/", "github-code-c", "the-stack", "vault-function", "starcoderdata", "stack-dedup"],
    "cpp_code": ["cpp_code", "/cpp/", "github-code-c++", "c++"],
    "other_code": ["other_code", "multi_code", "python", "javascript", "rust", "shell", "stackoverflow"],
    "english": ["english", "openweb", "fineweb_edu", "wiki_en", "gutenberg_en"],
}
CATEGORY_HINTS = {
    "italian": ["it_", "_it.", "_it_", "/it/", "italian", "ital"],
    "c_code": ["c_src", "_c.", "/c/", ".c.jsonl", "_c_code", "ansi-c"],
    "cpp_code": ["cpp_src", "_cpp.", "/cpp/", ".cpp.jsonl", "_cpp_code"],
    "other_code": ["py_src", "js_src", "rs_src", "python_src", "javascript_src"],
    "english": ["en_", "_en.", "_en_", "/en/", "english", "eng"],
}
TARGET_CHARS = 10_000_000_000
SHARDS = 16


def category(path: Column) -> Column:
    """First category with a matching pattern, else null."""
    low, found = F.lower(path), F.lit(None).cast("string")
    for name, patterns in reversed(CATEGORY_PATTERNS.items()):
        found = F.when(contains_any(low, patterns), F.lit(name)).otherwise(found)
    return found


def likely_category(path: Column) -> Column:
    """Struct of the category with most hints, the first one on ties, and its score; nulls where nothing hints."""
    low = F.lower(path)
    scored = [F.struct(sum((low.contains(h).cast("int") for h in hints), F.lit(0)).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, hints) in enumerate(CATEGORY_HINTS.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, F.struct(best["name"].alias("category"), best["score"].alias("score")))


def require_categories(stats: DataFrame, allow_unknown: bool = False, source: str = "source") -> DataFrame:
    """The rows with a category. A source without one is an error, or is left out where unknown ones are allowed."""
    marked = stats.withColumn("category", category(F.col(source)))
    if not allow_unknown and (strange := marked.where("category is null").select(source).distinct().limit(10).collect()):
        raise ValueError(f"sources without a category: {[r[0] for r in strange]}")
    return marked.where("category is not null")


def source_stats(documents: DataFrame, text: str = "text") -> DataFrame:
    """Rows, characters and mean length of the texts of every source; null texts count as rows of no length."""
    n = F.coalesce(F.length(text), F.lit(0))
    return documents.groupBy("source").agg(F.count("*").alias("docs"), F.sum(n).alias("chars")).withColumn("avg_chars", F.col("chars") / F.col("docs"))


def budgets(stats: DataFrame, ratios: DataFrame, target: int = TARGET_CHARS) -> DataFrame:
    """Per source: its share of its category's budget, min(target * ratio, available), by estimated characters."""
    s = stats.withColumn("category", category(F.col("source"))).where("category is not null")
    total = s.groupBy("category").agg(F.sum("chars").alias("available"))
    cat = total.join(ratios.select("category", "ratio"), "category").where("ratio > 0 and available > 0")
    cat = cat.withColumn("budget", F.least(F.floor(F.lit(target) * F.col("ratio")), F.floor("available")).cast("bigint"))
    share = F.floor(F.col("budget") * (F.col("chars") / F.col("available"))).cast("bigint")
    rate = F.least(F.lit(1.0), F.greatest(F.lit(0.001), F.floor(F.col("source_budget") / F.col("avg_chars") * 1.2) / F.col("docs")))
    out = s.join(cat.select("category", "available", "budget"), "category").withColumn("source_budget", share)
    return out.withColumn("rate", F.when((F.col("docs") > 0) & (F.col("avg_chars") > 0), rate).otherwise(1.0))


def ordinals(df: DataFrame, keys: list[str], order: str, out: str = "ordinal") -> DataFrame:
    """Adds the 1-based rank by ``order`` within ``keys`` without putting a whole group into one task.

    Ranges of the order column hold about equal numbers of rows; ranks are local to a range plus the rows of the ranges
    before it.
    """
    ranged = df.withColumn("__b", range_of(order, edges_of(df, order)))
    counts = ranged.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    local = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(order))
    joined = ranged.withColumn("__local", local).join(before.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__b": "__kb"}), _same(keys))
    return joined.withColumn(out, F.col("__local") + F.col("__before")).drop("__local", "__before", "__b", "__kb", *(f"__k_{k}" for k in keys))


def _same(keys: list[str]) -> Column:
    on = F.col("__b") == F.col("__kb")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return on


def hash_sample(ranked: DataFrame, rates: DataFrame, sources: list[str], text: str = "text", ordinal: str = "ordinal") -> DataFrame:
    """Rows whose hash of source and ordinal lies under the source's rate; empty texts go afterwards."""
    number = F.lit(0)
    for s in sources:
        number = F.when(F.col("source") == s, source_hash(s)).otherwise(number)
    h = md5_mod(F.concat_ws(":", number.cast("string"), F.col(ordinal).cast("string")))
    return ranked.join(rates.select("source", "rate"), "source").where((h / 100_000 < F.col("rate")) & (F.length(text) > 0))


def shard(text: Column, shards: int = SHARDS) -> Column:
    return F.conv(F.right(F.md5(text), F.lit(1)), 16, 10).cast("int") % shards


def split(df: DataFrame, order: str = "doc_id", every: int = 100) -> DataFrame:
    """Adds ``position`` (from 0, over all rows) and ``split``: every hundredth row from the first is ``val``."""
    ranked = ordinals(df.withColumn("__all", F.lit(1)), ["__all"], order, "position").drop("__all")
    return ranked.withColumn("position", F.col("position") - 1).withColumn("split", F.when(F.col("position") % every == 0, "val").otherwise("train"))


def shuffled(df: DataFrame, seed: int = 42, id_column: str = "doc_id") -> DataFrame:
    """A fixed random order: shards permuted by hash, rows by hash within a shard."""
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("shard").cast("string"))), F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(id_column).cast("string"))), id_column)
