"""Reason-coded quality filter: one pass, first failing rule wins.

A null or empty text, or one that is empty after cleaning, has the reason ``empty``; a record whose JSON did not parse
has ``parse_error`` where the reader delivers ``_corrupt_record``. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import NOT_W, W, clean, clean_code, is_code, is_code_path, nfc, strip, with_ngrams, words

REASONS = ["parse_error", "empty", "too_short", "low_vocab", "long_words", "repetitive", "non_latin", "short_sentences", "list_heavy", "no_code_content", "mostly_comments", "ok"]
#: Directives that count as code in C mode.
C_DIRECTIVES = ["#include", "#define", "#ifdef", "#ifndef", "#endif", "#pragma", "#if ", "#else", "#elif", "#undef", "#line", "#error", "#warning"]


def longest_run(c: Column) -> Column:
    """How often the most frequent element of an array occurs: sort, then one pass over the runs."""
    step = lambda s, x: F.struct(
        x.alias("last"), F.when(s["last"] == x, s["n"] + 1).otherwise(1).alias("n"), F.greatest(s["best"], F.when(s["last"] == x, s["n"] + 1).otherwise(1)).alias("best")
    )
    return F.aggregate(F.sort_array(c), F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best")), step, lambda s: s["best"])


def latin_share(c: Column) -> Column:
    solid = F.length(F.regexp_replace(c, W, ""))
    latin = F.length(F.regexp_replace(c, rf"{W}|[^\x{{0}}-\x{{24f}}]", ""))
    return F.when(solid > 0, latin / F.greatest(solid, F.lit(1))).otherwise(F.lit(0.0))


def sentence_stats(c: Column) -> Column:
    """Struct of the sentences that are not blank and those of them with fewer than six words."""
    pieces = F.filter(F.split(c, "[.!?]+"), lambda s: s.rlike(NOT_W))
    return F.struct(F.size(pieces).alias("sentences"), F.size(F.filter(pieces, lambda s: F.size(words(s)) < 6)).alias("short"))


def list_stats(c: Column) -> Column:
    lines = F.split(c, "\n")
    full = F.filter(F.transform(lines, strip), lambda s: s != "")
    return F.struct(F.size(lines).alias("lines"), F.size(full).alias("full"), F.size(F.filter(full, lambda s: s.rlike(rf"\A(?:[-*•▪▸►→]|\p{{Nd}}+[.)]){W}"))).alias("items"))


def comment_stats(c: Column, c_mode: bool = False) -> Column:
    """Struct of code lines and comment lines."""
    live = F.filter(F.transform(F.split(c, "\n"), strip), lambda s: ~s.isin("", "{", "}", "*/"))
    hash_line = lambda s: s.startswith("#")
    if c_mode:
        directive = lambda s: s.rlike("^(?:" + "|".join(d.replace(" ", "[ ]") for d in C_DIRECTIVES) + ")")
        comment = lambda s: s.rlike(r"^(?:/\*|\* |\*/|//)") | (hash_line(s) & ~directive(s))
    else:
        comment = lambda s: s.rlike(r"^(?:/\*|\* |\*/|//|#)")
    comments = F.size(F.filter(live, comment))
    return F.struct((F.size(live) - comments).alias("code"), comments.alias("comments"))


def prepared(documents: DataFrame, text: str = "text", source: str | None = "source") -> DataFrame:
    """Adds ``is_code`` and ``cleaned``: by the raw text or a source that holds code."""
    flag = is_code(F.col(text))
    if source and source in documents.columns:
        flag = flag | is_code_path(F.col(source))
    df = documents.withColumn("is_code", flag)
    return df.withColumn("cleaned", F.when(F.col("is_code"), clean_code(F.coalesce(F.col(text), F.lit("")))).otherwise(clean(F.coalesce(F.col(text), F.lit("")))))


def with_reason(documents: DataFrame, text: str = "text", source: str | None = "source", c_mode: bool = False) -> DataFrame:
    """Adds ``is_code``, ``cleaned`` and ``reason``."""
    df = prepared(documents, text, source)
    code, t = F.col("is_code"), F.col("cleaned")
    df = with_ngrams(df.withColumn("__words", words(t)), "__words", "__trigrams", 3)
    # each statistic is a column of its own: computed once, and only for the branch that asks for it
    df = df.withColumns({"__s": F.when(~code, sentence_stats(t)), "__l": F.when(~code, list_stats(t)), "__c": F.when(code, comment_stats(t, c_mode)), "__run": longest_run(F.col("__trigrams"))})
    w, n = F.col("__words"), F.size("__words")
    sentences, lists, comments = F.col("__s"), F.col("__l"), F.col("__c")
    total = F.greatest(comments["code"] + comments["comments"], F.lit(1))
    reason = (
        F.when(t == "", "empty")
        .when(F.length(t) < F.when(code, 50).otherwise(200), "too_short")
        .when(~code & ((n < 20) | (F.size(F.array_distinct(w)) < F.least(F.lit(50), F.greatest(F.lit(10), F.floor(n / 3))))), "low_vocab")
        .when(F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)) > F.when(code, 80).otherwise(50), "long_words")
        .when((n >= 10) & (F.col("__run") / F.greatest(F.size("__trigrams"), F.lit(1)) > F.when(code, 0.6).otherwise(0.3)), "repetitive")
        .when(~code & (latin_share(t) < 0.65), "non_latin")
        .when(~code & (sentences["sentences"] >= 3) & (sentences["short"] / F.greatest(sentences["sentences"], F.lit(1)) >= 0.8), "short_sentences")
        .when(~code & (lists["lines"] >= 5) & (lists["full"] > 0) & (lists["items"] / F.greatest(lists["full"], F.lit(1)) >= 0.7), "list_heavy")
        .when(code & (comments["code"] == 0), "no_code_content")
        .when(code & (comments["comments"] / total > (0.9 if c_mode else 0.8)), "mostly_comments")
        .otherwise("ok")
    )
    if "_corrupt_record" in documents.columns:
        reason = F.when(F.col("_corrupt_record").isNotNull(), "parse_error").otherwise(reason)
    # a filter on the reason must not be pushed below it, which would evaluate the whole chain twice
    fixed = F.when(F.monotonically_increasing_id() >= 0, reason)
    return df.withColumn("reason", fixed).drop("__words", "__trigrams", "__s", "__l", "__c", "__run")


def kept(documents: DataFrame, **options) -> DataFrame:
    """Documents that pass, with ``normalised`` and its ``digest``."""
    return with_reason(documents, **options).where("reason = 'ok'").withColumn("normalised", nfc(F.col("cleaned"))).withColumn("digest", F.md5("normalised"))


def histogram(reasoned: DataFrame, *keys: str) -> DataFrame:
    return reasoned.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
