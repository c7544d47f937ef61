"""Queries of the training-data problems, named pN_..., and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import balance, budget, containers, language, leakage, oracle, provenance, quality, sentences
from corpusmill.plans.lineage import materialize, spread

PROSE_SOURCE = "source rlike '^(italian|english)_'"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet"))


def _prose(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).where(PROSE_SOURCE)


def _counted(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    tokenizer = budget.load(spark.read.parquet(f"{sf}/bpe_vocab.parquet"), spark.read.parquet(f"{sf}/bpe_merges.parquet"))
    return budget.with_tokens(_documents(spark, sf), tokenizer, list(columns))


def p1_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    counted = _counted(spark, sf, "source", "lang", "domain")
    natural = F.coalesce(language.normalised_label(F.col("lang")), F.lower(F.trim("lang")))
    code = F.regexp_replace(F.lower(F.trim("lang")), r"^(c\+\+|cplusplus)$", "cpp")
    slices = counted.withColumn("language", F.when(F.col("source").rlike("_code$"), code).otherwise(natural)).withColumn("domain", budget.domain_name(F.col("domain")))
    return budget.totals(slices, "source", "language", "domain")


def p1_document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(spark, sf, "source")


def p1_source_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return budget.totals(_counted(spark, sf, "source"), "source")


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    stats = materialize(quality.text_statistics(_prose(spark, sf)))
    return quality.classify(stats, quality.fit_mixture(stats))


def p2_text_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.not_prose(_classified(spark, sf)).select("doc_id")


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    records = materialize(balance.sized_records(_counted(spark, sf, "source"), spark.read.parquet(f"{sf}/mix_ratios.parquet")))
    duals, _ = balance.solve(records)
    return balance.draw(records, duals)


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    return balance.shares(_drawn(spark, sf), spark.read.parquet(f"{sf}/mix_ratios.parquet"))


def p3_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _drawn(spark, sf).where("copies > 0").select("doc_id", "category", "rate", "copies")


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    drawn = _drawn(spark, sf).groupBy("category").agg(F.count("*").alias("records"), F.sum("n_tokens").alias("available"), (F.sum(F.col("rate") * F.col("n_tokens")) / F.sum("n_tokens")).alias("rate"))
    return drawn.withColumn("rate", F.round("rate", 4))


def p4_passages(spark: SparkSession, sf: str) -> DataFrame:
    docs = _prose(spark, sf)
    return language.passages(docs, language.fit_ngrams(docs), keep=["doc_id", "lang"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    junk = p2_found(spark, sf)
    found = p4_passages(spark, sf).where("language != 'und'").groupBy("doc_id", "lang").agg(F.collect_set("language").alias("languages"))
    label = language.normalised_label(F.col("lang"))
    case = label.isNull() | (F.size("languages") > 1) | ~F.array_contains("languages", label)
    return found.where(case).join(junk, "doc_id", "left_anti").select("doc_id", F.explode("languages").alias("lang"))


def p4_cover(spark: SparkSession, sf: str) -> DataFrame:
    return p4_passages(spark, sf).groupBy("doc_id").agg(F.min("start_pos").alias("first_pos"), F.max("end_pos").alias("last_pos"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("covered"))


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    files = _documents(spark, sf).where(F.col("source").rlike("_code$"))
    return provenance.score(files, provenance.fit(files))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_scores(spark, sf).where("not by_hand").select("doc_id")


def p6_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return containers.pack(_counted(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return containers.report(p6_sequences(spark, sf))


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    return p6_sequences(spark, sf).groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("fragments"), F.max("n").alias("longest"))


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id")


MAX_BROADCAST_IDS = 1_000_000


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents named in sentence_sample; their ids are broadcast up to a checked number, beyond it both sides shuffle."""
    ids = spark.read.parquet(f"{sf}/sentence_sample.parquet").select("doc_id").distinct()
    small = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return _documents(spark, sf).select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def p8_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(_sampled(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_sentences(spark, sf).select("doc_id", "end_pos")


def p8_ends(spark: SparkSession, sf: str) -> DataFrame:
    return p8_sentences(spark, sf).groupBy("doc_id").agg(F.max("end_pos").alias("last_end"), (F.max("sentence") + 1 == F.count("*")).alias("numbered_through"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
