"""Named queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import decontaminate, dedup, metrics, mixing, packing, quality, sampling
from corpusmill.plans.lineage import materialize, shared_folder, spread
from corpusmill.plans.oracle import SQL
from corpusmill.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BUDGET_TARGET = 5_000_000
#: A byte-level tokenizer as a JSON file; only the driver reads it.
TOKENIZER = os.environ.get("CORPUSMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(*(columns or ("doc_id", "text", "source"))))


def filled(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return docs(spark, sf, *columns).where("text is not null")


@query
def code_flag(spark, sf):
    return docs(spark, sf).select("doc_id", T.is_code(F.col("text")).alias("is_code"), T.is_code_path(F.col("source")).alias("is_code_source"))


@query
def clean_text(spark, sf):
    return filled(spark, sf).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query
def clean_code_text(spark, sf):
    return filled(spark, sf).select("doc_id", T.clean_code(F.col("text")).alias("cleaned"))


@query
def normal_form(spark, sf):
    return filled(spark, sf).select("doc_id", F.md5(T.nfc(F.col("text"))).alias("digest"))


@query
def word_stats(spark, sf):
    w = T.words(F.col("text"))
    return filled(spark, sf).select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).alias("longest"))


@query
def trigram_repetition(spark, sf):
    df = T.with_ngrams(filled(spark, sf).withColumn("w", T.words(F.col("text"))), "w", "g", 3)
    return df.select("doc_id", F.size("g").alias("trigrams"), quality.longest_run(F.col("g")).alias("most_common"))


@query
def latin_ratio(spark, sf):
    return filled(spark, sf).select("doc_id", F.round(quality.latin_share(F.col("text")), 9).alias("latin_share"))


@query
def sentence_stats(spark, sf):
    return filled(spark, sf).select("doc_id", quality.sentence_stats(F.col("text")).alias("s")).select("doc_id", "s.sentences", "s.short")


@query
def list_ratio(spark, sf):
    return filled(spark, sf).select("doc_id", quality.list_stats(F.col("text")).alias("s")).select("doc_id", "s.lines", "s.full", "s.items")


@query
def comment_ratio(spark, sf):
    return filled(spark, sf).select("doc_id", quality.comment_stats(F.col("text")).alias("s")).select("doc_id", "s.code", "s.comments")


@query
def comment_ratio_c(spark, sf):
    return filled(spark, sf).select("doc_id", quality.comment_stats(F.col("text"), True).alias("s")).select("doc_id", "s.code", "s.comments")


@query
def quality_reason(spark, sf):
    return quality.with_reason(docs(spark, sf)).select("doc_id", "source", "is_code", "reason")


@query
def quality_histogram(spark, sf):
    return quality.histogram(quality.with_reason(docs(spark, sf)), "source")


@query
def top_reasons_per_source(spark, sf):
    counted = quality.histogram(quality.with_reason(docs(spark, sf)).where("reason <> 'ok'"), "source")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "reason"))
    return counted.withColumn("rank", rank).where("rank <= 3")


@query
def filter_totals(spark, sf):
    r = quality.with_reason(docs(spark, sf))
    return r.groupBy("is_code").agg(F.count("*").alias("docs"), F.count_if(F.col("reason") == "ok").alias("kept"), F.count_if(F.col("reason") != "ok").alias("rejected"))


@query
def rejection_report(spark, sf):
    r = table(spark, sf, "rejections").where("reason is not null")
    return r.groupBy("source", F.lower(F.trim("reason")).alias("reason")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def _kept(spark, sf, *columns):
    """Kept documents, written once: what follows reads them more than once, and the filter is the expensive part."""
    return materialize(quality.kept(docs(spark, sf)).select(*(columns or ("doc_id", "source", "is_code", "normalised", "digest"))))


@query
def kept_corpus(spark, sf):
    k = dedup.exact_duplicates(_kept(spark, sf, "doc_id", "source", "is_code", "digest").withColumn("rank", F.when(F.col("is_code"), 0).otherwise(1)), order=("rank", "doc_id"))
    return k.where("is_first").select("doc_id", "source", "digest")


@query
def exact_dedup(spark, sf):
    return dedup.exact_duplicates(_kept(spark, sf, "doc_id", "digest")).select("doc_id", "digest", "is_first")


@query
def dup_groups(spark, sf):
    return dedup.duplicate_groups(quality.kept(docs(spark, sf)))


@query
def incremental_dedup(spark, sf):
    keyed = filled(spark, sf).withColumn("digest", F.md5(T.nfc(F.col("text"))))
    return dedup.new_rows(keyed.where("doc_id % 2 = 1"), keyed.where("doc_id % 2 = 0")).select("doc_id", "digest")


@query
def ngram_blacklist(spark, sf):
    return decontaminate.blacklist(table(spark, sf, "benchmark"))


@query
def contaminated_docs(spark, sf):
    return decontaminate.contaminated(docs(spark, sf), decontaminate.blacklist(table(spark, sf, "benchmark")))


@query
def minhash_signature(spark, sf):
    s = dedup.signatures(_kept(spark, sf), "normalised")
    return s.select("doc_id", F.concat_ws(",", F.col("signature").cast("array<string>")).alias("signature"))


@query
def lsh_buckets(spark, sf):
    s = dedup.signatures(_kept(spark, sf).where("not is_code"), "normalised")
    b = dedup.band_keys(s, ["source", "doc_id"], *dedup.BANDS_TEXT)
    return b.groupBy("source", "band", "bucket").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id")).where("members > 1")


@query
def lsh_buckets_code(spark, sf):
    s = dedup.signatures(_kept(spark, sf).where("is_code"), "normalised")
    b = dedup.band_keys(s, ["source", "doc_id"], *dedup.BANDS_CODE)
    return b.groupBy("source", "band", "bucket").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id")).where("members > 1")


@query
def fuzzy_dedup(spark, sf):
    return dedup.near_duplicates(_kept(spark, sf))


@query
def fingerprint_keys(spark, sf):
    return dedup.fingerprints(_kept(spark, sf)).select("doc_id", "n", "fp_prefix", "fp_suffix", "fp_middle")


@query
def fingerprint_dedup(spark, sf):
    return dedup.fingerprint_dedup(_kept(spark, sf))


@query
def routed_dedup(spark, sf):
    return dedup.routed_dedup(_kept(spark, sf), most=100)


@query
def web_rows_accepted(spark, sf):
    return readers.web_rows_accepted(table(spark, sf, "web_rows")).select("row_id", "source")


@query
def min_length(spark, sf):
    return table(spark, sf, "web_rows").where(F.length("text") > 100).select("row_id")


@query
def italian_markers(spark, sf):
    return filled(spark, sf).select("doc_id", readers.likely_italian(F.col("text")).alias("likely_italian"))


@query
def autogen_header(spark, sf):
    body = table(spark, sf, "code_rows").withColumn("body", readers.first_present("content", "code", "func_code_string", "text"))
    return body.select("row_id", readers.generated_header(F.col("body")).alias("generated"), readers.generated_header(F.col("body"), readers.HEADER_MARKERS_SHORT).alias("generated_short"))


@query
def code_rows_c(spark, sf):
    return readers.code_rows_accepted(table(spark, sf, "code_rows"), "c").select("row_id", F.md5("text").alias("digest"))


@query
def code_rows_cpp(spark, sf):
    return readers.code_rows_accepted(table(spark, sf, "code_rows"), "cpp").select("row_id", F.md5("text").alias("digest"))


@query
def other_code_quota(spark, sf):
    return readers.per_language(table(spark, sf, "code_rows"), ["python", "javascript", "rust"], 90).select("row_id", "language")


@query
def source_priority_limit(spark, sf):
    rows = table(spark, sf, "web_rows").where(F.length("text") > 100)
    parts = [rows.where(F.col("source") == s).select("row_id", "source") for s in ("italian_fineweb", "italian_wiki", "italian_oscar")]
    return readers.prioritised(parts, 250)


@query
def source_registry(spark, sf):
    parts = [f().select(F.lit(name).alias("source"), "row_id") for name, f in readers.registry(spark, sf).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source").agg(F.count("*").alias("n"))


@query
def download_summary(spark, sf):
    return readers.delivery_summary(docs(spark, sf, "source"), readers.tier_limits(table(spark, sf, "tier_targets"), "smoke"))


@query
def stored_stats(spark, sf):
    s = table(spark, sf, "file_stats").where("path is not null").groupBy("path").agg(F.max_by(F.struct("source", "n", "avg_chars", "est_chars"), F.coalesce("n", F.lit(-1))).alias("s")).select("path", "s.source", "s.n")
    return s.groupBy("source").agg(F.count("*").alias("files"), F.sum("n").alias("lines"))


@query
def category_stats(spark, sf):
    s = mixing.source_stats(docs(spark, sf)).withColumn("category", mixing.category(F.col("source"))).where("category is not null")
    s = s.groupBy("category").agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"))
    return s.join(table(spark, sf, "mix_ratios"), "category").select("category", "docs", "chars", F.floor(F.col("chars") / F.col("chars_per_token")).alias("est_tokens"))


@query
def category_hint(spark, sf):
    return table(spark, sf, "file_stats").where("path is not null").select("path").distinct().select("path", mixing.category(F.col("path")).alias("category"), mixing.likely_category(F.col("path")).alias("h")).select("path", "category", F.col("h.category").alias("hint"), F.col("h.score").alias("hint_score"))


def _budgets(spark, sf):
    return mixing.budgets(mixing.source_stats(docs(spark, sf).where("source is not null")), table(spark, sf, "mix_ratios"), BUDGET_TARGET)


@query
def category_budget(spark, sf):
    return _budgets(spark, sf).select("source", "category", "budget", "source_budget", F.round("rate", 9).alias("rate"))


def _sampled(spark, sf):
    d = docs(spark, sf).where("source is not null")
    ranked = mixing.ordinals(d.select("doc_id", "text", "source"), ["source"], "doc_id")
    names = [r.source for r in table(spark, sf, "tier_targets").select("source").distinct().collect()]
    return mixing.hash_sample(ranked, _budgets(spark, sf), sorted(names))


@query
def hash_sample(spark, sf):
    return _sampled(spark, sf).select("doc_id", "source", "ordinal")


@query
def sampled_totals(spark, sf):
    return _sampled(spark, sf).groupBy("source").agg(F.count("*").alias("kept_docs"), F.sum(F.length("text")).alias("kept_chars"))


@query
def split_totals(spark, sf):
    counted = mixing.split(filled(spark, sf, "doc_id", "text").select("doc_id")).agg(F.count_if(F.col("split") == "train").alias("train_docs"), F.count_if(F.col("split") == "val").alias("val_docs"))
    return counted.withColumn("val_percent", F.round(F.col("val_docs") * 100 / (F.col("train_docs") + F.col("val_docs")), 6))


@query
def shard_counts(spark, sf):
    return filled(spark, sf).groupBy(mixing.shard(T.strip(F.col("text"))).alias("shard")).agg(F.count("*").alias("docs"))


@query
def train_val_split(spark, sf):
    return mixing.split(filled(spark, sf, "doc_id", "text").select("doc_id")).select("doc_id", "position", "split")


@query
def shuffled_order(spark, sf):
    return mixing.shuffled(filled(spark, sf).withColumn("shard", mixing.shard(T.strip(F.col("text"))))).select("doc_id", "shard")


@query
def tokenizer_sample(spark, sf):
    d = filled(spark, sf)
    return readers.bernoulli(d, 400, d.count(), T.is_code_path(F.col("source"))).select("doc_id", "source")


@query
def reservoir_mean(spark, sf):
    return readers.reservoir(filled(spark, sf), 2000).agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("avg_chars"))


@query
def byte_tokens(spark, sf):
    ids = packing.byte_tokens(F.col("text"))
    return filled(spark, sf).select("doc_id", F.size(ids).alias("n_tokens"), F.md5(F.concat_ws(",", ids.cast("array<string>"))).alias("digest"))


def _packed(spark, sf):
    d = mixing.split(filled(spark, sf, "doc_id", "text")).withColumn("ids", packing.framed(packing.byte_tokens(F.col("text"))))
    return packing.pack(d.select("split", "doc_id", "ids"))


@query
def pack_sequences(spark, sf):
    return _packed(spark, sf).select("split", "seq_id", F.size("tokens").alias("n"), F.md5(F.concat_ws(",", F.col("tokens").cast("array<string>"))).alias("digest"))


@query
def packing_totals(spark, sf):
    return _packed(spark, sf).groupBy("split").agg(F.count("*").alias("sequences"), F.sum(F.size("tokens")).alias("tokens"))


@query
def packing_report(spark, sf):
    d = mixing.split(filled(spark, sf, "doc_id", "text")).select("split", F.length("text").alias("chars"), F.size(packing.framed(packing.byte_tokens(F.col("text")))).alias("tokens"))
    out = d.groupBy("split").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    return out.withColumn("chars_per_doc", F.round(F.col("chars") / F.col("docs"), 6)).withColumn("sequences", F.floor(F.col("tokens") / packing.SEQUENCE))


@query
def binary_round_trip(spark, sf):
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    address = folder if "://" in folder or folder.startswith("/") else f"/{folder.removeprefix('file:').lstrip('/')}"
    packing.write_binary(_packed(spark, sf).where("split = 'train'"), address)
    return packing.read_binary(spark, address).select("seq_id", F.md5(F.concat_ws(",", F.col("tokens").cast("array<string>"))).alias("digest"))


@query
def json_round_trip(spark, sf):
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    readers.write_json_lines(filled(spark, sf), folder, "text")
    back = readers.json_lines(spark, folder, glob="*.json").where("_corrupt_record is null").where(F.col("text").rlike(T.NOT_W))
    return back.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query
def xy_pairs(spark, sf):
    p = packing.input_and_target(_packed(spark, sf))
    return p.select("split", "seq_id", F.md5(F.concat_ws(",", F.col("x").cast("array<string>"))).alias("x"), F.md5(F.concat_ws(",", F.col("y").cast("array<string>"))).alias("y"))


@query
def doc_boundary_mask(spark, sf):
    m = packing.boundary_mask(F.col("tokens"))
    return _packed(spark, sf).select("split", "seq_id", F.size(m).alias("n"), F.size(F.filter(m, lambda x: ~x)).alias("masked"))


@query
def mtp_mask(spark, sf):
    m = packing.distance_mask(packing.boundary_mask(F.col("tokens")), 2)
    return _packed(spark, sf).select("split", "seq_id", F.size(m).alias("n"), F.size(F.filter(m, lambda x: ~x)).alias("masked"))


@query
def mtp_targets(spark, sf):
    p = packing.input_and_target(_packed(spark, sf))
    t = packing.distant_targets(F.col("y"), 2)
    return p.select("split", "seq_id", F.size(t).alias("n"), F.element_at(t, 1).alias("first"), F.element_at(t, -1).alias("last"))


@query
def bpe_encode(spark, sf):
    e = packing.bpe_tokens(filled(spark, sf, "doc_id", "text"), TOKENIZER)
    return e.select("doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"))


@query
def bpe_round_trip(spark, sf):
    e = packing.decoded(packing.bpe_tokens(filled(spark, sf, "doc_id", "text"), TOKENIZER), TOKENIZER)
    return e.select("doc_id", (F.col("text") == F.col("decoded")).alias("same"))


@query
def piece_counts(spark, sf):
    piece = F.explode(F.regexp_extract_all("text", F.lit(rf"( ?\p{{L}}+| ?\p{{N}}+| ?[^{T.SPACE_BODY}\p{{L}}\p{{N}}]+)"), F.lit(1)))
    return filled(spark, sf).select(piece.alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def _training(spark, sf):
    return metrics.deduplicated(table(spark, sf, "step_log"))


def _validation(spark, sf):
    return metrics.deduplicated(table(spark, sf, "step_log"), validation=True)


@query
def ema_loss(spark, sf):
    e = metrics.smoothed(_training(spark, sf))
    # short runs end on exact halves of the last digit: decimals round those alike whatever the last bit says
    return e.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.round(F.max_by("ema", "step"), 9).cast("decimal(20,9)"), 6).cast("double").alias("ema"))


@query
def running_best(spark, sf):
    return metrics.running_best(_validation(spark, sf)).select("run_id", "step", F.round("best", 6).alias("best"), "improved")


@query
def capped_history(spark, sf):
    return metrics.capped_history(_training(spark, sf)).select("run_id", "step", F.round("value", 4).alias("value"))


@query
def chart_points(spark, sf):
    return metrics.chart_points(metrics.capped_history(_validation(spark, sf), value="val_loss")).select("run_id", "x", F.round("y", 4).alias("y"))


@query
def keep_latest(spark, sf):
    return metrics.newest(_validation(spark, sf)).select("run_id", "step")


@query
def validation_summary(spark, sf):
    return metrics.validation_summary(_validation(spark, sf)).select("run_id", F.round("mean_val_loss", 6).alias("mean_val_loss"), F.round("perplexity", 3).alias("perplexity"))


@query
def optimiser_steps(spark, sf):
    return metrics.optimiser_steps(_training(spark, sf)).select("run_id", "optimiser_step", F.round("mean_loss", 6).alias("mean_loss"), "micro_steps")


@query
def throughput(spark, sf):
    return metrics.throughput(_training(spark, sf)).select("run_id", "step", "tokens_seen", F.round("eta_seconds", 1).alias("eta_seconds"))


@query
def sanitised_log(spark, sf):
    s = metrics.sanitised(table(spark, sf, "step_log"), ["loss", "val_loss", "tok_per_sec"])
    return s.groupBy("run_id").agg(F.count("*").alias("n"), F.count("loss").alias("losses"), F.count("val_loss").alias("val_losses"), F.count("tok_per_sec").alias("rates"))


@query
def lr_schedule(spark, sf):
    return spark.range(0, 80_001, 500).select(F.col("id").alias("step"), F.round(metrics.learning_rate(F.col("id")) * 1e9, 3).alias("lr_e9"))


@query
def humanised_counts(spark, sf):
    n = mixing.source_stats(docs(spark, sf))
    return n.select("source", metrics.humanised(F.col("chars")).alias("chars"))


def _logits(spark, sf):
    return sampling.long_form(table(spark, sf, "embeddings"))


@query
def topk_filter(spark, sf):
    return sampling.top_k(_logits(spark, sf), 10).select("row_id", "token_id")


@query
def topp_filter(spark, sf):
    return sampling.top_p(_logits(spark, sf), 0.5, 0.1).select("row_id", "token_id", F.round("p", 9).alias("p"))


@query
def repetition_penalty(spark, sf):
    v = table(spark, sf, "embeddings")
    history = v.select(F.col("vec_id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: ((F.col("vec_id") * 7 + i * i) % 64).cast("int")).alias("tokens"))
    return sampling.repetition_penalty(_logits(spark, sf), history).select("row_id", "token_id", F.round("logit", 9).alias("logit"))


@query
def log_normaliser(spark, sf):
    return sampling.log_normaliser(_logits(spark, sf)).select("row_id", F.round("logsumexp", 9).alias("logsumexp"))


@query
def draft_residual(spark, sf):
    l = _logits(spark, sf)
    p = sampling.with_probability(l, 0.1).select("row_id", "token_id", "p")
    q = sampling.with_probability(l, 0.2).select("row_id", "token_id", F.col("p").alias("q"))
    r = sampling.residual(p.join(q, ["row_id", "token_id"]))
    accepted = sampling.acceptance(F.col("p"), F.col("q"), F.lit(0.5))
    return r.groupBy("row_id").agg(F.count_if(accepted).alias("accepted"), F.round(F.max("r"), 9).alias("largest"), F.round(F.sum("r"), 6).alias("total"))
