"""Sources and sinks: JSON lines in several readings, Parquet, token files, and the registry of corpus sources."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import NOT_W, contains_any, md5_mod
from corpusmill.operators.mixing import ordinals

ITALIAN_SCORE = 0.7
TOP_ROWS = 100_000
#: Marks of generated headers, and of Italian.
HEADER_MARKERS = ["auto-generated", "generated by", "do not edit", "automatically generated"]
HEADER_MARKERS_SHORT = HEADER_MARKERS[:3]
ITALIAN_MARKERS = [
    " della ", " delle ", " dello ", " degli ", " nella ", " nelle ", " nello ", " negli ", " questo ", " questa ", " questi ", " queste ", " sono ", " siamo ", " essere ", " avere ",
    " possono ", " deve ", " stato ",
]
CPP_NAMES = ["c++", "cpp", "cplusplus"]


def json_lines(spark: SparkSession, path: str, recursive: bool = True, glob: str = "*.jsonl") -> DataFrame:
    """``text, _corrupt_record, file``: blank lines skipped, malformed lines kept for the reason ``parse_error``.

    Undecodable bytes become replacement signs; splitting by size is Spark's. A record that is no object, or whose text
    is null, has a null text.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file")).where(F.col("value").rlike(NOT_W))
    parsed = lines.withColumn("r", F.from_json("value", "text STRING, _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("r.text", "r._corrupt_record", "file")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").rlike(NOT_W))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts that are not blank of well-formed lines."""
    return json_lines(spark, path).where("_corrupt_record is null").where(F.col("text").rlike(NOT_W)).select("text", "file")


def discovered(spark: SparkSession, filtered: str, raw: str) -> DataFrame:
    """Filtered files where there are any, else the raw ones."""
    found = json_lines(spark, filtered, False, "*_filtered.jsonl")
    return found if found.inputFiles() else json_lines(spark, raw)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def write_json_lines(df: DataFrame, path: str, text: str = "normalised") -> None:
    """Only the text survives; committed as a whole by Spark's committer."""
    df.select(F.col(text).alias("text")).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Training and validation records of one log, in one nullable schema."""
    return spark.read.schema("step BIGINT, loss DOUBLE, lr DOUBLE, tok_per_sec DOUBLE, timestamp DOUBLE, ema_loss DOUBLE, val_loss DOUBLE, val_ppl DOUBLE").json(path)


def complete(spark: SparkSession, path: str, expected: int) -> bool:
    """Whether a delivered file may be skipped: at least 80 % of the expected lines, and its last line is whole."""
    lines = spark.read.text(path).where(F.col("value").rlike(NOT_W)).select("value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    row = lines.agg(F.count("*").alias("n"), F.max_by("value", F.struct("start", "at")).alias("last")).first()
    try:
        return row.n >= 0.8 * expected and row.last is not None and json.loads(row.last) is not None
    except ValueError:
        return False


def first_present(*names: str) -> Column:
    return F.coalesce(*(F.when(F.length(n) > 0, F.col(n)) for n in names), F.lit(""))


def generated_header(text: Column, markers: list[str] | None = None) -> Column:
    """Whether the first line holds a mark of generated code."""
    return contains_any(F.lower(F.substring_index(text, "\n", 1)), markers or HEADER_MARKERS)


def likely_italian(text: Column) -> Column:
    """Any of the marker words among the first 500 characters."""
    return F.coalesce(contains_any(F.lower(F.substring(text, 1, 500)), ITALIAN_MARKERS), F.lit(False))


def web_rows_accepted(rows: DataFrame) -> DataFrame:
    """Web rows with a score of at least 0.7 (a missing one counts as 1) and more than 100 characters."""
    return rows.where((F.coalesce("score", F.lit(1.0)) >= ITALIAN_SCORE) & (F.length("text") > 100))


def code_rows_accepted(rows: DataFrame, language: str, min_length: int = 50) -> DataFrame:
    """``row_id, text``: code of one language from whichever column holds it, without generated headers."""
    lang = F.lower(F.coalesce("language", "lang", F.lit("")))
    wanted = {"c": ["c"], "cpp": CPP_NAMES}.get(language, [language])
    body = rows.where(lang.isin(*wanted)).withColumn("body", first_present("content", "code", "func_code_string", "text"))
    return body.where((F.length("body") > min_length) & ~generated_header(F.col("body"))).select("row_id", F.lit(language).alias("language"), F.col("body").alias("text"))


def first_rows(df: DataFrame, limit: int, order: str) -> DataFrame:
    """The first rows by a column; above TOP_ROWS by ranges of it instead of one task's heap."""
    if limit <= TOP_ROWS:
        return df.orderBy(order).limit(limit)
    ranked = ordinals(df.withColumn("__all", F.lit(1)), ["__all"], order, "__rank")
    return ranked.where(F.col("__rank") <= limit).drop("__rank", "__all")


def prioritised(parts: list[DataFrame], limit: int, order: str = "row_id") -> DataFrame:
    """Rows of the first source, then of the next, until the limit: adds ``priority``.

    The limit is split over the sources by their counts, so each source is cut on its own and nothing is ranked globally.
    """
    out, left = None, limit
    for i, part in enumerate(parts):
        if left <= 0:
            break
        n = part.count()
        taken = part if n <= left else first_rows(part, left, order)
        taken = taken.withColumn("priority", F.lit(i))
        out = taken if out is None else out.unionByName(taken)
        left -= min(n, left)
    return out if out is not None else parts[0].withColumn("priority", F.lit(0)).limit(0)


def per_language(rows: DataFrame, languages: list[str], limit: int | None = None) -> DataFrame:
    """An equal quota of the limit for each language; without a limit all of them."""
    out = None
    for x in languages:
        part = code_rows_accepted(rows, x)
        part = part if limit is None else first_rows(part, limit // len(languages), "row_id")
        out = part if out is None else out.unionByName(part)
    return out


def tier_limits(targets: DataFrame, tier: str, sources: list[str] | None = None) -> DataFrame:
    chosen = targets.where(F.col("tier") == tier)
    return chosen.where(F.col("source").isin(sources)) if sources else chosen


def delivery_summary(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """``source, docs, target, status``: EMPTY, LOW(x%) under half the target, else OK."""
    counted = documents.groupBy("source").agg(F.count("*").alias("docs"))
    df = limits.select("source", "target").join(counted, "source", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    status = F.when(F.col("docs") == 0, "EMPTY").when(F.col("docs") < F.col("target") * 0.5, F.concat(F.lit("LOW("), F.round(F.col("docs") * 100 / F.col("target")).cast("bigint").cast("string"), F.lit("%)"))).otherwise("OK")
    return df.withColumn("status", status)


def registry(spark: SparkSession, sf: str) -> dict[str, Callable[[], DataFrame]]:
    """Factories of the nine corpus sources over the delivered tables; each frame is lazy, Spark schedules them."""

    def web(source: str, predicate: Callable[[DataFrame], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: predicate(spark.read.parquet(f"{sf}/web_rows.parquet").where(F.col("source") == source)).select("row_id", "text")

    def code(language: str) -> Callable[[], DataFrame]:
        return lambda: code_rows_accepted(spark.read.parquet(f"{sf}/code_rows.parquet"), language).select("row_id", "text")

    filled = lambda d: d.where(F.length("text") > 0)
    out = {"italian_oscar": web("italian_oscar", web_rows_accepted), "italian_fineweb": web("italian_fineweb", lambda d: d.where(F.length("text") > 100))}
    out |= {s: web(s, filled) for s in ("italian_wiki", "english_web", "english_wiki", "english_edu")}
    out |= {"c_code": code("c"), "cpp_code": code("cpp")}
    out["other_code"] = lambda: per_language(spark.read.parquet(f"{sf}/code_rows.parquet"), ["python", "javascript", "rust"]).select("row_id", "text")
    return out


def reservoir(df: DataFrame, size: int, text: str = "text", seed: int = 42) -> DataFrame:
    """A uniform sample of fixed size, the same under any partitioning: the rows with the smallest keyed hashes."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(text))), text).limit(size)


def bernoulli(df: DataFrame, size: int, total: int, code: Column | None = None, boost: float = 1.5, seed: int = 7) -> DataFrame:
    """Rows by hash at rate size/total, raised for code; of those at most 1.2 times the size, by a second hash."""
    rate = F.lit(min(1.0, size / max(total, 1)))
    if code is not None:
        rate = F.when(code, F.least(F.lit(1.0), rate * boost)).otherwise(rate)
    drawn = df.where(md5_mod(F.concat(F.lit(f"{seed}/"), F.col("text")), 1_000_000) / 1_000_000 < rate)
    return reservoir(drawn, int(size * 1.2))
