"""Exact, near and positional deduplication, each as set operations on keyed tables.

Null texts have no key: they are never duplicates of anything and stay. Ties in the order column are broken by the
digest. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import nfc, with_ngrams, words
from corpusmill.operators.mixing import ordinals
from corpusmill.plans.lineage import materialize

PRIME = (1 << 31) - 1
PERMUTATIONS = 64
#: Bands and rows for 64 permutations in the bucket query, for text and for code.
BANDS_TEXT, BANDS_CODE = (4, 15), (5, 11)
#: Near duplicates: words of a shingle, the least Jaccard similarity, and bands and rows of the candidates. A pair of
#: similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.
NEAR_WORDS, NEAR_SIMILARITY, NEAR_BANDS = 5, 0.8, (32, 4)
MARKS = ("prefix", "suffix", "middle")
#: Rows of one component that a task scans at once.
SCAN_ROWS = 200_000
#: Fixed value: rows of a source up to which near duplicates are found by similarity.
MOST_NEAR = 500_000
MOST_SOURCES = 100_000


def exact_duplicates(df: DataFrame, digest: str = "digest", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``occurrence``, 1 for the first row of each digest in the given order.

    The first row of a digest comes from a map-side minimum rather than a window, so a digest that a third of all rows
    share is one partial aggregate per task. The digest is what is shuffled, never the text.
    """
    key = F.struct(*order)
    first = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("__first"))
    joined = df.join(first, digest, "left")
    return joined.withColumn("is_first", F.coalesce(key == F.col("__first"), F.lit(True))).drop("__first")


def duplicate_groups(df: DataFrame, digest: str = "digest", id_column: str = "doc_id") -> DataFrame:
    return df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("copies"), F.min(id_column).alias("first_id")).where("copies > 1")


def new_rows(batch: DataFrame, seen: DataFrame, digest: str = "digest", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of a batch whose digest no earlier batch had, once each; rows without a digest all stay."""
    fresh = exact_duplicates(batch, digest, order).where("is_first").drop("is_first")
    return fresh.join(seen.select(digest).where(F.col(digest).isNotNull()).distinct(), digest, "left_anti")


def shingle_hashes(df: DataFrame, text: str, out: str = "shingles") -> DataFrame:
    """Array of distinct 31-bit hashes of the word trigrams of a text; of its words where it has fewer than three."""
    df = df.withColumn("__w", words(F.lower(nfc(F.col(text)))))
    df = with_ngrams(df, "__w", "__g", 3)
    source = F.when(F.size("__w").between(1, 2), F.col("__w")).otherwise(F.col("__g"))
    hashed = F.transform(F.array_distinct(source), lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") % PRIME)
    return df.withColumn(out, F.array_distinct(hashed)).drop("__w", "__g")


def permutation(i: int) -> tuple[int, int]:
    """Multiplier and offset of one permutation, from a fixed linear recurrence."""
    a = (1_103_515_245 * (i + 1) + 12_345) % (PRIME - 1) + 1
    b = (69_069 * (i + 7) + 362_437) % PRIME
    return a, b


def _registers(permutations: int, pairs: np.ndarray | None = None):
    pairs = np.array([permutation(i) for i in range(permutations)], np.int64) if pairs is None else pairs

    @F.pandas_udf("array<bigint>")
    def run(shingles: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in shingles:
            out = []
            for h in s:
                if h is None or not len(h):
                    out.append(np.full(permutations, PRIME, np.int64))
                    continue
                low = np.full(permutations, PRIME, np.int64)
                for at in range(0, len(h), 4096):  # a long text in slices
                    x = np.asarray(h[at : at + 4096], np.int64)
                    low = np.minimum(low, ((x[:, None] * pairs[:, 0] + pairs[:, 1]) % PRIME).min(0))
                out.append(low)
            yield pd.Series(out, dtype=object)

    return run


def signatures(df: DataFrame, text: str, out: str = "signature", permutations: int = PERMUTATIONS) -> DataFrame:
    """Adds the MinHash signature; a text without words has PRIME in every register, so all such texts collide."""
    return shingle_hashes(df, text, "__s").withColumn(out, _registers(permutations)("__s")).drop("__s")


def band_keys(signed: DataFrame, keys: list[str], bands: int, rows: int, signature: str = "signature") -> DataFrame:
    """One row per band: ``keys``, ``band`` and ``bucket``."""
    values = [F.struct(F.lit(i).alias("band"), F.md5(F.concat_ws(",", F.slice(signature, i * rows + 1, rows).cast("array<string>"))).alias("bucket")) for i in range(bands)]
    return signed.select(*keys, F.explode(F.array(*values)).alias("b")).select(*keys, "b.band", "b.bucket")


def greedy_removed(memberships: DataFrame, id_column: str = "doc_id", max_rounds: int = 100) -> DataFrame:
    """Ids removed under the rule: a member goes if and only if an earlier kept one shares a bucket with it.

    Input rows are (bucket, id). No pairs are formed: in each round a bucket's first undecided member is found by a
    partial minimum; who comes first in all of its buckets is kept, and the others of those buckets go. The undecided
    rest is written to the shared folder and shrinks in every round; ties cannot occur, as ids are unique.
    """
    state = materialize(memberships.select("bucket", F.col(id_column).alias("id")).distinct())
    removed = None
    for _ in range(max_rounds):
        lead = state.groupBy("bucket").agg(F.min("id").alias("lead"))
        led = materialize(state.join(lead, "bucket"))
        kept = led.groupBy("id").agg(F.min((F.col("id") == F.col("lead")).cast("int")).alias("first")).where("first = 1").select("id")
        taken = led.where("id = lead").join(kept, "id", "left_semi").select("bucket", "id")
        gone = materialize(led.where("id <> lead").join(taken.select("bucket"), "bucket", "left_semi").select("id").distinct())
        removed = gone if removed is None else removed.unionByName(gone)
        state = materialize(led.select("bucket", "id").join(gone, "id", "left_anti").join(kept, "id", "left_anti"))
        if state.isEmpty():
            return removed.distinct()
    raise RuntimeError("the longest chain of near duplicates exceeds max_rounds")


def shingle_sets(df: DataFrame, text: str, out: str = "shingles", n: int = NEAR_WORDS) -> DataFrame:
    """Array of distinct 64-bit hashes of the runs of n words; a shorter text is one run, a null text has a null array."""
    df = df.withColumn("__w", words(F.lower(nfc(F.col(text)))))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("__w", i, n)))
    return df.withColumn(out, F.when(F.size("__w") > 0, F.array_distinct(runs)).when(F.col("__w").isNotNull(), F.array().cast("array<bigint>"))).drop("__w")


def near_duplicates(df: DataFrame, text: str = "normalised", scope: list[str] | None = None, id_column: str = "doc_id", similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """``doc_id, class_id, removed``: a text goes if an earlier kept one of its scope is at least that similar.

    Similarity is Jaccard's over the sets of five-word shingles. Texts of one set form a class, whose first member stands
    for them, so a text that a third of the rows repeat is one representative. Candidates are the representatives that
    share a band and whose sets are of similar size; each pair is then counted exactly, and the greedy rule runs on what
    holds. Null texts are classes of their own.
    """
    scope = scope or ["source"]
    sets = shingle_sets(df.select(*scope, F.col(id_column).alias("id"), text), text).drop(text)
    sets = materialize(sets.withColumn("key", F.when(F.col("shingles").isNull(), F.concat(F.lit("null "), F.col("id").cast("string"))).otherwise(F.md5(F.concat_ws(",", F.array_sort("shingles").cast("array<string>"))))))
    classes = materialize(sets.groupBy(*scope, "key").agg(F.min("id").alias("class_id")))
    theirs = classes.select(*(F.col(c).alias(f"__{c}") for c in scope), F.col("key").alias("__key"), "class_id")
    same = F.col("key") == F.col("__key")
    for c in scope:  # a null is a scope like any other
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    members = sets.select(*scope, "id", "key").join(theirs, same).select("id", "class_id")
    heads = materialize(sets.where(F.size("shingles") > 0).join(classes.select(F.col("class_id").alias("id")), "id", "left_semi").drop("key"))
    bands, rows = NEAR_BANDS
    pairs = np.random.default_rng(bands * rows).integers(1, PRIME, (bands * rows, 2))
    low = heads.select(*scope, "id", F.size("shingles").alias("n"), _registers(bands * rows, pairs)(F.transform("shingles", lambda x: F.pmod(x, F.lit(PRIME)))).alias("signature"))
    buckets = materialize(low.select("id", "n", F.explode(F.array(*(F.xxhash64(*scope, *(F.col(c).isNull() for c in scope), F.lit(i), F.slice("signature", i * rows + 1, rows)) for i in range(bands)))).alias("bucket")))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    one = materialize(buckets.join(shared, "bucket"))
    other = one.select("bucket", F.col("id").alias("id_b"), F.col("n").alias("n_b"))
    near = (F.col("id") < F.col("id_b")) & (F.least("n", "n_b") >= similarity * F.greatest("n", "n_b") - 1e-9)
    candidates = one.join(other, "bucket").where(near).select("id", "id_b").distinct()
    both = candidates.join(heads.select("id", "shingles"), "id").join(heads.select(F.col("id").alias("id_b"), F.col("shingles").alias("shingles_b")), "id_b")
    common = F.size(F.array_intersect("shingles", "shingles_b"))
    links = both.where(common >= similarity * (F.size("shingles") + F.size("shingles_b") - common) - 1e-9)
    ends = links.select(F.concat_ws(" ", F.col("id").cast("string"), F.col("id_b").cast("string")).alias("bucket"), F.explode(F.array("id", "id_b")).alias("id"))
    gone = greedy_removed(ends, "id").select(F.col("id").alias("class_id"), F.lit(True).alias("gone"))
    return members.join(gone, "class_id", "left").select(F.col("id").alias(id_column), "class_id", (F.coalesce("gone", F.lit(False)) | (F.col("id") != F.col("class_id"))).alias("removed"))


def fingerprints(df: DataFrame, text: str = "normalised", safe_middle: bool = False) -> DataFrame:
    """Adds ``fp_prefix``, ``fp_suffix``, ``fp_middle`` and ``n``.

    As executed, the middle window of a text under 200 characters starts that far from its end; ``safe_middle`` clamps
    it at the beginning instead.
    """
    n = F.length(text)
    mid = F.floor(n / 2)
    start = mid - 100
    if safe_middle:
        first = F.greatest(start, F.lit(0))
    else:
        first = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(start)
    middle = F.substring(F.col(text), (first + 1).cast("int"), F.greatest(mid + 100 - first, F.lit(0)).cast("int"))
    return (
        df.withColumn("n", n.cast("bigint"))
        .withColumn("fp_prefix", F.sha2(F.substring(text, 1, 200), 256))
        .withColumn("fp_suffix", F.sha2(F.right(F.col(text), F.lit(200)), 256))
        .withColumn("fp_middle", F.sha2(middle, 256))
    )


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` from rows (id, fp): label propagation until no label changes; the label is the component's first id.

    Every round also takes over the label of the label, which shortens long chains.
    """
    label = materialize(edges.select("id").distinct().withColumn("label", F.col("id")))
    while True:
        low = edges.join(label, "id").groupBy("fp").agg(F.min("label").alias("low"))
        near = materialize(edges.join(low, "fp").groupBy("id").agg(F.min("low").alias("label")))
        after = materialize(near.join(near.select(F.col("id").alias("label"), F.col("label").alias("further")), "label").select("id", F.least("label", "further").alias("label")))
        settled = after.join(label.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty()
        label = after
        if settled:
            return label


def fingerprint_dedup(df: DataFrame, text: str = "normalised", id_column: str = "doc_id", tolerance: float = 0.15, scope: list[str] | None = None, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """``doc_id, removed``: a document goes if a fingerprint was last kept by a document of nearly the same length.

    Fingerprints count within ``scope``, by default in all rows. The rule is a scan in the order of ids, and what a
    document finds depends on the documents kept before it, so it is followed inside connected components of shared
    fingerprints. A text that repeats its predecessor in the component goes without being scanned: that one was kept, or
    went and changed nothing. The rest of a component is scanned in stretches of at most ``scan_rows`` rows, all
    components side by side; from stretch to stretch the last kept lengths are a table. No task holds more than a stretch
    of a component. Null and empty texts stay.
    """
    here = F.coalesce(F.to_json(F.struct(*scope)), F.lit("")) if scope else F.lit("")
    keyed = df.where(F.length(text) > 0).select(F.col(id_column).alias("id"), here.alias("__scope"), F.col(text).alias("__t"))
    marks = {k: F.concat(F.lit(k[0]), F.col(f"fp_{k}"), F.col("__scope")) for k in MARKS}
    prints = materialize(fingerprints(keyed, "__t").select("id", "n", F.md5("__t").alias("digest"), *(c.alias(k) for k, c in marks.items())))
    long = prints.select("id", F.explode(F.array(*MARKS)).alias("fp"))
    shared = long.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    edges = materialize(long.join(shared, "fp"))
    ranked = ordinals(prints.join(components(edges), "id"), ["label"], "id", "rank")
    before = ranked.select("label", (F.col("rank") + 1).alias("rank"), F.col("digest").alias("before"))
    placed = materialize(ranked.join(before, ["label", "rank"], "left").withColumn("repeats", F.coalesce(F.col("digest") == F.col("before"), F.lit(False))).drop("rank", "before"))
    rows = ordinals(placed.where("not repeats").drop("digest", "repeats"), ["label"], "id", "rank")
    rows = materialize(rows.withColumn("stretch", F.floor((F.col("rank") - 1) / scan_rows)).drop("rank"))
    kind = prints.schema["id"].dataType.simpleString()

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        last: tuple[dict, dict, dict] = ({}, {}, {})
        out = []
        for row in pdf.itertuples(index=False):
            for mark, known, d in zip((row.prefix, row.suffix, row.middle), (row.last_prefix, row.last_suffix, row.last_middle), last):
                if mark not in d and known == known and known is not None:
                    d[mark] = known
            found = (row.prefix, row.suffix, row.middle)
            near = any(m in d and abs(row.n - d[m]) / max(row.n, d[m], 1) < tolerance for m, d in zip(found, last))
            out.append(near)
            if not near:
                for m, d in zip(found, last):
                    d[m] = row.n
        return pd.DataFrame({"id": pdf["id"].values, "gone": out})

    gone, state = placed.where("repeats").select("id"), None
    for stretch in range(int(rows.agg(F.max("stretch")).first()[0] or 0) + 1):
        part = rows.where(F.col("stretch") == stretch).drop("stretch")
        for k in MARKS:
            part = part.withColumn(f"last_{k}", F.lit(None).cast("double")) if state is None else part.join(state.select(F.col("fp").alias(k), F.col("last").cast("double").alias(f"last_{k}")), k, "left")
        scanned = materialize(part.groupBy("label").applyInPandas(scan, f"id {kind}, gone boolean"))
        gone = gone.unionByName(scanned.where("gone").select("id"))
        kept = rows.where(F.col("stretch") == stretch).join(scanned.where("not gone"), "id").select("id", "n", F.explode(F.array(*MARKS)).alias("fp"))
        new = kept.groupBy("fp").agg(F.max_by("n", "id").alias("last"))
        state = materialize(new if state is None else new.unionByName(state.join(new, "fp", "left_anti")))
    return df.select(id_column).join(gone.select(F.col("id").alias(id_column), F.lit(True).alias("__r")), id_column, "left").select(id_column, F.coalesce("__r", F.lit(False)).alias("removed"))


def routed_dedup(df: DataFrame, text: str = "normalised", source: str = "source", id_column: str = "doc_id", most: int = MOST_NEAR) -> DataFrame:
    """``doc_id, rule, removed``: sources of at most ``most`` rows by similarity, larger ones by fingerprints, each on its own."""
    sizes = df.groupBy(source).agg((F.count("*") > most).alias("__large"))
    sizes = sizes.withColumnRenamed(source, "__s")
    routed = df.join(F.broadcast(sizes) if sizes.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else sizes, F.col(source).eqNullSafe(F.col("__s"))).drop("__s")
    near = near_duplicates(routed.where("not __large"), text, [source], id_column)
    marked = fingerprint_dedup(routed.where("__large"), text, id_column, scope=[source])
    return near.select(id_column, F.lit("similarity").alias("rule"), "removed").unionByName(marked.select(id_column, F.lit("fingerprint").alias("rule"), "removed"))


def iterate_batches(frames: Iterator[DataFrame], digest: str = "digest") -> Iterator[DataFrame]:
    """New rows of each batch in turn; what was seen is written to the shared folder after each."""
    seen = None
    for frame in frames:
        fresh = materialize(new_rows(frame, seen, digest) if seen is not None else exact_duplicates(frame, digest).where("is_first").drop("is_first"))
        seen = fresh.select(digest) if seen is None else seen.unionByName(fresh.select(digest))
        yield fresh
