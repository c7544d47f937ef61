import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import metrics, mixing, packing, sampling


def test_split_sizes(spark):
    for n in (0, 1, 100, 101):
        df = spark.range(n).select((F.col("id") * 3).alias("doc_id"))
        out = mixing.split(df)
        assert out.where("split = 'val'").count() == math.ceil(n / 100)
        assert sorted(r.position for r in out.collect()) == list(range(n))


def test_ordinals_over_many_ranges(spark, monkeypatch):
    import corpusmill.functions.ranges as ranges

    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 50)
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("doc_id"), (F.col("id") % 3).alias("k"))
    for r in mixing.ordinals(df, ["k"], "doc_id").groupBy("k").agg(F.collect_list(F.struct("doc_id", "ordinal")).alias("x")).collect():
        assert [o for _, o in sorted(r.x)] == list(range(1, len(r.x) + 1))


def test_categories(spark):
    rows = ["data/italian_web", "raw/C_CODE/x", "cpp_code", "the-stack/python", "english_edu", "python/a", "nothing", None]
    df = spark.createDataFrame([(r,) for r in rows], "p string").select("p", mixing.category(F.col("p")).alias("c"))
    assert [r.c for r in df.collect()] == ["italian", "c_code", "cpp_code", "c_code", "english", "other_code", None, None]


def test_a_source_without_category_is_an_error_unless_allowed(spark):
    df = spark.createDataFrame([("english_web",), ("odd",)], "source string")
    with pytest.raises(ValueError, match="odd"):
        mixing.require_categories(df)
    assert [r.category for r in mixing.require_categories(df, allow_unknown=True).collect()] == ["english"]


def test_the_shuffle_is_the_order_of_its_keys(spark):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    rows = [(i, i % 16) for i in range(300)]
    out = [(r.doc_id, r.shard) for r in mixing.shuffled(spark.createDataFrame(rows, "doc_id bigint, shard int").repartition(7)).collect()]
    assert out == sorted(rows, key=lambda r: (md5(f"42/{r[1]}"), md5(f"42/{r[0]}"), r[0])) != rows


def test_packing_conserves_tokens(spark):
    for sizes in ([1022], [1023], [1023, 1024], [5, 3000, 7, 1500], [], [0, 0]):
        df = spark.createDataFrame([("train", i, [4 + i] * n) for i, n in enumerate(sizes)], "split string, doc_id bigint, ids array<int>")
        framed = df.withColumn("ids", packing.framed(F.col("ids")))
        flat = [t for i, n in enumerate(sizes) for t in [1, *[4 + i] * n, 2]]
        out = {r.seq_id: r.tokens for r in packing.pack(framed).collect()}
        assert len(out) == len(flat) // 1025
        assert [t for k in sorted(out) for t in out[k]] == flat[: len(out) * 1025]


def test_masks(spark):
    df = spark.createDataFrame([([1, 9, 2, 1, 8],), ([7],), ([],)], "t array<int>")
    m = packing.boundary_mask(F.col("t"))
    out = df.select(m.alias("m"), packing.distance_mask(m, 2).alias("d")).collect()
    assert out[0].m == [False, True, False, False] and out[0].d == [False, False, False]
    assert out[1].m == [] and out[1].d is None and out[2].m == []


def test_binary_round_trip(spark, tmp_path):
    a = np.arange(1025 * 3 + 10, dtype="<u2")
    (tmp_path / "x.bin").write_bytes(a.tobytes())
    rows = packing.read_binary(spark, str(tmp_path / "x.bin")).orderBy("seq_id").collect()
    assert [t for r in rows for t in r.tokens] == a[: 1025 * 3].astype(int).tolist()


def test_what_is_written_is_read_back(spark, tmp_path):
    folder = str(tmp_path / "train")
    rows = [(i, [(i * 31 + j) % 65_536 for j in range(16)]) for i in range(50)]
    df = spark.createDataFrame(rows, "seq_id bigint, tokens array<int>").repartition(5)
    assert packing.write_binary(df, folder, sequences_per_file=20) == 3
    assert sum(f.stat().st_size for f in (tmp_path / "train").glob("part-*.bin")) == 50 * 16 * 2
    flat = np.concatenate([np.fromfile(f, "<u2") for f in sorted((tmp_path / "train").glob("part-*.bin"))])
    assert flat.tolist() == [t for _, ts in rows for t in ts]
    back = packing.read_binary(spark, folder, 16, sequences_per_task=7)
    assert sorted((r.seq_id, list(r.tokens)) for r in back.collect()) == rows
    assert packing.read_binary(spark, str(tmp_path / "train" / "part-00000.bin"), 16).count() > 0
    with pytest.raises(Exception, match="16 bits"):
        packing.write_binary(spark.createDataFrame([(1, [65_536])], "seq_id bigint, tokens array<int>"), str(tmp_path / "wide"))


def test_bytes(spark):
    texts = ["", "a\nb", "però 😀 \x00\x7f", "日本"]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", packing.byte_tokens(F.col("t")).alias("ids")).collect()
    assert {r.i: r.ids for r in out} == {i: [b + 4 for b in t.encode()] for i, t in enumerate(texts)}


def test_epochs_and_micro_batches(spark):
    e = packing.epochs(spark.range(20).withColumnRenamed("id", "seq_id"), 2).collect()
    first, second = ([r.seq_id for r in e if r.epoch == k] for k in (0, 1))
    assert sorted(first) == sorted(second) == list(range(20)) and first != second and [r.epoch for r in e] == [0] * 20 + [1] * 20
    b = packing.micro_batches(spark.range(10).withColumnRenamed("id", "position"), size=4).collect()
    assert sorted((r.position, r.batch) for r in b) == [(i, i // 4) for i in range(8)]


def test_a_missing_token_or_a_wide_vocabulary_is_refused(tmp_path):
    import json

    def write(vocab):
        p = tmp_path / "t.json"
        p.write_text(json.dumps({"model": {"vocab": vocab}, "added_tokens": [{"content": "<bos>", "id": 1}]}))
        return str(p)

    assert packing._tokenizer_file(write({"a": 2}), ("<bos>",))
    for vocab, needed in (({"a": 2}, ("<eos>",)), ({"a": 70_000}, ())):
        with pytest.raises(ValueError):
            packing._tokenizer_file(write(vocab), needed)


def test_many_ranges_are_searched(spark, monkeypatch):
    import corpusmill.functions.ranges as ranges

    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 20)
    monkeypatch.setattr(ranges, "MOST_COMPARED", 8)
    df = spark.range(3000).select((F.col("id") * 7 % 3000).alias("doc_id"), F.lit(1).alias("k"))
    assert len(ranges.edges_of(df, "doc_id")) > 8
    out = mixing.ordinals(df, ["k"], "doc_id").collect()
    assert all(r.ordinal == r.doc_id + 1 for r in out)


def test_smoothing_against_a_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int(s), float(v)) for k in ("a", "b") for s, v in zip(rng.choice(20_000, 500, replace=False), rng.normal(size=500))] + [("a", 20_001, float("nan")), ("c", 1, None), ("a", 20_002, float("inf"))]
    df = spark.createDataFrame(rows, "run_id string, step bigint, loss double")
    out = {(r.run_id, r.step): r.ema for r in metrics.smoothed(df).collect()}
    for k in ("a", "b"):
        e = None
        for s, v in sorted((s, v) for r, s, v in rows if r == k and v is not None and math.isfinite(v)):
            e = v if e is None else 0.05 * v + 0.95 * e
            assert abs(out[k, s] - e) < 1e-9
    assert not any(k == "c" for k, _ in out)


def test_capped_history(spark):
    for n, size in ((2000, 2000), (2001, 1500), (2502, 1500), (2501, 2000)):
        df = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("step"), F.lit(1.0).alias("loss"))
        out = metrics.capped_history(df)
        assert out.count() == size and out.agg(F.max("step")).first()[0] == n - 1


def test_best_and_schedule(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([3.0, 2.0, 2.0, float("nan"), 1.0])], "run_id string, step bigint, val_loss double")
    assert [r.improved for r in metrics.running_best(df).orderBy("step").collect()] == [True, True, False, True]
    lr = lambda s: spark.range(s, s + 1).select(metrics.learning_rate(F.col("id"))).first()[0]
    assert abs(lr(0) - 3e-4 / 3000) < 1e-12 and lr(3000) == lr(56_999) == 3e-4 and abs(lr(80_000) - 1e-5) < 1e-12


def test_best_over_many_pieces(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(s), float(v)) for k in ("a", None) for s, v in zip(rng.choice(60_000, 300, replace=False), rng.normal(size=300))]
    out = {(r.run_id, r.step): (r.best, r.improved) for r in metrics.running_best(spark.createDataFrame(rows, "run_id string, step bigint, val_loss double")).collect()}
    for k in ("a", None):
        low = math.inf
        for s, v in sorted((s, v) for r, s, v in rows if r == k):
            assert out[k, s] == (min(low, v), v < low)
            low = min(low, v)


def test_log_keeps_the_last_delivery(spark):
    rows = [(1, "r", 5, 1.0, None, "2024-01-01"), (2, "r", 5, 2.0, None, "2024-01-02"), (3, "r", 5, 9.0, None, None), (4, "r", 5, None, 0.5, "2024-01-01"), (5, "r", 5, 3.0, None, "2024-01-02")]
    df = spark.createDataFrame(rows, "log_id bigint, run_id string, step bigint, loss double, val_loss double, d string").selectExpr("log_id", "run_id", "step", "loss", "val_loss", "cast(d as timestamp_ntz) logged_at")
    assert [r.loss for r in metrics.deduplicated(df).collect()] == [3.0]
    assert [r.val_loss for r in metrics.deduplicated(df, validation=True).collect()] == [0.5]


def test_checkpoints(spark):
    df = spark.createDataFrame([("c/ckpt_5.pt",), ("c/ckpt_12.pt",), ("c/final.pt",)], "path string")
    assert metrics.chosen_checkpoint(df).first().path == "c/final.pt"
    assert metrics.chosen_checkpoint(df, "c/ckpt_5.pt").first().path == "c/ckpt_5.pt"
    assert metrics.chosen_checkpoint(df.where("path not like '%final%'")).first().path == "c/ckpt_12.pt"


def logits(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "row_id bigint, token_id int, logit double")


def test_filters(spark):
    assert sorted(r.token_id for r in sampling.top_k(logits(spark, [5.0, 4.0, 4.0, 3.0]), 2).collect()) == [0, 1, 2]
    p = logits(spark, [math.log(x) for x in (0.5, 0.3, 0.2)])
    assert sorted(r.token_id for r in sampling.top_p(p, 0.5000001).collect()) == [0, 1]
    assert sorted(r.token_id for r in sampling.top_p(p, 0.49).collect()) == [0]
    history = spark.createDataFrame([(1, [9] * 70 + [0, 1])], "row_id bigint, tokens array<int>")
    out = {r.token_id: r.logit for r in sampling.repetition_penalty(logits(spark, [2.0, -2.0, 2.0]), history).collect()}
    assert abs(out[0] - 2 / 1.2) < 1e-12 and abs(out[1] + 2.4) < 1e-12 and out[2] == 2.0
