import json

from corpusmill.sources import readers
from corpusmill.streaming import incremental


def test_json_lines(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    lines = [json.dumps({"text": "one"}), "", "   ", "{broken", json.dumps({"text": None}), json.dumps({"other": 1}), json.dumps({"text": "  "})]
    (tmp_path / "a" / "x.jsonl").write_text("\n".join(lines))
    (tmp_path / "a" / "b" / "y.jsonl").write_text(json.dumps({"text": "two"}))
    (tmp_path / "a" / "z.txt").write_text("no")
    df = readers.json_lines(spark, str(tmp_path / "a"))
    assert df.where("_corrupt_record is not null").count() >= 1
    assert sorted(r.text for r in readers.texts(spark, str(tmp_path / "a")).collect()) == ["one", "two"]
    out = str(tmp_path / "out")
    readers.write_json_lines(df.where("text = 'one'"), out, "text")
    assert [json.loads(r.value) for r in spark.read.text(out).collect()] == [{"text": "one"}]


def test_a_delivered_file_is_skipped_if_its_last_line_is_whole(spark, tmp_path):
    for lines, expected, whole in ((['{"text": "a"}', "{broken", '{"text": "b"}'], 3, True), (['{"text": "a"}', '{"te'], 2, False), (['{"text": "a"}'], 2, False), ([], 0, False)):
        (tmp_path / "x.jsonl").write_text("\n".join(lines))
        assert readers.complete(spark, str(tmp_path / "x.jsonl"), expected) is whole


def test_plain_lines_and_discovery(spark, tmp_path):
    raw, filtered = tmp_path / "raw", tmp_path / "filtered"
    raw.mkdir(), filtered.mkdir()
    (raw / "a.jsonl").write_text('{"text": "raw"}\n\n')
    assert readers.line_count(spark, str(raw)) == 2 and readers.text_lines(spark, str(raw)).count() == 1
    assert [r.text for r in readers.discovered(spark, str(filtered), str(raw)).collect()] == ["raw"]
    (filtered / "a_filtered.jsonl").write_text('{"text": "kept"}')
    assert [r.text for r in readers.discovered(spark, str(filtered), str(raw)).collect()] == ["kept"]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id", "concat('t', id) as text")
    for draw in (lambda d: readers.reservoir(d, 40), lambda d: readers.bernoulli(d, 60, 500)):
        assert {r.id for r in draw(df.repartition(3)).collect()} == {r.id for r in draw(df.repartition(11)).collect()} != set()


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    readers.append_log(spark.createDataFrame([(1, 0.5)], "step bigint, loss double"), path)
    readers.append_log(spark.createDataFrame([(1, 0.7)], "step bigint, val_loss double"), path)
    assert sorted((r.loss, r.val_loss) for r in readers.read_log(spark, path).collect() if r.loss) == [(0.5, None)]


def test_priority_and_quota(spark):
    a = spark.createDataFrame([(5,), (1,)], "row_id bigint")
    b = spark.createDataFrame([(9,), (3,), (4,)], "row_id bigint")
    assert sorted((r.priority, r.row_id) for r in readers.prioritised([a, b], 4).collect()) == [(0, 1), (0, 5), (1, 3), (1, 4)]
    assert readers.prioritised([a, b], 0).count() == 0
    assert readers.prioritised([a.limit(0), b], 99).count() == 3


def test_code_rows(spark):
    body = "int f(void) { return 1; }" + " " * 40
    rows = [(1, body, None, None, None, "C", None), (2, "", body, None, None, None, "c"), (3, "// Auto-Generated by x\n" + body, None, None, None, "c", None), (4, body, None, None, None, "C++", None), (5, None, None, None, None, "c", None), (6, body, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_id bigint, content string, code string, text string, func_code_string string, language string, lang string")
    assert sorted(r.row_id for r in readers.code_rows_accepted(df, "c").collect()) == [1, 2]
    assert [r.row_id for r in readers.code_rows_accepted(df, "cpp").collect()] == [4]


def test_summary(spark):
    d = spark.createDataFrame([("a",)] * 6 + [("b",)] * 4, "source string")
    t = spark.createDataFrame([("s", "a", 10), ("s", "b", 10), ("s", "c", 10)], "tier string, source string, target bigint")
    assert {r.source: r.status for r in readers.delivery_summary(d, readers.tier_limits(t, "s")).collect()} == {"a": "OK", "b": "LOW(40%)", "c": "EMPTY"}


def test_incremental_stream_is_restartable(spark, tmp_path):
    source, store, marks = (str(tmp_path / x) for x in ("in", "store", "marks"))
    schema = "doc_id bigint, text string"
    for rows in ([(1, "a"), (2, "a"), (3, "é")], [(4, "é"), (5, "b"), (6, None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.incremental_dedup(stream, store, marks).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(f"{store}/kept").collect()) == [1, 3, 5, 6]


def test_windows(spark):
    df = spark.createDataFrame([("r", "2024-01-01 00:01:00", 1.0, 2.0), ("r", "2024-01-01 00:02:00", float("nan"), 4.0)], "run_id string, t string, loss double, tok_per_sec double").selectExpr("run_id", "cast(t as timestamp) logged_at", "loss", "tok_per_sec")
    r = incremental.windowed_metrics(df).first()
    assert (r.mean_loss, r.mean_rate, r.records) == (1.0, 3.0, 2)
