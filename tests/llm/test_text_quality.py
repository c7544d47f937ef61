import numpy as np

from corpusmill.llm import quality

PROSE = [
    "The council met in the old hall and nobody knew what the mayor would say about the bridge. In the end he said that it would be closed.",
    "Ieri la maestra ha raccontato ai bambini la storia del ponte che non era ancora finito. Nessuno le ha creduto.",
    "then we went to the river and the boat was gone and my brother said that it was not his fault because the rope was old",
    "Le guardien du phare n'a pas vu le bateau. « Qui est là ? » demanda-t-il.",
    "昨日、先生は子供たちと湖へ行ったが、橋は閉まっていた。バスは来なかった。",
]
OTHER = [
    "rope, nails, hammer, lamp, paint, glass, wool, honey, soap, boots, tent, clock, ladder, bottle, candle",
    "id,name,price\n1,lamp,20.5\n2,rope,8.9\n3,tent,89.0\n4,soap,2.3\n5,wool,7.1\n6,nails,3.3",
    "Bf7kQ2xV9zLm4RtY8wPc1NdGh6JsKa3TuEiOo5XzWvQbUr0CmSpDyHlFg+/aZeUjI7oPkL2mNqYxWcErVtBy",
    "We sell the best lamps in the town. " * 20,
    "[10:22:01] INFO node=5 rc=0\n[10:22:04] WARN node=9 rc=2\n[10:22:09] ERR node=1 rc=7",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")


def test_statistics_of_known_texts():
    s = dict(zip(quality.STATS, quality.statistics(["One two.\nThree four!\nfive"])[0]))
    assert s["n_words"] == 5 and s["n_chars"] == 25
    assert abs(s["punctuated_lines"] - 2 / 3) < 1e-9 and abs(s["symbol_ratio"] - 2 / 21) < 1e-9


def test_blocks_do_not_leak_into_each_other():
    texts = [*PROSE, "", " \n", *OTHER, "x"]
    together = quality.statistics(texts)
    alone = np.concatenate([quality.statistics([t]) for t in texts])
    assert np.allclose(together, alone)


def test_prose_and_the_rest_are_told_apart(spark):
    texts = [*PROSE * 8, *OTHER * 3, None, "  "]
    stats = quality.text_statistics(frame(spark, texts)).cache()
    out = {r.doc_id: r.text_class for r in quality.classify(stats, quality.fit_mixture(stats)).collect()}
    for i in range(len(PROSE) * 8):
        assert out[i] == "prose", texts[i]
    for i in range(len(PROSE) * 8, len(texts) - 2):
        assert out[i] in ("list", "table", "junk"), texts[i]
    assert out[len(texts) - 2] == out[len(texts) - 1] == "blank"


def test_a_table_of_integers_is_not_blank(spark):
    numbers = ["\n".join(f"{i * 37 % 1000} {i * 91 % 1000} {i}" for i in range(40)), "4711", "1 2 3 4 5 6 7 8 9"]
    stats = quality.text_statistics(frame(spark, [*PROSE * 8, *OTHER * 3, *numbers, "\u3000\u00a0 \n"])).cache()
    out = {r.doc_id: r.text_class for r in quality.not_prose(quality.classify(stats, quality.fit_mixture(stats))).collect()}
    first = len(PROSE) * 8 + len(OTHER) * 3
    assert {first, first + 1, first + 2} <= set(out) and first + 3 not in out


def test_likelihood_rises(spark):
    x = quality._vectors(quality.statistics([*PROSE, *OTHER] * 5))
    seen = []
    stats = quality.text_statistics(frame(spark, [*PROSE, *OTHER] * 5)).cache()
    for n in (1, 4):
        m = quality.fit_mixture(stats, iterations=n, tolerance=0)
        seen.append(quality._responsibility((x - m["center"]) / m["scale"], m)[1].mean())
    assert seen[1] >= seen[0] - 1e-6


def test_empty_table_and_long_text(spark):
    empty = quality.text_statistics(frame(spark, ["x"]).limit(0))
    assert quality.classify(empty, quality.fit_mixture(empty)).count() == 0
    assert quality.statistics(["the bridge was closed. " * 100_000])[0, 0] == 2_300_000


def test_every_pass_is_one_job_whatever_the_partitions(spark):
    stats = quality.text_statistics(frame(spark, [*PROSE, *OTHER] * 5)).repartition(12).cache()
    stats.count()
    tracker = spark.sparkContext.statusTracker()

    def jobs(iterations):
        group = f"passes {iterations}"
        spark.sparkContext.setJobGroup(group, group)
        quality.fit_mixture(stats, iterations=iterations, tolerance=0)
        return len(tracker.getJobIdsForGroup(group))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert jobs(5) - jobs(2) == 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setJobGroup("", "")
