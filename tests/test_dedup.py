import random

from pyspark.sql import functions as F

from corpusmill.operators import decontaminate, dedup


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, is_code boolean, normalised string")


def test_first_occurrence(spark):
    df = spark.createDataFrame([(3, "a", 0), (1, "a", 0), (2, None, 0), (5, None, 0), (4, "b", 0)], "doc_id bigint, digest string, first int")
    out = {r.doc_id: r.is_first for r in dedup.exact_duplicates(df).collect()}
    assert out == {1: True, 3: False, 2: True, 5: True, 4: True}
    assert dedup.exact_duplicates(df.limit(0)).count() == 0


def test_chain_keeps_its_ends(spark):
    m = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3)], "bucket string, doc_id bigint")
    assert [r.id for r in dedup.greedy_removed(m).collect()] == [2]


def test_greedy_against_a_sequential_scan(spark):
    r = random.Random(1)
    for _ in range(3):
        rows = [(f"b{r.randint(0, 60)}", i) for i in range(150) for _ in range(r.randint(1, 3))]
        buckets = {}
        for b, i in rows:
            buckets.setdefault(i, set()).add(b)
        seen, gone = set(), set()
        for i in sorted(buckets):
            if buckets[i] & seen:
                gone.add(i)
            else:
                seen |= buckets[i]
        m = spark.createDataFrame(rows, "bucket string, doc_id bigint")
        assert {x.id for x in dedup.greedy_removed(m).collect()} == gone


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(200)]
    near = base[:199] + ["other"]
    far = [f"v{i}" for i in range(200)]
    rows = [(1, "s", False, " ".join(base)), (2, "s", False, " ".join(base)), (3, "s", False, " ".join(near)), (4, "s", False, " ".join(far)), (5, "t", False, " ".join(base)), (6, "s", False, "")]
    out = {r.doc_id: r.removed for r in dedup.near_duplicates(docs(spark, rows)).collect()}
    assert out[1] is False and out[2] is True and out[4] is False and out[5] is False and out[6] is False
    assert dedup.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def shingled(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_near_copies_around_the_threshold_against_brute_force(spark):
    r = random.Random(6)
    rows = [(0, "s", False, " ".join(f"w{i}" for i in range(200))), (1, "s", True, " ".join([f"w{i}" for i in range(199)] + ["other"]))]
    for k in range(60):
        base = [f"k{k}w{i}" for i in range(100)]
        copy = base[: r.randint(82, 95)] + [f"k{k}x{i}" for i in range(r.randint(0, 8))]
        rows += [(10 * k + 10, "s", bool(k % 2), " ".join(base)), (10 * k + 11, "s", bool(k % 2), " ".join(copy))]
    kept, gone = [], set()
    for i, _, _, text in rows:
        a = shingled(text)
        if any(len(a & b) >= 0.8 * len(a | b) for b in kept):
            gone.add(i)
        else:
            kept.append(a)
    assert 1 in gone and 15 < len(gone) < 55
    assert {x.doc_id for x in dedup.near_duplicates(docs(spark, rows)).where("removed").collect()} == gone


def test_a_null_scope_loses_no_row(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None, False, base), (2, None, False, base), (3, None, False, base + " more"), (4, "", False, base), (5, None, None, None), (6, None, None, None)]
    out = {r.doc_id: r.removed for r in dedup.near_duplicates(docs(spark, rows)).collect()}
    assert out == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_signature_estimates_similarity(spark):
    a, b = [f"w{i}" for i in range(300)], [f"w{i}" for i in range(30, 330)]
    s = {r.doc_id: r.signature for r in dedup.signatures(docs(spark, [(1, "s", False, " ".join(a)), (2, "s", False, " ".join(b))]), "normalised").collect()}
    grams = lambda w: set(zip(w, w[1:], w[2:]))
    truth = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert abs(sum(x == y for x, y in zip(s[1], s[2])) / 64 - truth) < 0.2


def sequential(rows, tolerance=0.15):
    last, gone = ({}, {}, {}), set()
    for i, t in sorted(rows):
        if not t:
            continue
        m = len(t) // 2
        marks = (t[:200], t[-200:], t[m - 100 : m + 100])
        if any(k in d and abs(len(t) - d[k]) / max(len(t), d[k], 1) < tolerance for k, d in zip(marks, last)):
            gone.add(i)
        else:
            for k, d in zip(marks, last):
                d[k] = len(t)
    return gone


def test_fingerprints_against_a_sequential_scan(spark):
    r = random.Random(3)
    heads = ["".join(r.choice("abcdef ") for _ in range(260)) for _ in range(6)]
    texts = [r.choice(heads) + "".join(r.choice("xyz") for _ in range(r.randint(0, 90))) + r.choice(heads) for _ in range(80)] + [None, "", heads[0][:120], heads[0][:120], heads[1][:199], heads[2][:150]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, normalised string")
    assert {x.doc_id for x in dedup.fingerprint_dedup(df).where("removed").collect()} == sequential(list(enumerate(texts)))


def test_a_chain_longer_than_sixty_links_is_one_component(spark):
    """Neighbours share their beginning or their end in turn. Cut after sixty links, the far end is scanned apart."""
    r = random.Random(8)
    part = ["".join(r.choice("abcdef") for _ in range(200)) for _ in range(200)]
    rows = [(i, part[(i + 1) // 2] + "".join(r.choice("xyz") for _ in range(300)) + part[100 + i // 2]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, normalised string")
    assert {x.doc_id for x in dedup.fingerprint_dedup(df).where("removed").collect()} == sequential(rows) == set(range(1, 150, 2))


def scanned(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, normalised string")
    return {x.doc_id for x in dedup.fingerprint_dedup(df, **options).where("removed").collect()}


def test_a_copy_of_a_kept_text_stays_once_its_fingerprints_are_overwritten(spark):
    r = random.Random(9)
    part = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a = part(1000)
    b = a[:200] + part(1600) + a[-200:]
    c = part(1200) + a[400:600] + part(1200)
    texts = [a, b, c, a]
    assert scanned(spark, texts) == sequential(list(enumerate(texts))) == set()


def test_stretches_of_a_component_hand_on_their_state(spark):
    r = random.Random(12)
    heads = ["".join(r.choice("abcdef ") for _ in range(260)) for _ in range(3)]
    texts = []
    for _ in range(90):
        texts += [r.choice(heads) + "".join(r.choice("xyz") for _ in range(r.randint(0, 400))) + r.choice(heads)] * r.choice([1, 1, 1, 2, 5])
    truth = sequential(list(enumerate(texts)))
    assert 20 < len(truth) < len(texts) - 10
    assert scanned(spark, texts, scan_rows=17) == truth == scanned(spark, texts)


def test_routes_by_size(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "s", False, base), (2, "s", False, base + " more")] + [(i, "t", False, base + " x" * (i % 3)) for i in range(10, 16)] + [(20, None, False, base), (21, None, False, base)]
    out = {(r.doc_id, r.rule): r.removed for r in dedup.routed_dedup(docs(spark, rows), most=3).collect()}
    assert {k for k in out} == {(i, "similarity" if i < 10 or i > 19 else "fingerprint") for i, *_ in rows}
    assert {i for (i, _), x in out.items() if x} == {2, 11, 12, 13, 14, 15, 21}
    assert dedup.routed_dedup(docs(spark, rows).limit(0)).count() == 0


def test_batches(spark):
    parts = [spark.createDataFrame(x, "doc_id bigint, digest string") for x in ([(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")], [(6, "c"), (7, None)])]
    assert [sorted(r.doc_id for r in f.collect()) for f in dedup.iterate_batches(parts)] == [[1, 3], [5], [7]]


def test_contamination(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:20])), (2, None), (3, "too short")], "item_id bigint, text string")
    texts = [" ".join(words[3:16]), " ".join(words[3:15]), (" ".join(words[3:16]).upper() + " x ") * 2, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    banned = decontaminate.blacklist(bench)
    assert {r.doc_id: r.hits for r in decontaminate.contaminated(df, banned).collect()} == {0: 1, 2: 2}
    assert {r.doc_id for r in decontaminate.contaminated(df, banned, threshold=2).collect()} == {2}
    assert decontaminate.contaminated(df, banned.where(F.lit(False))).count() == 0
