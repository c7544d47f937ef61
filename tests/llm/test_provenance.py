import random

import pytest

from corpusmill.llm import provenance as P

VERBS, NOUNS = ["read", "find", "join", "merge", "load", "sort"], ["queue", "node", "table", "list", "frame", "index"]


def function(r, prefix=""):
    return f"int {prefix}{r.choice(VERBS)}_{r.choice(NOUNS)}(int {r.choice(NOUNS)}) {{\n    int k = {r.randint(0, 99)};\n    if (k > {r.randint(0, 99)}) return k;\n    return -{r.randint(1, 9)};\n}}\n"


def file(r, kind):
    body = "#include <stdio.h>\n" + "".join(function(r) + "/* keep the order stable */\n" for _ in range(r.randint(2, 5)))
    if kind == "hand":
        return body, r.choice(["src/a_node.c", None, "lib/gen_list.c"])
    if kind == "quoting":
        return body + 'void p(void) { puts("/* Code generated by x. DO NOT EDIT. */"); }\n', "src/q.c"
    if kind == "told":
        return f"/* Code generated by tool{r.choice('abcd')} v{r.randint(1, 9)}.1. DO NOT EDIT. */\n" + body, r.choice(["src/a.c", None])
    if kind == "worded":
        path = r.choice(["vendor/zorb/x.c", "dist/y.c", "src/a.c", None, None, "lib/b.c"])
        return f"/* put together with {''.join(r.choice('abdeors') for _ in range(7))} out of {r.choice(NOUNS)}.q, leave it alone */\n" + body, path
    if kind == "data":
        return "unsigned char d[] = {\n" + "".join("    " + ", ".join(f"0x{r.randint(0, 255):02x}" for _ in range(12)) + ",\n" for _ in range(30)) + "};\n", None
    if kind == "minified":
        return "".join(f"int {r.choice('abcdef')}{r.choice('xyz')}(int a,int b){{return a*b+{r.randint(1, 99)};}}" for _ in range(40)), None
    return "#include <stdio.h>\n" + "".join(function(r, "zorb_") for _ in range(3)), r.choice(["third_party/zorblib/a.c", "vendor/zorblib/b.c"])


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    kinds = [r.choice(["hand"] * 6 + ["quoting", "told", "worded", "data", "minified", "copied"]) for _ in range(700)]
    rows = [(i, *file(r, k), f"owner/repo{r.randint(0, 40)}", k) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, file_path string, domain string, score string"), kinds


@pytest.fixture(scope="module")
def model(corpus):
    return P.fit(corpus[0], per_stratum=300)


def test_held_out_accuracy(corpus, model):
    assert model["validation"]["precision"] > 0.9 and model["validation"]["recall"] > 0.9
    df, kinds = corpus
    out = {r.doc_id: not r.by_hand for r in P.score(df, model).collect()}
    truth = [k not in ("hand", "quoting") for k in kinds]
    assert sum(out[i] == t for i, t in enumerate(truth)) > 0.97 * len(truth)


def test_forms_are_learned_where_headers_are_masked(model):
    r = random.Random(99)
    for kind in ("data", "minified"):
        assert all(s > 0 for s in P.scores(*map(list, zip(*(file(r, kind) for _ in range(10)))), model))


def test_bodies_are_scored_without_comments(model):
    r = random.Random(5)
    body = file(r, "hand")[0]
    said = "/* Code generated by toolb v3.1. DO NOT EDIT. */\n" + body
    assert P.scores([said], [None], model) == P.scores([body], [None], model)
    assert P.LineScores(model).of([said])[0] > 0 > P.LineScores(model).of([body])[0]


def test_announcements_in_words_of_no_list_are_learned(model):
    r = random.Random(6)
    lines = P.LineScores(model)
    found = lines.of([file(r, "worded")[0] for _ in range(50)])
    assert not any(P.announces(x) for x in P.comment_lines(file(r, "worded")[0]))
    assert (found > 0).mean() > 0.9
    assert (lines.of([file(r, "hand")[0] for _ in range(50)]) > 0).mean() == 0


def test_a_remark_about_generation_announces_nothing():
    assert P.announces("This file is automatically generated from a.idl") and P.announces("@generated by x") and P.announces("Autogenerato da x")
    assert not P.announces("This table was auto-generated once; it is maintained by hand now.")
    assert not P.announces("reports are generated by the nightly job") and not P.announces("un tempo generato automaticamente, ora scritto a mano")


def test_one_kind_of_label_alone_finds_nothing(spark):
    df = spark.createDataFrame([(i, f"int a{i}(int b) {{ return b + {i}; }}\n/* plain */\n", None, "r") for i in range(40)], "doc_id bigint, text string, file_path string, domain string")
    assert P.score(df, P.fit(df)).where("not by_hand").count() == 0


def test_frames(spark, model):
    df = spark.createDataFrame([(1, None, "vendor/x/a.c"), (2, "", None), (3, " ", "vendor/x/a.c"), (4, "int a;\n" * 50_000, None), (4, "int a;\n" * 50_000, None)], "doc_id bigint, text string, file_path string")
    rows = sorted((r.doc_id, r.by_hand) for r in P.score(df, model).collect())
    assert [d for d, _ in rows] == [2, 3, 4, 4] and rows[0][1] and rows[1][1]
    empty = df.limit(0).selectExpr("*", "file_path as domain")
    assert P.score(empty, P.fit(empty)).count() == 0
