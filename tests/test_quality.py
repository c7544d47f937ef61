"""The filter against an independent restatement in plain Python."""

import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import quality


def is_code(t):
    if len(t) < 20:
        return False
    total = len(t.replace(" ", "").replace("\n", ""))
    signs = sum(c in "{}();=<>[]+-*/&|!#" for c in t)
    return total > 0 and (signs / total > 0.15 or any(k in t[:500] for k in T.C_KEYWORDS + T.GENERAL_KEYWORDS))


def expected(t, source=""):
    code = is_code(t) or any(m in source for m in T.CODE_PATH_MARKERS)
    t = re.sub(r"https?://\S+", "", t)
    t = re.sub("\n{4,}", "\n\n\n", t).strip() if code else re.sub(r"[ \t]+", " ", re.sub("\n{3,}", "\n\n", t)).strip()
    w = t.split()
    if not t:
        return "empty"
    if len(t) < (50 if code else 200):
        return "too_short"
    if not code and (len(w) < 20 or len(set(w)) < min(50, max(10, len(w) // 3))):
        return "low_vocab"
    if max(map(len, w), default=0) > (80 if code else 50):
        return "long_words"
    grams = Counter(zip(w, w[1:], w[2:]))
    if len(w) >= 10 and max(grams.values()) / sum(grams.values()) > (0.6 if code else 0.3):
        return "repetitive"
    if not code:
        solid = [c for c in t if not c.isspace()]
        if not solid or sum(ord(c) <= 0x24F for c in solid) / len(solid) < 0.65:
            return "non_latin"
        s = [x for x in re.split("[.!?]+", t) if x.strip()]
        if len(s) >= 3 and sum(len(x.split()) < 6 for x in s) / len(s) >= 0.8:
            return "short_sentences"
        full = [x.strip() for x in t.split("\n") if x.strip()]
        items = sum(bool(re.match(r"[-*•▪▸►→]\s|\d+[.)]\s", x)) for x in full)
        return "list_heavy" if len(t.split("\n")) >= 5 and items / len(full) >= 0.7 else "ok"
    live = [x.strip() for x in t.split("\n") if x.strip() and x.strip() not in ("{", "}", "*/")]
    comments = sum(x.startswith(("/*", "* ", "*/", "//", "#")) for x in live)
    if len(live) == comments:
        return "no_code_content"
    return "mostly_comments" if comments / len(live) > 0.8 else "ok"


WORDS = [f"word{i}" for i in range(400)]
PROSE = " ".join(WORDS[:60])
EDGES = [
    "",
    "   \n",
    "https://a.b/c",
    "https://a.b x",
    "x" * 199,
    PROSE[:199].rstrip() + "x" * (199 - len(PROSE[:199].rstrip())),
    PROSE,
    " ".join(WORDS[:19]) + " " + "y" * 49,
    " ".join((WORDS[:9] * 3)[:20]) + "z" * 40,
    " ".join(WORDS[:49] * 4),
    " ".join(WORDS[:50] * 4),
    PROSE + " " + "q" * 50,
    PROSE + " " + "q" * 51,
    " ".join(["alpha beta gamma"] * 30 + WORDS[:60]),
    " ".join(["alpha beta gamma"] * 10 + WORDS[:60]),
    " ".join(f"слово{i}" for i in range(60)),
    " ".join(f"слово{i} wordword{i}{i}" for i in range(60)),
    ". ".join(" ".join(WORDS[i : i + 3]) for i in range(0, 180, 3)),
    ". ".join(" ".join(WORDS[i : i + 7]) for i in range(0, 180, 7)),
    "\n".join(f"- {' '.join(WORDS[i : i + 8])}" for i in range(0, 160, 8)),
    "\n".join(f"{i}) {' '.join(WORDS[i : i + 8])}" for i in range(0, 160, 8)),
    "\n".join(f"١. {' '.join(WORDS[i : i + 8])}" for i in range(0, 160, 8)),
    "\n".join(f"• {' '.join(WORDS[i : i + 60])}" for i in range(0, 180, 60)),
    "\u0085".join(WORDS[:80]),
    "\u001c".join(WORDS[:80]),
    "# import only comments here and there\n" * 4,
    " ".join(["alpha"] * 60 + WORDS[:60]),
    "# a comment line of code\n" * 4 + "x = call(1)\n",
    "# a comment line of code\n" * 9 + "x = call(1)\ny = call(2)\n",
    "void f() { return; } // " + "x" * 30,
    "#include <a.h>\n" * 10 + "int x;",
    PROSE + " from ",
    "a letter from home, " + " ".join(WORDS[:8]),
    "z" * 500 + " from " + PROSE,
]


def test_reasons_of_edge_texts(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(EDGES)] + [(900, None, None)], "doc_id bigint, text string, source string")
    out = {r.doc_id: r.reason for r in quality.with_reason(df).collect()}
    assert out.pop(900) == "empty"
    for i, t in enumerate(EDGES):
        assert out[i] == expected(t), (i, t[:60])
    assert set(out.values()) >= {"empty", "too_short", "low_vocab", "long_words", "repetitive", "non_latin", "short_sentences", "list_heavy", "no_code_content", "mostly_comments", "ok"}


def test_reasons_of_the_small_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    rows = quality.with_reason(df).select("doc_id", "text", "source", "reason").collect()
    for r in rows:
        assert r.reason == expected(r.text or "", r.source or ""), r.doc_id


def test_c_mode(spark):
    df = spark.createDataFrame([(1, "#include <a.h>\n" * 9 + "int x;\n" + "// c\n" * 3)], "doc_id bigint, text string")
    assert quality.with_reason(df).first().reason == "mostly_comments"
    assert quality.with_reason(df, c_mode=True).first().reason == "ok"


def test_parse_errors_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "{bad", "keep"), (2, PROSE, None, "keep")], "doc_id bigint, text string, _corrupt_record string, n string")
    out = {r.doc_id: (r.reason, r.n) for r in quality.with_reason(df).collect()}
    assert out == {1: ("parse_error", "keep"), 2: ("ok", "keep")}
    assert quality.with_reason(df.limit(0)).count() == 0


def test_cleaning_is_idempotent_and_normal_form(spark):
    rows = [(t,) for t in [*EDGES, "é Å", "café"]]
    df = spark.createDataFrame(rows, "t string").withColumn("c", T.clean(F.col("t"))).withColumn("cc", T.clean(F.col("c"))).withColumn("n", T.nfc(F.col("t")))
    for r in df.collect():
        assert r.c == r.cc and r.n == unicodedata.normalize("NFC", r.t)


def test_hash_modulus(spark):
    import hashlib

    df = spark.range(300).select(F.col("id").cast("string").alias("s"))
    for r in df.select("s", T.md5_mod(F.col("s")).alias("h")).collect():
        assert r.h == int(hashlib.md5(r.s.encode()).hexdigest(), 16) % 100_000
