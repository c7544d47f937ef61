import random

import pytest
from tokenizers import Tokenizer as Library
from tokenizers import models, pre_tokenizers

from corpusmill.llm import budget

CORPUS = "the bridge of the valley was closed; la città è chiusa, perché? 12345 tests\n\n  def f(x): return x's  don't 日本語 \t end "


@pytest.fixture(scope="module")
def tables():
    """A small vocabulary whose merges come from counting pairs of a sentence."""
    alphabet = budget.byte_alphabet()
    back = {b: c for c, b in alphabet.items()}
    vocabulary = {c: i for i, c in enumerate(alphabet)}
    words = [[back[b] for b in w.encode()] for w in ("Ġ" + CORPUS).replace(" ", " Ġ").split() for _ in range(2)]
    words = [[c for c in w if c in vocabulary] for w in words]
    merges = []
    for rank in range(60):
        count = {}
        for w in words:
            for p in zip(w, w[1:]):
                count[p] = count.get(p, 0) + 1
        best = max(count, key=lambda p: (count[p], p))
        merges.append((rank, *best))
        vocabulary.setdefault("".join(best), len(vocabulary))
        for w in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = ["".join(best)]
                i += 1
    return [(i, s) for s, i in vocabulary.items()] + [(len(vocabulary), "<bos>")], merges


@pytest.fixture(scope="module")
def library(tables):
    t = Library(models.BPE(vocab={s: i for i, s in tables[0]}, merges=[(a, b) for _, a, b in tables[1]]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=True)
    return t


def test_walks_agree_with_merging(tables):
    t, r = budget.Tokenizer(*tables), random.Random(1)
    pieces = sorted({bytes(r.choice(b"thebridg aofvly") for _ in range(r.randint(1, 14))) for _ in range(3000)})
    walk = budget.Walk(t)
    for p in pieces:
        assert walk.tokens(p) == len(t.encode(p)), p


def test_documents_agree_with_the_library(spark, tables, library):
    r = random.Random(2)
    texts = [CORPUS, "", " ", None, "a", " a", "\n\n", "don't  stop", "<bos>", CORPUS * 400, "é" * 5000, *("".join(r.choice(CORPUS) for _ in range(r.randint(1, 200))) for _ in range(200))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, tokens string")
    vocabulary, merges = spark.createDataFrame(tables[0], "token_id int, token string"), spark.createDataFrame(tables[1], "merge_rank int, left_piece string, right_piece string")
    out = {x.doc_id: x.n_tokens for x in budget.with_tokens(docs, budget.load(vocabulary, merges), []).collect()}
    library.encode_special_tokens = True
    for i, t in enumerate(texts):
        assert out[i] == (None if t is None else len(library.encode(t).ids)), (i, t and t[:80])
    assert budget.with_tokens(docs.limit(0), budget.load(vocabulary, merges), []).count() == 0


def test_repeated_rows_and_null_ids_count_each(spark, tables, library):
    rows = [(1, CORPUS), (1, CORPUS), (1, "the bridge"), (1, None), (1, ""), (None, "a bell"), (None, "a bell"), (None, CORPUS), (2, "the bridge")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocabulary, merges = spark.createDataFrame(tables[0], "token_id int, token string"), spark.createDataFrame(tables[1], "merge_rank int, left_piece string, right_piece string")
    out = [(x.doc_id, x.n_chars, x.n_tokens) for x in budget.with_tokens(docs, budget.load(vocabulary, merges), []).collect()]
    assert sorted(out, key=str) == sorted([(i, t if t is None else len(t), t if t is None else len(library.encode(t).ids)) for i, t in rows], key=str)


def test_totals(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", None, None), (None, 5, 2)], "source string, n_chars bigint, n_tokens bigint")
    assert sorted((tuple(r) for r in budget.totals(df, "source").collect()), key=str) == sorted([("a", 2, 3, 1), (None, 1, 5, 2)], key=str)
