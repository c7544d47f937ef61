import itertools

import numpy as np
import pytest

from corpusmill.llm import language

TEXTS = {
    "it": "La maestra ha chiesto perché il ponte non era ancora finito. Nessuno sapeva che cosa rispondere alla donna.",
    "en": "The teacher asked why the bridge had not been finished. Nobody knew what they should say to the woman.",
    "fr": "La maîtresse a demandé pourquoi le pont n'était pas encore fini. Personne ne savait quoi dire à cette femme.",
    "es": "La maestra preguntó por qué el puente no estaba todavía terminado. Nadie sabía qué decir a la mujer.",
    "pt": "A professora perguntou por que a ponte ainda não estava pronta. Ninguém sabia o que dizer à mulher.",
    "de": "Die Lehrerin fragte, warum die Brücke noch nicht fertig war. Niemand wusste, was man der Frau sagen sollte.",
    "ru": "Учительница спросила, почему мост ещё не готов. Никто не знал, что сказать этой женщине.",
    "el": "Η δασκάλα ρώτησε γιατί η γέφυρα δεν ήταν έτοιμη. Κανείς δεν ήξερε τι να πει στη γυναίκα.",
    "ar": "سألت المعلمة لماذا لم ينته الجسر بعد. لم يعرف أحد ماذا يقول للمرأة في المدينة.",
    "hi": "शिक्षिका ने पूछा कि पुल अभी तक क्यों नहीं बना। किसी को नहीं पता था कि क्या कहना है।",
    "zh": "老师问为什么那座桥还没有修好。没有人知道应该对那位女士说什么。",
    "ja": "先生はなぜ橋がまだ直っていないのかと尋ねた。誰もその人に何と言えばよいか知らなかった。",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, code) for i, (code, t) in enumerate(TEXTS.items())] + [(99, None, "it"), (100, "", None)]
    return language.fit_ngrams(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


@pytest.mark.parametrize("code", TEXTS)
def test_one_language(model, code):
    found = language.passages_of([TEXTS[code]], model)[0]
    assert [x[2] for x in found] == [code] and found[0][3] > 0.9


@pytest.mark.parametrize("a, b", [("it", "en"), ("en", "de"), ("it", "zh"), ("ru", "en"), ("fr", "it"), ("es", "pt")])
def test_two_languages_and_where_they_meet(model, a, b):
    text = TEXTS[a] + "\n\n" + TEXTS[b]
    found = language.passages_of([text], model)[0]
    assert [x[2] for x in found] == [a, b]
    assert abs(found[0][1] - len(TEXTS[a])) <= 2 and found[-1][1] == len(text)


def test_a_single_foreign_phrase_is_no_passage(model):
    found = language.passages_of([TEXTS["it"] + " " + "Come here." + " " + TEXTS["it"]], model)[0]
    assert [x[2] for x in found] == ["it"]


OUTSIDE = {
    "nl": "De gemeenteraad heeft gisteren besloten dat de oude brug over de rivier nog dit jaar wordt hersteld. Niemand wist wie dat zou betalen.",
    "pl": "Rada miasta postanowiła wczoraj, że stary most nad rzeką zostanie naprawiony jeszcze w tym roku. Nikt nie wiedział, kto za to zapłaci.",
    "uk": "Міська рада вчора вирішила, що старий міст через річку буде відремонтовано ще цього року. Ніхто не знав, хто за це заплатить.",
    "sv": "Kommunfullmäktige beslutade i går att den gamla bron över floden ska repareras redan i år. Ingen visste vem som skulle betala.",
}


@pytest.mark.parametrize("code", OUTSIDE)
def test_a_language_outside_the_model_is_undetermined(model, code):
    assert [x[2:] for x in language.passages_of([OUTSIDE[code]], model)[0]] == [("und", 0.0)]


def test_the_set_of_languages_is_that_of_penalised_likelihood(model):
    """Against trying every set of two languages with proportions fitted to convergence."""
    texts = [TEXTS["it"] + "\n\n" + TEXTS["en"], TEXTS["fr"], TEXTS["de"] + " " + TEXTS["el"], TEXTS["es"]]
    p = language.Pieces(texts)
    ll = p.score(model)
    like = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60))
    first = np.flatnonzero(np.concatenate([[True], p.row[1:] != p.row[:-1]]))
    weight = np.minimum(p.letters, 200).astype(float)
    uniform = np.full((len(texts), ll.shape[1]), 1 / ll.shape[1])
    share = language.choose(like, language._fit(like, uniform, p.row, first, weight, 12), p.row, first, weight)
    for i in range(len(texts)):
        own = p.row == i

        def fitted(chosen):
            s = np.zeros((1, ll.shape[1]))
            s[0, list(chosen)] = 1 / len(chosen)
            s = language._fit(like[own], s, np.zeros(own.sum(), int), np.array([0]), weight[own], 60)
            return language._likelihood(like[own], s, np.zeros(own.sum(), int), np.array([0]))[0]

        every = [c for k in (1, 2) for c in itertools.combinations(range(ll.shape[1]), k)]
        best = max(every, key=lambda c: fitted(c) - language.PENALTY * len(c))
        assert set(np.flatnonzero(share[i])) == set(best)


def test_runs_join_their_neighbours_as_by_rescanning(model):
    """The heap against the plain rule: find the smallest weak run, join it, start over."""
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 30))
        lang, ll, letters, ended = r.integers(0, 3, n), r.normal(0, 9, (n, len(language.LANGUAGES))), r.integers(1, 60, n), r.random(n) < 0.7
        runs = language.Runs(lang.copy(), ll, letters, ended)
        plain = lang.copy()
        while True:
            edge = [0, *(i for i in range(1, n) if plain[i] != plain[i - 1]), n]
            weak = [(letters[a:b].sum(), a, b) for a, b in zip(edge, edge[1:]) if runs.weak(a, b, plain[a])]
            if len(edge) == 2 or not weak:
                break
            _, a, b = min(weak)
            sides = [plain[i] for i in (a - 1, b) if 0 <= i < n]
            plain[a:b] = max(sides, key=lambda k: ll[a:b, k].sum())
        assert (runs.settle() == plain).all()


def test_labels(spark):
    spelled = {"it": "it", "ITA ": "it", "it-IT": "it", "Italian": "it", "en_GB": "en", "eng": "en", "xx": None, "und": None, "": None, None: None, "unknown": None, "日本": None}
    df = spark.createDataFrame([(k,) for k in spelled], "lang string")
    assert {r.lang: r.n for r in df.select("lang", language.normalised_label(df.lang).alias("n")).collect()} == spelled


def test_frames(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "12 34 !!"), (5, TEXTS["it"]), (5, TEXTS["it"]), (6, TEXTS["en"] * 3000)], "doc_id bigint, text string")
    rows = sorted((r.doc_id, r.language) for r in language.passages(df, model).collect())
    assert rows == [(4, "und"), (5, "it"), (5, "it"), (6, "en")]
    assert language.passages(df.limit(0), model).count() == 0
    assert language.fit_ngrams(df.limit(0).selectExpr("doc_id", "text", "text as lang")).shape[1] == len(language.LATIN)
