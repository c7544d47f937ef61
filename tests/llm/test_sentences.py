import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.sentences import sentence_ends, sentences


def cut(text):
    ends = sentence_ends(text)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


CASES = [
    ["Dr. Rossi arrived at 9.30 a.m. and left.", "Nobody knew why."],
    ["Everyone left at 5 p.m.", "The hall was closed."],
    ["La società Alfa S.p.A. ha chiuso il bilancio con 1.200,50 euro.", "Il sig. Bianchi era assente."],
    ["«Chi ha spento la luce?» chiese Anna senza alzarsi.", "Nessuno rispose."],
    ['Marco disse: "Torno subito."', "Poi uscì."],
    ["« Revenez demain. »", "Après la réunion, M. Blanc partit."],
    ["But... are you sure?", "Really?!", "Yes."],
    ["(That at least is what they told us.)", "The rest is silence (see the note below)."],
    ["“誰が来たのか。”と先生が尋ねた。", "橋は閉まっていた。"],
    ["牌子上写着：“请勿入内。”", "老师等了很久……然后走了。"],
    ["В 1914 г. мост закрыли, т. е. почти всё, см. стр. 65.", "«Кто это?» — спросил врач."],
    ["बैठक के बाद डॉ. राव ने कहा।", "पुल बंद था।"],
    ["Am 12. Mai kam Prof. Dr. Weber an.", "Die Brücke war zu."],
    ["Γιατί έφυγε;", "Κανείς δεν ξέρει."],
    ["See main.c and www.a.example for v2.5.1 of 3.146 parts.", "J. K. Weber wrote it."],
    ["It was as one often reads.", "Non è vero."],
]


@pytest.mark.parametrize("parts", CASES)
def test_joined_sentences_come_apart_again(parts):
    glue = "" if any("一" <= c <= "鿿" for c in parts[0]) else " "
    assert cut(glue.join(parts)) == parts


def test_a_blank_line_ends_a_unit_and_a_line_break_does_not():
    assert cut("A heading\n\nThe first line\nruns on. Done") == ["A heading", "The first line\nruns on.", "Done"]
    assert cut("One\r\n\r\nTwo") == ["One", "Two"]
    assert cut('He said "one thing\n\nand never closed it. Next.') == ['He said "one thing', "and never closed it.", "Next."]


def test_the_stop_of_a_list_marker_belongs_to_its_item():
    assert cut("1. Compare the prices. 2. Call the office.") == ["1. Compare the prices.", "2. Call the office."]
    assert cut("1. Buy rope.\n a. Ask Ann.\n b. Ask Bob.\n2. Sell it.") == ["1. Buy rope.", "a. Ask Ann.", "b. Ask Bob.", "2. Sell it."]
    assert cut("Before.\n- iv. The fourth. v. The fifth.\n\n3.2. A heading") == ["Before.", "- iv. The fourth.", "v. The fifth.", "3.2. A heading"]
    assert cut("How many came? 12. Nobody knew.") == ["How many came?", "12.", "Nobody knew."]
    assert cut("It closed in\n1914. Nobody knew.") == ["It closed in\n1914.", "Nobody knew."]


def test_a_forgotten_space_is_no_obstacle():
    assert cut("The bell was sold.Nobody knew it.") == ["The bell was sold.", "Nobody knew it."]


def test_empty_and_long_texts():
    assert sentence_ends(None) == sentence_ends("") == sentence_ends(" \n\n ") == []
    long = "The bridge was closed (for now). " * 20_000
    assert len(sentence_ends(long)) == 20_000
    assert sentence_ends("(" * 50_000 + "]" * 50_000) == [100_000]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\n\"'()«»。1,;:—", max_size=80))
def test_ends_rise_and_cover_all_signs(text):
    ends = sentence_ends(text)
    assert ends == sorted(set(ends))
    assert all(not text[e - 1].isspace() for e in ends)
    assert not text[ends[-1] if ends else 0 :].strip()


def test_frames(spark):
    df = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, None), (3, "")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in sentences(df).collect()) == [(1, 0, 4)] * 2 + [(1, 1, 9)] * 2
    assert sentences(df.limit(0)).count() == 0


def test_german_ordinals_and_streets():
    text = "Die Sitzung ist am 3. Oktober in der Lindenstr. 5 in Bonn. Das Kapitel endet mit Seite 45. Bringen wir es zu Ende. Er kam im 19. Jahrhundert und am 12. 580. Tag an."
    assert [text[a:b].strip() for a, b in zip([0, *sentence_ends(text)], sentence_ends(text))] == [
        "Die Sitzung ist am 3. Oktober in der Lindenstr. 5 in Bonn.",
        "Das Kapitel endet mit Seite 45.",
        "Bringen wir es zu Ende.",
        "Er kam im 19. Jahrhundert und am 12. 580. Tag an.",
    ]
