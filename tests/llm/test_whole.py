"""Cases that the operators once cut short."""

from __future__ import annotations

import pytest

from pagewright.llm import abuse, forms, langs, pairs, queries, sents

from .test_operators import TEXTS

# ---- 5: sentences

PATHS = [
    ("The rule (It is old. It still holds) was dropped. Yes.", ["The rule (It is old. It still holds) was dropped.", "Yes."]),
    ("(It is old. It still holds) was dropped. Yes.", ["(It is old. It still holds) was dropped.", "Yes."]),
    ("It was “old. It still holds” to us. Yes.", ["It was “old. It still holds” to us.", "Yes."]),
    ("(It is old. It still holds.) Next one.", ["(It is old.", "It still holds.)", "Next one."]),
    ("He went (see above. Then it ended. More came.", ["He went (see above.", "Then it ended.", "More came."]),
    ("He wrote: “It is old. It holds. It works.” Then he left.", ["He wrote: “It is old.", "It holds.", "It works.”", "Then he left."]),
]


@pytest.mark.parametrize(("text", "expected"), PATHS)
def test_path_over_open_marks(text, expected):
    assert [text[a:b] for a, b in sents.sentences(text)] == expected


def test_positions_with_selectors_beyond_the_first_plane():
    text = "第　葛\U000e0100城。Yes. No."
    assert [text[a:b] for a, b in sents.sentences(text)] == ["第　葛\U000e0100城。", "Yes.", "No."]
    assert sents.sentence_ends("It is 葛\U000e0100.\U000e0101 Yes.") == [9, 15]


# ---- 1: broken pairs

REFUSALS = [
    "I'm sorry, but I cannot translate section 4.2 of this text: „Das Verfahren wurde an allen Messstellen des Landes über mehrere Jahre erprobt und bewertet.“",
    "Es tut mir leid, den Abschnitt 3 „The method was tried at all stations of the country over several years and was then assessed“ kann ich nicht übersetzen.",
    "很抱歉，第 12 节无法翻译：“The method was tried at all stations of the country over several years, and it was then assessed by three independent groups of readers.”",
]


@pytest.mark.parametrize("reply", REFUSALS)
@pytest.mark.parametrize("language", ["de", "en", "ru"])
def test_refusals_whatever_the_language_of_the_reply(reply, language):
    assert len(reply) >= 90 and pairs.signals("Plain words 7", reply, "fr", {"en": 1.0}, {language: 1.0}, True)["refusal"][0] == "+"
    assert pairs.signals(reply, reply, "fr", {"en": 1.0}, {language: 1.0}, True)["refusal"][0] == "-"


PLAIN = ["Malheureusement, le modèle converge lentement.", "Purtroppo i dati mancano.", "Infelizmente, os dados faltam.", "К сожалению, данных нет.", "Desafortunadamente, faltan datos.", "Usamos esto como modelo."]
DECLINED = ["Я вынужден снова отказаться.", "I would rather not translate this.", "I am not comfortable to render this passage.", "Ich bin nicht in der Lage, das zu übersetzen.", "Je préfère ne pas m'en occuper.", "Перевести это невозможно.", "La traduction de ce passage est impossible."]


def test_wording_of_refusals():
    assert [x for x in PLAIN if pairs._declines(x.casefold())] == []
    assert [x for x in DECLINED if not pairs._declines(x.casefold())] == []


def test_words_of_another_language_that_look_like_a_refusal():
    assert pairs.signals("Das verletzt Rechte", "Copies infringe the rights of 3 authors; infringement is rare", "en", {"de": 1.0}, {"en": 1.0}, True)["refusal"][0] == "-"
    assert pairs.signals("Words", "Este texto infringe las normas", "es", {"en": 1.0}, {"es": 1.0}, True)["refusal"][0] == "+"


@pytest.fixture(scope="module")
def model():
    rows = [(x, code) for code, x in TEXTS.items() for _ in range(3)]
    return langs.LanguageModel().fit(rows)


MIXED = "Das ist nicht der Weg und wir haben es auch mit dem Hund gemacht, das ist nicht der Weg. This is the way in which we have done it."


def test_an_unchanged_mixed_source_is_copied(model):
    one = lambda source, target: pairs.signals(source, source, target, model.scores([source])[0], model.scores([source])[0], True, model)
    assert pairs._top(model.scores([MIXED])[0])[0] == "de"
    assert (one(MIXED, "de")["copied"], one(MIXED, "de")["exempt"]) == ("+++", False)
    assert one(MIXED.split(". ")[0], "de")["exempt"]
    both = "这个问题与国家发展关系不大。这个问题与国家发展关系不大。Это не тот путь, который они выбрали."
    assert not pairs.wholly(both, "zh-CN", model) and pairs.wholly(both.split("Э")[0], "zh-CN", model)


def test_a_short_source_in_a_longer_wrap_is_compared():
    source, wrap = "一个规则的一个部分。", "Here is the translation you asked for: "
    assert pairs.signals(source, wrap + source, "en", {"zh-CN": 1.0}, {"en": 1.0}, True)["copied"] == "++-"
    assert pairs.signals(source, wrap + "One part of a rule.", "en", {"zh-CN": 1.0}, {"en": 1.0}, True)["copied"] == "---"


# ---- 8: harmful language


def test_labels_add_wording_that_the_lexicon_does_not_have():
    lexicon = abuse.Lexicon()
    new, near, rare = "Zorblek snarvs grimble about quondam tarns.", "You are a glorbic idjut and everybody knows it.", "Vexlor thrimps with dandle."
    known = "You are a stupid idiot and everybody knows it."
    rows = [(f"{new} {known}", 1)] * 12 + [(f"{new} The list is long.", 0)] + [(near, 1)] * 12 + [(f"{rare} The list is long.", 1)] + [("The paper describes the method. The list is long.", 0)] * 80
    found, words = abuse.gathered(lexicon, rows)
    frequency = {"": 1000} | {t: 1 for x in found for t in x.bag}
    idf = abuse.idf_of(found, words, frequency)
    examples, kept = abuse.labelled_examples(lexicon, found, [label for _, label in rows], idf)
    # of a harmful document without another harmful sentence, what no harmless document has the like of is an example
    assert {name: c for _, c, name in examples} == {new: abuse.GENERAL, near: abuse.GENERAL, known: "abusive", rare: abuse.GENERAL, "The list is long.": "", "The paper describes the method.": ""}
    assert [found[i].text for i in kept] == [name for _, _, name in examples]
    judge = abuse.fitted(lexicon, rows, lambda terms: {"": 1000} | dict.fromkeys(terms, 1))
    assert judge.document(new).keys() == {abuse.GENERAL} and judge.document(new)[abuse.GENERAL][0] > 0.5
    assert judge.document(near)["abusive"][0] > 0.5 and judge.document("The list is long.") == {}


def test_a_label_against_all_others_is_no_example():
    lexicon = abuse.Lexicon()
    bad = "You are a stupid idiot and everybody knows it."
    rows = [(f"{bad} Number {n} of the list.", 1) for n in range(9)] + [(bad, 0)] + [("The list is long.", 0)] * 20 + [("The list is long.", 1)]
    found, words = abuse.gathered(lexicon, rows)
    examples, _ = abuse.labelled_examples(lexicon, found, [label for _, label in rows], abuse.idf_of(found, words, {"": 1000}))
    assert {name: c for _, c, name in examples} == {bad: "abusive", "The list is long.": ""}


def test_scores_follow_the_labels():
    scores, labels = [0.0] * 900 + [0.9] * 100, [0] * 880 + [1] * 20 + [1] * 90 + [0] * 10
    a, b = abuse.platt(scores, labels)
    curve = lambda s: 1 / (1 + abuse.exp(-(a * s + b)))
    assert curve(0.0) == pytest.approx(20 / 900, abs=0.01) and curve(0.9) == pytest.approx(0.9, abs=0.02)
    assert abuse.platt([0.1, 0.9], [0, 1]) == abuse.PLATT


def test_chance_of_many_documents():
    assert abuse.chance(0, 5, 0.2) == pytest.approx(1) and abuse.chance(2, 0, 0.2) == pytest.approx(0.04) and 0 <= abuse.chance(2000, 2000, 0.2) < 1e-6


# ---- 4: one form


def test_bigrams_of_all_texts_whole(spark):
    # more texts than were once sampled, equal ones among them, and one longer than was once read
    rows = [(f"Word{'abcdefghij'[n % 10]} eins {n}",) for n in range(9000)] + [("ab " * 4000 + "qzq",), (None,), ("",)]
    model = forms.spelling_of(spark.createDataFrame(rows, "text string").repartition(3))
    assert model.totals["^"] == 2 * 9000 + 4000 + 1 and model.pairs["z"] == {"q": 1} and model.pairs["o"] == {"r": 9000} and model.pairs["a"] == {"$": 900, "b": 4000}
    assert forms.spelling_of(spark.createDataFrame([], "text string")).totals == {}


def test_bigrams_of_both_tables(spark, tmp_path):
    spark.createDataFrame([("ab", None)], "text string, paper_id string").write.parquet(f"{tmp_path}/work_items.parquet")
    spark.createDataFrame([([("xy",), (None,)],), (None,)], "text_items array<struct<str string>>").write.parquet(f"{tmp_path}/page_texts.parquet")
    assert queries._speller(spark, str(tmp_path)).pairs["^"] == {"a": 1, "x": 1}


def test_bigrams_of_kana_with_marks():
    model = forms.Spelling().fit(["このページの一覧", "次のへいわ"])
    assert model.pairs["ペ"] == {"ー": 1} and model.canonical("ぺ一ジ") == "ページ"


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_bigrams_by_characters(monkeypatch, size):
    monkeypatch.setattr(forms, "PIECE", size)
    texts = ["The words", "", "Ünder, das", "аbc сло́во, ΑΣ.Α ΣΑΣ", "この一覧、ト一ク", "한글 ไทย ①²x1a", "ab cd ef", "\U00020000口 İo"]
    expected = {}
    for text in texts:
        for token in forms.re.findall(r"[^\W\d_]+", forms.unicodedata.normalize("NFD", text).lower()):
            scripts = {forms.script(c) for c in token}
            if len(scripts - {""}) == 1 or scripts <= {"han", "hiragana", "katakana", ""}:
                for a, b in zip(f"^{token}", f"{token}$", strict=True):
                    expected.setdefault(a, []).append(b)
    model = forms.Spelling().fit(texts)
    held = lambda c: c not in "^$" and forms._kind(ord(c)) > 127
    assert model.totals == {a: len(found) for a, found in expected.items()}
    assert {a: dict(found) for a, found in model.pairs.items()} == {a: {b: found.count(b) for b in found if held(a) or held(b)} for a, found in expected.items()}
