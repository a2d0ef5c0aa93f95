"""Text, sentence and language functions, on strings with known results."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pagewright.functions import ends, keys, language, sentences as S, text as T
from pagewright.operators import settings

SPLITS = [
    ("First one. Second one? Third!", ["First one.", "Second one?", "Third!"]),
    ("Models, e.g. Transformers, work. As shown in Fig. 3 and Eq. 2, it holds.", ["Models, e.g. Transformers, work.", "As shown in Fig. 3 and Eq. 2, it holds."]),
    ("Vaswani et al. [12] proposed it. See Sec. 4 vs. Sec. 5.", ["Vaswani et al. [12] proposed it.", "See Sec. 4 vs. Sec. 5."]),
    ("That is, i.e. The rest.", ["That is, i.e. The rest."]),
    ("Accuracy rose to 93.5 with v1.2.3 from github.com/a/b [12]. Next.", ["Accuracy rose to 93.5 with v1.2.3 from github.com/a/b [12].", "Next."]),
    ("As A. Vaswani wrote. 1. First item here.", ["As A. Vaswani wrote.", "1. First item here."]),
    ("Figure 1. Sample program. It loops.", ["Figure 1. Sample program.", "It loops."]),
    ('He said "stop." Then (it ended.) Done.', ['He said "stop."', "Then (it ended.)", "Done."]),
    ("本文提出了一种新模型。实验表明它更快！是否适用于其他任务？", ["本文提出了一种新模型。", "实验表明它更快！", "是否适用于其他任务？"]),
    ("我们称之为「注意力」。（见图１。）结果如下。", ["我们称之为「注意力」。", "（见图１。）", "结果如下。"]),
    ("准确率为９３．５％。下一句。", ["准确率为９３．５％。", "下一句。"]),
    ("本論文では新しい手法を提案する。実験により有効性を示す。", ["本論文では新しい手法を提案する。", "実験により有効性を示す。"]),
    ("우리는 새로운 방법을 제안한다. 실험 결과는 다음과 같다.", ["우리는 새로운 방법을 제안한다.", "실험 결과는 다음과 같다."]),
    ("Мы предлагаем новый метод, см. рис. 3. Он работает быстро.", ["Мы предлагаем новый метод, см. рис. 3.", "Он работает быстро."]),
    ("Wir nutzen z. B. Transformer, vgl. Abschnitt 2. Das Modell lernt.", ["Wir nutzen z. B. Transformer, vgl. Abschnitt 2.", "Das Modell lernt."]),
    ("Nous utilisons p. ex. des modèles. Les résultats sont bons.", ["Nous utilisons p. ex. des modèles.", "Les résultats sont bons."]),
    ("", []), ("   ", []), (None, []), ("no end", ["no end"]), ("Wait... what? Yes.", ["Wait... what?", "Yes."]),
]


def values(spark, rows, column, schema="text string"):
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def test_split_sentences(spark):
    assert values(spark, [t for t, _ in SPLITS], S.split_sentences(F.col("text"))) == [s for _, s in SPLITS]


@pytest.mark.parametrize(("text", "expected"), [x for x in SPLITS if x[0] and x[0].strip()])
def test_ends_in_kernels_agree(text, expected):
    begin, out = 0, []
    for end in ends.sentence_ends(text):
        out.append(text[begin:end].strip())
        begin = end
    assert [s for s in out if s] == expected


def test_sentences_cover_the_text(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/blocks.parquet").select("text").distinct().collect()]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(T.collapse_blanks(F.col("text")).alias("plain"), S.split_sentences(F.col("text")).alias("s"), T.is_cjk_text(F.col("text")).alias("cjk")).collect()
    for r in rows:
        if not r.cjk:
            assert " ".join(r.s) == r.plain


def test_line_join(spark):
    pairs = [("xs-", "f"), ("e-", "M"), ("ab", "c"), ("2-", "x"), ("模型", "的"), ("する", "。"), ("s‐", "f"), ("", "x"), (None, "x")]
    assert values(spark, pairs, T.line_join(F.col("a"), F.col("b")), "a string, b string") == ["merge", "keep", "space", "space", "join", "join", "merge", "space", "space"]
    lines = F.array(*[F.lit(x) for x in ("trans-", "former and Trace-", "Monkey run ", "模", "型")])
    assert spark.range(1).select(T.join_lines(lines).alias("v")).first().v == "transformer and Trace-Monkey run模型"


def test_accents_and_ligatures(spark):
    made = T.combined_accents()
    assert made["¨ı"] == "ï" and made["´e"] == "é" and "¨1" not in made and made["ˇs"] == "š"
    assert values(spark, ["eﬃcient ﬁg", None, ""], T.expand_ligatures(F.col("text"))) == ["efficient fig", None, ""]


def test_normalize_and_keys(spark):
    assert values(spark, ["  a\u00a0\u3000b\n\tc\ufeff", "e\u0301", None, ""], T.normalize_source(F.col("text"))) == ["a b c", "é", None, ""]
    key = keys.cache_key(F.col("text"), F.lit("m"), F.lit("zh-CN"), F.lit("g"))
    one, two, other = values(spark, ["a  b", "a b", "ab"], key)
    assert one == two != other and len(one) == 40
    glossary = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    swapped = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    row = spark.range(1).select(keys.glossary_hash(glossary).alias("x"), keys.glossary_hash(swapped).alias("y")).first()
    assert row.x == row.y == hashlib.sha1(b'[["a","1"],["b","2"]]').hexdigest()[:12]
    given = [({}, "97d170e1550e"), ({"b": "y", "A": "x"}, "c0484491af6a"), ({"Z": "1", "é": "2", "e": "3", "f": "4"}, hashlib.sha1('[["e","3"],["é","2"],["f","4"],["Z","1"]]'.encode()).hexdigest()[:12])]
    for terms, digest in given:
        assert spark.range(1).select(keys.glossary_hash(keys.glossary_of(terms)).alias("x")).first().x == digest


LANGUAGES = [
    ("本文提出了一种新的注意力机制。", "zh-CN"), ("本文提出了一種新的注意力機制，這個方法對長序列有效。", "zh-TW"), ("本論文では新しい手法を提案する。", "ja"),
    ("우리는 새로운 방법을 제안한다.", "ko"), ("Мы предлагаем новый метод.", "ru"), ("We propose a new model for the translation of papers.", "en"),
    ("Nous proposons un nouveau modèle pour la traduction des articles.", "fr"), ("Wir schlagen ein neues Modell für die Übersetzung vor.", "de"),
    ("Proponemos un modelo nuevo para la traducción de los artículos.", "es"), ("Propomos um novo modelo para a tradução dos artigos.", "pt"),
    ("Proponiamo un nuovo modello per la traduzione degli articoli.", "it"), ("Table 3", None), ("BLEU 28.4", None), ("", None), (None, None),
]


def test_detect_language(spark):
    assert values(spark, [t for t, _ in LANGUAGES], language.detect_language(F.col("text"))) == [c for _, c in LANGUAGES]


def test_already_in_language(spark):
    rows = [("這個方法對長序列有效。", "zh-CN", "auto"), ("這個方法對長序列有效。", "zh-TW", "auto"), ("Nous proposons un modèle pour la traduction.", "fr", "auto"), ("Nous proposons un modèle pour la traduction.", "en", "auto"), ("Table 3", "en", "auto"), ("Table 3", "en", "en"), ("Table 3", "en", "fr")]
    assert values(spark, rows, language.is_already_in(F.col("text"), F.col("target"), F.col("source")), "text string, target string, source string") == [False, True, True, False, False, True, False]


def test_resolve_target(spark):
    rows = [("ja", "en"), ("auto", "zh-cn"), ("auto", "zh-HK"), (None, "pt-BR"), ("xx", "sv"), ("auto", "zh-tw"), ("auto", "de")]
    expected = ["ja", "zh-CN", "zh-TW", "pt", "en", "zh-TW", "de"]
    assert values(spark, rows, language.resolve_target(F.col("s"), F.col("d")), "s string, d string") == expected
    assert [settings.resolve_target(s, d) for s, d in rows] == expected


def test_flags(spark):
    texts = ["Figure 3: x", "图 1：整体", "3.1 Method", "第2章", "• item", "2) item", "plain text.", "?>9@AJ.D<F@", None]
    assert values(spark, texts, T.is_caption(F.col("text"))) == [True, True, False, False, False, False, False, False, None]
    assert values(spark, texts, T.has_section_number(F.col("text"))) == [False, False, True, True, False, False, False, False, None]
    assert values(spark, texts, T.is_list_item(F.col("text"))) == [False, False, False, False, True, True, False, False, None]
    assert values(spark, ["End.", "End.”  ", "no", "完。」", None], T.ends_with_terminal(F.col("text"))) == [True, True, False, True, None]
    assert values(spark, ["?>9@AJ.D<F@", "fine text", ""], T.is_garbled(F.col("text"))) == [True, False, False]


def test_format_message(spark):
    rows = [("a {0} b {1} {0}", ["x", "y"]), ("{1} {2}", ["x", "y"]), ("{0}", [None]), ("none", []), ("{0}", [])]
    assert values(spark, rows, T.format_message(F.col("t"), F.col("a")), "t string, a array<string>") == ["a x b y x", "y {2}", "{0}", "none", "{0}"]
