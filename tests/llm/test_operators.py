"""The operators for training data: results on small cases, properties, and odd input."""

from __future__ import annotations

import random
import unicodedata

import pytest
import regex
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from pagewright.llm import abuse, forms, langs, leaks, packing, pairs, pieces, queries, sents

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def speller():
    return forms.Spelling().fit(["The quick brown fox jumps over the lazy dog", "Съешь ещё этих мягких французских булок", "この規則の一覧", "一个规则"])


# ---- 4: one form

SAME = [
    ("looks", "ｌｏoks"), ("façade", "façade"), ("office", "oﬃce"), ("Trace-7", "Trace‑7"), ("a b", "a b"), ("a b", "a　b"), ("word", "wo​rd"), ("word", "wo­rd"),
    ("paper", "рареr"), ("Вот это", "Bот этo"), ("一个", "⼀个"), ("ペ", "ヘ゜".replace("゜", "゚")), ("ﾃﾞｰﾀ", "データ"), ("行", "⾏"), ("COPE", "СОРЕ"),
]
DIFFERENT = [("a", "b"), ("O", "0"), ("l", "I"), ("1", "l"), ("é", "e"), ("A", "a"), ("x²", "x2"), ("-", "–"), ("a b", "a  b"), ("ab", "a b"), (".", "。"), ("①", "1"), ("…", "..."), ("rn", "m")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(speller, a, b):
    assert speller.canonical(a) == speller.canonical(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look(speller, a, b):
    assert speller.canonical(a) != speller.canonical(b)


def test_canonical_is_stable_and_readable(speller):
    assert speller.canonical(None) is None and speller.canonical("") == ""
    assert speller.canonical("Вот это слово") == "Вот это слово" and speller.canonical("the fox") == "the fox"
    assert speller.canonical("однa лисa") == "одна лиса" and speller.canonical("тhе lazy dоg").endswith("lazy dog")


@hyp(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcoepxy АВСоерху ニ二口ロ-‐ éé́１1"), max_size=20))
def test_canonical_twice(text):
    model = forms.Spelling().fit(["abc"])
    once = model.canonical(text)
    assert model.canonical(once) == once


def test_pairs_of_same_look(spark, speller):
    rows = [("w", "p/1", 1, "paper"), ("w", "p/1", 2, "рареr"), ("w", "p/1", 2, "рареr"), ("w", "p/1", 3, "paper"), ("w", "p/2", 4, "рареr"), ("w", None, 5, "рареr"), ("w", "p/1", 6, None), ("w", "p/1", 7, ""), ("w", "p/1", 8, "other")]
    frame = spark.createDataFrame(rows, "tbl string, scope string, id bigint, text string")
    for above in (1, 2000):
        got = forms.same_look(forms.with_canonical(frame, "text", speller), salt_above=above).collect()
        assert sorted((r.id_a, r.id_b) for r in got) == [(1, 2), (2, 3)]
    assert forms.same_look(forms.with_canonical(frame.limit(0), "text", speller)).count() == 0


# ---- 5: sentences

ENDS = [
    ("Prof. Halvik and Dr. T. R. Osmund met. They left.", ["Prof. Halvik and Dr. T. R. Osmund met.", "They left."]),
    ("We kept 3.5 % (cf. Fig. 6, Eq. 18). It is so!", ["We kept 3.5 % (cf. Fig. 6, Eq. 18).", "It is so!"]),
    ("Someone wrote “Stop!” next to line No. 38. Yes.", ["Someone wrote “Stop!” next to line No. 38.", "Yes."]),
    ("It was opened and then ... closed again. Then...", ["It was opened and then ... closed again.", "Then..."]),
    ("„Halt!“ stand dort. Wir lasen es, z. B. am 3. Mai.", ["„Halt!“ stand dort.", "Wir lasen es, z. B. am 3. Mai."]),
    ("Les relecteurs ont demandé « 60, est-ce assez ? » et nous partons. Bien.", ["Les relecteurs ont demandé « 60, est-ce assez ? » et nous partons.", "Bien."]),
    ("有人写了“停！”两个字。然后……过了9分钟又关上了。", ["有人写了“停！”两个字。", "然后……过了9分钟又关上了。"]),
    ("（参看图1）我们做了。“好的。”他走了", ["（参看图1）我们做了。", "“好的。”", "他走了"]),
    ("誰かが「やめろ！」と書いた。値は3.5である。", ["誰かが「やめろ！」と書いた。", "値は3.5である。"]),
    ("누군가 “그만!”이라고 적었다. 끝났다.", ["누군가 “그만!”이라고 적었다.", "끝났다."]),
    ("Нам дали 45 томов, и А. Б. Сарнов прочёл их. Да.", ["Нам дали 45 томов, и А. Б. Сарнов прочёл их.", "Да."]),
    ("1. The first one. 2. The second one.", ["1. The first one.", "2. The second one."]),
    ("closed at once.The next one", ["closed at once.", "The next one"]),
    ("The file a.v4.1.txt was read at 9.30 by us", ["The file a.v4.1.txt was read at 9.30 by us"]),
    ("One line\nAnother line.", ["One line", "Another line."]),
    ("我们做了。  It is done. 好", ["我们做了。", "It is done.", "好"]),
]


@pytest.mark.parametrize(("text", "expected"), ENDS)
def test_sentences(text, expected):
    assert [text[a:b] for a, b in sents.sentences(text)] == expected


def test_positions_with_invisible_characters():
    text = "Pro​f. Halvik m‍et. Ye­s."
    assert [text[a:b] for a, b in sents.sentences(text)] == ["Pro​f. Halvik m‍et.", "Ye­s."]
    assert sents.sentence_ends(None) == [] == sents.sentence_ends("") == sents.sentence_ends(" \n ")


@hyp(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab A.!?。！“”「」()（）… \n​1了我"), max_size=40))
def test_ends_grow_and_reach_the_end(text):
    ends = sents.sentence_ends(text)
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) for e in ends)
    if ends:
        assert not text[ends[-1] :].translate({c: None for c, t in forms._REWRITE.items() if t is None}).strip()


def run(k, text, y, size=10.0, x=72.0):
    return {"run_id": k, "str": text, "matrix": [size, 0.0, 0.0, size, x, float(y)], "width": 1.0, "height": size, "font_name": "f", "has_eol": True}


def test_runs_of_a_page():
    items = [run(1, "A title", 800, 14.0), run(2, "First line of", 780), run(3, "it. Next", 765), run(4, "note", 755, 8.0), run(5, "Alone here", 740), run(6, "new par. ", 719), run(7, "End", 719, x=200.0), None, run(8, None, 700), run(9, "off", 2400)]
    found = [sents.run_ends(p) for p in sents.paragraphs(items, [0.0, 0.0, 595.0, 842.0], {})]
    assert found == [[(3, 3), (3, 8)], [(5, 10)], [(6, 8), (7, 3)]]
    assert sents.paragraphs(None, None, None) == []


def test_sentence_frames(spark):
    items = spark.createDataFrame([(1, "One. Two.", "x"), (1, "One. Two.", "x"), (2, None, "x"), (3, "", "x")], "item_id bigint, text string, rec_id string")
    assert sorted((r.rec_id, r.start_pos, r.end_pos) for r in sents.item_sentences(items).collect()) == [(1, 0, 4), (1, 5, 9)]
    assert sents.page_sentences(spark.read.parquet(f"{D}/page_texts.parquet").limit(0)).count() == 0


def test_page_sentences_are_those_of_the_plain_way(spark):
    items = [run(1, "A title", 800, 14.0), run(2, "First. Second", 780), run(3, " ", 770, 8.0), run(4, "ends", 765), run(5, "x", 760, 8.0), run(6, "Alone", 750), run(7, None, 740), run(8, "off", 2400), None]
    own = spark.createDataFrame([("p", 1, [0.0, 0.0, 595.0, 842.0], {"f": ("serif",)}, items), ("q", 1, None, None, items), ("r", 1, [], {"f": ("monospace",)}, items), ("s", 1, None, None, None)], spark.read.parquet(f"{D}/page_texts.parquet").select("paper_id", "page", "view_box", "styles", "text_items").schema)
    for pages in (own, spark.read.parquet(f"{D}/page_texts.parquet")):
        plain = set()
        for r in pages.collect():
            d = r.asDict(True)
            plain |= {x for p in sents.paragraphs(d["text_items"], d["view_box"], d["styles"]) for x in sents.run_ends(p)}
        assert {(r.rec_id, r.end_pos) for r in sents.page_sentences(pages).collect()} == plain


# ---- 3: languages

TEXTS = {
    "en": "This is the way in which we have done it and what they said about that", "de": "Das ist nicht der Weg und wir haben es auch mit dem Hund gemacht", "fr": "Nous avons fait cela dans la maison et les autres ne sont pas venus",
    "es": "No es el camino que los otros han tomado y por eso estamos en la casa", "pt": "Não é o caminho que os outros tomaram e por isso estamos em casa", "it": "Non è la strada che gli altri hanno preso e per questo siamo nella casa",
    "ru": "Это не тот путь, который они выбрали", "zh-CN": "这个问题与国家发展关系不大", "zh-TW": "這個問題與國家發展關係不大", "ja": "これはその問題とは関係がないのである", "ko": "이것은 그 문제와 관계가 없다",
}


@pytest.fixture(scope="module")
def lid(spark):
    items = spark.read.parquet("/root/testdata/sf0.01/work_items.parquet").select("text", "source_language")
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")
    return langs.model_of(langs.sample_of(items), langs.sample_of(documents))


def test_labels():
    assert [langs.label_code(x) for x in ("EN", "en-GB", "German", "zh-Hant", "zh_tw", "zh-Hans", "pt-BR", "日本語", "und", "latin", "", None, "q1", "tlh")] == ["en", "en", "de", "zh-TW", "zh-TW", "zh-CN", "pt", "ja", *[None] * 6]


def test_languages_of_new_texts(lid):
    found = lid.scores(list(TEXTS.values()))
    assert [max(s, key=s.get) for s in found] == list(TEXTS)
    assert lid.scores(["", "[12]", "Σ = 4", "f(x) = 3", "± 0.5"]) == [None] * 5 and lid.scores([]) == []


def test_held_out_accuracy(lid):
    import duckdb

    rows = duckdb.execute("SELECT text, source_language FROM '/root/testdata/sf0.1/work_items.parquet' WHERE source_language IN ('en','de','fr','es','pt','it','ru','ja','ko','zh-CN','zh-TW') AND text IS NOT NULL ORDER BY hash(item_id) LIMIT 3000").fetchall()
    found = lid.scores([t for t, _ in rows])
    good = [max(s, key=s.get) == code for s, (_, code) in zip(found, rows, strict=True) if s]
    assert sum(good) / len(good) > 0.85  # more than a tenth of the labels is wrong by design


def test_segments(spark, lid):
    mixed = f"{TEXTS['en']}.\n{TEXTS['de']}.\n[3]\n{TEXTS['de']}!\n{TEXTS['ja']}。"
    rows = [(1, mixed, "en"), (2, TEXTS["fr"], "fr-CA"), (3, TEXTS["fr"], "de"), (4, TEXTS["fr"], None), (5, "[12]", None), (6, None, "en"), (7, "", "en"), (3, TEXTS["fr"], "de")]
    frame = spark.createDataFrame(rows, "rec_id bigint, text string, label string")
    got = sorted((r.rec_id, r.seg_no, r.lang) for r in langs.languages(frame, lid, True, True).collect())
    assert got == [(1, 0, "en"), (1, 1, "de"), (1, 2, "ja"), (3, 0, "fr"), (4, 0, "fr")]
    every = langs.languages(frame, lid, False).collect()
    assert {r.rec_id for r in every} == {1, 2, 3, 4} and all(0 <= r.confidence <= 1 for r in every)


# ---- 1: pairs

PAIRS = [
    (1, TEXTS["en"] + ".", TEXTS["de"] + ".", None), (2, TEXTS["en"] + ".", TEXTS["en"], "copied"), (3, TEXTS["en"] + ".", TEXTS["fr"] + ".", "wrong_language"), (4, TEXTS["en"] + ".", "Das ist nicht der,", "truncated"),
    (5, TEXTS["en"] + ".", "I'm sorry, but I can't translate this.", "refusal"), (6, TEXTS["en"] + ".", None, "empty"), (7, TEXTS["en"] + ".", " … ", "empty"), (8, TEXTS["de"] + ".", TEXTS["de"] + ".", None), (9, "[12]", "[12]", None),
    (10, TEXTS["en"] + ".", "Translation: " + TEXTS["en"].upper(), "copied"), (11, None, TEXTS["de"] + ".", None),
]


def test_defects(spark, lid):
    good = [(100 + i, f"{TEXTS['en']} {i}.", f"{TEXTS['de']} {i}.") for i in range(60)]
    items = spark.createDataFrame([(i, s) for i, s, *_ in [*PAIRS, *good]] + [(1, PAIRS[0][1])], "item_id bigint, text string")
    requests = spark.createDataFrame([(1, "de", [i for i, *_ in PAIRS] + [99, None]), (2, "DE", [i for i, *_ in good]), (3, None, None)], "request_id bigint, target_language string, item_ids array<bigint>")
    replies = spark.createDataFrame([(1, i, r) for i, _, r, _ in PAIRS] * 2 + [(2, i, r) for i, _, r in good], "request_id bigint, item_id bigint, translation string")
    got = {(r.request_id, r.item_id): r.labels[0] for r in pairs.defects(requests, items, replies, lid).collect()}
    assert got == {(1, i): d for i, _, _, d in PAIRS if d} | {(1, 99): "missing"}
    assert pairs.defects(requests.limit(0), items, replies, lid).count() == 0


def test_label_model_finds_the_class():
    post = pairs.label_model({"++": 40.0, "+-": 5.0, "-+": 5.0, "--": 950.0, "00": 10.0})
    assert post["++"] > 0.99 > post["+-"] and post["--"] == 0 and pairs.label_model({}) == {}
    assert 0.3 <= pairs.cutoff({"++": 40.0, "--": 10.0}, {"++": 0.99, "--": 0.0}) <= 0.99


# ---- 2: pieces


def check(text, limit, overlap):
    out = pieces.cut(text, limit, overlap)
    sound = 3000 if limit is None or limit < 200 else limit
    edges = {m.start() for m in regex.finditer(r"\X", text)} | {len(text)}
    assert "".join(text[a + s : b] for a, b, s in out) == text
    for a, b, _ in out:
        assert a in edges and b in edges
        assert b - a <= sound or len(regex.findall(r"\X", text[a:b])) == 1
    return out


def test_cut_at_boundaries():
    text = " ".join(f"Sentence number {i} is here." for i in range(100))
    out = check(text, 500, 40)
    least = 1 + -(-(len(text) - 500) // 460)
    assert least <= len(out) <= least + 1 and all(text[:b].rstrip().endswith(".") for _, b, _ in out) and all(s == 40 for *_, s in out[1:])
    assert pieces.cut("short", 500, 40) == [(0, 5, 0)] and pieces.cut(None, 1, 1) == [] == pieces.cut("", 1, 1)
    assert len(check("x" * 7000, None, 0)) == 3 and len(check("x" * 7000, -1, None)) == 3
    lines = "\n".join("word " * 30 for _ in range(20))
    assert all(lines[b - 1] == "\n" for _, b, _ in check(lines, 700, 0)[:-1])


def test_cut_never_inside_a_character():
    family = "👨‍👩‍👧‍👦"
    check((family + "é") * 200, 200, 30)
    check("a" + "́" * 500 + "b" * 300, 200, 30)
    check("한국어" * 300 + unicodedata.normalize("NFD", "각") * 200, 250, 100)


@hyp(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab .,\né́中。👍🏽‍"), min_size=1, max_size=900), st.integers(200, 300), st.integers(-5, 400))
def test_cut_any_text(text, limit, overlap):
    check(text, limit, overlap)


def test_piece_frames(spark):
    blocks = spark.createDataFrame([(1, "x " * 400, 1), (1, "x " * 400, 1), (2, "x " * 400, 9), (3, None, 1), (4, "", 1), (5, "y " * 2000, None)], "block_no bigint, text string, profile_id int")
    options = spark.createDataFrame([(1, 300, 20), (2, None, None)], "profile_id int, max_chars_per_request int, overlap_chars int")
    got = pieces.pieces(blocks, options).groupBy("block_no").count().collect()
    assert {r.block_no: r["count"] for r in got} == {1: 3, 5: 2}


# ---- 6: packing


def test_first_fit_decreasing_against_the_plain_way():
    rng = random.Random(3)
    for _ in range(50):
        sizes, capacity = [rng.randint(0, 60) for _ in range(rng.randint(0, 80))], 50
        room, plain = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            if sizes[i] > capacity:
                continue
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [capacity] * (k == len(room))
            room[k] -= sizes[i]
            plain[i] = k
        got = packing.first_fit_decreasing(sizes, capacity)
        assert {i: got[i] for i in plain} == plain
        assert len({got[i] for i in range(len(sizes)) if i not in plain}) == len(sizes) - len(plain)


def test_packing(spark):
    documents = spark.createDataFrame([(1, "word " * 900), (2, "字" * 3000), (3, ""), (4, None), (5, "short"), (6, "a" * 5000)], "doc_id bigint, text string")
    budgets = spark.createDataFrame([(1, 128), (2, 4096), (3, None), (4, 0), (1, 128)], "budget_id int, capacity_tokens int")
    rows = packing.pack(documents, budgets, group=3).collect()
    coder = packing.encoding()
    text = {1: "word " * 900, 2: "字" * 3000, 5: "short", 6: "a" * 5000}
    fill, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r.budget_id, r.doc_id, r.part_no)):
        piece = text[r.doc_id][r.start_pos : r.end_pos]
        assert len(coder.encode_ordinary(piece)) == r.n_tokens
        fill[r.budget_id, r.container] = fill.get((r.budget_id, r.container), 0) + r.n_tokens
        seen[r.budget_id, r.doc_id] = seen.get((r.budget_id, r.doc_id), "") + piece
    assert seen == {(b, k): t for b in (1, 2) for k, t in text.items()}
    assert all(n <= {1: 128, 2: 4096}[b] for (b, _), n in fill.items())
    assert packing.pack(documents.limit(0), budgets).count() == 0


# ---- 7: leaks

ITEM = "Beside the zealous anchor of Jalbel, a amber window trusts the hammer while every saddle gathers its grateful pillar. When Sormond delays 32 crooked engines, the pebble near the kettle carries no fragile quarry."
ZH = "冰冷的长廊藏起竹篮，而弯曲的青砖又画下了43个水井。当草帽交换冰冷的渔网的时候，铜钟已经寻找了明亮的马鞍。"


def plain_share(text, item, n=8):
    """Brute force: words of the item in runs of n that stand in the text, by one greedy pass; exact for single passages."""
    words, squashed = leaks.units(item), leaks.squash(text)
    hit = [False] * len(words)
    for i in range(len(words) - n + 1):
        if "".join(words[i : i + n]) in squashed:
            hit[i : i + n] = [True] * n
    return sum(hit) / len(words)


def test_leaks():
    model = leaks.Leaks([(1, ITEM), (2, ZH), (3, "too short to match"), (4, ""), (5, None)])
    assert model.of(f"x {ITEM} y")[1][0] == 1.0 and model.of(ITEM.upper().replace(" ", "\n").replace("a", "а"))[1][0] == 1.0
    assert model.of(ZH)[2][0] == 1.0 and model.of("前文" + ZH[:30] + "后文")[2][0] == pytest.approx(plain_share(ZH[:30], ZH))
    assert model.of("so it is too short to match here")[3][0] == 1.0
    words = ITEM.split()
    assert model.of(" ".join(words[:7])) == {} and model.of(None) == {} and model.of("") == {}
    half = " ".join(words[:12]) + " other words between them " + " ".join(words[14:24])
    assert model.of(half)[1][0] == pytest.approx(22 / len(words))
    swapped = " ".join(words[14:24]) + " other words between them " + " ".join(words[:12])
    assert model.of(swapped)[1][0] == pytest.approx(12 / len(words))
    kana = "このことばはひらがなだけでかかれたながいぶんです"
    assert leaks.Leaks([(1, kana)]).of("まえ" + kana[4:20] + "あと")[1][0] == pytest.approx(16 / len(kana))
    broken = ITEM.replace("grateful", "grate-\r\nful")
    assert model.of(broken)[1][0] == 1.0


@hyp(max_examples=60, deadline=None)
@given(st.integers(0, 30), st.integers(1, 36), st.lists(st.sampled_from("the amber zealous window no pebble 32 kettle".split()), max_size=30))
def test_leaks_against_brute_force(start, size, noise):
    words = ITEM.split()
    text = " ".join([*noise, *words[start : start + size], *noise])
    got = leaks.Leaks([(1, ITEM)]).of(text).get(1, (0.0,))[0]
    assert got <= plain_share(text, ITEM) + 1e-9
    if min(size, len(words) - start) >= 8:
        assert got >= min(size, len(words) - start) / len(words) - 1e-9


def test_leak_frames(spark):
    documents = spark.createDataFrame([(1, f"a {ITEM}"), (2, f"a {ITEM}"), (3, None), (4, ""), (5, "nothing")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaks(documents, items).collect()) == [(1, 7), (2, 7)]
    two = spark.createDataFrame([(7, "another text of the same item, which no document holds at all"), (7, ITEM)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaks(documents, two).collect()) == [(1, 7), (2, 7)]
    assert leaks.leaks(documents, items.limit(0)).count() == 0 == leaks.leaks(documents.limit(0), items).count()


# ---- 8: harmful language


def test_undisguised():
    lexicon = abuse.Lexicon()
    assert [lexicon.plain(forms.skeleton(t)) for t in ("1d1ot", "idi0t", "idioooot", "m*ron", "Jalron33", "X87")] == ["idiot", "idiot", "idiot", "moron", "jalron33", "x87"]
    assert abuse.undisguised("you i d i o t here") == "you idiot here" and abuse.undisguised("you i.d.i.o.t!") == "you idiot!"
    assert abuse.undisguised("你这白 痴") == "你这白痴" and abuse.undisguised("T. R. Osmund") == "T. R. Osmund"


def test_nearest_is_exact():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    from collections import Counter

    examples = [(Counter(rng.choices(words, k=rng.randint(1, 9))), rng.choice(["", "abusive", "sexual"]), str(i)) for i in range(500)]
    index = abuse.Index(examples, {w: 0.5 + rng.random() * 3 for w in words}, block=16)
    vectors = [index.vector(index.bags[i]) for i in range(500)]
    for _ in range(60):
        query = index.vector(Counter(rng.choices(words, k=6)))
        every = sorted(((sum(w * v.get(t, 0.0) for t, w in query.items()), -i) for i, v in enumerate(vectors)), reverse=True)
        every = [(s, -i) for s, i in every if s >= 0.3][:9]
        got = index.nearest(query, 9, 0.3, harmless=True)
        assert [i for _, i in got] == [i for _, i in every] and [s for s, _ in got] == pytest.approx([s for s, _ in every])


def test_judge(spark):
    harmless = ["The paper describes the method.", "The word “idiot” appears in comments.", "Age and gender of readers were noted.", "The process kills its children and waits."]
    harmful = ["You are a stupid idiot and everybody knows it.", "All foreigners are vermin and should be thrown out.", "Free porn videos, click here."]
    rows = [(i, t) for i, t in enumerate(harmless * 3 + harmful * 3)] + [(100, None), (101, ""), (102, "You are an 1d1ot."), (103, "Women are vermin."), (104, "Vous lisez ce texte.")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "a", int(t in harmful)) for i, t in rows if i < 100] + [(0, "b", None), (0, "a", 0)], "doc_id bigint, annotator string, label int")
    judge = abuse.judge_of(documents, labels)
    found = {(r.doc_id, r.category) for r in abuse.judged(documents, judge).where(F.col("score") >= 0.5).collect()}
    expected = {(i, c) for i, t in rows if t for h, c in zip(harmful, abuse.CATEGORIES, strict=True) if t == h} | {(102, "abusive"), (103, "hateful")}
    assert found == expected
    none = abuse.judge_of(documents, labels.limit(0))
    assert none.document("You are a pathetic idiot.") == {} == none.document(None) and abuse.judged(documents.limit(0), judge).count() == 0


def test_passed_texts_have_no_near_example(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judge = abuse.judge_of(documents, spark.read.parquet("/root/testdata/sf0.01/review_labels.parquet"))
    passed = opened = 0
    for r in documents.collect():
        text = abuse.undisguised(r.text)
        for sentence in abuse.sentences(text):
            vector = judge.index.vector(judge.lexicon.bag(sentence))
            every = judge.index.nearest(vector, 9, judge.least, harmless=True)
            if not judge.may_hold(sentence):
                passed += 1
                assert not any(judge.index.category[place] for _, place in every)
            else:
                opened += 1
                assert judge.index.nearest(vector, 9, judge.least) in ([], every)
            assert judge.may_hold(text) or not judge.may_hold(sentence)
    assert passed > 1000 and opened > 10


def test_document_frequency(spark):
    texts = ["The Threshold of thresholds, the end.", "ТВАРЬ und Größe_3", "这个问题，问题", None, "", "no"]
    documents = spark.createDataFrame([(t,) for t in texts], "text string")
    terms = {"the", "threshold", "thresh~", "thresholds", "größe_3", forms.skeleton("тварь"), "问题", "个问", "题问", "absent"}
    assert abuse.document_frequency(documents, terms) == {"": 4, "the": 1, "threshold": 1, "thresh~": 1, "thresholds": 1, "größe_3": 1, forms.skeleton("тварь"): 1, "问题": 1, "个问": 1}


def test_bounded_sample(spark):
    from pagewright.llm._sample import bounded, thinned

    df = spark.range(20_000).selectExpr("id % 5000 AS k", "repeat('x', 10) AS t")
    rows = bounded(df, 300, "k")
    assert 40 <= len(rows) <= 300 and len({r.k for r in rows}) == len(rows) and rows == bounded(df.repartition(7), 300, "k")
    assert thinned(df, 300, 20_000, "k").count() < 1000 and len(bounded(df.limit(10), 300, "k")) == df.limit(10).distinct().count()
    assert bounded(df.limit(0), 300, "k") == []


# ---- all queries, on the smallest tables


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    frame = queries.queries()[name](spark, D)
    assert frame.count() > 0
    columns = {"p1_found": "request_id item_id defect", "p2_found": "block_no", "p3_found": "tbl rec_id seg_no lang", "p4_found": "tbl id_a id_b", "p5_found": "tbl rec_id end_pos", "p7_found": "doc_id item_id", "p8_found": "doc_id category"}
    if name in columns:
        assert frame.columns == columns[name].split()
        assert frame.count() == frame.distinct().count()
