"""Problem 1: defective replies, by noisy labelling functions and a label model.

For each defect several labelling functions vote yes (+), no (-) or nothing (0) on a pair of source text and reply. For
each defect a label model with one hidden class learns by expectation maximization how often each function votes what in
and outside the class, from the counts of all vote patterns of the whole table. A label is kept where its posterior
exceeds a cutoff that is validated on the same counts: the one with the highest expected F1. A pair may keep several.

missing and empty are facts, not guesses, and need no model. Null texts: a null reply is empty, a null source gets
votes only from the functions that look at the reply.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from ._arrow import map_columns
from .forms import normalised
from .langs import LanguageModel, label_code, label_units
from .sents import sentences

MODELLED = ("refusal", "copied", "wrong_language", "truncated")
ORDER = ("missing", "empty", *MODELLED)

# How a model declines, in the eleven languages; lower case, without invisible characters.
_DECLINES = {
    "en": r"\b(?:i(?:['’]m| am)? (?:sorry|afraid)|sorry,|i apologi[sz]e)|(?:can(?:no|['’])t|can ?not|unable to|not able to|won['’]t|must (?:decline|refuse)|decline to|refuse to|not allowed to|not permitted to) (?:\w+ ){0,4}?(?:translat|process|help|assist|provide|comply|render|answer|fulfil)"
    r"|(?:against|violat\w+) (?:my|our|the|usage|content)\w* (?:\w+ )?(?:guidelines|polic|rules)|not (?:in a position|comfortable|going) to (?:\w+ ){0,2}?(?:translat|render|process|help)|(?:rather|prefer) not (?:to )?(?:translat|render)|wo(?:n['’]t|uld not) be able to|have to (?:decline|refuse)|no translation (?:is|can be|will be) (?:given|provided)|as an? (?:ai|(?:large )?language (?:model|system)|assistant)",
    "de": r"es tut mir (?:sehr )?leid|tut mir leid|(?:kann|darf|werde|möchte|muss) (?:ich )?(?:\S+ ){0,6}?(?:nicht (?:\w+ )?(?:übersetz|bearbeit|helf|wiedergeb|weiterhelf)|ablehnen)|(?:muss|möchte) (?:\S+ ){0,4}?(?:ablehnen|verweigern)|nicht in der lage,? (?:\S+ ){0,4}?(?:übersetz|zu übersetz|wiederzugeb)|lieber nicht übersetz|als (?:ki|sprach(?:modell|system))|keine übersetzung|richtlinien|entschuldigung",
    "fr": r"désolée?|je (?:ne (?:peux|puis|suis)|regrette|dois (?:\w+ )?(?:refuser|décliner))|impossible de traduire|pas en mesure|nous ne pouvons (?:\w+ )?traduire|je préfère ne pas|traduction (?:\S+ ){0,5}?impossible|en tant qu(?:e|['’])|aucune traduction|contraire à (?:mes|nos|aux)",
    "es": r"lo siento|lo lamento|lamento|(?:debo|tengo que) (?:rechazar|declinar|negarme)|no puedo|no me es posible|como (?:un )?(?:modelo de|sistema de|asistente)|no se ofrece|ninguna traducción|prefiero no traducir|\binfringen?\b(?! (?:(?:up)?on|the|our|an?|any|your|their|its|his|her|my|no|this|that|these|those|such|others?|copyrights?|patents?|rights?|privacy)\b)|mis (?:normas|directrices)",
    "pt": r"lamento|desculpe|sinto muito|(?:tenho (?:de|que)|devo) (?:recusar|declinar)|não posso|não consigo|não me é possível|como (?:um )?(?:modelo de|sistema de|assistente)|nenhuma tradução|prefiro não traduzir|minhas (?:regras|diretrizes|normas)",
    "it": r"mi dispiace|spiacente|(?:devo|sono costretto a) (?:rifiutare|declinare)|non posso|non sono in grado|come (?:un )?(?:modello di|sistema di|assistente)|nessuna traduzione|preferisco non tradurre|mie (?:linee|regole)",
    "ru": r"извините|простите|сожалею|перевести (?:\S+ ){0,4}?(?:невозможно|нельзя|не (?:получится|могу))|не могу|не в состоянии|не имею возможности|как (?:языковая|ии)|перевод не|(?:вынужден[а-я]*|должен|должна) (?:\w+ )?(?:отказ|отклон)|отказываюсь|отклоняю|правила[мх]? (?:использования|сервиса)",
    "zh": r"抱歉|对不起|對不起|无法(?:翻译|处理|提供|协助|帮助|完成)|無法(?:翻譯|處理|提供|協助|幫助|完成)|不能(?:翻译|翻譯|提供|处理|處理)|恕不|恕难|恕難|不符合(?:使用)?(?:规定|規定|政策)|作为(?:一个)?(?:语言|人工智能|ai)|作為(?:一個)?(?:語言|人工智慧|ai)|拒绝|拒絕|请换|請換",
    "ja": r"申し訳|すみません|ごめんなさい|翻訳(?:する(?:こと)?が)?(?:は)?(?:できま|でき(?:ない|かね)|いたしかね|お断り)|お手伝いできま|対応できま|応じられま|言語モデルとして|(?:ご?依頼|ご?要望|リクエスト)\S{0,8}?(?:でき(?:ま|かね)|られま)|お?(?:応え|答え|引き受け)(?:は)?でき(?:ま|かね)|お断り|提供できま|ガイドライン",
    "ko": r"죄송|미안|번역(?:해 드릴|할) 수 없|번역하지 (?:못|않)|도와드릴 수 없|처리할 수 없|제공할 수 없|(?:요청|부탁)\S* ?(?:\S+ )?(?:들어줄|들어 드릴|처리할|수행할|응할) 수 없|언어 모델|거절|지침|유감",
}
# Words of a request for another input, which refusals carry.
_ASKS = re.compile(r"please (?:send|try|provide)|anything else|(?:incomplete|another (?:text|sentence|passage))|different (?:text|sentence|passage)|bitte (?:senden|schicken|geben|versuchen)|anderen? (?:text|satz)|veuillez|autre (?:texte|phrase|passage)|por favor|otr[oa] (?:texto|frase)|outr[oa] (?:texto|frase)|per favore|un['’]?altr[oa] (?:testo|frase)|пожалуйста|друг(?:ой|ое|ую) (?:текст|предложение)|请|請|ください|下さい|바랍니다|주세요|주십시오")
#: Functions whose vote starts a class: the wording of a refusal and the end of a reply speak for themselves.
_START = {"refusal": (0,), "truncated": (0,)}
#: Functions of which one has to vote: a refusal declines or asks for something else.
_NEED = {"refusal": (0, 2)}
_DECLINES = {k: re.compile(v) for k, v in _DECLINES.items()}
# A letter that every wording of a language has; no wording of the others is bound to a script.
_LETTER = {"ru": re.compile("[а-я]"), "zh": re.compile("[㐀-鿿]"), "ja": re.compile("[ぁ-ヿ]"), "ko": re.compile("[가-힣]")}
_SYMBOL = re.compile(r"[^\W_]")
_KEY = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"\d+(?:\.\d+)*")
_LIST = re.compile(r"\A\W*(?:\d{1,2}|[A-Za-z])[.)]\s+|(?<=[.!?。！？…])\s*\(?(?:\d{1,2}|[A-Za-z])[.)]\s+(?=\S)|\A\W*\d+(?:\.\d+)+\s+(?=\D)")
_NAME = re.compile(r"(?<![A-Za-z])[A-Za-z]*(?:[a-z][A-Z]|[A-Za-z]-?[A-Z]?\d)[A-Za-z\d-]*")
_CLOSING = " \t\n\r\xa0\"”“’»›」』）)]】*_`"
_MARKS = ".!?。！？．｡…,，、;；:：-"
_STOPS = re.compile(r"[.!?。！？…]+[\"”“’»」』）)]*(?=\s|\Z|[぀-鿿（“「『A-Z])")


def _vote(yes: bool | None, no: bool | None = None) -> str:
    return "+" if yes else "-" if (no if no is not None else yes is not None) else "0"


def _top(scores: dict[str, float] | None) -> tuple[str | None, float]:
    """The best language and by how much it beats the next one."""
    if not scores:
        return None, 0.0
    first, *rest = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    return first[0], min(2.0, first[1] - (rest[0][1] if rest else -2.0))


def _stop(text: str) -> str:
    """How a text ends: s with a full stop, e with an ellipsis, c with a comma or the like, b with a bracket, n with none."""
    core = text.rstrip(_CLOSING)
    rest = text[len(core) :]
    mark = core[len(core.rstrip(_MARKS)) :]
    if ("）" in rest or ")" in rest) and mark in ("", "."):
        # a stop inside brackets ends the text only where the brackets hold a whole sentence
        opened = max(text.rfind("("), text.rfind("（"))
        whole = mark and (opened <= 3 or text[:opened].rstrip()[-1:] in ".!?。！？”»」")
        return "s" if whole else "b"
    if not mark:
        return "n"
    if "…" in mark or ".." in mark:
        return "e"
    return "c" if mark[-1] in ",，、;；:：-" else "s"


def _grams(key: str) -> set[str]:
    return {key[i : i + 4] for i in range(max(1, len(key) - 3))}


def _lacks(text: str, other: str) -> bool:
    """Whether a letter or digit of the other text is missing in a text."""
    for c in other:  # noqa: SIM110 (ends soon where the scripts differ)
        if c not in text and c.isalnum():
            return True
    return False


def _declines(lower: str) -> bool:
    """Whether a text declines, by the patterns of all languages; those of a script are searched where it has a letter."""
    return any(p.search(lower) for k, p in _DECLINES.items() if (script := _LETTER.get(k)) is None or script.search(lower))


def wholly(source: str, target: str | None, model: LanguageModel, language: str | None = None) -> bool:
    """Whether all sentences of a text that have words are in the target language; language is that of the whole text."""
    units = [source[a:b] for a, b in sentences(source)]
    if len(units) == 1 and language is not None:
        return language == target
    return all(x is None or x[0] == target for x in label_units(model.scores(units), target))


def signals(source: str | None, reply: str, target: str | None, of_source: dict | None, of_reply: dict | None, same_script: bool | None, model: LanguageModel | None = None) -> dict[str, object]:
    """The votes for one pair, both texts normalised, except those that need the whole table.

    Without a model the language of the source as a whole says whether it is wholly in the target language.
    """
    plain = reply
    lower = plain.casefold()
    source_plain = source or ""
    language, margin = _top(of_reply)
    source_language, _ = _top(of_source)
    words = of_source is not None
    # the letters and digits alone are read only where a copy is possible, or a name may be spelled apart: in the target
    # language a reply can only hold the source whole, and not where it lacks one of its letters
    other = language is not None and language == target != source_language and source_language is not None
    without = not source_plain or other and _lacks(lower, source_plain.casefold())
    key, source_key = ("", "") if without else (_KEY.sub("", lower), _KEY.sub("", source_plain.casefold()))
    # stray number signs are noise; what is counted are numbers and names as often as they stand
    here, there = plain.replace("#", ""), source_plain.replace("#", "")
    numbers, given = [_NUMBER.findall(t.replace(",", ".")) for t in (here, _LIST.sub(" ", there))]
    names, given_names = _NAME.findall(here), _NAME.findall(there)
    lost = set(given).difference(numbers)
    lost_names = set(given_names).difference(names)
    if lost_names:
        key = key or _KEY.sub("", lower)
        source_key = source_key or _KEY.sub("", source_plain.casefold())
        lost_names = [n for n in lost_names if n.casefold() not in key and _KEY.sub("", n.casefold()) not in key]
    # a number or name that stands in another spelling is no sign that the text stops
    cut_numbers = bool(lost) and (Counter(given) - Counter(numbers)).total() > (Counter(numbers) - Counter(given)).total()
    cut_names = bool(lost_names) and (Counter(given_names) - Counter(names)).total() > (Counter(names) - Counter(given_names)).total()
    marks = bool(given or given_names)
    # refusal
    declines = _declines(lower) and not (source and _declines(source_plain.casefold()))
    unlike = marks and len(lost) == len(set(given)) and len(lost_names) == len(set(given_names))
    refusal = _vote(declines, True) + _vote(unlike if marks else None) + _vote(bool(_ASKS.search(lower)), False)
    # copied
    whole = words and source_language == target
    if without or not words:
        copied = "---"
    else:
        inside = len(source_key) >= 4 and source_key in key and len(key) <= 2 * len(source_key) + 80
        near = not inside and source_key and language in (None, source_language) and 0.8 <= len(key) / len(source_key) <= 1.5 and len(_grams(source_key) & _grams(key)) >= 0.9 * len(_grams(source_key))
        if model is not None and words and (inside or near):  # elsewhere nothing asks for it
            whole = wholly(source_plain, target, model, source_language)
        # a reply that holds all of a mixed text stays in its languages, whichever is the larger part
        stays = language == source_language and (language != target or inside and not whole)
        copied = _vote(inside, True) + _vote(inside or near, True) + _vote(stays, language is not None and language == target)
    # wrong language
    if target is None or not words and language is None:
        wrong = "---"
    else:
        wrong = _vote(language is not None and language != target and margin > 0.6, language == target and margin > 0.2)
        wrong += _vote(None if same_script is None else not same_script)
        wrong += _vote(of_reply is not None and target is not None and of_reply.get(target, -2.0) < -0.3, of_reply is not None and of_reply.get(target, -2.0) > 0.3)
    # truncated
    if not _SYMBOL.search(source_plain):
        truncated, ratio = "0000", None
    else:
        before, after = _stop(source_plain), _stop(plain)
        tail = "0" if before in "ncb" or after == "b" else "+" if after in "nc" or after == "e" and before != "e" else "-"
        few = len(_STOPS.findall(plain)) - len(_STOPS.findall(source_plain))
        truncated = tail + (_vote(cut_numbers) if given else "0") + (_vote(cut_names) if given_names else "0") + ("+" if few < 0 else "-" if few == 0 else "0")
        ratio = log((len(plain) + 1) / (len(source_plain) + 1))
    return {"refusal": refusal, "copied": copied, "wrong_language": wrong, "truncated": truncated, "ratio": ratio, "exempt": bool(source is not None and (not words or whole)), "src": source_language}


def _features(model) -> Callable[[dict[str, list]], dict[str, list]]:
    scripts = {"ru": (3,), "ja": (4, 5), "zh-CN": (4,), "zh-TW": (4,), "ko": (6,)}

    def batch(columns: dict[str, list]) -> dict[str, list]:
        names = ("request_id", "item_id", "src", "tgt", "ratio", "exempt", "empty", "whole", *MODELLED)
        out: dict[str, list] = {k: [] for k in names}
        replies = [normalised(r) if r else "" for r in columns["translation"]]
        sources = [normalised(s) if s else "" for s in columns["text"]]
        lid: LanguageModel = model.value
        of_replies, counts = lid.scores_and_counts(replies)
        of_sources = lid.scores(sources)
        for k, (request, item, target, source) in enumerate(zip(columns["request_id"], columns["item_id"], columns["target_language"], columns["text"], strict=True)):
            source = None if source is None else sources[k]
            reply, code = replies[k], label_code(target)
            row: dict[str, object] = {"request_id": request, "item_id": item, "tgt": code, "empty": not _SYMBOL.search(reply)}
            same = None
            if code:
                own = counts[k]
                letters = own[1] / 5 + own[2] / 50 + own[3] / 5 + own[4] / 2 + own[5] + own[6] / 2
                if letters > 0.5:
                    fit = sum(own[s] / (5 if s == 3 else 1 if s == 5 else 2) for s in scripts.get(code, ())) if code in scripts else own[1] / 5 + own[2] / 50
                    if code == "ja" and own[4] > 8 and not own[5] or code in ("zh-CN", "zh-TW") and own[5] > 2:
                        fit = 0
                    same = fit / letters > 0.3
            row |= {"src": None, "ratio": None, "exempt": False, **dict.fromkeys(MODELLED, "")} if row["empty"] else signals(source, reply, code, of_sources[k], of_replies[k], same, lid)
            # only replies without any number or name of their own can answer many sources
            row["whole"] = None if row["empty"] or _NUMBER.search(reply) or _NAME.search(reply) else _KEY.sub("", reply.casefold())
            for name in names:
                out[name].append(row[name])
        return out

    return batch


def label_model(counts: dict[str, float], prior: float = 0.03, rounds: int = 60, start: tuple[int, ...] = (), need: tuple[int, ...] = ()) -> dict[str, float]:
    """Posteriors of vote patterns by expectation maximization over their counts.

    The class starts as the patterns with more votes for it than against it, and those with a vote of a function in start.
    Patterns without a vote of any function in need, where there are such, stay out.
    """
    if not counts:
        return {}
    size = len(next(iter(counts)))
    post = {p: 0.95 if p.count("+") > p.count("-") or any(p[k] == "+" for k in start) else 0.5 if p.count("+") and p.count("+") == p.count("-") else 0.02 for p in counts}
    for _ in range(rounds):
        total = sum(counts.values())
        inside = sum(n * post[p] for p, n in counts.items())
        share = (inside + prior * 10) / (total + 10)
        # a vote for the class is more likely inside than outside: the smoothing says so
        yes = [{v: (sum(n * post[p] for p, n in counts.items() if p[k] == v) + a) / (inside + 10) for v, a in (("+", 5), ("-", 4), ("0", 1))} for k in range(size)]
        no = [{v: (sum(n * (1 - post[p]) for p, n in counts.items() if p[k] == v) + a) / (total - inside + 10) for v, a in (("+", 0.05), ("-", 7.95), ("0", 2))} for k in range(size)]
        for k in start:  # such a function is wrong once in a thousand at most, however few cases there are
            no[k]["+"] = min(no[k]["+"], 0.001)
        for p in post:
            score = log(share / (1 - share)) + sum(log(yes[k][v] / no[k][v]) if v != "0" else 0.0 for k, v in enumerate(p))
            post[p] = 1 / (1 + exp(-max(-40.0, min(40.0, score)))) if "+" in p and (not need or any(p[k] == "+" for k in need)) else 0.0
    return post


def cutoff(counts: dict[str, float], post: dict[str, float]) -> float:
    """The cutoff with the highest expected F1; 0.5 where there is no case."""
    best, value, kept, right = 0.5, 0.0, 0.0, 0.0
    total = sum(n * post[p] for p, n in counts.items())
    for p in sorted(counts, key=lambda x: -post[x]):
        kept += counts[p]
        right += counts[p] * post[p]
        f1 = 2 * right / (kept + total) if kept + total else 0.0
        if f1 > value + 1e-12:
            best, value = post[p] - 1e-9, f1
    return min(max(best, 0.3), 0.9)


def pairs(requests: DataFrame, items: DataFrame, replies: DataFrame) -> DataFrame:
    """(request_id, item_id, target_language, text, translation, missing): each id of each request once."""
    asked = requests.select("request_id", "target_language", F.explode("item_ids").alias("item_id")).where("item_id is not null").distinct()
    texts = items.groupBy("item_id").agg(F.max("text").alias("text"))
    got = replies.where("request_id is not null and item_id is not null").groupBy("request_id", "item_id").agg(F.max("translation").alias("translation"))
    return asked.join(got.withColumn("came", F.lit(True)), ["request_id", "item_id"], "left").join(texts, "item_id", "left").select("request_id", "item_id", "target_language", "text", "translation", F.col("came").isNull().alias("missing"))


def defects(requests: DataFrame, items: DataFrame, replies: DataFrame, model: LanguageModel, short: float = 0.4, repeated: int = 4) -> DataFrame:
    """(request_id, item_id, labels): the pairs with a defect and all that fit, in order."""
    spark = requests.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    every = pairs(requests, items, replies)
    missing = every.where("missing").select("request_id", "item_id")
    schema = "request_id bigint, item_id bigint, src string, tgt string, ratio double, exempt boolean, empty boolean, whole string, " + ", ".join(f"{x} string" for x in MODELLED)
    rows = every.where("not missing").select("request_id", "item_id", "target_language", "text", "translation")
    rows = map_columns(rows, _features(shared), schema).withColumn("whole", F.when(F.col("whole").isNotNull(), F.xxhash64("whole")))
    rows = cut(rows.unionByName(missing.withColumn("absent", F.lit(True)), allowMissingColumns=True))
    present = rows.where("absent is null and not empty")
    # lengths by pair of languages, over all pairs; at most as many rows as there are pairs of languages
    usual = present.where("ratio is not null").groupBy("src", "tgt").agg(F.avg("ratio").alias("usual")).select(F.coalesce("src", F.lit("")).alias("s"), F.coalesce("tgt", F.lit("")).alias("t"), "usual")
    scored = present.join(F.broadcast(usual), (F.coalesce("src", F.lit("")) == F.col("s")) & (F.coalesce("tgt", F.lit("")) == F.col("t")), "left").withColumn("gap", F.col("ratio") - F.col("usual"))
    # replies that answer sources of very different lengths; aggregates only, so no group is gathered
    often = scored.where("whole is not null").groupBy(F.col("whole").alias("w")).agg(F.count("gap").alias("n"), F.stddev_pop("gap").alias("spread")).where((F.col("n") >= repeated) & (F.col("spread") > 0.25)).select("w")
    scored = scored.join(often, F.col("whole") == F.col("w"), "left")
    gap = F.col("gap")
    scored = scored.select(
        "request_id", "item_id", "exempt",
        F.concat("refusal", F.when(F.col("w").isNotNull(), "+").otherwise("-")).alias("refusal"),
        "copied", "wrong_language",
        F.concat("truncated", F.when(gap < -short, "+").when(gap > -short / 2, "-").otherwise("0")).alias("truncated"),
    )
    long = scored.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in MODELLED]), F.array(*MODELLED))).alias("defect", "votes"))
    table: dict[str, dict[str, float]] = {x: {} for x in MODELLED}
    for row in long.groupBy("defect", "votes").count().collect():  # at most 3 to the number of functions, of each defect
        table[row["defect"]][row["votes"]] = float(row["count"])
    labels = [F.when(F.col("absent"), F.lit("missing")), F.when(F.col("empty"), F.lit("empty"))]
    kept = []
    for name in MODELLED:
        post = label_model(table[name], start=_START.get(name, ()), need=_NEED.get(name, ()))
        bar = cutoff(table[name], post)
        good = [p for p, value in post.items() if value > bar]
        hit = F.col(name).isin(good) if good else F.lit(False)
        if name in ("copied", "wrong_language", "truncated"):
            hit = hit & (~F.col("exempt") if name == "copied" else F.lit(True))
        kept.append(F.when(hit, F.lit(name)))
    modelled = scored.select("request_id", "item_id", F.array_compact(F.array(*kept)).alias("labels"))
    plain = rows.where("absent or empty").select("request_id", "item_id", F.array_compact(F.array(*labels)).alias("labels"))
    return plain.unionByName(modelled).where(F.size("labels") > 0)
